"""JSON objects in free text, and letters without their marks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.spans import located

THOUGHT = r"(?s)<think>.*?</think>\s*"
FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"


def _object_at(text: Column, tokens: Column, start: Column) -> Column:
    """The text from a bracket at `start` to the one that closes it; null if none does. Brackets in strings do not count."""
    own = F.filter(tokens, lambda t: t["start"] >= start)
    begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(-1).alias("skip"), F.lit(None).cast("int").alias("end"))

    def step(s: Column, t: Column) -> Column:
        # What a backslash in a string stands before counts for nothing; nor does what follows the end.
        live = s["end"].isNull() & (t["start"] != s["skip"])
        quoted, mark = s["quoted"], t["match"]
        depth = F.when(live & ~quoted & (mark == "{"), s["depth"] + 1).when(live & ~quoted & (mark == "}"), s["depth"] - 1).otherwise(s["depth"])
        closed = live & ~quoted & (mark == "}") & (depth == 0)
        return F.struct(
            depth.alias("depth"), F.when(live & (mark == '"'), ~quoted).otherwise(quoted).alias("quoted"),
            F.when(live & quoted & (mark == "\\"), t["end"]).otherwise(s["skip"]).alias("skip"), F.when(closed, t["end"]).otherwise(s["end"]).alias("end"),
        )

    end = F.aggregate(own, begin, step, lambda s: s["end"])
    return F.substr(text, start + 1, end - start)


def json_in(text: Column) -> Column:
    """The first JSON object in a text, as VARIANT; null if there is none.

    What stands between <think> tags is no part of it; of fenced blocks the first counts.
    Opening brackets are tried in order: a balanced-bracket scan gives the text that one
    could span, and that must parse.
    """
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), THOUGHT, ""))
    fenced = F.regexp_extract(plain, FENCE, 1)
    body = F.when(plain.rlike(FENCE), fenced).otherwise(plain)
    tokens = located(body, r'[\\"{}]')
    starts = F.filter(tokens, lambda t: t["match"] == "{")
    tried = F.aggregate(starts, F.lit(None).cast("string"), lambda found, t: F.when(found.isNotNull(), found).otherwise(_valid(_object_at(body, tokens, t["start"]))))
    return F.try_parse_json(tried)


def _valid(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


# Letters that have no decomposition.
LETTERS = {
    "Ł": "L", "ł": "l", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Þ": "Th", "þ": "th", "Æ": "Ae", "æ": "ae",
    "Œ": "Oe", "œ": "oe", "ß": "ss", "Ħ": "H", "ħ": "h", "İ": "I", "ı": "i",
}


def _folded(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", LETTERS.get(c, c)) if not unicodedata.combining(x))


def _tables() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one each and what to, and those that fold to several; by the rule of compatible decomposition.

    Of the basic plane, without Hangul, whose syllables would fall apart into their parts.
    """
    one, to, several, marks = [], [], {}, []
    for code in range(0xA0, 0x10000):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or (f := _folded(c)) == c:
            continue
        if len(f) == 1:
            one.append(c)
            to.append(f)
        elif f:
            several[c] = f
        else:
            marks.append(c)
    # Characters without a counterpart go.
    return "".join(one + marks), "".join(to), several


_ONE, _TO, _SEVERAL = _tables()


def ascii_fold(text: Column) -> Column:
    """Letters without strokes and marks: Łódź is Lodz, ﬁ is fi. Others stay.

    One table for the characters that fold to one, and for marks that stand by themselves,
    which go; those that fold to several are looked up where a text has some.
    """
    table = F.create_map(*[F.lit(x) for p in _SEVERAL.items() for x in p])
    # Few different characters beyond ASCII stand in a text: each is looked up once and put everywhere.
    spelt = F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7F]"), F.lit(0))), text, lambda t, c: F.replace(t, c, F.coalesce(F.try_element_at(table, c), c)))
    return F.translate(spelt, _ONE, _TO)
