"""Licence scans: Aho-Corasick for tags and notices, shunting-yard for expressions.

One automaton holds every notice phrase and every tag behind which an expression may
stand (`SPDX-License-Identifier:`, `license:`, `licensed under`). It runs over a text's
words, joined by single spaces, so that a phrase stands however it is punctuated. An
expression is read from the raw text behind its tag: identifiers, `and`, `or`, `with`
and brackets, turned into postfix order by the operators' precedence and evaluated on
what licences grant: of parts joined by `and` the least counts, by `or` the most, and an
exception leaves its licence's grant.

A text is one row and passes through one task whole; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.bytes_ import flat

# The phrases and labels that the contract names.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: More notices. Of those that start at one word the longest counts.
NOTICES = {
    "mit license": "mit", "the mit license": "mit", "apache license": "apache-2", "apache license 2": "apache-2", "apache software license": "apache-2",
    "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2", "gnu general public license v2": "gpl-2",
    "gnu general public license version 3": "gpl-3", "gnu general public license v3": "gpl-3", "gnu gpl": "gpl",
    "gnu lesser general public license": "lgpl", "gnu lesser general public license version 2 1": "lgpl-2.1", "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license": "agpl", "gnu affero general public license version 3": "agpl-3", "mozilla public license": "mpl", "mozilla public license version 2": "mpl-2", "mozilla public license 2": "mpl-2",
    "eclipse public license": "epl", "bsd license": "bsd", "2 clause bsd license": "bsd-2-clause", "3 clause bsd license": "bsd-3-clause", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc", "zlib license": "zlib", "boost software license": "bsl-1", "the unlicense": "unlicense", "cc0": "cc0", "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain", "released into the public domain": "public-domain",
    "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution share alike": "cc-by-sa", "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc", "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "all rights reserved": "proprietary", "unauthorized copying of this file": "proprietary",
}
#: Phrases behind which an expression may stand; behind those of the first row a colon or an equals sign must follow.
MARKED = ("spdx license identifier", "license", "licence", "license expression")
SPOKEN = ("licensed under", "licensed under the", "released under", "released under the", "available under", "available under the", "distributed under", "distributed under the")
#: What a licence grants to one who trains on a text, by the licence's family; the longest prefix counts.
GRANTS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "0bsd": 1.0, "isc": 1.0, "zlib": 1.0, "bsl": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0, "wtfpl": 1.0, "cc-by": 0.9, "artistic": 0.8, "python": 1.0, "psf": 1.0,
    "mpl": 0.7, "lgpl": 0.7, "epl": 0.7, "cddl": 0.7, "eupl": 0.6, "cc-by-sa": 0.6, "gpl": 0.5, "agpl": 0.4, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "licenseref": 0.1, "proprietary": 0.0,
}
#: Identifiers that stand without a version or number.
BARE = {"mit", "isc", "zlib", "unlicense", "wtfpl", "gpl", "lgpl", "agpl", "cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd"}
PRECEDENCE = {"with": 3, "and": 2, "or": 1}
_TOKEN = re.compile(r"[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*|[()])")
_VERSION = re.compile(r"(?:[.]0)+$")


def label_of(identifier: str) -> str | None:
    """The label of an identifier: without `-only`, `-or-later`, a plus sign, closing `.0`s and, for Creative Commons, a version.

    None if its family is not known, or if it has no number and is no BARE one.
    """
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower().rstrip("."))
    name = re.sub(r"-[0-9.]+$", "", name) if name.startswith("cc") else _VERSION.sub("", name)
    known = name in BARE or re.search("[0-9]", identifier) or name.startswith("licenseref-")
    return name if known and grant_of(name) is not None else None


@lru_cache(1 << 12)
def grant_of(label: str) -> float | None:
    parts = label.split("-")
    for n in range(len(parts), 0, -1):
        if (g := GRANTS.get("-".join(parts[:n]))) is not None:
            return g
    return None


def postfix(text: str, at: int = 0) -> tuple[list[str], int]:
    """(tokens in postfix order, end) of the longest expression at `at`; no token if there is none.

    It ends where a token cannot go on: an unknown identifier, two operands in a row, a
    bracket that was not opened. A trailing operator and brackets left open are dropped.
    An exception behind `with` may have any name.
    """
    out: list[str] = []
    held: list[tuple[str, int]] = []
    operand, depth, end = True, 0, at

    def popped(least: int) -> None:
        while held and held[-1][0] != "(" and PRECEDENCE[held[-1][0]] >= least:
            out.append(held.pop()[0])

    while m := _TOKEN.match(text, at):
        token = m[1]
        low = token.lower()
        if operand:
            if token == "(":
                held.append(("(", 0))
                depth += 1
            elif token == ")" or low in PRECEDENCE:
                break
            elif held and held[-1][0] == "with":
                out.append(low)
                operand = False
            elif (label := label_of(token)) is not None:
                out.append(label)
                operand = False
            else:
                break
        elif low in PRECEDENCE:
            popped(PRECEDENCE[low])
            held.append((low, len(out)))
            operand = True
        elif token == ")" and depth:
            popped(0)
            held.pop()
            depth -= 1
        else:
            break
        at = m.end()
        if not operand:
            end = at
    while held and operand:  # an operator that waits for its right side
        if held.pop()[0] != "(":
            operand = False
    popped(0)
    while held:
        held.pop()
        popped(0)
    return out, end


def evaluate(tokens: list[str]) -> tuple[set[str], float]:
    """(labels, grant) of an expression in postfix order."""
    stack: list[tuple[set[str], float]] = []
    for t in tokens:
        if t in PRECEDENCE:
            (right, b), (left, a) = stack.pop(), stack.pop()
            stack.append((left, a) if t == "with" else (left | right, min(a, b) if t == "and" else max(a, b)))
        else:
            g = grant_of(t)
            stack.append(({t}, 0.0 if g is None else g))
    return stack[0]


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    kinds: dict[str, list[tuple]] = {}
    for phrase, label in BASE.items():
        kinds.setdefault(phrase, []).append(("base", label))
    for phrase, label in NOTICES.items():
        kinds.setdefault(phrase, []).append(("notice", label))
    for phrase in MARKED:
        kinds.setdefault(phrase, []).append(("marked", ""))
    for phrase in SPOKEN:
        kinds.setdefault(phrase, []).append(("spoken", ""))
    for phrase, what in kinds.items():
        found.add_word(f" {phrase} ", (phrase.count(" ") + 1, len(phrase.rpartition(" ")[2]), what))
    found.make_automaton()
    return found


def _words_table() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    table[48:58] = np.arange(48, 58)
    table[97:123] = table[65:91] = np.arange(97, 123)
    return table


_WORDS = _words_table()
_MARK = re.compile(r"[\"'\]]?[ \t]*[:=][ \t]*[\"'\[]?")


def scan(x: np.ndarray) -> tuple[int, list[tuple[int, int, str, bool]], list[tuple[int, str, list[str], float]]]:
    """(words, notices, expressions) of a text's bytes.

    notices: (first word, words, label, whether the contract's). expressions: (first word
    of the tag, expression, labels, grant).
    """
    mapped = _WORDS[x]
    word = mapped != 32
    before = np.append(False, word[:-1]) if len(x) else word
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return 0, [], []
    joined = np.concatenate(([32], mapped[word | before], [32] if word[-1] else [])).astype(np.uint8)
    met = list(_automaton().iter(joined.tobytes().decode("latin-1")))
    if not met:
        return len(starts), [], []
    spaces = np.flatnonzero(joined == 32)
    notices, longest, tags = [], {}, []
    for end, (n, size, what) in met:
        at = int(np.searchsorted(spaces, end)) - n
        for kind, label in what:
            if kind == "base":
                notices.append((at, n, label, True))
            if kind in ("base", "notice"):
                longest[at] = max(longest.get(at, (0, "")), (n, label))
            else:
                tags.append((at, n, kind, size))
    own = {(a, n) for a, n, _, _ in notices}
    notices += [(a, n, label, False) for a, (n, label) in longest.items() if (a, n) not in own]
    expressions, taken = [], set()
    raw = x.tobytes().decode("latin-1") if tags else ""
    for at, n, kind, size in sorted(tags):
        stop = int(starts[at + n - 1]) + size
        m = _MARK.match(raw, stop) if kind == "marked" else None
        if kind == "marked" and not m:
            continue
        begin = m.end() if m else stop
        if begin in taken:
            continue
        tokens, end = postfix(raw, begin)
        if tokens:
            taken.add(begin)
            labels, grant = evaluate(tokens)
            expressions.append((at, raw[begin:end].strip(), sorted(labels), grant))
    return len(starts), sorted(notices), expressions


_NOTICE = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("base", pa.bool_())])
_EXPRESSION = pa.struct([("start", pa.int64()), ("expression", pa.string()), ("labels", pa.list_(pa.string())), ("grant", pa.float64())])
_SCHEMA = "n_words long, notices array<struct<start:long,words:long,label:string,base:boolean>>, expressions array<struct<start:long,expression:string,labels:array<string>,grant:double>>, score double"


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, notices, expressions, score.

    notices: places of phrases (start counts words from 0); expressions: what stands
    behind tags, evaluated. score is the least grant of all that was found, from 0
    (nothing granted, or nothing found) to 1. Null and empty texts have no words. Repeated
    rows and ids are rows of their own, a null id too; ids may have any type. An empty
    table gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat(b.column(1))
            n, notices, expressions, score = [], [], [], []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                words, found, told = scan(data[lo:hi])
                grants = [grant_of(label) for _, _, label, _ in found] + [e[3] for e in told]
                n.append(words)
                notices.append([dict(zip(("start", "words", "label", "base"), x, strict=True)) for x in found])
                expressions.append([dict(zip(("start", "expression", "labels", "grant"), x, strict=True)) for x in told])
                score.append(min(grants, default=0.0))
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(notices, pa.list_(_NOTICE)), pa.array(expressions, pa.list_(_EXPRESSION)), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "notices", "expressions", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, {_SCHEMA}").withColumnRenamed("id", id_col)


def labelled(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of licences()."""
    base = F.filter("notices", lambda x: x["base"])
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    place: Column = F.transform(base, lambda x: x["start"])
    names = F.concat(F.transform("notices", lambda x: x["label"]), F.flatten(F.transform("expressions", lambda x: x["labels"])))
    return found.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        listed(F.transform(base, lambda x: x["label"])).alias("base_labels"), listed(names).alias("labels"), "score",
    )
