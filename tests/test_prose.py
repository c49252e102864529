"""Term searches, JSON in text, folded letters and run files against plain Python."""

import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from weft.functions.spans import located
from weft.functions.unfold import LETTERS, ascii_fold, json_in
from weft.operators import misreads, outcomes, terms
from weft.sources import runs


def test_located(spark):
    texts = [None, "", "a1b22", "1", "11 2", "x\x01y\x023", "é5 ÷ 6", "1" * 5000 + " 2" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in rows.select("id", located(F.col("text"), "[0-9]([0-9]*)").alias("s")).collect():
        plain = (texts[r.id] or "").replace("\x01", "").replace("\x02", "")
        assert [tuple(s) for s in r.s] == [(*m.span(), m[0]) for m in re.finditer("[0-9]+", plain)]


def test_find_terms(spark):
    """Every place, overlapping ones too; over shards as in one automaton."""
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abc é") for _ in range(rng.randrange(60)))) for i in range(80)] + [(90, None), (91, "")]
    words = ["a", "ab", "bc", "é", "abc", " a", "", None, "zz", "ab"]
    want = sorted((i, w, at, t[at - 1 : at] if at else "", t[at + len(w) : at + len(w) + 1]) for i, t in texts for w in {*words} - {"", None} for at in range(len(t or "")) if t.startswith(w, at))
    frame, own = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(w,) for w in words], "word string")
    for limit in ({}, {"shard_bytes": 3}):
        assert sorted(map(tuple, terms.find_terms(frame, ["id"], "text", own, "word", **limit).collect())) == want
    assert terms.find_terms(frame, ["id"], "text", own.where("word = 'none'"), "word").count() == 0
    assert terms.find_terms(frame.where("id < 0"), ["id"], "text", own, "word").count() == 0


def test_within(spark):
    rng = random.Random(6)
    a, b = ([(rng.randrange(3), rng.randrange(200)) for _ in range(60)] for _ in range(2))
    left, right = (spark.createDataFrame(x, "k int, at int") for x in (a, b))
    for width in (0, 1, 7):
        got = sorted(map(tuple, misreads.within(left, right, ["k"], "at", width).collect()))
        assert got == sorted({x for x in a for y in b if x[0] == y[0] and abs(x[1] - y[1]) <= width})


def plain_json(text):
    body = re.sub(r"(?s)<think>.*?</think>\s*", "", text or "").strip()
    if m := re.search(r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```", body):
        body = m[1].strip()
    for m in re.finditer(r"\{", body):
        try:
            found, _ = json.JSONDecoder().raw_decode(body[m.start() :])
        except ValueError:
            continue
        return found
    return None


def test_json_in(spark):
    rng = random.Random(11)
    parts = ['{"a": ', "{", "}", '"', "\\", "1", "[", "]", '"x{y"', ": ", ", ", "null", ' "b": ', "```json\n", "\n```", "<think>", "</think>", " word ", '{"c": {"d": "}"}}', '\\"']
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)] + [None, "", '{"k": "' + "v" * 50000 + '"}', '{"e": "\\\\"}', "{}"]
    texts = [t for t in texts if not t or t.count('"a"') < 2]  # a key that repeats is no object here
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    got = {r.id: r.o and json.loads(r.o) for r in rows.select("id", F.to_json(json_in(F.col("text"))).alias("o")).collect()}
    assert {i: got[i] for i in got if got[i] != plain_json(texts[i])} == {} and sum(o is not None for o in got.values()) > 200


def test_ascii_fold(spark):
    every = "".join(chr(c) for c in range(0x20, 0x10000) if not 0xAC00 <= c <= 0xD7A3 and not 0xD800 <= c <= 0xDFFF)
    texts = [every[i : i + 500] for i in range(0, len(every), 500)] + ["Ławiński Strømland Đorđević Müller ﬁn ß", "é", "", None]
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", "".join(LETTERS.get(c, c) for c in t)) if not unicodedata.combining(c))
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i").select(ascii_fold(F.col("text")).alias("t")).collect()]
    assert got[-1] is None and got[:-1] == [fold(t) for t in texts[:-1]]
    assert got[-4] == "Lawinski Stromland Dordevic Muller fin ss"


def test_sentences(spark):
    text = "One (p = 0.05). 58% rose, e.g. Two vs. Three did. See Fig. none! ok? Yes.ResultsWere fine."
    got = spark.createDataFrame([(1, text), (2, None), (3, "  ")], "id int, text string").select("id", outcomes.sentence_list(F.col("text")).alias("s")).collect()
    assert got[0].s == ["One (p = 0.05).", "58% rose, e.g. Two vs. Three did.", "See Fig. none! ok?", "Yes.", "ResultsWere fine."] and got[1].s == got[2].s == []


def test_run_files(spark, tmp_path):
    """Whole, broken, empty and absent files, with foreign ones beside them."""
    cases = {
        "synthesis-ageing-v2": {runs.VERDICT: '{"verdict": "AAA", "maturity_level": 5, "journal_ready": true}', runs.MANIFEST: '{"receipts": [{"directness": "direct"}, {}]}', runs.REGISTRY: '{"R1": {"source_doi": "10.1/X"}, "r2": {}}'},
        "plain": {runs.VERDICT: "{}", runs.MANIFEST: "[1]", runs.REGISTRY: "{"}, "empty": {runs.VERDICT: "", "other.json": "{}"}, "foreign": {"other.json": "{}"},
        "twice": {runs.VERDICT: "{}", runs.MANIFEST: "{}", runs.REGISTRY: '{"a": {}, "a": {}}'},
    }
    for run, files in cases.items():
        (tmp_path / run).mkdir()
        for name, text in files.items():
            (tmp_path / run / name).write_text(text)
    got = {r.run_id: r for r in runs.run_summaries(runs.read_files(spark, f"{tmp_path}/*/*.json")).collect()}
    assert got.keys() == {*cases}
    whole = got["synthesis-ageing-v2"]
    assert (whole.topic, whole.eligibility, whole.n_source_papers, whole.directness_mix, whole.citation_keys) == ("ageing", "full_aaa_primary", 2, {"direct": 1, "unknown": 1}, ["10.1/x", "r2"])
    assert got["plain"].exclusion_reason == f"unreadable artifacts: {runs.MANIFEST}, {runs.REGISTRY}"
    assert {got[r].exclusion_reason for r in ("empty", "foreign")} == {f"missing artifacts: {runs.VERDICT}, {runs.MANIFEST}, {runs.REGISTRY}"} and got["twice"].exclusion_reason == f"unreadable artifacts: {runs.REGISTRY}"
    assert all(got[r].eligibility == "excluded" for r in ("plain", "empty", "twice"))
