"""Exact, near and line dedup and decontamination against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from weft.llm.decontam import contamination, decontaminate
from weft.llm.exact_dedup import exact_dedup
from weft.llm.graph import connected_components
from weft.llm.linededup import dedup_lines
from weft.llm.simhash import fingerprint, local_roots, planes_of, simhash_components, within

SCHEMA = "doc_id long, text string, size int, id string, n long"


def table(spark, texts):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, 1, "x", 2) for i, t in (texts.items() if isinstance(texts, dict) else texts)]
    return spark.createDataFrame(rows, SCHEMA)


EDGE = {1: None, 2: "", 3: " \t\n", 4: "a b", 5: "ab", 6: "a  b\n", 7: "é" * 5, 8: "é" * 5, 9: "w " * 30000, 10: "w" * 30000}


def test_exact_dedup_edges(spark):
    got = {r.doc_id: r for r in exact_dedup(table(spark, EDGE), digest_all=True).collect()}
    assert {i: r.keep_id for i, r in got.items()} == {1: 3, 2: 3, 3: 3, 4: 6, 5: 6, 6: 6, 7: 7, 8: 7, 9: 9, 10: 9}
    for i, r in got.items():
        norm = re.sub(r"[\x20\x09-\x0D]", "", EDGE[i] or "")
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest() and r.kept == (r.keep_id == i)


def test_exact_dedup_repeats_and_empty(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, "b")]
    got = exact_dedup(table(spark, rows)).collect()
    assert sorted(r.group_size for r in got) == [1, 3, 3, 3] and sum(r.kept for r in got) == 2
    assert next(r.text_sha256 for r in got if r.keep_id == 2) is None  # finished before the full hash
    assert exact_dedup(table(spark, {})).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = max(1, len(words) - 2)
    grams = [" ".join(words[i : i + 3]) for i in range(n)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams))


def test_simhash(spark):
    rng = random.Random(3)
    docs = {i: " ".join(rng.choice("one Two three four Five é".split()) for _ in range(rng.choice([0, 1, 2, 3, 60]))) for i in range(80)}
    docs |= {100 + i: docs[i] + "\n" for i in range(20)} | {200: None, 201: "  "}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    assert all(fingerprint((t or "").encode(), chunk=7) == prints[i] for i, t in docs.items())
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(table(spark, docs)).collect()}
    assert got == {i: (f"{prints[i]:016x}", root(i)) for i in docs}
    assert simhash_components(table(spark, {})).count() == 0


def test_bit_sliced_comparison():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    x = np.unique(np.concatenate([base, base[:200] ^ np.uint64(7), base[:100] ^ np.uint64(15 << 50), base[:50] ^ np.uint64((1 << 60) + 3)]))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    q, c = within(planes_of(x), len(x), x)
    assert {*zip(q.tolist(), c.tolist(), strict=True)} == {*zip(*(a.tolist() for a in np.nonzero(near)), strict=True)}
    for radius in (0, 1, 2, 5):
        q, c = within(planes_of(x), len(x), x[:40], radius)
        assert len(q) == (np.bitwise_count(x[:40, None] ^ x[None, :]) <= radius).sum()
    ids = rng.permutation(len(x)).astype(np.int64)
    label = ids.copy()
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert (local_roots(x, ids) == label).all()


def test_cells_of_large_keys(spark):
    from pyspark.sql import functions as F

    from weft.llm.simhash import near_links

    reps = spark.range(300).select((F.col("id") % 64).alias("k"), F.col("id").alias("rep")).selectExpr("shiftleft(1L, cast(k as int)) + rep * 0 as fp", "rep").dropDuplicates(["fp"])
    whole = connected_components(near_links(reps)).where("node <> component").count()
    assert whole == connected_components(near_links(reps, cell_rows=5)).where("node <> component").count() == 63


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(50, 60), (60, 70), (50, 50), (90, 91), (91, 90)]
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(50, 50), (60, 50), (70, 50), (90, 90), (91, 90)}


def plain_contamination(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items.items():
        w = split(t)
        n = min(10, len(w))
        for at in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[at : at + n])].add(str(i))
    out = {}
    for i, t in docs.items():
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[at : at + n]))) is not None:
                    hit |= {*range(at, at + n)}
                    found |= own
        out[i] = (len(w), len(hit), sorted(found), bool(hit))
    return out


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("alpha Beta gamma DELTA épée zwölf ÉTÉ seven 7 nine".split())
    items = {i: " ".join(word() for _ in range(n)) for i, n in enumerate([0, 2, 4, 9, 10, 11, 25, 40])} | {20: None}
    docs = {}
    for i in range(60):
        parts = [word() for _ in range(rng.randrange(30))]
        if i % 2:
            w = items[rng.choice([4, 5, 6, 7])].split()
            a = rng.randrange(len(w))
            parts += [x.upper() + rng.choice(["", "!", " --"]) for x in w[a : a + rng.randrange(6, 20)]]
        docs[i] = " ".join(parts + [word() for _ in range(rng.randrange(5))])
    docs |= {90: None, 91: "", 92: "épée ... Été", 93: "alpha beta " * 4000}
    frame = spark.createDataFrame([*items.items()], "item_id long, text string")
    for sub in (items, {k: items[k] for k in (4, 5, 6, 7)}, {0: ""}):
        own = frame.where(frame.item_id.isin([*sub])) if sub != {0: ""} else frame.where("item_id = 0")
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate(table(spark, docs), own).collect()}
        assert got == plain_contamination(docs, sub)
    hits, spans = contamination(table(spark, docs), frame, broadcast_rows=0)  # joined by shuffles
    want = plain_contamination(docs, items)
    assert {r.id: (r.n_hit, list(r["items"])) for r in hits.collect()} == {i: w[1:3] for i, w in want.items() if w[3]}
    assert all(r.n <= 10 for r in spans.collect())
    hits, _ = contamination(table(spark, docs), frame, broadcast_bytes=0)  # windows joined by a shuffle
    assert {r.id: (r.n_hit, list(r["items"])) for r in hits.collect()} == {i: w[1:3] for i, w in want.items() if w[3]}


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0}])
def test_decontamination_ids(spark, limits):
    """contamination() pools the rows of one id, or of none; verdicts tell rows of one id apart by their text."""
    item = " ".join(f"w{k}" for k in range(12))
    frame = spark.createDataFrame([(1, item), (None, item), (1, item)], "item_id long, text string")
    rows = [(1, "x " + item), (1, "clean"), (None, item), (None, "clean too"), (2, "clean")]
    hits, _ = contamination(table(spark, rows), frame, **limits)
    assert {r.id: (r.n_hit, list(r["items"])) for r in hits.collect()} == {1: (12, ["", "1"]), None: (12, ["", "1"])}
    got = Counter((r.doc_id, r.n_words, r.contaminated) for r in decontaminate(table(spark, rows), frame).collect())
    assert got == {(1, 13, True): 1, (1, 1, False): 1, (None, 12, True): 1, (None, 2, False): 1, (2, 1, False): 1}
    assert decontaminate(table(spark, {}), frame).count() == 0


def plain_line_dedup(docs):
    strip = " \t\n\x0b\x0c\r"
    runs = []
    for i, t in docs.items():
        lines = [(k, x.strip(strip)) for k, x in enumerate((t or "").split("\n")) if x.strip(strip)]
        for at in range(len(lines) - 2):
            runs.append(((i, lines[at][0]), tuple(x for _, x in lines[at : at + 3]), [k for k, _ in lines[at : at + 3]]))
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
        runs += [((i, k), (x,), [k]) for k, x in lines if words(x) >= 40]
        runs += [((i, k), (x, y), [k, m]) for (k, x), (m, y) in zip(lines, lines[1:], strict=False) if words(x) + words(y) >= 40]
    first = {}
    for place, key, _ in runs:
        first[key] = min(first.get(key, place), place)
    gone = defaultdict(set)
    for place, key, rows in runs:
        if first[key] != place:
            gone[place[0]] |= {*rows}
    return {i: (t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i])) for i, t in docs.items()}


def test_line_dedup(spark):
    rng = random.Random(8)
    long = " ".join(f"w{k}" for k in range(55))
    half = ["one two three " * 8, "four five six " * 7, "seven eight nine " * 6]
    lines = [f"line {k}" for k in range(12)] + ["", "  ", long, *half]
    docs = {i: "\n".join(rng.choice(lines) for _ in range(rng.randrange(12))) for i in range(60)}
    docs |= {100: None, 101: "", 102: long, 103: f" {long}\t", 104: "a\nb\nc\na\nb\nc\na\nb\nc", 105: "x\n" * 500}
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(table(spark, docs)).collect()}
    assert got == plain_line_dedup(docs)
    assert got[104] == ("a\nb\nc", 6)
    counts = {r.doc_id: r.n_lines for r in dedup_lines(table(spark, docs)).collect()}
    assert counts[100] == 0 and counts[105] == 500
    assert dedup_lines(table(spark, {})).count() == 0
    again = dedup_lines(table(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc")])).collect()
    assert Counter((r.doc_id, r.n_removed) for r in again) == {(1, 0): 2, (None, 3): 1, (2, 3): 1}


def test_line_dedup_ids(spark):
    """Rows of one id, or of none, keep what only they have."""
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc"), (2, "p\nq\nr\nt"), (None, "p\nq\nr"), (None, "u\nv\nw"), (None, "u\nv\nw\nx")]
    got = Counter((r.doc_id, r.text) for r in dedup_lines(table(spark, rows)).collect())
    assert got - Counter({(1, "a\nb\nc"): 1, (2, ""): 1, (2, "p\nq\nr\nt"): 1, (None, ""): 1}) in (Counter({(None, "u\nv\nw"): 1, (None, "x"): 1}), Counter({(None, ""): 1, (None, "u\nv\nw\nx"): 1}))
    named = spark.createDataFrame([(str(i), t) for i, t in rows[:3]], "doc_id string, text string")
    assert Counter(r.text for r in dedup_lines(named).collect()) == {"a\nb\nc": 1, "": 1, "p\nq\nr\nt": 1}


@pytest.mark.parametrize("run, gram", [(2, 1), (2, 2), (4, 2)])
def test_line_dedup_guarantee(spark, run, gram):
    """Whatever the window, every repeated run of the length is found."""
    rng = random.Random(run * 10 + gram)
    docs = {i: "\n".join(rng.choice("abcdef") for _ in range(15)) for i in range(30)}
    found = {r.doc_id: r.n_removed for r in dedup_lines(table(spark, docs), run=run, gram=gram).collect()}
    seen, want = set(), {}
    for i in sorted(docs):
        x, gone = docs[i].split("\n"), set()
        for at in range(len(x) - run + 1):
            key = tuple(x[at : at + run])
            if key in seen:
                gone |= {*range(at, at + run)}
            seen.add(key)
        want[i] = len(gone)
    assert found == want
