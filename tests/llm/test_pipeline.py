"""The pipeline against plain Python, stage by stage, on a small corpus."""

import random
import re
from collections import Counter

import pytest
from test_dedup import plain_contamination, plain_fingerprint
from test_models import WORDS, water_fill

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    pick = lambda lang, n: " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "er", "in", "os", "at", "um"]) for _ in range(n))
    items = [(i, pick("aa", rng.choice([10, 14, 30]))) for i in range(5)]
    rows = []
    for i in range(160):
        lang = rng.choice([*WORDS])
        rows.append([i, pick(lang, rng.randrange(60, 120)), lang, rng.choice(["s0", "s0", "s1", None])])
    for k in range(20):  # exact copies, near copies and leaks
        rows.append([200 + k, rows[k][1].replace(" ", "  "), rows[k][2], "s1"])
        rows.append([300 + k, rows[40 + k][1].upper().replace(" ", "\n", 3), rows[40 + k][2], "s0"])
        rows.append([400 + k, f"{pick('aa', 30)} {items[k % 5][1]} {pick('aa', 5)}", "aa", "s0"])
    rows += [[500, None, "aa", "s0"], [501, "", "bb", "s0"], [502, "12 34 !!", "aa", "s2"]]
    path = f"file://{tmp_path_factory.mktemp('docs')}"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_stage_by_stage(spark, folder):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        rows = docs.collect()
        got = {r.doc_id for r in rows}
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(rows) == len(got)
        if name == "language_id":
            assert got == {*before} - {500, 501, 502}
        elif name == "exact_dedup":
            best = {}
            for i, r in before.items():
                best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append((-len(r.text), i))
            assert got == {min(v)[1] for v in best.values()} and len(got) < len(before)
        elif name == "simhash_near_dedup":
            prints = {i: plain_fingerprint(r.text) for i, r in before.items()}
            label = {i: i for i in prints}
            moved = True
            while moved:
                moved = False
                for a in prints:
                    low = min(label[b] for b in prints if bin(prints[a] ^ prints[b]).count("1") <= 3)
                    moved |= low < label[a]
                    label[a] = min(label[a], low)
            assert got == {i for i in prints if label[i] == i} and len(got) < len(before)
        elif name == "benchmark_decontamination":
            plain = plain_contamination({i: r.text for i, r in before.items()}, items)
            assert got == {i for i in before if not plain[i][3]} and len(got) < len(before)
        else:
            size = {i: len(r.text.split()) for i, r in before.items()}
            total, taken, longest = Counter(), Counter(), Counter()
            for i, r in before.items():
                total[r.source] += size[i]
                longest[r.source] = max(longest[r.source], size[i])
            copies = Counter(r.doc_id for r in rows)
            for i, n in copies.items():
                assert n <= 2 and sorted(r.copy for r in rows if r.doc_id == i) == [*range(1, n + 1)]
                taken[before[i].source] += n * size[i]
            assert all(abs(taken[s] - t) <= longest[s] + 1 for s, t in water_fill(dict(total)).items())


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, spark.read.parquet(f"{folder}/source_mixing").collect()))


def test_repeated_and_null_ids_are_decided_row_by_row(spark, tmp_path):
    rng = random.Random(3)
    pick = lambda lang, n: " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "er", "in", "os", "at", "um"]) for _ in range(n))
    path = f"file://{tmp_path}"
    leak, twin, lone = pick("aa", 12), pick("bb", 90), [pick("aa", 90) for _ in range(6)]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    stages, count = dict(corpus_pipeline.STAGES), iter(range(9))

    def after(name, rows):
        at = f"{path}/docs{next(count)}"
        spark.createDataFrame([(i, t, "aa", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(at)
        return Counter((r.doc_id, r.text) for r in stages[name](spark, spark.read.parquet(at), path).collect())

    s = "s0"
    got = after("exact_dedup", [(1, "a", s), (1, "a", s), (1, "b", s), (2, "a ", s), (2, "c", s), (None, "d", s), (None, "d", s), (None, "c", s), (3, "e", s)])
    assert got == Counter([(2, "a "), (1, "b"), (2, "c"), (None, "d"), (3, "e")])
    near = [(5, twin, s), (5, twin.upper(), s), (5, lone[0], s), (None, twin.replace(" ", "\n", 2), s), (None, lone[1], s), (None, lone[2], s), (None, lone[2].upper(), s)]
    got = after("simhash_near_dedup", near)
    assert Counter((i, t.lower()) for i, t in got.elements()) == Counter([(5, twin), (5, lone[0]), (None, lone[1]), (None, lone[2])])
    dirty = f"{lone[3]} {leak} {lone[4]}"
    got = after("benchmark_decontamination", [(7, dirty, s), (7, lone[0], s), (None, dirty, s), (None, lone[1], s)])
    assert got == Counter([(7, lone[0]), (None, lone[1])])
    texts = [pick("aa", 20) for _ in range(60)]
    got = after("source_mixing", [(None if k % 2 else 7, t, "s0" if k < 30 else "s1") for k, t in enumerate(texts)])
    words = Counter({"s0": 600, "s1": 600})
    for source, want in water_fill(dict(words)).items():
        taken = sum(n * 20 for (_, t), n in got.items() if (texts.index(t) < 30) == (source == "s0"))
        assert abs(taken - want) <= 21


def test_near_stage_links_by_fingerprints_and_by_similarity(spark, tmp_path):
    """Two texts within op6's radius that are less alike than four fifths, and two that are alike beyond the radius."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    sets = lambda t: {t[i : i + 5] for i in range(len(t) - 4)}

    def pair(edits, wanted):
        while True:
            base = tuple(word() for _ in range(300))
            for _ in range(40):
                own = list(base)
                for k in rng.sample(range(300), edits):
                    own[k] = word()
                far = bin(plain_fingerprint(" ".join(base)) ^ plain_fingerprint(" ".join(own))).count("1")
                a, b = sets(base), sets(tuple(own))
                if wanted(far <= 3, len(a & b) * 5 >= len(a | b) * 4):
                    return " ".join(base), " ".join(own)

    texts = [*pair(9, lambda near, alike: near and not alike), *pair(5, lambda near, alike: alike and not near), " ".join(word() for _ in range(300))]
    spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/docs")
    got = corpus_pipeline.near(spark, spark.read.parquet(f"file://{tmp_path}/docs"), "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 2, 4]


def test_near_copies_at_four_fifths(spark, monkeypatch):
    from weft.llm import jaccard
    from weft.llm.jaccard import near_copies

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([60, 120, 300]))]
        for edits in [0, *rng.choices(range(1, 6), k=5)]:
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += ["one two", "One  two", "", None, "one two three"]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    label = [*range(len(texts))]
    alike = [(i, j) for i in label for j in range(i) if (sets[i] == sets[j] or len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4)]
    while any(label[i] != label[j] for i, j in alike):
        for i, j in alike:
            label[i] = label[j] = min(label[i], label[j])
    got = {r.id: r.component for r in near_copies(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {i: c for i, c in enumerate(label) if label.count(c) > 1}
    # The same where nearly every shingle is crowded and cells are small.
    monkeypatch.setattr(jaccard, "LIGHT", 1)
    monkeypatch.setattr(jaccard, "CELL", 3)
    again = {r.id: r.component for r in near_copies(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert again == got
    from weft.llm.simhash import fingerprint

    far = [bin(fingerprint(texts[i].encode()) ^ fingerprint(texts[j].encode())).count("1") > 3 for i, j in alike if texts[i] and texts[j]]
    assert sum(far) > 5  # links that the contract of op6 would not make
