"""Classifiers, LM, mixing, URL filter and token counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weft.llm.langid import codewords, fit, identify, predict
from weft.llm.lmtrie import BITS, BITS3, SPLIT, SPLIT_BITS, EliasFano, LanguageModel, Trie, _blobs, _stretches, _unblob, score_corpus, word_hashes
from weft.llm.mixing import mix
from weft.llm.bytes_ import passage_rows
from weft.llm.quality import AttentionModel, classify, score
from weft.llm.quality import fit as fit_quality
from weft.llm.tokens import count_tokens, document_token_counts
from weft.llm.urlfilter import UrlFilter, _levels, _pack, build_cascade, judge_urls, listed_in

WORDS = {"aa": "the of and tion ing house water", "bb": "der die und keit ung haus wasser", "cc": "le la que eau ment maison été"}


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(5, 200))), lang) for i in range(n) for lang in [rng.choice([*WORDS])]]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "clash", 0.5) for i, t, lang in rows], "doc_id long, text string, lang string, source string, id string, score double")


def test_language_id(spark):
    rows = corpus(300) + [(900, None, "aa"), (901, "123 !!!", "bb"), (902, "", None), (903, "der und", None), (904, "the of and " * 60000, "aa"), (0, "le la", "cc")]
    got = identify(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out and r.doc_id < 900 and r.doc_id]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    said = {r.doc_id: r for r in got}
    assert [said[i].lang_pred for i in (900, 901, 902, 904)] == ["und", "und", "und", "aa"] and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in identify(docs(spark, [(1, "abc", None)])).collect()} == {"und"}
    assert identify(docs(spark, [])).count() == 0


def plain_language(model, text, dims):
    """Best language, its share and the gap to the second, letter by letter."""
    x = [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.encode()]
    count = Counter(c for c in x if c != 32)
    for a, b, c in zip(x, x[1:], x[2:], strict=False):
        if (a != 32 or b != 32) and (b != 32 or c != 32):
            count[256 + ((a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) % (1 << 32) >> 7) % dims] += 1
    total = max(1, sum(count.values()))
    bits = [model.bias[j] + sum(math.sqrt(n / total) * model.weights[k, j] for k, n in count.items()) for j in range(model.code.shape[1])]
    loss = [sum(t * math.log1p(math.exp(-m * c)) for m, c, t in zip(bits, word, trust, strict=True)) * len(bits) for word, trust in zip(model.code, model.trust, strict=True)]
    near = sorted(loss)
    return model.languages[loss.index(near[0])], 1 / sum(math.exp(near[0] - v) for v in loss), near[1] - near[0]


@pytest.mark.parametrize("langs", [("aa", "bb"), ("aa", "bb", "cc")])
def test_language_decoding(spark, langs):
    """Against plain decoding; half of one language and half of another is ambiguous."""
    rows = [r for r in corpus(400, 12) if r[2] in langs]
    model = fit(docs(spark, rows), dims=512)
    half = [(1000 + k, " ".join((WORDS[langs[0]].split() + WORDS[langs[1]].split()) * 9), None) for k in range(1)]
    own = rows[:60] + half
    got = {r.doc_id: r for r in predict(docs(spark, own), model, dims=512).collect()}
    for i, text, _ in own:
        lang, p, gap = plain_language(model, text, 512)
        assert abs(got[i].score - p) < 1e-3 and (got[i].lang_pred == lang or gap < 1e-3)
        assert got[i].ambiguous == (gap < model.least) or abs(gap - model.least) < 1e-3
    assert got[1000].ambiguous and sum(got[i].ambiguous for i, _, _ in rows[:60]) <= 2


@pytest.mark.parametrize("n", [1, 2, 4, 7, 12])
def test_codewords_differ(n):
    code = codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n


def test_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i, text, lang in corpus(400, 5):
        bad = i % 4 == 0
        words = text.split()
        half = len(words) // 2
        rows.append((i, " ".join(words[:half] + [w.upper() + "!!" for w in words[half:]]) if bad else text, lang))
        if rng.random() < 0.7:
            labels.append((i, int(not bad), 0))
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "the of " * 100000, "aa"), (0, "the of", "aa")]
    marks = spark.createDataFrame([*labels, (3, None, 1), labels[0]], "doc_id long, quality int, toxic int")
    got = classify(docs(spark, rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and 0 < r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)
    assert next(r.n_passages for r in got if r.doc_id == 902) == 3125
    assert {r.score for r in classify(docs(spark, rows), marks.where("false")).collect()} == {0.5}


def test_attention_gradient():
    rng = np.random.default_rng(1)
    m = AttentionModel(6, 4, 3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, sizes, y = rng.standard_normal((9, 6)), np.array([2, 3, 1, 3]), np.array([1.0, 0, 1, 0])

    def loss():
        h, s = m.encode(x)
        p = m.pool(h, s, sizes)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, g in m._gradient(x, sizes, y).items():
        at = np.unravel_index(1 if m.p[k].size > 1 else 0, m.p[k].shape)
        m.p[k][at] += 1e-5
        up = loss()
        m.p[k][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-6
        m.p[k][at] += 1e-5


def plain_attention(model, x):
    """Score of one document's passages, number by number."""
    p = {k: v.astype(float).tolist() for k, v in model.p.items()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    dot = lambda v, m, j: sum(a * row[j] for a, row in zip(v, m, strict=True))
    encoded, logits = [], []
    for row in x.tolist():
        z = [(a - m) / s for a, m, s in zip(row, model.mean.tolist(), model.scale.tolist(), strict=True)]
        h = [math.tanh(dot(z, p["E"], j) + p["e"][j]) for j in range(len(p["e"]))]
        encoded.append(h)
        logits.append(sum(math.tanh(dot(h, p["V"], j)) * sig(dot(h, p["U"], j)) * p["w"][j] for j in range(len(p["w"]))))
    share = [math.exp(s) for s in logits]
    pooled = [sum(a * h[j] for a, h in zip(share, encoded, strict=True)) / sum(share) for j in range(len(p["e"]))]
    return sig(sum(a * b for a, b in zip(pooled, p["c"], strict=True)) + p["b"][0])


def test_quality_scores(spark):
    """Against a plain forward pass; long texts, empty ones and an empty table too."""
    rows = corpus(60, 4) + [(900, None, "aa"), (901, "", "aa"), (902, "the of! " * 3000, "aa")]
    frame = docs(spark, rows)
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = fit_quality(frame, marks)
    got = {r.doc_id: r for r in score(frame, model).collect()}
    for i, text, _ in [*rows[:12], *rows[-3:]]:
        data = np.frombuffer((text or "").encode(), np.uint8)
        x, n = passage_rows(data, np.array([0, len(data)]))
        assert got[i].n_passages == n[0] and abs(got[i].score - plain_attention(model, x)) < 1e-4
    assert score(frame.where("false"), model).count() == 0 and fit_quality(frame.where("false"), marks) is None
    assert classify(frame.where("false"), marks).count() == 0
    named = frame.withColumn("doc_id", frame.doc_id.cast("string"))
    assert classify(named, marks.withColumn("doc_id", marks.doc_id.cast("string"))).count() == len(rows)


def test_quality_sample_bounds(spark):
    """Whole documents, as many as the passages allow; repeated rows count once."""
    rows = [(i, "word " * 640, "aa") for i in range(30)]
    frame = docs(spark, rows).union(docs(spark, rows[:5] * 3))
    marks = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    seen = []

    class Probe(AttentionModel):
        def fit(self, x, sizes, y, **kw):
            seen.append(sizes.tolist())
            return self

    import weft.llm.quality as q

    real, q.AttentionModel = q.AttentionModel, Probe
    try:
        for limits in ({}, {"passages": 95}, {"sample": 4}, {"passages": 3}):
            q.fit(frame, marks, **limits)
    finally:
        q.AttentionModel = real
    assert seen == [[10] * 30, [10] * 9, [10] * 4, [10]]


def test_elias_fano():
    rng = np.random.default_rng(4)
    for n, universe in ((0, 10), (1, 1), (50, 60), (3000, 1 << 40), (3000, 1 << 61), (2000, 500)):
        x = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
        e = EliasFano.build(x, universe)
        assert (e.at(np.arange(n)) == x).all()
        own = np.unique(x)
        assert (x[e.place_of(own)] == own).all() if n else True
        other = np.setdiff1d(rng.integers(0, universe, 200, dtype=np.uint64), x)
        assert (e.place_of(other) == -1).all()


def test_trie_round_trip():
    """Blobs of stretches add up to the counts of all n-grams; the trie gives them back."""
    from weft.llm.lmtrie import END

    rng = np.random.default_rng(6)
    words = np.append(rng.integers(0, 1 << 64, 40, dtype=np.uint64), END)
    tok = np.append(words[np.minimum(rng.geometric(0.12, 5000), len(words)) - 1], END)
    seq = [END, END, *tok.tolist()]
    pairs = Counter(zip(seq[1:], seq[2:], strict=False))
    thirds = Counter(t for t in zip(seq, seq[1:], seq[2:], strict=False) if t[1] != END)
    shards: dict = {}
    for stretch in _stretches(tok, 700):
        for k, blob in _blobs(stretch, 2):
            shards.setdefault(k, []).append(_unblob(blob))
    tries = {k: Trie.load(Trie.build(*map(np.concatenate, zip(*v, strict=True)), 2, k % SPLIT == 0, 0.75).pack()) for k, v in shards.items()}
    total, low = Counter(seq[2:]), lambda w, bits: np.array([w & (1 << bits) - 1], np.uint64)
    assert sum(t.successors.n for t in tries.values()) == len(pairs) and sum(t.thirds.n for t in tries.values()) == len(thirds)
    for w in total:
        t = tries[(w >> 62) * SPLIT]
        assert t.counts(t.place_of(np.array([w], np.uint64)))[0] == total[w]
    for (u, v), n in pairs.items():
        t = tries[(u >> 62) * SPLIT + (v >> 64 - SPLIT_BITS)]
        at = t.second(t.place_of(np.array([u], np.uint64)), low(v, BITS))
        assert at[0] >= 0 and 0.999 * (n - 0.75) <= t.taken(at)[0] <= n - 0.75 + 1e-9
        begin, end = t.pointers3.at(at), t.pointers3.at(at + 1)
        own = {w: c for (a, b, w), c in thirds.items() if (a, b) == (u, v)}
        got = {w: t.third(begin, end, low(w, BITS3))[0] if end > begin else 0 for w in own}
        assert len(own) == int(end[0] - begin[0]) and all(0 < got[w] <= (c - 0.75) / sum(own.values()) + 1e-9 for w, c in own.items())
        assert -1e-9 <= 1 - sum(got.values()) - t.left(at)[0] < 2e-5
        if end > begin:
            assert not t.third(begin, end, low(123456789, BITS3))[0]


def test_word_hashes_tell_words_apart():
    text = "a A b ab ba " + "x" * 200 + " " + "x" * 201 + " été \n a"
    x = np.frombuffer(text.encode(), np.uint8)
    h, n = word_hashes(x, np.array([0, 5, len(x)]))
    assert n.tolist() == [3, 6] and len({*h.tolist()}) == 7 and h[0] == h[1] == h[-1]


def plain_lm(rows):
    """(doc_id, n_tokens, n_known, base_score, score) of each row, and the number of training tokens."""
    lower = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())) + [b" "]
    train = [lower(t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([b" ", *t[:-1]], t, strict=True))
    thirds = Counter(p for t in train for p in zip([b" ", *t[:-2]], t[:-1], t[1:], strict=False))
    n, v = sum(count.values()), len(count)
    kinds, kinds3, context = Counter(a for a, _ in pairs), Counter((a, b) for a, b, _ in thirds), Counter()
    for (a, b, _), c in thirds.items():
        context[a, b] += c
    want = []

    def p2(a, b):
        return max(pairs[a, b] - 0.75, 0) / max(count[a], 1) + (0.75 * kinds[a] / count[a] if count[a] else 1) * (count[b] + 1) / (n + v + 1)

    def p3(a, b, c):
        if b == b" " or not context[a, b]:
            return p2(b, c)
        return max(thirds[a, b, c] - 0.75, 0) / context[a, b] + 0.75 * kinds3[a, b] / context[a, b] * p2(b, c)

    for i, t, _ in rows:
        w = lower(t)
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        p = [p3(*x) for x in zip([b" ", b" ", *w[:-2]], [b" ", *w[:-1]], w, strict=False)]
        want.append((i, len(w), sum(count[x] > 0 for x in w), base, sum(map(math.log10, p))))
    return want, n


def held_to_plain_lm(got, rows):
    want, n = plain_lm(rows)
    assert len(got) == len(want) and all(r.train_tokens == n for r in got)
    for r, x in zip(sorted(got, key=lambda r: (r.doc_id, r.n_tokens)), sorted(want), strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known) == x[:3]
        assert r.base_score == pytest.approx(x[3], rel=1e-9) and abs(r.score - x[4]) <= 0.01 * r.n_tokens


@pytest.mark.parametrize("texts", [["a b c d e", "a b c", "d e"], ["a b"], ["", None], [None], ["a"], ["", "a", None, "a b", "b a c"]])
def test_lm_scores_of_tiny_corpora(spark, texts):
    """Counts of a stretch may hold no bigram or trigram; a null or empty training text is one token."""
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, t, "aa") for i, t in zip(train, texts, strict=False)] + [(2, "a b c never", "aa")]
    for parts in (1, len(rows)):
        held_to_plain_lm(score_corpus(docs(spark, rows).repartition(parts)).collect(), rows)


def test_lm_scores_over_uneven_partitions_and_many_shards(spark):
    """A short last partition beside long ones, and far more shards than the text needs."""
    rows = corpus(60, 9)
    small = [(1000 + i, "two words", "aa") for i in range(3)]
    frame = docs(spark, rows).repartition(2).union(docs(spark, small).coalesce(1))
    held_to_plain_lm(score_corpus(frame).collect(), rows + small)
    many = LanguageModel(frame, shard_bytes=64)
    few = {r.doc_id: r.score for r in LanguageModel(frame).score(frame).collect()}
    # Codes are quantised shard by shard.
    assert many.shard_bits > 6 and all(abs(r.score - few[r.doc_id]) <= 0.01 * r.n_tokens for r in many.score(frame).collect())


def test_lm_scores(spark):
    rows = corpus(200, 9) + [(900, None, "aa"), (901, "", "aa"), (902, "never seen\x0bwords", "aa"), (903, "the of " * 300000, "aa"), (5, "the of", "aa")]
    held_to_plain_lm(score_corpus(docs(spark, rows)).collect(), rows)
    assert score_corpus(docs(spark, [])).count() == 0
    untrained = score_corpus(docs(spark, [(i, "a b", "aa") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2])).collect()
    assert untrained and all(r.train_tokens == r.n_known == 0 and r.score == r.base_score for r in untrained)


def test_lm_files_are_checked(spark):
    """A model whose files were moved or cut gives an error, no scores."""
    import os

    frame = docs(spark, corpus(50, 9))
    for harm in (lambda f: os.rename(f, f + ".old"), lambda f: os.truncate(f, os.path.getsize(f) - 8)):
        model = LanguageModel(frame)
        assert model.score(frame).count() == 50 and model.folder
        for name in os.listdir(model.folder):
            if name.endswith(".trie"):
                harm(f"{model.folder}/{name}")
        with pytest.raises(Exception, match=r"No such file|instead of"):
            model.score(frame).collect()


def test_lm_in_a_store(spark, monkeypatch):
    """Without a common folder of files, executors fetch the levels from a table."""
    import weft.llm.lmtrie as m

    frame = docs(spark, corpus(40, 9))
    want = sorted(map(tuple, LanguageModel(frame).score(frame).collect()))
    real = m.qualified
    monkeypatch.setattr(m, "qualified", lambda s, f: "store:" + real(s, f))
    monkeypatch.setattr(type(frame.write), "parquet", lambda self, path, _p=type(frame.write).parquet: _p(self, path.removeprefix("store:")))
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, path, _p=type(spark.read).parquet: _p(self, path.removeprefix("store:")))
    model = LanguageModel(frame)
    assert model.folder is None and sorted(map(tuple, model.score(frame).collect())) == want


def mix_rows(n, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(n)]


def water_fill(sizes):
    weights = {s: w for s, w in zip(sorted((s for s in sizes if s is not None)), [5, 2, 1] * len(sizes), strict=False)}
    if None in sizes:
        weights[None] = [5, 2, 1][len(weights) % 3]
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in full}
        rate = (total - sum(full.values())) / sum(rest.values()) if rest else 0
        over = {s: 2.0 * sizes[s] for s, w in rest.items() if w * rate > 2 * sizes[s]}
        if not over:
            return full | {s: w * rate for s, w in rest.items()}
        full |= over


def test_mixing(spark):
    rows = mix_rows(1500) + [(9000, None, "a"), (9001, " ", "zz"), (9002, "w " * 5000, "b"), (3, "w w", "b")]
    frame = spark.createDataFrame([(i, t, s, 7) for i, t, s in rows], "doc_id long, text string, source string, size int")
    got = mix(frame).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    sizes["zz"] += 0
    want = water_fill(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        if r.source_size:
            assert r.copies in (math.floor(r.target / r.source_size), math.ceil(r.target / r.source_size))
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1 for s in sizes)
    again = mix(frame.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mix(frame.where("false")).count() == 0


def test_mixing_rows_alike(spark):
    """Many rows without an id and of one size are dealt over leaves."""
    frame = spark.createDataFrame([(None, "w w w", "a")] * 3000 + [(1, "w " * 3000, "b")], "doc_id long, text string, source string")
    got = mix(frame).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == 3001 and abs(taken["a"] - target["a"]) <= 4 and max(r.copies for r in got) <= 2
    assert Counter(map(tuple, got)) == Counter(map(tuple, mix(frame).collect()))


def test_mixing_is_fair(spark):
    """Over many seeds' worth of sources, a document is taken as often as its expectation says."""
    rows = [(k * 100 + i, "w " * (1 + i), f"s{k:03d}") for k in range(120) for i in range(6)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    ratio = {w: [r.copies - r.target / r.source_size for r in got if r.doc_id % 100 == w] for w in range(6)}
    assert all(abs(sum(x) / len(x)) < 0.12 for x in ratio.values())


def test_cascade_is_exact():
    rng = np.random.default_rng(8)
    h1, h2 = (rng.integers(0, 1 << 64, 20000, dtype=np.uint64) for _ in range(2))
    for share in (0.0, 0.01, 0.5, 0.99, 1.0):
        listed = rng.random(20000) < share
        levels = build_cascade(h1, h2, listed)
        assert (listed_in(levels, h1, h2) == listed).all() and (listed_in(_levels(_pack(levels)), h1, h2) == listed).all()


@pytest.mark.parametrize("limits", [{}, {"shard_keys": 7}, {"max_bytes": 0, "shard_keys": 11, "group_rows": 5}])
def test_url_filter(spark, limits):
    urls = [f"https://H{i % 40}.Site.example.{['com', 'net', 'org'][i % 3]}/{['en', 'de', 'fr'][i % 3]}/p{i}?q#f" for i in range(300)]
    urls += [None, "", "no host", "http://x.net", "http://example.net/en/a", "http://a.example.net/en/", "http://badexample.com/de/x", "ftp://org/fr/", "x://y.org#/fr/", "http://a/b://c"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    block = spark.createDataFrame([(f"h{i}.site.example.com",) for i in range(0, 40, 3)] + [(None,), ("elsewhere",)], "key string")
    names = {r.key for r in block.collect()}
    got = {r.page_id: r for r in judge_urls(pages, block, **limits).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        sub = lambda s: host == s or host.endswith("." + s)  # noqa: B023, E731
        rule, says = None, "block" if host in names else "allow"
        for s, p, v in (("net", "/", "block"), ("org", "/fr/", "allow"), ("example.com", "/de/", "block"), ("example.net", "/en/", "allow")):
            if sub(s) and path.startswith(p):
                rule, says = s + p, v
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, says), u
    assert judge_urls(pages.where("false"), block, **limits).count() == 0
    twice = judge_urls(pages.union(pages).union(pages.limit(1).selectExpr("cast(null as long)", "url", "host")), block, **limits)
    assert twice.count() == 2 * len(urls) + 1 and len({(r.page_id, r.verdict) for r in twice.collect()}) == len(urls) + 1


def test_equal_hashes_are_an_error():
    h = np.array([5, 5], np.uint64)
    with pytest.raises(ValueError, match="same two hashes"):
        build_cascade(h, h, np.array([True, False]))


def test_url_filter_size(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as key")
    f = UrlFilter(keys, keys.where("key like '%7'"))
    assert f.mark(keys, "key", "in").where("in <> (key like '%7')").count() == 0 and f.bytes < 5000


def test_token_scan(spark):
    rng = random.Random(4)
    rows, want = [], Counter()
    for stream in range(3):
        x = [rng.choice([9, 1, 2, 3]) if rng.random() < 0.9 else 9 for _ in range(rng.randrange(200, 400))] + [1] * 70 + ([9] if stream else [])
        lengths = [len(p) for p in re.split("9", "".join(map(str, x)))]
        lengths = lengths[:-1] + [n for n in lengths[-1:] if n]
        want.update((stream, k, n) for k, n in enumerate(lengths))
        rows += [(stream, k, np.array(x[at : at + 16], np.uint16).tobytes()) for k, at in enumerate(range(0, len(x), 16))]
    got = count_tokens(spark.createDataFrame(rows, "stream int, block long, tokens binary"), separator=9, block=16, group=4).collect()
    assert Counter((r.stream, r.ordinal, r.n_tokens) for r in got) == want


def test_document_token_counts(spark):
    from weft.llm.tokens import VOCABULARY, _encoder

    rows = corpus(60) + [(900, None, "aa"), (901, "", "aa"), (902, "<|endoftext|> é", "aa"), (903, "the water, " * 9000, "aa"), (3, "again", "aa")]
    encode = _encoder(VOCABULARY).encode_ordinary
    got = document_token_counts(docs(spark, rows), block=512).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(encode(t or ""))) for i, t, _ in rows)
    assert document_token_counts(docs(spark, [])).count() == 0
