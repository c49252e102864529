import itertools
import math
import re
import random

from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.operators import aggregates, claims, classify, gates, identity, ledger, meta, select, similarity, tension


def test_greedy_keys_are_not_components(spark):
    rows = spark.createDataFrame([(1, ["d1"]), (2, ["d1", "n2"]), (3, ["n2"]), (4, []), (5, None)], "ord long, keys array<string>")
    assert [(r.ord, r.ref) for r in identity.dedup_records(rows, "ord", "keys").orderBy("ord").collect()] == [(1, 1), (3, 2), (4, 3), (5, 4)]


def test_greedy_matches_a_sequential_scan(spark):
    rng = random.Random(2)
    rows = [(i, [f"k{rng.randrange(40)}" for _ in range(rng.randrange(4))]) for i in range(150)]
    owned, want = set(), []
    for i, keys in rows:
        if not owned & {*keys}:
            owned |= {*keys}
            want.append(i)
    df = spark.createDataFrame(rows, "ord long, keys array<string>")
    assert sorted(r.ord for r in select.greedy_by_keys(df, "ord", "keys").collect()) == want
    edges = [(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if {*x} & {*y}]
    frame = spark.createDataFrame(edges, "early long, late long")
    assert sorted(r.ord for r in select.greedy_by_edges(df, "ord", frame).collect()) == want


def test_receipts_match_by_identity_then_title(spark):
    rows = [
        (0, None, "t0", "10.1/a", None, "Same", 2001, 5), (1, None, "t1", "10.1/b", None, "Same", 2001, 9), (2, None, "t2", None, None, "same!", 2001, 1), (3, None, "t3", None, None, "Other", 2000, 1), (4, None, "t4", None, None, "Other", 2002, 1),
        (5, None, "t5", "10.1/A", "0012", "x", None, 1), (6, "NCT1", "Same  thesis", None, None, "p", None, 1), (7, "nct1", "same thesis", None, None, "q", None, 3),
    ]
    df = spark.createDataFrame(rows, "ord long, trial string, thesis string, doi string, pmid string, title string, year int, n_claims int")
    kept = sorted(r.ord for r in identity.dedup_receipts(df).collect())
    # 5 has two identifiers and takes 10.1/a from 0; 2 has 1's title; years part 3 and 4; 7 has more claims than 6.
    assert kept == [1, 3, 4, 5, 7]


def test_pools(spark):
    rows = [("same", 0.5, 0.1)] * 4 + [("two", 1.0, 0.1)] * 2 + [("wide", x, 0.2) for x in (0.1, 0.5, 1.2, 2.0)]
    df = spark.createDataFrame(rows, "g string, effect double, se double")
    got = {r.g: r for r in meta.pool(df, ["g"]).collect()}
    assert {*got} == {"same", "wide"}
    assert got["same"].q < 1e-18 and got["same"].tau2 == 0 and got["same"].i2 == 0 and math.isclose(got["same"].se, 0.05)
    y, w = [0.1, 0.5, 1.2, 2.0], 25.0
    q = sum(w * (x - 0.95) ** 2 for x in y)
    tau2 = (q - 3) / (4 * w - 4 * w * w / (4 * w))
    assert math.isclose(got["wide"].tau2, tau2) and math.isclose(got["wide"].estimate, 0.95) and math.isclose(got["wide"].i2, (q - 3) / q)
    mixed = spark.createDataFrame([("a", 1.0, 0.1, "md"), ("a", 1.0, 0.1, "rr"), ("a", 1.0, 0.1, "md"), ("b", 1.0, 0.0, "md")], "g string, effect double, se double, metric string")
    assert {tuple(r) for r in meta.unpoolable(mixed, ["g"]).collect()} == {("a", "mixed metrics"), ("b", "too few studies")}


def test_effect_shapes(spark):
    cols = ["effect", "se", "metric", "mean_t", "sd_t", "n_t", "mean_c", "sd_c", "n_c", "events_t", "events_c", "hr", "ci_lower", "ci_upper"]
    row = lambda **k: tuple(k.get(c) for c in cols)
    rows = [
        row(effect=1.0, se=0.5, metric="md"), row(mean_t=5.0, sd_t=1.0, n_t=10.0, mean_c=3.0, sd_c=1.0, n_c=10.0), row(events_t=5.0, n_t=10.0, events_c=2.0, n_c=10.0), row(hr=0.8, ci_lower=0.6, ci_upper=1.1),
        row(effect=1.0, se=0.5, hr=0.8, ci_lower=0.6, ci_upper=1.1), row(effect=1.0), row(events_t=0.0, n_t=10.0, events_c=2.0, n_c=10.0), row(effect=1.0, se=0.0),
    ]
    schema = ", ".join(f"`{c}` {'string' if c == 'metric' else 'double'}" for c in cols)
    got = meta.normalize_effects(spark.createDataFrame(rows, schema)).collect()
    assert [r["shape"] for r in got] == ["effect", "continuous", "binary", "hazard", "ambiguous", "unknown", "binary", "effect"]
    assert [r.error for r in got] == [None] * 4 + ["ambiguous shape", "unknown shape", "unusable numbers", "unusable numbers"]
    assert math.isclose(got[1].effect_size, 2.0) and math.isclose(got[2].effect_size, math.log(2.5)) and got[3].metric_out == "log_hr"


def test_claim_spans(spark):
    text = "HR 0.75 (95% CI 0.1 to 0.9; p<0.05), n = 120, 4.2 ± 1.1 mg, 30% better after 12 weeks"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no number"), (5, (text + " ") * 200)], "id int, text string")
    got = claims.extract(rows, "id", "text").collect()
    one = [r for r in got if r.id == 1]
    assert [r.kind for r in one] == ["ratio", "ci", "p_value", "n", "mean_sd", "unit", "percent", "unit"]
    assert next(r.groups for r in one if r.kind == "ci") == ["95", "0.1", "0.9"]
    assert {r.id for r in got} == {1, 5} and len(got) == 8 * 201
    for r in got:  # places and groups are those of the pattern
        m = re.compile(claims.KINDS[r.kind]).match(r.sentence, r.start)
        assert m.end() == r.end and list(m.groups()) == r.groups


def test_binding(spark):
    rows = spark.createDataFrame([(1, "Weight was reduced by 5% in the drug arm; pain improved", 22, "effect"), (2, None, 0, "effect"), (3, "nothing here", 0, "effect")], "id int, sentence string, start int, role string")
    got = {r.id: (r.endpoint, r.arm, r.direction, r.confidence) for r in claims.bind(rows, ["weight", "pain"], ["drug"], {"reduced": "negative", "improved": "positive"}).collect()}
    assert got == {1: ("weight", "drug", "negative", "high"), 2: (None, None, None, "none"), 3: (None, None, None, "none")}


def test_claims_of_neighbours_do_not_touch(spark):
    """Texts of one batch are read together; claims, blocked claims and terms stay in their own."""
    rows = spark.createDataFrame([(1, "n", "weight 5"), (2, "n", "% HR"), (3, "n", "0.5 and 7"), (4, "n", "5% weight"), (5, "n", "was reduced by 4%, ±; n =\n4")], "id int, role string, text string").coalesce(1)
    got = claims.extract(rows, "id", "text", keep=("role",))
    assert got.columns == ["id", "kind", "start", "end", "groups", "role", "sentence"]
    assert [(r.id, r.kind, r.start, r.end, r.groups, r.role) for r in got.collect()] == [(4, "percent", 0, 2, ["5"], "n"), (5, "percent", 15, 17, ["4"], "n")]
    assert claims.extract(rows, "id", "text", sentence=False).columns == ["id", "kind", "start", "end", "groups"]
    near = {r.id: (r.endpoint, r.direction) for r in claims.bind(got, ["weight"], ["x"], {"reduced": "negative"}).collect()}
    assert near == {4: ("weight", None), 5: (None, "negative")}


def test_binding_reads_a_sentence_once(spark, monkeypatch):
    """Not once a claim: texts given to the search are those of the sentences."""
    seen = []

    class Counted(claims.Joined):
        def __init__(self, texts):
            seen.append(len(texts))
            super().__init__(texts)

    monkeypatch.setattr(claims, "Joined", Counted)
    rows = spark.createDataFrame([("weight fell", i, "effect") for i in range(11)], "sentence string, start int, role string")
    grabbed = {}
    monkeypatch.setattr(type(rows), "mapInArrow", lambda d, f, s: grabbed.update(f=f) or d.selectExpr("*", "0 as _e", "0 as _a", "0 as _d"))
    claims.bind(rows, ["weight"], ["a"], {"fell": "negative"})
    list(grabbed["f"](iter(rows.toArrow().to_batches())))
    assert sum(seen) < 11


def test_thresholds_and_ties(spark):
    df = spark.createDataFrame([("<", 0.05), ("=", 0.05), ("<=", 0.05), (">", 0.01), ("=", 0.01), ("<", 1.5), (None, 0.01)], "c string, p double")
    assert [r.s for r in df.select(aggregates.significant(F.col("c"), F.col("p")).alias("s")).collect()] == [True, False, True, False, True, False, False]
    rows = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 3), ("g", "b", 4), ("h", None, 5), ("h", "c", 6)], "g string, v string, o int")
    assert {(r.g, r.v, r.n) for r in aggregates.mode(rows, ["g"], "v", "o").collect()} == {("g", "b", 2), ("h", "c", 1)}
    assert {(r.g, r.dominant) for r in aggregates.direction_profile(rows.where("v is not null"), "g", "v").collect()} == {("g", "mixed"), ("h", "c")}


def test_top_tensions(spark):
    rows = spark.createDataFrame([(1, "p", "q"), (2, "q", "r"), (3, "p", "s"), (4, "r", "s")], "o int, a string, b string")
    assert [r.o for r in tension.top_tensions(rows, "o", 10).collect()] == [1, 4]
    assert tension.top_tensions(rows, "o", 0).count() == 0
    assert [r.tension_id for r in tension.plan(rows, "o").collect()] == ["T001", "T002", "T003", "T004"]


def test_directional_kind(spark):
    d = ["positive", "negative", "null", "mixed"]
    df = spark.createDataFrame([(a, b) for a in d for b in d], "a string, b string")
    got = {(r.a, r.b): r.k for r in df.select("a", "b", tension.directional_kind(F.col("a"), F.col("b")).alias("k")).collect()}
    assert got["positive", "negative"] == got["negative", "positive"] == "disagreement" and got["null", "null"] == "orthogonal" and got["positive", "positive"] == "agreement" and got["null", "negative"] == "null_vs_negative"


def test_similar_sets_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [f"w{rng.randrange(30)}" for _ in range(rng.randrange(3, 12))]) for i in range(120)]
    rows += [(200 + i, r[1] + ["extra"]) for i, r in enumerate(rows[:30])] + [(300, rows[0][1])]
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(t), i)
    for limit in (0.5, 0.8, 0.9):
        want = {(*sorted((i, j)), round(len(x & y) / len(x | y), 9)) for (x, i), (y, j) in itertools.combinations(sets.items(), 2) if len(x & y) / len(x | y) >= limit}
        got = similarity.similar_sets(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t", limit).collect()
        assert {(r.a, r.b, round(r.similarity, 9)) for r in got} == want


def test_rollup_and_gates(spark):
    tree = spark.createDataFrame([("r", None, 0, "mean", False), ("a", "r", 1, "min", False), ("b", "r", 1, "mean", False), ("a1", "a", 2, "mean", False), ("a2", "a", 2, "mean", False), ("b1", "b", 2, "mean", True), ("b2", "b", 2, "mean", False)], "id string, parent string, depth int, strategy string, critical boolean")
    leaves = spark.createDataFrame([("a1", 1.0), ("a2", 0.5), ("b1", 0.0), ("b2", 1.0)], "id string, score double")
    got = {r.id: (r.score, r.status) for r in gates.rollup(tree, leaves, 2).collect()}
    assert got["a"] == (0.5, "partial") and got["b"] == (0.0, "failed") and got["r"] == (0.25, "partial") and got["a1"][1] == "passed"


def test_ledger_upsert_and_window(spark):
    state = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    news = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1)], "k string, v int, o int")
    assert {tuple(r) for r in ledger.upsert(state, news, ["k"], "o").collect()} == {("a", 1), ("b", 6), ("c", 7)}
    pages = spark.createDataFrame([("l", i, 100, 1 if i > 2 else 50, 50, 10) for i in range(9)], "lane string, page int, hits int, new int, core int, noise int")
    assert [r.stop for r in ledger.yield_stop(pages, "lane", "page").orderBy("page").collect()] == [False] * 7 + [True] * 2


def test_classifier_rescue(spark):
    df = spark.createDataFrame([("off_thesis", "A1"), ("reject", "A1"), ("off_thesis", "C"), ("core_on_thesis", "C")], "c string, t string")
    assert [r.p for r in df.select(classify.extraction_pool(F.col("c"), F.col("t")).alias("p")).collect()] == ["adjacent", None, None, "core"]


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    keys = lambda *a: one(tx.identity_keys(*[F.lit(x).cast("string") for x in a]))
    assert keys("10.1/A", "0012", None, "see NCT1234567.", "T") == ["doi:10.1/a", "pmid:12", "nct:NCT1234567"]
    assert keys(None, "", None, None, "A b!") == ["title:ab"] and keys(None, "000", None, None, "x") == ["pmid:0"] and keys(None, None, None, None, "!") == []
    assert one(tx.canonical_number(F.lit("1,234.5"))) == "1234.5" and one(tx.canonical_number(F.lit(".5"))) == "0.5"
    assert [one(tx.alpha_suffix(F.lit(k))) for k in (0, 25, 26, 701, 702)] == ["a", "z", "aa", "zz", "aaa"]
    assert one(tx.clean_text(F.lit("<p>H<sub>2</sub>O&nbsp;&lt;x&gt;</p>\n"))) == "H2O <x>"


def test_diverse_choice(spark):
    rng = random.Random(7)
    rows = [(i % 3, i, [rng.choice([-1.0, 1.0]) * rng.random() for _ in range(3)]) for i in range(60)]
    want = []
    for g in range(3):
        kept = []
        for _, i, v in sorted(r for r in rows if r[0] == g):
            cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
            if all(cos(v, k) <= 0.86 for k in kept):
                kept.append(v)
                want.append((g, i))
    got = tension.diverse(spark.createDataFrame(rows, "g int, i int, v array<double>"), "g", "i", "v").collect()
    assert sorted((r.g, r.i) for r in got) == sorted(want) and len(want) < 60


def test_fingerprint_ignores_order_only(spark):
    from weft.operators import audit

    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "x"), ("b", 2, None), ("c", 1, "x"), ("c", 3, None), ("d", 1, "x"), ("d", 1, "x")], "g string, k int, v string")
    got = {r.g: r.digest for r in audit.fingerprint(df.repartition(3), ["g"], ["k", "v"]).collect()}
    assert got["a"] == got["b"] and len({*got.values()}) == 3
    assert got == {r.g: r.digest for r in audit.fingerprint(df.orderBy(F.desc("k")), ["g"], ["k", "v"]).collect()}


def test_near_duplicate_lines(spark):
    words = [f"w{k}" for k in range(25)]
    rows = [(1, " ".join(words) + "\nshort line"), (2, " ".join(words[::-1])), (3, " ".join(words[:24] + ["other"])), (4, None)]
    got = similarity.near_duplicate_lines(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()
    assert [round(r.similarity, 6) for r in got] == [round(24 / 26, 6)]  # the reversed line has the same set
