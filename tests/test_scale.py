"""Operators that avoid pairs, held against the pairs themselves."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from weft.operators import identity, matching, numerics, similarity, studies, tension
from weft.sources import landed, runs
from weft.streaming import ledger

DIRECTIONS = ("positive", "negative", "null", "mixed")


def test_severity_counts_pairs(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, rng.choice("xy"), rng.choice(["direct", "direct", "indirect"]), [(e, rng.choice(DIRECTIONS)) for e in rng.sample(["a", "b", "c"], rng.randrange(4))]) for i in range(60)]
    said = spark.createDataFrame(rows, "id int, topic int, outcome string, directness string, said array<struct<endpoint:string,direction:string>>")
    none = F.lit(None).cast("string")
    receipts = said.select("id", "topic", "outcome", "directness", tension.endpoint_map(F.col("said"), F.array(none), none).alias("endpoint_directions"))
    counted = {(r.topic, r.kind): r.n for r in tension.severity(receipts, "topic").collect()}
    paired = tension.pairs(receipts, "topic").groupBy("topic", "kind").count()
    assert counted == {(r.topic, r.kind): r["count"] for r in paired.collect()} and sum(counted.values()) == 2 * 30 * 29 // 2


def test_pairs_of_one_topic_are_dealt(spark):
    rng = random.Random(5)
    rows = [(i, "t", rng.choice(["x", "y", None]), rng.choice(["direct", "indirect", None]), {e: rng.choice(DIRECTIONS) for e in rng.sample(["a", "b"], rng.randrange(3))}) for i in [*range(50), 7, None]]
    receipts = spark.createDataFrame([*rows, (99, None, "x", "direct", {})], "id int, topic string, outcome string, directness string, endpoint_directions map<string,string>").coalesce(1)
    got = tension.pairs(receipts, "topic", chunk=3)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1  # one topic was one task
    a, b = receipts.alias("a"), receipts.alias("b")
    shared = tension.shared_endpoint(F.col("a.endpoint_directions"), F.col("b.endpoint_directions"))
    kind = tension._kind("a", "b", F.col("s.kind"))
    plain = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (F.col("a.id") < F.col("b.id"))).withColumn("s", shared).select("a.topic", F.col("a.id").alias("x"), F.col("b.id").alias("y"), kind.alias("kind"), F.when(kind == F.col("s.kind"), F.col("s.endpoint")).alias("endpoint"))
    known = sorted(map(repr, (tuple(r) for r in plain.collect())))
    assert known == sorted(map(repr, (tuple(r) for r in got.select("topic", "a", "b", "kind", "endpoint").collect()))) and len(known) > 1000


def test_shared_endpoints(spark):
    rows = [([("HbA1c", "positive"), ("weight", "null")], [("hba1c", "negative"), ("Weight", "positive")]), ([("a", "positive")], [("b", "negative")]), ([("a", "positive"), ("a", "null")], [("a", "negative")]), (None, [("a", "null")])]
    df = spark.createDataFrame(rows, "x array<struct<endpoint:string,direction:string>>, y array<struct<endpoint:string,direction:string>>")
    none = F.lit(None).cast("string")
    maps = [tension.endpoint_map(F.col(c), F.array(none), none) for c in "xy"]
    got = [r.s for r in df.select(tension.shared_endpoint(*maps).alias("s")).collect()]
    assert got[0].kind == "disagreement" and got[1] is None and got[2].kind == "null_vs_negative" and got[3] is None
    alone = spark.range(1).select(tension.endpoint_map(F.lit(None), F.array(F.lit("Pain")), F.lit("Negative")).alias("m")).first().m
    assert [*alone.values()] == ["negative"] and len(alone) == 1


def test_agreeing_makes_the_pairs_that_agree(spark):
    rng = random.Random(11)
    pick = lambda *xs: rng.choice([None, *xs])
    rows = [(f"w{i:02}", pick("t", "u"), pick("d", "e"), pick("p", "q"), pick("1", "2")) for i in range(60)]
    got = {(r.a, r.b) for r in identity.agreeing(spark.createDataFrame(rows, "who string, title string, doi string, pmid string, year string"), "title", ["doi", "pmid", "year"]).collect()}
    fits = lambda x, y: x[1] is not None and x[1] == y[1] and all(a is None or b is None or a == b for a, b in zip(x[2:], y[2:], strict=True))
    assert got == {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if fits(x, y)} and got


def test_containing(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("ab c") for _ in range(rng.randrange(12)))) for i in range(80)] + [(90, None)]
    terms = ["a", "ab", "abc", "b ca", "", "zz", "abcab", "ab"]
    got = {(r.id, r.term) for r in matching.containing(spark.createDataFrame(texts, "id int, x string"), "id", "x", spark.createDataFrame([(t,) for t in terms], "t string"), "t").collect()}
    assert got == {(i, t) for i, x in texts if x for t in terms if t and t in x}
    assert matching.containing(spark.createDataFrame(texts, "id int, x string"), "id", "x", spark.createDataFrame([], "t string"), "t").count() == 0


def test_similar_sets_of_few_words(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(30)]
    sets = [set(rng.sample(words, rng.randrange(1, 22))) for _ in range(300)]
    sets += [s ^ {rng.choice(words)} for s in sets[:100]]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets) if s], "id int, t array<string>")
    first = {frozenset(s): i for i, s in reversed([*enumerate(sets)]) if s}
    known = {(min(first[x], first[y]), max(first[x], first[y])) for x, y in itertools.combinations(first, 2) if len(x & y) >= 0.9 * len(x | y)}
    assert {(r.a, r.b) for r in similarity.similar_sets(df, "id", "t", 0.9).collect()} == known and len(known) > 20
    # Rows under a word that many sets have met each other; few of those under a part's key do.
    hashed = df.select("id", F.transform("t", lambda x: F.xxhash64(x)).alias("t")).toArrow().combine_chunks().to_batches()
    keys = [(k, i, smaller) for b in hashed for out in similarity._signed(b, 0.9) for i, k, smaller in zip(*(out.column(c).to_pylist() for c in (0, 3, 4)), strict=True)]
    held = {}
    for k, i, smaller in keys:
        held.setdefault(k, set()).add(i)
    assert sum(len(x) * (len(x) - 1) // 2 for x in held.values()) < len(sets) * (len(sets) - 1) // 2 / 20


def test_line_members_sends_no_text(spark):
    text = "A long line of words\nb a\n" * 3 + "a, b!\n"
    docs = spark.createDataFrame([(1, text), (1, text), (2, "a b"), (None, "A b"), (3, None)], "id int, x string")
    lines = {(i, x) for i, t in [(1, text), (2, "a b"), (None, "A b")] for x in t.split("\n") if x}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    words = lambda x: frozenset(re.findall("[a-z0-9]+", x.lower()))
    known = sorted((str(i), md5(x), min(md5(y) for _, y in lines if words(y) == words(x))) for i, x in lines)
    got = similarity.line_members(docs, "id", "x", 1)
    assert sorted((str(r.id), r.line_id, r.representative) for r in got.collect()) == known
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^\n]*\bline#", plan)  # whole lines were shuffled


def test_pool_reads_a_value_once(spark):
    rows = [("high", "", "5.0 mg"), ("High", "", "5 mg"), ("partial", "unit_value", "1,200"), ("partial", "p_value", "7"), ("none", "unit_value", "8"), ("high", "", "n/a"), ("high", "", None), (None, "", "9")]
    claims = spark.createDataFrame(rows, "confidence string, claim_type string, value string")
    pools = {strict: numerics.pool(claims, strict) for strict in (True, False)}
    assert {k: {r.number for r in p.collect()} for k, p in pools.items()} == {True: {"5", "1200"}, False: {"5", "1200", "7"}}
    plan = pools[True]._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan[plan.rindex("Aggregate [value"):]  # the filter ran on every claim


def test_similar_sets_of_long_sets(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 300]))] for _ in range(4)]
    rows = []
    for b in base:
        for _ in range(12):
            own = [x for x in b if rng.random() > 0.06] + [f"n{rng.randrange(9999)}" for _ in range(rng.randrange(len(b) // 10))]
            rows.append((len(rows), own))
    rows += [(100, []), (101, None), (102, rows[0][1]), (102, rows[0][1])]
    sets = {}
    for i, t in rows:
        if t:
            sets.setdefault(frozenset(t), i)
    for limit in (0.8, 0.9, 1.0):
        want = {(*sorted((i, j)),) for (x, i), (y, j) in itertools.combinations(sets.items(), 2) if len(x & y) / len(x | y) >= limit}
        got = similarity.similar_sets(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t", limit)
        assert {(r.a, r.b) for r in got.collect()} == want


def test_cosine_search_in_blocks(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(50)] + [(60, None)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    one = {(r.query, r.match, round(r.cosine, 9)) for r in similarity.cosine_search(v.where("id % 5 = 0"), v, "id", "v", 0.5).collect()}
    many = {(r.query, r.match, round(r.cosine, 9)) for r in similarity.cosine_search(v.where("id % 5 = 0"), v, "id", "v", 0.5, block=3).collect()}
    assert one == many and one
    assert similarity.cosine_search(v.where("id < 0"), v, "id", "v", 0.5).count() == 0
    packed = {(r.query, r.match, round(r.cosine, 9)) for r in similarity.cosine_search(v.where("id % 5 = 0"), v, "id", "v", 0.5, block=3, max_bytes=0).collect()}
    assert packed == one and similarity.cosine_search(v, v.where("id < 0"), "id", "v", 0.5, max_bytes=0).count() == 0


def test_close_pairs_in_blocks(spark):
    rng = random.Random(9)
    rows = [("g" if i % 3 else None, i, [rng.random() for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i long, v array<float>")
    pairs = [{(r.g, r.early, r.late) for r in similarity.close_pairs(df, "g", "i", "v", 0.95, block=n).collect()} for n in (512, 4)]
    assert pairs[0] == pairs[1] and all(a < b for _, a, b in pairs[0]) and {g for g, _, _ in pairs[0]} == {"g", None}


def test_broken_payloads(spark):
    bad = "<PubmedArticleSet><PubmedArticle><PMID>1</PMID><ArticleTitle>A &foo; <b>B</ArticleTitle><Abstract><AbstractText><![CDATA[x < y]]></AbstractText></Abstract></PubmedArticle><PubmedArticle><PMID>2</PMID><ArticleTitle>C</ArticleTitle></PubmedArticle></PubmedArticleSet>"
    rows = [("pubmed", bad), ("pubmed", bad[:-5]), ("pubmed", "<"), ("arxiv", "<?xml version='1.0'?>\n<!-- c --><feed/>"), ("core", '{"results": []}'), ("core", '{"message": "busy"}'), ("core", "[1"), ("core", None)]
    df = spark.createDataFrame(rows, "source string, payload string")
    got = [(r.pmid, r.title) for r in landed.read_all(df.limit(1)).orderBy("pmid").collect()]
    assert [p for p, _ in got] == ["1", "2"] and got[1][1] == "C" and got[0][1].startswith("A")
    assert landed.read_all(df).count() == 4
    assert sorted(r.reason for r in landed.quarantine(df).collect()) == ["cut off", "empty", "no records", "not JSON or XML", "not JSON or XML"]


def test_nested_and_repeated_sections(spark):
    text = "<body><sec><title>Methods</title><p>a</p><sec id='2'><title>Arms <i>two</i></title><p>b</p><p>c</p></sec></sec><sec><title>methods</title><p>d</p></sec><sec><p>e</p></sec></body>"
    s = spark.createDataFrame([(text,), (None,)], "t string").select(landed.jats_sections(F.col("t")).alias("s")).collect()
    assert s[0].s == {"methods": "a d", "arms two": "b c", "": "e"} and s[1].s == {}


def test_streams_keep_the_last_row_and_forget_late_events(spark, tmp_path):
    day = lambda n, k: [(i, f"2024-01-{n:02} 0{i % 9}:00:00", i, "t", 1.0) for i in range(k)]
    schema = "event_id long, ts string, user_id int, event_type string, value double"
    for batch in ([*day(1, 3)], [*day(1, 2), *day(9, 2)], [*day(1, 4), *day(10, 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ledger.daily(ledger.read_events(spark, f"{tmp_path}/in", 1))
        last = {r.day.day: r.n for r in ledger.run_once(stream, f"{tmp_path}/update", "update", keys=["day", "event_type"]).collect()}
        closed = {r.day.day: r.n for r in ledger.run_once(stream, f"{tmp_path}/append").collect()}
    # The last four events of the first day come after the watermark has passed it.
    assert last == {1: 5, 9: 2, 10: 1} and closed == {1: 5}
    with pytest.raises(ValueError):
        ledger.run_once(stream, f"{tmp_path}/none", "update")


def test_study_rules_on_nulls(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(studies.study_role(none, none, none, F.lit(None).cast("boolean")).alias("role")).first()
    assert row.role


def test_cited_rows_send_no_bundles_to_all(spark):
    """Bundles come of an explode, whose size Spark underrates; they must not be broadcast."""
    from weft.operators import supply

    texts = spark.createDataFrame([(1, 7, "As in [2]. Abel 2001."), (2, 8, "PMID: 5"), (3, 9, "[1]")], "id int, bundle int, text string")
    bundle = spark.createDataFrame([(7, 1, "Abel 2001", "4", None), (7, 2, "Bo 1", "5", None), (8, 1, "Cay 2", "5", "10.1000/x")], "bundle int, position int, cited_as string, pmid string, doi string")
    got = supply.cited_rows(texts, bundle)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (2, 1)]
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()


def test_capped_tensions_make_no_pairs(spark, monkeypatch):
    """Receipts of many kinds: the greedy choice from kinds is that from all pairs, to the last one."""
    rng = random.Random(5)
    rows = [(i, i % 2, rng.choice("xy"), rng.choice(["direct", "indirect"]), [(e, rng.choice(DIRECTIONS)) for e in rng.sample(["a", "b"], rng.randrange(3))]) for i in range(40)]
    said = spark.createDataFrame(rows, "id int, topic int, outcome string, directness string, said array<struct<endpoint:string,direction:string>>")
    none = F.lit(None).cast("string")
    receipts = said.select("id", "topic", "outcome", "directness", tension.endpoint_map(F.col("said"), F.array(none), none).alias("endpoint_directions")).localCheckpoint()
    used, want = set(), []
    for r in sorted(tension.pairs(receipts, "topic").collect(), key=lambda r: (-r.severity, r.a, r.b)):
        if not used & {r.a, r.b}:
            used |= {r.a, r.b}
            want.append((r.topic, r.a, r.b, r.kind, r.endpoint, r.severity))
    from weft.plans import synthesis

    monkeypatch.setattr(tension, "pairs", None)
    for top in (7, 30):
        assert sorted(map(tuple, tension.top_capped(receipts, "topic", top).collect())) == sorted(want[:top])
    assert synthesis.QUERIES["tension_top_capped"](spark, "/root/testdata/sf0.001").count() == 4


def test_mechanisms_meet_once(spark):
    """Rows that repeat would be multiplied by each other in one task a key."""
    topics = spark.createDataFrame([("t", "d")] * 9 + [("d", "u")], "topic string, domain string")
    mapping = spark.createDataFrame([("d", "m")] * 9 + [("x", "n")], "key string, mechanism string")
    got = matching.expand_mechanisms(topics, mapping)
    assert sorted(map(tuple, got.collect())) == [("d", "m"), ("t", "m")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 5


def test_papers_are_dealt_over_tasks(spark):
    """Orders are one small file; their papers must not be one task."""
    from weft.operators import surface
    from weft.plans import surfaces

    papers = surfaces.papers(spark, "/root/testdata/sf0.001")
    assert papers.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows = spark.createDataFrame([(" \t",), ("| a |",), (" one  two\n| a b |\nthree\r\n",), (None,)], "t string")
    assert [r.n for r in rows.select(surface.words(F.col("t")).alias("n")).collect()] == [0, 0, 3, 0]


def test_settler_sets_one_timer():
    """A timer and a read of the state a wait would make a marker's rows quadratic."""
    import pandas as pd

    from weft.streaming.markers import Settler

    class State(list):
        def get(self):
            return iter(self)

        def put(self, rows):
            self[:] = rows

    class Handle:
        timers = []

        def getListState(self, *_):  # noqa: N802
            return State()

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class Values:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 600

    s, h = Settler(100_000), Handle()
    s.init(h)
    rows = pd.DataFrame({"kind": ["submission"] * 500 + ["publication"] * 2, "run": [str(i) for i in range(500)] + [None] * 2, "us": [1000 * (i + 1) for i in range(500)] + [90_000, 80_000]})
    got = pd.concat(s.handleInputRows(("m",), iter([rows]), None))
    assert len(got) == 190 and set(got["published_at"]) == {80_000, 90_000} and h.timers == [180]
    gone = pd.concat(s.handleExpiredTimer(("m",), Values(), None))
    assert len(gone) == 310 and not s.waiting and not s.published and h.timers == [180]


def test_sentence_rules_are_dealt_and_guarded(spark):
    """Line items are one small file; guards of patterns leave out no match."""
    from weft.operators import issues
    from weft.plans import manuscripts

    assert manuscripts.sentence_rows(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    texts = ["As Abel et al. (2999) say", "It is 7 below 5", "It is 3 is above 5", "It is 3 below 5", "No change was seen (p 3)", "One (TBD) two", "Lorem Ipsum", "See A1_x here", "the the", "B3_x et al below", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    got = {(r.id, r.code) for r in issues.issues(rows, "id", F.lit(0), F.col("s"), issues.sentence_rules(2026)).collect()}
    assert got == {(0, "future_citation"), (1, "arithmetic"), (2, "arithmetic"), (4, "no_change_nonzero"), (5, "template_artifact"), (6, "template_artifact"), (7, "internal_label"), (8, "repeated_word")}


def test_sentences_that_rows_share_are_read_once(spark):
    from weft.operators import numerics

    said = [(i, "Baseline speed was 5 in Abel 2001." if i % 2 else "We reported 6 in Abel 2001.") for i in range(8)] + [(1, "Baseline speed was 5 in Abel 2001."), (9, "We reported 6 in Cay 2002."), (10, None)]
    index = spark.createDataFrame([("Abel 2001", "5", ["dose"]), ("Abel 2001", "7", ["effect"])], "citation string, number string, roles array<string>")
    found = numerics.role_drift(spark.createDataFrame(said, "id int, s string"), "id", "s", index)
    assert sorted((r.id, r.number, r.issue) for r in found.collect()) == [(i, "5" if i % 2 else "6", "role_drift" if i % 2 else "value_drift") for i in range(8)]
    assert "Repartition" in found._jdf.queryExecution().optimizedPlan().toString()


def test_sections_that_papers_share_are_read_once(spark):
    from weft.operators import outcomes

    text = "Grip strength (GS) improved in the drug group; GS rose again."
    other = "GS improved in the drug group at the end."
    rows = [(1, "Abstract", text), (1, "results", text), (2, "results", text), (2, "conclusion", other), (3, "abstract", other), (2, "results", text), (4, "methods", text), (5, "results", None)]
    found = outcomes.outcome_claims(spark.createDataFrame(rows, "paper int, section string, text string"), [("grip strength", r"\bgrip strength\b")], [("increase", r"\b(?:improved|rose)\b")])
    got = sorted((r.paper, r.section, r.clause[-14:]) for r in found.collect())
    assert got == sorted([(1, "abstract", "the drug group"), (1, "abstract", "th rose again."), (2, "conclusion", "up at the end."), (2, "results", "the drug group"), (2, "results", "th rose again.")])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Repartition") >= 3


def test_receipts_are_deduplicated_without_their_texts(spark):
    rows = [(1, None, "A  b" + "x" * 300, None, None, "One", None, 3), (2, None, " a b" + "X" * 250, None, None, "Two", None, 5), (3, None, "c", None, None, "one!", None, 1), (4, None, None, None, None, None, None, 0)]
    got = identity.dedup_receipts(spark.createDataFrame(rows, "ord long, trial string, thesis string, doi string, pmid string, title string, year int, n_claims int"))
    assert sorted(r.ord for r in got.collect()) == [2, 3, 4] and "thesis" not in got.columns


def test_sketches_are_not_made_for_each_user(spark):
    import re

    from weft.plans import supplies

    plan = supplies.QUERIES["approximate_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    keys = re.findall(r"keys=\[([^\]]*)\], functions=\[([^\n]*)", plan)
    assert any("approx" in f for _, f in keys) and not any("user_id" in k and "approx" in f for k, f in keys)


def test_run_files_are_checked_once(spark):
    """Each of a run's three files is parsed once to see whether it is an object, and no schema is made for that."""
    files = spark.createDataFrame([("/r/a/" + n, "{}") for n in (runs.VERDICT, runs.MANIFEST, runs.REGISTRY)], "path string, content string")
    plan = runs.run_summaries(files)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("parseJson("), plan.count("schemaOfVariant(")) == (3, 0)
    texts = {"{}": True, " \n{}": True, '{"a": [1]}': True, "[{}]": False, "{": False, "": False, "\f{}": False, "{'a': 1}": False, '{"a": 1, "a": 1}': False, "1": False, None: False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", runs.is_object(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in rows} == texts


def test_receipts_of_one_title_make_no_pairs(spark, monkeypatch):
    """A title that half of the rows share, with an identifier or without: the rows written stay in proportion, and the rows kept are those of a scan."""
    from weft.operators import select

    rng, rows = random.Random(4), []
    for i in range(160):
        doi = rng.choice([None, None, f"10.1/{rng.randrange(60)}", f"10.1/{i}"])
        pmid, year = rng.choice([None, None, None, f"00{rng.randrange(40)}"]), rng.choice([None, None, 2001, 2002])
        rows.append((i, None, f"t{i}" if i % 7 else "T  0", doi, pmid, "One!" if i % 2 else rng.choice([None, "", f"n{rng.randrange(30)}"]), year, rng.randrange(5)))

    def clash(a, b):
        agree = lambda j: a[j] is None or b[j] is None or a[j] == b[j]
        same = lambda j: a[j] is not None and a[j] == b[j]
        titled = (a[5] or None) is not None and a[5] == b[5]
        return a[2] == b[2] or (same(3) and agree(4)) or (same(4) and agree(3)) or (titled and all(agree(j) for j in (3, 4, 6)))

    kept = []
    for r in sorted(rows, key=lambda r: (-((r[3] is not None) + (r[4] is not None)), -r[7], r[0])):
        if not any(clash(r, k) for k in kept):
            kept.append(r)
    written, plain = [], select.cut

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(select, "cut", counted)
    monkeypatch.setattr(identity, "cut", counted)
    frame = spark.createDataFrame(rows, "ord long, trial string, thesis string, doi string, pmid string, title string, year int, n_claims int")
    got = identity.dedup_receipts(frame)
    assert sorted(r.ord for r in got.collect()) == sorted(r[0] for r in kept)
    assert max(written) <= 13 * len(rows)


def test_manuscripts_that_orders_share_are_read_once(spark, tmp_path, monkeypatch):
    """Of 70 orders, some with one text and some twice in the table, each text is read once and each order has its issues."""
    from weft.operators import surface
    from weft.plans import surfaces

    period = 10 * 27 * 7 * 5 * 11 * 13 * 17
    keys = [k + n * period for k in range(35) for n in range(2)]
    spark.createDataFrame([(k,) for k in [*keys, *keys[:9]]], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    read, plain = [], surface.manuscripts

    def counted(docs, id_col, text_col):
        read.append(docs.count())
        return plain(docs, id_col, text_col)

    monkeypatch.setattr(surface, "manuscripts", counted)
    for name, level in (("paper_issues", 1), ("paragraph_issues", 2), ("surface_sentence_issues", 3)):
        got = [tuple(r) for r in surfaces.QUERIES[name](spark, str(tmp_path)).collect()]
        want = {(k, code) for k in keys for d, fragments in surfaces.FRAGMENTS.values() for code in fragments[k // d % len(fragments)][level]}
        assert sorted(got) == sorted(want)
    assert read == [35] * 3


def test_paper_rules_look_for_words_first(spark):
    """The words of an abstract are cut once, not at each of their places; patterns still find their texts in any case."""
    from weft.operators import issues, surface

    texts = {
        "unresolved_template": "STUDY(S) were read", "citation_artifact": "It was so PMID:\nand more", "grammar_artifact": "It IS said\tTO\nIs", "pipeline_jargon": "Accepted Receipts", "unresolved_statistic": "The P-Value was Unknown", "human_verification": "HUMAN-Reviewed",
        "unbacked_appraisal": "rob 2", "repair_artifact": "EVIDENCE\nsuggests  that evidence suggests that", "internal_tier_label": "B2_x", "internal_handle": "PMC1234567", "orphan_table": "See TABLE\n4", "classification_row": "x\n|  **Directness** | y |", "polarity": "Decreased\nLIFESPAN by 5",
        "duplicate_phrase": "In Mice in mice", "abstract_contradiction": "There were 0 mechanistic sources.\n## Results\nMechanistic", "plain": "One was seen and one was kept",
    }
    docs = spark.createDataFrame([(k, f"## Abstract\n{t}\n") for k, t in texts.items()], "id string, text string")
    rules = surface.paper_rules({}, {}, 0, 0, 0, (0, 0.0))
    found = issues.issues(surface.judged(surface.manuscripts(docs, "id", "text")), "id", F.lit(0), F.lit(""), rules)
    want = {(k, k) for k in texts if k != "plain"} | {("repair_artifact", "duplicate_phrase")}
    assert {(r.id, r.code) for r in found.collect()} - {(k, "missing_references") for k in texts} == want
    assert "regexp" not in str(rules["duplicate_phrase"][1])
