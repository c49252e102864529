import json

from weft.plans import flows
from weft.plans.registry import queries
from weft.streaming import ledger


def test_seed_corpus(spark):
    hits = [
        {"title": "Metformin randomized trial", "abstractText": "placebo improved survival", "pubYear": "2024", "doi": "10.1000/a", "pmid": "1"},
        {"title": "Metformin randomized trial", "abstractText": "placebo improved survival, longer", "pubYear": "2024", "doi": "10.1000/a"},
        {"title": "Zebra", "abstractText": "traumatic brain injury"},
    ]
    rows = [("europepmc", json.dumps({"resultList": {"result": hits}})), ("openalex", json.dumps({"results": [{"display_name": "Other", "ids": {"pmid": "https://x/0001"}}]})), ("core", "broken")]
    pack = {"aliases": ["metformin"], "lexicon": {"reject": ["traumatic brain injury"], "core": ["randomized"], "mechanism": ["in vitro"], "context": ["treated with"]}}
    out = flows.seed_corpus(spark.createDataFrame(rows, "source string, payload string"), pack, 2026)
    got = {r.title: r for r in out["corpus"].collect()}
    assert {*got} == {"Metformin randomized trial", "Zebra"} or {*got} == {"Metformin randomized trial", "Zebra", "Other"}
    top = got["Metformin randomized trial"]
    assert top["class"] == "core_on_thesis" and top.pool == "core" and top.abstract.endswith("longer") and got["Zebra"]["class"] == "reject"
    assert {r.stage: r.n for r in out["funnel"].collect()}["pool:core"] == 1 and out["quarantine"].count() == 1


def test_synthesize_and_field(spark):
    text = "weight was reduced in the drug arm (p = 0.01), n = 40"
    rows = [(f"p{i}", "t", "w", "direct" if i else "indirect", text.replace("reduced", "improved") if i == 2 else text) for i in range(4)] + [("p9", "t", "w", "direct", None)]
    out = flows.synthesize(spark.createDataFrame(rows, "paper string, topic string, outcome string, directness string, text string"), ["weight"], ["drug"], {"reduced": "negative", "improved": "positive"})
    assert {r.id: r.direction for r in out["receipts"].collect()} == {"p0": "negative", "p1": "negative", "p2": "positive", "p3": "negative"}
    kinds = sorted(r.kind for r in out["tensions"].collect())
    assert kinds == ["agreement", "disagreement", "disagreement"] + ["indirectness_gap"] * 3
    run = out["runs"].first()
    assert (run.receipts, run.tensions, run.level) == (4, 6, 2)
    runs = spark.createDataFrame([("a", "r1", 3, 5), ("a", "r2", 4, 2), ("b", "r3", 0, 9), ("c", "r4", 1, 1)], "topic string, run string, level int, receipts int")
    effects = spark.createDataFrame([("a", "o", 1), ("b", "o", -1), ("c", "o", -1)], "topic string, outcome string, sign int")
    field = flows.synthesize_field(runs, effects)
    assert {(r.topic, r.best) for r in field["manifest"].collect()} == {("a", "r2"), ("c", "r4")}
    assert [(r.outcome, list(r.positive_topics), list(r.negative_topics)) for r in field["contradictions"].collect()] == [("o", ["a"], ["c"])]


def test_pooled_outcomes(spark):
    cols = ["effect", "se", "mean_t", "sd_t", "n_t", "mean_c", "sd_c", "n_c", "events_t", "events_c", "hr", "ci_lower", "ci_upper"]
    rows = [("o", f"s{i}", i, "md", 1.0 + i / 10, 0.5, *[None] * 11) for i in range(4)] + [("o", "s0", 9, "md", 50.0, 0.1, *[None] * 11), ("o", "bad", 10, "md", 1.0, 0.0, *[None] * 11)]
    out = flows.pooled_outcomes(spark.createDataFrame(rows, "outcome string, study string, ord int, metric string, " + ", ".join(f"{c} double" for c in cols)), ["outcome"])
    pool = out["pools"].first()
    assert pool.k == 4 and abs(pool.estimate - 1.15) < 1e-12 and out["quarantine"].count() == 1 and out["left_out"].count() == 0


def test_late_events_are_dropped_and_repeats_too(spark, tmp_path):
    def batch(name, rows):
        spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))

    batch("b=1", [(1, "2024-01-10 00:00:00", 1, "view", 1.0), (1, "2024-01-10 00:00:01", 1, "view", 1.0)])
    stream = ledger.read_events(spark, str(tmp_path / "in" / "*"))
    rows = ledger.run_once(ledger.first_of(stream, ["event_id"]), str(tmp_path / "out"))
    assert rows.count() == 1
    batch("b=2", [(1, "2024-01-10 01:00:00", 1, "view", 1.0), (2, "2024-01-10 02:00:00", 1, "view", 1.0), (3, "2023-12-01 00:00:00", 1, "view", 1.0)])
    rows = ledger.run_once(ledger.first_of(ledger.read_events(spark, str(tmp_path / "in" / "*")), ["event_id"]), str(tmp_path / "out"))
    assert sorted(r.event_id for r in rows.collect()) == [1, 2]  # 1 again and 3 too late


def test_registered_streams_keep_all_events_of_many_files(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    rng, start, sf = random.Random(8), datetime(2024, 1, 1), str(tmp_path)
    rows = [(k % 110, start + timedelta(days=rng.randrange(60), minutes=k), k % 4, "view", 1.0) for k in range(120)]  # ten ids twice
    for k in range(20):  # more files than a trigger of eight takes, in no order of time
        spark.createDataFrame(rows[k::20], "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{sf}/events.parquet")
    got = queries()["stream_distinct"](spark, sf).first()
    assert (got.events, got.users) == (110, 4)
    want = []
    for user in range(4):
        times = sorted(r[1] for r in rows if r[2] == user)
        for before, at in zip([None, *times], times):
            if before and at - before < timedelta(hours=6):
                want[-1][1] += 1
            else:
                want.append([(user, at), 1])
    assert sorted([(r.user_id, r.start), r.n] for r in queries()["stream_sessions"](spark, sf).collect()) == sorted(want)


def test_greedy_queries_match_plain_python(spark):
    """The registered greedy queries, which have no SQL, against sequential scans."""
    import re

    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "n_chars", "source").collect())
    owned, want = set(), []
    for d in docs:
        keys = {"t:" + re.sub("[^a-z0-9]+", "", d.text[:80].lower()), f"n:{d.n_chars}:{d.source}"}
        if not owned & keys:
            owned |= keys
            want.append((d.doc_id, len(want) + 1))
    assert sorted((r.doc_id, r.ref) for r in queries()["identity_dedup_greedy"](spark, sf).collect()) == want
    pairs = sorted(((-r.severity, r.a, r.b) for r in queries()["tension_pairs"](spark, sf).collect()))
    used, top = set(), []
    for s, a, b in pairs:
        if not used & {a, b} and len(top) < 10:
            used |= {a, b}
            top.append((a, b))
    assert [(r.a, r.b) for r in sorted(queries()["tension_top_capped"](spark, sf).collect(), key=lambda r: r.tension_id)] == top


def test_settled_markers(spark, tmp_path):
    """A publication within the time to live, one after it, one before its submission, and late ones, over three triggers."""
    from weft.streaming import markers

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, markers.STATE_STORE)

    def batch(n, rows):
        frame = spark.createDataFrame(rows, "marker string, kind string, run string, ts string").selectExpr("marker", "kind", "run", "cast(ts as timestamp) ts")
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/b={n}")
        stream = spark.readStream.schema("marker string, kind string, run string, ts timestamp").parquet(f"{tmp_path}/in/*")
        rows = ledger.run_once(markers.settled(stream, 3_600_000, "1 hour"), f"{tmp_path}/out")
        return {r.run: (r.status, r.published_at and r.published_at.minute) for r in rows.collect()}

    sent, out, day = "submission", "publication", "2024-01-01 "
    try:
        got = batch(1, [("a", sent, "a1", day + "00:00:00"), ("b", sent, "b1", day + "00:00:00.5"), ("b", out, None, day + "00:30:00"), ("c", out, None, day + "00:10:00"), ("d", sent, "d1", day + "00:00:00")])
        assert got == {"b1": ("published", 30)}
        got = batch(2, [("a", out, None, day + "00:50:00"), ("c", sent, "c1", day + "00:45:00"), ("e", sent, "e1", day + "01:00:00"), ("z", sent, "z1", "2024-01-02 05:00:00")])
        # d never, e not before the watermark passed its hour; z still waits.
        want = {"a1": ("published", 50), "b1": ("published", 30), "c1": ("published", 10), "d1": ("expired", None), "e1": ("expired", None)}
        assert got == want
        assert batch(3, [("e", out, None, day + "01:10:00"), ("z", out, None, "2024-01-02 06:00:00")]) == {**want, "z1": ("published", 0)}
    finally:
        spark.conf.set(name, before)
