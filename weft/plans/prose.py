"""Queries of term searches, isolation and misread numbers. Texts are put together from fragments that say what the rules make of them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from weft.operators import isolation, misreads, terms
from weft.plans.outcomes import _values
from weft.plans.studies import _cases
from weft.plans.tables import derived, derived_sql, registrar, table

QUERIES, SQL, query = registrar()


@query("topic_mentions", r"""
    with a as (select n_regionkey as topic, lower(trim(n_name)) as alias from nation where n_regionkey < 4),
    r as (select o_orderkey as id, o_custkey % 5 as topic, lower('Trade in ' || n_name || case when o_orderkey % 3 = 0 then 'n goods' else ', goods' end) as text from orders join nation on n_nationkey = o_orderkey % 25)
    select id, topic, topic = 4 or exists (select 1 from a where a.topic = r.topic and length(alias) >= 3 and regexp_matches(r.text, '(^|[^a-z0-9])' || alias || '($|[^a-z0-9])')) as mentions from r""")
def topic_mentions(spark, sf_dir):
    """Nations are aliases of their regions; the last region has none."""
    n = table(spark, sf_dir, "nation")
    names = n.select((F.col("n_nationkey")).alias("k"), "n_name")
    text = F.concat(F.lit("Trade in "), "n_name", F.when(F.col("o_orderkey") % 3 == 0, "n goods").otherwise(", goods"))
    r = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 25).join(names, "k").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("topic"), text.alias("text"))
    return terms.topic_mentions(r, n.where("n_regionkey < 4").select(F.col("n_regionkey").cast("long").alias("topic"), F.col("n_name").alias("alias")))


ARM = {"topic": "l_suppkey % 4", "arm": _cases("l_orderkey", ["Low-dose Agent A", "agent", "Placebo ", "sham device", "", "vehicle control", "agent b", "Exercise", "pool"])}


@query("arm_belongs", f"""
    with own(topic, term) as (values (0, 'agent a'), (0, 'agent alpha'), (1, 'exercise training'), (2, 'agent b')), every as (select * from own union select distinct topic, unnest(['placebo', 'control', 'vehicle', 'pooled']) from own),
    c as (select *, lower(trim(arm)) as said from {derived_sql('lineitem', ARM, 'l_orderkey', 'l_linenumber')})
    select l_orderkey * 10 + l_linenumber as id, topic, topic = 3 or said = '' or exists (select 1 from every e where e.topic = c.topic and (contains(said, term) or contains(term, said))) as belongs from c""")
def arm_belongs(spark, sf_dir):
    c = derived(table(spark, sf_dir, "lineitem"), ARM, "l_orderkey", "l_linenumber").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "topic", "arm")
    arms = spark.createDataFrame([(0, "Agent A"), (0, "agent alpha"), (1, "exercise training"), (2, "agent b "), (2, "")], "topic long, arm string")
    return terms.arm_belongs(c, arms)


#: (title, abstract, target, aliases, whether the comparison leaves the target unisolated); the abstract's sentences are long enough to be a study's own.
TRIALS = [
    ("Agent in adults", "All participants received agent during the trial.", "agent", [], True),
    ("Agent in adults", "Adults were randomized to agent or placebo for 12 weeks.", "agent", [], False),
    ("Agent in adults", "Adults were randomized to walking or stretching for weeks; agent was open to all.", "agent", [], True),
    ("Agent in adults", "Agent was taken by some; adults were randomized to 10 mg or 20 mg for weeks.", "agent", [], False),
    ("Agent in adults", "Adults were randomized to agent plus walking or agent plus rest for 12 weeks.", "agent", [], True),
    ("Training in adults", "We randomized adults to diet advice while also undergoing resistance training daily.", "resistance training", [], True),
    ("Training in adults", "Adults in the resistance arm improved most; trials comparing the resistance arm and rest were run.", "resistance training", [], False),
    ("Agent in adults", "The effects of walking compared with rest on agent levels were seen in adults.", "agent", [], True),
    ("Agent in adults", "Previous studies randomized adults to walking or rest beside agent.", "agent", [], False),
    ("A combination of agent and zinc", "Two groups were compared. The control group maintained usual care at home.", "agent", [], True),
    ("A combination of agent and zinc", "Two groups were compared in a factorial plan. The control group maintained usual care at home.", "agent", [], False),
    ("A combination of agent and zinc", "Two groups were compared. The control group maintained usual care at home.", "agent and zinc", [], False),
    ("Sirolimus in adults", "Adults were randomly assigned to rapamycin or placebo for a year.", "sirolimus", ["Rapa-mycin", "rapamycin"], False),
    ("Metformin in adults", "Metformin hydrochloride (met) was used; adults were randomized to met or rest.", "metformin hydrochloride", [], False),
    ("Notes", "Nothing was compared in this short report.", "", [], False),
    ("Agent in adults", "Rats were divided into groups: walking or placebo, and agent was in the feed.", "agent", [], False),
]


@query("unisolated_combination", f"with t(k, unisolated) as (values {_values([(i, t[-1]) for i, t in enumerate(TRIALS)])}) select o_orderkey, unisolated from orders join t on k = o_orderkey % {len(TRIALS)}")
def unisolated_combination(spark, sf_dir):
    one = [F.struct(F.lit(t).alias("title"), F.lit(a).alias("abstract"), F.lit(g).alias("target"), F.array(*map(F.lit, al)).cast("array<string>").alias("aliases")) for t, a, g, al, _ in TRIALS]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*one), (F.col("o_orderkey") % len(TRIALS)).cast("int")).alias("t")).select("o_orderkey", "t.*")
    return isolation.unisolated(rows).select("o_orderkey", "unisolated")


REGISTRY = [("0.8 m/s", "Studenski 2011"), ("5%", "Lee 2019"), ("30 kg/m2", "Obesity Panel 1998"), ("7%", "Lee 2019")]
SUPPORTED = [("Witham 2025", "0.8 m/s"), ("Witham 2025", "3%"), ("Moe 2020", "7%")]
#: (sentence, (numeric, citation) that it leaves without a source).
BACKGROUND = [
    ("Walking below 0.8 m/s is slow (Studenski 2011).", []), ("Walking below 0.8 m/s is slow.", [("0.8 m/s", "Studenski 2011")]), ("Walking at 0.8 m/s was seen by Witham 2025.", []), ("A loss of 5% or 7% matters.", [("5%", "Lee 2019"), ("7%", "Lee 2019")]),
    ("The interval was 95% wide.", []), ("The value 1.5% was small.", []), ("A loss of 7% matters, as Moe 2020 and others say.", []), ("A body of 30 kg/m2 is heavy, 5% more so (Lee 2019).", [("30 kg/m2", "Obesity Panel 1998")]), ("No number here.", []),
]
_B = len(BACKGROUND)
_HEADER = "| Row | 5% |\n| Other. Row | 0.8 m/s |\n\n"
_END = "\n\n## References\nWalking at 0.8 m/s and 5%."


def _doc(spark, sf_dir, parts, n):
    """Orders as manuscripts of two sentences: the parts at o_orderkey and o_custkey."""
    at = lambda c: F.get(F.array(*map(F.lit, parts)), (F.col(c) % n).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), at("o_orderkey").alias("a"), at("o_custkey").alias("b"))


@query("background_unsourced", f"""
    with f(k, numeric, citation, snippet) as (values {_values([(i, *u, s) for i, (s, us) in enumerate(BACKGROUND) for u in us])}),
    d as (select o_orderkey as id, 0 as sentence_at, o_orderkey % {_B} as k from orders union all select o_orderkey, 1, o_custkey % {_B} from orders)
    select id, sentence_at, numeric, citation, snippet from d join f using (k)""")
def background_unsourced(spark, sf_dir):
    papers = _doc(spark, sf_dir, [s for s, _ in BACKGROUND], _B).select("id", F.concat(F.lit(_HEADER), "a", F.lit("\n"), "b", F.lit(_END)).alias("text"))
    return misreads.unsourced_background(papers, spark.createDataFrame(REGISTRY, "numeric string, citation string"), spark.createDataFrame(SUPPORTED, "citation string, numeric string"))


@query("background_far", f"""
    with f(k, numeric, citation, snippet, place, size) as (values {_values([(i, n, c, s, s.index(n), len(s)) for i, (s, _) in enumerate(BACKGROUND) for n, c in REGISTRY if n in s and not s[s.index(n) - 1].isdigit() and s[s.index(n) - 1] != '.'])}),
    b(k, numeric) as (values {_values([(i, n) for i, (s, _) in enumerate(BACKGROUND) for c, n in SUPPORTED if c in s])}),
    c(k, citation, place) as (values {_values([(i, c, s.index(c)) for i, (s, _) in enumerate(BACKGROUND) for c in dict.fromkeys(c for _, c in REGISTRY) if c in s])}),
    size(k, n) as (values {_values([(i, len(s)) for i, (s, _) in enumerate(BACKGROUND)])}),
    d as (select o_orderkey as id, 0 as at, o_orderkey % {_B} as k, 0 as begin from orders union all select o_orderkey, 1, o_custkey % {_B}, n + 1 from orders join size on size.k = o_orderkey % {_B}),
    cited as (select id, citation, begin + place as pos from d join c using (k))
    select id, d.at as sentence_at, numeric, citation, snippet from d join f using (k)
    where not exists (select 1 from cited where cited.id = d.id and cited.citation = f.citation and abs(cited.pos - d.begin - f.place) <= 45) and not exists (select 1 from b where b.k = d.k and b.numeric = f.numeric)""")
def background_far(spark, sf_dir):
    """A citation within 45 characters will do."""
    papers = _doc(spark, sf_dir, [s for s, _ in BACKGROUND], _B).select("id", F.concat("a", F.lit(" "), "b", F.lit(_END)).alias("text"))
    return misreads.unsourced_background(papers, spark.createDataFrame(REGISTRY, "numeric string, citation string"), spark.createDataFrame(SUPPORTED, "citation string, numeric string"), 45)


CLAIMS = [("0.13 m/s", "An improvement of 0.13 m/s was seen", "high"), ("0.13 m/s", "The difference was 0.13 m/s", "high"), ("2 kg", "Weight had a decrease of 2 kg", "high"), ("9 mg", "A dose of 9 mg was given", "high"), ("4 kg", "A gain of 4 kg", "partial"), (" ", "change", "high")]
#: (paragraph, numbers misread in a sentence, number misread in the paragraph, places of sentences that refer back).
MISREADS = [
    ("Gait speed was 0.13 m/s, a value of little use.", ["0.13 m/s"], None, []),
    ("An improvement of 0.13 m/s indicates benefit.", [], None, []),
    ("No change in class was seen, and in the groups at the end walking at 0.13 m/s fell below the 0.8 m/s mark.", ["0.13 m/s"], "0.13 m/s", []),
    ("A level of 2 kg was seen.", ["2 kg"], None, []),
    ("A level of 9 mg and 4 kg was seen.", [], None, []),
    ("Walking showed a change of 0.13 m/s. This walk speed value is below the 0.8 m/s threshold.", [], None, [1]),
    ("Walking showed a difference of 0.13 m/s. It held. This walk speed value is below the 0.8 m/s cutoff.", [], None, [2]),
    ("Walking showed an increase of 0.2 m/s. This walking speed value misses the threshold.", [], None, [1]),
    ("At 0.13 m/s the rest is unclear here, since most walked as they had before. Speeds of 0.6 m/s remained below all.", [], "0.13 m/s", []),
    ("This walk speed value is below the 0.8 m/s threshold. Walking showed a gain of 0.13 m/s.", [], None, []),
    ("| 0.13 m/s | value of |\n| x | y |", ["0.13 m/s"], None, []),
    ("## Limitations\nAt 0.13 m/s the rest is unclear here, as most walked so. Speeds of 0.6 m/s remained below all.", [], None, []),
    ("Plain words only.", [], None, []),
]
_M = len(MISREADS)


def manuscripts(spark, sf_dir):
    """Two paragraphs a manuscript."""
    return _doc(spark, sf_dir, [p for p, *_ in MISREADS], _M).select("id", F.concat("a", F.lit("\n\n"), "b").alias("text"))


def values(spark):
    return misreads.change_values(spark.createDataFrame(CLAIMS, "raw string, sentence string, confidence string"))


def _n_sentences(p: str) -> int:
    return len(re.split(r"(?<=[.!?])\s+(?=[A-Z])", p))


_PARTS = f"""sizes(k, n) as (values {_values([(i, _n_sentences(p)) for i, (p, *_) in enumerate(MISREADS)])}),
    d as (select o_orderkey as id, 0 as para, o_orderkey % {_M} as k, 0 as base from orders union all select o_orderkey, 1, o_custkey % {_M}, n from orders join sizes on sizes.k = o_orderkey % {_M})"""


def _sentence_places() -> list[tuple]:
    rows = []
    for i, (p, bad, _, _) in enumerate(MISREADS):
        for at, s in enumerate(re.split(r"(?<=[.!?])\s+(?=[A-Z])", p)):
            rows += [(i, at, n) for n in bad if n in s]
    return rows


@query("change_misreads", f"with {_PARTS}, f(k, place, numeric) as (values {_values(_sentence_places())}) select id, base + place as at, numeric from d join f using (k)")
def change_misreads(spark, sf_dir):
    return misreads.change_misreads(manuscripts(spark, sf_dir), values(spark))


_TWO = f"d as (select o_orderkey as id, 0 as para, o_orderkey % {_M} as k from orders union all select o_orderkey, 1, o_custkey % {_M} from orders)"


@query("paragraph_misreads", f"with {_TWO}, f(k, numeric) as (values {_values([(i, n) for i, (_, _, n, _) in enumerate(MISREADS) if n])}) select id, para, numeric from d join f using (k)")
def paragraph_misreads(spark, sf_dir):
    return misreads.paragraph_misreads(manuscripts(spark, sf_dir), values(spark))


@query("anaphor_misreads", f"with {_TWO}, f(k, place) as (values {_values([(i, n) for i, (*_, ns) in enumerate(MISREADS) for n in ns])}) select id, para, place as at from d join f using (k)")
def anaphor_misreads(spark, sf_dir):
    return misreads.anaphor_misreads(manuscripts(spark, sf_dir), values(spark))
