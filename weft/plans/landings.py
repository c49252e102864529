"""Registered queries of sources, query builders and sinks: payloads rendered from documents, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import builders
from weft.plans.streams import folder
from weft.plans.tables import derived, derived_sql, registrar, table
from weft.sources import landed, sinks

QUERIES, SQL, query = registrar()

#: Records of a response.
PAGE = 25
_FIELDS = {
    "title": "concat('Report ', cast(doc_id as string), ' & ', coalesce(lang, 'xx'))", "abstract": "concat('About ', coalesce(source, 'none'), ' in ', cast(n_chars as string), ' characters of ', coalesce(lang, 'xx'))",
    "year": "cast(1990 + doc_id % 30 as int)", "id": "cast(doc_id as string)", "doi": "concat('10.1000/x', cast(doc_id as string))", "pmid": "cast(doc_id + 1 as string)",
    "venue": "concat(case when doc_id % 3 = 0 then 'bioRxiv' when doc_id % 3 = 1 then 'medRxiv' else 'Journal' end, ' ', coalesce(lang, 'xx'))",
}
_ROWS = derived_sql("documents", _FIELDS, "doc_id")


def records(spark, sf_dir) -> DataFrame:
    return derived(table(spark, sf_dir, "documents"), _FIELDS, "doc_id")


def _marked() -> Column:
    """Titles with mark-up and an entity, as services send them."""
    return F.concat(F.lit("<i>Report</i> "), F.col("id"), F.replace(F.substr("title", F.length(F.concat(F.lit("Report "), F.col("id"))) + 1), F.lit("&"), F.lit("&amp;")))


def _doi() -> Column:
    return F.concat(F.lit("https://doi.org/"), F.upper("doi"))


def _index() -> Column:
    words = F.split("abstract", " ")
    places = lambda w: F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == w)
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, places(w))))


def _named(**columns: Column) -> Column:
    return F.struct(*[c.alias(k.replace("__", "-")) for k, c in columns.items()])


def _europepmc() -> Column:
    return _named(title=_marked(), abstractText=F.col("abstract"), pubYear=F.col("year").cast("string"), doi=_doi(), pmid=F.col("pmid"), journalTitle=F.col("venue"), source=F.lit("MED"), id=F.col("id"))


def _tagged(name: str, value: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), value, F.lit(f"</{name}>"))


#: By source: a record of a response.
RECORDS = {
    "europepmc": _europepmc, "biorxiv": _europepmc, "medrxiv": _europepmc, "pmc_oai": _europepmc,
    "openalex": lambda: _named(display_name=_marked(), abstract_inverted_index=_index(), publication_year=F.col("year"), doi=_doi(), id=F.col("id"), ids=_named(pmid=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("pmid"))), primary_location=_named(source=_named(display_name=F.col("venue")))),
    "clinicaltrials": lambda: _named(hasResults=F.lit(True), protocolSection=_named(identificationModule=_named(nctId=F.concat(F.lit("nct"), F.lpad("id", 8, "0")), briefTitle=_marked()), descriptionModule=_named(briefSummary=F.col("abstract")), statusModule=_named(startDateStruct=_named(date=F.concat(F.col("year").cast("string"), F.lit("-05")))))),
    "crossref": lambda: _named(title=F.array(_marked()), abstract=F.col("abstract"), DOI=_doi(), URL=F.col("id"), container__title=F.array("venue"), issued=_named(date__parts=F.array(F.array("year", F.lit(5))))),
    "semanticscholar": lambda: _named(title=_marked(), abstract=F.col("abstract"), year=F.col("year"), url=F.col("id"), venue=F.col("venue"), externalIds=_named(DOI=_doi(), PubMed=F.col("pmid"))),
    "doaj": lambda: _named(id=F.col("id"), bibjson=_named(title=_marked(), abstract=F.col("abstract"), year=F.col("year").cast("string"), journal=_named(title=F.col("venue")), identifier=F.array(_named(type=F.lit("eissn"), id=F.lit("1")), _named(type=F.lit("DOI"), id=_doi())))),
    "core": lambda: _named(title=_marked(), abstract=F.col("abstract"), yearPublished=F.col("year"), doi=_doi(), downloadUrl=F.col("id"), publisher=F.col("venue")),
    "chembl": lambda: _named(molecule_chembl_id=F.col("id"), pref_name=_marked(), first_approval=F.col("year"), molecule_type=F.col("abstract")),
    "facts": lambda: _named(paper_id=F.col("id"), title=_marked(), claim=F.col("abstract"), year=F.col("year"), doi=_doi()),
    "fulltext": lambda: _named(title=_marked(), text=F.col("abstract"), year=F.col("year"), doi=_doi(), pmid=F.col("pmid")),
    # XML; the stray entity is one that no parser of XML knows.
    "pubmed": lambda: _tagged("PubmedArticle", F.concat(
        F.lit("<MedlineCitation>"), _tagged("PMID", F.col("pmid"), ' Version="1"'), F.lit("<Article><Journal>"), F.lit("<JournalIssue><PubDate>"), _tagged("Year", F.col("year").cast("string")), F.lit("</PubDate></JournalIssue>"), _tagged("Title", F.col("venue")),
        F.lit("</Journal>"), _tagged("ArticleTitle", _marked()), F.lit("<Abstract>"), _tagged("AbstractText", F.substring_index("abstract", " in ", 1)), _tagged("AbstractText", F.concat(F.lit("in "), F.substring_index("abstract", " in ", -1)), ' Label="R"'),
        F.lit("</Abstract></Article></MedlineCitation><ArticleIdList>"), _tagged("ArticleId", F.lit("PII&foo;"), ' IdType="pii"'), _tagged("ArticleId", _doi(), ' IdType="doi"'), F.lit("</ArticleIdList>"))),
    "arxiv": lambda: _tagged("entry", F.concat(_tagged("id", F.col("id")), _tagged("published", F.concat(F.col("year").cast("string"), F.lit("-01-02"))), _tagged("title", _marked()), _tagged("summary", F.col("abstract")), _tagged("arxiv:doi", _doi()))),
    "openaire": lambda: _tagged("oaf:result", F.concat(_tagged("title", _marked(), ' classid="main"'), _tagged("description", F.col("abstract")), _tagged("dateofacceptance", F.concat(F.col("year").cast("string"), F.lit("-01-02"))), _tagged("pid", F.col("id"), " classid='handle'"), _tagged("pid", _doi(), " classid='doi'"), _tagged("journal", F.col("venue")))),
}
_XML = {"pubmed": "PubmedArticleSet", "arxiv": "feed", "openaire": "response"}

_NO, _TEXT = "cast(null as varchar)", {"title": "title", "abstract": "abstract", "year": "year", "url": "id", "doi": "doi", "pmid": "pmid", "nct": "cast(null as varchar)", "venue": "venue"}
#: By source: fields that differ from a plain copy.
_ODD = {
    **{s: {"url": "'https://europepmc.org/article/MED/' || id"} for s in ("europepmc", "biorxiv", "medrxiv", "pmc_oai")},
    "clinicaltrials": {"url": "'https://clinicaltrials.gov/study/nct' || lpad(id, 8, '0')", "doi": _NO, "pmid": _NO, "venue": _NO, "nct": "'NCT' || lpad(id, 8, '0')"},
    "crossref": {"pmid": _NO}, "doaj": {"pmid": _NO, "url": "'https://doaj.org/article/' || id"}, "core": {"pmid": _NO},
    "chembl": {"url": "'https://www.ebi.ac.uk/chembl/compound_report_card/' || id", "doi": _NO, "pmid": _NO, "venue": _NO}, "facts": {"pmid": _NO, "venue": _NO}, "fulltext": {"url": _NO, "venue": _NO},
    "pubmed": {"url": _NO}, "arxiv": {"pmid": _NO, "venue": _NO}, "openaire": {"url": _NO, "pmid": _NO},
}
_ONLY = {"biorxiv": "doc_id % 3 = 0", "medrxiv": "doc_id % 3 = 1"}


def payloads(rows: DataFrame, source: str) -> DataFrame:
    """(page, payload): responses of a source, PAGE records each."""
    pages = rows.withColumn("page", F.expr(f"doc_id div {PAGE}")).withColumn("x", RECORDS[source]()).groupBy("page").agg(F.collect_list(F.struct("doc_id", "x")).alias("xs"))
    # By number; a record may hold a map, which has no order.
    in_order = F.array_sort("xs", lambda a, b: F.when(a["doc_id"] < b["doc_id"], -1).when(a["doc_id"] > b["doc_id"], 1).otherwise(0))
    items = F.transform(in_order, lambda s: s["x"])
    if source in _XML:
        body = F.concat(F.lit(f"<?xml version='1.0'?><{_XML[source]} xmlns:oaf='http://namespace.openaire.eu/oaf'>"), F.array_join(items, "\n"), F.lit(f"</{_XML[source]}>"))
        return pages.select("page", body.alias("payload"))
    out = items
    for part in reversed(landed.PATHS[source].split(".")):
        out = F.struct(out.alias(part))
    return pages.select("page", F.to_json(out).alias("payload"))


def _hits_sql(source: str) -> str:
    fields = {**_TEXT, **_ODD.get(source, {})}
    return f"select '{source}' as source, " + ", ".join(f"{e} as {k}" for k, e in fields.items()) + f" from {_ROWS}" + (f" where {_ONLY[source]}" if source in _ONLY else "")


def _source(name: str) -> None:
    @query(f"source_{name}", _hits_sql(name))
    def read(spark, sf_dir):
        return landed.read_source(payloads(records(spark, sf_dir), name), name)


for _name in landed.READERS:
    _source(_name)


def _mixed(spark, sf_dir) -> DataFrame:
    """(source, page, payload): each page as the response of one source, in turn."""
    rows, out = records(spark, sf_dir), None
    for i, name in enumerate(landed.READERS):
        own = rows.where(f"(doc_id div {PAGE}) % {len(landed.READERS)} = {i}")
        part = payloads(own, name).select(F.lit(name).alias("source"), "page", "payload")
        out = part if out is None else out.unionByName(part)
    return out


_TURNS = "case (doc_id // 25) % 16 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(landed.READERS)) + " end"


@query("sources_read_all", f"""select source, count(*) as n, count(doi) as dois, count(pmid) as pmids, count(venue) as venues, min(year) as first_year, max(title) as last_title
    from (select s.source, case when s.source in ('clinicaltrials', 'chembl') then null else doi end as doi, case when s.source in ('europepmc', 'biorxiv', 'medrxiv', 'pmc_oai', 'openalex', 'semanticscholar', 'fulltext', 'pubmed') then pmid end as pmid,
      case when s.source in ('clinicaltrials', 'chembl', 'facts', 'fulltext', 'arxiv') then null else venue end as venue, year, title from (select *, {_TURNS} as source from {_ROWS}) s where not (s.source = 'biorxiv' and doc_id % 3 <> 0) and not (s.source = 'medrxiv' and doc_id % 3 <> 1)) group by source""")
def sources_read_all(spark, sf_dir):
    """Responses of all sources in one table, read in one scan."""
    hits = landed.read_all(_mixed(spark, sf_dir))
    return hits.groupBy("source").agg(F.count("*").alias("n"), F.count("doi").alias("dois"), F.count("pmid").alias("pmids"), F.count("venue").alias("venues"), F.min("year").alias("first_year"), F.max("title").alias("last_title"))


@query("sources_quarantine", f"""select page, source, case when page % 5 = 0 then 'empty' when page % 5 = 1 and source in ('pubmed', 'arxiv', 'openaire') then 'cut off' when page % 5 = 1 then 'not JSON or XML' else 'no records' end as reason
    from (select distinct doc_id // 25 as page, {_TURNS} as source from documents) where page % 5 in (0, 1) or (page % 5 = 2 and source not in ('pubmed', 'arxiv', 'openaire'))""")
def sources_quarantine(spark, sf_dir):
    """Of five responses one is blank, one cut off and one, if JSON, an error message."""
    turn = F.col("page") % 5
    whole = F.col("payload")
    broken = F.when(turn == 0, "  ").when(turn == 1, F.substr(whole, F.lit(1), F.length(whole) - 3)).when((turn == 2) & ~F.col("source").isin(*_XML), '{"error": "busy"}').otherwise(whole)
    return landed.quarantine(_mixed(spark, sf_dir).withColumn("payload", broken)).select("page", "source", "reason")


@query("source_open_access", f"select title, doi, case when doc_id % 4 = 0 then 'https://oa.example/' || id end as oa_url from {_ROWS}")
def source_open_access(spark, sf_dir):
    rows = records(spark, sf_dir)
    found = rows.where("doc_id % 4 = 0").select(_doi().alias("doi"), F.concat(F.lit("https://oa.example/"), "id").alias("oa_url"))
    return landed.with_open_access(rows.select("title", "doi"), found).select("title", "doi", "oa_url")


_BODY = "coalesce(lang, 'xx')"


@query("source_jats_sections", f"select doc_id, 'About ' || {_BODY} || ' it was found' as methods, abstract as nested, title as tail from (select *, coalesce(lang, 'xx') as lang from (select f.*, d.lang from {_ROWS} f join documents d using (doc_id)))")
def source_jats_sections(spark, sf_dir):
    """Articles with a nested section and a title that comes twice."""
    rows = records(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("xx")).alias("lang")), "doc_id")
    sec = lambda title, *body: F.concat(F.lit("<sec id='s'>"), _tagged("title", F.lit(title)), *body, F.lit("</sec>"))
    article = F.concat(
        F.lit("<article><body>"), sec("Methods", _tagged("p", F.concat(F.lit("About "), _tagged("i", F.col("lang")))), sec("Nested", _tagged("p", F.col("abstract")))),
        sec("METHODS", _tagged("p", F.lit("it was")), _tagged("p", F.lit("found"))), sec("Tail", _tagged("p", F.replace("title", F.lit("&"), F.lit("&amp;")))), F.lit("</body></article>"),
    )
    got = rows.select("doc_id", landed.jats_sections(article).alias("s"))
    return got.select("doc_id", F.col("s.methods").alias("methods"), F.col("s.nested").alias("nested"), F.col("s.tail").alias("tail"))


@query("source_split_sections", f"select doc_id, abstract, title as methods, venue as results from {_ROWS}")
def source_split_sections(spark, sf_dir):
    rows = records(spark, sf_dir)
    text = F.concat(F.lit("Front matter\nABSTRACT\n"), "abstract", F.lit("\n2. Methods:\n"), "title", F.lit("\n  Results \n"), "venue", F.lit("\nResults\nagain"))
    got = rows.select("doc_id", landed.split_sections(text).alias("s"))
    return got.select("doc_id", F.col("s.abstract").alias("abstract"), F.col("s.methods").alias("methods"), F.col("s.results").alias("results"))


_SPEC = {
    "a": "split_part(p_name, ' ', 1)", "b": "split_part(p_name, ' ', 2)", "brand": "p_brand", "kind": "concat('Trial ', cast(p_size % 4 as string))", "low": "cast(case when p_size % 3 = 0 then 1990 + p_size else null end as int)", "high": "cast(case when p_size % 2 = 0 then 2020 else null end as int)",
}
_SPECS = derived_sql("part", _SPEC, "p_partkey", "p_type")
_QUOTED = "case when contains({0}, ' ') then '\"' || {0} || '\"' else {0} end"


def specs(spark, sf_dir) -> DataFrame:
    """Parts as retrieval specs."""
    rows = derived(table(spark, sf_dir, "part"), _SPEC, "p_partkey", "p_type")
    return rows.select("p_partkey", F.array("a", "b").alias("topic_terms"), F.array("p_type").alias("scope_terms"), F.array("kind").alias("evidence_types"), F.array("brand").alias("exclude_terms"), F.array().cast("array<string>").alias("languages"), F.col("low").alias("date_from"), F.col("high").alias("date_to"), F.array("brand").alias("background"))


@query("build_pubmed_query", f"""select p_partkey, '(' || a || '[tiab] OR ' || b || '[tiab]) AND ' || {_QUOTED.format("p_type")} || '[tiab] AND ' || {_QUOTED.format("kind")} || '[pt]' || case when low is null then '' else ' AND (' || low || '[dp] : ' || coalesce(high, 3000) || '[dp])' end
    || ' NOT ' || {_QUOTED.format("brand")} || '[tiab]' as q from {_SPECS}""")
def build_pubmed_query(spark, sf_dir):
    return specs(spark, sf_dir).select("p_partkey", builders.pubmed_query().alias("q"))


@query("build_europepmc_query", f"""select p_partkey, '(' || a || ' OR ' || b || ') AND ' || {_QUOTED.format("p_type")} || ' AND PUB_TYPE:' || kind || case when low is null then '' else ' AND PUB_YEAR:[' || low || ' TO ' || coalesce(high, 3000) || ']' end as q from {_SPECS}""")
def build_europepmc_query(spark, sf_dir):
    return specs(spark, sf_dir).select("p_partkey", builders.europepmc_query().alias("q"))


@query("build_query_for_source", f"""select p_partkey, '(' || a || ' OR ' || b || ') AND ' || {_QUOTED.format("p_type")} as keyword, a || ' ' || b || ' ' || p_type as fulltext from {_SPECS} where a <> b and lower(p_type) not in (lower(a), lower(b))""")
def build_query_for_source(spark, sf_dir):
    """The keyword and the full-text form; parts whose two words differ."""
    rows = specs(spark, sf_dir).where("topic_terms[0] <> topic_terms[1] and not exists(topic_terms, t -> lower(t) = lower(scope_terms[0]))")
    return rows.select("p_partkey", builders.query_for(F.lit("crossref")).alias("keyword"), builders.query_for(F.lit("fulltext")).alias("fulltext"))


@query("build_waves", f"""select p_partkey, label, p_type as scope, case when label = 'precision' then kind end as kind from (select *, case when label = 'background' then brand else type end as p_type from (select p_partkey, p_type as type, kind, brand, unnest(['precision', 'recall', 'background']) as label from {_SPECS}))""")
def build_waves(spark, sf_dir):
    rows = specs(spark, sf_dir).select("p_partkey", F.explode(builders.waves()).alias("w"))
    return rows.select("p_partkey", "w.label", F.get("w.scope_terms", F.lit(0)).alias("scope"), F.get("w.evidence_types", F.lit(0)).alias("kind"))


@query("build_plan_terms", "select p_partkey, trim(p_brand) || ' ' || array_to_string(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: x not in ('red', 'green', 'the', 'of')), ' ') as terms from part where len(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: x not in ('red', 'green', 'the', 'of'))) > 0")
def build_plan_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", builders.plan_terms(F.col("p_brand"), F.col("p_name"), ["red", "green", "the", "of"]).alias("terms"))
    return rows.where("trim(p_brand) <> terms").select("p_partkey", "terms")


@query("sink_bibtex", "select '@article{P' || p_partkey || ',' || chr(10) || '  author = {' || p_type || '},' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '  year = {' || cast(1990 + p_size as int) || '},' || chr(10) || '  doi = {},' || chr(10) || '}' as value from part")
def sink_bibtex(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("key"), F.col("p_type").alias("author"), F.col("p_name").alias("title"), (F.lit(1990) + F.col("p_size")).cast("int").alias("year"), F.lit(None).cast("string").alias("doi"))
    return sinks.bibtex(p)


@query("sink_forest_rows", """with e as (select cast(p_partkey as varchar) as study, cast(p_size as double) as effect, 1.0 + p_partkey % 7 as se from part), t as (select sum(1 / (se * se)) as total from e)
    select study, effect, round(effect - 1.959963984540054 * se, 6) as low, round(effect + 1.959963984540054 * se, 6) as high, round(1 / (se * se) / total, 9) as weight from e, t""")
def sink_forest_rows(spark, sf_dir):
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("study"), F.col("p_size").cast("double").alias("effect"), (F.lit(1.0) + F.col("p_partkey") % 7).alias("se"))
    return sinks.forest_rows(e).select("study", "effect", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("weight", 9).alias("weight"))


@query("sink_pack_version", """with l as (select o_custkey, max(o_orderdate) as d, count(*) as n, arg_max(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) as s from orders group by o_custkey)
    select cast(o_custkey as varchar) as slug, cast(n + 1 as bigint) as version, sha256('F') as pack_hash, 'F' as pack_data from l where s <> 'F'
    union all select cast(c_custkey as varchar), 1, sha256('F'), 'F' from customer where c_custkey not in (select o_custkey from orders)""")
def sink_pack_version(spark, sf_dir):
    """Orders as versions of their customers' packs; a new pack is written where the last one differs."""
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders")
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    packs = o.select(F.col("o_custkey").cast("string").alias("slug"), F.row_number().over(order).cast("long").alias("version"), F.sha2("o_orderstatus", 256).alias("pack_hash"))
    fresh = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("slug"), F.lit("F").alias("pack_data"))
    return sinks.pack_version(packs, fresh).select("slug", F.col("version").cast("long").alias("version"), "pack_hash", "pack_data")


@query("sink_export_manifest", """select cast(o_custkey as bigint) as customer, count(*) as files, cast(sum(floor(o_totalprice)) as bigint) as bytes, min('order-' || o_orderkey) as first_name from orders group by o_custkey""")
def sink_export_manifest(spark, sf_dir):
    """Orders as files of their customers' bundles; the manifest is read back."""
    files = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("order-"), F.col("o_orderkey")).alias("name"), F.floor("o_totalprice").cast("long").alias("bytes"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"))
    made = sinks.export_manifest(files, "o_custkey").select(F.col("o_custkey").cast("long").alias("customer"), F.from_json("manifest", "array<struct<name:string, bytes:long, sha256:string>>").alias("m"))
    return made.select("customer", F.size("m").cast("long").alias("files"), F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x["bytes"]).alias("bytes"), F.get("m", F.lit(0))["name"].alias("first_name"))


def _written(spark):
    """A folder of the shared one for what a sink writes."""
    return folder(spark).replace("/stream-", "/sink-")


@query("sink_json_written", "select c_custkey, c_name, c_acctbal from customer")
def sink_json_written(spark, sf_dir):
    """Written as JSON and read again."""
    path = _written(spark)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    sinks.write_table(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)


@query("sink_csv_written", "select s_suppkey, s_name, '\"' || s_name || '\", ' || chr(92) as odd from supplier")
def sink_csv_written(spark, sf_dir):
    """Written as CSV and read again; quotes, commas and backslashes come back."""
    path = _written(spark)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.concat(F.lit('"'), "s_name", F.lit('", \\')).alias("odd"))
    sinks.write_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True)


@query("sink_state_updated", "select o_custkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus, max(o_orderkey) as o_orderkey_then from orders group by o_custkey")
def sink_state_updated(spark, sf_dir):
    """Orders put into a state by customer, older ones first; each customer's last one stands."""
    path = _written(spark)
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("o_orderkey_then"), F.col("o_orderkey").alias("at"))
    middle = rows.agg(F.percentile_approx("at", 0.5)).first()[0]
    sinks.update_state(spark, path, rows.where(F.col("at") <= middle), ["o_custkey"], "at")
    return spark.read.parquet(sinks.update_state(spark, path, rows.where(F.col("at") > middle), ["o_custkey"], "at"))
