"""Readers of landed API payloads: rows (payload text) to one schema of hits.

Retrieval itself is somebody else's job; payloads arrive as files of JSON or XML
responses, one a row. A reader is an expression from a payload to an array of hits:
JSON is parsed with a schema that names only what is used, XML with patterns that
survive broken mark-up. A payload that cannot be read gives no hits and is listed
by quarantine().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import clean_text, missing, normalize_doi

HIT = ("source", "title", "abstract", "year", "url", "doi", "pmid", "nct", "venue")

# Connector names, whether they run by default, and the setting that holds a key.
REGISTRY = (
    ("pubmed", True, None), ("europepmc", True, None), ("openalex", True, None), ("clinicaltrials", True, None), ("biorxiv", True, None), ("medrxiv", True, None),
    ("semanticscholar", True, None), ("crossref", True, None), ("doaj", True, None), ("openaire", True, None), ("pmc_oai", True, None), ("arxiv", True, None),
    ("core", True, "CORE_API_KEY"), ("chembl", False, None), ("facts", True, "FACTS_TOKEN"), ("fulltext", True, "FULLTEXT_TOKEN"), ("unpaywall", False, "UNPAYWALL_EMAIL"),
)


def registry(spark: SparkSession, configured: tuple[str, ...] = ()) -> DataFrame:
    """(name, default_enabled, auth, enabled): enabled means by default and with its key, if it needs one."""
    rows = spark.createDataFrame(list(REGISTRY), "name string, default_enabled boolean, auth string")
    return rows.withColumn("enabled", F.col("default_enabled") & (F.col("auth").isNull() | F.col("auth").isin(*configured)))


Reader = Callable[[Column], Column]


def _hit(source: str, made: dict[str, Column]) -> Column:
    """One hit in the schema that all sources share."""
    none = F.lit(None).cast("string")
    made = {k: made.get(k, none) for k in HIT[1:]}
    made["year"] = F.try_to_number(F.regexp_extract(made["year"].cast("string"), "([0-9]{4})", 1), F.lit("9999")).cast("int")
    made["doi"] = normalize_doi(made["doi"])
    for k in ("title", "abstract", "venue"):
        made[k] = missing(clean_text(made[k]))
    return F.struct(F.lit(source).alias("source"), *[made[k].alias(k) for k in HIT[1:]])


#: Path of the array of records in a JSON response, by source.
PATHS: dict[str, str] = {}


def _json(schema: str, path: str, source: str, columns: Callable[[Callable[[str], Column]], dict[str, Column]]) -> Reader:
    PATHS[source] = path

    def read(payload: Column) -> Column:
        found = F.from_json(payload, schema)
        for part in path.split("."):
            found = found[part]

        def hit(x: Column) -> Column:
            def at(name: str) -> Column:
                out = x
                for part in name.split("."):
                    out = out[part]
                return out

            return _hit(source, columns(at))

        return F.transform(found, hit)

    return read


def inverted_abstract(index: Column) -> Column:
    """The text of a map from words to their places."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s["w"]), " ")


europepmc = _json(
    "resultList struct<result: array<struct<title:string, abstractText:string, pubYear:string, doi:string, pmid:string, pmcid:string, journalTitle:string, source:string, id:string>>>",
    "resultList.result", "europepmc",
    lambda x: {"title": x("title"), "abstract": x("abstractText"), "year": x("pubYear"), "doi": x("doi"), "pmid": x("pmid"), "venue": x("journalTitle"), "url": F.concat(F.lit("https://europepmc.org/article/"), x("source"), F.lit("/"), x("id"))},
)
openalex = _json(
    "results array<struct<display_name:string, abstract_inverted_index: map<string, array<int>>, publication_year:int, doi:string, id:string, ids: struct<pmid:string>, primary_location: struct<source: struct<display_name:string>>>>",
    "results", "openalex",
    lambda x: {"title": x("display_name"), "abstract": inverted_abstract(x("abstract_inverted_index")), "year": x("publication_year"), "doi": x("doi"), "url": x("id"), "pmid": missing(F.regexp_extract(x("ids.pmid"), "([0-9]+)$", 1)), "venue": x("primary_location.source.display_name")},
)
clinicaltrials = _json(
    "studies array<struct<hasResults:boolean, protocolSection: struct<identificationModule: struct<nctId:string, briefTitle:string>, descriptionModule: struct<briefSummary:string>, statusModule: struct<startDateStruct: struct<date:string>>>>>",
    "studies", "clinicaltrials",
    lambda x: {"title": x("protocolSection.identificationModule.briefTitle"), "abstract": x("protocolSection.descriptionModule.briefSummary"), "year": x("protocolSection.statusModule.startDateStruct.date"), "nct": F.upper(x("protocolSection.identificationModule.nctId")), "url": F.concat(F.lit("https://clinicaltrials.gov/study/"), x("protocolSection.identificationModule.nctId"))},
)
crossref = _json(
    "message struct<items: array<struct<title: array<string>, abstract:string, DOI:string, URL:string, `container-title`: array<string>, issued: struct<`date-parts`: array<array<int>>>>>>",
    "message.items", "crossref",
    lambda x: {"title": F.get(x("title"), F.lit(0)), "abstract": x("abstract"), "year": F.get(F.get(x("issued.date-parts"), F.lit(0)), F.lit(0)), "doi": x("DOI"), "url": x("URL"), "venue": F.get(x("container-title"), F.lit(0))},
)
semanticscholar = _json(
    "data array<struct<title:string, abstract:string, year:int, url:string, venue:string, externalIds: struct<DOI:string, PubMed:string>>>", "data", "semanticscholar",
    lambda x: {"title": x("title"), "abstract": x("abstract"), "year": x("year"), "url": x("url"), "venue": x("venue"), "doi": x("externalIds.DOI"), "pmid": x("externalIds.PubMed")},
)
doaj = _json(
    "results array<struct<id:string, bibjson: struct<title:string, abstract:string, year:string, journal: struct<title:string>, identifier: array<struct<type:string, id:string>>>>>", "results", "doaj",
    lambda x: {"title": x("bibjson.title"), "abstract": x("bibjson.abstract"), "year": x("bibjson.year"), "venue": x("bibjson.journal.title"), "doi": F.get(F.filter(x("bibjson.identifier"), lambda i: F.lower(i["type"]) == "doi"), F.lit(0))["id"], "url": F.concat(F.lit("https://doaj.org/article/"), x("id"))},
)
core = _json(
    "results array<struct<title:string, abstract:string, yearPublished:int, doi:string, downloadUrl:string, publisher:string>>", "results", "core",
    lambda x: {"title": x("title"), "abstract": x("abstract"), "year": x("yearPublished"), "doi": x("doi"), "url": x("downloadUrl"), "venue": x("publisher")},
)
chembl = _json(
    "molecules array<struct<molecule_chembl_id:string, pref_name:string, first_approval:int, molecule_type:string>>", "molecules", "chembl",
    lambda x: {"title": x("pref_name"), "abstract": x("molecule_type"), "year": x("first_approval"), "url": F.concat(F.lit("https://www.ebi.ac.uk/chembl/compound_report_card/"), x("molecule_chembl_id"))},
)
facts = _json(
    "facts array<struct<paper_id:string, title:string, claim:string, year:int, doi:string>>", "facts", "facts",
    lambda x: {"title": x("title"), "abstract": x("claim"), "year": x("year"), "doi": x("doi"), "url": x("paper_id")},
)
fulltext = _json(
    "hits array<struct<title:string, text:string, year:int, doi:string, pmid:string>>", "hits", "fulltext",
    lambda x: {"title": x("title"), "abstract": x("text"), "year": x("year"), "doi": x("doi"), "pmid": x("pmid")},
)




def _as(source: str, venue: str | None = None) -> Reader:
    """Europe PMC responses under another name; with a venue, only the records of it."""

    def read(payload: Column) -> Column:
        hits = europepmc(payload)
        if venue:
            hits = F.filter(hits, lambda h: F.contains(F.lower(h["venue"]), F.lit(venue)))
        return F.transform(hits, lambda h: h.withField("source", F.lit(source)))

    PATHS[source] = PATHS["europepmc"]
    return read


def _xml(element: str, source: str, **patterns: str) -> Reader:
    """Splits a response at an element; a field is what a pattern's group first matches in it.

    Patterns ask for no well-formed XML, so an unknown entity or an unclosed tag
    costs a field at most. A pattern that starts with * gives all its matches.
    """

    def read(payload: Column) -> Column:
        plain = F.regexp_replace(payload, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
        plain = F.regexp_replace(plain, r"(</?)[A-Za-z]+:", "$1")
        parts = F.regexp_extract_all(plain, F.lit(rf"(?s)<{element}[ >].*?</{element}>"), 0)

        def field(x: Column, pattern: str) -> Column:
            if pattern.startswith("*"):
                return missing(F.array_join(F.regexp_extract_all(x, F.lit("(?s)" + pattern[1:]), 1), " "))
            return missing(F.regexp_extract(x, "(?s)" + pattern, 1))

        return F.transform(parts, lambda x: _hit(source, {k: field(x, p) for k, p in patterns.items()}))

    return read


def _tag(name: str, mark: str = "") -> str:
    return rf"<{name}(?:\s[^>]*)?{mark}>(.*?)</{name}>"


pubmed = _xml(
    "PubmedArticle", "pubmed", title=_tag("ArticleTitle"), abstract="*" + _tag("AbstractText"), year="<PubDate>.*?<(?:Year|MedlineDate)>([^<]*)<", pmid=r"<PMID[^>]*>\s*([0-9]+)\s*</PMID>",
    doi=r"<ArticleId[^>]*IdType=['\"]doi['\"][^>]*>\s*(.*?)\s*</ArticleId>", venue="<Journal>.*?" + _tag("Title"),
)
arxiv = _xml("entry", "arxiv", title=_tag("title"), abstract=_tag("summary"), year=_tag("published"), url=_tag("id"), doi=_tag("doi"))
openaire = _xml("result", "openaire", title=_tag("title"), abstract=_tag("description"), year=_tag("dateofacceptance"), doi=r"<pid[^>]*classid=['\"]doi['\"][^>]*>\s*(.*?)\s*</pid>", venue=_tag("journal"))

READERS: dict[str, Reader] = {
    "pubmed": pubmed, "europepmc": europepmc, "openalex": openalex, "clinicaltrials": clinicaltrials, "biorxiv": _as("biorxiv", "biorxiv"), "medrxiv": _as("medrxiv", "medrxiv"),
    "semanticscholar": semanticscholar, "crossref": crossref, "doaj": doaj, "openaire": openaire, "pmc_oai": _as("pmc_oai"), "arxiv": arxiv, "core": core, "chembl": chembl, "facts": facts, "fulltext": fulltext,
}


def read_source(landed: DataFrame, source: str) -> DataFrame:
    """Hits of landed(payload) from one connector."""
    return landed.select(F.explode_outer(READERS[source](F.col("payload"))).alias("h")).where("h is not null").select("h.*")


def read_all(landed: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Hits of landed(source, payload) from all enabled connectors, in one schema and one scan."""
    chosen = None
    for name in enabled or READERS:
        hits = READERS[name](F.col("payload"))
        chosen = F.when(F.col("source") == name, hits) if chosen is None else chosen.when(F.col("source") == name, hits)
    return landed.select(F.explode_outer(chosen).alias("h")).where("h is not null").select("h.*")


_ROOT = r"(?s)^(?:<\?.*?\?>|<!--.*?-->|<![^>]*>|\s)*<([A-Za-z_][\w:.-]*)"


def quarantine(landed: DataFrame) -> DataFrame:
    """landed(source, payload) rows that cannot be read, with a reason.

    empty; not JSON or XML; cut off, for XML that does not end with its root; no
    records, for JSON without its source's array. An empty array is no fault.
    """
    text = F.btrim(F.col("payload"), F.lit(" \t\r\n"))
    root = F.regexp_extract(text, _ROOT, 1)
    xml = F.startswith(text, F.lit("<"))
    lacks = None
    for name, path in PATHS.items():
        none = F.get_json_object("payload", f"$.{path}").isNull()
        lacks = F.when(F.col("source") == name, none) if lacks is None else lacks.when(F.col("source") == name, none)
    bad = (
        F.when(F.col("payload").isNull() | (text == ""), "empty").when(~xml & F.try_parse_json("payload").isNull(), "not JSON or XML").when(xml & (root == ""), "not JSON or XML")
        .when(xml & ~F.endswith(text, F.concat(F.lit("</"), root, F.lit(">"))) & ~F.endswith(text, F.lit("/>")), "cut off").when(~xml & lacks, "no records")
    )
    return landed.withColumn("reason", bad).where("reason is not null")


def with_open_access(hits: DataFrame, locations: DataFrame) -> DataFrame:
    """Left join with oa(doi, oa_url), the first url of each DOI."""
    own = locations.select(normalize_doi(F.col("doi")).alias("doi"), "oa_url").where("doi is not null").groupBy("doi").agg(F.min("oa_url").alias("oa_url"))
    return hits.join(own, "doi", "left")


SECTIONS = ("abstract", "introduction", "methods", "results", "discussion", "limitations", "conclusion", "references")


def split_sections(text: Column) -> Column:
    """Map from canonical section to its text, by headings on lines of their own."""
    names = "|".join(SECTIONS)
    marked = F.regexp_replace(text, rf"(?im)^[ \t]*(?:[0-9]+\.?[ \t]*)?({names})s?[ \t]*:?[ \t]*$", "\x01$1\x02")
    parts = F.filter(F.split(marked, "\x01"), lambda p: F.contains(p, F.lit("\x02")))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.split_part(p, F.lit("\x02"), F.lit(1))).alias("k"), F.btrim(F.split_part(p, F.lit("\x02"), F.lit(2)), F.lit(" \t\r\n")).alias("v")))
    # The first of sections that repeat.
    firsts = F.array_distinct(F.transform(pairs, lambda s: s["k"]))
    return F.map_from_entries(F.transform(firsts, lambda k: F.struct(k, F.get(F.filter(pairs, lambda s: s["k"] == k), F.lit(0))["v"])))


def jats_sections(payload: Column) -> Column:
    """Map from section title, in lower case, to text of a JATS article.

    A section's paragraphs are those up to the next section, nested or not, which has
    an entry of its own; sections of one title are joined in order.
    """
    inner = lambda x, tag: F.regexp_extract_all(x, F.lit("(?s)" + _tag(tag)), 1)
    parts = F.slice(F.split(F.coalesce(payload, F.lit("")), "<sec(?=[ >])"), 2, 1 << 30)
    pairs = F.transform(parts, lambda x: F.struct(F.lower(clean_text(F.coalesce(F.get(inner(x, "title"), F.lit(0)), F.lit("")))).alias("k"), F.array_join(F.transform(inner(x, "p"), lambda t: clean_text(t)), " ").alias("v")))
    titles = F.array_distinct(F.transform(pairs, lambda s: s["k"]))
    joined = lambda k: F.array_join(F.transform(F.filter(pairs, lambda s: (s["k"] == k) & (s["v"] != "")), lambda s: s["v"]), " ")
    return F.map_from_entries(F.transform(titles, lambda k: F.struct(k, joined(k))))
