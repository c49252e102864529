import json

import pytest

from pyspark.sql import functions as F

from weft.functions import builders
from weft.sources import landed, sinks

PAYLOADS = {
    "europepmc": {"resultList": {"result": [{"title": "A <i>trial</i> &amp; more", "abstractText": "x", "pubYear": "2020", "doi": "https://doi.org/10.1000/ABC", "pmid": "12", "journalTitle": "bioRxiv", "source": "PPR", "id": "1"}]}},
    "openalex": {"results": [{"display_name": "T", "abstract_inverted_index": {"b": [1, 3], "a": [0], "c": [2]}, "publication_year": 2021, "doi": "10.1000/x", "id": "W1", "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/77"}}]},
    "clinicaltrials": {"studies": [{"hasResults": True, "protocolSection": {"identificationModule": {"nctId": "nct01234567", "briefTitle": "S"}, "statusModule": {"startDateStruct": {"date": "2019-05"}}}}]},
    "crossref": {"message": {"items": [{"title": ["C"], "DOI": "10.5555/Q", "issued": {"date-parts": [[2018, 3]]}, "container-title": ["J"]}]}},
    "semanticscholar": {"data": [{"title": "SS", "year": 2017, "externalIds": {"DOI": "10.1/ss", "PubMed": "5"}}]},
    "doaj": {"results": [{"id": "d", "bibjson": {"title": "D", "year": "2016", "identifier": [{"type": "eissn", "id": "1"}, {"type": "DOI", "id": "10.1234/d"}]}}]},
    "core": {"results": [{"title": "CO", "yearPublished": 2015}]},
    "chembl": {"molecules": [{"molecule_chembl_id": "CHEMBL1", "pref_name": "METFORMIN"}]},
    "facts": {"facts": [{"paper_id": "p", "title": "F", "claim": "c", "year": 2014}]},
    "fulltext": {"hits": [{"title": "FT", "text": "t"}]},
}
XML = {
    "pubmed": "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>9</PMID><Article><Journal><Title>J</Title><PubDate><Year>2013</Year></PubDate></Journal><ArticleTitle>PM</ArticleTitle><Abstract><AbstractText>one</AbstractText><AbstractText>two</AbstractText></Abstract></Article></MedlineCitation><ArticleIdList><ArticleId IdType='doi'>10.9999/pm</ArticleId></ArticleIdList></PubmedArticle></PubmedArticleSet>",
    "arxiv": '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/1</id><published>2012-01-01</published><title>AX</title><summary>s</summary><arxiv:doi>10.4444/ax</arxiv:doi></entry></feed>',
    "openaire": "<response><result><title>OA</title><dateofacceptance>2011-02-02</dateofacceptance><pid classid='doi'>10.3333/oa</pid></result></response>",
}


@pytest.fixture(scope="module")
def payloads(spark):
    rows = [(k, json.dumps(v)) for k, v in PAYLOADS.items()] + list(XML.items()) + [("biorxiv", json.dumps(PAYLOADS["europepmc"])), ("core", "not json"), ("core", ""), ("core", None)]
    return spark.createDataFrame(rows, "source string, payload string")


def test_readers(payloads):
    got = {r.source: r.asDict() for r in landed.read_all(payloads).collect()}
    assert {*got} == {*PAYLOADS, *XML, "biorxiv"}
    assert got["europepmc"]["title"] == "A trial & more" and got["europepmc"]["doi"] == "10.1000/abc" and got["europepmc"]["year"] == 2020
    assert got["openalex"]["abstract"] == "a b c b" and got["openalex"]["pmid"] == "77"
    assert got["clinicaltrials"]["nct"] == "NCT01234567" and got["clinicaltrials"]["year"] == 2019
    assert got["crossref"]["doi"] == "10.5555/q" and got["crossref"]["year"] == 2018 and got["crossref"]["venue"] == "J"
    assert got["doaj"]["doi"] == "10.1234/d"
    assert got["pubmed"]["abstract"] == "one two" and got["pubmed"]["doi"] == "10.9999/pm" and got["pubmed"]["year"] == 2013
    assert got["arxiv"]["doi"] == "10.4444/ax" and got["arxiv"]["year"] == 2012 and got["openaire"]["doi"] == "10.3333/oa"


def test_quarantine_and_registry(spark, payloads):
    assert sorted(r.reason for r in landed.quarantine(payloads).collect()) == ["empty", "empty", "not JSON or XML"]
    on = {r.name for r in landed.registry(spark, ("CORE_API_KEY",)).where("enabled").collect()}
    assert "core" in on and "facts" not in on and "chembl" not in on and len(landed.REGISTRY) == 17


def test_sections(spark):
    text = "Title\nAbstract\nshort\n1. Methods\nwe did\nmore\nRESULTS:\nit works 5%\nResults\nagain\n"
    r = spark.createDataFrame([(text,)], "t string").select(landed.split_sections(F.col("t")).alias("s")).first().s
    assert r == {"abstract": "short", "methods": "we did\nmore", "results": "it works 5%"}
    jats = "<article><body><sec><title>Methods</title><p>a</p><p>b</p></sec></body></article>"
    assert spark.createDataFrame([(jats,)], "t string").select(landed.jats_sections(F.col("t")).alias("s")).first().s == {"methods": "a b"}


def test_builders(spark):
    spec = [(["metformin", "type 2 diabetes"], ["adults"], ["Clinical Trial"], ["rat"], ["en"], 2000, None, ["aging"])]
    df = spark.createDataFrame(spec, "topic_terms array<string>, scope_terms array<string>, evidence_types array<string>, exclude_terms array<string>, languages array<string>, date_from int, date_to int, background array<string>")
    r = df.select(builders.pubmed_query().alias("p"), builders.europepmc_query().alias("e"), builders.keyword_query().alias("k"), builders.query_for(F.lit("fulltext")).alias("f"), builders.waves().alias("w")).first()
    assert r.p == '(metformin[tiab] OR "type 2 diabetes"[tiab]) AND adults[tiab] AND "Clinical Trial"[pt] AND en[lang] AND (2000[dp] : 3000[dp]) NOT rat[tiab]'
    assert r.e == '(metformin OR "type 2 diabetes") AND adults AND PUB_TYPE:Clinical Trial AND LANG:en AND PUB_YEAR:[2000 TO 3000]'
    assert r.k == '(metformin OR "type 2 diabetes") AND adults' and r.f == "metformin type 2 diabetes adults" and [w.label for w in r.w] == ["precision", "recall", "background"]
    none = df.select(builders.plan_terms(F.lit("  "), F.lit("the heart"), ["the"]).alias("a"), builders.plan_terms(F.lit("aging"), F.lit("The heart"), ["the"]).alias("b")).first()
    assert none.a is None and none.b == "aging heart"


def test_sinks(spark, tmp_path):
    news = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "k string, v int, o int")
    root = f"file://{tmp_path}/state"
    sinks.update_state(spark, root, news, ["k"], "o")
    path = sinks.update_state(spark, root, spark.createDataFrame([("b", 9, 5)], "k string, v int, o int"), ["k"], "o")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 9)}
    packs = spark.createDataFrame([("s", 1, "x")], "slug string, version int, pack_hash string")
    assert sinks.pack_version(packs, spark.createDataFrame([("s", "data"), ("t", "d")], "slug string, pack_data string")).orderBy("slug").select("version").collect() == [(2,), (1,)]
    bib = sinks.bibtex(spark.createDataFrame([("k1", "A", "T", 2020, None)], "key string, author string, title string, year int, doi string")).first().value
    assert bib.startswith("@article{k1,") and "doi = {}" in bib
    rows = sinks.forest_rows(spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 1.0)], "study string, effect double, se double")).collect()
    assert abs(sum(r.weight for r in rows) - 1) < 1e-12


def test_state_of_two_writers(spark, tmp_path, monkeypatch):
    """A writer whose state moved meanwhile puts its news into the other's version; one that never gets through says so."""
    frame = lambda *rows: spark.createDataFrame(rows, "k string, v int, o int")
    root, real = f"file://{tmp_path}/state", sinks.upsert
    sinks.update_state(spark, root, frame(("a", 1, 1)), ["k"], "o")

    def between(*args):
        monkeypatch.setattr(sinks, "upsert", real)
        sinks.update_state(spark, root, frame(("a", 2, 2), ("b", 2, 2)), ["k"], "o")
        return real(*args)

    monkeypatch.setattr(sinks, "upsert", between)
    path = sinks.update_state(spark, root, frame(("b", 3, 3)), ["k"], "o")
    assert path == sinks.current_state(spark, root) and {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 3)}
    monkeypatch.setattr(sinks, "current_state", lambda s, r, seen=iter(range(99)): None if next(seen) % 2 else path)
    with pytest.raises(RuntimeError, match="moved"):
        sinks.update_state(spark, root, frame(("c", 1, 1)), ["k"], "o", tries=2)
