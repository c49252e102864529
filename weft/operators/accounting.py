"""Counts that prose states against counts that were saved, and terms brought to their canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.terms import find_terms, is_word

ROSTER, NOTE = "Outcome-class roster:", "Direction heterogeneity note:"
#: `Outcome n=3 (direction: positive=2; null=1; directness: direct=3; sources: ...)`.
ENTRY = r"([A-Za-z][A-Za-z0-9 _/-]*?) n=(\d+) \(([^()]*)\)"
PAIR = r"([a-z_]+)=(\d+)"


def stated_counts(papers: DataFrame) -> DataFrame:
    """(id, outcome, field, label, n) that the roster of papers(id, text) states: `n` of each outcome, and its directions and directness by label."""
    line = F.regexp_extract("text", rf"(?m){ROSTER}\s*(.*)$", 1)
    entries = papers.select("id", F.explode(F.regexp_extract_all(line, F.lit(ENTRY), F.lit(0))).alias("e"))
    rows = entries.select("id", F.trim(F.regexp_extract("e", ENTRY, 1)).alias("outcome"), F.regexp_extract("e", ENTRY, 2).cast("long").alias("n"), F.regexp_extract("e", ENTRY, 3).alias("inside"))

    def part(name: str) -> Column:
        """Label=number pairs behind a name and before the next one."""
        return F.regexp_extract_all(F.regexp_extract("inside", rf"{name}: ((?:[a-z_]+=\d+(?:; )?)*)", 1), F.lit(PAIR), F.lit(0))

    pair = lambda field: F.transform(part(field), lambda p: F.struct(F.lit(field).alias("field"), F.split(p, "=")[0].alias("label"), F.split(p, "=")[1].cast("long").alias("n")))
    own = F.array(F.struct(F.lit("n").alias("field"), F.lit("").alias("label"), F.col("n")))
    return rows.select("id", "outcome", F.inline(F.concat(own, pair("direction"), pair("directness"))))


def saved_counts(receipts: DataFrame) -> DataFrame:
    """The same counts of receipts(id, outcome, direction, directness)."""
    of = lambda field, label: F.struct(F.lit(field).alias("field"), label.alias("label"))
    fields = F.array(of("n", F.lit("")), of("direction", F.col("direction")), of("directness", F.col("directness")))
    return receipts.select("id", "outcome", F.explode(fields).alias("f")).groupBy("id", "outcome", "f.field", "f.label").agg(F.count("*").alias("n"))


def accounting_mismatches(papers: DataFrame, receipts: DataFrame) -> DataFrame:
    """(id, outcome, field, label, stated, saved, kind): counts of a roster that differ from the saved ones, as extra, lost or unequal.

    Papers without a roster, and those without receipts, are not checked.
    """
    checked = papers.where(F.contains("text", F.lit(ROSTER))).join(receipts.select("id").distinct(), "id", "left_semi")
    key = ["id", "outcome", "field", "label"]
    said = stated_counts(checked).withColumnRenamed("n", "stated")
    kept = saved_counts(receipts.join(checked.select("id"), "id", "left_semi")).withColumnRenamed("n", "saved")
    both = said.join(kept, key, "full")
    kind = F.when(F.col("saved").isNull(), "extra").when(F.col("stated").isNull(), "lost").when(F.col("stated") != F.col("saved"), "unequal")
    return both.withColumn("kind", kind).where("kind is not null")


def short_forms(receipt_id: Column) -> Column:
    """Names that prose may give an accepted source `Author_Year_ACRONYM_...`: author and year, the author, each capital word behind the year, and all of them joined by a hyphen, an underscore or a space."""
    parts = F.split(receipt_id, "_")
    dated = (F.size(parts) >= 2) & F.get(parts, F.lit(1)).rlike(r"^\d+$")
    author = F.when(dated, F.array(F.concat_ws(" ", parts[0], F.get(parts, F.lit(1))), parts[0])).otherwise(F.array().cast("array<string>"))
    tail = F.slice(parts, F.lit(3), F.greatest(F.size(parts), F.lit(1)))
    loud = lambda t: t.rlike(r"^[^a-z]*[A-Z][^a-z]*$") & (F.length(t) >= 2)
    first_quiet = F.coalesce(F.nullif(F.array_position(F.transform(tail, loud), F.lit(False)), F.lit(0).cast("long")), F.size(tail).cast("long") + 1)
    caps = F.slice(tail, F.lit(1), (first_quiet - 1).cast("int"))
    joined = F.when(F.size(caps) >= 2, F.array(*[F.array_join(caps, s) for s in "-_ "])).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(author, caps, joined))


CLAUSE_BREAK = r",\s+(?=[A-Z][a-z]|and\b|but\b|while\b|although\b|whereas\b|however\b)"


def accepted_called_rejected(papers: DataFrame, receipts: DataFrame, gate: str) -> DataFrame:
    """(id, at, form): clauses of papers(id, text) that call a source of receipts(id, receipt_id) rejected, by a short form of its name; one row a clause.

    `gate` is the name of the gate in phrases such as "rejected by <gate>". A clause ends with its sentence, or at a comma before a new subject.
    """
    marker = rf"(?i)(?:was\s+rejected\b|rejected\s+by\s+{gate}|{gate}-quarantined|did\s+not\s+pass\s+{gate}|quarantined\s+by\s+{gate})"
    clauses = papers.select("id", F.posexplode(F.split("text", rf"(?<=[.!?])\s+(?=[A-Z])|\n\n+|\n(?=#)|{CLAUSE_BREAK}")).alias("at", "clause")).where(F.col("clause").rlike(marker))
    forms = receipts.where(F.coalesce(F.trim("receipt_id"), F.lit("")) != "").select("id", F.explode(short_forms(F.trim("receipt_id"))).alias("form")).where("form <> ''").distinct()
    hits = find_terms(clauses.withColumnRenamed("at", "place"), ["id", "place"], "clause", forms, "form")
    whole = hits.where(~F.col("before").rlike(r"\w") & ~F.col("behind").rlike(r"\w")).select("id", "place", F.col("term").alias("form")).distinct()
    return whole.join(forms, ["id", "form"], "left_semi").groupBy("id", F.col("place").alias("at")).agg(F.min("form").alias("form"))


def unnamed_receipts(receipts: DataFrame) -> DataFrame:
    """(id, n): receipts without an id, where there are some."""
    return receipts.groupBy("id").agg(F.count_if(F.coalesce(F.trim("receipt_id"), F.lit("")) == "").alias("n")).where("n > 0")


def normalised_terms(texts: DataFrame, canonical: DataFrame) -> DataFrame:
    """(id, text, terms) of texts(id, text) and canonical(term, name): lower-cased texts in which terms, as words, are put by their names, and the names in order.

    Of terms that overlap the one that begins first counts, of those the longest.
    """
    low = texts.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    own = canonical.select(F.lower(F.trim("term")).alias("term"), "name").where(F.length("term") > 0).groupBy("term").agg(F.min("name").alias("name"))
    hits = find_terms(low, ["id"], "text", own, "term").where(is_word()).join(own, "term")
    place = F.struct("at", (-F.length("term")).alias("shorter"), (F.col("at") + F.length("term")).alias("end"), "name")
    lists = hits.groupBy("id").agg(F.array_sort(F.collect_list(place)).alias("p"))
    begin = F.struct(F.lit(0).cast("long").alias("end"), F.slice(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("end"), F.lit("").alias("name"))), 1, 0).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        one = F.struct(x["at"].alias("at"), x["end"].alias("end"), x["name"].alias("name"))
        fits = x["at"] >= s["end"]
        return F.struct(F.when(fits, x["end"]).otherwise(s["end"]).alias("end"), F.when(fits, F.array_append(s["kept"], one)).otherwise(s["kept"]).alias("kept"))

    chosen = lists.select("id", F.aggregate("p", begin, step, lambda s: s["kept"]).alias("kept"))
    rows = low.join(chosen, "id", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<struct<at:bigint,end:bigint,name:string>>")))
    piece = lambda x, i: F.concat(F.substr("text", (F.coalesce(F.get("kept", i - 1)["end"], F.lit(0)) + 1).cast("int"), (x["at"] - F.coalesce(F.get("kept", i - 1)["end"], F.lit(0))).cast("int")), x["name"])
    last = F.coalesce(F.get("kept", F.size("kept") - 1)["end"], F.lit(0))
    tail = F.substr("text", (last + 1).cast("int"), F.length("text"))
    return rows.select("id", F.concat(F.array_join(F.transform("kept", piece), ""), tail).alias("text"), F.col("kept.name").alias("terms"))


def plain_terms(text: Column, most: int = 200) -> Column:
    """The different words of four characters or more that begin with a letter, in order, `most` of them at most."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z][A-Za-z0-9-]{3,}\b"), F.lit(0)))), 1, most)
