"""Record identity: merging hits, dedup, crosswalks and citation labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.text import alpha_suffix, missing
from weft.operators.select import cut, greedy_by_keys, greedy_by_sides


def merge_hits(hits: DataFrame) -> DataFrame:
    """One row per key of hits(key, ord, source, title, abstract, year, url).

    The longest abstract and title (the first on a tie), the first year and url that
    are not missing in order of arrival, all sources in order. All are aggregates
    with partial results map side, so a key of any size is merged without gathering.
    """
    longest = lambda c: F.max_by(missing(F.col(c)), F.struct(F.length(F.coalesce(F.col(c), F.lit(""))), -F.col("ord")))
    earliest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    return hits.groupBy("key").agg(
        longest("abstract").alias("abstract"),
        longest("title").alias("title"),
        earliest("year").alias("year"),
        earliest("url").alias("url"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min("ord").alias("ord"),
    ).withColumn("n_sources", F.size("sources"))


def accumulate_waves(hits: DataFrame, cap: int | None = None) -> DataFrame:
    """(wave, new, seen_before, total) of hits(wave, ord, key): a key counts in the wave that has it first.

    With a cap, keys after the first `cap` by arrival are not admitted.
    """
    first = hits.groupBy("key").agg(F.min_by("wave", F.struct("wave", "ord")).alias("wave"), F.min(F.struct("wave", "ord")).alias("at"))
    if cap is not None:
        first = first.orderBy("at").limit(cap)
    new = first.groupBy("wave").agg(F.count("*").alias("new"))
    seen = hits.groupBy("wave").agg(F.countDistinct("key").alias("keys"))
    rows = seen.join(new, "wave", "left").fillna({"new": 0})
    # One row a wave.
    return rows.select("wave", "new", (F.col("keys") - F.col("new")).alias("seen_before"), F.sum("new").over(W.orderBy("wave")).alias("total"))


def dedup_records(rows: DataFrame, order: str, keys: str) -> DataFrame:
    """Keeps a record unless a kept earlier one owns one of its keys; numbers them from 1.

    Numbers come from range partitions and their sizes, not from one sorted task.
    """
    return number(greedy_by_keys(rows, order, keys), order, "ref")


def number(rows: DataFrame, order: str, into: str) -> DataFrame:
    """Dense numbers from 1 in order of a column."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    before = dealt.groupBy("_part").agg(F.count("*").alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    return dealt.join(F.broadcast(before), "_part").withColumn(into, F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy(order))).drop("_part", "_before")


def dedup_receipts(rows: DataFrame) -> DataFrame:
    """Keeps one receipt of each evidence unit or bibliographic source.

    rows(ord, trial, thesis, doi, pmid, title, year, n_claims). Better identified
    receipts come first, then those with more claims, then the earlier. Two conflict
    if trial and thesis agree, or if they are the same source: no identifier differs
    and one agrees, or no year differs and the titles agree. The thesis goes on as a hash
    of what is compared of it, and is not returned: no whole text is shuffled.
    """
    rows = rows.withColumn("thesis", F.md5(_sign("thesis", 200)))
    rank = F.struct(-(missing(F.col("doi")).isNotNull().cast("int") + missing(F.col("pmid")).isNotNull().cast("int")), -F.col("n_claims"), F.col("ord"))
    # A range shuffle reads its rows twice; the texts are read once.
    ranked = number(cut(rows.withColumn("_rank", rank)), "_rank", "_n").drop("_rank")
    return greedy_by_sides(ranked, "_n", conflicts(ranked)).drop("_n", "thesis")


def _sign(c: str, n: int) -> Column:
    """The first n characters in lower case with white space collapsed."""
    return F.substring(F.regexp_replace(F.trim(F.lower(F.coalesce(F.col(c), F.lit("")))), r"\s+", " "), 1, n)


def agreeing(each: DataFrame, same: str, soft: list[str]) -> DataFrame:
    """(a, b), a < b by who: rows of each(who, same, soft...) that are equal in `same`, and in all of soft that both know.

    Which of soft a row knows is a mask. A row looks for each mask in turn, by the
    values that both then know, so that the join makes only pairs that agree, however
    many rows one title has.
    """
    mask = sum((F.col(c).isNotNull().cast("int") * (1 << i) for i, c in enumerate(soft)), F.lit(0))
    rows = each.where(F.col(same).isNotNull()).withColumn("mask", mask).withColumn("want", F.explode(F.array(*[F.lit(m) for m in range(1 << len(soft))])))
    both = F.col("mask").bitwiseAND(F.col("want"))
    shared = [F.when(both.bitwiseAND(F.lit(1 << i)) > 0, F.col(c)).alias(c) for i, c in enumerate(soft)]
    keyed = rows.select("who", "mask", "want", F.to_json(F.struct(same, *shared)).alias("k"))
    a, b = keyed.alias("a"), keyed.alias("b")
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.mask") == F.col("b.want")) & (F.col("a.want") == F.col("b.mask")) & (F.col("a.who") < F.col("b.who"))
    return a.join(b, on).select(F.col("a.who").alias("a"), F.col("b.who").alias("b"))


def conflicts(rows: DataFrame) -> DataFrame:
    """(_n, key, side) of rows(_n, trial, thesis, doi, pmid, title, year) that conflict, as greedy_by_sides() reads them.

    Under an equal doi, pmid or title, rows are told apart by which of the others they
    know. Two of one kind conflict if all that the kind knows agrees: they share a key.
    Two of unlike kinds conflict if what both know agrees: they share a key from two
    sides. So a row has a key for each kind, and no pairs are made, whatever a title is
    shared by. The thesis is a hash (see dedup_receipts).
    """
    keyed = rows.select(
        "_n",
        F.upper(F.coalesce("trial", F.lit(""))).alias("trial"),
        "thesis",
        F.lower(missing(F.col("doi"))).alias("doi"),
        F.nullif(F.ltrim(F.col("pmid"), F.lit("0")), F.lit("")).alias("pmid"),
        F.nullif(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+", ""), F.lit("")).alias("title"),
        F.col("year").cast("string").alias("year"),
    )
    digest = lambda *c: F.unhex(F.md5(F.to_json(F.struct(*c))))
    at = lambda same, soft: sum((F.col(c).isNotNull().cast("int") * (1 << i) for i, c in enumerate(soft)), F.when(F.col(same).isNotNull(), 0))
    rules = [("doi", ["pmid"]), ("pmid", ["doi"]), ("title", ["doi", "pmid", "year"])]
    # Kinds that there are: eight at most.
    there = keyed.agg(*[F.collect_set(at(same, soft)).alias(same) for same, soft in rules]).first()
    held = [F.struct(digest(F.lit("evidence").alias("by"), "trial", "thesis").alias("key"), F.lit(0).alias("side"))]
    for same, soft in rules:
        mask = at(same, soft)
        for other in there[same]:
            both = mask.bitwiseAND(F.lit(other))
            shared = [F.when(both.bitwiseAND(F.lit(1 << i)) > 0, F.col(c)).alias(c) for i, c in enumerate(soft)]
            key = digest(F.lit(same).alias("by"), F.col(same).alias("same"), F.least(mask, F.lit(other)).alias("low"), F.greatest(mask, F.lit(other)).alias("high"), *shared)
            side = F.when(mask == other, 0).when(mask < other, 1).otherwise(2)
            held.append(F.when(mask.isNotNull(), F.struct(key.alias("key"), side.alias("side"))))
    each = keyed.select("_n", F.explode(F.filter(F.array(*held), lambda h: h.isNotNull())).alias("h"))
    return each.select("_n", "h.key", "h.side")


def crosswalk(saved: DataFrame, meta: DataFrame) -> DataFrame:
    """saved(id, doi, title) with meta(meta_id, doi, title): by DOI, else by a title that is unique in meta."""
    by_doi = meta.where("doi is not null").groupBy("doi").agg(F.min("meta_id").alias("by_doi"))
    by_title = meta.where("title is not null").groupBy("title").agg(F.count("*").alias("n"), F.min("meta_id").alias("by_title")).where("n = 1").drop("n")
    return saved.join(by_doi, "doi", "left").join(by_title, "title", "left").select("id", F.coalesce("by_doi", "by_title").alias("meta_id"), F.when(F.col("by_doi").isNotNull(), "doi").when(F.col("by_title").isNotNull(), "title").alias("how"))


def alias_issues(rows: DataFrame, alias: str, identity: str) -> DataFrame:
    """Aliases bound to more than one identity."""
    return rows.groupBy(alias).agg(F.countDistinct(identity).alias("identities")).where("identities > 1")


def best_run(runs: DataFrame, topic: str, run: str, rank: list[Column]) -> DataFrame:
    """(topic, best, runs): each topic's run with the largest rank, compared left to right."""
    return runs.groupBy(topic).agg(F.max_by(run, F.struct(*rank)).alias("best"), F.count("*").alias("runs"))


def citation_labels(rows: DataFrame, author: str, year: str, source: str, order: str) -> DataFrame:
    """Adds label: author and year, with a, b, c in order of first use if distinct sources share them."""
    sources = rows.groupBy(author, year, source).agg(F.min(order).alias("_first"))
    w = W.partitionBy(author, year)
    ranked = sources.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy("_first", source)) - 1)
    text = F.concat(F.col(author), F.lit(" "), F.col(year).cast("string"), F.when(F.col("_n") > 1, alpha_suffix(F.col("_k"))).otherwise(""))
    return rows.join(ranked.select(author, year, source, text.alias("label")), [author, year, source])


def reconcile(local: DataFrame, remote: DataFrame) -> DataFrame:
    """local(id, sub_id, sha, title) matched with remote(rid, sub_id, sha, title).

    An exact submission id or content hash decides before a title; titles that occur
    more than once on either side match nothing.
    """
    once = lambda d, k: d.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    titles = once(local, "title").join(once(remote, "title"), "title", "left_semi")
    found = None
    for rank, k in enumerate(("sub_id", "sha", "title")):
        own = local.where(F.col(k).isNotNull())
        if k == "title":
            own = own.join(titles, "title", "left_semi")
        m = own.select("id", k).join(remote.select("rid", k), k).select("id", "rid", F.lit(rank).alias("rank"))
        found = m if found is None else found.union(m)
    best = found.groupBy("id").agg(F.min(F.struct("rank", "rid")).alias("m"))
    return local.select("id").join(best, "id", "left").select("id", "m.rid", F.when(F.col("m").isNull(), None).when(F.col("m.rank") == 0, "submission").when(F.col("m.rank") == 1, "hash").otherwise("title").alias("marker"))
