"""Reading the tables that queries bind to, and registering queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over the session's cores: a table of one small file is one task, however much is made of each row."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def registrar() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """(queries, SQL, decorator) of a module: the decorator takes a name and, where SQL can say it, the SQL."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(name: str, text: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[name] = f
            if text:
                sql[name] = text
            return f

        return add

    return queries, sql, query


def derived(rows: DataFrame, columns: dict[str, str], *keep: str) -> DataFrame:
    """The columns `keep` of rows and columns derived from rows by expressions that both engines read alike."""
    return rows.select(*keep, *[F.expr(e).alias(k) for k, e in columns.items()])


def derived_sql(source: str, columns: dict[str, str], *keep: str) -> str:
    return "(select " + ", ".join([*keep, *[f"{e} as {k}" for k, e in columns.items()]]) + f" from {source})"
