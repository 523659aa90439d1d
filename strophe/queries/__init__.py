"""Registered queries of the reference's operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def op(name: str, sql: str | None = None):
    """Register f(t) -> DataFrame, where t(name) reads a table of the given folder."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            t = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
            t.spark, t.dir = spark, sf_dir
            return f(t)

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def digest(v: str = "emb"):
    """Vectors as md5 of entries in thousandths: summation orders differ in the last bits."""
    return F.md5(F.array_join(F.transform(v, lambda x: F.round(x.cast("double") * 1000, 0).cast("long").cast("string")), ","))


def digest_sql(v: str) -> str:
    return f"md5(array_to_string(list_transform({v}, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000, 0) AS BIGINT) AS VARCHAR)), ','))"


def load() -> None:
    """Import the modules that register queries."""
    from strophe.queries import corpus, features, jobs, metrics, patches, quality, sequences, streams  # noqa: F401
