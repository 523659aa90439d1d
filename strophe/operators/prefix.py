"""Global ranks and running sums without a single-partition sort.

A window ordered over the whole table would meet in one task. Rows get a bucket that rises with the order key, and 4,096
neighbouring buckets or fewer make a group. Sums run inside a bucket, over the buckets of a group, and over the groups (a bounded
table, broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.hashing import hash_key

#: Hex digits of a bucket, and of its group: a million buckets, of 100 MB each at 100 TB; 4,096 groups at most, the only rows
#: that meet in one partition.
DIGITS, GROUP = 5, 3


def running_sum(df: DataFrame, order: list[str], value: Column, out: str, bucket: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """df with ``out``: the sum of value over all rows before this one. ``order[0]`` is a hex key unless a bucket is given, a whole
    number below 16**5 that rises with ``order``; ties are broken by the further columns; null keys come first. Rows are shuffled once, by bucket. With ``by``, columns of a few
    values none of which is null, such as a split, each of their values has sums of its own."""
    if bucket is None:
        b, group = F.substring(order[0], 1, DIGITS), F.substring("__b", 1, GROUP)
    else:
        b, group = bucket, F.expr(f"__b div {16 ** (DIGITS - GROUP)}")
    rows = df.withColumn("__v", value.cast("long")).withColumn("__b", F.coalesce(b, F.lit("" if bucket is None else -1)))
    totals = rows.groupBy(*by, "__b").agg(F.sum("__v").alias("__t")).withColumn("__g", group)
    groups = totals.groupBy(*by, "__g").agg(F.sum("__t").alias("__gt"))
    ahead = groups.select(*by, "__g", (F.sum("__gt").over(Window.partitionBy(*by).orderBy("__g")) - F.col("__gt")).alias("__ahead"))
    within = F.sum("__t").over(Window.partitionBy(*by, "__g").orderBy("__b")) - F.col("__t")
    before = totals.withColumn("__within", within).join(F.broadcast(ahead), [*by, "__g"]).select(*by, "__b", (F.col("__ahead") + F.col("__within")).alias("__before"))
    own = F.sum("__v").over(Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__v")
    # by merge: both sides are dealt out by bucket already
    return rows.withColumn(out, own).join(before.hint("merge"), [*by, "__b"]).withColumn(out, F.col("__before") + F.col(out)).drop("__v", "__b", "__before")


def quantile_splits(df: DataFrame, column: str, most: int = 2048, least_rows: int = 1000, k: int = 32_768) -> list[float]:
    """Numbers that part the rows by a number column in ranges of about equal size: at most ``most``, of some ``least_rows`` rows or
    more. They are quantiles of a KLL sketch, made of partial sketches for 64 groups of partitions, so that no task merges those of all;
    its rank error, of some 0.014 % for this k, keeps a range of distinct numbers under twice the mean, wherever the numbers lie."""
    whole = F.col(column).cast("bigint")
    parts = df.where(whole.isNotNull()).select(whole.alias("x"), (F.spark_partition_id() % 64).alias("g")).groupBy("g").agg(F.kll_sketch_agg_bigint("x", k).alias("s"))
    made = parts.agg(F.kll_merge_agg_bigint("s", k).alias("s")).select("s", F.kll_sketch_get_n_bigint("s").alias("n")).first()  # under 1 MB
    buckets = min(most, -(-made["n"] // least_rows)) if made["s"] is not None else 0
    if buckets < 2:
        return []
    ranks = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    found = df.sparkSession.range(1).select(F.kll_sketch_get_quantile_bigint(F.lit(made["s"]), ranks).alias("q")).first()["q"]
    return sorted({float(q) for q in found})


def number_bucketed(df: DataFrame, column: str, out: str, splits: list[float] | None = None) -> DataFrame:
    """df with out, a bucket that rises with a whole-number column: the number of splits at or below it; -1 for null. Equal numbers
    share a bucket, so an order whose first column has a very common number is for ``ranged_positional``."""
    from pyspark.ml.feature import Bucketizer

    splits = quantile_splits(df, column) if splits is None else splits
    if not splits:
        return df.withColumn(out, F.when(F.col(column).isNull(), -1).otherwise(0))
    # a binary search on the JVM; a double rises with the whole number that it is made of
    cut = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="__x", outputCol="__y")
    found = cut.transform(df.withColumn("__x", F.coalesce(F.col(column).cast("double"), F.lit(0.0))))
    return found.withColumn(out, F.when(F.col(column).isNull(), -1).otherwise(F.col("__y").cast("int"))).drop("__x", "__y")


def numbered_sum(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """running_sum in an order whose first column is a whole number, whatever numbers it has."""
    return running_sum(number_bucketed(df, order[0], "__at"), order, value, out, F.col("__at")).drop("__at")


def seeded_rank(df: DataFrame, seed, key: str, out: str = "rank") -> DataFrame:
    """0-based rank in the order of md5(seed:key), ties by key."""
    keyed = df.withColumn("__h", hash_key(seed, F.col(key)))
    return running_sum(keyed, ["__h", key], F.lit(1), out).drop("__h")
