"""Packing of token arrays into fixed windows, and samples from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.arrays import PAD, loss_mask, pad_to, padded_windows, shift_left
from strophe.functions.hashing import hash_key
from strophe.operators.prefix import number_bucketed, quantile_splits, running_sum


def pack_separate(rows: DataFrame, n: int, key: str = "id") -> DataFrame:
    """(key, window, seq): each record alone, in windows of n, the last one padded. No shuffle; works on a stream as well."""
    return rows.select(*[c for c in rows.columns if c != "seq"], F.posexplode(padded_windows(F.col("seq"), n)).alias("window", "seq"))


def token_offsets(rows: DataFrame, seed, key: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """rows(key, seq) with offset: the tokens of all records before it in the order of md5(seed:key), or of those of the same ``by``."""
    keyed = rows.withColumn("order_key", hash_key(seed, F.col(key)))
    return running_sum(keyed, ["order_key", key], F.size("seq"), "offset", by=by)


def pack_concatenated(rows: DataFrame, n: int, seed, key: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, seq_id, seq): for each value of ``by``, such as a split, all records' tokens in the seeded order, cut into windows of n; only the last is padded. A record makes
    one row for each window that it overlaps, never one for each token."""
    at = token_offsets(rows.where(F.size("seq") > 0), seed, key, by)
    first, last = F.expr(f"offset div {n}"), F.expr(f"(offset + size(seq) - 1) div {n}")
    parts = at.select(*by, "offset", "seq", F.explode(F.sequence(first, last)).alias("seq_id"))
    start = F.greatest(F.lit(0), F.col("seq_id") * n - F.col("offset"))
    end = F.least(F.size("seq").cast("long"), (F.col("seq_id") + 1) * n - F.col("offset"))
    parts = parts.select(*by, "seq_id", F.struct(F.col("offset"), F.slice("seq", (start + 1).cast("int"), (end - start).cast("int")).alias("part")).alias("p"))
    whole = parts.groupBy(*by, "seq_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return whole.select(*by, "seq_id", pad_to(F.flatten(F.transform("ps", lambda p: p["part"])), n).alias("seq"))


def pack_by_range(files: DataFrame, places: DataFrame, marks: DataFrame, n: int, per: int) -> DataFrame:
    """files(id, seq, windows) in windows of n -> (seq_id, seq, ...), by places(id, windows, before); marks are the places with further
    columns of their ids. ``per`` neighbouring sequences, those of a shard, lie in one task.

    Files are dealt out to ranges of ids, whose sequences follow each other. The tokens go as JSON text, which is shorter than an array,
    and the marks with them, so that no join shuffles them again; only windows of shards that two ranges share are shuffled once more."""
    splits = quantile_splits(places, "id", least_rows=200)
    dealt = lambda rows: number_bucketed(rows, "id", "part", splits)
    others = [c for c in marks.columns if c not in ("id", "windows")]
    text = dealt(files).select("part", "id", F.to_json("seq").alias("text"), "windows")
    both = text.unionByName(dealt(marks).select("part", "id", *others), allowMissingColumns=True).repartition("part")
    w = Window.partitionBy("part", "id").orderBy(F.col("windows").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)  # an id's mark, then its files
    found = both.select("part", "text", "windows", (F.sum("windows").over(w) - F.col("windows")).alias("ahead"), *(F.first(c).over(w).alias(c) for c in others)).where("text is not null")
    ends = dealt(places).groupBy("part").agg(F.min("before").alias("first"), F.max(F.col("before") + F.col("windows")).alias("end"))  # 2,049 ranges at most
    found = found.withColumn("before", F.col("before") + F.col("ahead")).join(F.broadcast(ends), "part")

    def windows(rows: DataFrame) -> DataFrame:
        seq = F.from_json("text", "array<string>", {"mode": "FAILFAST", "maxStringLen": "2147483647"})
        cells = F.posexplode_outer(padded_windows(seq, n)).alias("window", "seq")  # outer, as the filter of the other form would parse each text once more
        out = rows.select("first", "end", "before", *[c for c in others if c != "before"], cells)
        return out.withColumn("seq_id", F.col("before") + F.col("window")).drop("before", "window")

    within = f"seq_id div {per} * {per} >= first and (seq_id div {per} + 1) * {per} <= end"
    shared = found.where(f"before div {per} * {per} < first or ((before + windows - 1) div {per} + 1) * {per} > end")
    shared = windows(shared).where(f"not ({within})").repartition(F.expr(f"seq_id div {per}"))
    return windows(found).where(within).unionByName(shared).drop("first", "end")


def to_samples(seqs: DataFrame, pad: str = PAD) -> DataFrame:
    """seqs(..., seq, emb?) -> (..., src, tgt, mask, emb): next-token targets, a mask of non-pad targets, an empty vector if absent."""
    emb = F.col("emb") if "emb" in seqs.columns else F.array().cast("array<float>")
    others = [c for c in seqs.columns if c not in ("seq", "emb")]
    tgt = shift_left(F.col("seq"), pad)
    return seqs.select(*others, F.col("seq").alias("src"), tgt.alias("tgt"), loss_mask(tgt, pad).alias("mask"), emb.alias("emb"))
