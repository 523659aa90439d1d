"""Exact incremental dedup by content hash: what a stream has seen is a table, not state, so rows any time apart are told apart.

Folder of a SeenTable, all tables by the number of the batch that wrote them, so that a batch that is run again replaces
its own rows and does not see them:

- ``hashes/batch=N/part=P``: the hashes that batch N saw first, in ``parts`` parts by the hash.
- ``bloom/batch=N``: a Bloom filter of the same hashes, as bitmaps of 32,768 bits: a twelfth of the hashes' size or less.

A batch's hashes are first put to the filter, by an equi-join on the bitmap's number; only those that it does not rule out are looked up in
the table, in the parts where they fall. ``compact`` merges the batches' filters and files up to a batch into one. The number of parts is the table's, for good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one bitmap, and bits that a hash sets.
BITMAP, PROBES = 32_768, 4


class SeenTable:
    """``expected``: hashes for which the filter is laid out, 16 bits each; with more of them it rules out fewer, and results stay exact."""

    def __init__(self, spark: SparkSession, folder: str, expected: int = 100_000_000, parts: int = 256):
        self.spark, self.folder, self.parts = spark, folder, parts
        self.bitmaps = -(-16 * expected // BITMAP)

    def part_of(self, digest: Column) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.parts)).cast("int")

    def _positions(self, digest: Column) -> Column:
        return F.array(*(F.pmod(F.xxhash64(F.lit(i), digest), F.lit(self.bitmaps * BITMAP)) for i in range(PROBES)))

    def _before(self, kind: str, schema: str, number: int) -> DataFrame | None:
        """What batches before this one have written."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return None
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/{kind}").where(F.col("batch") < number)

    def maybe(self, digests: DataFrame, number: int) -> DataFrame | None:
        """Of digests(hash), each once, those that the filter does not rule out."""
        bloom = self._before("bloom", "bitmap_number long, bits binary", number)
        if bloom is None:
            return None
        whole = bloom.groupBy("bitmap_number").agg(F.bitmap_or_agg("bits").alias("bits"))
        probes = digests.select("hash", F.explode(self._positions(F.col("hash"))).alias("p")).select("hash", F.expr(f"p div {BITMAP}").alias("bitmap_number"), (F.col("p") % BITMAP).cast("int").alias("bit"))
        byte = F.conv(F.hex(F.substring("bits", F.expr("bit div 8 + 1"), F.lit(1))), 16, 10).cast("int")
        held = probes.join(whole.hint("merge"), "bitmap_number").where(F.getbit(byte, F.col("bit") % 8) == 1)
        return held.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") == PROBES).select("hash")

    def hits(self, digests: DataFrame, number: int) -> DataFrame:
        """Of digests(hash), each once, those that a batch before this one has seen."""
        likely, known = self.maybe(digests, number), self._before("hashes", "hash string, part int", number)
        if likely is None or known is None:
            return digests.where("false")
        likely = likely.withColumn("part", self.part_of(F.col("hash")))
        parts = [r["part"] for r in likely.select("part").distinct().collect()]  # at most self.parts
        return known.where(F.col("part").isin(parts)).select("hash", "part").join(likely.hint("merge"), ["hash", "part"], "left_semi").select("hash") if parts else digests.where("false")

    def add(self, digests: DataFrame, number: int) -> None:
        """Take digests(hash), each once and not seen before, as seen by this batch."""
        digests.withColumn("part", self.part_of(F.col("hash"))).repartition("part").sortWithinPartitions("part", "hash").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/hashes/batch={number}")
        p = self.spark.read.schema("hash string, part int").parquet(f"{self.folder}/hashes/batch={number}").select(F.explode(self._positions(F.col("hash"))).alias("p"))
        bits = p.select(F.expr(f"p div {BITMAP}").alias("bitmap_number"), (F.col("p") % BITMAP).alias("bit")).groupBy("bitmap_number").agg(F.bitmap_construct_agg("bit").alias("bits"))
        bits.write.mode("overwrite").parquet(f"{self.folder}/bloom/batch={number}")

    def compact(self, number: int, target: str) -> SeenTable:
        """A table in a new folder with what batches before ``number`` have seen, as that of batch 0; its users go on from number."""
        out = SeenTable(self.spark, target, parts=self.parts)
        out.bitmaps = self.bitmaps
        known = self._before("hashes", "hash string, part int", number)
        if known is not None:
            out.add(known.select("hash"), 0)
        return out


def dedup_exact(batch: DataFrame, number: int, seen: SeenTable, digest: str, order: list[str], scratch: str) -> DataFrame:
    """For foreachBatch: the batch's rows whose hash no earlier batch has seen, of each hash the one of the least order. Hashes and order
    alone are compared; whole rows are read once more at the end, for the kept keys. Rows with a null hash are all kept.

    Running a batch again gives the same rows: the keys of its winners are written in ``scratch`` before the hashes count as seen."""
    spark, key = batch.sparkSession, F.struct(*order)
    least = batch.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("hash")).agg(F.min(key).alias("key"))
    path = f"{scratch}/batch={number:08d}"
    least.write.mode("overwrite").parquet(f"{path}/least")
    least = spark.read.schema(least.schema).parquet(f"{path}/least")
    fresh = least.join(seen.hits(least.select("hash"), number).hint("merge"), "hash", "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path}/fresh")
    fresh = spark.read.schema(least.schema).parquet(f"{path}/fresh")
    seen.add(fresh.select("hash"), number)
    won = batch.join(fresh.toDF("__hash", "__key").hint("merge"), (F.col(digest) == F.col("__hash")) & (key == F.col("__key"))).drop("__key")
    return won.dropDuplicates(["__hash"]).drop("__hash").unionByName(batch.where(F.col(digest).isNull()))
