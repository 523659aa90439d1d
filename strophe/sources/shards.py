"""Sharded datasets of packed sequences, and their manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions.arrays import loss_tokens
from strophe.operators.prefix import numbered_sum
from strophe.sources.work import written

FORMAT_VERSION = 1
MANIFEST = (
    "format_version int, tokenizer_name string, tokenizer_config map<string,string>, max_seq_len int, shard_token_capacity bigint, separate_sequences boolean, "
    "embedding_size int, sequence_count bigint, loss_token_count bigint, shards array<struct<name:string,sequence_count:bigint,loss_token_count:bigint>>"
)


def shard_name(shard):
    return F.format_string("shard-%06d", shard)


def assign_shards(seqs: DataFrame, max_seq_len: int, shard_tokens: int) -> DataFrame:
    """seqs(seq_id, ...) with shard_id: seq_id div the sequences that a shard holds."""
    per = shard_tokens // max_seq_len
    if per < 1:
        raise ValueError("a shard must hold a sequence")
    return seqs.withColumn("shard_id", F.expr(f"seq_id div {per}"))


def write_shards(seqs: DataFrame, path: str, overwrite: bool = False, by: tuple[str, ...] = (), dealt: bool = False) -> None:
    """One folder a shard, with a gzip file of JSON lines; each shard is one task's work, of bounded size. Dealt: each shard's rows
    lie in one task already, and are not shuffled. With ``by`` there is a folder of shards for each of its values:
    path/column=value. The tasks put their files in place themselves (the committer's second algorithm), as the driver would
    rename those of all shards one after the other; so a write that fails can leave some shards, but no _SUCCESS file."""
    rows = (seqs if dealt else seqs.repartition(*by, "shard_id")).sortWithinPartitions(*by, "shard_id", "seq_id")
    files = rows.write.mode("overwrite" if overwrite else "errorifexists").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    files.partitionBy(*by, "shard_id").json(path, compression="gzip")


def read_shards(spark: SparkSession, path: str, vectors: bool = False) -> DataFrame:
    """The sequences of a folder of shards, with the vectors of their files if asked for; a folder without shards has none. The folders
    are listed by a few tasks for each core: Spark's own number is a task for each of them, up to 10,000."""
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(tasks)
    spark.conf.set(tasks, str(4 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.schema("seq_id bigint, seq array<string>, emb array<double>, shard_id bigint" if vectors else "seq_id bigint, seq array<string>, shard_id bigint").json(path)
    finally:
        spark.conf.set(tasks, before)


def scan_shard_dirs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(dir, shard_id, sequence_count, start, end): the shards of several folders, in the order of the folders and then of their ids, as
    one run of sequences."""
    rows = None
    for i, path in enumerate(paths):
        own = read_shards(spark, path).groupBy("shard_id").agg(F.count("*").alias("sequence_count")).withColumn("dir", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    return cumulative_shards(rows, ["dir", "shard_id"])


def shard_counts(seqs: DataFrame) -> DataFrame:
    return seqs.groupBy("shard_id").agg(F.count("*").alias("sequence_count"), F.sum(loss_tokens(F.col("seq"))).cast("long").alias("loss_token_count"))


def build_manifest(seqs: DataFrame, tokenizer_name: str, tokenizer_config: dict[str, str], max_seq_len: int, shard_tokens: int, separate: bool = False, embedding_size: int = 0) -> DataFrame:
    """One row. No sequences: counts 0 and no shards."""
    per = shard_counts(seqs).select(F.struct(shard_name("shard_id").alias("name"), "sequence_count", "loss_token_count").alias("s"))
    config = F.create_map(*(F.lit(x) for kv in sorted(tokenizer_config.items()) for x in kv)) if tokenizer_config else F.create_map().cast("map<string,string>")
    return per.agg(F.array_sort(F.collect_list("s")).alias("shards")).select(
        F.lit(FORMAT_VERSION).alias("format_version"), F.lit(tokenizer_name).alias("tokenizer_name"), config.alias("tokenizer_config"), F.lit(max_seq_len).alias("max_seq_len"),
        F.lit(shard_tokens).cast("long").alias("shard_token_capacity"), F.lit(separate).alias("separate_sequences"), F.lit(embedding_size).alias("embedding_size"),
        F.aggregate("shards", F.lit(0).cast("long"), lambda a, x: a + x["sequence_count"]).alias("sequence_count"),
        F.aggregate("shards", F.lit(0).cast("long"), lambda a, x: a + x["loss_token_count"]).alias("loss_token_count"), "shards",
    )


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Typed; a missing path is an error, and so is a manifest without sequences."""
    out = spark.read.schema(MANIFEST).json(path)
    if out.where("sequence_count > 0").isEmpty():
        raise ValueError(f"no sequences in {path}")
    return out


SHARED = ["format_version", "tokenizer_name", "tokenizer_config", "max_seq_len", "separate_sequences", "embedding_size"]


def validate_manifests(manifests: DataFrame, key: str = "ordinal") -> DataFrame:
    """(key, field, value, expected) of the fields in which a manifest differs from the first (least key)."""
    shown = manifests.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.to_json(F.struct(F.col(f).alias("v"))).alias("value")) for f in SHARED if f in manifests.columns))).alias("x")).select(key, "x.*")
    first = shown.groupBy("field").agg(F.min_by("value", key).alias("expected"))
    return shown.join(F.broadcast(first), "field").where(~F.col("value").eqNullSafe(F.col("expected"))).select(key, "field", "value", "expected")


def check_shards(seqs: DataFrame, manifest_shards: DataFrame) -> DataFrame:
    """manifest_shards(shard_id, expected): shards whose rows differ from the manifest's count; 0 where one side lacks the shard."""
    rows = seqs.groupBy("shard_id").agg(F.count("*").alias("rows"))
    both = rows.join(manifest_shards, "shard_id", "full").select("shard_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.where("rows <> expected")


def check_shard_folder(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """``check_shards`` of a folder of shards against a manifest in parts, both as written: (shard_id, rows, expected)."""
    listed = read_manifest_parts(spark, manifest).select("shard_id", F.col("sequence_count").alias("expected"))
    return check_shards(read_shards(spark, folder), listed)


def cumulative_shards(shards: DataFrame, order: list[str]) -> DataFrame:
    """shards(..., sequence_count) with start and end sequence numbers over all, in the order of the columns: at most two, whole
    numbers from 0, of which the last is below 2**40. The counts are written first, as each use would count the shards' rows again;
    the sums run over ranges of the order, so that no task holds all shards."""
    if len(order) > 2:
        raise ValueError("an order of shards has at most two columns")
    place = F.col(order[-1]).cast("long")
    if len(order) == 2:
        place = F.shiftleft(F.col(order[0]).cast("long"), 40) + place
    rows = written(shards.withColumn("__place", place), "shards")
    out = numbered_sum(rows, ["__place"], F.col("sequence_count"), "start").drop("__place")
    return out.withColumn("end", F.col("start") + F.col("sequence_count"))


#: Shards that a part of a manifest's table lists.
PART_SHARDS = 10_000


def write_manifest_parts(seqs: DataFrame, path: str, header: dict[str, str], max_seq_len: int, shard_tokens: int) -> None:
    """A manifest for any number of shards: path/shards has a row for each shard (name, counts and start), in parts of PART_SHARDS by
    their numbers, and path/header one row with the totals. Neither a row nor a task holds all shards. Refuses an existing path."""
    counts = cumulative_shards(shard_counts(seqs), ["shard_id"])
    rows = counts.select("shard_id", shard_name("shard_id").alias("name"), "sequence_count", "loss_token_count", "start", F.expr(f"shard_id div {PART_SHARDS}").alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "shard_id").write.partitionBy("part").parquet(f"{path}/shards")
    total = read_manifest_parts(seqs.sparkSession, path).agg(F.count("*").alias("shard_count"), F.coalesce(F.sum("sequence_count"), F.lit(0)).alias("sequence_count"), F.coalesce(F.sum("loss_token_count"), F.lit(0)).alias("loss_token_count"))
    fixed = [F.lit(v).alias(k) for k, v in {"format_version": FORMAT_VERSION, "max_seq_len": max_seq_len, "shard_token_capacity": shard_tokens, **header}.items()]
    total.select(*fixed, "shard_count", "sequence_count", "loss_token_count").write.json(f"{path}/header")


def read_manifest_parts(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(shard_id, name, sequence_count, loss_token_count, start) of the shards from first to last, or of all; parts outside are not read."""
    rows = spark.read.schema("shard_id bigint, name string, sequence_count bigint, loss_token_count bigint, start bigint, part bigint").parquet(f"{path}/shards")
    if first is not None:
        rows = rows.where(f"part >= {first // PART_SHARDS} and shard_id >= {first}")
    if last is not None:
        rows = rows.where(f"part <= {last // PART_SHARDS} and shard_id <= {last}")
    return rows.drop("part")


def sequence_at(indices: DataFrame, shards: DataFrame) -> DataFrame:
    """indices(index) with the shard (start <= index < end) that holds it and the place there. Shards are joined by the stretches
    of numbers that they overlap, as long as the largest shard, so that one overlaps two at most. Indices beyond the end are
    dropped."""
    width = shards.agg(F.max("sequence_count")).first()[0] or 1
    overlaps = F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"greatest(start, end - 1) div {width}")))
    at = indices.withColumn("__b", F.expr(f"index div {width}")).join(shards.withColumn("__b", overlaps).hint("merge"), "__b")
    return at.where("index >= start and index < end").drop("__b").withColumn("local_index", F.col("index") - F.col("start"))
