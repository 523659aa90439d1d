"""Reading and writing of record tables, embeddings tables and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BAD = "_corrupt_record"


def discover_files(spark: SparkSession, folder: str | None, recursive: bool = True, paths: list[str] | None = None, extensions: tuple[str, ...] = ("mid", "midi")) -> DataFrame:
    """(path, length) of the files with the extensions under a folder, and of the listed paths, in path order. Only names and
    sizes are read: the content column is pruned. Finding nothing is an error."""
    out = None
    sources = [(folder, {"pathGlobFilter": "*.{" + ",".join(extensions) + "}", "recursiveFileLookup": str(recursive).lower()})] if folder else []
    for path, options in [*sources, *((p, {}) for p in paths or [])]:
        own = spark.read.format("binaryFile").options(**options).load(path).select("path", "length")
        if options and not recursive:  # Spark goes on into folders named key=value
            root = spark._jvm.org.apache.hadoop.fs.Path(path)
            whole = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
            own = own.where(F.regexp_extract("path", "^(.*)/[^/]*$", 1) == whole)
        out = own if out is None else out.unionByName(own)
    if out is None or out.isEmpty():
        raise FileNotFoundError(f"no files with extensions {', '.join(extensions)}")
    return out.distinct().orderBy("path")


def read_records(spark: SparkSession, path: str, schema: StructType | str, tolerant: bool = False) -> DataFrame:
    """JSON lines; strict: a bad row fails the job. Tolerant: a bad row has only _corrupt_record set."""
    if not tolerant:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.read.schema(StructType([*wide.fields]).add(BAD, "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def parse_records(lines: DataFrame, column: str, schema: str, tolerant: bool = False) -> DataFrame:
    """The same over a column of JSON lines: parsed fields, and the line itself where it is no JSON object of the schema."""
    parsed = F.from_json(column, f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    out = lines.withColumn("__p", parsed)
    if not tolerant:
        out = out.withColumn("__p", F.when(F.col(f"__p.{BAD}").isNull(), F.col("__p")).otherwise(F.raise_error(F.concat(F.lit("bad record: "), F.substring(column, 1, 200)))))
    return out.select(*lines.columns, "__p.*")


def read_records_audited(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Files of JSON lines -> (good rows with file, audit(file, line, text) of the lines that are no JSON object of the schema; lines
    count from 1, empty ones too, which are neither good nor bad). Rows of a block of a file lie one after the other in one task, so
    a line's place in its block is its number less the block's least; the lines of the blocks before it are summed over a row for each
    block. No line is shuffled but the bad ones. Both results read the files; these must not change between."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    parsed = parse_records(lines, "value", schema, tolerant=True)
    full = F.trim("value") != ""
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select("file", "block", "first", before.alias("before"))
    bad = parsed.where(full & F.col(BAD).isNotNull()).select("file", "block", "at", F.col("value").alias("text")).join(placed.hint("merge"), ["file", "block"])
    good = parsed.where(full & F.col(BAD).isNull()).drop("value", "block", "at", BAD)
    return good, bad.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "text")


def write_records(df: DataFrame, path: str, overwrite: bool = False, kind: str = "json") -> None:
    """Refuses an existing path unless told to overwrite."""
    df.write.mode("overwrite" if overwrite else "errorifexists").format(kind).save(path)


def read_embedding_table(rows: DataFrame, key: str, order: str, vector: str = "emb") -> DataFrame:
    """key -> vector; the last row of a key (by order) wins. One aggregation, no sort."""
    return rows.groupBy(key).agg(F.max_by(vector, order).alias(vector))


def write_embedding_dataset(slices: DataFrame, path: str, per_file: bool, key: str = "path", order: str = "slice") -> None:
    """slices(key, order, seq, emb, metadata): slice rows as they are, or one row a file with its sequences in order, the mean
    vector and the first metadata. Refuses an existing path."""
    if per_file:
        from strophe.operators.pooling import mean_embedding

        slices = mean_embedding(slices, key, order)
    slices.write.mode("errorifexists").json(path)


def append_embedding_batch(files: DataFrame, path: str, number: int) -> DataFrame:
    """Append a micro-batch's rows to an embedding data set, once: a batch that is run again replaces its own. Returns what is written."""
    own = f"{path}/batch={number:08d}"
    files.write.mode("overwrite").json(own)
    return files.sparkSession.read.schema(files.schema).json(own)


METRICS = {
    "loss": "run string, pass int, batch int, step bigint, tokens_seen bigint, loss double",
    "eval": "run string, step bigint, tokens_seen bigint, avg_train_loss double, avg_val_loss double",
}


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(METRICS[kind]).option("header", True).csv(path)


RESULTS = "run string, metadata_category string, dataset_size bigint, epoch_metrics array<struct<epoch:int,loss:double,accuracy:double>>, max_accuracy double"


def write_results(epochs: DataFrame, runs: DataFrame, path: str) -> None:
    """epochs(run, epoch, loss, accuracy) and runs(run, metadata_category, dataset_size) -> one JSON object a run: its epochs in their
    order and the best accuracy, 0 where a run has no epochs. Refuses an existing path."""
    by_run = epochs.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), "loss", "accuracy"))).alias("epoch_metrics"), F.max("accuracy").alias("best"))
    out = runs.join(by_run, "run", "left").select("run", "metadata_category", "dataset_size", F.coalesce("epoch_metrics", F.array()).alias("epoch_metrics"), F.coalesce("best", F.lit(0.0)).alias("max_accuracy"))
    write_records(out, path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, RESULTS)


def positional(df: DataFrame, order: list[str]) -> DataFrame:
    """df with its 0-based position in the order, whose first column is a whole number; nulls come first."""
    from strophe.operators.prefix import numbered_sum

    return numbered_sum(df, order, F.lit(1), "index")


def ranged_positional(df: DataFrame, order: list[str]) -> DataFrame:
    """df with its 0-based position in an order of any kind. Spark deals the rows out in ranges of the order; they are written
    with the number of their range, which is the bucket, as another run may draw other bounds."""
    from strophe.operators.prefix import running_sum
    from strophe.sources.work import shared_folder

    path = shared_folder(df.sparkSession, "ranged") + "/rows"
    ranged = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranged.write.parquet(path)
    back = df.sparkSession.read.schema(ranged.schema).parquet(path)
    return running_sum(back, order, F.lit(1), "index", F.col("__range")).drop("__range")
