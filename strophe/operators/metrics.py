"""Reports over predictions and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classification_report(pairs: DataFrame, tags: DataFrame) -> DataFrame:
    """pairs(true_id, pred_id), tags(tag_id) -> per tag: tp, fp, fn, support, precision, recall, f1, class_accuracy (= recall); a
    ratio without cases is 0, and tags without rows are there."""
    hit = F.col("true_id") == F.col("pred_id")
    as_true = pairs.groupBy(F.col("true_id").alias("tag_id")).agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fn"))
    as_pred = pairs.groupBy(F.col("pred_id").alias("tag_id")).agg(F.count_if(~hit).alias("fp"))
    d = tags.select("tag_id").join(as_true, "tag_id", "left").join(as_pred, "tag_id", "left").fillna(0, ["tp", "fp", "fn"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    d = d.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    d = d.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return d.withColumn("support", F.col("tp") + F.col("fn")).withColumn("class_accuracy", F.col("recall"))


def overall(pairs: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: n, accuracy (0 without rows), macro_f1."""
    acc = pairs.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("true_id") == F.col("pred_id")).cast("double")), F.lit(0.0)).alias("accuracy"))
    return acc.crossJoin(classification_report(pairs, tags).agg(F.avg("f1").alias("macro_f1")))


def file_vote(slices: DataFrame) -> DataFrame:
    """slices(file_id, class_id, prob, nonpad) -> (file_id, pred_id): the class of the largest sum of prob * nonpad, ties to the lowest."""
    s = slices.groupBy("file_id", "class_id").agg(F.sum(F.col("prob") * F.col("nonpad")).alias("score"))
    return s.groupBy("file_id").agg(F.max_by("class_id", F.struct("score", -F.col("class_id"))).alias("pred_id"))


def loss_reductions(tokens: DataFrame) -> DataFrame:
    """tokens(batch, loss, mask) -> one row: token-weighted mean (0 without tokens), and mean of the batches' masked means (0 for a
    batch without tokens). They differ when batches hold different numbers of tokens."""
    m = F.col("mask").cast("double")
    per = tokens.groupBy("batch").agg(F.sum(F.col("loss") * m).alias("s"), F.sum(m).alias("n"))
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0)
    return per.agg(F.coalesce(F.when(F.sum("n") > 0, F.sum("s") / F.sum("n")), F.lit(0.0)).alias("token_mean"), F.coalesce(F.avg(mean), F.lit(0.0)).alias("batch_mean"))


def batch_losses(tokens: DataFrame) -> DataFrame:
    m = F.col("mask").cast("double")
    return tokens.groupBy("batch").agg(F.coalesce(F.when(F.sum(m) > 0, F.sum(F.col("loss") * m) / F.sum(m)), F.lit(0.0)).alias("loss"), F.sum(m).cast("long").alias("tokens"))


def best_epoch(epochs: DataFrame) -> DataFrame:
    """epochs(epoch, accuracy) -> one row: best_accuracy (0 without epochs) and the first epoch that has it."""
    return epochs.agg(F.coalesce(F.max("accuracy"), F.lit(0.0)).alias("best_accuracy"), F.max_by("epoch", F.struct("accuracy", -F.col("epoch"))).alias("best_epoch"))


def accumulate(batches: DataFrame, grad_acc: int) -> DataFrame:
    """batches(pass, batch from 1, loss, tokens) -> steps (pass, step, loss mean, tokens sum, partial): groups of grad_acc batches in
    each pass; a pass's last group is kept when short, and flagged."""
    g = batches.groupBy("pass", F.expr(f"(batch - 1) div {grad_acc}").alias("step"))
    return g.agg(F.avg("loss").alias("loss"), F.sum("tokens").alias("tokens"), (F.count("*") < grad_acc).alias("partial"))


def run_rollup(shards: DataFrame, batch_size: int, grad_acc: int) -> DataFrame:
    """shards(sequence_count, loss_token_count) -> one row: sequences, loss tokens and steps of a pass."""
    d = shards.agg(F.coalesce(F.sum("sequence_count"), F.lit(0)).alias("sequences"), F.coalesce(F.sum("loss_token_count"), F.lit(0)).alias("loss_tokens"))
    return d.withColumn("steps_per_pass", F.greatest(F.lit(1), F.ceil(F.ceil(F.col("sequences") / batch_size) / grad_acc)).cast("long"))


def trailing_mean(rows: DataFrame, run: str, order: str, value: str, size: int) -> DataFrame:
    """rows with trailing and running mean; a run is one training run's log."""
    w = Window.partitionBy(run).orderBy(order)
    return rows.withColumn("trailing", F.avg(value).over(w.rowsBetween(1 - size, 0))).withColumn("running", F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def tokens_seen(rows: DataFrame, run: str, order: str, tokens: str) -> DataFrame:
    return rows.withColumn("tokens_seen", F.sum(tokens).over(Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def throttle(rows: DataFrame, interval: int, step: str = "step", force: str = "force") -> DataFrame:
    """Rows that are logged: forced, without a step, at step <= 1, all if the interval is <= 1, else each interval-th step."""
    keep = F.col(force) | F.col(step).isNull() | (F.col(step) <= 1)
    return rows if interval <= 1 else rows.where(keep | (F.col(step) % interval == 0))


def first_response(gos: DataFrame, notes: DataFrame, timeout: int) -> DataFrame:
    """gos(stream, go_id, at), notes(stream, at, velocity) -> (stream, go_id, at, latency): the first note with velocity > 0 within the
    timeout; null if none. Times are longs; go and note meet by stream and time bucket, so the join is an equi-join."""
    bucket = lambda c: F.expr(f"{c} div {timeout}")
    n = notes.where("velocity > 0").select("stream", F.col("at").alias("note_at"))
    n = n.withColumn("b", bucket("note_at"))
    g = gos.withColumn("b", F.explode(F.array(bucket("at"), bucket("at") + 1)))
    hits = g.join(n, ["stream", "b"]).where((F.col("note_at") >= F.col("at")) & (F.col("note_at") <= F.col("at") + timeout))
    first = hits.groupBy("stream", "go_id").agg(F.min(F.col("note_at") - F.col("at")).alias("latency"))
    return gos.join(first, ["stream", "go_id"], "left").select("stream", "go_id", "at", "latency")


def lineage(phases: DataFrame) -> DataFrame:
    """phases(phase, parent, steps, tokens) with start_step and start_tokens: the totals of all phases before it, by pointer
    doubling, so that a chain of n phases takes log2 n joins. Each round is written in the shared folder. A phase on or behind
    a cycle has no start: null."""
    from strophe.sources.work import shared_folder

    spark, folder = phases.sparkSession, shared_folder(phases.sparkSession, "lineage")
    zero = F.lit(0).cast("long")
    # done: the totals of the phases from here back to `up`, which is null where the chain ends
    d = phases.select("phase", F.col("parent").alias("up"), F.col("steps").cast("long").alias("steps"), F.col("tokens").cast("long").alias("tokens"), zero.alias("start_step"), zero.alias("start_tokens"))
    most, reach, i = phases.count(), 1, 0
    while True:
        d.write.parquet(f"{folder}/{i}")
        d = spark.read.schema(d.schema).parquet(f"{folder}/{i}")
        if reach > 2 * most or d.where("up is not null").isEmpty():
            break
        hop = d.select(F.col("phase").alias("up"), (F.col("start_step") + F.col("steps")).alias("hs"), (F.col("start_tokens") + F.col("tokens")).alias("ht"), F.col("up").alias("next"))
        d = d.join(hop.hint("merge"), "up", "left").select(
            "phase", F.col("next").alias("up"), "steps", "tokens",
            (F.col("start_step") + F.coalesce("hs", zero)).alias("start_step"), (F.col("start_tokens") + F.coalesce("ht", zero)).alias("start_tokens"),
        )
        reach, i = 2 * reach, i + 1
    known = F.col("up").isNull()
    return d.select("phase", "steps", "tokens", F.when(known, F.col("start_step")).alias("start_step"), F.when(known, F.col("start_tokens")).alias("start_tokens"))
