"""Reports and run metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strophe.operators import metrics as m
from strophe.queries import op
from strophe.queries.corpus import SEQS, seqs
from strophe.sources import shards

PAIRS = "pr AS (SELECT CAST(label AS INT) AS true_id, CAST(vec_id * 7 % 9 AS INT) AS pred_id FROM embeddings), tg AS (SELECT CAST(unnest(range(0, 12)) AS INT) AS tag_id)"
REPORT = f"""{PAIRS}, c AS (SELECT tag_id, count(*) FILTER (true_id = tag_id AND pred_id = tag_id) AS tp, count(*) FILTER (true_id <> tag_id AND pred_id = tag_id) AS fp, count(*) FILTER (true_id = tag_id AND pred_id <> tag_id) AS fn FROM tg, pr GROUP BY 1),
 q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM q)"""


def pairs(t):
    d = t("embeddings").select(F.col("label").cast("int").alias("true_id"), (F.col("vec_id") * 7 % 9).cast("int").alias("pred_id"))
    return d, t.spark.range(12).select(F.col("id").cast("int").alias("tag_id"))


@op("a10_classification_report", f"WITH {REPORT} SELECT tag_id, tp, fp, fn, tp + fn AS support, CAST(round(p, 6) AS DOUBLE) AS precision, CAST(round(r, 6) AS DOUBLE) AS recall, CAST(round(f1, 6) AS DOUBLE) AS f1 FROM f")
def a10(t):
    d = m.classification_report(*pairs(t))
    return d.select("tag_id", "tp", "fp", "fn", "support", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


@op("a10_overall", f"WITH {REPORT} SELECT (SELECT count(*) FROM pr) AS n, (SELECT CAST(round(avg(CASE WHEN true_id = pred_id THEN 1.0 ELSE 0.0 END), 6) AS DOUBLE) FROM pr) AS accuracy, CAST(round(avg(f1), 6) AS DOUBLE) AS macro_f1 FROM f")
def a10o(t):
    return m.overall(*pairs(t)).select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@op("a11_file_vote", "WITH s AS (SELECT l_suppkey AS file_id, l_linenumber AS class_id, sum(CAST(round(l_discount * 100, 0) AS BIGINT) * CAST(l_quantity AS BIGINT)) AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, class_id) AS rn FROM s) SELECT file_id, class_id AS pred_id FROM r WHERE rn = 1")
def a11(t):
    d = t("lineitem").select(F.col("l_suppkey").alias("file_id"), F.col("l_linenumber").alias("class_id"), F.round(F.col("l_discount") * 100, 0).cast("long").alias("prob"), F.col("l_quantity").cast("long").alias("nonpad"))
    return m.file_vote(d)


LOSSES = "tk AS (SELECT user_id AS batch, value AS loss, user_id % 10 <> 0 AND event_id % 3 <> 0 AS mask FROM events), pb AS (SELECT batch, coalesce(sum(loss) FILTER (mask) / nullif(count(*) FILTER (mask), 0), 0) AS loss, coalesce(sum(loss) FILTER (mask), 0) AS s, count(*) FILTER (mask) AS n FROM tk GROUP BY 1)"


def losses(t):
    return t("events").select(F.col("user_id").alias("batch"), F.col("value").alias("loss"), ((F.col("user_id") % 10 != 0) & (F.col("event_id") % 3 != 0)).alias("mask"))


@op("a12_batch_losses", f"WITH {LOSSES} SELECT batch, CAST(round(loss, 6) AS DOUBLE) AS loss, n AS tokens FROM pb")
def a12b(t):
    return m.batch_losses(losses(t)).withColumn("loss", F.round("loss", 6))


@op("a12_loss_reductions", f"WITH {LOSSES} SELECT CAST(round(coalesce(sum(s) / nullif(sum(n), 0), 0), 6) AS DOUBLE) AS token_mean, CAST(round(avg(loss), 6) AS DOUBLE) AS batch_mean FROM pb")
def a12(t):
    return m.loss_reductions(losses(t)).select(F.round("token_mean", 6).alias("token_mean"), F.round("batch_mean", 6).alias("batch_mean"))


@op("a13_best_epoch", "WITH e AS (SELECT user_id AS epoch, count(*) FILTER (event_type = 'click') / count(*) AS accuracy FROM events GROUP BY 1) SELECT CAST(round(max(accuracy), 6) AS DOUBLE) AS best_accuracy, (SELECT epoch FROM e ORDER BY round(accuracy, 9) DESC, epoch LIMIT 1) AS best_epoch FROM e")
def a13(t):
    e = t("events").groupBy(F.col("user_id").alias("epoch")).agg(F.round(F.count_if(F.col("event_type") == "click") / F.count("*"), 9).alias("accuracy"))
    return m.best_epoch(e).withColumn("best_accuracy", F.round("best_accuracy", 6))


BATCHES = "bt AS (SELECT user_id AS pass, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS batch, value AS loss, CAST(floor(value) AS BIGINT) AS tokens FROM events)"


def run_batches(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t("events").select(F.col("user_id").alias("pass"), F.row_number().over(w).cast("long").alias("batch"), F.col("value").alias("loss"), F.floor("value").cast("long").alias("tokens"))


@op("a14_accumulate", f"WITH {BATCHES} SELECT pass, (batch - 1) // 8 AS step, CAST(round(avg(loss), 6) AS DOUBLE) AS loss, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) < 8 AS partial FROM bt GROUP BY 1, 2")
def a14(t):
    return m.accumulate(run_batches(t), 8).withColumn("loss", F.round("loss", 6))


@op("a15_run_rollup", f"WITH {SEQS} SELECT count(*) AS sequences, CAST(sum(lt) AS BIGINT) AS loss_tokens, CAST(greatest(1, ceil(ceil(count(*) / 32) / 4)) AS BIGINT) AS steps_per_pass FROM s")
def a15(t):
    return m.run_rollup(shards.shard_counts(seqs(t)), 32, 4)


@op("w01_trailing_mean", f"WITH {BATCHES} SELECT pass, batch, CAST(round(avg(tokens) OVER (PARTITION BY pass ORDER BY batch ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS DOUBLE) AS trailing, CAST(round(avg(tokens) OVER (PARTITION BY pass ORDER BY batch ROWS UNBOUNDED PRECEDING), 6) AS DOUBLE) AS running FROM bt")
def w01(t):
    return m.trailing_mean(run_batches(t), "pass", "batch", "tokens", 20).select("pass", "batch", F.round("trailing", 6).alias("trailing"), F.round("running", 6).alias("running"))


@op("w02_tokens_seen", f"WITH {BATCHES} SELECT pass, batch, CAST(sum(tokens) OVER (PARTITION BY pass ORDER BY batch) AS BIGINT) AS tokens_seen FROM bt")
def w02(t):
    return m.tokens_seen(run_batches(t), "pass", "batch", "tokens").select("pass", "batch", "tokens_seen")


@op("f07_throttle", "SELECT event_id, CASE WHEN event_id % 50 <> 7 THEN event_id END AS step FROM events WHERE event_type = 'error' OR event_id % 50 = 7 OR event_id <= 1 OR event_id % 20 = 0")
def f07(t):
    d = t("events").select("event_id", F.when(F.col("event_id") % 50 != 7, F.col("event_id")).alias("step"), (F.col("event_type") == "error").alias("force"))
    return m.throttle(d, 20).select("event_id", "step")


@op("x39_lineage", "WITH RECURSIVE p AS (SELECT n_nationkey AS phase, CASE WHEN n_nationkey >= 2 THEN n_nationkey - 2 END AS parent, count(c_custkey) AS steps, CAST(coalesce(sum(floor(c_acctbal)), 0) AS BIGINT) AS tokens FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), r AS (SELECT phase, parent, steps, tokens, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS k FROM p WHERE parent IS NULL UNION ALL SELECT p.phase, p.parent, p.steps, p.tokens, r.s + r.steps, r.k + r.tokens FROM p JOIN r ON p.parent = r.phase) SELECT phase, steps, tokens, s AS start_step, k AS start_tokens FROM r")
def x39(t):
    c = t("customer").groupBy(F.col("c_nationkey").alias("phase")).agg(F.count("*").alias("steps"), F.sum(F.floor("c_acctbal")).cast("long").alias("tokens"))
    p = t("nation").select(F.col("n_nationkey").alias("phase"), F.when(F.col("n_nationkey") >= 2, F.col("n_nationkey") - 2).alias("parent")).join(c, "phase", "left").fillna(0, ["steps", "tokens"])
    return m.lineage(p)


@op("j08_first_response", "WITH g AS (SELECT user_id AS stream, event_id AS go_id, epoch_us(ts) // 1000000 AS at FROM events WHERE event_type = 'view'), n AS (SELECT user_id AS stream, epoch_us(ts) // 1000000 AS at FROM events WHERE event_type = 'click' AND floor(value) % 128 > 0) SELECT g.stream, go_id, g.at, min(n.at - g.at) AS latency FROM g LEFT JOIN n ON g.stream = n.stream AND n.at BETWEEN g.at AND g.at + 43200 GROUP BY 1, 2, 3")
def j08(t):
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    e = t("events").select(F.col("user_id").alias("stream"), "event_id", at.alias("at"), "event_type", (F.floor("value") % 128).alias("velocity"))
    return m.first_response(e.where("event_type = 'view'").select("stream", F.col("event_id").alias("go_id"), "at"), e.where("event_type = 'click'").select("stream", "at", "velocity"), 43200)
