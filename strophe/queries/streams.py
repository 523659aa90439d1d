"""R1-R9 over the tables as streams, and S3, S7, S12, S13: sinks that are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions.arrays import fixed_chunks, tokens_of
from strophe.operators import embed
from strophe.operators.corpus import content_hash
from strophe.operators.prefix import numbered_sum
from strophe.queries import op
from strophe.queries.corpus import HASH, SEQS, TOKENS, seqs
from strophe.sources import records, shards
from strophe.sources.work import shared_folder, written
from strophe.streaming import live, seen


PARTS = 3


def _docs(t):
    """Documents in three arrivals by their ids, one file a micro-batch or more."""
    d = t("documents").select(F.col("doc_id").alias("id"), tokens_of(F.col("text")).alias("seq"))
    return live.stream_of(t.spark, live.arrive(d, F.pmod("id", F.lit(PARTS)), PARTS, shared_folder(t.spark, "docs")), 16)


def _arrived(t):
    """Events in three arrivals by their times, every third up to 80 minutes late, and in a fourth one a closing event of nobody 400
    days on, behind which all windows and captures are ended."""
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    lo, third = F.unix_micros(F.lit(ends["lo"])), (F.unix_micros(F.lit(ends["hi"])) - F.unix_micros(F.lit(ends["lo"]))) / PARTS + 1
    late = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 5 * 1_200_000_000).otherwise(0)
    closing = e.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.lit("close").alias("event_type"), F.lit(PARTS).alias("part"))
    dealt = e.withColumn("part", F.least(F.lit(PARTS - 1), F.floor((F.unix_micros("ts") + late - lo) / third)).cast("int"))
    return live.arrive(dealt.unionByName(closing, allowMissingColumns=True), F.col("part"), PARTS + 1, shared_folder(t.spark, "events"))


def _events(t, path=None):
    return live.stream_of(t.spark, path or _arrived(t), 16)


DOCS = f"t AS (SELECT doc_id AS id, {TOKENS} AS tok FROM documents)"


BAGS = ", ".join(f"CAST(count(*) FILTER (b = {i}) AS VARCHAR)" for i in range(16))


@op("r01_slice_embed_append", f"WITH {DOCS}, u AS (SELECT id, unnest(tok) AS w, generate_subscripts(tok, 1) - 1 AS p FROM t), b AS (SELECT id, CAST(p // 64 AS BIGINT) AS slice, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 16 AS b FROM u) SELECT id, slice, count(*) AS n_tokens, concat_ws(',', {BAGS}) AS bag FROM b GROUP BY 1, 2")
def r01(t):
    out = live.drain(live.slice_and_embed(_docs(t), 64, lambda s: s.withColumn("emb", embed.hashed_bag(F.col("seq")))), "r01")
    n = F.size("seq").cast("long")
    return out.select("id", F.col("slice").cast("long").alias("slice"), n.alias("n_tokens"), F.concat_ws(",", F.transform("emb", lambda x: F.round(x * F.size("seq")).cast("int").cast("string"))).alias("bag"))


def _bag_model():
    """An example hook: counts of a slice's tokens in 16 hashed buckets."""
    import hashlib

    def counts(seq):
        out = [0.0] * 16
        for w in seq:
            out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
        return out

    return lambda batch: [counts(seq) for seq in batch]


@op("r01_embed_files", f"WITH {DOCS}, u AS (SELECT id, unnest(tok) AS w, len(tok) AS n FROM t), b AS (SELECT id, n, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 16 AS b, w FROM u) SELECT id, CAST(ceil(max(n) / 64) AS BIGINT) AS n_slices, CAST(max(n) AS BIGINT) AS n_tokens, concat_ws(',', {BAGS}) AS bag FROM b GROUP BY 1")
def r01f(t):
    """Slices of a document come in different arrivals; the second run of the query takes the last ones, and with them ends most files."""
    d = t("documents").select(F.col("doc_id").alias("id"), tokens_of(F.col("text")).alias("seq"))
    s = d.select("id", fixed_chunks(F.col("seq"), 64).alias("c")).select("id", F.size("c").alias("slices"), F.posexplode("c").alias("slice", "seq"))
    folder, part = shared_folder(t.spark, "r01f"), F.pmod(F.col("id") + F.col("slice"), F.lit(PARTS))
    s = written(s.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + 3600 * part)), "slices")
    run = lambda: live.drain(live.embed_files(live.stream_of(t.spark, f"{folder}/in", 16), _bag_model, "id", "ts", together=32), "r01f", each=lambda b, i: records.append_embedding_batch(b, f"{folder}/files", i), folder=f"{folder}/query")
    live.arrive(s.where(part < PARTS - 1), part, PARTS - 1, f"{folder}/in")
    run()
    s.where(part == PARTS - 1).write.mode("append").parquet(f"{folder}/in")
    run()
    out = t.spark.read.schema("id long, seqs array<array<string>>, emb array<double>").json(f"{folder}/files")
    bag = F.concat_ws(",", F.transform("emb", lambda x: F.round(x * F.size("seqs")).cast("int").cast("string")))
    return out.select("id", F.size("seqs").cast("long").alias("n_slices"), F.size(F.flatten("seqs")).cast("long").alias("n_tokens"), bag.alias("bag"))


@op("r02_stream_dedup", "SELECT DISTINCT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def r02(t):
    e = _events(t).select("ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return live.drain(live.dedup(e, ["user_id", "event_type", "k"], "ts", "60 days"), "r02").where("user_id >= 0").select("user_id", "event_type", "k")


@op("r02_incremental_dedup", f"SELECT hash, min(doc_id) AS doc_id, arg_min(length(text), doc_id) AS n_chars FROM (SELECT *, {HASH} AS hash FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def r02i(t):
    """Documents arrive in the order of their ids; of each content the first to come stays, however long ago it came. Each arrival is one
    micro-batch, in a run of its own without a limit of files: the files of an arrival lie in no order of their ids."""
    d = t("documents").select("doc_id", "text", content_hash(F.col("text")).alias("hash"))
    part = numbered_sum(d, ["doc_id"], F.lit(1), "at").crossJoin(F.broadcast(d.agg((F.count("*") / PARTS + 1).alias("size")))).withColumn("part", F.floor(F.col("at") / F.col("size")).cast("int")).drop("at", "size")
    folder = shared_folder(t.spark, "r02i")
    table = seen.SeenTable(t.spark, f"{folder}/seen", parts=16)
    run = lambda: live.drain(live.stream_of(t.spark, f"{folder}/in"), "r02i", each=lambda b, i: seen.dedup_exact(b, i, table, "hash", ["doc_id"], f"{folder}/scratch"), folder=f"{folder}/query")
    part = written(part, "parts")
    for i in range(PARTS):
        part.where(F.col("part") == i).write.mode("append").parquet(f"{folder}/in")
        out = run()
    return out.where("hash is not null").select("hash", "doc_id", F.length("text").cast("long").alias("n_chars"))


@op("r03_tolerant_decode", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k, event_id % 7 = 0 AS bad FROM events")
def r03(t):
    lines = _events(t).where("event_id >= 0").select("event_id", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("line"))
    good, bad = live.decode_to(lines, "line", "k int", shared_folder(t.spark, "r03"))
    return good.select("event_id", "k", F.lit(False).alias("bad")).unionByName(bad.select("event_id", "k", F.lit(True).alias("bad")))


CAPTURE = "WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'signup' AS stop FROM events), n AS (SELECT *, min(us) OVER (PARTITION BY user_id) AS b FROM e), r AS (SELECT *, max(stop::INT) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM n WHERE us <= b + 864000000000) SELECT user_id, us, event_id FROM r WHERE coalesce(over, 0) = 0"


def _control(e):
    at = F.col("ts").cast("timestamp")
    return e.select("user_id", "event_id", F.unix_micros(at).alias("us"), (F.col("event_type") == "signup").alias("stop"), at.alias("ts"))


@op("r04_capture_stream", CAPTURE)
def r04(t):
    return live.drain(live.capture(_control(_events(t)), "user_id", "us", "event_id", "stop", 864_000_000_000, delay="2 hours"), "r04").where("user_id >= 0").select("user_id", "us", "event_id")


AGAIN = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'signup' AS stop FROM events),
 c AS (SELECT user_id, min(us) AS b FROM e GROUP BY 1 UNION ALL SELECT user_id, min(us) FROM (SELECT c.user_id, c.b, coalesce(min(s.us), c.b + 86400000000) + 259200000000 AS u FROM c LEFT JOIN e s ON s.user_id = c.user_id AND s.stop AND s.us BETWEEN c.b AND c.b + 86400000000 GROUP BY 1, 2) JOIN e USING (user_id) WHERE us > u GROUP BY 1),
 f AS (SELECT c.user_id, c.b, min((s.us, s.event_id)) AS first FROM c LEFT JOIN e s ON s.user_id = c.user_id AND s.stop AND s.us BETWEEN c.b AND c.b + 86400000000 GROUP BY 1, 2)
SELECT e.user_id, us, event_id FROM f JOIN e ON e.user_id = f.user_id AND us BETWEEN b AND b + 86400000000 AND (first IS NULL OR (us, event_id) <= first)"""


@op("r04_capture_again", AGAIN)
def r04a(t):
    """Captures of a day at most, with three days' rest after each."""
    d = live.capture(_control(_events(t)), "user_id", "us", "event_id", "stop", 86_400_000_000, delay="2 hours", rest=259_200_000_000)
    return live.drain(d, "r04a").where("user_id >= 0").select("user_id", "us", "event_id")


@op("r04_capture_batch", CAPTURE)
def r04b(t):
    return live.capture_batch(_control(t("events")), "user_id", "us", "event_id", "stop", 864_000_000_000)


@op("r05_density_tumbling", "SELECT user_id, epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM events GROUP BY 1, 2")
def r05(t):
    d = live.drain(live.density(_events(t), "ts", ["user_id"], "1 day", delay="2 hours"), "r05")
    return d.select("user_id", F.expr("unix_micros(window.start) div 86400000000").alias("day"), "n")


@op("r05_density_sliding", "WITH w AS (SELECT epoch_us(ts) // 21600000000 - unnest([0, 1, 2, 3]) AS s FROM events) SELECT s AS start, count(*) AS n FROM w GROUP BY 1")
def r05s(t):
    d = live.drain(live.density(_events(t), "ts", [], "1 day", "6 hours", "2 hours"), "r05s")
    return d.select(F.expr("unix_micros(window.start) div 21600000000").alias("start"), "n")


@op("r06_sessions", "WITH l AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS d FROM events), s AS (SELECT user_id, us, sum(CASE WHEN d IS NULL OR d > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS s FROM l) SELECT user_id, min(us) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def r06(t):
    d = live.drain(live.sessions(_events(t), "ts", "user_id", "12 hours", "2 hours"), "r06")
    return d.select("user_id", F.unix_micros("session_window.start").alias("start"), "n")


@op("r07_stream_responses", "WITH g AS (SELECT user_id, event_id, epoch_us(ts) AS at FROM events WHERE event_type = 'view'), n AS (SELECT user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'click') SELECT event_id AS go_id, min(n.at - g.at) AS latency FROM g JOIN n ON g.user_id = n.user_id AND n.at BETWEEN g.at AND g.at + 43200000000 GROUP BY 1")
def r07(t):
    path = _arrived(t)
    # the closing event is in both streams, so that it moves both watermarks
    g = _events(t, path).where("event_type in ('view', 'close')").select(F.col("user_id").alias("stream"), F.col("event_id").alias("go_id"), F.col("ts").alias("go_ts"))
    n = _events(t, path).where("event_type in ('click', 'close')").select(F.col("user_id").alias("note_stream"), F.col("ts").alias("note_ts"))
    return live.drain(live.first_responses(g, n, "12 hours", "2 hours"), "r07").select("go_id", "latency")


@op("r08_resumable_progress", f"WITH {DOCS}, n AS (SELECT CASE WHEN id % 3 = 2 THEN 1 ELSE 0 END AS run, tok FROM t) SELECT run, CAST(count(*) AS BIGINT) AS rows, CAST(sum(len(tok)) AS BIGINT) AS tokens, TRUE AS goes_on FROM n GROUP BY 1")
def r08(t):
    """Two runs of one query: the second begins with the batch after the first one's last and takes the third arrival alone."""
    folder = shared_folder(t.spark, "r08")
    d = t("documents").select(F.col("doc_id").alias("id"), tokens_of(F.col("text")).alias("seq"))
    part = F.pmod("id", F.lit(PARTS))
    run = lambda: live.drain(live.stream_of(t.spark, f"{folder}/in", 16), "r08", each=lambda b, i: live.with_progress(b, i, 4), folder=f"{folder}/query")
    live.arrive(d.where(part < PARTS - 1), part, PARTS - 1, f"{folder}/in")
    before = run().agg(F.max("number")).first()[0]
    d.where(part == PARTS - 1).write.mode("append").parquet(f"{folder}/in")
    progress = run()
    after = F.col("number") > before
    steps = F.max("number") - F.min("number") + 1 == F.count("*")
    d = progress.withColumn("run", after.cast("int")).groupBy("run").agg(F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), steps.alias("steps"), F.min("number").alias("first"))
    return d.select("run", "rows", "tokens", (F.col("steps") & (F.col("first") == F.when(F.col("run") == 1, before + 1).otherwise(0))).alias("goes_on"))


@op("r09_stream_pack", f"WITH {DOCS}, w AS (SELECT id, tok, unnest(range(0, CAST(ceil(len(tok) / 64) AS BIGINT))) AS \"window\" FROM t), p AS (SELECT id, \"window\", tok[\"window\" * 64 + 1:\"window\" * 64 + 64] AS s FROM w) SELECT id, \"window\", md5(array_to_string(s, ' ') || repeat(' <P>', 64 - len(s))) AS hash FROM p")
def r09(t):
    return live.drain(live.pack(_docs(t), 64), "r09").select("id", F.col("window").cast("long").alias("window"), F.md5(F.concat_ws(" ", "seq")).alias("hash"))


@op("s03_write_records", "SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def s03(t):
    path = shared_folder(t.spark, "s03") + "/records"
    records.write_records(t("conversations"), path)
    return records.read_records(t.spark, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@op("s07_load_manifest", f"WITH {SEQS} SELECT 1 AS format_version, count(*) AS sequence_count, CAST(count(DISTINCT shard_id) AS BIGINT) AS n_shards FROM s")
def s07(t):
    folder = shared_folder(t.spark, "s07")
    s = written(seqs(t), "sequences")
    shards.write_shards(s, f"{folder}/shards")
    shards.build_manifest(s, "white-space", {"unit": "word"}, 128, 128 * 64).write.json(f"{folder}/manifest")
    return shards.load_manifest(t.spark, f"{folder}/manifest").select("format_version", "sequence_count", F.size("shards").cast("long").alias("n_shards"))


@op("s12_write_embedding_dataset", "SELECT vec_id // 5 AS path, CAST(count(*) AS BIGINT) AS n_seqs FROM embeddings GROUP BY 1")
def s12(t):
    path = shared_folder(t.spark, "s12") + "/files"
    s = t("embeddings").select(F.expr("vec_id div 5").alias("path"), F.col("vec_id").alias("slice"), F.col("label").cast("string").alias("seq"), F.col("embedding").alias("emb"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    records.write_embedding_dataset(s, path, per_file=True)
    return t.spark.read.schema("path long, seqs array<string>, emb array<double>").json(path).where(F.size("emb") == 64).select("path", F.size("seqs").cast("long").alias("n_seqs"))


@op("s13_run_metrics", "SELECT CAST(user_id AS VARCHAR) AS run, CAST(count(*) AS BIGINT) AS n, CAST(round(sum(value) * 100, 0) AS BIGINT) AS cents FROM events GROUP BY 1")
def s13(t):
    path = shared_folder(t.spark, "s13") + "/loss"
    d = t("events").select(F.col("user_id").cast("string").alias("run"), F.lit(0).alias("pass"), F.lit(1).alias("batch"), F.col("event_id").alias("step"), F.lit(0).cast("long").alias("tokens_seen"), F.col("value").alias("loss"))
    records.append_metrics(d.where("step % 2 = 0"), path)
    records.append_metrics(d.where("step % 2 = 1"), path)
    return records.read_metrics(t.spark, path, "loss").groupBy("run").agg(F.count("*").alias("n"), F.round(F.sum("loss") * 100, 0).cast("long").alias("cents"))


@op("s13_results", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run, epoch_us(ts) // 604800000000 AS epoch, CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE) / count(value) AS loss, count(*) FILTER (event_type = 'click') / count(*) AS accuracy FROM events WHERE user_id % 10 > 0 GROUP BY 1, 2),
 r AS (SELECT CAST(user_id AS VARCHAR) AS run, min(event_type) AS metadata_category, count(*) AS dataset_size FROM events GROUP BY 1)
 SELECT run, any_value(metadata_category) AS metadata_category, any_value(dataset_size) AS dataset_size, coalesce(string_agg(epoch || ':' || CAST(round(loss * 1000, 0) AS BIGINT) || ':' || CAST(round(accuracy * 1000000, 0) AS BIGINT), ',' ORDER BY epoch), '') AS epochs, coalesce(CAST(round(max(accuracy), 6) AS DOUBLE), 0.0) AS max_accuracy FROM r LEFT JOIN e USING (run) GROUP BY 1""")
def s13_results(t):
    """A run for each user, an epoch for each week of theirs; every tenth user's run has no epochs. Losses are summed as
    decimals, as the order of a sum of doubles would decide which way a mean between two thousandths is rounded."""
    path = shared_folder(t.spark, "s13") + "/results"
    e = t("events").withColumn("run", F.col("user_id").cast("string")).withColumn("ts", F.col("ts").cast("timestamp"))
    weeks = e.where("user_id % 10 > 0").groupBy("run", F.expr("unix_micros(ts) div 604800000000").alias("epoch")).agg((F.sum(F.col("value").cast("decimal(20,6)")).cast("double") / F.nullif(F.count("value"), F.lit(0))).alias("loss"), F.avg((F.col("event_type") == "click").cast("double")).alias("accuracy"))
    records.write_results(weeks, e.groupBy("run").agg(F.min("event_type").alias("metadata_category"), F.count("*").alias("dataset_size")), path)
    shown = F.transform("epoch_metrics", lambda x: F.concat_ws(":", x["epoch"].cast("string"), F.round(x["loss"] * 1000, 0).cast("long").cast("string"), F.round(x["accuracy"] * 1_000_000, 0).cast("long").cast("string")))
    return records.read_results(t.spark, path).select("run", "metadata_category", "dataset_size", F.array_join(shown, ",").alias("epochs"), (F.round(F.col("max_accuracy") * 1_000_000, 0) / 1_000_000).alias("max_accuracy"))
