"""The jobs of strophe.plans over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.contracts import notes_view
from strophe.functions.arrays import tokens_of
from strophe.plans import jobs
from strophe.queries import digest, digest_sql, op
from strophe.queries.corpus import HASH, TOKENS, L, U
from strophe.queries.features import SCORED, shown_report
from strophe.queries.quality import BODIES, CONFIG, NOTES
from strophe.sources import records, shards
from strophe.sources.work import shared_folder

PACK, SHARD = 256, 256 * 64
SPLIT = f"CASE WHEN {U.format(seed=42, key='doc_id')} <= {int(0.95 * 4294967296)} THEN 'train' ELSE 'val' END"
PACKED = f"""WITH h AS (SELECT doc_id, text, {HASH} AS hash FROM documents), u AS (SELECT min(doc_id) AS doc_id FROM h GROUP BY hash), d AS (SELECT doc_id, {SPLIT} AS split, {TOKENS} AS tok FROM u JOIN documents USING (doc_id)),
 o AS (SELECT *, coalesce(sum(len(tok)) OVER (PARTITION BY split ORDER BY md5('42:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM d), w AS (SELECT split, CAST(off AS BIGINT) + unnest(range(0, len(tok))) AS g, unnest(tok) AS x FROM o)
 SELECT split, g // {PACK} AS seq_id, g // {PACK} // 64 AS shard_id, md5(string_agg(x, ' ' ORDER BY g) || repeat(' <P>', {PACK} - CAST(count(*) AS INT))) AS h, greatest(0, count(*) - 1) AS loss_tokens FROM w GROUP BY 1, 2, 3"""


@op("e02_pack_dataset", PACKED)
def e02(t):
    d = jobs.build_packed_dataset(t("documents"), PACK, SHARD, 42)
    return d.select("split", "seq_id", "shard_id", F.md5(F.array_join("seq", " ")).alias("h"), F.col("loss_tokens").cast("long").alias("loss_tokens"))


RUN = ("max_instruments", "repetitive_content")
LOOSE = {n: c | {"run": n in RUN} for n, c in CONFIG.items()}
LINE = "lpad(CAST(onset AS VARCHAR), 10, '0') || ',' || lpad(CAST(pitch AS VARCHAR), 3, '0') || ',' || dur || ',' || velocity || ',' || instrument"


@op("e01_note_corpus", f"""WITH {NOTES}, bad AS ({' UNION '.join(f"SELECT piece_id FROM (WITH {BODIES[n]}) WHERE failed" for n in RUN)}), h AS (SELECT piece_id, md5(string_agg({LINE}, ';' ORDER BY {LINE})) AS hash FROM notes WHERE piece_id NOT IN (SELECT piece_id FROM bad) AND instrument <> 'error' GROUP BY 1)
 SELECT min(piece_id) AS piece_id, hash, CASE WHEN {U.format(seed=42, key='min(piece_id)')} <= {int(0.9 * 4294967296)} THEN 'train' ELSE 'val' END AS split FROM h GROUP BY hash""")
def e01(t):
    return jobs.build_note_corpus(notes_view(t("events")), LOOSE, ["error"], 42, 0.9)


@op("e03_probe_report", SCORED)
def e03(t):
    d = t("embeddings").select("vec_id", F.col("embedding").alias("emb"), "label")
    return shown_report(jobs.probe_report(d, F.col("vec_id") % 5 == 0))


@op("e04_pack_files_with_vectors", f"""WITH t AS (SELECT doc_id, {TOKENS} AS tok FROM documents), o AS (SELECT doc_id, tok, (len(tok) + {L - 1}) // {L} AS nw, sum((len(tok) + {L - 1}) // {L}) OVER (ORDER BY doc_id) - (len(tok) + {L - 1}) // {L} AS before FROM t WHERE len(tok) > 0),
 w AS (SELECT doc_id, CAST(before + wi AS BIGINT) AS seq_id, tok[wi * {L} + 1:wi * {L} + {L}] AS s FROM (SELECT *, unnest(range(0, nw)) AS wi FROM o)), e AS (SELECT vec_id // 5 AS path, arg_max(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1)
 SELECT seq_id, seq_id // 64 AS shard_id, md5(array_to_string(s, ' ') || repeat(' <P>', {L} - len(s))) AS h, {digest_sql('embedding')} AS vector, (SELECT max(len(embedding)) FROM e) AS embedding_size, (SELECT count(*) FROM w) AS sequence_count FROM w JOIN e ON doc_id % 100 = path""")
def e04(t):
    """Documents as files, each with the vector of its path; the folder is read back with its manifest's header in each row."""
    folder = shared_folder(t.spark, "e04") + "/set"
    table = records.read_embedding_table(t("embeddings").select(F.expr("vec_id div 5").alias("path"), "vec_id", F.col("embedding").alias("emb")), "path", "vec_id")
    docs = t("documents").select(F.col("doc_id").alias("id"), tokens_of(F.col("text")).alias("seq"))
    vectors = docs.select("id", (F.col("id") % 100).alias("path")).join(table, "path").select("id", "emb")
    jobs.write_packed_files(docs, folder, L, 64 * L, vectors=vectors)
    header = t.spark.read.schema("embedding_size int, sequence_count bigint").json(f"{folder}/manifest/header")
    rows = shards.read_shards(t.spark, f"{folder}/shards", vectors=True).crossJoin(F.broadcast(header))
    return rows.select("seq_id", "shard_id", F.md5(F.array_join("seq", " ")).alias("h"), digest().alias("vector"), F.col("embedding_size").cast("long").alias("embedding_size"), "sequence_count")
