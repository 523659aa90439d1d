"""Sources, filters, joins, dedup and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.contracts import CATEGORY_TAGS, MANUAL_METADATA, notes_view, tag_table
from strophe.functions.arrays import loss_tokens, tokens_of
from strophe.operators import corpus as c
from strophe.operators.packing import pack_separate
from strophe.operators.prefix import numbered_sum
from strophe.queries import digest, digest_sql, op
from strophe.queries.quality import NOTES
from strophe.sources import records, shards
from strophe.sources.work import shared_folder, written

HASH = r"md5(trim(regexp_replace(text, '\s+', ' ', 'g')))"
TOKENS = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
U = "CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT)"


@op("s01_discover_files")
def s01(t):
    return records.discover_files(t.spark, t.dir, extensions=("parquet",)).select(F.regexp_extract("path", r"([^/]+/?[^/]*)$", 1).alias("name"), "length")


@op("s01_discover_modes", """WITH f AS (SELECT DISTINCT doc_id % 7 AS part FROM documents), m AS (SELECT 'all' AS mode, part FROM f UNION ALL SELECT 'flat', part FROM f WHERE part = 3 UNION ALL SELECT 'listed', part FROM f WHERE part IN (1, 2) UNION ALL SELECT 'both', part FROM f WHERE part IN (1, 3) UNION ALL SELECT 'nothing', -1)
 SELECT mode, part, row_number() OVER (PARTITION BY mode ORDER BY part) - 1 AS place FROM m""")
def s01_modes(t):
    """A folder of folders of text files, found with all below it, in one folder alone, from a list of folders and from both; a folder
    above the files finds nothing without recursion, which is an error."""
    path = shared_folder(t.spark, "s01") + "/files"
    docs = t("documents").select((F.col("doc_id") % 7).alias("part"), F.coalesce("text", F.lit("")).alias("value"))
    docs.repartition("part").write.partitionBy("part").text(path)
    find = lambda mode, *args, **options: records.discover_files(t.spark, *args, extensions=("txt",), **options).select("path", F.lit(mode).alias("mode"))
    found = find("all", path).unionByName(find("flat", f"{path}/part=3", recursive=False))
    found = found.unionByName(find("listed", None, paths=[f"{path}/part={i}/*.txt" for i in (1, 2)])).unionByName(find("both", f"{path}/part=3", paths=[f"{path}/part=1/*.txt"]))
    ranked = records.ranged_positional(found, ["mode", "path"])
    first = ranked.groupBy("mode").agg(F.min("index").alias("first"))  # four rows
    own = ranked.join(F.broadcast(first), "mode").select("mode", F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part"), (F.col("index") - F.col("first")).alias("place"))
    try:
        find("nothing", path, recursive=False)
    except FileNotFoundError:
        own = own.unionByName(t.spark.range(1).select(F.lit("nothing").alias("mode"), F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("place")))
    return own


@op("s02_read_records", "WITH l AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 4) ELSE props END AS line FROM events) SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(line, '$.k') AS INT) END AS k, event_id % 7 = 0 AS bad FROM l")
def s02(t):
    lines = t("events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("line"))
    return records.parse_records(lines, "line", "k int", tolerant=True).select("event_id", "k", F.col("_corrupt_record").isNotNull().alias("bad"))


BLOCK = 10_000


@op("s02_tolerant_files", f"""WITH l AS (SELECT event_id, event_id // {BLOCK} AS part, row_number() OVER (PARTITION BY event_id // {BLOCK} ORDER BY event_id) AS line, CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 4) ELSE props END AS text FROM events)
 SELECT part, line, text FROM l WHERE event_id % 7 = 0 UNION ALL SELECT part, NULL, count(*) || ':' || sum(CAST(json_extract_string(text, '$.k') AS INT)) FROM l WHERE event_id % 7 <> 0 GROUP BY 1""")
def s02_files(t):
    """Files of JSON lines, every seventh of which is cut off: the bad ones by file and line, and a row for the good ones of each file."""
    path = shared_folder(t.spark, "s02") + "/lines"
    cut = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    lines = t("events").select(F.expr(f"event_id div {BLOCK}").alias("part"), "event_id", cut.alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "event_id").drop("event_id").write.partitionBy("part").text(path)
    good, bad = records.read_records_audited(t.spark, path, "k int")
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part")
    n = good.groupBy(part).agg(F.concat_ws(":", F.count("*").cast("string"), F.sum("k").cast("string")).alias("text"))
    return bad.select(part, "line", "text").unionByName(n.select("part", F.lit(None).cast("long").alias("line"), "text"))


@op("s04_record_at", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents) SELECT index, doc_id, (SELECT count(*) FROM documents) AS n FROM r")
def s04(t):
    docs = t("documents").select("doc_id")
    n = docs.agg(F.count("*").alias("n"))
    return records.positional(docs, ["doc_id"]).crossJoin(F.broadcast(n)).select("index", "doc_id", "n")


L, SHARD = 128, 128 * 64
SEQS = f"t AS (SELECT doc_id, len(tok) AS nt, (len(tok) + {L - 1}) // {L} AS nw FROM (SELECT doc_id, {TOKENS} AS tok FROM documents)), o AS (SELECT *, sum(nw) OVER (ORDER BY doc_id) - nw AS before FROM t), w AS (SELECT before, nt, unnest(range(0, nw)) AS wi FROM o), s AS (SELECT CAST(before + wi AS BIGINT) AS seq_id, CAST((before + wi) // {SHARD // L} AS BIGINT) AS shard_id, greatest(0, least({L}, nt - wi * {L}) - 1) AS lt FROM w)"


def seqs(t):
    """Whole documents in ascending order of their ids, each cut into padded windows: seq_id, shard_id, seq."""
    d = t("documents").select("doc_id", tokens_of(F.col("text")).alias("seq"))
    # written with its windows, as the places are found in several passes, of which only one needs the tokens
    d = numbered_sum(written(d.withColumn("n", F.ceil(F.size("seq") / L)), "tokens"), ["doc_id"], F.col("n"), "before").drop("n")
    d = pack_separate(d, L, "doc_id").select((F.col("before") + F.col("window")).alias("seq_id"), "seq")
    return shards.assign_shards(d, L, SHARD)


@op("s05_write_shards", f"WITH {SEQS} SELECT 'shard-' || lpad(CAST(shard_id AS VARCHAR), 6, '0') AS name, count(*) AS n, min(seq_id) AS first, max(seq_id) AS last FROM s GROUP BY ALL")
def s05(t):
    path = shared_folder(t.spark, "s05") + "/shards"
    shards.write_shards(seqs(t), path)
    return shards.read_shards(t.spark, path).groupBy(shards.shard_name("shard_id").alias("name")).agg(F.count("*").alias("n"), F.min("seq_id").alias("first"), F.max("seq_id").alias("last"))


@op("s06_build_manifest", f"WITH {SEQS}, p AS (SELECT shard_id, count(*) AS n, sum(lt) AS l FROM s GROUP BY ALL) SELECT 1 AS format_version, CAST(sum(n) AS BIGINT) AS sequence_count, CAST(sum(l) AS BIGINT) AS loss_token_count, string_agg('shard-' || lpad(CAST(shard_id AS VARCHAR), 6, '0') || ':' || n || ':' || l, ',' ORDER BY shard_id) AS shards FROM p")
def s06(t):
    m = shards.build_manifest(seqs(t), "white-space", {"unit": "word"}, L, SHARD)
    return m.select("format_version", "sequence_count", "loss_token_count", F.array_join(F.transform("shards", lambda s: F.concat_ws(":", s["name"], s["sequence_count"].cast("string"), s["loss_token_count"].cast("string"))), ",").alias("shards"))


@op("s06_manifest_parts", f"WITH {SEQS}, p AS (SELECT shard_id, count(*) AS sequence_count, CAST(sum(lt) AS BIGINT) AS loss_token_count FROM s GROUP BY ALL) SELECT shard_id, 'shard-' || lpad(CAST(shard_id AS VARCHAR), 6, '0') AS name, sequence_count, loss_token_count, CAST(sum(sequence_count) OVER (ORDER BY shard_id) - sequence_count AS BIGINT) AS start, (SELECT count(*) FROM p) AS shards, (SELECT CAST(sum(sequence_count) AS BIGINT) FROM p) AS sequences FROM p")
def s06_parts(t):
    """The manifest in parts, with the totals of its header in each row."""
    path = shared_folder(t.spark, "s06") + "/manifest"
    shards.write_manifest_parts(seqs(t), path, {"tokenizer_name": "white-space"}, L, SHARD)
    header = t.spark.read.schema("shard_count bigint, sequence_count bigint").json(f"{path}/header").toDF("shards", "sequences")
    return shards.read_manifest_parts(t.spark, path).crossJoin(F.broadcast(header))


@op("s08_validate_manifests", "WITH m AS (SELECT source, CAST(max(length(text)) AS BIGINT) // 10000 AS max_seq_len, 'ws' AS tokenizer_name FROM documents GROUP BY 1), f AS (SELECT max_seq_len FROM m ORDER BY source LIMIT 1) SELECT source, 'max_seq_len' AS field, m.max_seq_len AS value, f.max_seq_len AS expected FROM m, f WHERE m.max_seq_len <> f.max_seq_len")
def s08(t):
    m = t("documents").groupBy("source").agg(F.expr("max(length(text)) div 10000").alias("max_seq_len")).withColumn("tokenizer_name", F.lit("ws"))
    v = shards.validate_manifests(m, "source")
    return v.select("source", "field", *(F.get_json_object(x, "$.v").cast("long").alias(x) for x in ("value", "expected")))


@op("s09_check_shards", f"WITH {SEQS}, p AS (SELECT shard_id, count(*) AS rows FROM s GROUP BY ALL), e AS (SELECT shard_id, rows + (shard_id % 3 = 0)::INT AS expected FROM p WHERE shard_id % 5 <> 4) SELECT shard_id, coalesce(rows, 0) AS rows, coalesce(expected, 0) AS expected FROM p FULL JOIN e USING (shard_id) WHERE coalesce(rows, 0) <> coalesce(expected, 0)")
def s09(t):
    s = seqs(t)
    expected = s.groupBy("shard_id").agg(F.count("*").alias("n")).where("shard_id % 5 <> 4").select("shard_id", F.expr("n + int(shard_id % 3 = 0)").alias("expected"))
    return shards.check_shards(s, expected)


@op("s09_check_folder", f"WITH {SEQS}, p AS (SELECT shard_id, count(*) AS expected, count(*) FILTER (shard_id % 5 <> 4 AND (shard_id % 3 > 0 OR seq_id % 64 > 0)) AS rows FROM s GROUP BY ALL) SELECT * FROM p WHERE rows <> expected")
def s09_folder(t):
    """A folder of shards whose manifest lists all sequences, of which every fifth shard and the first sequence of every third are lost."""
    folder = shared_folder(t.spark, "s09")
    s = written(seqs(t), "sequences")
    shards.write_manifest_parts(s, f"{folder}/manifest", {"tokenizer_name": "white-space"}, L, SHARD)
    shards.write_shards(s.where("shard_id % 5 <> 4 and (shard_id % 3 > 0 or seq_id % 64 > 0)"), f"{folder}/shards")
    return shards.check_shard_folder(t.spark, f"{folder}/shards", f"{folder}/manifest")


CUM = f"{SEQS}, p AS (SELECT shard_id % 2 AS dir, shard_id, count(*) AS sequence_count FROM s GROUP BY ALL), q AS (SELECT *, sum(sequence_count) OVER (ORDER BY dir, shard_id) AS e FROM p), cum AS (SELECT dir, shard_id, sequence_count, CAST(e - sequence_count AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM q)"


def cumulative(t):
    """Two folders of shards, the even and the odd ones, scanned one after the other."""
    folder = shared_folder(t.spark, "dirs")
    shards.write_shards(seqs(t).withColumn("dir", F.col("shard_id") % 2), folder, by=("dir",))
    return shards.scan_shard_dirs(t.spark, [f"{folder}/dir=0", f"{folder}/dir=1"]).select(F.col("dir").cast("long").alias("dir"), "shard_id", "sequence_count", "start", "end")


@op("s10_scan_shard_dirs", f"WITH {CUM} SELECT * FROM cum")
def s10(t):
    return cumulative(t)


@op("w04_cumulative_shard_starts", f"WITH {CUM} SELECT shard_id, start FROM cum")
def w04(t):
    return cumulative(t).select("shard_id", "start")


@op("j06_sequence_at", f"WITH {CUM} SELECT e.event_id AS index, shard_id, e.event_id - start AS local_index FROM events e JOIN cum ON e.event_id >= start AND e.event_id < \"end\"")
def j06(t):
    return shards.sequence_at(t("events").select(F.col("event_id").alias("index")), cumulative(t)).select("index", "shard_id", "local_index")


@op("s11_read_embedding_table", f"WITH r AS (SELECT vec_id % 100 AS path, vec_id, embedding, row_number() OVER (PARTITION BY vec_id % 100 ORDER BY vec_id DESC) AS rn FROM embeddings) SELECT path, len(embedding) AS n, CAST(round(embedding[1], 6) AS DOUBLE) AS first, {digest_sql('embedding')} AS hash FROM r WHERE rn = 1")
def s11(t):
    d = records.read_embedding_table(t("embeddings").select((F.col("vec_id") % 100).alias("path"), "vec_id", F.col("embedding").alias("emb")), "path", "vec_id")
    return d.select("path", F.size("emb").cast("long").alias("n"), F.round(F.col("emb")[0].cast("double"), 6).alias("first"), digest().alias("hash"))


@op("f02_remove_instruments", f"WITH {NOTES} SELECT instrument, count(*) AS n FROM notes WHERE instrument NOT IN ('error', 'signup') GROUP BY 1")
def f02(t):
    return c.remove_instruments(notes_view(t("events")), ["error", "signup"]).groupBy("instrument").agg(F.count("*").alias("n"))


@op("f03_drop_text_meta", "SELECT conv_id, turn, role FROM conversations WHERE NOT (turn % 2 = 0 AND role IN ('system', 'lyrics'))")
def f03(t):
    d = t("conversations").withColumn("is_meta", F.col("turn") % 2 == 0)
    return c.drop_text_meta(d, "role", types=["system", "lyrics"]).select("conv_id", "turn", "role")


LIMIT = 86400
PREFIX = f"{NOTES}, ped AS (SELECT piece_id, note_id AS pedal_id, onset AS tick, CASE WHEN pitch % 2 = 0 THEN 1 ELSE 0 END AS value FROM notes WHERE instrument = 'click'), nn AS (SELECT * FROM notes WHERE instrument <> 'click' AND piece_id % 5 <> 0)"


@op("f04_prompt_prefix", f"""WITH {PREFIX}, k AS (SELECT piece_id, onset, dur, pitch, velocity FROM nn WHERE onset <= {LIMIT} UNION ALL SELECT piece_id, 0, 1, u, 60 FROM (SELECT DISTINCT piece_id FROM notes) p, (SELECT unnest([60, 64]) AS u) WHERE piece_id NOT IN (SELECT piece_id FROM nn WHERE onset <= {LIMIT})),
 pl AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY tick DESC, pedal_id DESC) AS rn FROM ped WHERE tick <= {LIMIT}), pk AS (SELECT piece_id, count(*) AS n_pedals FROM pl WHERE NOT (rn = 1 AND value = 1) GROUP BY 1)
 SELECT piece_id, count(*) AS n_notes, CAST(sum(pitch) AS BIGINT) AS pitches, coalesce(any_value(n_pedals), 0) AS n_pedals FROM k LEFT JOIN pk USING (piece_id) GROUP BY 1""")
def f04(t):
    notes = notes_view(t("events")).where("piece_id is not null")
    ped = notes.where("instrument = 'click'").select("piece_id", F.col("note_id").alias("pedal_id"), F.col("onset").alias("tick"), F.when(F.col("pitch") % 2 == 0, 1).otherwise(0).alias("value"))
    n, p = c.prompt_prefix(notes.select("piece_id").distinct(), notes.where("instrument <> 'click' and piece_id % 5 <> 0"), ped, LIMIT)
    pk = p.groupBy("piece_id").agg(F.count("*").alias("n_pedals"))
    return n.groupBy("piece_id").agg(F.count("*").alias("n_notes"), F.sum("pitch").alias("pitches")).join(pk, "piece_id", "left").withColumn("n_pedals", F.coalesce("n_pedals", F.lit(0)))


@op("f05_eligible_for_embedding", "SELECT o_custkey AS piece_id, min(o_orderpriority) = '1-URGENT' AND max(o_orderpriority) = '1-URGENT' AS eligible FROM orders GROUP BY 1")
def f05(t):
    notes = t("orders").select(F.col("o_custkey").alias("piece_id"), F.col("o_orderpriority").alias("instrument"))
    return c.eligible_for_embedding(notes, notes.select("piece_id").distinct(), "1-URGENT")


KV = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'composer' ELSE 'genre' END AS key, CASE doc_id % 4 WHEN 0 THEN 'bach' WHEN 1 THEN 'jazz' WHEN 2 THEN 'schumann' ELSE lang END AS value FROM documents"


@op("f06_validate_manual_metadata", f"WITH e AS ({KV}) SELECT doc_id, key, value FROM e WHERE NOT ((key = 'composer' AND value IN ({', '.join(repr(x) for x in MANUAL_METADATA['composer'])})) OR (key = 'genre' AND value IN ('classical', 'jazz')))")
def f06(t):
    i = F.col("doc_id") % 4
    e = t("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "composer").otherwise("genre").alias("key"), F.when(i == 0, "bach").when(i == 1, "jazz").when(i == 2, "schumann").otherwise(F.col("lang")).alias("value"))
    return c.validate_manual_metadata(e).select("doc_id", "key", "value")


@op("f08_sample_projection", f"WITH t AS (SELECT doc_id, {TOKENS} AS s FROM documents) SELECT doc_id, array_to_string(s, ' ') AS src, array_to_string(list_concat(list_slice(s, 2, len(s)), ['<P>']), ' ') AS tgt, CAST(greatest(len(s) - 1, 0) AS BIGINT) AS mask_on, CAST(0 AS INT) AS emb_size FROM t")
def f08(t):
    from strophe.operators.packing import to_samples

    d = to_samples(t("documents").select("doc_id", tokens_of(F.col("text")).alias("seq")))
    return d.select("doc_id", F.array_join("src", " ").alias("src"), F.array_join("tgt", " ").alias("tgt"), F.size(F.filter("mask", lambda x: x)).cast("long").alias("mask_on"), F.size("emb").alias("emb_size"))


@op("j01_attach_embeddings", f"WITH e AS (SELECT vec_id // 5 AS path, vec_id, embedding, row_number() OVER (PARTITION BY vec_id // 5 ORDER BY vec_id DESC) AS rn FROM embeddings) SELECT doc_id, path, CAST(round(embedding[1], 6) AS DOUBLE) AS e1, {digest_sql('embedding')} AS hash FROM (SELECT doc_id, doc_id % 100 AS path FROM documents) JOIN e USING (path) WHERE rn = 1")
def j01(t):
    table = records.read_embedding_table(t("embeddings").select(F.expr("vec_id div 5").alias("path"), "vec_id", F.col("embedding").alias("emb")), "path", "vec_id")
    s = t("documents").select("doc_id", (F.col("doc_id") % 100).alias("path"))
    return c.attach_embeddings(s, table, "path").select("doc_id", "path", F.round(F.col("emb")[0].cast("double"), 6).alias("e1"), digest().alias("hash"))


TAGGED = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'sad' WHEN 1 THEN 'calm' WHEN 2 THEN 'angry' END AS tag FROM documents"


def tagged(t):
    i = F.col("doc_id") % 4
    return t("documents").select("doc_id", F.when(i == 0, "sad").when(i == 1, "calm").when(i == 2, "angry").alias("tag"))


@op("j02_map_tags_strict", f"WITH r AS ({TAGGED}) SELECT doc_id, tag, CASE tag WHEN 'sad' THEN 1 WHEN 'calm' THEN 2 END AS tag_id, tag IS NOT NULL AND tag <> 'angry' AS known FROM r")
def j02(t):
    good, bad = c.map_tags_strict(tagged(t), "emotion")
    return good.select("doc_id", "tag", "tag_id", F.lit(True).alias("known")).unionByName(bad.select("doc_id", "tag", F.lit(None).cast("int").alias("tag_id"), F.lit(False).alias("known")))


@op("j03_map_tags_other", f"WITH r AS ({TAGGED}) SELECT doc_id, CASE WHEN tag IN ('sad', 'calm') THEN tag ELSE 'other' END AS tag, CASE tag WHEN 'sad' THEN 1 WHEN 'calm' THEN 2 ELSE 4 END AS tag_id FROM r")
def j03(t):
    return c.map_tags_other(tagged(t), [*CATEGORY_TAGS["emotion"], "other"]).select("doc_id", "tag", "tag_id")


@op("j04_lookup_metadata", "SELECT d.doc_id, d.lang, CASE WHEN l.quality IS NULL THEN d.source WHEN l.toxic = 1 THEN 'toxic' ELSE d.source END AS source, CAST(l.quality AS VARCHAR) AS quality FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality, toxic FROM labels) l USING (doc_id)")
def j04(t):
    pieces = t("documents").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    catalogue = t("labels").distinct().select("doc_id", F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("source"), F.when(F.col("toxic") == 1, "toxic").otherwise("")).alias("found"))
    m = c.lookup_metadata(pieces, catalogue, "doc_id")
    return m.select("doc_id", *(F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("lang", "source", "quality")))


VOCAB = f"tk AS (SELECT doc_id, unnest({TOKENS}) AS token, unnest(range(0, len({TOKENS}))) AS pos FROM documents), vc AS (SELECT token, row_number() OVER (ORDER BY md5('v:' || token), token) AS token_id FROM (SELECT DISTINCT token FROM tk WHERE token IS NOT NULL))"


@op("j05_encode_decode", f"WITH {VOCAB} SELECT d.doc_id, md5(coalesce(string_agg(CAST(token_id AS VARCHAR), ' ' ORDER BY pos), '')) AS ids, md5(coalesce(string_agg(token, ' ' ORDER BY pos), '')) AS seq FROM documents d LEFT JOIN (tk JOIN vc USING (token)) USING (doc_id) GROUP BY 1")
def j05(t):
    rows = t("documents").select(F.col("doc_id").alias("id"), tokens_of(F.col("text")).alias("seq"))
    vocabulary = c.build_vocabulary(rows)
    ids = written(c.encode_tokens(rows, vocabulary), "ids")
    texts = c.decode_tokens(ids, vocabulary).select("id", F.md5(F.array_join("seq", " ")).alias("seq"))
    return ids.select("id", F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")).alias("ids")).join(texts.hint("merge"), "id").select(F.col("id").alias("doc_id"), "ids", "seq")


@op("a01_content_hash", f"SELECT doc_id, {HASH} AS hash FROM documents")
def a01(t):
    return t("documents").select("doc_id", c.content_hash(F.col("text")).alias("hash"))


@op("a01_note_content_hash", f"WITH {NOTES} SELECT piece_id, md5(string_agg(lpad(CAST(onset AS VARCHAR), 10, '0') || ',' || lpad(CAST(pitch AS VARCHAR), 3, '0') || ',' || dur || ',' || velocity || ',' || instrument, ';' ORDER BY lpad(CAST(onset AS VARCHAR), 10, '0') || ',' || lpad(CAST(pitch AS VARCHAR), 3, '0') || ',' || dur || ',' || velocity || ',' || instrument)) AS hash FROM notes GROUP BY 1")
def a01n(t):
    return c.note_content_hash(notes_view(t("events")))


@op("a02_dedup_keep_first", f"WITH h AS (SELECT doc_id, {HASH} AS hash FROM documents) SELECT hash, min(doc_id) AS doc_id, count(*) - 1 AS n_duplicates FROM h GROUP BY 1")
def a02(t):
    h = t("documents").select("doc_id", c.content_hash(F.col("text")).alias("hash"))
    kept, audit = c.dedup_keep_first(h, "hash", ["doc_id"])
    n = audit.groupBy("hash").agg(F.count("*").alias("n"))
    return kept.join(n.hint("merge"), "hash", "left").select("hash", "doc_id", F.coalesce("n", F.lit(0)).alias("n_duplicates"))


UNION = f"SELECT 0 AS o, doc_id AS id, {HASH} AS hash FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 1, doc_id, {HASH} FROM documents UNION ALL SELECT 2, item_id, {HASH} FROM benchmark"


def combined(t):
    d = t("documents").select(F.col("doc_id").alias("id"), c.content_hash(F.col("text")).alias("hash"))
    b = t("benchmark").select(F.col("item_id").alias("id"), c.content_hash(F.col("text")).alias("hash"))
    return c.combine_datasets(d.where("id % 2 = 0"), d, b)


@op("a03_combine_datasets", f"WITH u AS ({UNION}), r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY o, id) AS rn FROM u) SELECT id, hash, o AS source_ordinal FROM r WHERE rn = 1")
def a03(t):
    return combined(t)


@op("u02_union_distinct", f"WITH u AS ({UNION}) SELECT DISTINCT hash FROM u")
def u02(t):
    return combined(t).select("hash")


@op("u01_union_of_paths", "SELECT url AS path, 'dir' AS origin FROM pages UNION ALL SELECT DISTINCT source, 'list' FROM documents")
def u01(t):
    return t("pages").select(F.col("url").alias("path"), F.lit("dir").alias("origin")).unionByName(t("documents").select(F.col("source").alias("path"), F.lit("list").alias("origin")).distinct())


@op("o03_canonical_path_sort", "SELECT row_number() OVER (ORDER BY url, page_id) - 1 AS index, page_id FROM pages")
def o03(t):
    return records.ranged_positional(t("pages").select("url", "page_id"), ["url", "page_id"]).select("index", "page_id")


@op("o08_ratio_split", f"SELECT doc_id, CASE WHEN {U.format(seed=42, key='doc_id')} <= {int(0.95 * 4294967296)} THEN 'train' ELSE 'val' END AS split FROM documents")
def o08(t):
    return c.ratio_split(t("documents").select("doc_id"), "doc_id", 0.95, 42)


NAMES = ["tion", "thon", "bach", "ther"]


@op("x19_names_in_filename", f"WITH m AS (SELECT page_id, url, list_filter({NAMES}, lambda n: contains(lower(url), n)) AS f FROM pages) SELECT page_id, CASE WHEN len(f) = 1 THEN f[1] END AS composer FROM m")
def x19(t):
    return t("pages").select("page_id", c.match_names(F.col("url"), NAMES).alias("composer"))


@op("x20_names_in_text", f"WITH m AS (SELECT conv_id, turn, list_filter({NAMES}, lambda n: contains(lower(text), n)) AS f FROM conversations) SELECT conv_id, turn, CASE WHEN len(f) = 1 THEN f[1] END AS composer FROM m")
def x20(t):
    return t("conversations").select("conv_id", "turn", c.match_names(F.col("text"), NAMES).alias("composer"))


@op("x21_fill_manual", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'classical' ELSE lang END AS genre, 'sonata' AS form FROM documents")
def x21(t):
    m = c.fill_manual(F.create_map(F.lit("genre"), F.when(F.col("doc_id") % 3 != 0, F.col("lang"))), {"genre": "classical", "form": "sonata"})
    return t("documents").select("doc_id", m.alias("m")).select("doc_id", F.col("m")["genre"].alias("genre"), F.col("m")["form"].alias("form"))


@op("x22_overwrite_metadata", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS source, CASE WHEN doc_id % 2 = 0 THEN 'new' END AS extra FROM documents")
def x22(t):
    m = c.overwrite_metadata(F.create_map(F.lit("source"), "source"), F.create_map(F.lit("source"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(""), F.lit("extra"), F.when(F.col("doc_id") % 2 == 0, "new")))
    return t("documents").select("doc_id", m.alias("m")).select("doc_id", F.col("m")["source"].alias("source"), F.try_element_at("m", F.lit("extra")).alias("extra"))


@op("x37_row_replication", "SELECT conv_id, turn, unnest(range(1, 4)) AS variation FROM conversations")
def x37(t):
    return t("conversations").select("conv_id", "turn", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("variation"))


@op("x38_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def x38(t):
    return t("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@op("a04_loss_token_counts", f"WITH {SEQS} SELECT shard_id, CAST(sum(lt) AS BIGINT) AS loss_tokens FROM s GROUP BY 1")
def a04(t):
    return seqs(t).groupBy("shard_id").agg(F.sum(loss_tokens(F.col("seq"))).cast("long").alias("loss_tokens"))


@op("j10_pair_predictions", "SELECT l.doc_id, l.quality AS true_id, CASE WHEN length(d.text) > 1000 THEN 1 ELSE 0 END AS pred_id FROM labels l JOIN documents d USING (doc_id)")
def j10(t):
    predictions = t("documents").select("doc_id", F.when(F.length("text") > 1000, 1).otherwise(0).alias("pred_id"))
    return t("labels").select("doc_id", F.col("quality").alias("true_id")).join(predictions, "doc_id")
