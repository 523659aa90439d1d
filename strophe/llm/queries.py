"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import best_fit, decontaminate, hard_negatives, html_text, language, lm_score, near_dedup, pii, positive_unlabelled, quality, spelling, token_files, tool_calls
from strophe.llm.common import fold, materialise, table, work_dir

QUERIES = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold() == 0).alias("held_out"))
    contents = language.learn(docs.where(~F.col("held_out")))
    return language.identify(docs.drop("lang"), contents).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = token_files.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return token_files.decode_documents(materialise(segments, work_dir(spark, "token_files"), "segments"))


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.apply(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


#: Of the registered queries; a job of one's own passes a secret.
KEY = "strophe-registered-query"


@query
def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY).select("doc_id", "text", "n_found")


@query
def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(*tool_calls.from_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


@query
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold() == 0).alias("held_out"))
    described = materialise(positive_unlabelled.features(docs), work_dir(spark, "quality_features"), "described")
    labels = table(spark, sf_dir, "labels").where(fold() != 0)
    model = positive_unlabelled.learn(described.where("not held_out"), positive_unlabelled.trusted_positives(labels))
    return positive_unlabelled.score(described, model).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), hard_negatives.quantise("embedding").alias("vector")), F.col("vec_id") % 50 == 0)


def _crc_entry(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


SQL["op12_spelling_variants"] = rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS w FROM documents), l AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS i, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM r),
 x AS (SELECT w, hex(encode(i || w)) AS x FROM l),
 c AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda j: CAST('0x' || substr(x, 2 * j + 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, {[_crc_entry(i) for i in range(256)]}[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM x),
 t AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM c),
 v AS MATERIALIZED (SELECT word, count(*) AS n FROM t WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
 d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
 p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.i = b.i AND a.d = b.d AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON d.d = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.d = v.word),
 q AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS near, max(n) AS near_n FROM p JOIN v ON v.word = b GROUP BY 1),
 f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM v LEFT JOIN q ON a = word),
 z AS (SELECT word, word AS o, 0 AS steps FROM f UNION ALL SELECT z.word, f.form, steps + 1 FROM z JOIN f ON f.word = z.o WHERE f.form IS NOT NULL)
SELECT f.*, root FROM f JOIN (SELECT word, arg_max(o, steps) AS root FROM z GROUP BY 1) USING (word)"""

SQL["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
 a AS (SELECT vec_id AS anchor_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v WHERE vec_id % 50 = 0), b AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v),
 s AS (SELECT anchor_id, vec_id, a.label = b.label AS alike, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM a JOIN b USING (d) GROUP BY ALL),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

SQL["op3_tool_call_linking"] = r"""
WITH RECURSIVE t AS (SELECT *, 'call:' || conv_id || ':' || turn AS call_id, CASE WHEN role = 'system' THEN 'configure' WHEN role = 'user' THEN 'reply' ELSE role END AS name FROM conversations WHERE coalesce(role, '') <> 'assistant'),
 c AS (SELECT *, '{' || concat_ws(',', '"n_chars":' || length(text), CASE WHEN name = 'reply' AND instr(text, ',') > 0 THEN '"detail":"' || substr(text, instr(text, ',') + 1) || '"' END, '"prompt":"' || text || '"', '"turn":' || turn) || '}' AS args FROM t),
 e AS (SELECT x.conv_id, x.turn AS turn, y.turn AS before FROM c x JOIN c y ON x.conv_id = y.conv_id AND CASE WHEN length(x.text) < 40 THEN y.turn = x.turn + 2 ELSE y.turn IN (x.turn - 1, x.turn - 2) END),
 reach AS (SELECT conv_id, turn, before FROM e UNION SELECT reach.conv_id, reach.turn, e.before FROM reach JOIN e ON e.conv_id = reach.conv_id AND e.turn = reach.before),
 stuck AS (SELECT DISTINCT r.conv_id, r.turn FROM reach r WHERE r.turn = r.before OR EXISTS (SELECT 1 FROM reach q WHERE q.conv_id = r.conv_id AND q.turn = r.before AND q.before = r.before)),
 lv AS (SELECT conv_id, turn, 0 AS level FROM c ANTI JOIN stuck USING (conv_id, turn) UNION SELECT e.conv_id, e.turn, lv.level + 1 FROM lv JOIN e ON e.conv_id = lv.conv_id AND e.before = lv.turn ANTI JOIN stuck s ON s.conv_id = e.conv_id AND s.turn = e.turn),
 l AS (SELECT conv_id, turn, max(level) AS level FROM lv GROUP BY 1, 2),
 p AS (SELECT c.*, l.level, json_valid(args) AS good, concat_ws('; ', CASE WHEN name = 'reply' AND instr(text, ',') = 0 THEN 'missing detail' END) AS problems FROM c LEFT JOIN l USING (conv_id, turn)),
 r AS (SELECT conv_id, 'call:' || conv_id || ':' || (turn - 1) AS call_id, min(text) AS content, count(*) AS result_copies FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
 f AS (SELECT coalesce(p.conv_id, r.conv_id) AS conv_id, coalesce(p.call_id, r.call_id) AS call_id, turn, name, level, good, text, args, CASE WHEN good THEN problems ELSE '' END AS problems, content, coalesce(result_copies, 0) AS result_copies FROM p FULL JOIN r ON p.conv_id = r.conv_id AND p.call_id = r.call_id)
SELECT conv_id, call_id, turn, name, level, CASE WHEN name IS NULL THEN 'no call' WHEN NOT good THEN 'bad arguments' WHEN problems <> '' THEN 'invalid' WHEN level IS NULL THEN 'cycle' WHEN result_copies = 0 THEN 'no result' ELSE 'linked' END AS status,
 coalesce(problems, '') AS problems, CASE WHEN name IS NULL THEN 0 ELSE 1 END AS copies, result_copies,
 '{"arguments":' || CASE WHEN good THEN '{' || concat_ws(',', '"detail":' || CAST(to_json(json_extract_string(args, '$.detail')) AS VARCHAR), '"n_chars":' || length(text), '"prompt":' || CAST(to_json(json_extract_string(args, '$.prompt')) AS VARCHAR), '"turn":' || turn) || '}' ELSE 'null' END || ',"call_id":' || CAST(to_json(call_id) AS VARCHAR) || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null')
 || ',"name":' || coalesce(CAST(to_json(name) AS VARCHAR), 'null') || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"turn":' || coalesce(CAST(turn AS VARCHAR), 'null') || '}' AS json FROM f"""

SQL["op1_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.o), m AS (SELECT d, min(o) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m ON d = doc_id LEFT JOIN n USING (doc_id)"""
