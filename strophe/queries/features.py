"""Vectors, similarity, score tables, probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions import arrays as a
from strophe.operators import embed, metrics, pooling, probe, scores
from strophe.queries import digest, digest_sql, op
from strophe.queries.corpus import TOKENS, U

LONG = "lg AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings)"
HASHED = "md5(string_agg(CAST(CAST(round(m * 1000, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY dim))"


def first3(v: str = "emb"):
    return [F.round(F.col(v)[i], 6).alias(f"e{i}") for i in range(3)]


E3 = "CAST(round(max(m) FILTER (dim = 0), 6) AS DOUBLE) AS e0, CAST(round(max(m) FILTER (dim = 1), 6) AS DOUBLE) AS e1, CAST(round(max(m) FILTER (dim = 2), 6) AS DOUBLE) AS e2"


@op("a05_mean_embedding", f"WITH {LONG}, m AS (SELECT vec_id // 5 AS path, dim, avg(CAST(x AS DOUBLE)) AS m FROM lg GROUP BY 1, 2), i AS (SELECT vec_id // 5 AS path, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS seqs, min_by(label, vec_id) AS label FROM embeddings GROUP BY 1) SELECT path, any_value(seqs) AS seqs, any_value(label) AS label, {E3}, {HASHED} AS hash FROM m JOIN i USING (path) GROUP BY 1")
def a05(t):
    s = t("embeddings").select(F.expr("vec_id div 5").alias("path"), "vec_id", F.col("vec_id").cast("string").alias("seq"), F.col("embedding").alias("emb"), F.col("label").alias("metadata"))
    return pooling.mean_embedding(s, "path", "vec_id").select("path", F.array_join("seqs", ",").alias("seqs"), F.col("metadata").alias("label"), *first3(), digest().alias("hash"))


@op("a06_masked_mean", f"WITH {LONG}, m AS (SELECT vec_id // 5 AS id, dim, avg(CAST(x AS DOUBLE)) AS m FROM lg WHERE label % 2 = 0 GROUP BY 1, 2) SELECT id, {E3}, {HASHED} AS hash FROM m GROUP BY 1")
def a06(t):
    d = t("embeddings").select(F.expr("vec_id div 5").alias("id"), F.col("embedding").alias("emb"), (F.col("label") % 2 == 0).alias("mask"))
    return pooling.masked_mean(d, "id").select("id", *first3(), digest().alias("hash"))


@op("a07_last_valid", f"WITH r AS (SELECT vec_id // 5 AS id, embedding, row_number() OVER (PARTITION BY vec_id // 5 ORDER BY vec_id DESC) AS rn FROM embeddings WHERE label < 6) SELECT id, CAST(round(CAST(embedding[1] AS DOUBLE), 6) AS DOUBLE) AS e0, {digest_sql('embedding')} AS hash FROM r WHERE rn = 1")
def a07(t):
    d = t("embeddings").select(F.expr("vec_id div 5").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("emb"), (F.col("label") < 6).alias("valid"))
    return pooling.last_valid(d, "id", "pos", "valid").select("id", F.round(F.col("emb")[0].cast("double"), 6).alias("e0"), digest().alias("hash"))


@op("a07_at_end_token", f"WITH e AS (SELECT vec_id // 5 AS id, min(vec_id) AS pos FROM embeddings WHERE label = 3 GROUP BY 1) SELECT id, CAST(round(CAST(embedding[1] AS DOUBLE), 6) AS DOUBLE) AS e0, {digest_sql('embedding')} AS hash FROM e JOIN embeddings ON vec_id = pos")
def a07e(t):
    d = t("embeddings").select(F.expr("vec_id div 5").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("emb"), "label")
    ends = d.where("label = 3").groupBy("id").agg(F.min("pos").alias("pos"))
    return pooling.at_end_token(d, ends, "id", "pos").select("id", F.round(F.col("emb")[0].cast("double"), 6).alias("e0"), digest().alias("hash"))


@op("a08_weighted_mean", f"WITH {LONG}, m AS (SELECT vec_id // 5 AS id, dim, sum(CAST(x AS DOUBLE) * (label + 1)) / sum(label + 1) AS m FROM lg GROUP BY 1, 2) SELECT id, {E3}, {HASHED} AS hash FROM m GROUP BY 1")
def a08(t):
    d = t("embeddings").select(F.expr("vec_id div 5").alias("id"), F.col("embedding").alias("emb"), (F.col("label") + 1).alias("n"))
    return pooling.weighted_mean(d, "id", "n").select("id", *first3(), digest().alias("hash"))


@op("a09_chunk_mean", f"WITH {LONG}, m AS (SELECT vec_id % 37 AS piece_id, dim, avg(CAST(x AS DOUBLE)) AS m FROM lg GROUP BY 1, 2) SELECT piece_id, {E3}, {HASHED} AS hash FROM m GROUP BY 1")
def a09(t):
    return pooling.chunk_mean(t("embeddings").select((F.col("vec_id") % 37).alias("piece_id"), F.col("embedding").alias("emb")), "piece_id").select("piece_id", *first3(), digest().alias("hash"))


VIEWS = "SELECT vec_id // 2 AS id, vec_id // 2 // 16 AS batch, vec_id % 2 AS view, embedding FROM embeddings"
SIM = f"vw AS ({VIEWS}), sim AS (SELECT a.batch, a.id AS i, b.id AS j, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM vw a JOIN vw b ON a.batch = b.batch AND a.view = 0 AND b.view = 1)"


def views(t):
    return t("embeddings").select(F.expr("vec_id div 2").alias("id"), F.expr("vec_id div 2 div 16").alias("batch"), (F.col("vec_id") % 2).alias("view"), F.col("embedding").alias("emb"))


@op("j07_pairs_in_batch", f"WITH {SIM} SELECT batch, i, j, CAST(round(s, 6) AS DOUBLE) AS similarity FROM sim")
def j07(t):
    return pooling.pairs_in_batch(views(t), "batch", "id", "view").withColumn("similarity", F.round("similarity", 6))


@op("x35_contrastive_loss", f"WITH {SIM}, z AS (SELECT batch, i, j, s / 0.1 AS z FROM sim), r AS (SELECT batch, i, ln(sum(exp(z))) - max(z) FILTER (i = j) AS l FROM z GROUP BY 1, 2), c AS (SELECT batch, j, ln(sum(exp(z))) - max(z) FILTER (i = j) AS l FROM z GROUP BY 1, 2) SELECT batch, CAST(round((a.l + b.l) / 2, 6) AS DOUBLE) AS loss FROM (SELECT batch, avg(l) AS l FROM r GROUP BY 1) a JOIN (SELECT batch, avg(l) AS l FROM c GROUP BY 1) b USING (batch)")
def x35(t):
    return pooling.batch_contrastive_loss(views(t), "batch", "id", "view").withColumn("loss", F.round("loss", 6))


@op("x29_l2_normalise", f"WITH n AS (SELECT vec_id, embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS l FROM embeddings) SELECT vec_id, CAST(round(embedding[1] / l, 6) AS DOUBLE) AS e0, CAST(round(embedding[2] / l, 6) AS DOUBLE) AS e1, {digest_sql('list_transform(embedding, lambda y: y / l)')} AS hash FROM n")
def x29(t):
    v = a.l2_normalise(F.col("embedding"))
    return t("embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.col("v")[0].cast("double"), 6).alias("e0"), F.round(F.col("v")[1].cast("double"), 6).alias("e1"), digest("v").alias("hash"))


# score table: one group for each order, the lines' quantities as scores of their line numbers
SCORES = "sc AS (SELECT l_orderkey AS group_id, l_linenumber AS token_id, max(l_quantity) / 10 AS score FROM lineitem GROUP BY 1, 2)"
PROBS = f"{SCORES}, ex AS (SELECT *, exp((score - max(score) OVER (PARTITION BY group_id)) / 0.7) AS e FROM sc), pr AS (SELECT group_id, token_id, e / sum(e) OVER (PARTITION BY group_id) AS prob FROM ex)"


def score_table(t):
    return t("lineitem").groupBy(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("token_id")).agg((F.max("l_quantity") / 10).alias("score"))


def probs(t):
    return scores.softmax(score_table(t), temperature=0.7)


@op("x30_softmax", f"WITH {PROBS} SELECT group_id, token_id, CAST(round(prob, 6) AS DOUBLE) AS prob FROM pr")
def x30(t):
    return probs(t).select("group_id", "token_id", F.round("prob", 6).alias("prob"))


@op("x31_min_p", f"WITH {PROBS}, k AS (SELECT * FROM (SELECT *, max(prob) OVER (PARTITION BY group_id) AS m FROM pr) WHERE prob >= 0.1 * m) SELECT group_id, token_id, CAST(round(prob / sum(prob) OVER (PARTITION BY group_id), 6) AS DOUBLE) AS prob FROM k")
def x31(t):
    return scores.min_p(probs(t), 0.1).select("group_id", "token_id", F.round("prob", 6).alias("prob"))


MASS = f"{PROBS}, ms AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY group_id ORDER BY prob DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mass FROM pr)"


@op("w09_nucleus_mass", f"WITH {MASS} SELECT group_id, token_id, CAST(round(mass, 6) AS DOUBLE) AS mass FROM ms")
def w09(t):
    return scores.nucleus_mass(probs(t)).select("group_id", "token_id", F.round("mass", 6).alias("mass"))


@op("x32_top_p", f"WITH {MASS} SELECT group_id, token_id, CAST(round(prob / sum(prob) OVER (PARTITION BY group_id), 6) AS DOUBLE) AS prob FROM ms WHERE round(mass, 12) <= 0.9")
def x32(t):
    return scores.top_p(probs(t), 0.9).select("group_id", "token_id", F.round("prob", 6).alias("prob"))


@op("o04_greedy", f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, token_id) AS rn FROM sc) SELECT group_id, token_id FROM r WHERE rn = 1")
def o04(t):
    return scores.greedy(score_table(t))


@op("o11_weighted_draw", f"WITH {PROBS}, c AS (SELECT *, round(sum(prob) OVER (PARTITION BY group_id ORDER BY token_id), 12) AS c, round({U.format(seed=13, key='group_id')} / 4294967296.0, 12) AS u FROM pr) SELECT group_id, coalesce(min(token_id) FILTER (c >= u), max(token_id)) AS token_id FROM c GROUP BY 1")
def o11(t):
    return scores.draw(probs(t), 13)


@op("x33_guided_blend", f"WITH {SCORES}, b AS (SELECT l_orderkey AS group_id, l_linenumber AS token_id, max(l_discount) AS d FROM lineitem GROUP BY 1, 2) SELECT group_id, token_id, CASE WHEN token_id = 7 THEN NULL ELSE CAST(round(0.6 * score + 0.4 * d, 6) AS DOUBLE) END AS score FROM sc JOIN b USING (group_id, token_id)")
def x33(t):
    other = t("lineitem").groupBy(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("token_id")).agg(F.max("l_discount").alias("score"))
    d = scores.guided_blend(score_table(t), other, scores.guidance(50, 3.0, 1000), forbidden=7)
    return d.select("group_id", "token_id", F.when(F.col("score") > float("-inf"), F.round("score", 6)).alias("score"))


@op("x34_cross_entropy", f"WITH {SCORES}, z AS (SELECT group_id, ln(sum(exp(score))) AS lse FROM sc GROUP BY 1), g AS (SELECT group_id, max(token_id) AS k FROM sc GROUP BY 1) SELECT group_id, k AS class_id, CASE WHEN k = 1 THEN 0.0 ELSE CAST(round(lse - score, 6) AS DOUBLE) END AS loss FROM g JOIN z USING (group_id) JOIN sc ON sc.group_id = g.group_id AND sc.token_id = k")
def x34(t):
    logits = score_table(t).select("group_id", F.col("token_id").alias("class_id"), F.col("score").alias("logit"))
    targets = logits.groupBy("group_id").agg(F.max("class_id").alias("class_id"))
    d = scores.cross_entropy(logits, targets, ["group_id"], ignored=1)
    return targets.join(d, "group_id").select("group_id", "class_id", F.round("loss", 6).alias("loss"))


@op("h01_embed", f"WITH t AS (SELECT doc_id, {TOKENS} AS tok FROM documents), w AS (SELECT doc_id, len(tok) AS n, CAST('0x' || substr(md5(unnest(tok)), 1, 8) AS BIGINT) % 16 AS b FROM t) SELECT doc_id, CAST(round(count(*) FILTER (b = 0) / max(n), 6) AS DOUBLE) AS e0, CAST(round(count(*) FILTER (b = 1) / max(n), 6) AS DOUBLE) AS e1, CAST(round(count(*) FILTER (b = 2) / max(n), 6) AS DOUBLE) AS e2, {digest_sql('list_transform(range(0, 16), lambda i: len(list_filter(list(b), lambda y: y = i)) / max(n))')} AS hash FROM w GROUP BY 1")
def h01(t):
    d = t("documents").select("doc_id", a.tokens_of(F.col("text")).alias("seq"))
    return d.select("doc_id", embed.hashed_bag(F.col("seq")).alias("emb")).select("doc_id", *first3(), digest().alias("hash"))


def _length_model():
    """An example hook: sequence length and mean token length."""
    return lambda batch: [[float(len(s)), sum(map(len, s)) / max(1, len(s))] for s in batch]


@op("h01_embed_hook", f"WITH t AS (SELECT doc_id, {TOKENS} AS tok FROM documents) SELECT doc_id, len(tok) AS n_tokens FROM t")
def h01h(t):
    d = embed.embed(t("documents").select("doc_id", a.tokens_of(F.col("text")).alias("seq")), _length_model)
    return d.select("doc_id", F.col("emb")[0].cast("long").alias("n_tokens"))


CLASSES = "(SELECT max(label) FROM embeddings WHERE vec_id % 5 <> 0)"
#: The fit by accelerated descent, 300 steps from zero: at each, a row a class with its weights and, last, its intercept.
FIT = f"""d AS (SELECT vec_id, CAST(label AS INT) AS label, list_append(CAST(embedding AS DOUBLE[]), 1.0) AS x FROM embeddings WHERE vec_id % 5 <> 0 AND label IS NOT NULL AND embedding IS NOT NULL),
 cl AS (SELECT list(col ORDER BY j) AS cols, any_value(n) AS n FROM (SELECT j, list(v ORDER BY vec_id) AS col, CAST(count(*) AS DOUBLE) AS n FROM (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM d) GROUP BY j)),
 it AS (SELECT 0 AS k, CAST(c AS INT) AS c, list_transform(cols, lambda z: 0.0::DOUBLE) AS w, list_transform(cols, lambda z: 0.0::DOUBLE) AS v FROM cl, (SELECT unnest(range(0, {CLASSES} + 1)) AS c)
 UNION ALL SELECT k + 1, c, new, list_transform(new, lambda z, i: z + 0.8 * (z - w[i])) FROM (SELECT k, c, w, list_transform(v, lambda z, i: z - 1.2 * (list_dot_product(r, cols[i]) / n + CASE WHEN i < len(v) THEN 0.01 * z ELSE 0 END)) AS new FROM
 (SELECT k, c, w, v, list(p - (label = c)::INT ORDER BY vec_id) AS r FROM (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM (SELECT k, c, w, v, vec_id, label, list_dot_product(v, x) AS z FROM it, d WHERE k < 300)) GROUP BY k, c, w, v), cl)),
 fit AS (SELECT c, w FROM it WHERE k = 300)"""
SCORED = f"""WITH RECURSIVE {FIT}, pr AS (SELECT CAST(label AS INT) AS true_id, arg_max(c, z) AS pred_id FROM (SELECT vec_id, label, c, list_dot_product(w, list_append(CAST(embedding AS DOUBLE[]), 1.0)) AS z FROM embeddings, fit WHERE vec_id % 5 = 0) GROUP BY vec_id, label),
 tg AS (SELECT DISTINCT CAST(label AS INT) AS tag_id FROM embeddings), cn AS (SELECT tag_id, count(*) FILTER (true_id = tag_id AND pred_id = tag_id) AS tp, count(*) FILTER (true_id <> tag_id AND pred_id = tag_id) AS fp, count(*) FILTER (true_id = tag_id AND pred_id <> tag_id) AS fn FROM tg, pr GROUP BY 1),
 q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM cn)
 SELECT tag_id, tp, fp, fn, tp + fn AS support, CAST(round(p, 6) AS DOUBLE) AS precision, CAST(round(r, 6) AS DOUBLE) AS recall, CAST(round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS DOUBLE) AS f1 FROM q"""


def shown_report(d):
    return d.select(F.col("tag_id").cast("int").alias("tag_id"), "tp", "fp", "fn", "support", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


def _probe(t):
    d = t("embeddings").select("vec_id", F.col("embedding").alias("emb"), "label")
    return d, probe.fit_probe(d.where("vec_id % 5 <> 0"))


@op("p01_fit_probe", f"WITH RECURSIVE {FIT} SELECT c AS class, CAST(generate_subscripts(w, 1) - 1 AS INT) AS place, CAST(round(unnest(w), 5) AS DOUBLE) AS weight FROM fit")
def p01(t):
    """The weights of every class, and at the last place its intercept."""
    _, model = _probe(t)
    rows = [(c, [*map(float, w), float(b)]) for c, (w, b) in enumerate(zip(model.weights, model.intercepts, strict=True))]
    return t.spark.createDataFrame(rows, "class int, w array<double>").select("class", F.posexplode("w").alias("place", "weight")).withColumn("weight", F.round("weight", 5))


@op("p02_score_probe", SCORED)
def p02(t):
    d, model = _probe(t)
    pairs = probe.score_probe(model, d.where("vec_id % 5 = 0")).select(F.col("label").cast("int").alias("true_id"), "pred_id")
    return shown_report(metrics.classification_report(pairs, d.select(F.col("label").cast("int").alias("tag_id")).distinct()))
