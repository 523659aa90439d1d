"""Score tables (group, token, score): softmax, filters, draws and blends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.hashing import hash_uniform


def softmax(scores: DataFrame, group: str = "group_id", temperature: float = 1.0) -> DataFrame:
    """scores with prob: exp((score - max) / t) over its sum in the group."""
    top = scores.groupBy(group).agg(F.max("score").alias("__top"))
    e = scores.join(top, group).withColumn("__e", F.exp((F.col("score") - F.col("__top")) / temperature))
    return e.withColumn("prob", F.col("__e") / F.sum("__e").over(Window.partitionBy(group))).drop("__e", "__top")


def _renormalise(df: DataFrame, group: str) -> DataFrame:
    return df.withColumn("prob", F.col("prob") / F.sum("prob").over(Window.partitionBy(group)))


def min_p(probs: DataFrame, base: float, group: str = "group_id") -> DataFrame:
    """Tokens with prob >= base * the group's largest, renormalised."""
    top = F.max("prob").over(Window.partitionBy(group))
    return _renormalise(probs.withColumn("__top", top).where(F.col("prob") >= base * F.col("__top")).drop("__top"), group)


def nucleus_mass(probs: DataFrame, group: str = "group_id", token: str = "token_id") -> DataFrame:
    """probs with mass: the sum of larger probabilities in the group (ties by token)."""
    w = Window.partitionBy(group).orderBy(F.desc("prob"), token).rowsBetween(Window.unboundedPreceding, -1)
    return probs.withColumn("mass", F.coalesce(F.sum("prob").over(w), F.lit(0.0)))


def top_p(probs: DataFrame, p: float, group: str = "group_id", token: str = "token_id") -> DataFrame:
    """The nucleus: tokens before which at most p of the mass stands, renormalised."""
    return _renormalise(nucleus_mass(probs, group, token).where(F.round("mass", 12) <= p).drop("mass"), group)


def greedy(scores: DataFrame, group: str = "group_id", token: str = "token_id") -> DataFrame:
    """The token of the largest score; ties go to the lowest id."""
    return scores.groupBy(group).agg(F.max_by(token, F.struct("score", -F.col(token))).alias(token))


def draw(probs: DataFrame, seed, group: str = "group_id", token: str = "token_id") -> DataFrame:
    """One token a group by inverse cumulative distribution at a hash-uniform number; the last token if rounding falls short."""
    w = Window.partitionBy(group).orderBy(token)
    cdf = probs.withColumn("__c", F.round(F.sum("prob").over(w.rowsBetween(Window.unboundedPreceding, 0)), 12))
    hit = cdf.withColumn("__hit", F.col("__c") >= F.round(hash_uniform(seed, F.col(group)), 12))
    return hit.groupBy(group).agg(F.coalesce(F.min(F.when(F.col("__hit"), F.col(token))), F.max(token)).alias(token))


def guidance(step: int, gamma: float, n: int, limit: int = 250) -> float:
    """The guidance weight: it rises over min(limit, n) steps and then stays at gamma."""
    return min(gamma, step / min(limit, n) * gamma)


def guided_blend(a: DataFrame, b: DataFrame, weight: float, group: str = "group_id", token: str = "token_id", forbidden: int | None = None) -> DataFrame:
    """weight * a + (1 - weight) * b; the forbidden token's score is minus infinity."""
    d = a.join(b.select(group, token, F.col("score").alias("__b")), [group, token])
    blend = weight * F.col("score") + (1 - weight) * F.col("__b")
    if forbidden is not None:
        blend = F.when(F.col(token) == forbidden, F.lit(float("-inf"))).otherwise(blend)
    return d.withColumn("score", blend).drop("__b")


def cross_entropy(logits: DataFrame, targets: DataFrame, keys: list[str], token: str = "class_id", ignored: int = 0) -> DataFrame:
    """(keys, loss): log-sum-exp less the target's logit; 0 where the target is the ignored id. targets(keys, token)."""
    top = logits.groupBy(*keys).agg(F.max("logit").alias("top"))
    lse = logits.join(top, keys).groupBy(*keys).agg((F.max("top") + F.log(F.sum(F.exp(F.col("logit") - F.col("top"))))).alias("lse"))
    own = logits.join(targets, [*keys, token]).select(*keys, token, F.col("logit").alias("own"))
    return own.join(lse, keys).select(*keys, F.when(F.col(token) == ignored, 0.0).otherwise(F.col("lse") - F.col("own")).alias("loss"))


