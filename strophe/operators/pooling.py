"""Pooling of vectors and similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def _mean(df: DataFrame, keys: list[str], vector: str = "emb", weight: Column | None = None) -> DataFrame:
    """(keys, vector): weighted mean of vectors of one size, summed up before the one shuffle. A null vector counts as none, and so
    does one of weight 0; a key without any has no row."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.where(F.col(vector).isNotNull()).select(*keys, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"), w.alias("w")).where("w > 0")
    return rows.groupBy(*keys).agg(Summarizer.mean(F.col("v"), F.col("w")).alias("m")).select(*keys, vector_to_array("m").alias(vector))


def mean_embedding(slices: DataFrame, key: str, order: str) -> DataFrame:
    """slices(key, order, seq, emb, metadata) -> (key, seqs in order, emb mean, metadata of the first)."""
    info = slices.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "seq"))).alias("x"), F.min_by("metadata", order).alias("metadata"))
    return info.select(key, F.transform("x", lambda s: s["seq"]).alias("seqs"), "metadata").join(_mean(slices, [key]), key)


def masked_mean(tokens: DataFrame, key: str, mask: str = "mask", vector: str = "emb") -> DataFrame:
    """Mean of the vectors of token rows whose mask is set."""
    return _mean(tokens.where(F.col(mask)), [key], vector)


def last_valid(tokens: DataFrame, key: str, pos: str, valid: str, vector: str = "emb") -> DataFrame:
    """The vector of the last valid token."""
    return tokens.where(F.col(valid)).groupBy(key).agg(F.max_by(vector, pos).alias(vector))


def at_end_token(tokens: DataFrame, ends: DataFrame, key: str, pos: str, vector: str = "emb") -> DataFrame:
    """The vector at each sequence's end token; ends(key, pos)."""
    return tokens.join(ends, [key, pos]).select(key, vector)


def weighted_mean(segments: DataFrame, key: str, weight: str, vector: str = "emb") -> DataFrame:
    """Mean of segment vectors, weighted by their lengths."""
    return _mean(segments, [key], vector, F.col(weight))


def chunk_mean(chunks: DataFrame, key: str, vector: str = "emb") -> DataFrame:
    return _mean(chunks, [key], vector)


#: Most vectors of a side in one matrix.
BLOCK = 256


def _blocks(rows: DataFrame, batch: str, ident: str, vector: str, side: str) -> DataFrame:
    """(batch, side): the vectors of a batch in arrays of at most BLOCK, one shuffle by batch."""
    place = F.row_number().over(Window.partitionBy(batch).orderBy("id")) - 1
    own = rows.select(F.col(batch), F.col(ident).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    numbered = own.where(F.col(batch).isNotNull()).withColumn("__block", (place / BLOCK).cast("int"))
    return numbered.groupBy(batch, "__block").agg(F.collect_list(F.struct("id", "v")).alias(side)).drop("__block")


def _matrix(rows: pa.StructScalar) -> tuple[pa.Array, np.ndarray]:
    """The ids of a block, and its vectors of length 1 as a matrix; a row of NaN for a null vector, one with nulls and one of length 0."""
    ids, vectors = rows.values.field("id"), rows.values.field("v")
    held, sizes = vectors.is_valid().to_numpy(zero_copy_only=False), pc.unique(pc.list_value_length(vectors.drop_null())).to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of sizes {sizes} in one batch")
    out = np.full((len(ids), sizes[0] if sizes else 0), np.nan)
    out[held] = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(held.sum(), -1) if sizes else out[held]
    with np.errstate(divide="ignore", invalid="ignore"):
        return ids, out / np.sqrt((out * out).sum(1, keepdims=True))


def _products(rows: DataFrame, batch: str, ident: str, view: str, vector: str, each: Callable[[pa.Array, pa.Array, np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
    """(batch, columns of each) for every block of view-0 rows with every block of view-1 rows of a batch: ``each`` gets both sides'
    ids and the matrix of their cosines, NaN where there is none."""
    a, b = (_blocks(rows.where(F.col(view) == i), batch, ident, vector, "ab"[i]) for i in (0, 1))
    key = rows.schema[batch]
    names = [key.name, *(f.name for f in StructType.fromDDL(schema))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                (i, x), (j, y) = _matrix(part.column(1)[k]), _matrix(part.column(2)[k])
                if x.shape[1] and y.shape[1] and x.shape[1] != y.shape[1]:
                    raise ValueError(f"vectors of sizes {[x.shape[1], y.shape[1]]} in one batch")
                cosines = x @ y.T if x.shape[1] and y.shape[1] else np.full((len(i), len(j)), np.nan)
                columns = each(i, j, cosines)
                yield pa.RecordBatch.from_arrays([pa.repeat(part.column(0)[k], len(columns[0])), *columns], names=names)

    # both sides are already dealt out by batch
    return a.join(b.hint("merge"), batch).select(batch, "a", "b").mapInArrow(run, StructType([StructField(key.name, key.dataType), *StructType.fromDDL(schema)]))


def pairs_in_batch(rows: DataFrame, batch: str, ident: str, view: str, vector: str = "emb") -> DataFrame:
    """(batch, i, j, similarity): cosine of every view-0 row with every view-1 row of its batch, as products of blocks of unit vectors.
    Batches bound the pairs: a batch holds what a model takes at once. Null for a null vector, one of length 0 and one with nulls; rows
    without a batch have no pairs; repeated ids are paired each. Vectors of several sizes in a batch are an error."""

    def each(i: pa.Array, j: pa.Array, cosines: np.ndarray) -> list[pa.Array]:
        n, m = cosines.shape
        return [i.take(pa.array(np.repeat(np.arange(n), m))), j.take(pa.array(np.tile(np.arange(m), n))), pa.array(cosines.ravel(), from_pandas=True)]

    kind = rows.schema[ident].dataType.simpleString()
    return _products(rows, batch, ident, view, vector, each, f"i {kind}, j {kind}, similarity double")


def contrastive_loss(similarities: DataFrame, batch: str, temperature: float = 0.1) -> DataFrame:
    """(batch, loss): mean of the cross-entropies over rows and over columns of the similarity matrix / temperature; the pair of
    equal ids is the target."""
    s = similarities.withColumn("z", F.col("similarity") / temperature)

    def side(own: str) -> DataFrame:
        top = s.groupBy(batch, own).agg(F.max("z").alias("top"))
        lse = s.join(top, [batch, own]).groupBy(batch, own).agg((F.max("top") + F.log(F.sum(F.exp(F.col("z") - F.col("top"))))).alias("lse"), F.max(F.when(F.col("i") == F.col("j"), F.col("z"))).alias("t"))
        return lse.groupBy(batch).agg(F.avg(F.col("lse") - F.col("t")).alias(own))

    return side("i").join(side("j"), batch).select(batch, ((F.col("i") + F.col("j")) / 2).alias("loss"))


def batch_contrastive_loss(rows: DataFrame, batch: str, ident: str, view: str, vector: str = "emb", temperature: float = 0.1) -> DataFrame:
    """``contrastive_loss`` of the rows of ``pairs_in_batch`` without their pairs. Each block product leaves its rows' and columns' greatest value, their sum of exponentials below it and
    the target. A row or column without a partner of its id does not count, nor does a pair without a cosine;
    an id must be unique in its view. A batch without any target has a null loss."""

    def side(ids: pa.Array, others: pa.Array, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = np.where(np.isnan(z), -np.inf, z)
        top = known.max(1)
        with np.errstate(invalid="ignore"):
            total = np.where(np.isinf(top), 0.0, np.exp(known - np.where(np.isinf(top), 0.0, top)[:, None]).sum(1))
        at = pc.index_in(ids, value_set=others, skip_nulls=True)
        met = at.is_valid().to_numpy(zero_copy_only=False)
        target = np.full(len(ids), np.nan)
        target[met] = z[met, at.drop_null().to_numpy()]
        return top, total, target

    def each(i: pa.Array, j: pa.Array, cosines: np.ndarray) -> list[pa.Array]:
        both = [side(i, j, cosines / temperature), side(j, i, cosines.T / temperature)]
        numbers = [pa.array(np.concatenate(x), from_pandas=True) for x in zip(*both, strict=True)]
        return [pa.array(np.repeat([0, 1], [len(i), len(j)]).astype(np.int32)), pa.concat_arrays([i, j]), *numbers]

    kind = rows.schema[ident].dataType.simpleString()
    parts = _products(rows, batch, ident, view, vector, each, f"side int, id {kind}, top double, total double, target double")
    merged = parts.where("total > 0").groupBy(batch, "side", "id").agg(F.max("top").alias("most"), F.collect_list(F.struct("top", "total")).alias("p"), F.max("target").alias("target"))
    lse = F.col("most") + F.log(F.aggregate("p", F.lit(0.0), lambda s, x: s + x["total"] * F.exp(x["top"] - F.col("most"))))
    loss = merged.select(batch, "side", (lse - F.col("target")).alias("loss"))
    means = [F.avg(F.when(F.col("side") == i, F.col("loss"))) for i in (0, 1)]
    return loss.groupBy(batch).agg(((means[0] + means[1]) / 2).alias("loss"))
