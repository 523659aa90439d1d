"""Hard-negative mining by exact scores of anchors against all rows.

Vectors of whole numbers are packed into bit planes: plane b of eight components is one byte. For an anchor, a table of 256
sums for each eight components holds the sum of the anchor's components whose bits are set in a byte (the Four-Russians method);
a candidate's score is the sum, over planes and groups of eight, of the entries that its bytes pick, shifted by the plane and
negative in the plane of the sign. The scores are the full inner products.

Anchors go out in pages of at most ``page`` rows (8 MB at 64 components), each page in two passes over the packed
candidates: its positives, then its negatives. A task holds one batch of candidates and the best rows of each anchor;
what is shuffled is those rows, never the pairs. Each page's rows are written in the shared folder before the next begins.

Defined results: rows whose id, label or vector is null, or with a null or non-finite component, take no part; a shorter vector
counts as filled up with zeros; of rows with one id the least by label, then vector, takes part; ties of scores go to
the smaller id; no rows, no anchors or no other rows give no rows; scores that may pass 2**62 are an error. Only the
three columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import materialise, shuffle_parts, work_dir

#: Candidates and anchors of one score block: 2,048 x 128 numbers.
ROWS, ANCHORS = 2048, 128
NONE = np.int64(-(2**63))


def quantise(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null where a component is null or not finite."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(good, F.transform(x, lambda v: F.floor(v * scale)))


def bit_planes(vectors: np.ndarray, bits: int) -> np.ndarray:
    """(rows, components) whole numbers -> (bits, rows, components / 8) bytes; the last plane is the sign's."""
    return np.stack([np.packbits(((vectors >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)])


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(anchors, 8 g components) -> (g, 256, anchors): the sum of each subset of each eight components."""
    parts = anchors.T.reshape(-1, 8, len(anchors))
    out = np.zeros((len(parts), 256, len(anchors)), anchors.dtype)
    for i in range(8):
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] + parts[:, i : i + 1]
    return out


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products: table entries picked by the planes' bytes, from the sign's plane down, doubled at each."""
    total = None
    for b in range(len(planes) - 1, -1, -1):
        picked = sums[0].take(planes[b, :, 0], axis=0)
        for g in range(1, len(sums)):
            picked += sums[g].take(planes[b, :, g], axis=0)
        total = -picked if total is None else (total << 1) + picked
    return total


def best(score: np.ndarray, open_: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k, anchors) scores and ids of the open rows of the highest scores, in no order; ids rise with the rows, so that of equal
    scores the first rows are taken. Places that stay empty have the score NONE."""
    n = len(score)
    rank = np.where(open_, score.astype(np.int64) * n + np.arange(n - 1, -1, -1)[:, None], NONE)
    at = np.argpartition(rank, n - k, axis=0)[n - k :] if n > k else np.broadcast_to(np.arange(n)[:, None], rank.shape)
    found = np.where(np.take_along_axis(open_, at, 0), np.take_along_axis(score, at, 0).astype(np.int64), NONE)
    return found, ids[at]


def merge(a: tuple, b: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    score, ids = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.lexsort((ids, -np.maximum(score, -(2**62))), axis=0)[:k]
    return np.take_along_axis(score, order, 0), np.take_along_axis(ids, order, 0)


class Miner:
    """The best rows of a page of anchors, over the batches of candidates that a task sees."""

    def __init__(self, page: dict, k: int):
        self.page, self.k = page, k
        slots = 1 if page["low"] is None else page["low"].shape[0]
        self.kept = [(np.full((k, len(page["ids"])), NONE), np.zeros((k, len(page["ids"])), np.int64)) for _ in range(slots)]

    def add(self, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, labels, planes = ids[order], labels[order], planes[:, order]
        p = self.page
        for at in range(0, len(p["ids"]), ANCHORS):
            own = slice(at, at + ANCHORS)
            sums = subset_sums(p["vectors"][own])
            for r in range(0, len(ids), ROWS):
                rows = slice(r, r + ROWS)
                score = scores(planes[:, rows], sums)
                alike = labels[rows, None] == p["labels"][None, own]
                for slot, held in enumerate(self.kept):
                    if p["low"] is None:
                        fits = alike & (ids[rows, None] != p["ids"][None, own])
                    else:
                        fits = ~alike & (score >= p["low"][slot, own]) & (score <= p["high"][slot, own])
                    if fits.any():
                        held[0][:, own], held[1][:, own] = merge((held[0][:, own], held[1][:, own]), best(score, fits, ids[rows], self.k), self.k)

    def rows(self) -> tuple[np.ndarray, ...]:
        """(anchor id, slot, candidate id, score)"""
        out = []
        for slot, (score, ids) in enumerate(self.kept):
            at, anchor = np.nonzero(score != NONE)
            out.append((self.page["ids"][anchor], np.full(len(at), slot), ids[at, anchor], score[at, anchor]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _mined(packed: DataFrame, page: dict, bits: int, k: int) -> DataFrame:
    """(anchor_id, slot, id, score): of each task's rows the k best, and of those the k best over all."""
    sent = packed.sparkSession.sparkContext.broadcast(page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        miner = Miner(sent.value, k)
        for batch in batches:
            if batch.num_rows:
                raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, bits, -1)
                miner.add(batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.ascontiguousarray(raw.transpose(1, 0, 2)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in miner.rows()], names=["anchor_id", "slot", "id", "score"])

    part = packed.mapInArrow(run, "anchor_id long, slot long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id"))
    return part.withColumn("place", place).where(F.col("place") <= k)


def mine(rows: DataFrame, anchor: Column, ident: str = "vec_id", label: str = "label", vector: str = "vector", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, page: int = 16_384) -> DataFrame:
    """rows(ident, label, vector of whole numbers) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which ``anchor``, a condition on ident, holds; an anchor's positives are its best other rows of its label. For
    each of them the best rows of other labels with low * positive <= 100 * negative <= high * positive are its negatives."""
    spark, folder = rows.sparkSession, work_dir(rows.sparkSession, "hard_negatives")
    named = rows.select(F.col(ident).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("v"), anchor.alias("anchor"))
    valid = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    one = valid.repartition(shuffle_parts(spark), "id").groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.*")
    whole = materialise(one, folder, "rows")
    ends = whole.agg(F.max(F.size("v")).alias("size"), F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not ends["size"]:
        return spark.createDataFrame([], schema)
    most = max(-ends["lo"], ends["hi"], 1)
    if ends["size"] * most * most * ROWS >= 2**62:
        raise ValueError("scores may pass 2**62")
    bits, width = max(-ends["lo"] - 1, ends["hi"], 0).bit_length() + 1, -(-ends["size"] // 8) * 8
    kind = np.int32 if ends["size"] * most * 2**bits < 2**31 else np.int64

    def dense(vectors: list, dtype=np.int64) -> np.ndarray:
        out = np.zeros((len(vectors), width), dtype)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = bit_planes(dense([v.values.to_numpy() for v in batch.column(2)]), bits).transpose(1, 0, 2).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p.tobytes() for p in planes], pa.binary())], names=["id", "label", "planes"])

    packed = materialise(whole.select("id", "label", "v").mapInArrow(pack, "id long, label long, planes binary"), folder, "packed")
    anchors, last, pages = whole.where("anchor").select("id", "label", "v"), None, 0
    while True:
        taken = (anchors if last is None else anchors.where(F.col("id") > last)).orderBy("id").limit(page).collect()  # at most a page
        if not taken:
            break
        ids = np.array([r["id"] for r in taken])
        sent = {"ids": ids, "labels": np.array([r["label"] for r in taken]), "vectors": dense([r["v"] for r in taken], kind), "low": None}
        good = _mined(packed, sent, bits, positives).collect()  # at most positives * page
        # slots whose bounds cross take nothing: those of positives that are not there, and of negative scores
        bounds = {"low": np.ones((positives, len(ids)), np.int64), "high": np.zeros((positives, len(ids)), np.int64)}
        for r in good:
            at, score = int(np.searchsorted(ids, r["anchor_id"])), r["score"]
            bounds["low"][r["place"] - 1, at], bounds["high"][r["place"] - 1, at] = -(-low * score // 100), high * score // 100
        found = _mined(packed, sent | bounds, bits, negatives)
        chosen = spark.createDataFrame([(r["anchor_id"], r["place"] - 1, r["id"], r["score"]) for r in good], "anchor_id long, slot long, positive_id long, positive_score long")
        out = found.join(F.broadcast(chosen), ["anchor_id", "slot"])
        out.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("overwrite").parquet(f"{folder}/mined/page={pages:06d}")
        last, pages = int(ids[-1]), pages + 1
    return spark.read.schema(f"{schema}, page int").parquet(f"{folder}/mined").drop("page") if pages else spark.createDataFrame([], schema)
