"""The linear probe: a multinomial softmax on vectors, fitted to its optimum."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most numbers of a second derivative, (classes * (dimensions + 1)) squared: 256 MB on the driver.
LARGEST = 2**25


@dataclass(frozen=True)
class Probe:
    """weights[class][dimension], intercepts[class], and the largest component of the gradient where the fit ended."""

    weights: np.ndarray
    intercepts: np.ndarray
    gradient: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sums(rows: DataFrame, theta: np.ndarray) -> dict[int, np.ndarray]:
    """One pass: by part, sums over all rows. Part -1 is n, the log loss and its gradient; part i the i-th block of the second
    derivative, of the i-th pair of classes. A partition makes one row a part; these are added up in 64 groups and then together."""
    classes, width = theta.shape
    pairs = [(a, b) for a in range(classes) for b in range(a, classes)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, blocks = np.zeros(2 + classes * width), np.zeros((len(pairs), width * width))
        for part in parts:
            x = np.column_stack([np.stack(part["x"].to_numpy()).astype(float), np.ones(len(part))])
            y = part["y"].to_numpy()
            p = softmax(x @ theta.T)
            first[0] += len(part)
            first[1] -= np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
            wrong = p.copy()
            wrong[np.arange(len(y)), y] -= 1
            first[2:] += (wrong.T @ x).ravel()
            for i, (a, b) in enumerate(pairs):
                blocks[i] += (x.T @ (x * (p[:, a] * ((a == b) - p[:, b]))[:, None])).ravel()
        if first[0]:
            yield pd.DataFrame({"part": [-1], "v": [first]})
            for i, block in enumerate(blocks):
                yield pd.DataFrame({"part": [i], "v": [block]})

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    own = rows.mapInPandas(run, "part int, v array<double>").select("part", (F.spark_partition_id() % 64).alias("g"), array_to_vector("v").alias("v"))
    some = own.groupBy("part", "g").agg(Summarizer.sum(F.col("v")).alias("v"))
    return {r["part"]: np.array(r["v"]) for r in some.groupBy("part").agg(Summarizer.sum(F.col("v")).alias("v")).select("part", vector_to_array("v").alias("v")).collect()}


def fit_probe(train: DataFrame, features: str = "emb", label: str = "label", penalty: float = 0.01, most_passes: int = 50, enough: float = 1e-12) -> Probe:
    """The least mean log loss plus penalty / 2 times the sum of the squared weights (intercepts are free, and sum to zero), by
    Newton's method from zero; a step that does not lessen the loss is halved. Each step is one pass over the rows, of which some
    six are needed; labels are whole numbers from 0. Rows without a label or vector take no part; vectors of several sizes, no rows,
    or more than LARGEST second derivatives are errors."""
    rows = train.select(F.col(features).alias("x"), F.col(label).cast("long").alias("y")).where("x is not null and y is not null")
    seen = rows.agg(F.max("y").alias("top"), F.min("y").alias("low"), F.max(F.size("x")).alias("d"), F.min(F.size("x")).alias("least")).first()
    if seen["top"] is None or seen["low"] < 0 or seen["d"] != seen["least"]:
        raise ValueError(f"a probe takes rows with labels from 0 and vectors of one size, not {seen}")
    classes, width = seen["top"] + 1, seen["d"] + 1
    if (classes * width) ** 2 > LARGEST:
        raise ValueError(f"{classes} classes of {width - 1} dimensions have too many second derivatives")
    held = np.tile(np.append(np.full(width - 1, penalty), 0.0), classes)
    # adding a number to all intercepts changes nothing; this keeps their sum at zero
    free = np.zeros(width * classes)
    free[width - 1 :: width] = 1
    theta, step, best = np.zeros(classes * width), None, np.inf
    largest = np.inf
    for _ in range(most_passes):
        got = _sums(rows, theta.reshape(classes, width))
        n, loss = got[-1][0], got[-1][1] / got[-1][0] + (held * theta**2).sum() / 2
        gradient = got[-1][2:] / n + held * theta
        if step is not None and not loss <= best + 1e-13 * max(1.0, abs(best)):
            step = step / 2
            theta = theta - step
            continue
        best, largest = loss, float(np.abs(gradient).max())
        if largest <= enough:
            break
        second = np.diag(held) + np.outer(free, free)
        i = 0
        for a in range(classes):
            for b in range(a, classes):
                block = got[i].reshape(width, width) / n
                second[a * width : (a + 1) * width, b * width : (b + 1) * width] += block
                if a != b:
                    second[b * width : (b + 1) * width, a * width : (a + 1) * width] += block.T
                i += 1
        step = -np.linalg.lstsq(second, gradient, rcond=None)[0]
        theta = theta + step
    table = theta.reshape(classes, width)
    return Probe(table[:, :-1].copy(), table[:, -1].copy(), largest)


def score_probe(probe: Probe, rows: DataFrame, features: str = "emb") -> DataFrame:
    """rows with prob (of every class) and pred_id; ties go to the lowest class, a null vector has nulls."""
    weights, intercepts = probe.weights, probe.intercepts

    @F.pandas_udf("array<double>")
    def prob(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        known = vectors.notna().to_numpy()
        if known.any():
            p = softmax(np.stack(vectors[known].to_numpy()).astype(float) @ weights.T + intercepts)
            out.loc[known] = pd.Series(list(p), index=out.index[known])
        return out

    d = rows.withColumn("prob", prob(features))
    return d.withColumn("pred_id", (F.array_position("prob", F.array_max("prob")) - 1).cast("int"))
