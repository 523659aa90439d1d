"""A quality classifier by positive-unlabelled learning: trusted positives against unlabelled web text.

A document is a vector: one-hot bins of STATS figures of its text (repetition, case, signs, lengths, lines) and the shares of pairs of
neighbouring character classes. For a linear scorer z with the squared loss l(z, y) = (z - y)^2 / 4, the non-negative risk

    prior * E_P[l(z, 1)] + max(0, E_U[l(z, -1)] - prior * E_P[l(z, -1)])

depends on the data through the means of x and xx' over the positives P and the unlabelled rows U alone. So Spark sums these over
all training rows, a matrix of fixed size a task, in two levels; and the driver finds the exact minimum: max(0, r) is the maximum of
m * r over m from 0 to 1, for each m the risk is a convex quadratic, and m is found by bisection. The class prior is estimated on all rows too,
from the histograms of a first scorer: the least ratio, over the thresholds, of the unlabelled rows above to the positives above, with
the confidence bound that keeps thin tails out (the best-bin estimate). The score is (z + 1) / 2, cut to 0 to 1.

Defined results: null text counts as empty, which is scored as well; a document is a trusted positive if all its labels are 1, other labels say nothing;
repeated rows count again and are scored alike; a null doc_id has no label; without positives, or without unlabelled rows, every score is 0.5; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import materialise, work_dir

#: Figures of a text, bins of each, classes of characters.
STATS, BINS, CLASSES = 20, 12, 12
WIDTH = STATS * BINS + CLASSES * CLASSES + 1
SCORE_BINS = 1000
#: Partial sums that reach the driver, each of WIDTH**2 numbers.
PARTIALS = 16


def _classes() -> bytes:
    """UTF-8 byte -> class: lower case and all beyond ASCII, upper case, digits, blank, line end, end signs, inner signs, quotes and
    brackets, bars and arrows, money and mail signs, marks, control bytes."""
    table = bytearray(256)
    kinds = ["", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".?!", ",;:-", "\"'()[]{}", "|<>/\\=+~", "$%&@", "#*^_`"]
    for n, kind in enumerate(kinds):
        for c in kind.encode():
            table[c] = n
    for c in [*range(9), 11, 12, *range(14, 32), 127]:
        table[c] = 11
    return bytes(table)


CLASS = _classes()


def _bin(part: float, whole: float) -> int:
    """Bin of a share from 0 to 1, finer near both ends; the last bin where there is no whole."""
    if not whole:
        return BINS - 1
    x = min(1.0, part / whole)
    low = min(x, 1 - x)
    step = 0 if low <= 0 else 1 if low < 0.01 else 2 if low < 0.05 else 3 if low < 0.15 else 4 if low < 0.3 else 5
    return step if x < 0.5 else 10 - step


def _size(n: float) -> int:
    return min(BINS - 1, int(n).bit_length())


def describe(text: str | None) -> bytes:
    """STATS bins, then the square roots of the class pairs' shares in steps of 1/255."""
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, chars = len(words), len(raw) - sum(map(raw.count, b" \t\n\x0b\x0c\r"))
    kinds = np.frombuffer(raw.translate(CLASS), np.uint8)
    count = np.bincount(kinds, minlength=CLASSES)
    distinct: dict[bytes, int] = {}
    ids = [distinct.setdefault(w, len(distinct)) for w in words]
    at = np.array(ids, np.int64)
    most = int(np.bincount(at).max()) if n else 0
    doubled = int((at[1:] == at[:-1]).sum()) if n > 1 else 0
    threes = len(np.unique((at[2:] * n + at[1:-1]) * n + at[:-2])) if n > 2 else 0
    short = sum(len(w) < 4 for w in distinct)
    stats = (
        _size(len(raw)), _size(n), _size(len(lines)), _size(2 * chars / n if n else 0), _size(2 * n / len(lines) if lines else 0),
        _bin(len(distinct), n), _bin(most, n), _bin(doubled, n - 1), _bin(threes, n - 2), _bin(len(set(lines)), len(lines)),
        _bin(count[0], chars), _bin(count[1], chars), _bin(count[2], chars), _bin(int(count[5:].sum()), chars), _bin(int(count[8:].sum()), chars),
        _bin(raw.count(b"!!"), n), _bin(sum(x.rstrip()[-1:] in b".?!" for x in lines), len(lines)), _bin(sum(b"http" in x or b"www" in x for x in lines), len(lines)),
        _bin(short, len(distinct)), _bin(sum(w[:1].isupper() for w in distinct), len(distinct)),
    )
    pairs = np.bincount(kinds[:-1].astype(np.int64) * CLASSES + kinds[1:], minlength=CLASSES * CLASSES) if len(kinds) > 1 else np.zeros(CLASSES * CLASSES)
    shares = np.rint(255 * np.sqrt(pairs / max(1, len(kinds) - 1))).astype(np.uint8)
    return bytes(stats) + shares.tobytes()


def vectors(described: list[bytes]) -> np.ndarray:
    """(rows, WIDTH), the last component 1."""
    raw = np.frombuffer(b"".join(described), np.uint8).reshape(len(described), STATS + CLASSES * CLASSES)
    out = np.zeros((len(raw), WIDTH))
    out[np.arange(len(raw))[:, None], np.arange(STATS) * BINS + raw[:, :STATS]] = 1
    out[:, STATS * BINS : -1] = raw[:, STATS:] / 255
    out[:, -1] = 1
    return out


def features(docs: DataFrame) -> DataFrame:
    """docs with x, in place of text."""
    others = [c for c in docs.columns if c not in ("text", "x")]
    rows = docs.select(*others, F.col("text").cast("string").alias("text"))
    schema = docs.select(*others).withColumn("x", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([describe(t.as_py()) for t in batch.column(len(others))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], x], names=[*others, "x"])

    return rows.mapInArrow(run, schema)


def _summed(rows: DataFrame, shape: tuple[int, ...], of) -> np.ndarray:
    """The sum of ``of(x)``, an array of the shape, over all rows: one array a task, added up in PARTIALS tasks and on the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                total += of(vectors(batch.column(0).slice(i, 4096).to_pylist()))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([int(total.flat[-1]) % PARTIALS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sum"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for batch in batches:
            for x in batch.column(1):
                total += np.frombuffer(x.as_py()).reshape(shape)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sum"])

    out = np.zeros(shape)
    for r in rows.select("x").mapInArrow(partial, "slot int, sum binary").repartition(PARTIALS).mapInArrow(add, "slot int, sum binary").collect():
        out += np.frombuffer(bytes(r["sum"])).reshape(shape)
    return out


def moments(rows: DataFrame) -> np.ndarray:
    """The sum of xx'; as x ends in 1, its last row is the sum of x and its last number the count."""
    return _summed(rows, (WIDTH, WIDTH), lambda x: x.T @ x)


def histogram(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Rows by SCORE_BINS bins of their score, and their number."""

    def of(x: np.ndarray) -> np.ndarray:
        at = np.minimum((SCORE_BINS * score_of(x, weights)).astype(np.int64), SCORE_BINS - 1)
        return np.append(np.bincount(at, minlength=SCORE_BINS), len(x)).astype(float)

    return _summed(rows, (SCORE_BINS + 1,), of)[:-1]


def score_of(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip((x @ weights + 1) / 2, 0, 1)


def fit(p: np.ndarray, u: np.ndarray, prior: float, ridge: float) -> np.ndarray:
    """The weights of the least non-negative risk plus ridge * |w|^2, from the means of xx' over positives and unlabelled rows.

    r(w) = E_U[l(z, -1)] - prior * E_P[l(z, -1)] may fall below 0 only where the fit is too close; then its weight m falls below 1."""
    side = np.full(WIDTH, ridge)
    side[-1] = 0.0

    def least(m: float) -> np.ndarray:
        # prior * E_P[(z - 1)^2 / 4] + m * (E_U[(z + 1)^2 / 4] - prior * E_P[(z + 1)^2 / 4])
        a = (prior * (1 - m) * p + m * u) / 4 + np.diag(side + 1e-9)
        b = (prior * (1 + m) * p[-1] - m * u[-1]) / 4
        return np.linalg.solve(a, b)

    def rest(w: np.ndarray) -> float:
        return (w @ u @ w + 2 * u[-1] @ w + 1 - prior * (w @ p @ w + 2 * p[-1] @ w + 1)) / 4

    w = least(1.0)
    if rest(w) >= 0:  # the unbiased risk's minimum is the non-negative one's
        return w
    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        if rest(least(mid)) < 0:
            high = mid
        else:
            low = mid
    return least(high)


def best_bin_prior(p: np.ndarray, u: np.ndarray, confidence: float = 0.1) -> float:
    """From histograms of scores: the unlabelled share above a threshold by the positives' share above it, at the threshold where that and the widths of
    both shares' confidence bounds are least."""
    n_p, n_u = p.sum(), u.sum()
    above_p, above_u = np.cumsum(p[::-1]) / n_p, np.cumsum(u[::-1]) / n_u
    width = np.sqrt(np.log(4 / confidence) / (2 * n_p)) + np.sqrt(np.log(4 / confidence) / (2 * n_u))
    some = above_p > 0
    bound = (above_u[some] + width) / above_p[some]
    at = int(np.argmin(bound))
    return float(np.clip(above_u[some][at] / above_p[some][at], 0.01, 0.99))


@dataclass
class Model:
    weights: np.ndarray
    prior: float


def learn(described: DataFrame, positives: DataFrame, strength: float = 3.0) -> Model:
    """described(doc_id, x) are the unlabelled rows; positives(doc_id) the trusted ones among them, each once. The ridge is
    ``strength`` by the number of positives, and 1e-4."""
    spark, folder = described.sparkSession, work_dir(described.sparkSession, "positive_unlabelled")
    trusted = materialise(described.select("doc_id", "x").join(positives.select("doc_id").hint("merge"), "doc_id", "left_semi"), folder, "positives")
    p, u = moments(trusted), moments(described)
    if not p[-1, -1] or not u[-1, -1]:
        return Model(np.zeros(WIDTH), 0.5)
    ridge = 1e-4 + strength / p[-1, -1]
    p, u = p / p[-1, -1], u / u[-1, -1]
    first = fit(p, u, 0.5, ridge)
    prior = best_bin_prior(histogram(trusted, first), histogram(described, first))
    return Model(fit(p, u, prior, ridge), prior)


def score(described: DataFrame, model: Model) -> DataFrame:
    """described(..., x) with score in place of x."""
    sent = described.sparkSession.sparkContext.broadcast(model.weights)
    others = [c for c in described.columns if c not in ("x", "score")]
    schema = described.select(*others).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(others)).to_pylist()
            parts = [score_of(vectors(x[i : i + 4096]), sent.value) for i in range(0, len(x), 4096)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=[*others, "score"])

    return described.select(*others, "x").mapInArrow(run, schema)


def trusted_positives(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality) -> (doc_id) of those that have label 1 and no other."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = 1 and hi = 1").select("doc_id")
