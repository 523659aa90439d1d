"""Best-fit packing by a configuration linear program.

Only the histogram of lengths reaches the driver (at most ``capacity`` bins, each in SALTS parts). The program min sum x_p,
sum_p a_pl x_p >= n_l is solved by multiplicative weights: a knapsack dynamic programme prices the best pattern under the
present length weights, and each length's weight falls with what its patterns cover. Rounding the averaged solution down and
taking its full patterns leaves a smaller program, which is solved and rounded again, for as many passes as still fix a share of
what is left. What they leave is priced on: each further pattern is the longest length left and the best knapsack beside it, fixed
as often as the counts allow, so that each uses a length up. The last hundredth goes by best fit. Pieces then find their place by their rank among the pieces of their length: ranks come from salted counts, so a length
that holds a third of all pieces is no single task's work.

Defined results: null or empty text -> a piece with the end id alone; documents with null or equal doc_id are all packed,
ordered by piece and crc; an empty table packs to nothing; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import materialise, work_dir
from strophe.llm.tokenise import encoder

SALTS = 64
#: Lengths in one knapsack; a rounded pattern's least fill; what best fit gets; the least share of what is left that a pass fixes.
PRICED, FULL, REST, GAIN = 96, 0.999, 0.01, 0.03
#: (rounds, tilt, passes) that are tried, the fewest sequences win, then those with the most from the program: more rounds give finer
#: patterns, tilt makes longer pieces worth more, more passes leave less to be priced after rounding.
TRIES = [(300, 1.02, 3), (300, 1.02, 12), (600, 1.02, 1), (300, 1.02, 1), (300, 1.1, 1)]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first, which takes what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def piece_table(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py()) + end
                rows += [(doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def price(weights: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Counts by length of a pattern of the largest total weight, none above what is left (bounded knapsack)."""
    items: list[tuple[int, int]] = []
    for length in np.flatnonzero((weights[: capacity + 1] > 0) & (left[: capacity + 1] > 0)).tolist():
        most, k = min(int(left[length]), capacity // length), 1
        while most > 0:  # binary parts of the multiplicity
            items.append((length, min(k, most)))
            most, k = most - k, 2 * k
    best, taken = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for n, (length, k) in enumerate(items):
        size = length * k
        v = best[: capacity + 1 - size] + k * weights[length]
        taken[n, size:] = v > best[size:]
        np.maximum(best[size:], v, out=best[size:])
    out, c = np.zeros(len(left), np.int64), capacity
    for n in range(len(items) - 1, -1, -1):
        if taken[n, c]:
            length, k = items[n]
            out[length] += k
            c -= length * k
    return out


def relaxed(left: np.ndarray, capacity: int, rounds: int, tilt: float, rng: np.random.Generator, eta: float = 1.0) -> list[tuple[np.ndarray, float]]:
    """The program's averaged solution: patterns and how often each is used. A round prices the PRICED dearest lengths."""
    have, covered, patterns = np.flatnonzero(left), np.zeros(len(left)), {}
    bound = max(1.0, float((left[have] * have).sum()) / capacity)
    step, used = max(1.0, bound / rounds), 0.0
    while used < bound:
        ratio = np.exp(-eta * (covered[have] / left[have] - used / bound))
        dearest = have[np.argsort(-ratio * have ** (tilt - 1) * (1 + 0.2 * rng.random(len(have))), kind="stable")[:PRICED]]
        weights = np.zeros(len(left))
        weights[have] = (have / capacity) ** tilt * ratio
        weights[np.setdiff1d(have, dearest)] = 0
        p = price(weights, left, capacity)
        patterns.setdefault(p.tobytes(), [p, 0.0])[1] += step
        covered += step * p
        used += step
    return [(p, x) for p, x in patterns.values()]


def rounded(counts: np.ndarray, capacity: int, rounds: int, tilt: float, passes: int) -> dict[str, list[tuple[np.ndarray, int]]]:
    """Patterns (counts by length) and how often each is used; together they hold exactly the given counts. By origin: 'whole'
    (pieces of full length), 'rounded' (the program), 'residual' (priced after rounding), 'rest' (best fit)."""
    left = counts.astype(np.int64).copy()
    out: dict[str, list[tuple[np.ndarray, int]]] = {"whole": [], "rounded": [], "residual": [], "rest": []}
    size, rng = np.arange(len(left)), np.random.default_rng(1)

    def fix(kind: str, p: np.ndarray, n: int) -> None:
        out[kind].append((p, n))
        np.subtract(left, n * p, out=left)

    if left[capacity]:
        fix("whole", (size == capacity).astype(np.int64), int(left[capacity]))
    total = int(left @ size)
    if not total:
        return out
    for _ in range(passes):
        before = int(left @ size)
        if before <= REST * total:
            break
        for p, x in sorted(relaxed(left, capacity, rounds, tilt, rng), key=lambda v: -int(v[0] @ size)):
            n = int(min(np.floor(x), (left[p > 0] // p[p > 0]).min())) if p.any() else 0
            if n > 0 and p @ size >= FULL * capacity:
                fix("rounded", p, n)
        if before - int(left @ size) < GAIN * before:
            break
    while int(left @ size) > REST * total:
        longest = int(np.flatnonzero(left)[-1])
        others = left[: capacity - longest + 1].copy()
        if longest < len(others):
            others[longest] -= 1
        have = np.flatnonzero(others)
        weights = np.zeros(len(others))
        if len(have) > PRICED:
            have = np.concatenate((have[-PRICED // 2 :], rng.choice(have[: -PRICED // 2], PRICED // 2, replace=False)))
        weights[have] = (have / capacity) ** tilt
        p = np.zeros(len(left), np.int64)
        p[: len(others)] = price(weights, others, capacity - longest)
        p[longest] += 1
        fix("residual", p, int((left[p > 0] // p[p > 0]).min()))
    out["rest"] = best_fit(left, capacity)
    return out


def solve(counts: np.ndarray, capacity: int) -> dict[str, list[tuple[np.ndarray, int]]]:
    """The best of TRIES; one with as few sequences as hold all tokens is the last, as there is none with fewer."""
    least, found = -(-int(counts @ np.arange(len(counts))) // capacity), []
    for t in TRIES:
        found.append(rounded(counts, capacity, *t))
        if sum(n for p in found[-1].values() for _, n in p) == least:
            break
    return min(found, key=lambda kinds: (sum(n for p in kinds.values() for _, n in p), -sum(n for _, n in kinds["rounded"])))


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """The rest: the longest first, each bin filled by the best-fitting total of what is left (subset sums as bit sets), and
    repeated while the counts allow."""
    left, out = left.copy(), []
    while left.any():
        l0 = int(np.flatnonzero(left)[-1])
        p = np.zeros(len(left), np.int64)
        p[l0] += 1
        room = capacity - l0
        rest = left.copy()
        rest[l0] -= 1
        while room > 0:
            fit = np.flatnonzero(rest[: room + 1])
            if not len(fit):
                break
            # the longest that fits, unless two lengths fill the room exactly
            pick = int(fit[-1])
            if pick < room:
                pair = fit[(rest[room - fit] > 0) & ((fit * 2 != room) | (rest[fit] > 1))]
                pick = int(pair[-1]) if len(pair) else pick
            p[pick] += 1
            rest[pick] -= 1
            room -= pick
        used = p > 0
        n = int((left[used] // p[used]).min())
        out.append((p, n))
        left -= n * p
    return out


class Slots:
    """Places of the pieces of each length by their rank, in arrays sorted by length and rank."""

    def __init__(self, patterns: list[tuple[np.ndarray, int]], starts: np.ndarray):
        """starts[length, salt]: the rank of the first piece of a salt."""
        rank: dict[int, int] = {}
        rows, sequence = [], 0
        for p, n in patterns:
            offset = 0
            for length in np.flatnonzero(p)[::-1].tolist():
                a, at = int(p[length]), rank.get(length, 0)
                rows.append((length, at, a, sequence, offset))
                rank[length] = at + a * n
                offset += a * length
            sequence += n
        self.starts = starts
        self.length, self.lo, self.a, self.sequence, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        self.span = max(rank.values(), default=0) + 1

    def place(self, length: np.ndarray, salt: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces, by their number within length and salt."""
        rank = self.starts[length, salt] + own
        at = np.searchsorted(self.length * self.span + self.lo, length * self.span + rank, side="right") - 1
        i = rank - self.lo[at]
        return self.sequence[at] + i // self.a[at], self.offset[at] + i % self.a[at] * length


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialise(piece_table(docs, tokenizer_path, capacity, end_id), work_dir(spark, "pack"), "pieces")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counts = np.zeros((capacity + 1, SALTS), np.int64)
    found = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).toArrow()  # at most capacity * SALTS rows
    counts[found["length"].to_numpy(), found["salt"].to_numpy()] = found["n"].to_numpy()
    patterns = [p for kind in solve(counts.sum(1), capacity).values() for p in kind]
    # sent to the tasks: SALTS numbers a length, and a slot for each length in each pattern, of which there are a few a length
    slots = spark.sparkContext.broadcast(Slots(patterns, np.cumsum(counts, 1) - counts))
    numbered = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = slots.value.place(*(batch.column(i).to_numpy() for i in (3, 5, 6)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[f.split()[0] for f in PLACED.split(", ")])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "salt", "own").mapInArrow(run, PLACED)
