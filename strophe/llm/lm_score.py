"""Language-model scores of whole texts: a log-bilinear neural model, trained by noise-contrastive estimation.

Spark counts every word of all training texts. Each of the VOCABULARY most frequent words that occur twice or more is a unit of
the model, with a context vector, a target vector and a bias of its own; the words outside it are units by their ending. The
vectors of the two units before a token, each through its own matrix, add up to a predicted vector. Its products with the target
vectors plus biases are normalised in two levels, as the vocabulary is large: over CLASSES groups of units, and over the units
of the group. A word outside the vocabulary then takes its smoothed share of its unit's count, with one unknown word a unit, so
the probabilities over all words sum to one.

Training reads every run of three tokens of the training texts: in each of ROUNDS rounds, on a share of the texts, every task
takes steps of noise-contrastive estimation on its own runs, at both levels, and Spark averages the rows of the tasks' parameters,
weighted by how often each was used. Every run is drawn, whatever the corpus; small ones are gone through repeatedly, for some
LEAST_DRAWS draws. Scoring multiplies in batches.

Word counts: the most frequent words, ``head`` at most (a documented bound) besides the words that are classes, go to the
tasks, the rest is joined by word; if more than ``head`` words share the largest counts, all others are joined.

Tokens: A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+``, then one end token. base_score sums log10((c+0.5)/(N+0.5(V+1))).

Defined results: null, empty or blank text -> the end token alone; a null doc_id counts as '' for its fold; repeated rows each
count and are each scored; no training text -> all words unknown, the classes equally likely; an empty table gives no rows;
only doc_id and text are read.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import fold, materialise, work_dir

END = b" "  # no word holds white space
VOCABULARY = 8_192
ENDINGS, REST = 56, 8  # units of the words outside the vocabulary: by a frequent ending, by a hash of it
SINGLES, CLASSES = 64, 128  # the most frequent units are groups of their own, the others are cut into CLASSES - SINGLES groups
BEGIN = 0  # the context that stands before a text; unit u is the context u + 1
SIZE, NOISE, BATCH, BUFFER = 16, 64, 1024, 1 << 17
PART, AT_ONCE = 128, 1 << 19
ROUNDS, LEAST_DRAWS = 4, 2_000_000  # each run is drawn once or more
KEPT = 200_000
PIECE = 1 << 22  # bytes of texts that a task cuts in words at a time
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Units(dict):
    """word -> unit: words of the vocabulary have their own, others one by their last two bytes; ``place`` renumbers them."""

    def __init__(self, vocabulary: list[bytes], endings: list[bytes], place: list[int] | None = None):
        self.place = list(range(len(vocabulary) + ENDINGS + REST)) if place is None else place
        super().__init__(zip(vocabulary, self.place, strict=False))
        self.first = len(vocabulary)
        self.endings = {e: self.place[self.first + i] for i, e in enumerate(endings)}

    def __missing__(self, word: bytes) -> int:
        u = self.endings.get(word[-2:])
        if u is None:
            u = self.place[self.first + ENDINGS + zlib.crc32(word[-2:]) % REST]
        if len(self) < KEPT:
            self[word] = u
        return u


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, the sums of their values, their numbers."""
    order = np.argsort(rows.astype(np.uint16) if rows.max() < 1 << 16 else rows, kind="stable")
    own = rows[order]
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return own[starts], np.add.reduceat(values.take(order, axis=0), starts, axis=0), np.diff(np.append(starts, len(own)))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b by PART rows: products so small are left to one thread, where a second one of the task's core would only wait."""
    if len(a) <= PART:
        return a @ b
    out, whole = np.empty((len(a), b.shape[1]), np.float32), len(a) // PART * PART
    np.matmul(a[:whole].reshape(-1, PART, a.shape[1]), b, out=out[:whole].reshape(-1, PART, b.shape[1]))
    np.matmul(a[whole:], b, out=out[whole:])
    return out


def _product_over_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b likewise."""
    if len(a) <= PART:
        return a.T @ b
    whole = len(a) // PART * PART
    parts = np.matmul(a[:whole].reshape(-1, PART, a.shape[1]).transpose(0, 2, 1), b[:whole].reshape(-1, PART, b.shape[1]))
    return parts.sum(0) + a[whole:].T @ b[whole:]


class LogBilinear:
    """Units in falling order of their unigram. All parameters are rows of one table, so that tasks' tables can be averaged by row:
    a vector and a bias each of the contexts, the groups and the units, then the two matrices; ``seen`` has the rows' AdaGrad sums."""

    def __init__(self, unigram: np.ndarray, size: int = SIZE, seed: int = 3):
        rng = np.random.default_rng(seed)
        n = len(unigram)
        wide = max(1, -(-(n - SINGLES) // (CLASSES - SINGLES)))
        self.starts = np.append(np.arange(min(n, SINGLES)), np.arange(SINGLES, n, wide)).astype(np.int64)
        self.ends = np.append(self.starts[1:], n)
        self.group = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)
        share = np.add.reduceat(unigram, self.starts) / unigram.sum()
        within = unigram / unigram.sum() / share[self.group]
        self.log_q = np.log(np.concatenate((share, within))).astype(np.float32)
        self.units, self.groups = n + 1, len(self.starts)
        self.rows = rng.normal(0, 0.1, (self.units + self.groups + n + 2 * size, size + 1)).astype(np.float32)
        self.rows[: self.units, size] = 0
        self.rows[self.units : self.units + len(self.log_q), size] = self.log_q
        self.rows[-2 * size :] = np.concatenate((np.eye(size, size + 1), np.eye(size, size + 1) * 0.5))
        self.seen = np.full(len(self.rows), 0.01, np.float32)
        self.used = np.zeros(len(self.rows), np.int64)  # by all tasks, in training
        self.size = size

    def train(self, runs: np.ndarray, counts: np.ndarray, unigram: np.ndarray, steps: int, batch: int = BATCH, seed: int = 5) -> np.ndarray:
        """Noise-contrastive estimation on runs (context two before, context before, unit), each drawn in proportion to its count:
        by blocks, the groups in mixed batches, then the units in batches of a group. Returns how often each row was used."""
        used = np.zeros(len(self.rows), np.int64)
        if not len(runs):
            return used
        rng = np.random.default_rng(seed)
        upto = np.cumsum(counts, dtype=np.float64)
        drawn = np.searchsorted(upto, (np.arange(steps * batch) + 0.5) * (upto[-1] / (steps * batch)), "right")
        rng.shuffle(drawn)
        few = max(1, batch // 8)  # a group has a small part of the runs
        mass = np.concatenate(([0.0], np.cumsum(unigram, dtype=np.float64)))
        for i in range(0, len(drawn), BUFFER):
            block = runs.take(drawn[i : i + BUFFER], axis=0).astype(np.int32)
            group = self.group[block[:, 2]]
            for j in range(0, len(block), batch):
                noise = self.group[np.minimum(np.searchsorted(mass, rng.random(NOISE) * mass[-1], "right") - 1, len(unigram) - 1)]
                self._step(block[j : j + batch, 0], block[j : j + batch, 1], group[j : j + batch], noise, used)
            order = np.argsort(group.astype(np.uint8), kind="stable")
            cuts = np.searchsorted(group[order], np.arange(self.groups + 1))
            for g in rng.permutation(self.groups):
                first, end = self.starts[g], self.ends[g]
                if end - first > 1:  # a group of one unit has nothing to tell apart
                    for j in range(cuts[g], cuts[g + 1], few):
                        own = block.take(order[j : min(j + few, cuts[g + 1])], axis=0)
                        noise = np.searchsorted(mass, mass[first] + rng.random(NOISE) * (mass[end] - mass[first]), "right") - 1
                        self._step(own[:, 0], own[:, 1], own[:, 2] + self.groups, np.clip(noise, first, end - 1) + self.groups, used)
        return used

    def _step(self, far: np.ndarray, near: np.ndarray, own: np.ndarray, noise: np.ndarray, used: np.ndarray, rate: float = 0.1) -> None:
        """One step of AdaGrad by rows: the own targets against noise that the batch shares."""
        size, n = self.size, len(own)
        target, at = self.rows[self.units : -2 * size], np.concatenate((near, far))
        r = np.ascontiguousarray(self.rows.take(at, axis=0)[:, :size])
        r1, r2, m1, m2 = r[:n], r[n:], self.rows[-2 * size : -size, :size], self.rows[-size:, :size]
        predicted = np.ones((n, size + 1), np.float32)
        predicted[:, :size] = _product(r1, m1)
        predicted[:, :size] += _product(r2, m2)
        log_k = np.float32(math.log(len(noise)))
        q, drawn = target.take(own, axis=0), target.take(noise, axis=0)
        up_own = 1 / (1 + np.exp(np.minimum(np.einsum("nd,nd->n", predicted, q) - self.log_q[own] - log_k, 30)))
        down = _product(predicted, -drawn.T)  # in place from here: -1 / (1 + exp(-(score - log(k q))))
        down += self.log_q[noise] + log_k
        np.exp(np.minimum(down, 30, out=down), out=down)
        down += 1
        np.divide(-1, down, out=down)
        up = up_own[:, None] * q
        up += _product(down, drawn)
        up = np.ascontiguousarray(up[:, :size])
        context = np.zeros((2 * n, size + 1), np.float32)
        context[:n, :size], context[n:, :size] = _product(up, m1.T), _product(up, m2.T)
        both = np.zeros((2 * size, size + 1), np.float32)
        both[:size, :size], both[size:, :size] = _product_over_rows(r1, up), _product_over_rows(r2, up)
        for rows, g, times in (
            _by_row(np.concatenate((own, noise)) + self.units, np.concatenate((up_own[:, None] * predicted, _product_over_rows(down, predicted)))),
            _by_row(at, context),
            (slice(len(self.rows) - 2 * size, None), both, n),
        ):
            seen = self.seen[rows] + np.einsum("nd,nd->n", g, g) / np.float32(size + 1)
            self.seen[rows] = seen
            g *= (rate / np.sqrt(seen))[:, None]
            g += self.rows[rows] if isinstance(rows, slice) else self.rows.take(rows, axis=0)
            self.rows[rows] = g
            used[rows] += times

    def log10(self, far: np.ndarray, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of units: the group's among the groups, the unit's among those of its group. Equal contexts
        are predicted, and normalised over the groups, once."""
        size = self.size
        if not hasattr(self, "sides"):
            self.sides = [_product(np.ascontiguousarray(self.rows[: self.units, :size]), m) for m in (self.rows[-2 * size : -size, :size], self.rows[-size:, :size])]
        rows, group = self.rows[self.units :], self.group[target]
        contexts, context = _distinct(far.astype(np.int64) * self.units + near)
        predicted = self.sides[0].take(contexts % self.units, axis=0) + self.sides[1].take(contexts // self.units, axis=0)
        out = _own(predicted, context, rows, group) - _log_sum(predicted, rows[: self.groups])[context]
        order = np.argsort(group.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(group[order], np.arange(self.groups + 1))
        for g in range(self.groups):
            if cuts[g] < cuts[g + 1] and self.ends[g] - self.starts[g] > 1:
                at, first = order[cuts[g] : cuts[g + 1]], self.groups + self.starts[g]
                out[at] += _own(predicted, context[at], rows, self.groups + target[at]) - _log_sum(predicted.take(context[at], axis=0), rows[first : self.groups + self.ends[g]])
        return out / math.log(10)


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, and the place of each code among them."""
    found = pa.array(codes).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _own(predicted: np.ndarray, at: np.ndarray, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The product of a predicted vector and a row, with the row's bias, for each pair of them."""
    r = rows.take(own, axis=0)
    return np.einsum("nd,nd->n", predicted.take(at, axis=0), r[:, :-1]).astype(np.float64) + r[:, -1]


def _log_sum(predicted: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logs of the sums of the exponentials of all rows' products; as many products at once as stay in the cache."""
    out = np.empty(len(predicted))
    vectors, bias = np.ascontiguousarray(rows[:, :-1].T), np.ascontiguousarray(rows[:, -1])
    step = max(PART, (1 << 17) // len(rows) // PART * PART)
    for i in range(0, len(predicted), step):
        s = _product(predicted[i : i + step], vectors)
        s += bias
        top = np.float32(0)
        if s.max() > 60 or s.min() < -60:  # else no sum overflows or vanishes
            top = s.max(1)
            s -= top[:, None]
        out[i : i + step] = np.log(np.exp(s, out=s).sum(1).astype(np.float64)) + top
    return out


def _coded(texts: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Some MB of texts at a time: the first one's place, the distinct words, END first, the codes of all tokens, the texts' numbers of tokens."""
    step = max(1, len(texts) * PIECE // max(texts.nbytes, 1))
    for i in range(0, len(texts), step):
        # copied, as Arrow's ascii_lower misplaces the strings of a slice
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts[i : i + step].to_pylist()], pa.large_string())))
        flat, holder = split.flatten(), pc.list_parent_indices(split).to_numpy()
        some = pc.not_equal(flat, "")  # white space before and after a text leaves empty words
        flat, holder = flat.filter(some).dictionary_encode(), holder[some.to_numpy(zero_copy_only=False)]
        sizes = np.bincount(holder, minlength=len(split)) + 1
        codes, last = np.zeros(sizes.sum(), np.int64), np.cumsum(sizes) - 1
        codes[np.delete(np.arange(len(codes)), last)] = flat.indices.to_numpy() + 1
        yield i, pa.concat_arrays([pa.array([END], pa.large_binary()), flat.dictionary.cast(pa.large_binary())]), codes, sizes


def word_counts(train: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, distinct, codes, _ in _coded(batch.column(0)):
                yield pa.RecordBatch.from_arrays([distinct.cast(pa.binary()), pa.array(np.bincount(codes, minlength=len(distinct)))], names=["word", "n"])

    return train.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _by_task(df: DataFrame, fill, size: int) -> DataFrame:
    """Dense counts that each task adds up over its batches, as (code, n) rows of what is not 0, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.int64)
        for batch in batches:
            fill(own, batch)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own[at])], names=["code", "n"])

    return df.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coded texts, one or more: the contexts two before and one before each unit, the units, the texts' starts."""
    texts = column.to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) // 2
    unit = np.frombuffer(b"".join(texts), np.uint16).astype(np.int32)
    starts = np.cumsum(sizes) - sizes
    near = np.concatenate(([BEGIN], unit[:-1] + 1), dtype=np.int32, casting="unsafe")
    near[starts] = BEGIN
    far = np.concatenate(([BEGIN], near[:-1]), dtype=np.int32, casting="unsafe")
    far[starts] = BEGIN
    return far, near, unit, starts


def fit(train: DataFrame, model: LogBilinear, unigram: np.ndarray, n_all: int) -> LogBilinear:
    """ROUNDS rounds of training in the tasks, each on its share of train(doc_id, units); the tables have few rows, whatever the corpus."""
    spark, wide = train.sparkSession, model.size + 2
    passes = max(1.0, min(LEAST_DRAWS / max(n_all, 1), 300.0))
    names = ["row", "used", *(f"d{i}" for i in range(wide))]
    types = [pa.int32(), pa.int64(), *[pa.float32()] * wide]
    for r in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model, unigram))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, r=r) -> Iterator[pa.RecordBatch]:
            model, unigram = sent.value
            model = copy.deepcopy(model)
            before = np.hstack((model.rows, model.seen[:, None]))
            used, buffer, held = np.zeros(len(model.rows), np.int64), [], 0

            def learn() -> None:
                nonlocal held
                runs = np.concatenate(buffer)
                batch = min(BATCH, max(64, len(runs) // 16))
                used[:] += model.train(runs, np.ones(len(runs)), unigram, math.ceil(len(runs) * passes / batch), batch, seed=5 + r)
                buffer.clear()
                held = 0

            for batch in batches:
                if not batch.num_rows:
                    continue
                runs = np.stack(_runs(batch.column(0))[:3], axis=1)
                for i in range(0, len(runs), BUFFER):
                    buffer.append(runs[i : i + BUFFER])
                    held += len(buffer[-1])
                    if held >= BUFFER:
                        learn()
            if held:
                learn()
            at = np.flatnonzero(used)
            moved = (np.hstack((model.rows, model.seen[:, None])) - before)[at] * used[at, None].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(used[at]), *(pa.array(np.ascontiguousarray(m)) for m in moved.T)], schema=pa.schema(list(zip(names, types, strict=True))))

        share = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == r).select("units")
        moved = share.mapInArrow(run, ", ".join(["row int", "used long", *(f"{n} float" for n in names[2:])]))
        moved = moved.groupBy("row").agg(*(F.sum(n).alias(n) for n in names[1:])).toArrow()
        at, used = moved["row"].to_numpy(), moved["used"].to_numpy()
        mean = np.stack([moved[n].to_numpy() for n in names[2:]], axis=1) / used[:, None] if len(at) else np.zeros((0, wide))
        model.used[at] += used
        model.rows[at] += mean[:, :-1].astype(np.float32)
        model.seen[at] += mean[:, -1].astype(np.float32)
        sent.unpersist()
    return model


def score(docs: DataFrame, fold_out: int = 1, head: int = 100_000) -> DataFrame:
    spark = docs.sparkSession
    folder = work_dir(spark, "lm")
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (fold() == fold_out).alias("held_out"))
    train = source.where(~F.col("held_out"))
    counts = materialise(word_counts(train), folder, "counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(total["n"] or 0), int(total["v"])

    # the head: words of at least that count by which no more than `head` words are taken; bars are exact below 10,000 and
    # intervals of four leading digits above, so that they stay few
    digits = F.pow(F.lit(10), F.greatest(F.length(F.col("n").cast("string")) - 4, F.lit(0))).cast("long")
    bars = {r["bar"]: r["k"] for r in counts.groupBy((F.col("n") - F.col("n") % digits).alias("bar")).agg(F.count("*").alias("k")).collect()}  # at most 9,000 rows a decade
    least, taken = n_all + 1, 0  # no count is larger: all words are joined if none is taken
    for bar in sorted(bars, reverse=True):
        if taken + bars[bar] > head:
            break
        least, taken = bar, taken + bars[bar]
    top = counts.where(F.col("n") >= least).toArrow()
    known = dict(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True))
    del top
    # the words with vectors of their own, whether or not the head holds any: of the bars that reach their number
    lowest, taken = 2, 0
    for bar in sorted(bars, reverse=True):
        taken += bars[bar]
        if taken >= VOCABULARY:
            lowest = max(bar, 2)
            break
    most = {bytes(r["word"]): r["n"] for r in counts.where(F.col("n") >= lowest).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()}
    vocabulary = list(most)
    known |= most
    own = spark.sparkContext.broadcast(frozenset(vocabulary))

    def ending_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w not in own.value:
                    sums[w[-2:]] += n  # at most 65,792 endings
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], names=["e", "n"])

    endings = counts.select("word", "n").mapInArrow(ending_sums, "e binary, n long").groupBy("e").agg(F.sum("n").alias("n"))
    endings = [bytes(r["e"]) for r in endings.orderBy(F.desc("n"), "e").limit(ENDINGS).collect()]
    size = len(vocabulary) + ENDINGS + REST

    def unit_sums(sums: np.ndarray, batch: pa.RecordBatch) -> None:
        u = Units(vocabulary, endings)
        at = np.fromiter((u[w] for w in batch.column(0).to_pylist()), np.int64, batch.num_rows)
        sums[:size] += np.bincount(at, batch.column(1).to_numpy(), size).astype(np.int64)
        sums[size:] += np.bincount(at, minlength=size)

    sums = np.zeros(2 * size, np.int64)
    found = _by_task(counts, unit_sums, 2 * size).toArrow()
    sums[found["code"].to_numpy()] = found["n"].to_numpy()
    order = np.argsort(-sums[:size], kind="stable")  # units in falling order of their tokens
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    in_unit, kinds = sums[:size][order], sums[size:][order]
    units = (vocabulary, endings, place.tolist())
    unigram = (in_unit + 1.0) / (in_unit + 1.0).sum()
    spread = np.where(order < len(vocabulary), 0.0, np.log10(in_unit + 0.5 * (kinds + 1)))  # of a unit's words; a word of the vocabulary is its unit
    base = math.log10(n_all + 0.5 * (v_all + 1))
    logs = {w: math.log10(n + 0.5) for w, n in known.items()}
    sent = spark.sparkContext.broadcast((logs, units))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, units = sent.value
        u, row = Units(*units), TaskContext.get().partitionId() << 40
        alone = set(units[0])
        for batch in batches:
            for first, distinct, codes, sizes in _coded(batch.column(1)):
                names = distinct.to_pylist()
                unit = np.fromiter(map(u.__getitem__, names), np.uint16, len(names))[codes]
                log = np.fromiter((logs.get(w, np.nan) for w in names), np.float64, len(names))
                found = ~np.isnan(log)
                shared = np.where(np.fromiter((w in alone for w in names), bool, len(names)) | ~found, 0.0, log)
                starts = np.cumsum(sizes) - sizes
                k, b, s = (np.add.reduceat(x[codes], starts) for x in (found.astype(np.int64), np.where(found, log, 0.0), shared))
                # the words that are not known here, with their numbers in each text
                at = np.flatnonzero(~found[codes])
                pairs, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes)[at] * len(names) + codes[at], return_counts=True)
                cuts = pa.array(np.searchsorted(pairs, np.arange(len(sizes) + 1) * len(names)).astype(np.int32))
                tails = pa.ListArray.from_arrays(cuts, distinct.take(pa.array(pairs % len(names))).cast(pa.binary()))
                n, data = len(sizes), unit.tobytes()
                columns = {
                    "row": pa.array(np.arange(row, row + n)), "doc_id": batch.column(0)[first : first + n], "held_out": batch.column(2)[first : first + n], "n_tokens": pa.array(sizes), "known": pa.array(k),
                    "base": pa.array(b - sizes * base), "score": pa.array(s), "units": pa.array([data[2 * i : 2 * (i + m)] for i, m in zip(starts.tolist(), sizes.tolist(), strict=True)], pa.binary()),
                    "words": tails, "tfs": pa.ListArray.from_arrays(cuts, pa.array(tf)),
                }
                row += n
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"
    parts = materialise(source.mapInArrow(code, f"{schema}, units binary, words array<binary>, tfs array<long>"), folder, "parts")
    model = fit(parts.where(~F.col("held_out")), LogBilinear(unigram), unigram, n_all)
    trained = spark.sparkContext.broadcast((model, spread))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, spread = trained.value
        for batch in batches:
            if batch.num_rows:
                far, near, unit, starts = _runs(batch.column("units"))
                value = np.concatenate([model.log10(far[i : i + AT_ONCE], near[i : i + AT_ONCE], unit[i : i + AT_ONCE]) for i in range(0, len(unit), AT_ONCE)]) - spread[unit]
                value = np.add.reduceat(value, starts) + batch.column("score").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(value) if c == "score" else batch.column(c) for c in batch.schema.names if c != "units"], names=[c for c in batch.schema.names if c != "units"])

    scored = parts.drop("words", "tfs").mapInArrow(run, schema)
    # words outside the head: their counts by join, their shares summed by row
    rest = parts.select("row", F.explode(F.arrays_zip("words", "tfs")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.tfs").alias("tf"))
    rest = rest.join(counts.where(F.col("n") < least).hint("merge"), "word", "left")
    log = F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    rest = rest.groupBy("row").agg(F.sum(log).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more_known"))
    scored = scored.join(rest.hint("merge"), "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
