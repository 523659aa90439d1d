"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item of m words is a set of k-word shingles, each weighted by its count and its words' length in bytes, and a
64-bit SimHash of those. A document's windows of m words are fingerprinted with running sums of its shingles' signed bits.
Only windows that hold a shingle of some item are built: a window without one has similarity 0. A multi-index finds the items
within RADIUS bits: the fingerprint is cut into BLOCKS bytes, one of which must be within RADIUS // BLOCKS bits of the item's
byte (pigeonhole), and per-byte tables list the items that are. Candidates of the same length are then confirmed by exact
weighted Jaccard similarity (sum of minima / sum of maxima) of at least ``threshold``.

A window of similarity 0.8 lies about 10 bits from its item; RADIUS 22 is more than four deviations beyond.

The index goes to the tasks in blocks of at most ``items_per_block`` items. A larger benchmark is matched block by block, one
pass over the documents each: the driver and the tasks hold one block at a time, and its hits are written before the next.

Defined results: null or empty texts and items match nothing; a text or item of fewer than k words has its whole sequence as
its one shingle; a null doc_id or item_id is kept as null; repeated documents each give their rows, repeated items count once; an
empty table on either side gives no rows; only doc_id, text, item_id and text are read. Among equal windows the first wins.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import work_dir
from strophe.llm.shingles import shingle_hashes, words

RADIUS, BLOCKS = 22, 8
HITS = "doc_id long, item_id long, similarity double, hamming int, first_word long, n_words long"
_NEAR = [[v for v in range(256) if (u ^ v).bit_count() <= RADIUS // BLOCKS] for u in range(256)]


def signed_bits(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per shingle, its weight with the sign of each of its hash's 64 bits."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (2 * bits.astype(np.int64) - 1) * weights[:, None]


def as_fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")[:, 0]


def weigh(tokens: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the shingles of a text, in order."""
    h = shingle_hashes(tokens, k)
    ends = np.concatenate(([0], np.cumsum([len(w) for w in tokens])))
    k = min(k, len(tokens))
    return h, ends[k:] - ends[: len(ends) - k] if k else np.empty(0, np.int64)


class Index:
    """Items of one benchmark block; those of fewer than k words form groups of their own, by their length."""

    def __init__(self, items: list[tuple[int | None, str | None]], k: int):
        self.groups: dict[int, dict] = {}
        for item_id, text in items:
            tokens = words(text)
            if tokens:
                h, w = weigh(tokens, k)
                g = self.groups.setdefault(min(k, len(tokens)), {"ids": [], "m": [], "fps": [], "sets": [], "all": set()})
                g["ids"].append(item_id)
                g["m"].append(len(tokens))
                g["fps"].append(int(as_fingerprint(signed_bits(h, w).sum(0, keepdims=True))[0]))
                g["sets"].append((Counter(h.tolist()), dict(zip(h.tolist(), w.tolist(), strict=True))))
                g["all"].update(h.tolist())
        for g in self.groups.values():
            g["all"] = np.array(sorted(g["all"]), np.uint64)
            g["holders"] = defaultdict(set)
            for i, (s, _) in enumerate(g["sets"]):
                for x in s:
                    g["holders"][x].add(g["m"][i])
            g["tables"] = [defaultdict(list) for _ in range(BLOCKS)]
            for i, fp in enumerate(g["fps"]):
                for b in range(BLOCKS):
                    for v in _NEAR[fp >> 8 * b & 255]:
                        g["tables"][b][g["m"][i], v].append(i)

    def match(self, text: str | None, threshold: float) -> list[tuple]:
        """(item_id, similarity, hamming, first word, words) of the best window for each item that is matched."""
        tokens, out = words(text), {}
        for k, g in self.groups.items():
            if len(tokens) < k:
                continue
            h = shingle_hashes(tokens, k)
            at = np.minimum(np.searchsorted(g["all"], h), len(g["all"]) - 1)
            seeds = np.flatnonzero(g["all"][at] == h)
            if not len(seeds):
                continue
            w = weigh(tokens, k)[1]
            for m in set().union(*(g["holders"][x] for x in h[seeds].tolist())):
                n = m - k + 1  # shingles of a window
                first = np.maximum(seeds - n + 1, 0)
                last = np.minimum(seeds, len(h) - n)
                if len(h) < n:
                    first, last, n = np.zeros(1, np.int64), np.zeros(1, np.int64), len(h)
                edge = np.zeros(len(h) + 1, np.int64)
                ok = first <= last
                np.add.at(edge, first[ok], 1)
                np.add.at(edge, last[ok] + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
                    if len(part):
                        self._windows(g, m, n, part, h, w, threshold, out)
        return [(i, *v) for (_, _, i), v in sorted(out.items(), key=lambda x: (x[0][0], x[0][1]))]

    def _windows(self, g: dict, m: int, n: int, starts: np.ndarray, h: np.ndarray, w: np.ndarray, threshold: float, out: dict) -> None:
        step = 20_000
        for s in range(0, len(starts), step):
            own = starts[s : s + step]
            a, b = int(own[0]), int(own[-1]) + n
            sums = np.concatenate((np.zeros((1, 64), np.int64), np.cumsum(signed_bits(h[a:b], w[a:b]), axis=0)))
            fps = as_fingerprint(sums[own - a + n] - sums[own - a])
            for start, fp in zip(own.tolist(), fps.tolist(), strict=True):
                near = {i for t in range(BLOCKS) for i in g["tables"][t].get((m, fp >> 8 * t & 255), ())}
                for i in near:
                    hamming = (fp ^ g["fps"][i]).bit_count()
                    if hamming <= RADIUS:
                        similarity = weighted(h[start : start + n].tolist(), w[start : start + n].tolist(), *g["sets"][i])
                        key = (id(g), i, g["ids"][i])
                        if similarity >= threshold and (key not in out or similarity > out[key][0]):
                            out[key] = similarity, hamming, start, m


def weighted(hashes: list[int], weights: list[int], item: Counter, item_weights: dict[int, int]) -> float:
    own, of = Counter(hashes), dict(zip(hashes, weights, strict=True)) | item_weights
    low = sum(min(c, own[x]) * of[x] for x, c in item.items())
    return low / sum(max(own[x], item[x]) * of[x] for x in {*own, *item})


def _blocks(benchmark: DataFrame, items_per_block: int) -> list[DataFrame]:
    """Parts of the benchmark, of bounded size by the hash of their rows."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    n = max(1, -(-items.count() // items_per_block))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def _send(items: DataFrame):
    return items.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])


def find(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, items_per_block: int = 20_000) -> DataFrame:
    """Pairs of a document and a benchmark item that one of its windows repeats."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def one(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, k)
            for batch in batches:
                rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in index.match(t.as_py(), threshold)]
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=[f.split()[0] for f in HITS.split(", ")])

        return source.mapInArrow(run, HITS)

    blocks = _blocks(benchmark, items_per_block)
    if len(blocks) == 1:
        return one(_send(blocks[0]))
    folder = work_dir(docs.sparkSession, "decontaminate")
    for items in blocks:
        sent = _send(items)
        one(sent).write.mode("append").parquet(f"{folder}/hits")
        sent.destroy()
    return docs.sparkSession.read.schema(HITS).parquet(f"{folder}/hits")


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, items_per_block: int = 20_000) -> DataFrame:
    """The rows of docs whose text holds no benchmark item: a filter, without a shuffle, where the benchmark is one block."""
    at = docs.columns.index("text")
    blocks = _blocks(benchmark, items_per_block)
    if len(blocks) > 1:
        own = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        hits = find(docs.select(own.alias("doc_id"), "text"), benchmark, k, threshold, items_per_block).select(F.col("doc_id").alias("leaking")).distinct()
        return docs.join(hits.hint("merge"), own == F.col("leaking"), "left_anti").select(*docs.columns)
    sent = _send(blocks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value, k)
        for batch in batches:
            yield batch.filter(pa.array([not index.match(t.as_py(), threshold) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
