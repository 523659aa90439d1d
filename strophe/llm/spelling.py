"""Spelling variants: words of a corpus within one edit of each other, and the more frequent form of each.

Two words within one edit agree in the first or in the second half of the shorter one's length, so that words meet in cells: all
that share the part outside a span of places. The words of a cell are scanned as a sorted list: the edit-matrix rows of a query
word, banded to the three columns that one edit can reach, are computed once for each range of words that share a prefix (the
ranges are those of the LCPs of neighbours), and a range whose prefix is more than one edit away is skipped whole. Rows of all query words
of a batch advance together, a character a step. A pair counts in the one cell whose span holds its first differing place.

A cell of more than ``most`` words is cut into the cells of its span's two halves, until its words are few or its span is one place, where the words
that can meet are some of the square of the alphabet; so no task holds more than that, whatever the vocabulary. A cell returns a count and a best
form for each of its words, not the pairs.

Defined results: null or empty texts have no words; a null doc_id counts as empty text where words are altered; repeated rows count
again; ties of frequency go to the smallest word in code-point order; an empty vocabulary gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import materialise, shuffle_parts, work_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Words of a cell, and of a batch of whole cells that a task scans at once.
MOST, BATCH = 4096, 16_384


def _transitions() -> np.ndarray:
    """(27 rows, 8 matches) -> row. A row is 9a + 3b + c of the banded distances (0, 1, 2 or more) at the columns d-1, d, d+1; the
    bits of a match: the character equals the query's at places d-1, d, d+1."""
    out = np.empty((27, 8), np.uint8)
    for row in range(27):
        left, mid, right = row // 9, row // 3 % 3, row % 3
        for bits in range(8):
            a = min(2, left + 1 - (bits & 1), mid + 1)
            b = min(2, mid + 1 - (bits >> 1 & 1), right + 1, a + 1)
            c = min(2, right + 1 - (bits >> 2 & 1), b + 1)
            out[row, bits] = 9 * a + 3 * b + c
    return out


STEP, START, DEAD = _transitions(), 10, 26  # START: distances 1, 0, 1


def near_pairs(words: list[str], cells: np.ndarray, shorter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, found) places of all words one edit apart in a list that is sorted by (cell, word); cells[i] numbers the cell of
    word i, and shorter, low and high are its cell's length and span. Words of a cell agree in their first ``low`` places."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    codes = np.frombuffer("".join(words).encode("utf-32-le") + b"\0\0\0\0", np.uint32)
    at = np.concatenate(([0], np.cumsum(size)[:-1]))

    def char(w: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The character of word w at place d; 0 outside of it."""
        inside = (d >= 0) & (d < size[w])
        return np.where(inside, codes[np.where(inside, at[w] + d, 0)], 0)

    # lcp[i]: characters that word i shares with the one before it, counted from its cell's low place; -1 at a cell's first word
    lcp = np.full(n + 1, -1, np.int64)
    open_ = np.flatnonzero(np.concatenate(([False], cells[1:] == cells[:-1])))
    lcp[open_] = 0
    while len(open_):
        a = char(open_, low[open_] + lcp[open_])
        open_ = open_[(a == char(open_ - 1, low[open_] + lcp[open_])) & (a != 0)]
        lcp[open_] += 1
    first = np.flatnonzero(lcp < 0)
    which = np.searchsorted(first, np.arange(n), side="right") - 1
    q, lo, hi = np.arange(n), first[which], first[which + 1]
    row, parted = np.full(n, START, np.uint8), np.full(n, -1, np.int64)
    pairs, depth = [], 0
    while len(q):
        d = low[q] + depth
        # the word that ends here is the range's first one
        ends = size[lo] == d
        if ends.any():
            e = np.flatnonzero(ends)
            gap = size[q[e]] - d[e]
            cost = np.select([gap == -1, gap == 0, gap == 1], [row[e] // 9, row[e] // 3 % 3, row[e] % 3], 2)
            place = np.where(parted[e] < 0, d[e], parted[e])
            length, top = shorter[q[e]], high[q[e]]
            own = (cost <= 1) & (lo[e] != q[e]) & (np.minimum(size[q[e]], d[e]) == length) & (place >= low[q[e]]) & ((place < top) | (top == length))
            pairs.append((q[e][own], lo[e][own]))
            lo = lo + ends
        left = lo < hi
        q, lo, hi, row, parted, d = q[left], lo[left], hi[left], row[left], parted[left], d[left]
        # the sub-ranges that share one more character: they begin at the range's first word and at words of this LCP
        starts = np.flatnonzero(lcp[:n] <= depth)
        a, b = np.searchsorted(starts, lo, side="right"), np.searchsorted(starts, hi, side="left")
        parts = b - a + 1
        parent = np.repeat(np.arange(len(q)), parts)
        nth = np.arange(len(parent)) - np.repeat(np.cumsum(parts) - parts, parts)
        bounds = np.concatenate((starts, [n]))
        begin = np.where(nth == 0, lo[parent], bounds[np.minimum(a[parent] + nth - 1, len(starts))])
        end = np.where(nth == parts[parent] - 1, hi[parent], bounds[np.minimum(a[parent] + nth, len(starts))])
        q, d = q[parent], d[parent]
        c = char(begin, d)
        same = c == char(q, d)
        bits = (c == char(q, d - 1)) + 2 * same + 4 * (c == char(q, d + 1))
        row = STEP[row[parent], bits]
        parted = np.where((parted[parent] < 0) & ~same, d, parted[parent])
        alive = row != DEAD
        q, lo, hi, row, parted = q[alive], begin[alive], end[alive], row[alive], parted[alive]
        depth += 1
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def _scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, shorter, low, high, word, n), sorted by (key, span, word) -> (word, n_near, near, near_n) of each word with near ones."""
    names = ["word", "n_near", "near", "near_n"]

    def found(t: pa.Table) -> pa.RecordBatch:
        words, n = t.column("word").to_pylist(), t.column("n").to_numpy()
        key, shorter, low, high = (t.column(c).to_numpy() for c in ("key", "shorter", "low", "high"))
        # cells that share a key by chance are told apart by their spans and by the words' first places
        new = np.array([True, *(b[:k] != a[:k] for a, b, k in zip(words, words[1:], low[1:].tolist(), strict=False))])
        for x in (key, shorter, low, high):
            new |= np.concatenate(([True], x[1:] != x[:-1]))
        q, x = near_pairs(words, np.cumsum(new), shorter, low, high)
        order = np.lexsort((x, -n[x], q))  # in a cell, code-point order is that of the places
        q, x = q[order], x[order]
        own, begin, count = np.unique(q, return_index=True, return_counts=True)
        best = x[begin]
        return pa.RecordBatch.from_arrays([pa.array([words[i] for i in own], pa.string()), pa.array(count, pa.int64()), pa.array([words[i] for i in best], pa.string()), pa.array(n[best], pa.int64())], names=names)

    held: list[pa.RecordBatch] = []
    for batch in rows:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH:
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last cell may go on
            if whole:
                for at, end in _pieces(key[:whole]):
                    yield found(t.slice(at, end - at))
                held = t.slice(whole).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        for at, end in _pieces(t.column("key").to_numpy()):
            yield found(t.slice(at, end - at))


def _pieces(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole cells, of about BATCH rows."""
    begins = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
    at = 0
    while at < len(key):
        end = int(begins[max(np.searchsorted(begins, at + BATCH, side="right") - 1, np.searchsorted(begins, at, side="right"))])
        yield at, end
        at = end


def vocabulary(docs: DataFrame, least_chars: int = 7, least_count: int = 2, noise: int = 31) -> DataFrame:
    """docs(doc_id, text) -> (word, n): letter runs with A-Z in lower case. Where ``noise`` divides the crc32 of
    '<doc_id>:<run>', the run loses a character: made spelling errors. Words of fewer characters or occurrences are left out."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))).alias("w"))
    low = runs.select("i", F.translate("w", UPPER, LOWER).alias("w"))
    marked = low.select("w", F.crc32(F.concat("i", F.lit(":"), "w").cast("binary")).alias("h"))
    place = (F.col("h") % F.length("w")).cast("int")
    altered = F.when(F.col("h") % noise == 0, F.concat(F.substring("w", F.lit(1), place), F.substring("w", place + 2, F.length("w")))).otherwise(F.col("w"))
    return marked.select(altered.alias("word")).where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _cells(words: DataFrame, spans: Column) -> DataFrame:
    """A row for each span (shorter, low, high) of a word, with the key of its cell: all but the span's places."""
    each = words.select("word", "n", F.explode(spans).alias("s")).select("word", "n", "s.*")
    rest = F.col("shorter") - F.col("high")
    return each.withColumn("key", F.xxhash64("shorter", "low", "high", F.substring("word", F.lit(1), F.col("low")), F.substring("word", F.length("word") - rest + 1, rest)))


def neighbours(words: DataFrame, least_chars: int, folder: str, most: int = MOST) -> DataFrame:
    """words(word, n), each once -> (word, n_near, near, near_n): for words with near ones their number, and the one of the largest n."""

    def span(shorter: Column, low: Column, high: Column) -> Column:
        return F.struct(shorter.cast("int").alias("shorter"), low.cast("int").alias("low"), high.cast("int").alias("high"))

    zero, length = F.lit(0), F.length("word")
    spans = F.array(*(span(x, a, b) for x in (length, length - 1) for a, b in ((F.floor(x / 2), x), (zero, F.floor(x / 2)))))
    rows, parts, level = _cells(words, F.filter(spans, lambda s: s["shorter"] >= least_chars)), [], 0
    while True:
        rows = materialise(rows, folder, f"cells_{level}")
        sizes = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        met = materialise(rows.join(sizes.hint("merge"), "key"), folder, f"met_{level}")
        large = (F.col("members") > most) & (F.col("high") - F.col("low") > 1)
        few = met.where(~large).select("key", "shorter", "low", "high", "word", "n").repartition(shuffle_parts(words.sparkSession), "key").sortWithinPartitions("key", "shorter", "low", "high", "word")
        parts.append(few.mapInArrow(_scan, "word string, n_near long, near string, near_n long"))
        rest = met.where(large)
        if rest.isEmpty():
            break
        mid = F.floor((F.col("low") + F.col("high")) / 2)
        rows, level = _cells(rest, F.array(span(F.col("shorter"), mid, F.col("high")), span(F.col("shorter"), F.col("low"), mid))), level + 1
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.minus")).alias("near_n"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """forms(word, form) -> (word, root), following forms to the last; each round doubles the steps."""
    links = materialise(forms.select("word", F.col("form").alias("root")), folder, "roots_0")
    rounds = 0
    while True:
        rounds += 1
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(links.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), folder, f"roots_{rounds}")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def group_variants(words: DataFrame, least_chars: int = 7, ratio: int = 10, most: int = MOST) -> DataFrame:
    """words(word, n), each once -> (word, n, n_near, form, form_n, root)."""
    folder = work_dir(words.sparkSession, "spelling")
    known = materialise(words.select("word", "n"), folder, "words")
    near = neighbours(known, least_chars, folder, most)
    joined = known.join(near.hint("merge"), "word", "left")
    wins = F.col("near_n") >= F.col("n") * ratio
    judged = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(wins, F.col("near")).alias("form"), F.when(wins, F.col("near_n")).alias("form_n")), folder, "judged")
    last = roots(judged.where("form is not null"), folder)
    return judged.join(last.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
