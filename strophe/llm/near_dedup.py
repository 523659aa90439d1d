"""MinHash near-dedup by an inverted join over signature coordinates.

1. Every text becomes its set of distinct k-word shingle hashes, a 128-bit fingerprint of that set, and a signature of
   COORDINATES MinHash values (58 bits of value and 6 of coordinate in one long, the name of a list). Equal sets collapse to
   one node (a partial aggregation, so a huge group of copies is cheap).
2. Each node is posted in the list of each of its coordinate values. Two nodes match when at least MATCHES lists agree.
   Skip: lists of length one meet nobody, and of the others each node leaves its COORDINATES - PREFIX longest out; two nodes
   that match still meet LEAST times in what is left (MATCHES less the skipped).
   a. Lists of at most SHORT nodes are merged: a row for each pair of a list's nodes, counted by pair. A pair stays with
      LEAST collisions, or fewer where one of the two could have met the rest in longer lists. Its collisions in the skipped
      lists are then looked up in the signatures, and it is kept with MATCHES in all.
   b. Longer lists are not merged into pairs: nodes that meet in LEAST of them or more are joined to the list's least node.
3. The kept pairs and the long lists form candidate groups. Their sets are brought together once, in blocks of bounded size;
   every pair of blocks counts collisions of signatures and confirms those at or above MATCHES on the full sets. A pair inside
   one known component is skipped: only links that join components are returned, so a group of n nodes gives fewer than 2n
   rows a block pair, never all pairs.
4. Components of the confirmed links, then of the rows.

Each step of at most three joins is written and read back: Spark plans what is left of a query anew after each of its stages, so
the driver's work on one query of all the joins grows with the square of their number.

A pair of similarity 0.8 has MATCHES (34 of 64) collisions but for a chance below 1e-6.

Defined results: null or empty text, or white space alone -> empty set, n_shingles 0, no link, kept, component of its own
(its doc_id); rows with equal doc_id are judged each by its text and take the component of it; rows with a null doc_id link as
others do, but never name a component: theirs is null, and one text of it kept, where no row of it has an id; an empty table
gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import materialise, shuffle_parts, work_dir
from strophe.llm.graph import connected_components
from strophe.llm.shingles import mix, shingle_hashes, words

COORDINATES, MATCHES = 64, 34
#: Collisions that two matching nodes have at least in their prefixes, and the length of a prefix.
LEAST = 4
PREFIX = COORDINATES - MATCHES + LEAST
#: A list up to this length is merged into pairs: at most half as many rows a posting.
SHORT = 32
#: Nodes in a block, and shingles: a block pair's sets and its count matrix stay within some tens of MB.
BLOCK_NODES, BLOCK_SHINGLES = 384, 400_000
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Names a row: its id, or its text's hash where it has none.
KEY = "coalesce(cast(doc_id as long), xxhash64(cast(text as string)))"
FEATURES = "doc_id long, key long, n_shingles long, fp string, signature array<long>"


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES MinHash values of a set of 64-bit hashes: 58 bits, then the coordinate's number."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 1_000_000 // COORDINATES)
    for i in range(0, len(shingles), step):
        x = shingles[i : i + step, None] * _SEEDS[None, :]
        out = np.minimum(out, (x ^ (x >> np.uint64(32))).min(0))
    return (mix(out) << np.uint64(6) | np.arange(COORDINATES, dtype=np.uint64)).astype("<u8").view("<i8")


def fingerprint(shingles: np.ndarray) -> str:
    """128 bits of a sorted set: two independent sums of mixed hashes."""
    with np.errstate(over="ignore"):
        a = int(mix(shingles + np.uint64(1)).sum(dtype=np.uint64))
        b = int(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return f"{a:016x}{b:016x}"


def features(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, sig, ends = [], [], [np.empty(0, "<i8")], [0]
            for text in batch.column(2):
                s = np.unique(shingle_hashes(words(text.as_py()), k))
                n.append(len(s))
                fp.append(fingerprint(s) if len(s) else None)
                if len(s):
                    sig.append(signature(s))
                ends.append(ends[-1] + (COORDINATES if len(s) else 0))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sig)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.string()), lists], names=["doc_id", "key", "n_shingles", "fp", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.expr(KEY).alias("key"), F.col("text").cast("string")).mapInArrow(run, FEATURES)


def collisions(a: str, b: str):
    """How many coordinates of two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def met(nodes: DataFrame, folder: str) -> DataFrame:
    """Edges (a, b) that join all nodes which match, and few others."""
    # dealt out by list once: the sizes and the join below both use it
    posted = nodes.select("node", F.explode("signature").alias("list")).repartition(shuffle_parts(nodes.sparkSession), "list")
    sizes = posted.groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    shared = posted.join(sizes.hint("merge"), "list")
    # the lists of length one come first in the order and meet nobody: they use up places of the prefix
    w = Window.partitionBy("node")
    ranked = shared.withColumn("rank", F.row_number().over(w.orderBy("size", "list"))).withColumn("n", F.count("*").over(w))
    ranked = ranked.where((F.lit(COORDINATES) - F.col("n") + F.col("rank")) <= PREFIX)
    ranked = ranked.withColumn("n_long", F.count(F.when(F.col("size") > SHORT, 1)).over(w)).select("node", "list", "size", "n_long")
    prefix = materialise(ranked, folder, "prefix")

    short = prefix.where(F.col("size") <= SHORT).select("list", "node", "n_long").repartition(shuffle_parts(nodes.sparkSession), "list")
    pairs = short.toDF("list", "a", "long_a").join(short.toDF("list", "b", "long_b").hint("merge"), "list").where("a < b")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.least("long_a", "long_b")).alias("n_long")).where(F.col("n") + F.col("n_long") >= LEAST)
    pairs = materialise(pairs.select("a", "b"), folder, "counted")
    own = nodes.select("node", "signature")
    pairs = pairs.join(own.toDF("a", "sig_a").hint("merge"), "a").join(own.toDF("b", "sig_b").hint("merge"), "b")
    pairs = materialise(pairs.where(collisions("sig_a", "sig_b") >= MATCHES).select("a", "b"), folder, "matched")

    # nodes that meet in long lists alone: each to the least head of its lists, and the heads of a node to one another
    long = prefix.where((F.col("size") > SHORT) & (F.col("n_long") >= LEAST)).select("list", "node")
    heads = materialise(long.groupBy("list").agg(F.min("node").alias("head")), folder, "heads")  # so that AQE can split a long list
    headed = materialise(long.join(heads.hint("merge"), "list").select("node", "head").distinct(), folder, "headed")
    least = headed.groupBy("node").agg(F.min("head").alias("least"))
    tied = least.select(F.col("node").alias("a"), F.col("least").alias("b")).union(headed.join(least.hint("merge"), "node").select("head", "least").distinct())
    return pairs.union(tied.where("a <> b"))


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def confirm(k: int, percent: int):
    """Links of a block pair that join components: collisions counted on signatures, confirmed on the full sets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, tuple] = {}
        for node, fp, block, sig, text in zip(*(rows[c] for c in ("node", "fp", "block", "signature", "text")), strict=True):
            s = np.unique(shingle_hashes(words(text), k))
            if node not in found and fingerprint(s) == fp:  # another row may have the doc_id with another text
                found[node] = block, sig, frozenset(s.tolist())
        ids = sorted(found)
        n, sides = len(ids), np.array([found[i][0] for i in ids])
        sigs = np.stack([found[i][1] for i in ids]) if n else np.empty((0, COORDINATES), np.int64)
        sets = [found[i][2] for i in ids]
        sizes = np.array([len(s) for s in sets])
        forest, out = Forest(n), []
        own = rows["x"].iloc[0] == rows["y"].iloc[0]
        for i in range(n - 1):
            match = (sigs[i + 1 :] == sigs[i]).sum(1)
            low, high = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
            good = (match >= MATCHES) & (100 * low >= percent * high)
            if not own:
                good &= sides[i + 1 :] != sides[i]
            for j in (np.flatnonzero(good) + i + 1).tolist():
                a, b = forest.find(i), forest.find(j)
                if a != b:
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        forest.up[max(a, b)] = min(a, b)
                        out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, k: int, percent: int, folder: str) -> DataFrame:
    """Confirmed links (a, b) of nodes that join components, for candidate groups (node, component)."""
    members = groups.join(nodes.hint("merge"), "node").withColumnRenamed("component", "candidates").drop("doc_id")
    # sets whose sizes differ by a factor over 100 / percent cannot link: bands by size, linked to the same and the next one
    members = members.withColumn("band", F.floor(F.log(F.col("n_shingles")) / math.log(101 / percent)).cast("long"))
    sums = members.groupBy("candidates", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sums = materialise(sums, folder, "sums")
    members = members.join(sums.hint("merge"), ["candidates", "band"]).withColumn("block", F.col("band") * 1_000_000_000 + F.pmod(F.xxhash64("node"), F.col("blocks")))
    members = materialise(members.select("candidates", "block", "node", "key", "fp", "signature"), folder, "members")
    spans = sums.select("candidates", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).select("candidates", "band", (F.col("band") * 1_000_000_000 + F.col("i")).cast("long").alias("x"))
    other = spans.select("candidates", F.col("band").alias("other"), F.col("x").alias("y"))
    pairs = spans.join(other.hint("merge"), "candidates").where((F.col("y") >= F.col("x")) & (F.col("other") - F.col("band") <= 1))
    pairs = materialise(pairs.select("candidates", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block")), folder, "block_pairs")
    # rows of a key with another text are told by their fingerprint
    texts = docs.select(F.expr(KEY).alias("key"), F.col("text").cast("string").alias("text"))
    texts = texts.join(members.select("key").hint("merge"), "key", "left_semi").dropDuplicates(["key", "text"])
    full = members.join(texts.hint("merge"), "key")
    work = pairs.join(full.hint("merge"), ["candidates", "block"]).select("candidates", "x", "y", "block", "node", "fp", "signature", "text")
    # a number of its own: the work is in the tasks, not in the bytes by which Spark would put partitions together
    work = work.repartition(shuffle_parts(docs.sparkSession), "candidates", "x", "y")
    return work.groupBy("candidates", "x", "y").applyInPandas(confirm(k, percent), "a long, b long")


def judged(docs: DataFrame, k: int, percent: int, folder: str) -> DataFrame:
    """Per row of docs: doc_id, key, n_shingles, component_id, kept."""
    rows = materialise(features(docs, k), folder, "features")
    # a node is a set: named by the least key that it has or, where that key's least set is another, by its fingerprint's hash
    own = rows.where("fp is not null")
    sets = own.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("any_key")).withColumn("key", F.coalesce("doc_id", "any_key")).drop("any_key")
    first = own.groupBy("key").agg(F.min("fp").alias("first"))
    sets = sets.join(first.hint("merge"), "key").select("fp", "doc_id", "key", F.when(F.col("fp") == F.col("first"), F.col("key")).otherwise(F.xxhash64("fp")).alias("node"))
    sets = materialise(sets, folder, "sets")
    # the signatures are dealt out once, by fingerprint
    bearers = own.select("fp", F.col("key").alias("row_key"), "n_shingles", "signature").join(sets.hint("merge"), "fp").where("row_key = key")
    nodes = materialise(bearers.drop("row_key").dropDuplicates(["fp"]), folder, "nodes")
    groups = connected_components(met(nodes, folder), folder, "candidates")
    found = materialise(links(docs, nodes, groups, k, percent, folder), folder, "links")
    components = connected_components(found, folder, "components")
    named = materialise(nodes.select("node", "fp", "doc_id", "key").join(components.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")), folder, "named")
    least = materialise(named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("key").alias("component_key")), folder, "least")
    named = named.select("fp", "component").join(least.hint("merge"), "component").drop("component")
    kept = F.when(F.col("component_key").isNull(), True).when(F.col("component_id").isNull(), F.col("key") == F.col("component_key")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    component_id = F.when(F.col("component_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(named.hint("merge"), "fp", "left").select("doc_id", "key", "n_shingles", component_id.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    return judged(docs, k, percent, work_dir(docs.sparkSession, "near_dedup")).drop("key")


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs of each component; of a doc_id that is kept, each of its texts once."""
    folder = work_dir(docs.sparkSession, "near_dedup")
    kept = materialise(judged(docs, k, percent, folder).where("kept").select(F.col("key").alias("_near_key")).distinct(), folder, "kept")
    # by key alone, so that the texts are dealt out once
    own = docs.withColumn("_near_key", F.expr(KEY)).join(kept.hint("merge"), "_near_key", "left_semi")
    return own.dropDuplicates(["_near_key", "text"]).select(*docs.columns)
