"""Streaming forms of ingestion, deduplication, windows, capture and packing.

Event-time columns are timestamps with time zone: a TIMESTAMP_NTZ column is cast before withWatermark. State is bounded by the
watermark; what that means for late or far-apart rows stands in each docstring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strophe.functions.arrays import fixed_chunks, padded_windows
from strophe.sources.records import parse_records
from strophe.sources.work import shared_folder


def stream_of(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table (a folder or one file) as a stream; files_per_trigger is the back-pressure. The path is given as a pattern
    that only it matches, as a file stream takes one file only so."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def arrive(df: DataFrame, part: Column, parts: int, folder: str) -> str:
    """Write a table as the files of ``parts`` arrivals one after the other, each a file of its own micro-batches: rows of part 0
    first. A file stream takes files in the order of their times."""
    for i in range(parts):
        df.where(part == i).write.mode("append").parquet(folder)
    return folder


def drain(
    stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None, folder: str | None = None,
    side: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Run a query over all that is there now, and read its output. Every micro-batch goes to a folder named by its number, so a
    batch that is run again replaces its own rows; in complete mode the last batch counts. With the folder of an earlier run the
    query goes on where that one ended. What ``side`` takes of a batch goes to the folder's side table."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        (each(batch, number) if each else batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number:08d}")
        if side:
            side(batch).write.mode("overwrite").parquet(f"{folder}/side/batch={number:08d}")

    with state_in_rocksdb(spark):
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch").alias("b")).first()["b"])
    return out


def side_table(spark: SparkSession, folder: str) -> DataFrame:
    """What a drained query with a side table has put there."""
    return spark.read.parquet(f"{folder}/side")


def slice_and_embed(docs: DataFrame, n: int, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs(id, seq) -> slices of n tokens with their vectors; stateless. A document's slices stay in one micro-batch."""
    s = docs.select("id", F.posexplode(fixed_chunks(F.col("seq"), n)).alias("slice", "seq"))
    return embed(s)


def dedup(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First row of each key; duplicates further apart than the delay may both pass, as state is dropped behind the watermark.
    The exact form is the batch one."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def decode(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Parsed lines, with _corrupt_record set for bad ones, which ``decode_to`` sends to a side table."""
    return parse_records(lines, column, schema, tolerant=True)


def decode_to(lines: DataFrame, column: str, schema: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Run the decoding over all lines that are there: good rows, and the bad ones from the side table."""
    bad = F.col("_corrupt_record").isNotNull()
    good = drain(decode(lines, column, schema), "decode", folder=folder, each=lambda b, i: b.where(~bad), side=lambda b: b.where(bad))
    return good, side_table(lines.sparkSession, folder)


def pack(stream: DataFrame, n: int, key: str = "id") -> DataFrame:
    """Each record in padded windows of n: stateless."""
    return stream.select(key, F.posexplode(padded_windows(F.col("seq"), n)).alias("window", "seq"))


def density(stream: DataFrame, ts: str, keys: list[str], length: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events a window, tumbling or sliding."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return stream.withWatermark(ts, delay).groupBy(*keys, w).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Runs of events between which less than the gap passes."""
    return stream.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))


def responses(gos: DataFrame, notes: DataFrame, timeout: str, delay: str = "1 hour") -> DataFrame:
    """Pairs of a go (stream, go_id, go_ts) and a note (note_stream, note_ts) within the timeout."""
    g, n = gos.withWatermark("go_ts", delay), notes.withWatermark("note_ts", delay)
    return g.join(n, (F.col("stream") == F.col("note_stream")) & (F.col("note_ts") >= F.col("go_ts")) & (F.col("note_ts") <= F.col("go_ts") + F.expr(f"interval {timeout}")))


def first_responses(gos: DataFrame, notes: DataFrame, timeout: str, delay: str = "1 hour") -> DataFrame:
    """(stream, go_id, go_ts, latency in microseconds): one row for each go that a note answers within the timeout. Two stateful steps in
    one query: the interval join, and the least latency of each go, which is let out (append mode) when the watermark has
    passed the go's time by the timeout, as no pair of it can come then. Gos and notes later than the delay are dropped; state is held for timeout
    and delay."""
    latency = (F.unix_micros("note_ts") - F.unix_micros("go_ts")).alias("latency")
    pairs = responses(gos, notes, timeout, delay).select("stream", "go_id", "go_ts", latency)
    return pairs.groupBy("stream", "go_id", "go_ts").agg(F.min("latency").alias("latency"))


class Capture(StatefulProcessor):
    """One stream's captures. Rows wait in a list state until the watermark has passed them and are then taken in order of (at, ident),
    whatever batch they came in; an event-time timer stands at the least waiting row, or where nothing waits at the end of the
    rest, when the stream's state is deleted."""

    def __init__(self, columns: list[str], duration: int, rest: int):
        self.columns, self.duration, self.rest = columns, duration, rest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, ident long, stop boolean")
        #: The running capture's first time, if there is one; and the time up to which rows are passed over.
        self.mark = handle.getValueState("mark", "begun long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for part in rows:
            new = list(zip(*(part[c].tolist() for c in self.columns), strict=True))
            if new:
                self.waiting.appendList(new)
                first = min(new)[0]
                least = first if least is None else min(least, first)
        if least is not None:
            self.handle.registerTimer(max(least // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        begun, until = self.mark.get() if self.mark.exists() else (None, None)
        waiting = sorted(tuple(r) for r in self.waiting.get())
        ready, taken = [r for r in waiting if r[0] < passed], []
        for row in ready:
            if begun is not None and row[0] > begun + self.duration:
                begun, until = None, begun + self.duration + self.rest
            if until is not None and row[0] <= until:
                continue
            begun, until = row[0] if begun is None else begun, None
            taken.append(row)
            if row[2]:
                begun, until = None, row[0] + self.rest
        waiting = waiting[len(ready) :]
        if begun is not None and begun + self.duration < passed:
            begun, until = None, begun + self.duration + self.rest
        if until is not None and until < passed:
            until = None
        if begun is None and until is None:
            self.mark.clear()
        else:
            self.mark.update((begun, until))
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        times = [waiting[0][0]] if waiting else [begun + self.duration] if begun is not None else [until] if until is not None else []
        for at in times:
            self.handle.registerTimer(max(at // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        if taken:
            yield pd.DataFrame({"key": [key[0]] * len(taken), "at": [r[0] for r in taken], "ident": [r[1] for r in taken]})

    def close(self) -> None:
        pass


def capture(stream: DataFrame, key: str, at: str, ident: str, stop: str, duration: int, ts: str = "ts", delay: str = "1 hour", rest: int = 2**60) -> DataFrame:
    """stream(key, at long microseconds of ts, ident long, stop boolean, ts): each stream's events from its first on, until
    ``duration`` has elapsed or a stop event comes, which is included. For ``rest`` microseconds after that (from the stop, or the end of the
    duration) the stream's rows are passed over; the next row begins another capture. Rows later than the delay are dropped.
    State, in RocksDB (``state_in_rocksdb``): the waiting rows of a delay, and two numbers a stream until the watermark has passed its rest."""
    rows = stream.withWatermark(ts, delay).select(key, at, ident, stop, ts)
    out = rows.groupBy(key).transformWithStateInPandas(Capture([at, ident, stop], duration, rest), "key long, at long, ident long", "append", "eventTime")
    return out.toDF(key, at, ident)


class HoldFiles(StatefulProcessor):
    """The embedded slices of a few files, each file's held until all have come, in whatever batches and order; a slice that comes again
    counts once. A slice is one string here, so that few values are moved. The timer stands at the time at which the first file is given up."""

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "file string, slice int, part string, at long")

    def waiting(self) -> tuple[dict, dict]:
        have: dict[str | None, dict] = {}
        last: dict[str | None, int] = {}
        for row in self.held.get():
            have.setdefault(row[0], {})[row[1]] = tuple(row)
            last[row[0]] = max(last.get(row[0], row[3]), row[3])
        return have, last

    def keep(self, have: dict, last: dict, without: list, new: list, passed: int) -> None:
        """Rewrites the state only where a file leaves it."""
        left = [f for f in have if f not in without]
        if not left:
            self.held.clear()
        elif without:
            self.held.put([row for f in left for row in have[f].values()])
        elif new:
            self.held.appendList(new)
        if left:
            self.handle.registerTimer(max(min(last[f] for f in left) + self.hold_ms, passed + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        have, last = self.waiting()
        new, sizes = [], {}
        for part in rows:
            for file, n, of, text, at in zip(*(part[c].tolist() for c in ("file", "slice", "slices", "part", "at")), strict=True):
                sizes[file] = of
                if n not in have.setdefault(file, {}):
                    have[file][n] = (file, n, text, at)
                    last[file] = max(last.get(file, at), at)
                    new.append(have[file][n])
        whole = [f for f, of in sizes.items() if len(have[f]) >= of]
        self.keep(have, last, whole, new, timerValues.getCurrentWatermarkInMs())
        if whole:
            yield pd.DataFrame({"file": whole, "parts": [[have[f][n][2] for n in sorted(have[f])] for f in whole]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        have, last = self.waiting()
        self.keep(have, last, [f for f in have if last[f] + self.hold_ms <= passed], [], passed)
        return iter([])

    def close(self) -> None:
        pass


def embed_files(slices: DataFrame, load: Callable, key: str, ts: str, batch_size: int = 64, delay: str = "1 hour", hold: str = "7 days", together: int = 1) -> DataFrame:
    """slices(key long, slice, slices, seq, ts), a stream -> (key, seqs, emb): one row for each file, when the last of its slices has come, with its
    sequences in order and the mean of their vectors. ``load`` makes the user's model, once for a worker's stream of a partition; the model gets at most
    batch_size sequences at a time. A file whose last slice is ``hold`` older than the watermark is given up, and slices later than the delay are dropped;
    state is the unfinished files' slices. Up to ``together`` files, those whose keys have the same quotient by it, share a state: Python takes
    milliseconds for a state that has rows in a batch, however few they are. The slices of these files must fit a worker."""
    from strophe.operators.embed import embed

    hold_ms = int(pd.Timedelta(hold).total_seconds() * 1000)
    rows = slices.withWatermark(ts, delay).select(key, F.col("slice").cast("int").alias("slice"), F.col("slices").cast("int").alias("slices"), "seq", ts, F.unix_millis(ts).alias("at"))
    rows = embed(rows, load, batch_size).select(F.expr(f"{key} div {together}").alias("state"), F.col(key).cast("string").alias("file"), "slice", "slices", F.to_json(F.struct("seq", "emb")).alias("part"), ts, "at")
    held = rows.groupBy("state").transformWithStateInPandas(HoldFiles(hold_ms), "file string, parts array<string>", "append", "eventTime")
    whole = held.select("file", F.transform("parts", lambda p: F.from_json(p, "seq array<string>, emb array<float>")).alias("x"))
    vectors = F.transform("x", lambda s: F.transform(s["emb"], lambda v: v.cast("double")))
    total = F.aggregate(F.slice(vectors, F.lit(2), F.size("x")), vectors[0], lambda have, v: F.zip_with(have, v, lambda a, b: a + b))
    return whole.select(F.col("file").cast("long").alias(key), F.transform("x", lambda s: s["seq"]).alias("seqs"), F.transform(total, lambda v: v / F.size("x")).alias("emb"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started meanwhile keep their state in RocksDB, as list states and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def capture_batch(events: DataFrame, key: str, at: str, ident: str, stop: str, duration: int) -> DataFrame:
    """The same over a whole table: the first stop in range bounds what is taken."""
    begun = events.groupBy(key).agg(F.min(at).alias("begun"))
    near = events.join(begun, key).where(F.col(at) <= F.col("begun") + duration)
    first = near.where(F.col(stop)).groupBy(key).agg(F.min(F.struct(F.col(at).alias("a"), F.col(ident).alias("i"))).alias("first"))
    d = near.join(first, key, "left").where(F.col("first").isNull() | (F.struct(F.col(at).alias("a"), F.col(ident).alias("i")) <= F.col("first")))
    return d.select(key, at, ident)


def with_progress(batch: DataFrame, number: int, per_pass: int) -> DataFrame:
    """One row a micro-batch: its number, rows, tokens, and the pass and batch that a resumed run begins at."""
    return batch.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("seq")), F.lit(0)).cast("long").alias("tokens")).select(
        F.lit(number).alias("number"), "rows", "tokens", F.lit((number + 1) // per_pass).alias("pass_index"), F.lit((number + 1) % per_pass).alias("batches_done")
    )
