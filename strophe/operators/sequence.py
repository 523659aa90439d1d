"""Operators on token sequences: closed segments, augmentation, note tokens, slices, orders and samplers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.arrays import BOS, EOS, PAD, pad_to
from strophe.functions.hashing import hash_int, hash_key
from strophe.operators.prefix import numbered_sum, seeded_rank


def complete_windows(tokens: DataFrame, key: str, pos: str = "pos", bos: str = "bos", eos: str = "eos") -> DataFrame:
    """tokens(key, pos, bos boolean, eos boolean) -> (key, start, end) of closed segments: an opening restarts an open segment,
    an end closes it, and an end without an opening after the end before it closes nothing."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    d = tokens.withColumn("__b", F.max(F.when(F.col(bos), F.col(pos))).over(w)).withColumn("__e", F.max(F.when(F.col(eos), F.col(pos))).over(w))
    return d.where(F.col(eos) & (F.col("__b") > F.coalesce("__e", F.lit(-1)))).select(key, F.col("__b").alias("start"), F.col(pos).alias("end"))


def closed_segments(seq: Column, bos: str = BOS, eos: str = EOS) -> Column:
    """The same over an array: structs of 1-based start and end. A segment is closed where, of all openings and ends, an end
    comes next after an opening."""
    marks = F.filter(F.transform(seq, lambda x, i: F.when(x == bos, -(i + 1)).when(x == eos, i + 1)), lambda m: m.isNotNull())  # openings below 0

    def pairs(ms: Column) -> Column:
        pair = lambda m, i: F.when((m > 0) & (F.get(ms, i - 1) < 0), F.struct((-F.get(ms, i - 1)).alias("start"), m.alias("end")))
        return F.filter(F.transform(ms, pair), lambda s: s.isNotNull())

    return F.transform(F.array(marks), pairs)[0]


def apply_to_complete_windows(seq: Column, transform: Callable[[Column], Column], bos: str = BOS, eos: str = EOS, pad: str = PAD) -> Column:
    """seq with every closed segment transformed in place and cut or padded to its length; all else is unchanged."""
    segments = closed_segments(seq, bos, eos)

    def build(segs: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(segs, i - 1)["end"], F.lit(0))
            n = s["end"] - s["start"] + 1
            body = F.slice(transform(F.slice(seq, s["start"], n)), F.lit(1), n)
            return F.concat(F.slice(seq, before + 1, s["start"] - before - 1), F.concat(body, F.array_repeat(F.lit(pad), n - F.size(body))))

        last = F.coalesce(F.element_at(segs, -1)["end"], F.lit(0))
        return F.when(F.size(segs) == 0, seq).otherwise(F.concat(F.flatten(F.transform(segs, part)), F.slice(seq, last + 1, F.size(seq))))

    return F.transform(F.array(segments), build)[0]


def scale_times(seq: Column, percent: Column, step: int = 10, kinds: tuple[str, ...] = ("onset", "dur")) -> Column:
    """Tempo: values of time tokens ('kind:value') scaled by a whole percentage and rounded half even to steps."""
    def one(x: Column) -> Column:
        kind, value = F.substring_index(x, ":", 1), F.substring_index(x, ":", -1).try_cast("long")
        scaled = F.bround(value * percent / (100 * step), 0).cast("long") * step
        return F.when(kind.isin(*kinds) & value.isNotNull(), F.concat(kind, F.lit(":"), scaled.cast("string"))).otherwise(x)

    return F.transform(seq, one)


def tempo_augment(seq: Column, key: Column, seed, factors: tuple[int, ...] = (80, 90, 100, 110, 120)) -> Column:
    """Closed segments at a hash-chosen tempo."""
    percent = F.array(*(F.lit(f) for f in factors))[F.pmod(hash_int(seed, key), F.lit(len(factors))).cast("int")]
    return apply_to_complete_windows(seq, lambda s: scale_times(s, percent))


def quantise(notes: DataFrame, time_step: int = 10, velocity_step: int = 10, max_dur: int = 5000, segment: int = 5000) -> DataFrame:
    """Times and velocities rounded half even to steps, durations from one step to the cap, and onset split in segment and rest."""
    near = lambda x, s: (F.bround(F.col(x) / s, 0) * s).cast("long")
    q = notes.withColumn("onset", near("onset", time_step)).withColumn("velocity", near("velocity", velocity_step)).withColumn("dur", F.greatest(F.lit(time_step), F.least(F.lit(max_dur), near("dur", time_step))).cast("long"))
    return q.withColumn("segment", F.expr(f"onset div {segment}")).withColumn("offset", F.col("onset") % segment)


def note_tokens(notes: DataFrame, absolute: bool = True, pedals: DataFrame | None = None, **steps: int) -> DataFrame:
    """(piece_id, seq): BOS, then for each note in order of (onset, pitch, note_id) its tokens, then EOS. Absolute: a '<T>' for each
    segment entered since the note before, 'note:pitch:velocity', 'onset:offset', 'dur:dur'; else 'wait:' the onset difference.
    Pedals (piece_id, tick, value, pedal_id) come before notes of their time, as 'pedal:value' with their time tokens."""
    q = quantise(notes, **steps)
    events = q.select("piece_id", F.col("onset").alias("at"), F.lit(1).alias("kind"), F.col("pitch").alias("a"), F.col("note_id").alias("b"), F.concat_ws(":", F.lit("note"), "pitch", "velocity").alias("name"), "segment", "offset", "dur")
    if pedals is not None:
        p = quantise(pedals.select("piece_id", F.col("tick").alias("onset"), F.lit(0).alias("dur"), F.lit(0).alias("velocity"), "value", "pedal_id"), **steps)
        events = events.unionByName(p.select("piece_id", F.col("onset").alias("at"), F.lit(0).alias("kind"), F.col("value").alias("a"), F.col("pedal_id").alias("b"), F.concat_ws(":", F.lit("pedal"), "value").alias("name"), "segment", "offset", F.lit(None).cast("long").alias("dur")))
    w = Window.partitionBy("piece_id").orderBy("at", "kind", "a", "b")
    long = F.when(F.col("dur").isNotNull(), F.array(F.concat(F.lit("dur:"), F.col("dur").cast("string")))).otherwise(F.array().cast("array<string>"))
    if absolute:
        marks = F.array_repeat(F.lit("<T>"), (F.col("segment") - F.coalesce(F.lag("segment").over(w), F.lit(0))).cast("int"))
        own = F.concat(marks, F.array(F.col("name"), F.concat(F.lit("onset:"), F.col("offset").cast("string"))), long)
    else:
        wait = F.col("at") - F.coalesce(F.lag("at").over(w), F.lit(0))
        own = F.concat(F.array(F.concat(F.lit("wait:"), wait.cast("string")), F.col("name")), long)
    d = events.withColumn("own", own).groupBy("piece_id").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "a", "b", "own"))).alias("x"))
    return d.select("piece_id", F.concat(F.array(F.lit(BOS)), F.flatten(F.transform("x", lambda s: s["own"])), F.array(F.lit(EOS))).alias("seq"))


def chunk_notes(notes: DataFrame, n: int) -> DataFrame:
    """notes with slice: every n notes of a piece in order of (onset, note_id); the last slice is short."""
    w = Window.partitionBy("piece_id").orderBy("onset", "note_id")
    return notes.withColumn("slice", F.floor((F.row_number().over(w) - 1) / n).cast("int"))


def random_slice(seq: Column, key: Column, seed, least: int, most: int) -> Column:
    """A slice of a length drawn from [least, most], begun at a start drawn from [0, size - least]; from 0 if the array is shorter."""
    n = (F.lit(least) + F.pmod(hash_int(f"{seed}len", key), F.lit(most - least + 1))).cast("int")
    room = F.size(seq) - least
    start = F.when(room > 0, F.pmod(hash_int(f"{seed}start", key), room + 1)).otherwise(0).cast("int")
    return F.slice(seq, start + 1, n)


def two_views(rows: DataFrame, key: str, seed, least: int, most: int) -> DataFrame:
    """Two seeded slices of each record, as view 0 and 1."""
    d = rows.withColumn("view", F.explode(F.array(F.lit(0), F.lit(1))))
    return d.withColumn("seq", random_slice(F.col("seq"), F.concat_ws("/", F.col(key).cast("string"), F.col("view").cast("string")), seed, least, most))


def block_shuffle(df: DataFrame, index: str, size: int, seed) -> DataFrame:
    """df with rank: blocks of size rows in order, each shuffled by hash; the last block, if partial, keeps its order. A block is
    one sort of bounded size."""
    n = df.agg(F.max(index).alias("last"))
    d = df.crossJoin(F.broadcast(n)).withColumn("__block", F.expr(f"{index} div {size}"))
    whole = (F.col("__block") + 1) * size <= F.col("last") + 1
    order = F.when(whole, hash_key(seed, F.col(index))).otherwise("")
    w = Window.partitionBy("__block").orderBy(order, index)
    return d.withColumn("rank", F.col("__block") * size + F.row_number().over(w) - 1).drop("__block", "last")


def rank_sharded(df: DataFrame, key: str, seed, epoch: int, replicas: int, shuffle: bool = True) -> DataFrame:
    """(key, index, replica): rows in the order of (seed, epoch), wrapped around at the end until all replicas have as many;
    replica = index mod replicas."""
    ranked = seeded_rank(df, f"{seed}/{epoch}", key, "index") if shuffle else numbered_sum(df, [key], F.lit(1), "index")
    n = ranked.agg(F.count("*").alias("n"))
    d = ranked.crossJoin(F.broadcast(n))
    short = F.pmod(-F.col("n"), F.lit(replicas))
    again = d.where(F.col("index") < short).withColumn("index", F.col("index") + F.col("n"))
    return d.unionByName(again).withColumn("replica", F.col("index") % replicas).drop("n")


def batches(df: DataFrame, rank: str, batch_size: int, skip: int = 0) -> DataFrame:
    """df with batch = rank div batch_size, from batch `skip` on."""
    return df.withColumn("batch", F.expr(f"{rank} div {batch_size}")).where(F.col("batch") >= skip)


def resume_point(pass_index: Column, done: Column, per_pass: Column) -> tuple[Column, Column]:
    """(pass, batches to skip): a finished pass rolls on to the next one's start."""
    over = done >= per_pass
    return F.when(over, pass_index + 1).otherwise(pass_index), F.when(over, 0).otherwise(done)


def merge_tracks(messages: DataFrame) -> DataFrame:
    """messages(piece_id, track, idx, delta, ...) with absolute tick and order within the piece, by (tick, track, idx)."""
    w = Window.partitionBy("piece_id", "track").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    d = messages.withColumn("tick", F.sum("delta").over(w))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("piece_id").orderBy("tick", "track", "idx")))


def exact_split(df: DataFrame, key: str, ratio: float, seed) -> DataFrame:
    """split: the first floor(n * ratio) rows of the seeded order are 'eval', the others 'train'."""
    d = seeded_rank(df, seed, key).crossJoin(F.broadcast(df.agg(F.floor(F.count("*") * ratio).alias("__k"))))
    return d.withColumn("split", F.when(F.col("rank") < F.col("__k"), "eval").otherwise("train")).drop("__k", "rank")


def choose_elements(rows: DataFrame, key: str, pos: str, seed, ratio: float = 0.45) -> DataFrame:
    """rows with chosen: ceil(ratio * n) elements of each piece, by hash of piece and place."""
    k = hash_key(seed, F.concat_ws("/", F.col(key).cast("string"), F.col(pos).cast("string")))
    w = Window.partitionBy(key)
    return rows.withColumn("chosen", F.row_number().over(w.orderBy(k, pos)) <= F.ceil(F.count("*").over(w) * ratio))


def event_ticks(events: DataFrame, stream: str, ts_us: str, order: str, ticks_per_beat: int = 480, tempo_us: int = 500_000) -> DataFrame:
    """events with delta ticks from the event before (0 for the first), rounded half even."""
    w = Window.partitionBy(stream).orderBy(ts_us, order)
    dt = F.col(ts_us) - F.coalesce(F.lag(ts_us).over(w), F.col(ts_us))
    return events.withColumn("ticks", F.bround(dt * ticks_per_beat / tempo_us, 0).cast("long"))


def after_end_mask(tokens: DataFrame, key: str, pos: str = "pos", eos: str = "eos") -> DataFrame:
    """tokens with done: an end token stands before them."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("done", F.coalesce(F.max(F.col(eos)).over(w), F.lit(False)))


def pad_to_length(seq: Column, n: int) -> Column:
    return pad_to(F.slice(seq, 1, n), n)
