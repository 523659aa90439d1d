"""Quality tests of pieces over the exploded note table.

Each test is a function (notes, **args) -> DataFrame(piece_id, value double, failed boolean). The definitions are this library's:
they follow from the tests' names and parameters and stand in each docstring. Times are seconds.

A test is stated as the cells that it counts notes by, and its value and verdict as aggregates over them, so that any number of
tests shares one scan of the notes, one window order and one chain of aggregations.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Cells(NamedTuple):
    """Notes of a piece where ``where`` holds, by ``outer`` and, in each of these, by ``inner``."""

    outer: Column
    inner: Column
    where: Column


class Test(NamedTuple):
    """``value`` and ``failed`` are aggregates over the outer cells (columns kind, outer, n, n_inner: the inner cells; top: notes of the
    largest; begin, finish, gap, velocities, velocity_sum; part_1 ...: notes of inner cells 1 to ``parts``)."""

    cells: dict[str, Cells]
    value: Column
    failed: Column
    parts: int = 0


def _cells(outer: Column, inner: Column | None = None, where: Column | None = None) -> Cells:
    return Cells(outer.cast("string"), F.lit(None).cast("string") if inner is None else inner.cast("string"), F.lit(True) if where is None else where)


def _of(kind: str, column: str | Column) -> Column:
    return F.when(F.col("kind") == kind, F.col(column) if isinstance(column, str) else column)


def _distinct(kind: str) -> Column:
    return F.count(_of(kind, "outer"))


def _entropy(kind: str) -> Column:
    """Shannon entropy (bits) of the notes' cells, by sums alone: log2 N - sum n log2 n / N."""
    total = F.sum(_of(kind, "n"))
    return F.log2(total) - F.sum(_of(kind, F.col("n") * F.log2("n"))) / total


def _order():
    """The order of a piece's notes."""
    return Window.partitionBy("piece_id").orderBy("onset", "note_id")


def _delta() -> Column:
    return F.col("onset") - F.lag("onset").over(_order())


def _gap() -> Column:
    return F.col("onset") - F.max(F.col("onset") + F.col("dur")).over(_order().rowsBetween(Window.unboundedPreceding, -1))


def _piece() -> dict[str, Cells]:
    """All of a piece as one cell."""
    return {"piece": _cells(F.lit(""))}


def _pitch() -> dict[str, Cells]:
    return {"pitch": _cells(F.col("pitch"))}


def _instrument() -> dict[str, Cells]:
    return {"instrument": _cells(F.col("instrument"))}


def values(notes: DataFrame, tests: dict[str, Test]) -> DataFrame:
    """A row for each piece: piece_id, and for each test a struct(value, failed) under its name. A value that cannot be had fails
    unless the test says else."""
    cells = {k: c for t in tests.values() for k, c in t.cells.items()}
    kinds = [F.when(c.where, F.struct(F.lit(k).alias("kind"), c.outer.alias("outer"), c.inner.alias("inner"))) for k, c in cells.items()]
    ordered = notes.withColumn("finish", F.col("onset") + F.col("dur"))
    if "gap" in cells:
        ordered = ordered.withColumn("gap", _gap())
    gap = F.max("gap") if "gap" in cells else F.lit(None).cast("long")
    rows = ordered.select("piece_id", "onset", "finish", "velocity", *(["gap"] if "gap" in cells else []), F.array_compact(F.array(*kinds)).alias("cell"))
    rows = rows.withColumn("cell", F.explode("cell")).select("*", "cell.*").drop("cell")
    inner = rows.groupBy("piece_id", "kind", "outer", "inner").agg(
        F.count("*").alias("n"), F.min("onset").alias("begin"), F.max("finish").alias("finish"), gap.alias("gap"), F.count("velocity").alias("velocities"), F.sum("velocity").alias("velocity_sum")
    )
    parts = max((t.parts for t in tests.values()), default=0)
    outer = inner.groupBy("piece_id", "kind", "outer").agg(
        F.sum("n").alias("n"), F.max("n").alias("top"), F.count("*").alias("n_inner"), F.min("begin").alias("begin"), F.max("finish").alias("finish"), F.max("gap").alias("gap"),
        F.sum("velocities").alias("velocities"), F.sum("velocity_sum").alias("velocity_sum"),
        *(F.sum(F.when(F.col("inner") == str(i), F.col("n")).otherwise(0)).alias(f"part_{i}") for i in range(1, parts + 1)),
    )
    return outer.groupBy("piece_id").agg(*(F.struct(F.round(t.value.cast("double"), 6).alias("value"), F.coalesce(t.failed, F.lit(True)).alias("failed")).alias(name) for name, t in tests.items()))


def _test(make: Callable[..., Test]) -> Callable[..., DataFrame]:
    @wraps(make)
    def run(notes: DataFrame, *args, **named) -> DataFrame:
        return values(notes, {"test": make(*args, **named)}).select("piece_id", "test.*")

    run.make = make
    return run


def _intervals(params: list[dict]) -> dict[str, Cells]:
    return {f"interval {p['interval_len_s']}": _cells(F.floor(F.col("onset") / p["interval_len_s"]), F.col("pitch")) for p in params}


@_test
def note_density_in_interval(test_params_list: list[dict]) -> Test:
    """Tumbling intervals of interval_len_s from onset 0. Value: the largest notes per second of the first entry's intervals.
    Fails if in any entry an interval has more than max_notes_per_second, or more of one pitch than the per-pitch limit."""
    rate = lambda p, column: F.max(_of(f"interval {p['interval_len_s']}", column)) / p["interval_len_s"]
    failed = F.lit(False)
    for p in test_params_list:
        failed = failed | (rate(p, "n") > p["max_notes_per_second"]) | (rate(p, "top") > p["max_notes_per_second_per_pitch"])
    return Test(_intervals(test_params_list), rate(test_params_list[0], "n"), failed)


@_test
def note_timing_entropy(min_length_entropy: float, min_onset_delta_entropy: float, step_s: int = 10) -> Test:
    """Entropy of durations, and of onset differences between neighbours by (onset, note_id), both in steps of step_s.
    Value: the length entropy. A piece of one note has delta entropy 0."""
    cells = {f"dur {step_s}": _cells(F.floor(F.col("dur") / step_s)), f"delta {step_s}": _cells(F.floor(_delta() / step_s), where=_delta().isNotNull())}
    length, delta = _entropy(f"dur {step_s}"), F.coalesce(_entropy(f"delta {step_s}"), F.lit(0.0))
    return Test(cells, length, (F.round(length, 6) < min_length_entropy) | (F.round(delta, 6) < min_onset_delta_entropy))


@_test
def note_pitch_entropy(min_entropy: float) -> Test:
    """Entropy of pitches."""
    return Test(_pitch(), _entropy("pitch"), F.round(_entropy("pitch"), 6) < min_entropy)


@_test
def unique_pitch_count_in_interval(test_params_list: list[dict]) -> Test:
    """Least number of distinct pitches over the tumbling intervals that hold notes; fails if below any entry's limit.
    Value: that of the first entry."""
    least = lambda p: F.min(_of(f"interval {p['interval_len_s']}", "n_inner"))
    failed = F.lit(False)
    for p in test_params_list:
        failed = failed | (least(p) < p["min_unique_pitch_cnt"])
    return Test(_intervals(test_params_list), least(test_params_list[0]), failed)


@_test
def unique_pitch_count(min_num_unique_pitches: int) -> Test:
    return Test(_pitch(), _distinct("pitch"), _distinct("pitch") < min_num_unique_pitches)


@_test
def silent_interval(max_silence_s: float) -> Test:
    """Longest gap between an onset and the latest end of all notes before it (by onset, note_id); 0 if there is none."""
    gap = F.greatest(F.lit(0), F.coalesce(F.max(_of("gap", "gap")), F.lit(0)))
    return Test({"gap": _cells(F.lit(""))}, gap, gap > max_silence_s)


@_test
def mean_note_velocity(min_velocity: float, max_velocity: float) -> Test:
    mean = F.sum(_of("piece", "velocity_sum")) / F.nullif(F.sum(_of("piece", "velocities")), F.lit(0))
    return Test(_piece(), mean, ~mean.between(min_velocity, max_velocity))


@_test
def max_programs(max_programs: int, program: str = "velocity") -> Test:
    """Distinct programs; the note view has no program column, so velocity stands for it in the registered query."""
    kind = f"program {program}"
    return Test({kind: _cells(F.col(program))}, _distinct(kind), _distinct(kind) > max_programs)


@_test
def max_instruments(max_instruments: int) -> Test:
    return Test(_instrument(), _distinct("instrument"), _distinct("instrument") > max_instruments)


def _length() -> Column:
    return F.max("finish") - F.min("begin")


def _rate(n: Column) -> Column:
    """Per second of the piece's length; null for a length of 0."""
    return F.when(_length() > 0, n / _length())


@_test
def total_note_frequency(min_per_second: float, max_per_second: float) -> Test:
    """Notes over the piece's length; a piece of length 0 fails."""
    rate = _rate(F.sum(_of("piece", "n")))
    return Test(_piece(), rate, ~rate.between(min_per_second, max_per_second))


@_test
def note_frequency_per_instrument(min_per_second: float, max_per_second: float) -> Test:
    """Notes of each instrument over the piece's length. Value: the largest. Fails if any is out of range."""
    low, high = _rate(F.min(_of("instrument", "n"))), _rate(F.max(_of("instrument", "n")))
    return Test(_instrument(), high, ~((low >= min_per_second) & (high <= max_per_second)))


@_test
def length(min_length_s: float, max_length_s: float) -> Test:
    return Test(_piece(), _length(), ~_length().between(min_length_s, max_length_s))


@_test
def repetitive_content(min_length_m: int, num_chunks: int, kl_tolerance: float) -> Test:
    """Notes in order of (onset, note_id) fall into num_chunks equal parts; pitch histograms of parts, one added to each of the
    piece's pitches, are compared by sum p ln(p/q). Value: the least over ordered pairs of parts; fails if below the tolerance in
    pieces of at least min_length_m minutes. Pieces with fewer notes than parts have no value and pass; so do notes without
    pitch."""
    kind = f"parts {num_chunks}"
    cells = {kind: _cells(F.col("pitch"), F.ntile(num_chunks).over(_order()), F.col("pitch").isNotNull())} | _piece()
    n = [F.col(f"part_{i}") + 1 for i in range(1, num_chunks + 1)]
    total = [F.sum(_of(kind, x)) for x in n]
    # sum p ln(p/q) of p = a/A, q = b/B over all pitches: (sum a ln a - sum a ln b) / A + ln(B/A)
    cross = lambda i, j: F.sum(_of(kind, n[i] * F.log(n[j])))
    pairs = [(cross(i, i) - cross(i, j)) / total[i] + F.log(total[j] / total[i]) for i in range(num_chunks) for j in range(num_chunks) if i != j]
    kl = F.when(F.sum(_of("piece", "n")) >= num_chunks, F.round(F.least(*pairs) if len(pairs) > 1 else F.lit(None).cast("double"), 6))
    return Test(cells, kl, F.coalesce((_length() >= 60 * min_length_m) & (kl < kl_tolerance), F.lit(False)), num_chunks)


TESTS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        note_density_in_interval, note_timing_entropy, note_pitch_entropy, unique_pitch_count_in_interval, unique_pitch_count, silent_interval, mean_note_velocity,
        max_programs, max_instruments, total_note_frequency, note_frequency_per_instrument, length, repetitive_content,
    )
}


def chosen(config: dict[str, dict]) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The tests of a config {name: {"run": bool, "args": {...}}} that run; an unknown name is an error, run or not."""
    unknown = sorted(set(config) - set(TESTS))
    if unknown:
        raise ValueError(f"unknown tests: {', '.join(unknown)}")
    return [(name, lambda notes, f=TESTS[name], a=c.get("args", {}): f(notes, **a)) for name, c in config.items() if c.get("run")]


def quality_suite(notes: DataFrame, config: dict[str, dict]) -> DataFrame:
    """Per piece: failures (array of name=value, in order of name), kept. All failures are collected; tests that do not run
    are not built. The tests that run share one scan of the notes."""
    names = sorted(name for name, _ in chosen(config))
    if not names:
        return notes.select("piece_id").distinct().select("piece_id", F.array().cast("array<string>").alias("failures"), F.lit(True).alias("kept"))
    d = values(notes, {name: TESTS[name].make(**config[name].get("args", {})) for name in names})
    shown = lambda name: F.concat(F.lit(f"{name}="), F.coalesce(F.col(f"{name}.value").cast("decimal(20,3)").cast("string"), F.lit("none")))
    failures = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"{name}.failed"), shown(name)) for name in names))))
    return d.select("piece_id", failures.alias("failures")).withColumn("kept", F.size("failures") == 0)
