"""Streams over several micro-batches: rows out of order, late and bad ones, silent streams, restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strophe.sources.work import shared_folder
from strophe.streaming import live

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def arrivals(spark, name, *batches):
    """A folder with a file for each batch of (user_id, minute, event_id, stop)."""
    folder = shared_folder(spark, name)
    for batch in batches:
        rows = [(u, DAY + dt.timedelta(minutes=m), i, s) for u, m, i, s in batch]
        d = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, stop boolean").withColumn("us", F.unix_micros("ts"))
        d.coalesce(1).write.mode("append").parquet(folder)
    return folder


CLOSE = [(-1, 10_000, -1, False)]


@pytest.mark.parametrize("per_trigger", [1, 16])
def test_capture_takes_rows_in_time_order_over_batches(spark, per_trigger):
    """Stream 1: its first row and its stop come in the second batch. Stream 2 falls silent. Stream 3 runs out of its time."""
    first = [(1, 20, 12, False), (1, 30, 13, False), (2, 5, 20, False), (3, 0, 30, False), (3, 61, 32, False)]
    second = [(1, 10, 10, False), (1, 25, 11, True), (3, 60, 31, False)]
    stream = live.stream_of(spark, arrivals(spark, "capture", first, second, CLOSE, [(1, 10_001, 14, False)]), per_trigger)
    got = live.drain(live.capture(stream, "user_id", "us", "event_id", "stop", 3_600_000_000, delay="2 hours"), "capture")
    assert sorted((r.user_id, r.event_id) for r in got.collect()) == [(1, 10), (1, 11), (1, 12), (2, 20), (3, 30), (3, 31)]


def test_windows_end_at_the_watermark_and_drop_what_is_later(spark):
    """A row within the delay counts, one behind the watermark of the batch before does not, and the closing row's own window stays open."""
    folder = arrivals(spark, "windows", [(1, 10, 1, False), (1, 290, 2, False)], [(1, 200, 3, False)], [(1, 20, 4, False)], CLOSE)
    d = live.drain(live.density(live.stream_of(spark, folder, 1), "ts", ["user_id"], "1 hour", delay="2 hours"), "windows")
    got = d.select("user_id", F.hour("window.start").alias("h"), "n").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1), (1, 3, 1), (1, 4, 1)]


def test_bad_lines_go_to_the_side_table(spark):
    folder = shared_folder(spark, "lines")
    for lines in ([(1, '{"k": 3}'), (2, "{")], [(3, '{"k": 4}'), (4, "no")]):
        spark.createDataFrame(lines, "id long, line string").write.mode("append").parquet(folder)
    good, bad = live.decode_to(live.stream_of(spark, folder, 1), "line", "k int", shared_folder(spark, "decode"))
    assert sorted((r.id, r.k) for r in good.collect()) == [(1, 3), (3, 4)]
    assert sorted((r.id, r._corrupt_record) for r in bad.collect()) == [(2, "{"), (4, "no")]


def test_a_restarted_query_goes_on(spark):
    source, folder = shared_folder(spark, "restart"), shared_folder(spark, "query")
    write = lambda ids: spark.createDataFrame([(i, ["a"] * i) for i in ids], "id long, seq array<string>").coalesce(1).write.mode("append").parquet(source)
    run = lambda: sorted((r.number, r["rows"], r.tokens) for r in live.drain(live.stream_of(spark, source, 1), "r", each=lambda b, i: live.with_progress(b, i, 2), folder=folder).collect())
    write([1, 2])
    assert run() == [(0, 2, 3)]
    write([3])
    write([4, 5])
    assert run() == [(0, 2, 3), (1, 1, 3), (2, 2, 9)]
    assert run() == [(0, 2, 3), (1, 1, 3), (2, 2, 9)]
