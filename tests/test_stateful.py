"""Streams with state that ends: captures with a rest, first responses, exact dedup, held files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strophe.sources.work import shared_folder
from strophe.streaming import live

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
MINUTE = 60_000_000


def arrive(spark, folder, rows, schema="user_id long, minute long, event_id long, stop boolean"):
    d = spark.createDataFrame(rows, schema)
    if "minute" in d.columns:
        d = d.withColumn("ts", F.timestamp_micros(F.lit(int(DAY.timestamp()) * 1_000_000) + F.col("minute") * MINUTE)).withColumn("us", F.unix_micros("ts"))
    d.coalesce(1).write.mode("append").parquet(folder)


def captured(spark, source, folder, duration, rest):
    c = live.capture(live.stream_of(spark, source, 1), "user_id", "us", "event_id", "stop", duration * MINUTE, delay="2 hours", rest=rest * MINUTE)
    return sorted((r.user_id, r.event_id) for r in live.drain(c, "capture", folder=folder).collect() if r.user_id >= 0)


def by_hand(rows, duration, rest):
    """rows: (user, minute, event, stop) -> the captured (user, event)"""
    out = []
    for u in {r[0] for r in rows}:
        begun = until = None
        for _, m, i, stop in sorted((r for r in rows if r[0] == u), key=lambda r: r[1:3]):
            if begun is not None and m > begun + duration:
                until, begun = begun + duration + rest, None
            if until is not None and m <= until:
                continue
            until, begun = None, m if begun is None else begun
            out.append((u, i))
            if stop:
                until, begun = m + rest, None
    return sorted(out)


def state(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/checkpoint")


def test_captures_rest_end_and_go_on_after_a_restart(spark):
    """Rows come out of order by up to 100 minutes, in five arrivals with a restart after each one; what is captured is what one pass in time order takes."""
    rng = random.Random(2)
    rows = [(u, m, 10_000 * u + m, rng.random() < 0.03) for u in range(6) for m in sorted(rng.sample(range(3000), 90))]
    parts = [[] for _ in range(4)]
    for r in rows:
        parts[min(3, (r[1] + rng.randrange(100)) // 800)].append(r)
    source, folder = shared_folder(spark, "rest"), shared_folder(spark, "query")
    for part in [*parts, [(-1, 20_000, -1, False)]]:
        arrive(spark, source, part)
        got = captured(spark, source, folder, 300, 200)
    assert got == by_hand(rows, 300, 200)
    # behind the watermark, nothing of the finished streams is left; the closing row itself waits
    assert state(spark, folder, "mark").count() == 0
    assert [tuple(r["key"]) for r in state(spark, folder, "waiting").collect()] == [(-1,)]
    arrive(spark, source, [(3, 20_100, 7, False), (3, 500, 8, False)])  # the second is too late
    arrive(spark, source, [(-1, 30_000, -2, False)])
    assert captured(spark, source, folder, 300, 200) == sorted([*by_hand(rows, 300, 200), (3, 7)])


def test_no_rest_of_its_own_captures_once(spark):
    rows = [(1, 0, 1, False), (1, 30, 2, True), (1, 40, 3, False), (2, 5, 4, False), (2, 90, 5, False), (-1, 9000, -1, False)]
    source = shared_folder(spark, "once")
    arrive(spark, source, rows)
    stream = live.capture(live.stream_of(spark, source), "user_id", "us", "event_id", "stop", 60 * MINUTE)
    assert sorted((r.user_id, r.event_id) for r in live.drain(stream, "once").collect() if r.user_id > 0) == [(1, 1), (1, 2), (2, 4)]


def first_responses(spark, source, folder):
    e = live.stream_of(spark, source, 1)
    g = e.where("not stop or user_id < 0").select(F.col("user_id").alias("stream"), F.col("event_id").alias("go_id"), F.col("ts").alias("go_ts"))
    n = live.stream_of(spark, source, 1).where("stop or user_id < 0").select(F.col("user_id").alias("note_stream"), F.col("ts").alias("note_ts"))
    return sorted((r.go_id, r.latency // MINUTE) for r in live.drain(live.first_responses(g, n, "3 hours", "2 hours"), "first", folder=folder).collect())


def test_first_response_is_one_row_a_go(spark):
    """The nearest response comes in a later batch than a farther one; a note before the go, or beyond the timeout, is none; the query is
    restarted before the nearest comes."""
    source, folder = shared_folder(spark, "gos"), shared_folder(spark, "query")
    arrive(spark, source, [(1, 100, 1, False), (1, 190, 2, True), (2, 100, 3, False), (2, 90, 4, True)])
    assert first_responses(spark, source, folder) == []  # nothing is let out before its time
    arrive(spark, source, [(1, 110, 5, True), (2, 281, 6, True), (3, 200, 7, False), (3, 200, 8, True), (3, 210, 9, True)])
    arrive(spark, source, [(-1, 2000, -1, True)])
    assert first_responses(spark, source, folder) == [(1, 10), (7, 0)]
    # both are behind the watermark of 1,880: dropped
    arrive(spark, source, [(4, 1500, 10, False), (4, 1510, 11, True)])
    arrive(spark, source, [(5, 1990, 12, False), (5, 1999, 13, True), (-1, 4000, -2, True)])
    assert first_responses(spark, source, folder) == [(-1, 0), (1, 10), (7, 0), (12, 9)]


def batch_of(spark, rows):
    return spark.createDataFrame(rows, "hash string, id long, text string")


@pytest.mark.parametrize("expected", [1, 100_000])
def test_exact_dedup_over_batches(spark, expected):
    """Equals the batch form whatever the distance of duplicates, also where the filter is far too small; a batch that is run again
    gives the same rows and keeps what it has added."""
    from strophe.operators import corpus
    from strophe.streaming import seen

    rng = random.Random(expected)
    rows = [(f"{rng.randrange(900):032x}", i, f"t{i}") for i in range(3000)]
    rows.insert(1500, rows[0])  # the very same row once more
    folder = shared_folder(spark, "exact")
    run = lambda n, table: sorted(tuple(r) for r in seen.dedup_exact(batch_of(spark, rows[n * 750 : (n + 1) * 750]), n, table, "hash", ["id"], f"{folder}/scratch").collect())
    got = []
    for n in range(3):
        table = seen.SeenTable(spark, f"{folder}/seen", expected, parts=3)  # a new process each time
        own = run(n, table)
        assert run(n, table) == own
        got += own
    moved = seen.SeenTable(spark, f"{folder}/seen", expected, parts=3).compact(3, f"{folder}/compacted")
    got += run(3, moved)
    got += run(4, moved)
    kept = corpus.dedup_keep_first(batch_of(spark, rows), "hash", ["id"])[0]
    assert sorted(got) == sorted(tuple(r) for r in kept.collect())


def test_filter_rules_out_nearly_all_new_hashes_and_no_old_one(spark):
    from strophe.streaming import seen

    table = seen.SeenTable(spark, shared_folder(spark, "bloom"), 4000, parts=3)
    old, new = (spark.range(a, a + 4000).select(F.md5(F.col("id").cast("string")).alias("hash")) for a in (0, 4000))
    table.add(old, 0)
    assert table.maybe(old, 1).count() == 4000 and table.maybe(new, 1).count() < 40
    assert table.maybe(old, 0).count() == 0  # what its own batch has written does not count
    assert table.hits(new.unionByName(old.limit(7)), 1).count() == 7


def test_exact_dedup_edges(spark):
    from strophe.streaming import seen

    folder = shared_folder(spark, "edges")
    table = seen.SeenTable(spark, f"{folder}/seen", parts=3)
    run = lambda n, rows: sorted((r.id, r.text) for r in seen.dedup_exact(batch_of(spark, rows), n, table, "hash", ["id"], f"{folder}/scratch").collect())
    assert run(0, []) == []
    assert run(1, [(None, 1, "a"), (None, 1, "a"), ("h", 5, "b"), ("h", 4, "c"), ("h", 4, "d")])[:2] == [(1, "a"), (1, "a")]
    assert run(2, [("h", 1, "e"), (None, 2, "f"), ("g", 3, "x" * 1_000_000)]) == [(2, "f"), (3, "x" * 1_000_000)]


def test_files_are_held_until_complete(spark):
    """Slices out of order and over two runs; one that comes twice counts once; a file that stays unfinished is given up behind its hold."""
    source, folder = shared_folder(spark, "slices"), shared_folder(spark, "query")
    schema = "id long, slice int, slices int, seq array<string>, minute long"
    _length_model = lambda: lambda batch: [[float(len(s)), float(sum(map(len, s)))] for s in batch]
    run = lambda: sorted((r.id, r.seqs, r.emb) for r in live.drain(live.embed_files(live.stream_of(spark, source, 1), _length_model, "id", "ts", 2, hold="2 hours"), "files", folder=folder).collect())
    arrive(spark, source, [(1, 1, 2, ["b", "bb"], 0), (2, 0, 1, ["c"], 0), (3, 0, 2, ["d"], 0), (1, 1, 2, ["b", "bb"], 1), (4, 0, 2, ["x"], 0)], schema)
    assert run() == [(2, [["c"]], [1.0, 1.0])]
    arrive(spark, source, [(1, 0, 2, ["a"], 30)], schema)
    arrive(spark, source, [(9, 0, 2, ["z"], 400)], schema)
    want = [(1, [["a"], ["b", "bb"]], [1.5, 2.0]), (2, [["c"]], [1.0, 1.0])]
    assert run() == want
    assert [tuple(r["key"]) for r in state(spark, folder, "held").select("key").distinct().collect()] == [(9,)]
    arrive(spark, source, [(3, 1, 2, ["d"], 401), (9, 1, 2, ["y"], 401)], schema)  # file 3 begins anew, without its first slice
    assert run() == [*want, (9, [["z"], ["y"]], [1.0, 1.0])]


def test_files_that_share_a_state(spark):
    """Neighbouring keys: each file is let out and given up for itself; the text of a slice and its null tokens come back as they were."""
    source, folder = shared_folder(spark, "slices"), shared_folder(spark, "query")
    schema = "id long, slice int, slices int, seq array<string>, minute long"
    model = lambda: lambda batch: [[float(len(s)), 0.1] for s in batch]
    run = lambda: sorted((r.id, r.seqs, [round(x, 6) for x in r.emb]) for r in live.drain(live.embed_files(live.stream_of(spark, source, 1), model, "id", "ts", 2, hold="2 hours", together=32), "files", folder=folder).collect())
    arrive(spark, source, [(33, 1, 2, ["b", "\"\n\\"], 0), (34, 0, 2, ["c"], 0), (35, 0, 1, [None, "d"], 0), (36, 0, 2, ["early"], 0)], schema)
    first = [(35, [[None, "d"]], [2.0, 0.1])]
    assert run() == first
    arrive(spark, source, [(34, 0, 2, ["again"], 60), (37, 0, 2, ["e"], 60), (33, 0, 2, [], 60)], schema)
    assert run() == [(33, [[], ["b", "\"\n\\"]], [1.0, 0.1]), *first]
    arrive(spark, source, [(99, 0, 2, ["z"], 200)], schema)  # the watermark passes the hold of 34 and 36, not that of 37
    run()
    arrive(spark, source, [(37, 1, 2, ["f"], 201), (34, 1, 2, ["late"], 201), (36, 1, 2, ["late"], 201)], schema)
    assert [r[0] for r in run()] == [33, 35, 37]


def test_slices_are_cut_from_a_text_that_is_split_once(spark):
    """An explode adds a filter on the slices, which is pushed down to the text: it may not split the text again for each slice."""
    from strophe.functions.arrays import fixed_chunks, tokens_of

    df = spark.range(1).select("id", F.lit("a b c d e").alias("text")).localCheckpoint()
    df = df.select("id", tokens_of(F.col("text")).alias("seq")).select("id", fixed_chunks(F.col("seq"), 2).alias("c")).select("id", F.posexplode("c").alias("slice", "seq")).where("slice >= 0")
    assert "slice(filter(split" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r["seq"] for r in df.orderBy("slice").collect()] == [["a", "b"], ["c", "d"], ["e"]]
