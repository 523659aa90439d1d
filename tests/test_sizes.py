"""Results that must not hang on the number of files, the order of sums or the length of lines."""

import duckdb
from pyspark.sql import functions as F

from strophe import queries
from strophe.operators import patches

queries.load()


def same_as_sql(spark, name, folder, *tables):
    con = duckdb.connect()
    for table in tables:
        path = folder / f"{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    df = queries.QUERIES[name](spark, str(folder))
    names = df.columns
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.SQL[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def events_of(folder, rows):
    """rows(user_id, value), an hour apart."""
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO e SELECT ?, TIMESTAMP '2024-01-01' + to_hours(?), ?, 'view', ?, '{\"k\": 5}'", [(i, i % 24, u, v) for i, (u, v) in enumerate(rows)])
    con.execute(f"COPY e TO '{folder}/events.parquet' (FORMAT parquet)")


def test_suite_values_between_two_thousandths(spark, tmp_path):
    events_of(tmp_path, [(7, 32.0 + (i < 39)) for i in range(80)])
    assert "mean_note_velocity=32.488" in same_as_sql(spark, "f01_quality_suite", tmp_path, "events")[0][1]


def test_first_of_a_content_stays_with_many_files(spark, tmp_path):
    """An arrival of more files than a micro-batch takes, written in any order of the ids."""
    ids = spark.range(0, 60_000, 1, 60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 9973).alias("text"))
    ids.repartitionByRange(60, F.desc("doc_id")).write.parquet(str(tmp_path / "documents.parquet"))
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert {r[1] for r in same_as_sql(spark, "r02_incremental_dedup", tmp_path, "documents")} == set(range(9973))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_results_do_not_hang_on_the_order_of_sums(spark, tmp_path):
    cents = F.pmod(F.xxhash64("id"), F.lit(20_000))
    e = spark.range(0, 24_000, 1, 8).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") % 24 * 3600).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3000 + 1).alias("user_id"),
        F.when(F.col("id") % 5 == 0, "click").otherwise("view").alias("event_type"), (cents / 100).alias("value"),
    )
    e.write.parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, "s13_results", tmp_path, "events")


def test_a_line_is_split_once(spark):
    """However many bars it has: each use of a part would split the line again."""
    df = spark.createDataFrame([("|:a|b|" + "c|" * 20_000,)], "text string").select(patches.bar_patches(F.col("text")).alias("p"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    got = df.first()["p"]
    assert len(got) == 20_002 and got[:3] == ["|:a|", "b|", "c|"] and got[-1] == "c|\n"


def test_user_code_has_few_rows_before_it(spark):
    """Pieces of an Arrow batch: all rows in order, as few at a time as their bytes ask for; rows reach the callback as Python values."""
    import pyarrow as pa

    from strophe.operators import embed

    texts = ["x" * (400_000 if i % 50 == 7 else 10) for i in range(1000)]
    parts = list(embed.parts_of(pa.RecordBatch.from_pydict({"i": list(range(1000)), "text": texts}), 256))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(1000))
    assert max(p.num_rows for p in parts) <= 256 and all(p.num_rows == 1 or p.nbytes <= embed.PART_BYTES for p in parts)
    df = spark.createDataFrame([(1, "a b"), (None, None), (3, "c")], "i long, text string")
    got = embed.tokenise(df, lambda row: [repr(row["i"]), *row["text"].split()]).collect()
    assert [r["seq"] for r in got] == [["1", "a", "b"], None, ["3", "c"]] and got[1]["error"].startswith("AttributeError") and got[0]["error"] is None
    vectors = embed.embed(df.select("i", F.split("text", " ").alias("seq")), lambda: lambda batch: [[len(s), 1] for s in batch], 2)
    assert [(r["i"], r["emb"]) for r in vectors.collect()] == [(1, [2.0, 1.0]), (None, [0.0, 1.0]), (3, [1.0, 1.0])]
