"""Token tables, dedup, the probe, tolerant files and manifests: edge rows, brute force and plans."""

import os
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe import queries
from strophe.functions import arrays as a
from strophe.operators import corpus, packing, patches, probe
from strophe.plans import jobs
from strophe.sources import records, shards
from strophe.sources.work import shared_folder

queries.load()


def test_tokens_of_white_space(spark):
    texts = ["", " \t\n", "\n a\u000b b\r", "a", None, " x y"]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(a.tokens_of(F.col("t")).alias("s")).collect()]
    assert got == [[], [], ["a", "b"], ["a"], None, [" x", "y"]]


DOCUMENT_QUERIES = [
    "j05_encode_decode", "x02_pack_separate", "x03_pack_concatenated", "w03_token_offsets", "w05_next_token_target", "x04_pad_last_cell", "x05_pad_augmented", "x06_pad_last_token", "x08_loss_mask",
    "x10_overlapping_segments", "x15_truncate", "e02_pack_dataset", "a04_loss_token_counts", "f08_sample_projection", "x11_group_lines", "h01_embed_hook",
]


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_blank_and_odd_texts_equal_sql(spark, tmp_path_factory, name):
    import duckdb

    folder = tmp_path_factory.getbasetemp() / "odd"
    texts = ["", "  ", "\n", "a b a", "\n a\tb ", "x", "x", "a " * 3000, "one\ntwo words\n", "é ü z"]
    if not folder.exists():
        folder.mkdir()
        rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    cursor = con.execute(queries.SQL[name])
    theirs = [d[0] for d in cursor.description]
    shown = lambda rows, at: sorted(tuple(str(r[i]) for i in at) for r in rows)
    assert shown(df.collect(), columns) == shown(cursor.fetchall(), [theirs.index(x) for x in columns])


def test_encode_and_decode_edges(spark):
    rare = "r" * 300
    seqs = [["a", "b", None, "a"], [], None, [rare, "a"], ["new"], ["a"] * 500]
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, seq array<string>")
    vocabulary = corpus.build_vocabulary(rows.where("id <> 4")).where("token is not null")
    ids = {r.token: r.token_id for r in vocabulary.collect()}
    assert set(ids) == {"a", "b", rare}
    assert corpus.common_tokens(vocabulary, 1).collect()[0].token == "a"
    assert rare not in {r.token for r in corpus.common_tokens(vocabulary).collect()}
    expected = {i: [ids.get(t, 0) for t in s or []] for i, s in enumerate(seqs)}
    for table in (vocabulary, vocabulary.drop("n")):
        encoded = corpus.encode_tokens(rows, table)
        assert {r.id: r.ids for r in encoded.collect()} == expected
        decoded = {r.id: r.seq for r in corpus.decode_tokens(encoded, table).collect()}
        assert decoded == {i: [t for t in s or [] if t in ids] for i, s in enumerate(seqs)}
    empty = spark.createDataFrame([], "id long, seq array<string>")
    assert corpus.encode_tokens(empty, vocabulary).count() == 0 and corpus.build_vocabulary(empty).count() == 0


def test_encoding_shuffles_no_row_for_each_token(spark, monkeypatch):
    """Blocks of few items and of one long row equal the plain lookup; only a block's distinct tokens are exploded and joined."""
    monkeypatch.setattr(corpus, "BLOCK", 7)
    seqs = [[f"w{(i * j) % 11}" for j in range(i % 9)] for i in range(60)] + [["w1", "w2"] * 400, None, [None, "w3"], ["gone"]]
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, seq array<string>").coalesce(2)
    vocabulary = corpus.build_vocabulary(rows).where("token <> 'gone'")
    ids = {r.token: r.token_id for r in vocabulary.collect()}
    encoded = corpus.encode_tokens(rows, vocabulary)
    assert "posexplode(seq" not in encoded._jdf.queryExecution().toString() and "posexplode(items" in encoded._jdf.queryExecution().toString()
    assert {r.id: r.ids for r in encoded.collect()} == {i: [ids.get(w, 0) for w in s or []] for i, s in enumerate(seqs)}
    assert {r.id: r.seq for r in corpus.decode_tokens(encoded, vocabulary).collect()} == {i: [w for w in s or [] if w in ids] for i, s in enumerate(seqs)}


def test_encoding_reads_its_rows_twice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), a.tokens_of(F.col("text")).alias("seq"))
    plan = corpus.encode_tokens(docs, corpus.build_vocabulary(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") <= 2


def test_dedup_with_many_copies_ties_and_nulls(spark):
    rows = [("h", i) for i in range(500)] + [("g", 7), ("g", 7), ("g", None), (None, 1)]
    kept, audit = corpus.dedup_keep_first(spark.createDataFrame(rows, "hash string, id int"), "hash", ["id"])
    assert sorted(kept.collect(), key=str) == sorted([("g", None), ("h", 0)], key=str)
    got = audit.collect()
    assert sorted(r.duplicate.id for r in got if r.hash == "h") == list(range(1, 500))
    assert [r.duplicate.id for r in got if r.hash == "g"] == [7, 7]


def test_packing_by_split_equals_packing_each(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, "train" if i % 3 else "val", [f"t{i}"] * rng.randint(0, 9)) for i in range(200)], "id long, split string, seq array<string>")
    both = {(r.split, r.seq_id): r.seq for r in packing.pack_concatenated(rows, 8, 5, by=("split",)).collect()}
    for part in ("train", "val"):
        own = {(part, r.seq_id): r.seq for r in packing.pack_concatenated(rows.where(F.col("split") == part), 8, 5).collect()}
        assert own == {k: v for k, v in both.items() if k[0] == part}


def test_grouped_lines_in_blocks_equal_python(spark):
    rng = random.Random(1)
    pieces = [[rng.choice(["a", "ab", "a\n", "b x\n", "a yy z\n", "ab \n", "c " + "q" * 70]) for _ in range(n)] for n in (0, 1, 2, 3, 10, 1000, 20_000)]
    df = spark.createDataFrame(list(enumerate(pieces)), "id long, ls array<string>")
    own = {r.id: r.ps for r in df.select("id", patches.group_lines(F.col("ls"), 64).alias("ps")).collect()}
    assert own == {r.id: list(r.ps) for r in patches.group_lines_in_python(df, "ls", "ps", 64).collect()}
    assert spark.createDataFrame([(None,)], "ls array<string>").select(patches.group_lines(F.col("ls")).alias("p")).first().p is None


def test_probe_ends_where_the_gradient_does(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 5)), rng.integers(0, 3, 300)
    x[np.arange(300), y] += 1
    rows = [(list(map(float, v)), int(c)) for v, c in zip(x, y, strict=True)] + [(None, 1), ([0.0] * 5, None)]
    df = spark.createDataFrame(rows, "emb array<double>, label int")
    model = probe.fit_probe(df, penalty=0.1)
    p = probe.softmax(x @ model.weights.T + model.intercepts)
    p[np.arange(300), y] -= 1
    assert np.abs(p.T @ x / 300 + 0.1 * model.weights).max() < 1e-9 and np.abs(p.mean(axis=0)).max() < 1e-9
    assert abs(model.intercepts.sum()) < 1e-9 and model.gradient < 1e-9
    scored = probe.score_probe(model, df).collect()
    assert sum(r.pred_id == r.label for r in scored if r.emb and r.label is not None) > 180
    assert [r.pred_id for r in scored if r.emb is None] == [None]
    flat = probe.Probe(np.zeros((3, 5)), np.zeros(3), 0.0)
    assert {r.pred_id for r in probe.score_probe(flat, df.where("emb is not null")).collect()} == {0}


@pytest.mark.parametrize("rows", [[], [([1.0], -1)], [([1.0], 0), ([1.0, 2.0], 1)], [([1.0] * 1000, 10)]])
def test_probe_refuses(spark, rows):
    with pytest.raises(ValueError):
        probe.fit_probe(spark.createDataFrame(rows, "emb array<double>, label int"))


def test_bad_lines_by_file_and_line_over_many_blocks(spark, tmp_path):
    rng = random.Random(4)
    expected = set()
    for name in ("one", "two", "empty"):
        lines = [] if name == "empty" else [rng.choice(['{"k": 1}', '{"k": 22222}', "", "{bad", f"x{i}" * rng.randint(1, 30)]) for i in range(2000)]
        (tmp_path / f"{name}.json").write_text("".join(f"{line}\n" for line in lines))
        expected |= {(name, i + 1, line) for i, line in enumerate(lines) if line and not line.startswith('{"k"')}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        good, bad = records.read_records_audited(spark, str(tmp_path), "k int")
        assert good.select("file").distinct().count() == 2 and good.where("k is null").count() == 0
        assert {(os.path.basename(r.file)[:-5], r.line, r.text) for r in bad.collect()} == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_manifest_parts(spark, monkeypatch):
    monkeypatch.setattr(shards, "PART_SHARDS", 3)
    seqs = spark.range(100).select(F.col("id").alias("seq_id"), F.array(F.lit("a"), F.lit("b")).alias("seq"), F.expr("id div 10").alias("shard_id"))
    path = f"{shared_folder(spark, 'parts')}/{uuid.uuid4().hex}"
    shards.write_manifest_parts(seqs, path, {"tokenizer_name": "w"}, 2, 20)
    assert sorted((r.shard_id, r.start) for r in shards.read_manifest_parts(spark, path, 2, 7).collect()) == [(i, 10 * i) for i in range(2, 8)]
    header = spark.read.json(f"{path}/header").first()
    assert (header.shard_count, header.sequence_count, header.loss_token_count) == (10, 100, 100)
    with pytest.raises(Exception, match="exists"):
        shards.write_manifest_parts(seqs, path, {}, 2, 20)
    none = f"{path}/none"
    shards.write_manifest_parts(seqs.where("seq_id < 0"), none, {}, 2, 20)
    assert spark.read.json(f"{none}/header").first().shard_count == 0


def test_sums_over_shards_meet_in_no_task(spark):
    counts = spark.range(5000).select((F.col("id") % 2).alias("dir"), F.expr("id div 2").alias("shard_id"), F.lit(3).cast("long").alias("sequence_count"))
    out = shards.cumulative_shards(counts, ["dir", "shard_id"])
    assert out._jdf.queryExecution().executedPlan().toString().count("SinglePartition") <= 1
    assert [r.start for r in out.orderBy("dir", "shard_id").collect()] == [3 * i for i in range(5000)]


def test_discovery_stays_in_its_folder(spark):
    folder = shared_folder(spark, "found")
    spark.createDataFrame([(1, "a"), (2, "b")], "part int, value string").write.partitionBy("part").text(folder)
    names = lambda **o: [r.path.split("/")[-2] for r in records.discover_files(spark, extensions=("txt",), **o).collect()]
    assert sorted(set(names(folder=folder))) == ["part=1", "part=2"]
    for own in (f"{folder}/part=1", f"{folder}/part=1/"):
        assert set(names(folder=own, recursive=False)) == {"part=1"}
    with pytest.raises(FileNotFoundError):
        names(folder=folder, recursive=False)
    with pytest.raises(FileNotFoundError):
        names(folder=None)


def test_vectors_of_files_are_packed_with_them(spark):
    files = spark.createDataFrame([(7, ["a"] * 5), (3, ["b"] * 4), (9, []), (11, None)], "id long, seq array<string>")
    vectors = spark.createDataFrame([(3, [0.25, -0.5]), (7, [1.0, 2.0]), (9, [0.0, 0.0])], "id long, emb array<double>")
    folder = shared_folder(spark, "packed")
    jobs.write_packed_files(files, folder, 4, 8, vectors=vectors)
    got = [tuple(r) for r in shards.read_shards(spark, f"{folder}/shards", vectors=True).orderBy("seq_id").collect()]
    assert got == [(0, ["b"] * 4, [0.25, -0.5], 0), (1, ["a"] * 4, [1.0, 2.0], 0), (2, ["a", "<P>", "<P>", "<P>"], [1.0, 2.0], 1)]
    header = spark.read.json(f"{folder}/manifest/header").first()
    assert (header.separate_sequences, header.embedding_size, header.sequence_count, header.shard_count) == (True, 2, 3, 2)
    assert shards.check_shard_folder(spark, f"{folder}/shards", f"{folder}/manifest").count() == 0
    with pytest.raises(ValueError, match="separate"):
        jobs.write_packed_files(files, folder, 4, 8, separate=False, vectors=vectors)
    with pytest.raises(Exception, match="no embedding for 7"):
        jobs.write_packed_files(files, shared_folder(spark, "packed"), 4, 8, vectors=vectors.where("id <> 7"))
    with pytest.raises(Exception, match="exists"):
        jobs.write_packed_files(files, folder, 4, 8)


def test_files_in_one_run_and_none_at_all(spark):
    files = spark.createDataFrame([(1, ["a"] * 5), (2, ["b"] * 4)], "id long, seq array<string>")
    folder = shared_folder(spark, "packed")
    jobs.write_packed_files(files, folder, 4, 8, separate=False)
    seqs = [r.seq for r in shards.read_shards(spark, f"{folder}/shards").orderBy("seq_id").collect()]
    assert len(seqs) == 3 and sorted(x for s in seqs for x in s) == ["<P>"] * 3 + ["a"] * 5 + ["b"] * 4


def test_results_of_runs(spark):
    epochs = spark.createDataFrame([("a", 2, 0.5, 0.9), ("a", 1, 0.7, 0.95)], "run string, epoch long, loss double, accuracy double")
    path = shared_folder(spark, "results")
    records.write_results(epochs, spark.createDataFrame([("a", "genre", 10), ("b", None, 0)], "run string, metadata_category string, dataset_size long"), path)
    a, b = records.read_results(spark, path).orderBy("run").collect()
    assert ([e.epoch for e in a.epoch_metrics], a.max_accuracy, a.dataset_size) == ([1, 2], 0.95, 10)
    assert (b.epoch_metrics, b.max_accuracy, b.metadata_category) == ([], 0.0, None)
    with pytest.raises(Exception, match="exists"):
        records.write_results(epochs, epochs.select("run", F.lit("x").alias("metadata_category"), F.lit(1).alias("dataset_size")), path)


def test_shards_are_put_in_place_by_tasks_and_listed_by_few(spark):
    """With many shards the driver may neither rename each one's file nor send a task to list each folder; a folder for each value of a column."""
    from strophe.sources import shards
    from strophe.sources.work import shared_folder

    def jobs_of(group, run):
        spark.sparkContext.setJobGroup(group, group)
        try:
            out = run()
        finally:
            spark.sparkContext._jsc.sc().clearJobGroup()
        tracker = spark.sparkContext.statusTracker()
        infos = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds]
        return out, max((i.numTasks for i in infos if i), default=0)

    path = shared_folder(spark, "many")
    seqs = spark.range(400).select(F.col("id").alias("seq_id"), F.array(F.lit("a")).alias("seq"), F.expr("id div 2").alias("shard_id"))
    shards.write_shards(seqs.withColumn("dir", F.col("shard_id") % 2), path, by=("dir",))
    limit = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    even, tasks = jobs_of("list", lambda: shards.read_shards(spark, f"{path}/dir=0"))
    assert 0 < tasks <= 4 * spark.sparkContext.defaultParallelism < 100
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == limit
    assert sorted(r["shard_id"] for r in even.select("shard_id").distinct().collect()) == list(range(0, 200, 2)) and even.count() == 200


def test_places_of_files_are_found_without_their_tokens(spark, monkeypatch):
    """The tokens are dealt out once by file and once by shard, not for the running sum as well; rows of one id keep their own tokens."""
    seen = []
    monkeypatch.setattr(jobs, "numbered_sum", lambda df, *args, f=jobs.numbered_sum: seen.append(df.columns) or f(df, *args))
    files = spark.createDataFrame([(5, ["a"] * 5), (2, ["b"]), (5, ["c"] * 2)], "id long, seq array<string>")
    folder = shared_folder(spark, "packed")
    jobs.write_packed_files(files, folder, 4, 8)
    assert seen and all("seq" not in columns for columns in seen)
    got = {r.seq_id: [t for t in r.seq if t != a.PAD] for r in shards.read_shards(spark, f"{folder}/shards").collect()}
    assert got[0] == ["b"] and sorted([got[1], got[2], got[3]]) in ([["a"], ["a"] * 4, ["c"] * 2],)


def test_files_are_dealt_out_once_and_shards_are_compressed(spark):
    """Many ranges of ids: places, vectors and shards as by hand, each shard one task's gzip file, and the tokens in no shuffle but that to their range."""
    import glob

    rows = [(i * i - 500 if i % 97 else 12, ["\\" * (i % 2) + f'"{i}\n', *(f"t{i}.{j}" for j in range(i * 7 % 11))]) for i in range(1000)]
    files = spark.createDataFrame(rows, "id long, seq array<string>")
    vectors = files.select("id", F.array(F.col("id") / 2, F.lit(0.5)).alias("emb")).distinct()
    folder = shared_folder(spark, "packed")
    jobs.write_packed_files(files, folder, 4, 28, vectors=vectors)
    got = {r.seq_id: r for r in shards.read_shards(spark, f"{folder}/shards", vectors=True).collect()}
    own = sorted((i, seq[at : at + 4]) for i, seq in rows for at in range(0, len(seq), 4))
    assert sorted(got) == list(range(len(own)))
    assert sorted((int(2 * r.emb[0]), [t for t in r.seq if t != a.PAD]) for r in got.values()) == own
    assert [2 * got[i].emb[0] for i in range(len(own))] == [i for i, _ in own] and all(r.shard_id == i // 7 and len(r.seq) == 4 for i, r in got.items())
    starts = {i: at for at, (i, _) in reversed(list(enumerate(own)))}
    for i, seq in rows[1:97]:  # these ids have one file each
        assert [t for k in range(-(-len(seq) // 4)) for t in got[starts[i] + k].seq if t != a.PAD] == seq
    paths = glob.glob(f"{folder}/shards/shard_id=*/*")
    assert len(paths) == -(-len(own) // 7) and all(p.endswith(".json.gz") for p in paths)
    packed = packing.pack_by_range(files.withColumn("windows", F.expr("ceil(size(seq) / 4)")), *[spark.createDataFrame([(i, 1, i) for i in range(900)], "id long, windows long, before long")] * 2, 4, 7)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(part#\w+, \d+\), REPARTITION_BY_COL", plan)) == 2 and "SortMergeJoin" not in plan  # twice the same: it is reused
