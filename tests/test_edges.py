"""Hand-made edge rows for the operators."""

import pytest
from pyspark.sql import functions as F

from strophe.functions import arrays as a
from strophe.operators import corpus, metrics, packing, patches, pooling, quality, scores, sequence
from strophe.sources import records, shards


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, value, column, kind="array<string>"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("seqs", [[], [["a"] * 4], [["a"] * 9], [["x"]], [["a"] * 3, ["b"] * 5], [[], ["a"] * 2]])
def test_concatenated_packing_conserves_tokens(spark, seqs):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id long, seq array<string>")
    out = packing.pack_concatenated(df, 4, 1).orderBy("seq_id").collect()
    total = sum(map(len, seqs))
    assert len(out) == -(-total // 4)
    assert all(len(r.seq) == 4 for r in out)
    assert sum(x != a.PAD for r in out for x in r.seq) == total
    assert all(a.PAD not in r.seq for r in out[:-1])


def test_separate_packing_pads_no_full_window(spark):
    df = spark.createDataFrame([(0, ["a"] * 4), (1, ["b"] * 9), (2, []), (3, ["c"])], "id long, seq array<string>")
    got = sorted((r.id, r.window, r.seq) for r in packing.pack_separate(df, 4).collect())
    assert got == [(0, 0, ["a"] * 4), (1, 0, ["b"] * 4), (1, 1, ["b"] * 4), (1, 2, ["b"] + [a.PAD] * 3), (3, 0, ["c"] + [a.PAD] * 3)]


def test_complete_windows(spark):
    s = ["x", "<E>", "<S>", "a", "<S>", "b", "<E>", "y", "<E>", "<S>", "open"]
    assert [tuple(x) for x in one(spark, s, sequence.closed_segments(F.col("s")))] == [(5, 7)]
    double = lambda c: F.concat(c, c)
    assert one(spark, s, sequence.apply_to_complete_windows(F.col("s"), double)) == s
    short = lambda c: F.slice(c, 1, 1)
    assert one(spark, s, sequence.apply_to_complete_windows(F.col("s"), short)) == [*s[:4], "<S>", "<P>", "<P>", *s[7:]]
    assert one(spark, [], sequence.apply_to_complete_windows(F.col("s"), double)) == []


def test_tempo_keeps_length_and_partial_edges(spark):
    s = ["dur:100", "<E>", "<S>", "dur:100", "note:1:2", "<E>", "<S>", "dur:100"]
    got = one(spark, s, sequence.apply_to_complete_windows(F.col("s"), lambda c: sequence.scale_times(c, F.lit(120))))
    assert got == ["dur:100", "<E>", "<S>", "dur:120", "note:1:2", "<E>", "<S>", "dur:100"]


def test_pad_rules_differ(spark):
    c = F.col("s")
    assert one(spark, ["a", "b"], a.pad_last_cell(c, 4)) == ["a", "b", "<P>", "<E>"]
    assert one(spark, ["a", "b"], a.pad_last_token(c, 4)) == ["a", "<E>", "<P>", "<P>"]
    assert one(spark, ["a", "<P>", "<D>", "<D>"], a.pad_augmented(c, 4)) == ["a", "<D>", "<P>", "<E>"]
    assert one(spark, ["a", "b", "c", "<E>"], a.pad_last_cell(c, 4)) == ["a", "b", "c", "<E>"]
    assert one(spark, [], a.pad_last_token(c, 4)) is None


@pytest.mark.parametrize(("n", "starts"), [(3, [1]), (4, [1]), (5, [1, 2]), (8, [1, 5]), (9, [1, 5, 6])])
def test_overlapping_segments(spark, n, starts):
    s = [str(i) for i in range(1, n + 1)]
    assert one(spark, s, a.overlapping_segments(F.col("s"), 4)) == [s[i - 1 : i + 3] for i in starts]


def test_dedup_keeps_the_first_source(spark):
    mk = lambda x: spark.createDataFrame(x, "id long, hash string")
    got = rows(corpus.combine_datasets(mk([(5, "h"), (7, "h"), (9, "k")]), mk([(1, "h"), (2, "z")])).select("id", "hash", "source_ordinal"))
    assert sorted(got) == [(2, "z", 1), (5, "h", 0), (9, "k", 0)]
    kept, audit = corpus.dedup_keep_first(mk([(3, "h"), (1, "h"), (2, "h")]), "hash", ["id"])
    assert rows(kept) == [(1, "h")] and sorted((r["hash"], r["kept"][0], r["duplicate"][0]) for r in audit.collect()) == [("h", 1, 2), ("h", 1, 3)]
    assert rows(corpus.dedup_keep_first(mk([(1, "h"), (1, "h")]), "hash", ["id"])[0]) == [(1, "h")]
    assert corpus.dedup_keep_first(kept, "hash", ["id"])[1].count() == 0


def test_split_is_a_disjoint_cover(spark):
    d = corpus.ratio_split(spark.range(500), "id", 0.8, 1)
    assert sum(r["count"] for r in d.groupBy("split").count().collect()) == 500
    assert sequence.exact_split(spark.range(50), "id", 0.3, 1).where("split = 'eval'").count() == 15


def test_shuffles_are_permutations(spark):
    d = sequence.block_shuffle(spark.range(25).withColumn("index", F.col("id")), "index", 10, 3)
    got = [r.id for r in d.orderBy("rank").collect()]
    assert sorted(got) == list(range(25)) and got[20:] == [20, 21, 22, 23, 24]
    assert {x // 10 for x in got[:10]} == {0}
    s = sequence.rank_sharded(spark.range(10), "id", 1, 0, 4)
    assert sorted(r["count"] for r in s.groupBy("replica").count().collect()) == [3, 3, 3, 3]


def test_quality_edges(spark):
    notes = spark.createDataFrame([(1, 0, 0, 5, 60, 10, "piano"), (2, 1, 0, 100, 60, 10, "piano"), (2, 2, 10, 1, 60, 10, "piano"), (2, 3, 90, 1, 60, 10, "bass")], "piece_id long, note_id long, onset long, dur long, pitch int, velocity int, instrument string")
    assert {r.piece_id: r.value for r in quality.note_pitch_entropy(notes, 0.1).collect()} == {1: 0.0, 2: 0.0}
    assert {r.piece_id: r.value for r in quality.silent_interval(notes, 5).collect()} == {1: 0.0, 2: 0.0}  # the long note covers the gap
    suite = quality.quality_suite(notes, {"max_instruments": {"run": True, "args": {"max_instruments": 1}}, "unique_pitch_count": {"run": True, "args": {"min_num_unique_pitches": 2}}, "length": {"run": False}})
    assert {r.piece_id: len(r.failures) for r in suite.collect()} == {1: 1, 2: 2}
    with pytest.raises(ValueError, match="unknown tests"):
        quality.quality_suite(notes, {"nothing": {"run": False}})


def test_report_is_safe_without_rows(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 1)], "true_id int, pred_id int")
    tags = spark.createDataFrame([(0,), (1,), (2,)], "tag_id int")
    got = {r.tag_id: (r.precision, r.recall, r.f1) for r in metrics.classification_report(pairs, tags).collect()}
    assert got == {0: (0.0, 0.0, 0.0), 1: (0.5, 1.0, pytest.approx(2 / 3)), 2: (0.0, 0.0, 0.0)}
    assert metrics.overall(pairs.limit(0), tags).first()["accuracy"] == 0


def test_vote_ties_go_to_the_lowest(spark):
    d = spark.createDataFrame([(1, 3, 0.5, 4), (1, 2, 1.0, 2), (1, 7, 0.1, 1)], "file_id int, class_id int, prob double, nonpad int")
    assert rows(metrics.file_vote(d)) == [(1, 2)]


def test_losses(spark):
    d = spark.createDataFrame([(0, 1.0, True), (0, 3.0, True), (1, 8.0, True), (2, 9.0, False)], "batch int, loss double, mask boolean")
    r = metrics.loss_reductions(d).first()
    assert (r.token_mean, r.batch_mean) == (4.0, pytest.approx(10 / 3))
    assert metrics.loss_reductions(d.limit(0)).first()["token_mean"] == 0
    steps = metrics.accumulate(spark.createDataFrame([(0, i, 1.0, 2) for i in range(1, 6)], "pass int, batch int, loss double, tokens long"), 2)
    assert sorted(rows(steps.select("step", "tokens", "partial"))) == [(0, 4, False), (1, 4, False), (2, 2, True)]


def test_sampling_filters(spark):
    p = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.7), (0, 2, 0.2), (1, 0, 0.4), (1, 1, 0.4), (1, 2, 0.2)], "group_id int, token_id int, prob double")
    assert {(r.group_id, r.token_id) for r in scores.top_p(p, 0.75).collect()} == {(0, 1), (0, 2), (1, 0), (1, 1)}
    assert scores.draw(scores.min_p(scores.top_p(p, 0.95), 0.1), 1).count() == 2
    assert sorted(rows(scores.greedy(p.withColumnRenamed("prob", "score")))) == [(0, 1), (1, 0)]


def test_pooling_and_losses(spark):
    v = spark.createDataFrame([(0, 0, 0, [1.0, 0.0]), (0, 0, 1, [1.0, 0.0]), (0, 1, 0, [0.0, 1.0]), (0, 1, 1, [0.0, 1.0])], "batch int, id int, view int, emb array<double>")
    assert pooling.contrastive_loss(pooling.pairs_in_batch(v, "batch", "id", "view"), "batch", 1.0).first()["loss"] == pytest.approx(0.31326, abs=1e-4)
    w = spark.createDataFrame([(0, 1, [1.0]), (0, 3, [5.0])], "id int, n int, emb array<double>")
    assert pooling.weighted_mean(w, "id", "n").first()["emb"] == [4.0]


def test_patches(spark):
    s = "ticks_per_beat 480\nnote_on 1 2\nnote_on 3 4\nnote 5\n" + "x" * 70 + " y\n"
    got = one(spark, s, patches.group_lines(patches.lines_of(F.col("s"))), "string")
    assert got == ["ticks_per_beat 480\n", "note_on 1 2\t3 4\n\t5\n".replace("\n\t", "\t"), "x" * 70 + " y\n"]
    assert one(spark, "|:a|b||c", patches.split_bars(F.col("s")), "string") == ["|:a|", "b||"]
    assert one(spark, "nothing", patches.split_bars(F.col("s")), "string") == []
    assert one(spark, "X:1\nL:1/8\n|:a|b|\n", patches.bar_patches(F.col("s")), "string")[0] == "X:1\n"


def test_manifest_and_shards(spark):
    s = spark.createDataFrame([(i, ["a"] * 30 + ["<P>"] * 2) for i in range(6)], "seq_id long, seq array<string>")
    sharded = shards.assign_shards(s, 32, 64)
    m = shards.build_manifest(sharded, "t", {}, 32, 64).first()
    assert (m.sequence_count, m.loss_token_count, len(m.shards)) == (6, 6 * 29, 3)
    assert shards.build_manifest(sharded.limit(0), "t", {}, 32, 64).first()["sequence_count"] == 0
    with pytest.raises(ValueError, match="hold a sequence"):
        shards.assign_shards(s, 32, 16)
    expected = spark.createDataFrame([(0, 2), (1, 3), (9, 1)], "shard_id long, expected long")
    assert sorted(rows(shards.check_shards(sharded, expected))) == [(1, 2, 3), (2, 2, 0), (9, 0, 1)]


def test_tags(spark):
    r = spark.createDataFrame([(1, "jazz"), (2, None), (3, "polka")], "id int, tag string")
    good, bad = corpus.map_tags_strict(r, "genre")
    assert [x.id for x in good.collect()] == [1] and sorted(x.id for x in bad.collect()) == [2, 3]
    with pytest.raises(ValueError, match="other"):
        corpus.map_tags_other(r, ["jazz"])


def test_embeddings_must_fit(spark):
    s = spark.createDataFrame([("a",), ("b",)], "path string")
    with pytest.raises(Exception, match="no embedding for b"):
        corpus.attach_embeddings(s, spark.createDataFrame([("a", [1.0])], "path string, emb array<float>"), "path").collect()
    with pytest.raises(ValueError, match="differ in size"):
        corpus.attach_embeddings(s, spark.createDataFrame([("a", [1.0]), ("b", [])], "path string, emb array<float>"), "path")


def test_strict_and_tolerant_records(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"k": 1}\nnot json\n')
    assert sorted(str(r.k) for r in records.read_records(spark, str(tmp_path / "r.json"), "k int", tolerant=True).collect()) == ["1", "None"]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        records.read_records(spark, str(tmp_path / "r.json"), "k int").collect()
    with pytest.raises(FileNotFoundError):
        records.discover_files(spark, str(tmp_path))
    out = str(tmp_path / "out")
    records.write_records(spark.range(2), out)
    with pytest.raises(Exception, match="(?i)exists"):
        records.write_records(spark.range(2), out)


def test_lineage_chain(spark):
    d = spark.createDataFrame([(i, i - 1 if i else None, 10, 100) for i in range(7)], "phase int, parent int, steps long, tokens long")
    assert sorted(rows(metrics.lineage(d).select("phase", "start_step", "start_tokens"))) == [(i, 10 * i, 100 * i) for i in range(7)]
    long = spark.createDataFrame([(i, i - 1 if i else None, 1, 2) for i in range(70)] + [(100, 101, 1, 1), (101, 100, 1, 1), (102, 999, 1, 1)], "phase int, parent int, steps long, tokens long")
    got = {p: (s, t) for p, s, t in rows(metrics.lineage(long).select("phase", "start_step", "start_tokens"))}
    assert all(got[i] == (i, 2 * i) for i in range(70)) and got[100] == got[101] == (None, None) and got[102] == (0, 0)


def test_sequence_lookup_and_path_order(spark):
    sizes = [3, 1, 0, 5, 2]
    d = shards.cumulative_shards(spark.createDataFrame(list(enumerate(sizes)), "shard_id long, sequence_count long"), ["shard_id"])
    found = shards.sequence_at(spark.range(-1, 14).select(F.col("id").alias("index")), d)
    truth = [(sum(sizes[:s]) + i, s, i) for s, n in enumerate(sizes) for i in range(n)]
    assert sorted(rows(found.select("index", "shard_id", "local_index"))) == truth
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    paths = [f"https://one.host/{i % 7}/{i}" for i in range(300)] + ["a", "", "https://one.host/3/3"]
    got = records.ranged_positional(spark.createDataFrame(list(enumerate(paths)), "n int, path string"), ["path", "n"])
    assert [r.n for r in sorted(got.collect(), key=lambda r: r["index"])] == [n for _, n in sorted((p, n) for n, p in enumerate(paths))]
