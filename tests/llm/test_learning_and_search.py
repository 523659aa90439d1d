"""op11 to op13: the classifier's risk, prior and held-out accuracy; spelling variants and hard negatives against brute force."""

import random
import zlib

import numpy as np
import pytest

from strophe.llm import hard_negatives, positive_unlabelled, spelling
from strophe.llm.common import materialise, work_dir
from strophe.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, word string, n long"
SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7.0, "w", 3) for i, t in rows], DOCS)


# --- positive-unlabelled quality -------------------------------------------------------------------------------------------


def test_risk_minimum_is_exact():
    rng = np.random.default_rng(3)
    w = positive_unlabelled.WIDTH
    x = np.zeros((400, w))
    x[:, :3] = rng.normal(size=(400, 3)) + (np.arange(400) < 200)[:, None]
    x[:, -1] = 1
    p, u = x[:150].T @ x[:150] / 150, x.T @ x / 400

    def risk(v, prior):
        z_p, z_u = x[:150] @ v, x @ v
        rest = ((z_u + 1) ** 2).mean() / 4 - prior * ((z_p + 1) ** 2).mean() / 4
        return prior * ((z_p - 1) ** 2).mean() / 4 + max(0.0, rest) + 1e-3 * (v[:-1] ** 2).sum()

    for prior in (0.3, 0.5, 0.9, 0.99):  # the last two drive the unlabelled risk below 0
        best = positive_unlabelled.fit(p, u, prior, 1e-3)
        for step in (1e-3, 1e-2, 0.3):
            for _ in range(60):
                move = np.zeros(w)
                move[[0, 1, 2, w - 1]] = rng.normal(size=4) * step
                assert risk(best + move, prior) >= risk(best, prior) - 1e-6


def test_prior_from_histograms():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0.8, 0.05, 30_000), rng.normal(0.3, 0.1, 10_000)
    bins = lambda x: np.histogram(x, 1000, (0, 1))[0].astype(float)
    assert abs(positive_unlabelled.best_bin_prior(bins(good[:9000]), bins(np.concatenate((good, bad)))) - 0.75) < 0.03


def test_moments_are_sums_over_all_rows(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ab", "Cd.", "e!!", "1"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    described = positive_unlabelled.features(docs(spark, enumerate(texts)).repartition(5)).select("doc_id", "x")
    x = positive_unlabelled.vectors([positive_unlabelled.describe(t) for t in texts])
    assert np.allclose(positive_unlabelled.moments(described), x.T @ x)


def test_quality_held_out(spark):
    found = {r["doc_id"]: r for r in QUERIES["op11_quality_classifier"](spark, SF).collect()}
    assert len(found) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [found[i]["score"] for i, q in labels.items() if q == 1 and found[i]["held_out"]]
    bad = [found[i]["score"] for i, q in labels.items() if q == 0 and found[i]["held_out"]]
    assert min(good) >= 0.3 and np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.98


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "x" * 3_000_000), (4, "x" * 3_000_000), (5, "a b c.\n" * 50_000)]
    described = positive_unlabelled.features(docs(spark, rows))
    assert set(described.columns) == {"doc_id", "lang", "source", "n_chars", "score", "word", "n", "x"}
    labels = spark.createDataFrame([(4, 1), (5, 1), (5, 0), (None, 1), (1, 0)], "doc_id long, quality int")
    trusted = positive_unlabelled.trusted_positives(labels)
    assert [r["doc_id"] for r in trusted.collect()] == [4]
    found = positive_unlabelled.score(described, positive_unlabelled.learn(described, trusted)).collect()
    assert len(found) == 7 and len({r["score"] for r in found if r["doc_id"] == 4}) == 1 and len({r["score"] for r in found if r["doc_id"] in (1, 2)}) == 1
    none = positive_unlabelled.learn(described, trusted.where("false"))
    assert {r["score"] for r in positive_unlabelled.score(described, none).collect()} == {0.5}
    empty = described.where("false")
    assert positive_unlabelled.score(empty, positive_unlabelled.learn(empty, trusted)).count() == 0


# --- spelling variants -----------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def brute_variants(counts, ratio=10):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


def variants(spark, counts, **more):
    rows = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, form int")
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.group_variants(rows, **more).collect()}


@pytest.mark.parametrize("most", [3, 4096])
def test_variants_brute_force(spark, most):
    """A small bound on a cell makes it cut cells down to spans of one place."""
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(300)} | {"z" * n for n in range(4, 12)}
    counts = {w: rng.choice([2, 3, 20, 30, 200, 250, 2500, 30_000]) for w in words}
    assert variants(spark, counts, least_chars=4, most=most) == brute_variants(counts)


def test_variants_many_in_one_cell(spark):
    counts = {"commonhead" + a + b: 2 for a in "abcdefghij" for b in "abcdefghij"} | {"commonheada": 500, "commonhead" + "q" * 20_000: 2, "commonhead" + "q" * 20_001: 50}
    found = variants(spark, counts, most=16)
    assert found == brute_variants(counts)


def test_variants_batches_of_cells(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BATCH", 7)
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 6))) for _ in range(120)})
    rows = sorted((1000 * n + 10 * lo + hi + 7 * (w[:lo] == "a"), n, lo, hi, w, 2) for w in words for n in (len(w), len(w) - 1) if n >= 4 for lo, hi in ((0, n),))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([dict(zip(("key", "shorter", "low", "high", "word", "n"), r, strict=True)) for r in rows])
    out = [r for b in spelling._scan(iter([batch.slice(i, 5) for i in range(0, len(rows), 5)])) for r in b.to_pylist()]
    total = {}
    for r in out:
        total[r["word"]] = total.get(r["word"], 0) + r["n_near"]
    assert total == {w: n for w in words if (n := sum(one_edit(w, x) for x in words))}


def test_vocabulary(spark):
    rows = [(1, "Hello wonderful WONDERFUL wonderful. Ünderfuls"), (1, "wonderful"), (2, None), (None, "wonderful straße"), (3, ""), (4, "×wonderful÷ " * 40_000)]
    want = {}
    import re

    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] = want.get(w, 0) + 1
    found = {r["word"]: r["n"] for r in spelling.vocabulary(docs(spark, rows)).collect()}
    assert found == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert spelling.group_variants(spelling.vocabulary(docs(spark, rows).where("false"))).count() == 0


# --- hard negatives --------------------------------------------------------------------------------------------------------


def brute_negatives(rows, anchor):
    """rows: id -> (label, vector)"""
    out = set()
    for a, (label, v) in rows.items():
        if not anchor(a):
            continue
        scores = {i: sum(x * y for x, y in zip(v, w, strict=False)) for i, (_, w) in rows.items()}
        best = lambda ids: sorted(ids, key=lambda i: (-scores[i], i))  # noqa: B023, E731
        for p in best(i for i in rows if i != a and rows[i][0] == label)[:5]:
            hard = best(i for i in rows if rows[i][0] != label and 50 * scores[p] <= 100 * scores[i] <= 95 * scores[p])[:3]
            out |= {(a, p, n + 1, i, scores[p], scores[i]) for n, i in enumerate(hard)}
    return out


VECTORS = "vec_id long, label int, vector array<long>, score long, slot int, page int"


def mined(spark, rows, **more):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, y, v, 0, 0, 0) for i, (y, v) in rows], VECTORS).repartition(3)
    out = hard_negatives.mine(frame, F.col("vec_id") % 5 == 0, **more)
    found = [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in out.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize(("seed", "most", "size"), [(1, 3, 8), (2, 90, 13), (3, 2**21, 64)])
def test_negatives_brute_force(spark, seed, most, size):
    """Few values make ties; pages of three anchors make several passes."""
    rng = random.Random(seed)
    rows = {i: (rng.choice([1, 1, 2, 3]), [rng.randint(-most, most) for _ in range(size - (i % 3 == 0))]) for i in rng.sample(range(-300, 300), 150)}
    assert mined(spark, rows.items(), page=7) == brute_negatives(rows, lambda i: i % 5 == 0)


def test_planes_give_products():
    rng = np.random.default_rng(2)
    a, c = rng.integers(-500, 500, (9, 24)), rng.integers(-512, 512, (31, 24))
    assert (hard_negatives.scores(hard_negatives.bit_planes(c, 10), hard_negatives.subset_sums(a)) == c @ a.T).all()


def test_negatives_edges(spark):
    same = {i: (1 + i % 2, [2, 3]) for i in range(40)}
    rows = [*same.items(), *same.items(), (None, (1, [1, 1])), (100, (None, [1, 1])), (105, (1, None)), (110, (1, [None, 1]))]
    assert mined(spark, rows) == brute_negatives(same, lambda i: i % 5 == 0) == set()
    near = same | {200: (1, [0, 0]), 205: (3, []), 7: (9, [1, 2])}
    assert mined(spark, near.items()) == brute_negatives(near, lambda i: i % 5 == 0) != set()
    assert mined(spark, []) == mined(spark, [(1, (1, [1])), (2, (1, [1]))]) == mined(spark, [(5, (1, []))]) == set()
    with pytest.raises(ValueError, match="2\\*\\*62"):
        mined(spark, [(5, (1, [2**40]))])


def test_quantise(spark):
    rows = [(1, [0.5, -0.001]), (2, [float("nan")]), (3, [None]), (4, None), (5, []), (6, [float("-inf")])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", hard_negatives.quantise().alias("v"))
    assert {r["vec_id"]: r["v"] for r in d.collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: [], 6: None}


def test_written_tables_are_in_the_shared_folder(spark):
    path = work_dir(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and materialise(spark.range(3), path, "t").count() == 3
