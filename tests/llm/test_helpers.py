"""Parts of the operators against brute force, without Spark."""

import itertools
import random

import numpy as np
import pytest

from strophe.llm import best_fit, crf, html_text, language, lm_score, near_dedup, quality, token_files
from strophe.llm.queries import tokenizer_path
from strophe.llm.shingles import shingle_hashes, words
from strophe.llm.tokenise import encoder

ODD = ["", "  a", "a  b", " a", " \n b", "a \n b\n", "x\xa0y \xa0z", "it's 'll  's x's", "<|endoftext|>hi", "a\x1cb c", "ñ ² ½ x²", "日本 語。 　x", "\t\ta  ", "a ", " ", "é", "Ünï-cödé, l'été. 12.5% (x)\n\n\ny", "a.b,c;d: e", "x" * 5000, "\x0b a\x85b"]


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_library(text):
    e = encoder(tokenizer_path())
    assert e.encode(text) == e.whole(text)
    assert e.encode(text) == e.whole(text)  # again, from the cache


def test_ids_of_random_texts():
    rng, e = random.Random(1), encoder(tokenizer_path())
    for _ in range(300):
        text = "".join(rng.choice("ab Z,.'s\n\té1²  ß日") for _ in range(rng.randint(0, 60)))
        assert e.encode(text) == e.whole(text), repr(text)


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1, 7], list(range(0, 200_000, 97))])
def test_codes_round_trip_and_random_access(ids):
    docs = [np.array(ids[: len(ids) // 2], np.uint32), np.array(ids[len(ids) // 2 :], np.uint32)]
    s = token_files.Segment(token_files.pack_segment([3, None], docs, 11))
    assert s.decode().tolist() == ids and s.doc_ids == [3, None] and s.lengths.tolist() == [len(d) for d in docs] and s.before == 11
    for i in {*range(min(len(ids), 600)), max(len(ids) - 1, 0)} if ids else ():
        assert s[i] == ids[i]
    with pytest.raises(IndexError):
        s[len(ids)]


@pytest.mark.parametrize("n", [1, 5, 6, 7, 12, 13, 25])
def test_only_the_first_piece_is_short(n):
    pieces = best_fit.cut(n, 6)
    assert sum(k for _, k in pieces) == n and all(k == 6 for _, k in pieces[1:])
    assert [s for s, _ in pieces] == [sum(k for _, k in pieces[:i]) for i in range(len(pieces))]


@pytest.mark.parametrize("seed", range(4))
def test_packing_holds_every_item_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 129, 400) if seed else rng.choice([60, 64, 70, 128], 400)
    counts = np.bincount(lengths, minlength=129)
    patterns = [p for kind in best_fit.solve(counts, 128).values() for p in kind]
    assert (sum(p * n for p, n in patterns) == counts).all()
    assert all(p @ np.arange(129) <= 128 for p, _ in patterns)
    salts = rng.integers(0, best_fit.SALTS, 400)
    per_salt = np.zeros((129, best_fit.SALTS), np.int64)
    np.add.at(per_salt, (lengths, salts), 1)
    slots = best_fit.Slots(patterns, np.cumsum(per_salt, 1) - per_salt)
    own, seen = {}, {}
    numbers = np.array([own.update({(x, s): own.get((x, s), -1) + 1}) or own[x, s] for x, s in zip(lengths.tolist(), salts.tolist(), strict=True)])
    for q, offset, length in zip(*(x.tolist() for x in slots.place(lengths, salts, numbers)), lengths.tolist(), strict=True):
        seen.setdefault(q, []).append((offset, length))
    assert len(seen) == sum(n for _, n in patterns)
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length


@pytest.mark.parametrize("seed", range(8))
def test_about_as_few_sequences_as_best_fit_alone(seed):
    rng = np.random.default_rng(seed)
    shape = [rng.integers(1, 513, 4000), np.minimum(rng.lognormal(4.6, 1, 4000).astype(int) + 1, 512), rng.choice(rng.integers(1, 513, 40), 4000), rng.integers(100, 300, 4000)][seed % 4]
    counts = np.bincount(shape, minlength=513) * (1 if seed < 4 else 37)
    kinds = best_fit.solve(counts, 512)
    n = {kind: sum(n for _, n in p) for kind, p in kinds.items()}
    least = -(-int(counts @ np.arange(513)) // 512)
    assert least <= sum(n.values()) <= 1.003 * sum(n for _, n in best_fit.best_fit(counts, 512))
    assert n["rounded"] + n["residual"] >= 0.9 * (sum(n.values()) - n["whole"])


def test_passes_of_the_program_leave_less_to_price():
    counts = np.bincount(np.minimum(np.random.default_rng(4).lognormal(4.6, 1, 20_000).astype(int) + 1, 512), minlength=513)
    n = [{kind: sum(n for _, n in p) for kind, p in best_fit.rounded(counts, 512, 300, 1.02, passes).items()} for passes in (1, 4)]
    assert n[1]["rounded"] > n[0]["rounded"] and n[1]["residual"] < n[0]["residual"]
    assert sum(n[1].values()) <= 1.003 * sum(n[0].values())


def test_empty_histogram():
    assert not any(best_fit.solve(np.zeros(17, np.int64), 16).values())


def test_knapsack_is_exact():
    rng = np.random.default_rng(5)
    left = np.zeros(21, np.int64)
    left[[3, 4, 7, 9]] = [2, 3, 1, 2]
    w = np.where(left > 0, rng.random(21), 0)
    best = max((sum(c * w[s] for c, s in zip(x, (3, 4, 7, 9), strict=True)), x) for x in itertools.product(range(3), range(4), range(2), range(3)) if sum(c * s for c, s in zip(x, (3, 4, 7, 9), strict=True)) <= 20)
    assert best_fit.price(w, left, 20) @ w == pytest.approx(best[0])


def test_words_and_shingles():
    assert words("Ab\x0bc\x85d É\x1ce\n") == ["ab".encode(), "c\x85d".encode(), "É\x1ce".encode()]
    assert words(None) == words("") == words(" \t\n") == []
    assert len(shingle_hashes(words("a b"), 4)) == 1 and len(shingle_hashes(words("a b c d e"), 4)) == 2 and len(shingle_hashes([], 4)) == 0
    assert shingle_hashes(words("a b"), 4)[0] != shingle_hashes(words("b a"), 4)[0]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = np.unique(x[:900]), np.unique(x[100:])
    assert abs((near_dedup.signature(a) == near_dedup.signature(b)).mean() - 0.8) < 0.17
    assert near_dedup.fingerprint(a) != near_dedup.fingerprint(b) and near_dedup.fingerprint(a) == near_dedup.fingerprint(np.unique(a[::-1]))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for labels in (2, 3):
        m = crf.Crf(rng.normal(size=(6, labels)), rng.normal(size=labels), rng.normal(size=(labels, labels)))
        f = rng.integers(0, 6, (5, 2))
        emit = m.scores(f)
        value = lambda y: m.start[y[0]] + sum(emit[t, y[t]] for t in range(5)) + sum(m.step[y[t], y[t + 1]] for t in range(4))  # noqa: B023, E731
        assert tuple(m.viterbi(f)) == max(itertools.product(range(labels), repeat=5), key=value)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    m = crf.Crf(rng.normal(size=(5, 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
    f, y = rng.integers(0, 5, (1, 4, 2)), rng.integers(0, 2, (1, 4))

    def likelihood() -> float:
        emit = m.scores(f[0])
        value = lambda z: m.start[z[0]] + sum(emit[t, z[t]] for t in range(4)) + sum(m.step[z[t], z[t + 1]] for t in range(3))
        return value(y[0]) - np.log(sum(np.exp(value(z)) for z in itertools.product(range(2), repeat=4)))

    for param, grad in zip((m.weights, m.start, m.step), crf._gradient(m, f, y), strict=True):
        for i in np.ndindex(param.shape):
            before = likelihood()
            param[i] += 1e-6
            assert (likelihood() - before) / 1e-6 == pytest.approx(grad[i], abs=1e-4)
            param[i] -= 1e-6


def test_repeated_words():
    rng = random.Random(6)
    for _ in range(60):
        w = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 60))]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
        assert quality.repeated_words(w) == len(covered)


def test_quality_base_counts():
    m = crf.Crf(np.zeros((quality.KINDS * quality.BUCKETS + 1, 2)), np.array([0.0, 1.0]), np.zeros((2, 2)))
    m = quality.Model(m, 0.5)
    assert quality.judge(None, m)[:7] == quality.judge(" \n", m)[:7] == (0, 0, 0, 0, 0, True, False)
    assert quality.judge("é #b\n\né #b\n \n \n c|", m)[:4] == (5, 8, 3, 1)


def test_line_labels_are_inferred_from_documents():
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice(["some", "plain", "words", "stand", "here", "today"]) for _ in range(9)) + "."
    junk = lambda: " ".join(w.upper() + "!!" for w in plain().split())
    made = []
    for i in range(120):
        lines = [(plain(), 0) for _ in range(rng.randint(1, 9))] + [(junk(), 1) for _ in range(rng.randint(1, 9) * (i % 2))]
        rng.shuffle(lines)
        made.append((lines, 1 - i % 2))
    train, held = made[:80], made[80:]
    m = quality.fit(["\n".join(x for x, _ in lines) for lines, _ in train], [y for _, y in train])
    marks = [(v, y) for lines, _ in held for v, (_, y) in zip(m.field.viterbi(quality.line_features([x for x, _ in lines])), lines, strict=True)]
    assert sum(v == y for v, y in marks) > 0.97 * len(marks)
    shares = [quality.content_share([x for x, _ in lines], m.field) for lines, y in held if not y]
    assert len({round(s, 1) for s in shares}) > 4 and 0 < m.share <= 1


def test_language_judgement():
    c = language.Classifier({"xx": b"banana bandana " * 40, "yy": b"wolke berg tal " * 40})
    assert c.judge("bandana banana banana bandana", 0.001)[0] == "xx" and c.judge("WOLKE, BERG! TAL wolke berg tal", 0.001)[0] == "yy"
    for text in (None, "", "12 ... \n", "²½"):
        assert c.judge(text, 0.001) == ("und", 0.0, True)
    assert language.Classifier({}).judge("a", 0.1) == ("und", 0.0, True)
    assert language.Classifier({"xx": b"a"}).judge("a", 0.1) == ("xx", 0.0, False)


def test_vocabulary_and_both_levels_are_normalised():
    """More units than groups: each context's probabilities over all units sum to one, and equal the two levels by hand."""
    n = 1000
    unigram = 1 / np.arange(1, n + 1)
    m = lm_score.LogBilinear(unigram)
    rng = np.random.default_rng(9)
    runs = np.stack((rng.integers(0, n + 1, 400), rng.integers(0, n + 1, 400), rng.integers(0, n, 400)), axis=1)
    m.train(runs, np.ones(400), unigram, steps=40, batch=64)
    every = np.arange(n)
    for far, near in ((lm_score.BEGIN, lm_score.BEGIN), (n, 7), (3, 500)):
        got = m.log10(np.full(n, far), np.full(n, near), every)
        assert (10**got).sum() == pytest.approx(1, abs=1e-5)
        rows, d = m.rows.astype(float), m.size
        h = np.append(rows[near, :d] @ rows[-2 * d : -d, :d] + rows[far, :d] @ rows[-d:, :d], 1)
        s = np.exp(rows[n + 1 : n + 1 + m.groups] @ h)
        t = np.exp(rows[n + 1 + m.groups : -2 * d] @ h)
        truth = [np.log10(s[g] / s.sum() * t[u] / t[m.starts[g] : m.ends[g]].sum()) for u, g in zip(every, m.group, strict=True)]
        assert got == pytest.approx(np.array(truth), abs=1e-4)


def test_model_is_normalised():
    m = lm_score.LogBilinear(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES))
    rng = np.random.default_rng(8)
    runs = rng.integers(0, lm_score.CLASSES, (50, 3)).astype(np.uint8)
    m.train(runs, np.ones(50, np.float32), np.full(lm_score.CLASSES, 1 / lm_score.CLASSES), steps=30, batch=64)
    every = np.arange(lm_score.CLASSES)
    for far, near in ((lm_score.BEGIN, lm_score.BEGIN), (3, 5)):
        p = 10 ** m.log10(np.full(len(every), far), np.full(len(every), near), every)
        assert p.sum() == pytest.approx(1)
    assert 10 ** m.log10(runs[:, 0].astype(int), runs[:, 1].astype(int), runs[:, 2].astype(int)).mean() > 1 / lm_score.CLASSES


@pytest.fixture(scope="module")
def page_model():
    return html_text.learn()


PARAGRAPH = "A long enough paragraph of the story, with some commas, and a full stop."
PAGES = [
    (None, ""), ("", ""), ("<html><body></body></html>", ""),
    (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title &amp; more</h1><p>{PARAGRAPH}<p>{PARAGRAPH} <b>bold</b>ly&nbsp;\n said</article><footer>&copy; us</footer>", f"Title & more {PARAGRAPH} {PARAGRAPH} boldly said"),
    (f"<body><div class='cookie-notice'><p>We use cookies.</p></div><main><h2>Head</h2><p>{PARAGRAPH}</p><div class=ad>Buy now, cheap.</div><p>{PARAGRAPH}</p></main><div id=comments><div class=comment><p>First! Great post.</p></div></div><script>var a='<p>x</p>';</script><!-- <p>no</p> -->", f"Head {PARAGRAPH} {PARAGRAPH}"),
    (f"<header>Site</header><article><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></article><aside><p>Related things to read.</p></aside><form><label>Mail</label><button>Go</button></form><p cla", f"{PARAGRAPH} {PARAGRAPH}"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page_model, page, text):
    assert html_text.main_text(page, page_model) == text


BODY = f"<article><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></article>"
OPEN = [
    f"<html><head><meta charset=u><title>t</title><body>{BODY}", f"<head><title>t</title><style>p{{}}</style><link href=x>{BODY}", f"<head><script>var b='<body>';</script><!-- <p>no</p> --></script>\n<body>{BODY}</body>",
    f"<svg class=x />{BODY}", f"<svg class=x />{BODY}<svg><path d='m'/></svg>", f"<svg><title>no</title><path d='m'/><g>{BODY}<svg><text>no</text></svg>", f"<svg><foreignObject><p>no</p></foreignObject><text>no</text></svg>{BODY}",
    f"<template id=x/>{BODY}<template><p>no</p></template>", f"<textarea name=x />{BODY}", f"<select />{BODY}", f"<noscript/>{BODY}<noscript><p>no</p></noscript>",
]


@pytest.mark.parametrize("page", OPEN)
def test_open_heads_and_self_closed_tags(page_model, page):
    assert html_text.main_text(page, page_model) == f"{PARAGRAPH} {PARAGRAPH}"


def test_held_out_layouts(page_model):
    right = total = 0
    for page in html_text.labelled_pages(60, seed=99):
        found, marks, text = [], [], ""
        for fragment, label in page:
            text += fragment
            found = html_text.blocks(text)
            marks += [label] * (len(found) - len(marks))
            del marks[len(found) :]
        guess = page_model.viterbi(html_text.features(found))
        right, total = right + int((guess == np.array(marks)).sum()), total + len(marks)
    assert right / total > 0.97


def test_texts_are_cut_in_words_by_pieces(monkeypatch):
    """The words and ends of every text, in its order, whatever the piece it is cut in and whatever white space it has."""
    import pyarrow as pa

    rng = random.Random(4)
    letters = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 AÄßabcÉZz€\0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(600)]
    for own in (texts, [None, "", " ", *texts]):
        for piece in (1, 9000, 1 << 22):
            monkeypatch.setattr(lm_score, "PIECE", piece)
            got = []
            for first, distinct, codes, sizes in lm_score._coded(pa.array(own)):
                assert first == len(got)
                names, ends = distinct.to_pylist(), np.cumsum(sizes)
                got += [[names[c] for c in codes[end - n : end]] for end, n in zip(ends, sizes, strict=True)]
            assert got == [[*words(t), lm_score.END] for t in own]
