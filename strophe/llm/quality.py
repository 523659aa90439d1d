"""Quality rules with line sequence labelling.

A linear-chain conditional random field labels each line of a text content or boilerplate (Viterbi). A document is kept if it
passes the base rules and at least a share of its words' characters stand in content lines. Field and share are learnt from a
bounded sample of labelled documents (``sample`` of each label, of at most ``sample_chars`` characters). The labels are the
documents', not the lines', so the lines' are inferred: a model of single lines is trained on the documents' labels, which the
kinds of lines that stand in good documents too pull to content; then, ROUNDS times, lines take the label that the last model
gives them, as far as the document's label allows (content has most lines of a good document, and a bad one has one line
of boilerplate at least), and the field is trained on them. The share is the one that tells the sample's documents apart
best, both labels counting alike; among equal ones the lowest.

Base: words are ``[^\\x20\\x09-\\x0D]+``; base_failed if under 20 words, or if over 30 % of the words stand in 8-word windows
that occur twice or more.

Defined results: null, empty or blank text -> zero counts, base_failed, not kept; a null doc_id stays null; repeated rows are
judged alike; no labelled document, or one label only -> the base rules alone decide; an empty table gives no rows; only doc_id, text and the labels' doc_id and quality are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm import crf

#: Fixed values of the base rules.
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
ROUNDS = 2
LEGAL = re.compile(r"licen[sc]ed? |all rights|copyright|cookie|subscribe|click here|log ?in|terms of|privacy", re.I)
UPPER, DIGIT = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile(r"\d")
CONTENT, BOILERPLATE = 0, 1  # ties go to the lower label
KINDS, BUCKETS = 13, 16
JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def repeated_words(words: list[bytes]) -> int:
    """Words in WINDOW-word windows that occur twice or more: exact ranks of windows by doubling."""
    if len(words) < WINDOW + 1:
        return 0
    seen: dict[bytes, int] = {}
    r = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    step = 1
    while step < WINDOW:
        key = r[:-step] * (int(r.max()) + 1) + r[step:]
        names, r = np.unique(key, return_inverse=True)
        if len(names) == len(key):
            return 0
        step *= 2
    twice = np.bincount(r)[r] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _tenth(part: int, whole: int) -> int:
    return min(10, (10 * part + whole - 1) // whole) if whole else 11


def line_features(lines: list[str]) -> np.ndarray:
    """(lines, KINDS) feature numbers; a number is kind * BUCKETS + bucket + 1."""
    seen: set[str] = set()
    out = np.empty((len(lines), KINDS), np.int64)
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        letters = sum(map(len, words))
        out[i] = (
            _tenth(sum(map(line.count, "#*$%&<>{}=~^\\")), letters),
            _tenth(len(UPPER.findall(line)), letters),
            _tenth(len(DIGIT.findall(line)), letters),
            min(15, letters // n) if n else 0,
            min(15, n.bit_length()),
            _tenth(len(set(words)), n),
            (".?!:;,|".find(line.rstrip()[-1:]) + 1) if n else 9,
            int(line.lstrip()[:1].isupper()),
            _tenth(line.count("!!"), n),
            _tenth(line.count("|"), n),
            int(line in seen) if n else 2,
            int(i == 0) + 2 * int(i == len(lines) - 1),
            int(bool(LEGAL.search(line))),
        )
        seen.add(line)
    return out + np.arange(KINDS) * BUCKETS + 1


@dataclass
class Model:
    field: crf.Crf
    share: float


def learn(docs: DataFrame, labels: DataFrame, sample: int = 500, sample_chars: int = 20_000) -> Model:
    one = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = reduce(DataFrame.unionByName, (one.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)))  # at most 2 * sample rows
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= sample_chars).join(F.broadcast(chosen), "doc_id")
    rows = own.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(2 * sample).collect()
    return fit([row["text"] for row in rows], [row["quality"] for row in rows])


def fit(texts: list[str], labels: list[int]) -> Model:
    """The field and the share, from texts and their labels (1 good, 0 bad)."""
    features = [line_features(t.split("\n")) for t in texts]
    if len(set(labels)) < 2:
        return Model(crf.train([], KINDS * BUCKETS + 1), 0.0)
    size = KINDS * BUCKETS + 1
    whole = [np.full(len(f), CONTENT if y else BOILERPLATE) for f, y in zip(features, labels, strict=True)]
    field = crf.train([(f[i : i + 1], m[i : i + 1]) for f, m in zip(features, whole, strict=True) for i in range(len(f))], size, epochs=4, batch=64)
    for _ in range(ROUNDS):
        marks = [lines_of(field, f, y) for f, y in zip(features, labels, strict=True)]
        field = crf.train(list(zip(features, marks, strict=True)), size, epochs=12, batch=16)
    shares = np.array([content_share(t.split("\n"), field) for t in texts])
    good = np.array(labels) == 1
    steps = np.unique(np.concatenate(([0.0], shares.round(3), [1.0])))
    balanced = [(shares[good] >= s).mean() + (shares[~good] < s).mean() for s in steps]
    return Model(field, float(steps[int(np.argmax(np.round(balanced, 9)))]))


def lines_of(field: crf.Crf, features: np.ndarray, label: int) -> np.ndarray:
    """Labels of a document's lines, by the field as far as the document's label allows."""
    marks = field.viterbi(features)
    lean = field.scores(features)
    lean = lean[:, BOILERPLATE] - lean[:, CONTENT]
    if label and 2 * (marks == BOILERPLATE).sum() > len(marks):
        marks = np.full(len(marks), CONTENT)
    elif not label and not (marks == BOILERPLATE).any():
        marks[int(lean.argmax())] = BOILERPLATE
    return marks


def word_chars(line: str) -> int:
    return len(line) - sum(map(line.count, BLANKS))


def content_share(lines: list[str], field: crf.Crf) -> float:
    """The share of the words' characters that stand in content lines; 0 without a word."""
    chars = np.array([word_chars(x) for x in lines])
    return float((field.viterbi(line_features(lines)) == CONTENT) @ chars / chars.sum()) if chars.any() else 0.0


def judge(text: str | None, model: Model) -> tuple:
    text = text or ""
    words, lines = text.encode().split(), text.split("\n")
    n, repeats = len(words), repeated_words(words)
    seen: set[str] = set()
    dup, total = 0, 0
    for line in lines:
        if chars := word_chars(line):
            total += chars
            dup += line in seen
            seen.add(line)
    failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
    content = content_share(lines, model.field)
    return n, total, sum(map(text.count, SYMBOLS)), dup, repeats, failed, not failed and content >= model.share, content


def apply(docs: DataFrame, model: Model) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(),) * 5 + (pa.bool_(), pa.bool_(), pa.float64())
        for batch in batches:
            rows = [judge(t.as_py(), sent.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True))], names=[f.split()[0] for f in JUDGED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, JUDGED)
