"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of a bounded sample of labelled texts (``sample_docs`` documents
of the lowest hash, ``sample_chars`` characters of each); a text goes to the language whose dictionary
compresses it smallest. ``score`` = 1 - smallest size / second smallest; below ``margin`` the document is rejected.

Defined results: null text, or text without a letter -> lang_pred 'und', score 0, rejected; ties -> the first language in
alphabetical order, score 0, rejected; one language only -> score 0 and nothing but 'und' is rejected; no labelled text ->
all 'und'; equal rows are judged alike; other columns are passed through, but for lang_pred, score and rejected, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OTHERS = regex.compile(r"\P{L}+")
LEVEL = 3
MAX_LANGS = 1000


def letters(text: str) -> str:
    """The whole text's words in lower case: case, digits and signs say nothing of the language."""
    return OTHERS.sub(" ", text.lower()).strip()


def learn(train: DataFrame, sample_docs: int = 500, sample_chars: int = 1500) -> dict[str, bytes]:
    """lang -> dictionary content; at most sample_docs * sample_chars characters a language reach the driver.

    Distinct rows are counted by language first (repeated ones share a hash, and count once); then those below a hash that lets about twice the
    sample through, and the one of the least hash in any case, are ranked, so that no task sorts a language that holds most of the rows."""
    rows = train.where("lang is not null and text is not null").select("lang", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h"), F.substring("text", 1, sample_chars).alias("text"))
    counted = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.min("h").alias("least"))
    counts = {r["lang"]: (max(1, r["n"]), r["least"]) for r in counted.limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return {}
    limits = train.sparkSession.createDataFrame([(x, max(least, (2**63 - 1) * min(n, 2 * sample_docs) // n)) for x, (n, least) in counts.items()], "lang string, most long")
    near = rows.join(F.broadcast(limits), "lang").where("h <= most").groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = near.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("rn") <= sample_docs)
    texts: dict[str, list] = {}
    for r in ranked.select("lang", "h", "text").collect():
        texts.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return {lang: " ".join(letters(t) for _, t in sorted(x)).encode() for lang, x in sorted(texts.items())}


class Classifier:
    def __init__(self, contents: dict[str, bytes]):
        import zstandard

        self.langs = sorted(contents)
        self.compressors = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))

    def judge(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        raw = letters(text or "").encode()
        if not raw or not self.langs:
            return "und", 0.0, True
        sizes = sorted((len(c.compress(raw)), lang) for c, lang in zip(self.compressors, self.langs, strict=True))
        score = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 0.0
        return sizes[0][1], score, len(sizes) > 1 and score < margin


def identify(docs: DataFrame, contents: dict[str, bytes], margin: float = 0.003) -> DataFrame:
    """docs with lang_pred, score, rejected; one pass, no shuffle. contents: from learn(), sent with the tasks."""
    kept = docs.drop("lang_pred", "score", "rejected")
    contents = {lang: bytes(x) for lang, x in contents.items()}
    sent = docs.sparkSession.sparkContext.broadcast(contents)
    schema = kept.selectExpr("*", "cast('' as string) lang_pred", "cast(0 as double) score", "false rejected").schema
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(sent.value)
        for batch in batches:
            lang, score, rejected = zip(*(c.judge(t.as_py(), margin) for t in batch.column(at)), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, schema)
