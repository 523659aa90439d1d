"""The corpus pipeline: language ID, near-dedup, decontamination, PII, packing, each over all that the one before kept.

Every stage but the last returns the columns of documents. run() writes each stage's rows in the shared folder and reads
them back, so that a lost executor costs the tasks of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import best_fit, decontaminate, language, near_dedup, pii
from strophe.llm.common import materialise, table, work_dir
from strophe.llm.queries import KEY, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language classifier does not reject."""
    return language.identify(docs, language.learn(docs)).where("not rejected").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5 words, similarity 0.8): the one of the least doc_id, once."""
    return near_dedup.deduplicate(docs, k=5, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and n_chars counted anew."""
    return pii.pseudonymise(docs, KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan: a row for each piece."""
    return best_fit.pack(docs, tokenizer_path())


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("decontamination", decontaminate_benchmark), ("pii", pseudonymise), ("best_fit_packing", pack_sequences)]
#: No SQL: compression, MinHash and packing have none. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), work_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
