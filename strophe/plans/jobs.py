"""The three jobs: corpus building, packed datasets and the linear probe, each a composition of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.functions.arrays import loss_tokens, tokens_of
from strophe.operators import corpus, metrics, packing, probe, quality
from strophe.operators.prefix import numbered_sum
from strophe.sources import shards
from strophe.sources.work import written


def build_note_corpus(notes: DataFrame, config: dict[str, dict], dropped: list[str], seed, ratio: float) -> DataFrame:
    """Quality tests -> instrument filter -> hash -> dedup -> split: (piece_id, hash, split)."""
    kept = quality.quality_suite(notes, config).where("kept").select("piece_id")
    clean = corpus.remove_instruments(notes.join(kept, "piece_id", "left_semi"), dropped)
    pieces, _ = corpus.dedup_keep_first(corpus.note_content_hash(clean), "hash", ["piece_id"])
    return corpus.ratio_split(pieces, "piece_id", ratio, seed)


def build_packed_dataset(docs: DataFrame, max_seq_len: int, shard_tokens: int, seed, ratio: float = 0.95) -> DataFrame:
    """documents(doc_id, text) -> dedup -> split -> pack -> shard: (split, seq_id, shard_id, seq, loss_tokens)."""
    hashed = docs.select("doc_id", "text", corpus.content_hash(F.col("text")).alias("hash"))
    unique, _ = corpus.dedup_keep_first(hashed, "hash", ["doc_id"])
    rows = corpus.ratio_split(unique, "doc_id", ratio, seed).select("split", F.col("doc_id").alias("id"), tokens_of(F.col("text")).alias("seq"))
    # written, as the packing reads its rows twice, and each reading would repeat the dedup
    packed = packing.pack_concatenated(written(rows, "unique"), max_seq_len, seed, by=("split",))
    return shards.assign_shards(packed, max_seq_len, shard_tokens).select("split", "seq_id", "shard_id", "seq", loss_tokens(F.col("seq")).alias("loss_tokens"))


def write_packed_files(files: DataFrame, folder: str, max_seq_len: int, shard_tokens: int, separate: bool = True, vectors: DataFrame | None = None, seed=0) -> None:
    """files(id, seq) -> folder/shards and folder/manifest. Separate: each file alone in padded windows, in the order of the ids
    (whole numbers), with the vector of its file where vectors(id, emb) are given; else one run of tokens in the seeded order. A file
    without a vector fails the job, vectors in one run are refused, and so is an existing folder. Separate files are read twice, for
    their lengths and for their tokens, which are shuffled once."""
    if vectors is not None and not separate:
        raise ValueError("vectors of files need separate sequences")
    size = 0
    if separate:
        own = files.where(F.size("seq") > 0).select("id", "seq", F.ceil(F.size("seq") / max_seq_len).alias("windows"))
        # places are found without the tokens, a row for each id
        lengths = written(own.groupBy("id").agg(F.sum("windows").alias("windows")), "lengths")
        places = written(numbered_sum(lengths, ["id"], F.col("windows"), "before"), "places")
        marks = places
        if vectors is not None:
            size = vectors.agg(F.max(F.size("emb"))).first()[0] or 0
            marks = corpus.attach_embeddings(places, vectors.select("id", "emb").hint("shuffle_hash"), "id")
        rows = packing.pack_by_range(own, places, marks, max_seq_len, shard_tokens // max_seq_len)
    else:
        rows = packing.pack_concatenated(written(files, "files"), max_seq_len, seed)
    shards.write_shards(shards.assign_shards(rows, max_seq_len, shard_tokens), f"{folder}/shards", dealt=separate)
    header = {"separate_sequences": separate, "embedding_size": size}
    shards.write_manifest_parts(shards.read_shards(files.sparkSession, f"{folder}/shards"), f"{folder}/manifest", header, max_seq_len, shard_tokens)


def probe_report(vectors: DataFrame, held_out) -> DataFrame:
    """vectors(emb, label) -> a report of the probe that is fitted on the rest, over the held-out rows."""
    model = probe.fit_probe(vectors.where(~held_out))
    pairs = probe.score_probe(model, vectors.where(held_out)).select(F.col("label").alias("true_id"), "pred_id")
    return metrics.classification_report(pairs, vectors.select(F.col("label").alias("tag_id")).distinct())
