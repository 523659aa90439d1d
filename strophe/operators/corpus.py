"""Hashing, deduplication, combination, splits, tags and metadata of pieces."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from strophe.contracts import DROPPED_INSTRUMENTS, MANUAL_METADATA, TEXT_META, tag_table
from strophe.functions.hashing import hash_int
from strophe.operators.prefix import seeded_rank
from strophe.sources.work import written


def content_hash(text: Column) -> Column:
    """md5 of the text with outer spaces cut and inner white space made single spaces; metadata does not count."""
    return F.md5(F.trim(F.regexp_replace(text, r"\s+", " ")))


def note_content_hash(notes: DataFrame) -> DataFrame:
    """(piece_id, hash): md5 of the piece's notes in order of (onset, pitch, dur, velocity, instrument); a collected piece is
    bounded by the longest piece."""
    line = F.concat_ws(",", F.lpad(F.col("onset").cast("string"), 10, "0"), F.lpad(F.col("pitch").cast("string"), 3, "0"), "dur", "velocity", "instrument")
    return notes.groupBy("piece_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(line)), ";")).alias("hash"))


def dedup_keep_first(df: DataFrame, hash_col: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, audit(hash, kept, duplicate)): of each hash the row of the least order stays; the audit has a row for each
    other one, so that a very common content is no single row. Rows that agree in the order too count as one."""
    rows = df.withColumn("__k", F.struct(*order))
    least = rows.groupBy(hash_col).agg(F.min("__k").alias("__k"))
    # by hash and order: the copies of a common content are dealt out, not met in one task, and only their keys go to the audit
    kept = rows.join(least.hint("merge"), [hash_col, "__k"]).dropDuplicates([hash_col, "__k"])
    audit = rows.select(hash_col, F.col("__k").alias("duplicate")).join(least.withColumnRenamed("__k", "kept").hint("merge"), hash_col)
    return kept.select(*df.columns), audit.where("duplicate > kept").select(hash_col, "kept", "duplicate")


def combine_datasets(*sources: DataFrame, hash_col: str = "hash", key: str = "id") -> DataFrame:
    """Ordered union; of equal content the first source's row stays (least key within it)."""
    out = None
    for i, df in enumerate(sources):
        own = df.withColumn("source_ordinal", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return dedup_keep_first(out, hash_col, ["source_ordinal", key])[0]


def ratio_split(df: DataFrame, key: str, ratio: float, seed) -> DataFrame:
    """split: 'train' where the row's uniform number is at most the ratio, else 'val'."""
    if not 0 <= ratio <= 1:
        raise ValueError("the ratio must be from 0 to 1")
    limit = int(ratio * 4294967296)
    return df.withColumn("split", F.when(hash_int(seed, F.col(key)) <= limit, "train").otherwise("val"))


def remove_instruments(notes: DataFrame, dropped: list[str] = DROPPED_INSTRUMENTS) -> DataFrame:
    return notes.where(~F.col("instrument").isin(dropped))


def drop_text_meta(messages: DataFrame, kind: str = "type", is_meta: str = "is_meta", types: list[str] = TEXT_META) -> DataFrame:
    return messages.where(~(F.col(is_meta) & F.col(kind).isin(types)))


def prompt_prefix(pieces: DataFrame, notes: DataFrame, pedals: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Notes with onset <= limit and pedals with tick <= limit, without a last pedal event that is an 'on'. A piece without such
    notes gets two notes: pitches 60 and 64, onset 0, duration 1, velocity 60."""
    near = notes.where(F.col("onset") <= limit).select("piece_id", "onset", "dur", "pitch", "velocity")
    default = F.explode(F.array(*(F.struct(F.lit(0).cast("long").alias("onset"), F.lit(1).cast("long").alias("dur"), F.lit(p).alias("pitch"), F.lit(60).alias("velocity")) for p in (60, 64)))).alias("n")
    rest = pieces.select("piece_id").join(near, "piece_id", "left_anti").select("piece_id", default).select("piece_id", "n.*")
    own = pedals.where(F.col("tick") <= limit)
    last = own.groupBy("piece_id").agg(F.max(F.struct("tick", "pedal_id", "value")).alias("last"))
    kept = own.join(last, "piece_id").where(~((F.col("pedal_id") == F.col("last.pedal_id")) & (F.col("value") == 1))).drop("last")
    return near.unionByName(rest), kept


def eligible_for_embedding(notes: DataFrame, pieces: DataFrame, instrument: str = "piano") -> DataFrame:
    """pieces with eligible: there are notes, and their instruments are exactly that one."""
    own = notes.groupBy("piece_id").agg(F.min("instrument").alias("lo"), F.max("instrument").alias("hi"))
    return pieces.join(own, "piece_id", "left").withColumn("eligible", F.coalesce((F.col("lo") == instrument) & (F.col("hi") == instrument), F.lit(False))).drop("lo", "hi")


def validate_manual_metadata(entries: DataFrame, allowed: dict[str, list[str]] = MANUAL_METADATA) -> DataFrame:
    """entries(key, value) that are not allowed."""
    dim = entries.sparkSession.createDataFrame([(k, v) for k, vs in allowed.items() for v in vs], "key string, value string")
    return entries.join(F.broadcast(dim), ["key", "value"], "left_anti")


def map_tags_strict(rows: DataFrame, category: str, tag: str = "tag") -> tuple[DataFrame, DataFrame]:
    """(rows with tag_id, audit of rows whose tag is missing or unknown); a strict caller aborts if the audit has rows."""
    dim = tag_table(rows.sparkSession).where(F.col("category") == category).select(F.col("tag").alias(tag), "tag_id")
    return rows.join(F.broadcast(dim), tag), rows.join(F.broadcast(dim), tag, "left_anti")


def map_tags_other(rows: DataFrame, tags: list[str], tag: str = "tag") -> DataFrame:
    """Missing or unknown tags become 'other', which must be among the tags."""
    if "other" not in tags:
        raise ValueError("the category has no tag 'other'")
    dim = rows.sparkSession.createDataFrame([(t, i) for i, t in enumerate(tags)], f"{tag} string, tag_id int")
    joined = rows.join(F.broadcast(dim), tag, "left")
    return joined.withColumn(tag, F.when(F.col("tag_id").isNull(), "other").otherwise(F.col(tag))).withColumn("tag_id", F.coalesce("tag_id", F.lit(tags.index("other"))))


def match_names(text: Column, names: list[str]) -> Column:
    """The one name that the text holds (case ignored); null if none or several do."""
    found = F.filter(F.array(*(F.lit(n) for n in names)), lambda n: F.contains(F.lower(text), n))
    return F.when(F.size(found) == 1, found[0])


def fill_manual(metadata: Column, manual: dict[str, str]) -> Column:
    """Manual values where the key is absent or null."""
    return F.map_concat(F.map_filter(F.create_map(*(F.lit(x) for kv in manual.items() for x in kv)), lambda k, v: F.try_element_at(metadata, k).isNull()), F.map_filter(metadata, lambda k, v: v.isNotNull()))


def overwrite_metadata(metadata: Column, results: Column) -> Column:
    """Results of metadata functions overwrite; null or empty ones are ignored."""
    good = F.map_filter(results, lambda k, v: v.isNotNull() & (v != ""))
    return F.map_concat(F.map_filter(metadata, lambda k, v: ~F.map_contains_key(good, k)), good)


def lookup_metadata(pieces: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """pieces(key, metadata) joined with an external catalogue(key, found map); found keys overwrite."""
    return pieces.join(catalogue, key, "left").withColumn("metadata", F.when(F.col("found").isNull(), F.col("metadata")).otherwise(overwrite_metadata(F.col("metadata"), F.col("found")))).drop("found")


def attach_embeddings(seqs: DataFrame, table: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """seqs with the vector of their key. Strict: a missing key, or vectors of several sizes, is an error."""
    joined = seqs.join(table, key, "left")
    if not strict:
        return joined
    checked = F.when(F.col("emb").isNull(), F.raise_error(F.concat(F.lit("no embedding for "), F.col(key).cast("string")))).otherwise(F.col("emb"))
    if table.agg(F.countDistinct(F.size("emb")).alias("n")).first()["n"] > 1:
        raise ValueError("embeddings differ in size")
    return joined.withColumn("emb", checked)


#: Items of a block of rows that are translated together.
BLOCK = 1 << 20
#: Most characters of a token that is sent to the tasks: with 10,000 tokens, 10 MB at most.
COMMON_CHARS = 256


def build_vocabulary(rows: DataFrame, seed="v") -> DataFrame:
    """rows(seq) -> (token, n, token_id): the occurrences of each distinct token, and ids from 1 in the order of md5(seed:token).
    The table is written in the shared folder and read back, as every use of it would count all tokens again."""
    counted = rows.select(F.explode("seq").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    numbered = seeded_rank(written(counted, "tokens"), seed, "token").select("token", "n", (F.col("rank") + 1).alias("token_id"))
    return written(numbered, "vocabulary")


def common_tokens(vocabulary: DataFrame, most: int = 10_000) -> DataFrame:
    """The tokens of the largest n, ``most`` at most and none of over COMMON_CHARS characters: a table of bounded size, to broadcast."""
    return vocabulary.where(F.length("token") <= COMMON_CHARS).orderBy(F.desc("n"), "token_id").limit(most).select("token", "token_id")


def _translated(rows: DataFrame, key: str, seq: str, table: DataFrame, by: str, what: str, out: str, unknown: int | None = None) -> DataFrame:
    """rows(key, seq) -> (key, out): each item replaced by ``what`` of its row in table(by, what), or by ``unknown``; dropped if that is None.

    Neighbouring rows form blocks of BLOCK items, each with a dictionary of its own; only the dictionaries' items are joined with the
    table, and come back to their block's rows. A block is bounded, but for one longer row. It is written with codes for items."""
    items, names = rows.schema[seq].dataType, ["__block", key, "codes", "items"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False) + 1  # empty rows count too
            part = (np.cumsum(sizes) - sizes) // BLOCK
            for first, end in pairwise([*np.flatnonzero(np.diff(part, prepend=-1)), len(part)] if len(part) else []):
                lists = batch.column(1).slice(first, end - first)
                flat = lists.flatten().dictionary_encode()
                codes = pa.ListArray.from_arrays(_offsets(lists), flat.indices)
                n, held = end - first, flat.dictionary
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), batch.column(0).slice(first, n), codes, pa.nulls(n, pa.list_(held.type))], names=names)
                held = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, batch.column(0).type), pa.nulls(1, codes.type), held], names=names)
                block += 1

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        lists, flat = left["codes"].combine_chunks(), left["codes"].combine_chunks().flatten()
        at = np.full(1 + max(pc.max(flat).as_py() or 0, pc.max(right["code"]).as_py() or 0), -1, np.int64)
        at[right["code"].to_numpy()] = np.arange(len(right))
        place = at[flat.fill_null(0).to_numpy()]
        good = (place >= 0) & flat.is_valid().to_numpy(zero_copy_only=False)
        offsets = _offsets(lists).to_numpy()
        if unknown is None:
            offsets, place, good = np.concatenate(([0], np.cumsum(good)))[offsets], place[good], good[good]
        values = right[what].combine_chunks().take(pa.array(place, mask=~good))
        values = values if unknown is None else values.fill_null(unknown)
        return pa.Table.from_arrays([left[key], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=[key, out])

    schema = StructType([StructField("__block", LongType()), rows.schema[key], StructField("codes", ArrayType(IntegerType())), StructField("items", items)])
    blocks = written(rows.select(key, seq).mapInArrow(cut, schema), "blocks")
    words = blocks.where("items is not null").select("__block", F.posexplode("items").alias("code", by))
    found = words.join(table.select(by, what).hint("merge"), by).select(F.col("__block").alias("__of"), "code", what)
    left = blocks.where("items is null").select("__block", key, "codes")
    schema = StructType([rows.schema[key], StructField(out, ArrayType(table.schema[what].dataType))])
    return left.groupBy("__block").cogroup(found.groupBy("__of")).applyInArrow(put, schema)


def _offsets(lists: pa.ListArray) -> pa.Array:
    """Offsets of the lists in their flat items; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())


def encode_tokens(rows: DataFrame, vocabulary: DataFrame, key: str = "id", unknown: int = 0) -> DataFrame:
    """rows(key, seq) -> (key, ids) by vocabulary(token, token_id). A token that it lacks, a null one included, becomes
    ``unknown``; a null or empty sequence has no ids. The key must be unique."""
    return _translated(rows, key, "seq", vocabulary, "token", "token_id", "ids", unknown)


def decode_tokens(rows: DataFrame, vocabulary: DataFrame, key: str = "id") -> DataFrame:
    """rows(key, ids) -> (key, seq); ids without a token are dropped. The key must be unique."""
    return _translated(rows, key, "ids", vocabulary, "token_id", "token", "seq")
