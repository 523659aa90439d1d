"""Token-ID output in directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id, level k the (k+1)-th chunk of
those ids that have one. A continuation bitmap beside each level's chunks says which ids go on, and a rank directory (set
bits before each 512-bit block) gives an id's place in the next level: any id is read with one lookup a level, without
decoding what stands before it.

A segment is a header, a document directory and the levels; a table row holds one segment in ``payload``. Rows are in
ascending doc_id order by (part, segment), and Spark's writer commits them, so a lost executor leaves no half-written file.

Defined results: null or empty text -> the end id alone; null doc_id sorts first; rows with equal doc_id are all kept,
ordered by text; an empty table gives no segment; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import shuffle_parts
from strophe.llm.tokenise import encoder

MAGIC = b"DAC1"
HEAD = struct.Struct("<4sBQQQ")  # magic, levels, documents, ids, ids of the part before this segment
BLOCK_BITS = 512
SEGMENT_IDS = 1 << 20
SEGMENTS = "part int, segment int, first_in_part long, n_ids long, payload binary"
DECODED = "part int, segment int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long"


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, continuation bitmap, rank directory) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-max(len(rest), 1) // BLOCK_BITS) * (BLOCK_BITS // 8), np.uint8)
        padded[: len(bits)] = bits
        counts = np.bitwise_count(padded.view("<u8")).reshape(-1, BLOCK_BITS // 64).sum(1)
        rank = np.concatenate(([0], np.cumsum(counts)[:-1])).astype("<u4")
        levels.append(((rest & 0xFF).astype(np.uint8), padded, rank))
        if not more.any():
            return levels
        rest = rest[more] >> 8


def pack_segment(doc_ids: list[int | None], docs: list[np.ndarray], before: int) -> bytes:
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    levels = encode_levels(ids)
    out = [HEAD.pack(MAGIC, len(levels), len(doc_ids), len(ids), before)]
    out.append(np.array([x is None for x in doc_ids], np.uint8).tobytes())
    out.append(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
    out.append(np.array([len(x) for x in docs], "<u8").tobytes())
    for chunks, bitmap, rank in levels:
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), rank.tobytes()]
    return b"".join(out)


class Segment:
    """Reads a packed segment; ``segment[i]`` is the i-th id, ``segment.decode()`` all of them."""

    def __init__(self, payload: bytes):
        magic, n_levels, n_docs, self.n, self.before = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at = HEAD.size

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(payload, dtype, n, at)
            at += x.nbytes
            return x

        nulls = take("u1", n_docs)
        self.doc_ids = [None if z else int(x) for z, x in zip(nulls, take("<i8", n_docs), strict=True)]
        self.lengths = take("<u8", n_docs).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-max(n, 1) // BLOCK_BITS)
            self.levels.append((take("u1", n), take("u1", blocks * BLOCK_BITS // 8), take("<u4", blocks)))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK_BITS
            own = int.from_bytes(bitmap[block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8].tobytes(), "little")
            i = int(rank[block]) + (own & ((1 << i % BLOCK_BITS) - 1)).bit_count()
        return value

    def decode(self) -> np.ndarray:
        above = np.empty(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            values = chunks.astype(np.uint32)
            values[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)] |= above << 8
            above = values
        return above


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Segments of all documents in ascending doc_id order: one range shuffle of the texts, then encoding by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        ids, arrays, size, before, segment = [], [], 0, 0, 0
        end = np.array([end_id], np.uint32)

        def flush():
            nonlocal ids, arrays, size, before, segment
            out = pa.RecordBatch.from_pylist([{"part": part, "segment": segment, "first_in_part": before, "n_ids": size, "payload": pack_segment(ids, arrays, before)}], schema=SCHEMA)
            ids, arrays, before, segment, size = [], [], before + size, segment + 1, 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                arrays.append(np.concatenate((np.frombuffer(enc.encode(text.as_py()), "<u4"), end)))
                size += len(arrays[-1])
                if size >= SEGMENT_IDS:
                    yield flush()
        if ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id")
    return ordered.sortWithinPartitions("doc_id", "text").mapInArrow(run, SEGMENTS)


SCHEMA = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first_in_part", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])


def decode_documents(segments: DataFrame) -> DataFrame:
    """Per document, from the segments alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = Segment(payload)
                ids, ends = s.decode().astype("<u4"), np.cumsum(s.lengths)
                view = memoryview(ids).cast("B")
                n = len(s.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(s.before + ends - s.lengths, pa.int64()), pa.array(s.lengths, pa.int64()),
                        pa.array([zlib.crc32(view[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), s.lengths.tolist(), strict=True)], pa.int64()),
                    ],
                    names=[f.split()[0] for f in DECODED.split(", ")],
                )

    # one row for each partition of the writer: bounded by its partition count, not by the documents
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = parts.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("part_start"))
    docs = segments.select("part", "segment", "payload").mapInArrow(run, DECODED)
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32", "part", "segment")
