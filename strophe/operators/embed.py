"""User code over batches of records: tokenisers and embedding models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructType

#: Bytes of the rows that user code has before it at once, besides the Arrow batch that they lie in.
PART_BYTES = 1 << 20


def parts_of(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``rows`` rows and PART_BYTES, or of one row, in order and without a copy: the Python values
    of a piece take many times its bytes, so those of a whole batch would grow with the texts."""
    for i in range(0, batch.num_rows, rows):
        waiting = [batch.slice(i, rows)]
        while waiting:
            part = waiting.pop()
            if part.num_rows > 1 and part.nbytes > PART_BYTES:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def _with(part: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, *columns.values()], schema=pa.schema([*part.schema, *(pa.field(k, v.type) for k, v in columns.items())]))


def tokenise(df: DataFrame, callback: Callable[[dict], list[str]], strict: bool = False) -> DataFrame:
    """df with seq and error: a record on which the callback fails has a null seq and the error's text; strict: it fails the job.
    The callback gets a row as a dict of Python values, None for null."""
    schema = StructType([*df.schema.fields]).add("seq", ArrayType(StringType())).add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts_of(batch, 256)):
            seqs, errors = [], []
            for row in part.to_pylist():
                try:
                    seqs.append(callback(row))
                    errors.append(None)
                except Exception as e:
                    if strict:
                        raise
                    seqs.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield _with(part, seq=pa.array(seqs, pa.list_(pa.string())), error=pa.array(errors, pa.string()))

    return df.mapInArrow(run, schema)


def embed(df: DataFrame, load: Callable[[], Callable[[list[list[str]]], list[list[float]]]], batch_size: int = 64, column: str = "seq") -> DataFrame:
    """df with emb: one vector for each sequence. ``load`` makes the model once for each worker's partition stream; the model
    gets at most batch_size sequences at a time."""
    schema = StructType([*df.schema.fields]).add("emb", ArrayType(FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for part in (p for batch in batches for p in parts_of(batch, batch_size)):
            seqs = [s if s is not None else [] for s in part.column(column).to_pylist()]
            yield _with(part, emb=pa.array([[float(x) for x in v] for v in model(seqs)], pa.list_(pa.float32())))

    return df.mapInArrow(run, schema)


def hashed_bag(seq: Column, size: int = 16) -> Column:
    """Example model in SQL: counts of tokens by md5 bucket, divided by the number of tokens."""
    buckets = F.transform(seq, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int"))
    # bound by an outer transform, so that the buckets are computed once
    return F.transform(F.array(buckets), lambda x: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(x, lambda b: b == i)) / F.greatest(F.size(x), F.lit(1))))[0]
