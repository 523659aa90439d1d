"""Column functions on token arrays: windows, padding, removal, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The special tokens.
PAD, BOS, EOS, DIM, UNK = "<P>", "<S>", "<E>", "<D>", "<U>"


def tokens_of(text: Column) -> Column:
    """Tokens between white space (blank, \\t, \\n, \\v, \\f, \\r); none in an empty or blank text, null for null."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda x: x != "")


def cut(seq: Column, n) -> Column:
    return F.slice(seq, 1, n)


def pad_to(seq: Column, n: int, pad: str = PAD) -> Column:
    return F.concat(seq, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(n) - F.size(seq)).cast("int")))


def pad_last_cell(seq: Column, n: int) -> Column:
    """Rule A: cut and pad to n; without an end token, it overwrites the last cell."""
    fixed = pad_to(cut(seq, n), n)
    return F.when(F.array_contains(fixed, EOS), fixed).otherwise(F.concat(F.slice(fixed, 1, n - 1), F.array(F.lit(EOS))))


def pad_augmented(seq: Column, n: int) -> Column:
    """Rule B: drop pads and the first DIM, then rule A."""
    return pad_last_cell(remove_first(F.filter(seq, lambda x: x != PAD), DIM), n)


def pad_last_token(seq: Column, n: int) -> Column:
    """Rule C: cut to n; without an end token, it overwrites the last real token; then pad. Null for an empty sequence."""
    short = cut(seq, n)
    ended = F.when(F.array_contains(short, EOS), short).otherwise(F.concat(F.slice(short, F.lit(1), F.size(short) - 1), F.array(F.lit(EOS))))
    return F.when(F.size(seq) > 0, pad_to(ended, n))


def remove_first(seq: Column, token: str) -> Column:
    at = F.array_position(seq, token).cast("int")
    return F.when(at > 0, F.concat(F.slice(seq, F.lit(1), at - 1), F.slice(seq, at + 1, F.size(seq)))).otherwise(seq)


def shift_left(seq: Column, pad: str = PAD) -> Column:
    """Next-token targets."""
    return F.concat(F.slice(seq, F.lit(2), F.size(seq)), F.array(F.lit(pad)))


def loss_mask(targets: Column, pad: str = PAD) -> Column:
    return F.transform(targets, lambda x: x != pad)


def loss_tokens(seq: Column, pad: str = PAD) -> Column:
    return F.greatest(F.lit(0), F.size(F.filter(seq, lambda x: x != pad)) - 1)


def truncate_at(seq: Column, token: str = EOS) -> Column:
    """Up to the first token of that kind, inclusive; whole without one."""
    at = F.array_position(seq, token).cast("int")
    return F.when(at > 0, F.slice(seq, F.lit(1), at)).otherwise(seq)


def fixed_chunks(seq: Column, n: int) -> Column:
    """Slices of n, the last one short; none for an empty array."""

    def of(seq: Column) -> Column:
        starts = F.when(F.size(seq) > 0, F.sequence(F.lit(1), F.size(seq), F.lit(n))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.slice(seq, s, n))

    # bound by an outer transform: where an explode's filter is pushed down, the array's own expression would be computed for each slice
    return F.transform(F.array(seq), of)[0]


def padded_windows(seq: Column, n: int, pad: str = PAD) -> Column:
    return F.transform(fixed_chunks(seq, n), lambda w: pad_to(w, n, pad))


def overlapping_segments(seq: Column, n: int) -> Column:
    """Slices of n; if a rest is left over and the array is longer than n, the last slice is the last n elements."""
    size = F.size(seq)
    starts = F.when(size > n, F.array_union(F.sequence(F.lit(1), size - n + 1, F.lit(n)), F.array((size - n + 1).cast("int")))).otherwise(F.array(F.lit(1)))
    return F.transform(starts, lambda s: F.slice(seq, s, n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
