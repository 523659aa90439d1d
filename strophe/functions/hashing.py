"""Random choice as a pure function of md5(seed:key): it survives retries, and SQL can repeat it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed, key: Column) -> Column:
    """The 32 hex digits by which seeded orders sort."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_int(seed, key: Column) -> Column:
    """A long in [0, 2**32)."""
    return F.conv(F.substring(hash_key(seed, key), 1, 8), 16, 10).cast("long")


def hash_uniform(seed, key: Column) -> Column:
    """A double in [0, 1)."""
    return hash_int(seed, key) / F.lit(4294967296.0)
