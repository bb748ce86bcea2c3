"""Reproducible pseudo-random keys from row ids: the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHUFFLE_SEED = 1
SPLIT_SEED = 42
FOLD_SEED = 7


def hash_key(seed: int, id_col: str = "doc_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hash01(seed: int, id_col: str = "doc_id") -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the key."""
    bits = F.conv(F.substring(hash_key(seed, id_col), 1, 8), 16, 10).cast("double")
    return bits / F.lit(4294967296.0)
