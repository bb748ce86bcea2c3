"""Shuffle keys, samples, splits and folds from hashed ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.keys import FOLD_SEED, SHUFFLE_SEED, SPLIT_SEED, hash01, hash_key


def with_shuffle_key(df: DataFrame, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Seeded order of the rows as a column; sort by it only where the order is wanted."""
    return df.withColumn("shuffle_key", hash_key(seed))


def ratio_sample(df: DataFrame, ratio: float, seed: int = SHUFFLE_SEED) -> DataFrame:
    """About ``ratio`` of all rows, by threshold: no shuffle, same rows on every run."""
    return df.filter(hash01(seed) < ratio)


def split_column(train: float = 0.6, validate: float = 0.2, seed: int = SPLIT_SEED) -> Column:
    h = hash01(seed)
    return (
        F.when(h < train, "train").when(h < train + validate, "validate").otherwise("test")
    )


def split_by_threshold(df: DataFrame, **shares) -> DataFrame:
    return df.withColumn("split", split_column(**shares))


#: Hexadecimal digits of a hash key.
KEY_DIGITS = 32


def key_at_rank(df: DataFrame, rank: int, seed: int, digits: int = 3, max_rows: int = 4096) -> str:
    """The ``rank``-th smallest hash key (1-based) without a global sort.

    Radix refinement: counts rows per next ``digits`` of the key, goes into the prefix that holds the
    rank, and counts again until that prefix has at most ``max_rows`` rows or is a whole key, which
    rows of one id share. At most 16**digits counts and ``max_rows`` keys reach the driver whatever
    the number of rows; each level is one aggregation with partial sums.
    """
    keys = df.select(hash_key(seed).alias("k"))
    prefix, left = "", rank
    while len(prefix) < KEY_DIGITS:
        inside = keys.filter(F.col("k").startswith(prefix)) if prefix else keys
        longer = F.substring("k", 1, len(prefix) + digits).alias("p")
        rows = 0
        for row in inside.groupBy(longer).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
            prefix, rows = row["p"], row["n"]
            if rows >= left:
                break
            left -= rows
        if rows <= max_rows and len(prefix) < KEY_DIGITS:
            found = keys.filter(F.col("k").startswith(prefix)).orderBy("k").limit(left).collect()
            return found[left - 1]["k"]
    return prefix


def half_even(x: float) -> int:
    return round(x)


def split_exact(
    df: DataFrame, train: float = 0.6, validate: float = 0.2, seed: int = SPLIT_SEED
) -> DataFrame:
    """Exactly round(train * n) and round(validate * n) rows, rounding half to even; rest test.

    ``doc_id`` must be unique. The rows themselves are never shuffled: two cut keys are found
    from counts, and each row compares its own key with them.
    """
    n = df.count()
    n_train, n_validate = half_even(n * train), half_even(n * validate)
    column = F.lit("test")
    for name, upto in (("validate", n_train + n_validate), ("train", n_train)):
        if upto > 0:
            cut = key_at_rank(df, min(upto, n), seed)
            column = F.when(hash_key(seed) <= cut, name).otherwise(column)
    return df.withColumn("split", column)


def holdout_split(
    df: DataFrame, ratio_train: float = -1, ratio_test: float = 0.2, seed: int = SPLIT_SEED
) -> DataFrame:
    """Test rows first; train is all the rest, or a sample of it (other rows get null)."""
    h = hash01(seed)
    use_rest = ratio_train < 0 or ratio_train + ratio_test > 1
    split = F.when(h < ratio_test, "test")
    if use_rest:
        split = split.otherwise("train")
    else:
        split = split.when(h < ratio_test + ratio_train, "train")
    return df.withColumn("split", split)


def fold_column(k: int, seed: int = FOLD_SEED) -> Column:
    return F.floor(hash01(seed) * k).cast("int")


def assign_folds(df: DataFrame, k: int = 0, seed: int = FOLD_SEED) -> DataFrame:
    """``fold`` in 0..k-1; with k = 0 fold 0 is the first 20 % and the other rows are fold 1."""
    if k > 0:
        return df.withColumn("fold", fold_column(k, seed))
    return df.withColumn("fold", F.when(hash01(seed) < 0.2, 0).otherwise(1))


def prefix_subset(df: DataFrame, fraction: float, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Nested subsets for learning curves: a smaller fraction is part of every larger one."""
    return ratio_sample(df, fraction, seed)
