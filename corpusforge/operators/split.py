"""Seeded shuffle (W2) and exact-size train/validation split.

The shuffle order is md5(seed | key): deterministic for a seed and
independent of partitioning. ``n_val = int(n * val_fraction)`` rows with the
smallest hashes form the validation set, found by an exact hex order
statistic, so the sizes are exact (``randomSplit`` is only approximate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import kth_smallest_hex


def shuffle_key(key: Column, seed: int) -> Column:
    """Order key of the seeded shuffle; the key column must be unique."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), key.cast("string")))


def val_size(n: int, val_fraction: float) -> int:
    # double product truncated, as int(len(rows) * val_fraction)
    return int(n * val_fraction)


def exact_split(
    df: DataFrame, key_col: str, val_fraction: float = 0.05, seed: int = 42, n: int | None = None
) -> DataFrame:
    """Add ``shuffle_key`` and ``split`` ('train' / 'val') columns. A key
    repeated across the cut would change the split's size: it raises."""
    keyed = df.withColumn("shuffle_key", shuffle_key(F.col(key_col), seed))
    if n is None:
        n = keyed.count()
    n_val = val_size(n, val_fraction)
    if n_val <= 0:
        return keyed.withColumn("split", F.lit("train"))
    threshold = kth_smallest_hex(keyed, "shuffle_key", n_val - 1, unique=True)
    return keyed.withColumn(
        "split", F.when(F.col("shuffle_key") <= F.lit(threshold), "val").otherwise("train")
    )
