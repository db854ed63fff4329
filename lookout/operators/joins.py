"""Joins of a large frame with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def lookup(large: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys``, of which ``small`` holds each at most once.

    A key with a third of all rows must not end in one task. Adaptive execution splits
    such a key, but only if both inputs of the join come straight from a shuffle, and
    ``small`` is mostly an aggregate that already lies in its partitions. The hash of
    the keys as one more join key makes Spark shuffle its few rows once more, after
    which the split applies. A ``small`` under the broadcast threshold is broadcast.
    """
    h = F.xxhash64(*keys)
    return (
        large.withColumn("_h", h)
        .join(small.withColumn("_h", h), [*keys, "_h"], how)
        .drop("_h")
    )
