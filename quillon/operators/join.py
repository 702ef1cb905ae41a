"""Inner equi-join on expressions of either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("auto", "shuffle_hash", "merge")


def hash_join(left: DataFrame, right: DataFrame, left_key: str | Column, right_key: str | Column, strategy: str = "auto") -> DataFrame:
    """Columns of ``left``, then of ``right``; every pair of rows with equal keys. Null keys never match.

    "auto" leaves the choice to Spark, which broadcasts a side only below its size threshold and
    splits skewed partitions; the others are hints. There is no forced broadcast. For a self-join, alias
    the sides and give their qualified columns.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    lk = left[left_key] if isinstance(left_key, str) else left_key
    rk = right[right_key] if isinstance(right_key, str) else right_key
    build = left if strategy == "auto" else left.hint(strategy)
    return build.join(right, lk == rk, "inner")


def joined_on(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, name: str = "_key") -> DataFrame:
    """As ``hash_join`` for computed keys over sides that share column names: the key is a column of its own."""
    a, b = left.withColumn(name, left_key).alias("l"), right.withColumn(name, right_key).alias("r")
    out = a.join(b, F.col(f"l.{name}") == F.col(f"r.{name}"), "inner")
    return out.select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in right.columns])
