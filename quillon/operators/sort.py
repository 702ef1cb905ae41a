"""Sorting by an expression; spilling and merging are Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_by(df: DataFrame, key: str | Column, *ties: str | Column, descending: bool = False) -> DataFrame:
    """Global order by ``key``; ``ties`` stay ascending in either direction, which is what a stable sort by them would give."""
    k = F.col(key) if isinstance(key, str) else key
    return df.orderBy(k.desc() if descending else k.asc(), *[F.col(t) if isinstance(t, str) else t for t in ties])


def external_sort(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted within: partition by partition the rows are in order. For writing sorted files."""
    dealt = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    return dealt.sortWithinPartitions(key)


def unsigned(column: str | Column) -> Column:
    """Sort key that orders a signed 64-bit column as unsigned."""
    c = F.col(column) if isinstance(column, str) else column
    return c.bitwiseXOR(F.lit(-(2**63)))
