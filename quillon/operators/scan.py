"""Scans, lookups and keyed sinks over any DataFrame or Parquet folder.

Filters are plain comparisons of a column with literals, so they reach the Parquet reader, which skips
row groups by their statistics; ``bulk_load`` writes by key to make those ranges narrow.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import DuplicateKey, KeyNotFound


def full_scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def range_scan(df: DataFrame, key: str, start: object, end: object) -> DataFrame:
    """Keys from ``start`` to ``end``, both included."""
    return df.where(F.col(key).between(start, end))


def ordered_range(df: DataFrame, key: str, start: object, end: object) -> DataFrame:
    return range_scan(df, key, start, end).orderBy(key)


def at_key(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == value)


def lookup(df: DataFrame, key: str, value: object) -> Row:
    """The row of a unique key."""
    found = at_key(df, key, value).take(1)
    if not found:
        raise KeyNotFound(value)
    return found[0]


def empty_scan(df: DataFrame) -> DataFrame:
    return df.limit(0)


def keyed_append(df: DataFrame, target: str, key: str) -> None:
    """Append rows to a Parquet folder whose ``key`` is unique; a repeated key raises and writes nothing.

    ``df`` is evaluated once, and of the target only keys within the new ones' range are read. A folder of Parquet has no
    lock: writers of one target must take turns.
    """
    df = df.persist()
    try:
        twice = df.groupBy(key).count().where("count > 1").select(key)
        try:
            stored = df.sparkSession.read.schema(df.schema).parquet(target)
            low, high = df.agg(F.min(key), F.max(key)).first()
            twice = twice.union(df.select(key).join(stored.where(F.col(key).between(low, high)).select(key), key, "left_semi"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        clash = twice.take(1)
        if clash:
            raise DuplicateKey(clash[0][0])
        df.write.mode("append").parquet(target)
    finally:
        df.unpersist()


def bulk_load(df: DataFrame, target: str, key: str) -> None:
    """Write sorted by key, range-partitioned, so that files and row groups hold disjoint ranges."""
    df.sort(key).write.mode("overwrite").parquet(target)
