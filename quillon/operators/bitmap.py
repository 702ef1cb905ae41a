"""Bitmap indexes, algebra on row sets, and scans of a table through them.

An index is a DataFrame (key, bucket, bits): for each key and each run of 32,768 rows a bitmap, built
by Spark's bitmap aggregates with partial aggregation, so no row list is ever collected. A row set is a
DataFrame (bucket, bits); operations on sets join or aggregate whole bitmaps by bucket, at most one per 32,768 rows, and
``positions`` decodes the last one only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap of Spark's (4096 bytes).
BUCKET_BITS = 32768


def build_index(rows: DataFrame, key: str, row: str) -> DataFrame:
    """Of pairs (key, row); pairs that repeat count once. ``row`` counts from 0."""
    # Spark's bucket numbers start at 1 and positions count within a bucket from row 1
    at = F.col(row) + 1
    return rows.groupBy(F.col(key).alias("key"), F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def total_rows(rows: DataFrame, row: str) -> DataFrame:
    """The largest row id and one; 0 without rows."""
    return rows.agg(F.coalesce(F.max(row) + 1, F.lit(0)).cast("bigint").alias("total_rows"))


def num_values(index: DataFrame) -> DataFrame:
    return index.agg(F.count_distinct("key").alias("num_values"))


def positions(bitmaps: DataFrame) -> DataFrame:
    """``row`` of each set bit of (bucket, bits)."""
    byte = lambda i: F.conv(F.hex(F.substring("bits", i + 1, F.lit(1))), 16, 10).cast("int")
    numbers = F.filter(F.sequence(F.lit(0), F.lit(BUCKET_BITS // 8 - 1)), lambda i: F.substring("bits", i + 1, F.lit(1)) != F.lit(b"\0"))
    bits = bitmaps.select("bucket", "bits", F.explode(numbers).alias("i")).select("bucket", "i", byte(F.col("i")).alias("b"))
    found = bits.select("bucket", "i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(F.col("b"), k) == 1)).alias("k"))
    return found.select(((F.col("bucket") - 1) * BUCKET_BITS + F.col("i") * 8 + F.col("k")).cast("bigint").alias("row"))


def lookup(index: DataFrame, key: object) -> DataFrame:
    """Row set of a key; empty for an absent one."""
    return index.where(F.col("key") == key).select("bucket", "bits")


def any_of(index: DataFrame, keys: Sequence[object]) -> DataFrame:
    """Rows under at least one key."""
    some = index.where(F.col("key").isin(list(keys))) if keys else index.limit(0)
    return some.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def all_of(index: DataFrame, keys: Sequence[object]) -> DataFrame:
    """Rows under every key; none for no keys."""
    keys = list(dict.fromkeys(keys))
    some = index.where(F.col("key").isin(keys)) if keys else index.limit(0)
    return _common(some.select("bucket", "bits"), len(keys))


def count_rows(index: DataFrame, key: object) -> DataFrame:
    """Cardinality of a key's rows, from the bitmaps alone."""
    return index.where(F.col("key") == key).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("count"))


# scans of a table by keys, without an index

def scan_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == value)


def scan_or(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    return df.where(F.col(column).isin(list(values))) if values else df.limit(0)


def scan_and(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows that meet every condition; none for no conditions."""
    if not conditions:
        return df.limit(0)
    for c in conditions:
        df = df.where(c)
    return df


def scan_and_keys(pairs: DataFrame, row: str, key: str, keys: Sequence[object]) -> DataFrame:
    """Of a many-valued attribute (row, key): rows that carry every one of ``keys``."""
    keys = list(dict.fromkeys(keys))
    if not keys:
        return pairs.select(row).limit(0)
    held = [F.max(F.when(F.col(key) == k, 1).otherwise(0)).alias(f"_k{i}") for i, k in enumerate(keys)]
    out = pairs.where(F.col(key).isin(keys)).groupBy(row).agg(*held)
    return scan_and(out, *[F.col(f"_k{i}") == 1 for i in range(len(keys))]).select(row)


# scans of a table through an index. Rows come in no order; ids that the table lacks are skipped

def scan_set(df: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id, the column ``row``, is in the set ``rows``."""
    return df.join(positions(rows).withColumnRenamed("row", row), row, "left_semi").select(df.columns)


def scan_by_index(df: DataFrame, row: str, index: DataFrame, key: object) -> DataFrame:
    return scan_set(df, row, lookup(index, key))


def scan_by_index_or(df: DataFrame, row: str, index: DataFrame, keys: Sequence[object]) -> DataFrame:
    return scan_set(df, row, any_of(index, keys))


def scan_by_index_and(df: DataFrame, row: str, index: DataFrame, keys: Sequence[object]) -> DataFrame:
    return scan_set(df, row, all_of(index, keys))


# algebra on row sets

def row_set(rows: DataFrame, row: str = "row") -> DataFrame:
    return build_index(rows.select(F.lit(0).alias("key"), F.col(row).alias("row")), "key", "row").select("bucket", "bits")


def _common(bitmaps: DataFrame, n: int) -> DataFrame:
    """Rows in ``n`` of as many sets, whose bitmaps are given together."""
    both = bitmaps.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return both.where(F.col("n") == n).select("bucket", "bits")


def set_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return _common(a.unionByName(b), 2)


def set_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def set_not(a: DataFrame, length: DataFrame | int) -> DataFrame:
    """Rows below ``length``, a number or a frame of one such as ``total_rows``, that are not in ``a``."""
    spark = a.sparkSession
    if isinstance(length, int):
        length = spark.range(1).select(F.lit(length).cast("bigint").alias("total_rows"))
    last = F.floor((F.col("total_rows") - 1) / BUCKET_BITS).cast("bigint")
    at = F.explode(F.when(F.col("total_rows") > 0, F.sequence(F.lit(0).cast("bigint"), last)))
    buckets = length.select("total_rows", at.alias("k")).select((F.col("k") + 1).alias("bucket"), F.least(F.lit(BUCKET_BITS), F.col("total_rows") - F.col("k") * BUCKET_BITS).cast("int").alias("n"))
    # the bitmap of the first n rows in hexadecimal; rows count from the low bit of each byte
    edge = F.get(F.array(*[F.lit(x) for x in ("", "01", "03", "07", "0F", "1F", "3F", "7F")]), F.col("n") % 8)
    every = F.rpad(F.concat(F.repeat(F.lit("FF"), F.floor(F.col("n") / 8).cast("int")), edge), BUCKET_BITS // 4, "0")
    flipped = F.unhex(F.translate(F.hex("bits"), "0123456789ABCDEF", "FEDCBA9876543210"))
    every = buckets.select("bucket", F.unhex(every).alias("bits"))
    others = a.join(every.select("bucket"), "bucket", "left_semi").select("bucket", flipped.alias("bits"))
    return every.unionByName(others).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"))


def set_count(a: DataFrame) -> DataFrame:
    return a.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("count"))


def set_iterate(a: DataFrame) -> DataFrame:
    return positions(a).orderBy("row")
