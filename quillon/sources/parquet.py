"""External tables: Parquet that the SELECT of this dialect reads as it is.

An extension: BIGINT columns are checked 64-bit integers, other types can be projected and
ordered by. NULL follows three-valued logic; the dialect's own tables have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.catalog import Catalog, Column, Table, kind_of
from quillon.plans.lowering import lower
from quillon.sql import ast
from quillon.sql.parser import parse
from quillon.sql.typecheck import check


def table_of(name: str, df: DataFrame, path: str | None = None) -> Table:
    return Table(name, [Column(f.name, kind_of(f.dataType)) for f in df.schema.fields], external=path)


def select_from(df: DataFrame, name: str, sql: str) -> DataFrame:
    """Run one SELECT over ``df`` as table ``name``."""
    statement = parse(sql)
    table = table_of(name, df)
    check(statement, Catalog({name.lower(): table}))
    assert isinstance(statement, ast.Select)
    return lower(statement, table, df, ordered=False)


def select_parquet(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run one SELECT over ``folder``/<table>.parquet; only the columns and row groups it needs are read."""
    statement = parse(sql)
    return select_from(spark.read.parquet(f"{folder}/{statement.table}.parquet"), statement.table, sql)
