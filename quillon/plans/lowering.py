"""From checked and folded trees to Columns and DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.catalog import ROW_ID, Kind, Table
from quillon.errors import SqlError
from quillon.sql import ast
from quillon.sql.fold import can_raise, constant_error, fold
from quillon.sql.typecheck import expression_kind

COMPARE = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def column(e: ast.Expression, table: Table) -> Column:
    """Under ANSI rules, arithmetic is checked by Spark.

    AND and OR evaluate both sides here, so an error on the right is not hidden by the left. Where
    neither side can fail, that can't be told apart and the plain operators let Spark push filters
    down; else ``least`` and ``greatest`` of booleans are AND and OR that always see both.
    """
    if isinstance(e, ast.Literal):
        return F.lit(e.value) if not isinstance(e.value, int) or isinstance(e.value, bool) else F.lit(e.value).cast("int")
    if isinstance(e, ast.Name):
        return F.col(f"`{table.column(e.name).name}`")
    a, b = column(e.left, table), column(e.right, table)
    if e.op in ("AND", "OR"):
        if can_raise(e.left) or can_raise(e.right):
            return F.least(a, b) if e.op == "AND" else F.greatest(a, b)
        return a & b if e.op == "AND" else a | b
    if e.op in COMPARE:
        return getattr(a, COMPARE[e.op])(b)
    if e.op == "/":
        quotient = F.call_function("div", a, b)
        return quotient if expression_kind(e, table) == Kind.BIGINT else quotient.cast("int")
    return a + b if e.op == "+" else a - b if e.op == "-" else a * b


def output_columns(select: ast.Select, table: Table) -> list[str]:
    """Names in the spelling of the schema; repeated names stay."""
    return [c.name for c in table.columns] if select.columns is None else [table.column(c).name for c in select.columns]


def filtered(select: ast.Select, table: Table, rows: DataFrame) -> DataFrame:
    if select.where is None:
        return rows
    where = fold(select.where)
    if isinstance(where, ast.Literal):
        return rows if where.value else rows.limit(0)
    if (error := constant_error(where)) is not None:
        # fails on the first row, whatever that is; without rows there is nothing to fail on
        if rows.isEmpty():
            return rows.limit(0)
        raise SqlError(error)
    return rows.where(column(where, table))


def ordering(select: ast.Select, table: Table, has_row_id: bool) -> list[Column]:
    """The key, and ties by row id in either direction."""
    out = []
    if select.order_by:
        key = F.col(f"`{table.column(select.order_by[0]).name}`")
        out.append(key.desc() if select.order_by[1] else key.asc())
    return out + ([F.col(ROW_ID).asc()] if has_row_id else [])


def lower(select: ast.Select, table: Table, rows: DataFrame, ordered: bool = True) -> DataFrame:
    """Filter, then sort, then project, so the key need not be projected.

    Without ORDER BY rows come by row id, where ``ordered`` asks for an order at all.
    """
    has_row_id = ROW_ID in rows.columns
    out = filtered(select, table, rows)
    order = ordering(select, table, has_row_id)
    if order and (ordered or select.order_by):
        out = out.orderBy(*order)
    names = output_columns(select, table)
    return out.select(*[F.col(f"`{c}`").alias(c) for c in names])
