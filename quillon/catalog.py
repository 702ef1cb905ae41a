"""Tables and their columns. Names compare without case and keep their spelling."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import types as T

from quillon.errors import Corrupted, TableExists, TableNotFound

ROW_ID = "_rowid"


class Kind(StrEnum):
    INT = "INT"
    VARCHAR = "VARCHAR"
    BOOL = "BOOL"
    #: External tables only: checked 64-bit integers, and types that can only be projected or ordered by.
    BIGINT = "BIGINT"
    OTHER = "OTHER"


DECLARABLE = {Kind.INT: T.IntegerType(), Kind.VARCHAR: T.StringType()}


def kind_of(spark_type: T.DataType) -> Kind:
    if isinstance(spark_type, T.IntegerType | T.ShortType | T.ByteType):
        return Kind.INT
    if isinstance(spark_type, T.LongType):
        return Kind.BIGINT
    if isinstance(spark_type, T.StringType):
        return Kind.VARCHAR
    return Kind.BOOL if isinstance(spark_type, T.BooleanType) else Kind.OTHER


@dataclass(frozen=True)
class Column:
    name: str
    kind: Kind


@dataclass
class Table:
    name: str
    columns: list[Column]
    next_row_id: int = 1
    #: Parquet folders of the rows that checkpoints have folded in, in row-id order, and how many rows each has.
    segments: list[tuple[str, int]] = field(default_factory=list)
    #: Set for external tables: the path that is read as it is.
    external: str | None = None

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(ROW_ID, T.LongType(), False), *(T.StructField(c.name, DECLARABLE[c.kind], False) for c in self.columns)])

    def to_json(self) -> dict:
        return {"name": self.name, "columns": [[c.name, c.kind.value] for c in self.columns], "next_row_id": self.next_row_id, "segments": self.segments}

    @staticmethod
    def from_json(x: dict) -> Table:
        try:
            return Table(x["name"], [Column(n, Kind(k)) for n, k in x["columns"]], x["next_row_id"], [(str(path), int(rows)) for path, rows in x["segments"]])
        except (KeyError, TypeError, ValueError) as e:
            raise Corrupted(f"table entry: {e}") from None


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)

    def get(self, name: str) -> Table:
        found = self.tables.get(name.lower())
        if found is None:
            raise TableNotFound(name)
        return found

    def has(self, name: str) -> bool:
        return name.lower() in self.tables

    def add(self, table: Table) -> None:
        if self.has(table.name):
            raise TableExists(table.name)
        self.tables[table.name.lower()] = table
