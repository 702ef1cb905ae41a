"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass

from quillon.catalog import Column


@dataclass(frozen=True)
class Literal:
    """An int, str or bool."""

    value: int | str | bool


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expression
    right: Expression


Expression = Literal | Name | Binary


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[Column, ...]


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Select:
    """``columns`` is None for ``*``; ``order_by`` is (name, descending)."""

    columns: tuple[str, ...] | None
    table: str
    where: Expression | None = None
    order_by: tuple[str, bool] | None = None


@dataclass(frozen=True)
class Begin:
    pass


@dataclass(frozen=True)
class Commit:
    pass


@dataclass(frozen=True)
class Rollback:
    pass


Statement = CreateTable | Insert | Select | Begin | Commit | Rollback
