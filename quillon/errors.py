"""Errors of the engine. Message texts are part of its interface and state fixed values."""

from __future__ import annotations


class DbError(Exception):
    pass


class SqlError(DbError):
    def __init__(self, message: str):
        super().__init__(f"SQL error: {message}")


class TableNotFound(DbError):
    def __init__(self, name: str):
        super().__init__(f"Table '{name}' does not exist")


class TableExists(DbError):
    def __init__(self, name: str):
        super().__init__(f"Table '{name}' already exists")


class ColumnNotFound(DbError):
    def __init__(self, column: str, table: str):
        super().__init__(f"Column '{column}' does not exist in table '{table}'")


class TypeMismatch(DbError):
    def __init__(self, message: str):
        super().__init__(f"Type error: {message}")


class RecordTooLarge(DbError):
    def __init__(self, size: int, most: int):
        super().__init__(f"Record too large: {size} bytes (max {most})")
        self.size, self.most = size, most


class TransactionError(DbError):
    def __init__(self, message: str):
        super().__init__(f"Transaction error: {message}")


class DuplicateKey(DbError):
    def __init__(self, key: object):
        super().__init__(f"Duplicate key: {key}")
        self.key = key


class KeyNotFound(DbError):
    def __init__(self, key: object):
        super().__init__(f"Key not found: {key}")
        self.key = key


class Corrupted(DbError):
    def __init__(self, message: str):
        super().__init__(f"Corrupted metadata: {message}")


class InternalError(DbError):
    def __init__(self, message: str):
        super().__init__(f"Internal error: {message}")
