"""Declared types, column definitions, values and errors."""

from __future__ import annotations

import enum
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import types as T


class EngineError(Exception):
    """Base of every error this library raises on its own."""


class StorageError(EngineError): ...
class CorruptData(EngineError): ...
class SchemaError(EngineError): ...
class TableNotFound(SchemaError): ...
class TableExists(SchemaError): ...
class ColumnNotFound(SchemaError): ...
class ColumnExists(SchemaError): ...
class IndexNotFound(SchemaError): ...
class IndexExists(SchemaError): ...
class TypeMismatch(EngineError): ...
class DuplicateKey(EngineError): ...
class UniqueViolation(DuplicateKey): ...
class RowTooLarge(EngineError): ...
class TransactionConflict(EngineError): ...
class TransactionClosed(EngineError): ...
class EncryptionRequired(EngineError): ...
class InvalidKey(EngineError): ...
class CollectionNotFound(EngineError): ...
class CollectionExists(EngineError): ...
class DimensionMismatch(EngineError): ...
class VectorNotFound(EngineError): ...
class VectorExists(EngineError): ...
class InvalidPath(EngineError): ...


class DataType(enum.Enum):
    TEXT = "text"
    INTEGER = "integer"
    REAL = "real"
    BLOB = "blob"
    BOOLEAN = "boolean"

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]


_SPARK = {DataType.TEXT: T.StringType(), DataType.INTEGER: T.LongType(), DataType.REAL: T.DoubleType(), DataType.BLOB: T.BinaryType(), DataType.BOOLEAN: T.BooleanType()}
MAX_ID = (1 << 63) - 1


class Kind(enum.Enum):
    """Sets of types whose values compare with each other."""

    TEXT = "text"
    NUMBER = "number"
    BLOB = "blob"
    BOOLEAN = "boolean"
    OTHER = "other"


def kind_of_type(t: T.DataType) -> Kind:
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return Kind.TEXT
    if isinstance(t, T.NumericType):
        return Kind.NUMBER
    if isinstance(t, T.BinaryType):
        return Kind.BLOB
    if isinstance(t, T.BooleanType):
        return Kind.BOOLEAN
    return Kind.OTHER


def kind_of_value(v: Any) -> Kind:
    if isinstance(v, bool):
        return Kind.BOOLEAN
    if isinstance(v, (int, float)):
        return Kind.NUMBER
    if isinstance(v, str):
        return Kind.TEXT
    if isinstance(v, (bytes, bytearray)):
        return Kind.BLOB
    return Kind.OTHER


def type_of_value(v: Any) -> DataType | None:
    """The declared type a native value has; None for null."""
    if v is None:
        return None
    if isinstance(v, bool):
        return DataType.BOOLEAN
    if isinstance(v, int):
        return DataType.INTEGER
    if isinstance(v, float):
        return DataType.REAL
    if isinstance(v, str):
        return DataType.TEXT
    if isinstance(v, (bytes, bytearray)):
        return DataType.BLOB
    raise TypeMismatch(f"no type for {type(v).__name__}")


def checked(v: Any, t: DataType, column: str) -> Any:
    """v as a value of type t. Integers widen to reals; nothing else is converted."""
    got = type_of_value(v)
    if got is None:
        return None
    if got is t:
        if t is DataType.INTEGER and not -(1 << 63) <= v <= MAX_ID:
            raise TypeMismatch(f"{column}: {v} is beyond 64 bits")
        return bytes(v) if t is DataType.BLOB else v
    if got is DataType.INTEGER and t is DataType.REAL:
        return float(v)
    raise TypeMismatch(f"{column} is {t.value}, not {got.value}")


def size_of(v: Any) -> int:
    """Bytes a value takes when encoded, for the row size limit."""
    if v is None:
        return 1
    if isinstance(v, str):
        return 5 + len(v.encode())
    if isinstance(v, (bytes, bytearray)):
        return 5 + len(v)
    return 2 if isinstance(v, bool) else 9


@dataclass(frozen=True)
class ColumnDef:
    """A declared column. nullable and unique are kept, not enforced: uniqueness comes from unique indexes."""

    name: str
    type: DataType
    nullable: bool = True
    is_unique: bool = False
    default_value: Any = None
    col_id: int = -1
    dropped: bool = False

    def not_null(self) -> ColumnDef:
        return replace(self, nullable=False)

    def unique(self) -> ColumnDef:
        return replace(self, is_unique=True)

    def default(self, value: Any) -> ColumnDef:
        return replace(self, default_value=checked(value, self.type, self.name))
