"""A table and vector engine on Spark: declared tables, null-aware filters, cursors, snapshots and exact search."""

from .catalog import Database, Durability, LightTransaction, Snapshot, Transaction, open_database
from .functions.distance import Metric
from .operators.query import Batch, FindOptions, FindResult, ScanOrder, Sort
from .predicate import Filter
from .types import ColumnDef, DataType, EngineError

__all__ = ["Batch", "ColumnDef", "DataType", "Database", "Durability", "EngineError", "Filter", "FindOptions", "FindResult", "LightTransaction", "Metric", "ScanOrder", "Snapshot", "Sort", "Transaction", "open_database"]
