"""Schemas of the tables, and guards on their enumerated columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("function", "class", "method")
EDGE_KINDS = ("import", "call")
CONFIDENCES = ("high", "low")

_S, _I = T.StringType(), T.IntegerType()


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


FILES = _struct(("path", _S, False), ("hash", _S, False))
#: ord: place in the file's parse, the last of all tie-breakers
SYMBOLS = _struct(("name", _S, False), ("kind", _S, False), ("line", _I, False), ("signature", _S, True), ("file", _S, False), ("ord", _I, False))
EDGES = _struct(("caller_file", _S, False), ("caller_symbol", _S, True), ("callee_name", _S, False), ("callee_file", _S, True), ("kind", _S, False), ("confidence", _S, False), ("ord", _I, False))
IMPORTS = _struct(("file", _S, False), ("lang", _S, True), ("ref", _S, False), ("ord", _I, False))
CALLS = _struct(("file", _S, False), ("caller", _S, False), ("callee", _S, False), ("ord", _I, False))
RANKS = _struct(("file", _S, False), ("rank", T.DoubleType(), False))
SOURCES = _struct(("path", _S, False), ("content", _S, True), ("lang", _S, True), ("hash", _S, True))
TABLES = {"files": FILES, "symbols": SYMBOLS, "edges": EDGES, "imports": IMPORTS, "calls": CALLS, "ranks": RANKS}


def empty(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _guarded(column: str, allowed: tuple[str, ...], what: str) -> Column:
    c = F.col(column)
    return F.when(c.isin(*allowed), c).otherwise(F.raise_error(F.concat(F.lit(f"invalid {what}: "), F.coalesce(c, F.lit("null")))).cast("string")).alias(column)


def guard_symbols(symbols: DataFrame) -> DataFrame:
    """Fails the write that meets an unknown kind."""
    return symbols.select(*[_guarded("kind", KINDS, "kind") if c == "kind" else c for c in symbols.columns])


def guard_edges(edges: DataFrame) -> DataFrame:
    guards = {"kind": _guarded("kind", EDGE_KINDS, "edge kind"), "confidence": _guarded("confidence", CONFIDENCES, "confidence")}
    return edges.select(*[guards.get(c, c) for c in edges.columns])
