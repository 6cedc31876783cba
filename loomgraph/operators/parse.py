"""Parsing as a DataFrame operator: one row per file in, nested results out, then flat tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from loomgraph.functions.parsers import PARSERS, analyze

_SYMBOL = "struct<name:string,kind:string,line:int,signature:string>"
ANALYZED = f"path string, lang string, symbols array<{_SYMBOL}>, imports array<string>, calls array<struct<caller:string,callee:string>>, error string"
_ARROW_SYMBOL = pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("signature", pa.string())])
_ARROW_CALL = pa.struct([("caller", pa.string()), ("callee", pa.string())])


def parse_one(source: str | None, lang: str | None) -> dict:
    """What a file's parser finds, and the error if it fails."""
    nothing = {"symbols": [], "imports": [], "calls": []}
    if lang not in PARSERS:
        return nothing | {"error": None}
    try:
        return analyze(source, lang) | {"error": None}
    except (RecursionError, MemoryError, ValueError, IndexError, KeyError) as e:
        return nothing | {"error": f"{type(e).__name__}: {e}"}


def parse_sources(sources: DataFrame) -> DataFrame:
    """sources: path, content, lang.  Files of unknown language have empty results; so have files that
    a parser fails on, which `error` tells."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [parse_one(s, lang) for s, lang in zip(batch.column("content").to_pylist(), batch.column("lang").to_pylist(), strict=True)]
            symbols = [[dict(zip(("name", "kind", "line", "signature"), s, strict=True)) for s in g["symbols"]] for g in got]
            calls = [[{"caller": a, "callee": b} for a, b in g["calls"]] for g in got]
            cols = [batch.column("path"), batch.column("lang"), pa.array(symbols, pa.list_(_ARROW_SYMBOL)), pa.array([g["imports"] for g in got], pa.list_(pa.string())), pa.array(calls, pa.list_(_ARROW_CALL)), pa.array([g["error"] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["path", "lang", "symbols", "imports", "calls", "error"])

    return sources.select("path", "content", "lang").mapInArrow(work, ANALYZED)


def symbols_of(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.col("path").alias("file"), F.posexplode("symbols").alias("ord", "s"))
    return rows.select("s.name", "s.kind", "s.line", "s.signature", "file", "ord")


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("file"), "lang", F.posexplode("imports").alias("ord", "ref")).select("file", "lang", "ref", "ord")


def calls_of(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.col("path").alias("file"), F.posexplode("calls").alias("ord", "c"))
    return rows.select("file", "c.caller", "c.callee", "ord")


@udtf(returnType="section string, ord int, name string, kind string, line int, signature string, callee string")
class AnalyzeSource:
    """Table function for SQL: SELECT * FROM sources, LATERAL analyze_source(content, lang)."""

    def eval(self, content: str, lang: str):
        got = analyze(content, lang or "python")
        for i, s in enumerate(got["symbols"]):
            yield "symbol", i, *s, None
        for i, ref in enumerate(got["imports"]):
            yield "import", i, ref, None, None, None, None
        for i, (caller, callee) in enumerate(got["calls"]):
            yield "call", i, caller, None, None, None, callee


def register_functions(spark) -> None:
    spark.udtf.register("analyze_source", AnalyzeSource)
