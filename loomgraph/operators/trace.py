"""Transitive callers, callees and impact, level by level.

A level is one join of the frontier with the edges.  The depth is at most five, so the levels of a
trace are written out as one plan and run as one job: each level's distinct frontier is a shuffle
that the levels behind it and the result share.  What is met again at a later level is dropped at
the end, where each node keeps its least depth.  Impact reads a level's edges in several ways, so
these are checkpointed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import clamp_depth, is_test_file, ordered
from loomgraph.operators.frames import checkpointed
from loomgraph.operators.resolve import unique_definitions

NODE = ("file", "symbol", "via", "depth")


def _levels(depth) -> int:
    return math.ceil(clamp_depth(depth))


def first_definition(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.filter(F.col("name") == name).orderBy("file", "line", "ord").limit(1).select("file", F.col("name").alias("symbol"))


def in_order(nodes: DataFrame, collation: str | None = None) -> DataFrame:
    return nodes.orderBy("depth", ordered("file", collation), ordered(F.coalesce("symbol", F.lit("")), collation))


def _nearest(levels: list[DataFrame]) -> DataFrame:
    """levels: file, symbol, via of each.  Every node at its least depth."""
    found = None
    for depth, rows in enumerate(levels, 1):
        rows = rows.withColumn("depth", F.lit(depth))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("file", "symbol", "via").agg(F.min("depth").alias("depth")).select(*NODE)


def trace_callers(symbols: DataFrame, edges: DataFrame, name: str, depth=2, collation: str | None = None) -> DataFrame:
    """Rows (file, symbol, via, depth).  An edge to a name in the frontier gives its caller; one without
    a calling symbol gives the file, and all symbols of that file join the frontier."""
    if _levels(depth) == 0:
        return first_definition(symbols, name).select("file", "symbol", F.lit("call").alias("via"), F.lit(0).alias("depth"))
    symbol = F.when(F.col("kind") == "call", F.col("caller_symbol"))
    steps = edges.select("callee_name", F.col("caller_file").alias("file"), symbol.alias("symbol"), F.when(symbol.isNull(), "import").otherwise("call").alias("via"))
    names = symbols.select(F.col("file").alias("f"), F.col("name").alias("n"))
    levels: list[DataFrame] = []
    for _ in range(_levels(depth)):
        if not levels:
            hits = steps.filter(F.col("callee_name") == name)
        else:
            fresh = levels[-1]
            climbed = fresh.filter("symbol IS NULL").select("file").join(names, F.col("file") == F.col("f")).select(F.col("n").alias("callee_name"))
            frontier = fresh.filter("symbol IS NOT NULL").select(F.col("symbol").alias("callee_name")).union(climbed).distinct()
            hits = steps.join(frontier, "callee_name", "left_semi")
        levels.append(hits.select("file", "symbol", "via").distinct())
    return in_order(_nearest(levels), collation)


def trace_callees(symbols: DataFrame, edges: DataFrame, name: str, depth=2, strict: bool = False, collation: str | None = None) -> DataFrame:
    """Rows (file, symbol, via, depth).  From a file in the frontier every call edge counts, whoever in
    the file makes it, and per callee name only the first; strict follows the calling symbol
    alone.  A call without a file goes to the one definition of its name, if there is one."""
    seed = first_definition(symbols, name)
    if _levels(depth) == 0:
        return seed.select("file", "symbol", F.lit("call").alias("via"), F.lit(0).alias("depth"))
    only = unique_definitions(symbols).select(F.col("name").alias("u"), F.col("file").alias("uf"))
    calls = edges.filter("kind = 'call'")
    of = ["caller_file", *(["caller_symbol"] if strict else [])]
    steps = calls.groupBy(*of, "callee_name").agg(F.min_by(F.struct("callee_file"), F.col("ord")).alias("t")).join(only, F.col("callee_name") == F.col("u"), "left")
    steps = steps.select(*of, F.coalesce("t.callee_file", "uf").alias("file"), F.col("callee_name").alias("symbol")).filter("file IS NOT NULL")
    frontier, levels = seed, []
    for _ in range(_levels(depth)):
        keys = frontier.select(F.col("file").alias("caller_file"), *([F.col("symbol").alias("caller_symbol")] if strict else [])).distinct()
        frontier = steps.join(keys, of, "left_semi").select("file", "symbol").distinct()
        levels.append(frontier.withColumn("via", F.lit("call")))
    # a cycle leads back to the seed, which is no callee of its own
    found = _nearest(levels).join(seed.withColumnsRenamed({"file": "sf", "symbol": "ss"}), (F.col("file") == F.col("sf")) & (F.col("symbol") == F.col("ss")), "left_anti")
    return in_order(found, collation)


def _ends(edges: DataFrame) -> DataFrame:
    """Each edge by the nodes that lead to it (kind F of a file, S of a symbol with or without a file)
    and what it leads to: rows (k, f, s, to_file, to_symbol, is_call, caller_symbol, callee_name)."""
    e = edges.select("caller_file", "caller_symbol", "callee_name", "callee_file", (F.col("kind") == "call").alias("is_call"))
    nothing = F.lit(None).cast("string")
    rest = ("is_call", "caller_symbol", "callee_name")
    caller = (F.col("caller_file").alias("to_file"), F.col("caller_symbol").alias("to_symbol"))
    callee = (F.col("callee_file").alias("to_file"), F.col("callee_name").alias("to_symbol"))
    out = e.select(F.lit("F").alias("k"), F.col("caller_file").alias("f"), nothing.alias("s"), *callee, *rest)
    out = out.unionByName(e.filter("callee_file IS NOT NULL").select(F.lit("F").alias("k"), F.col("callee_file").alias("f"), nothing.alias("s"), *caller, *rest))
    out = out.unionByName(e.select(F.lit("S").alias("k"), nothing.alias("f"), F.col("callee_name").alias("s"), *caller, *rest))
    return out.unionByName(e.filter("is_call AND caller_symbol IS NOT NULL").select(F.lit("S").alias("k"), F.col("caller_file").alias("f"), F.col("caller_symbol").alias("s"), *callee, *rest))


def impact(symbols: DataFrame, edges: DataFrame, file: str | None = None, symbol: str | None = None, depth=2) -> DataFrame:
    """Rows (section, value): the files reached both ways from the target, the symbols on the call
    edges scanned, and which of the files are tests."""
    spark = symbols.sparkSession
    node = "k string, f string, s string"
    rows = [("F", file, None)] if file is not None else []
    rows += [("S", None, symbol)] if symbol is not None else []
    seeds = spark.createDataFrame(rows, node)
    if symbol is not None:
        there = symbols.filter(F.col("name") == symbol).select("file", "name")
        seeds = seeds.union(there.select(F.lit("F"), "file", F.lit(None).cast("string"))).union(there.select(F.lit("S"), "file", "name"))
    ends = _ends(edges)
    frontier = seeds.distinct()
    files, scanned = frontier.filter("f IS NOT NULL").select(F.col("f").alias("value")), spark.createDataFrame([], "value string")
    for _ in range(_levels(depth)):
        # a symbol of a file is also met by its name alone
        keys = frontier.unionByName(frontier.filter("k = 'S' AND f IS NOT NULL").withColumn("f", F.lit(None).cast("string"))).distinct()
        keys = keys.select(*[F.col(c).alias(f"of_{c}") for c in ("k", "f", "s")])
        hits = ends.join(keys, (F.col("k") == F.col("of_k")) & F.col("f").eqNullSafe(F.col("of_f")) & F.col("s").eqNullSafe(F.col("of_s")), "left_semi").drop("k", "f", "s").distinct()
        # read in several ways by the result and the next level
        hits = checkpointed(hits)
        calls = hits.filter("is_call")
        scanned = scanned.union(calls.select("caller_symbol")).union(calls.select("callee_name"))
        reached = hits.filter("to_file IS NOT NULL").select("to_file", "to_symbol", "is_call")
        frontier = reached.select(F.lit("F").alias("k"), F.col("to_file").alias("f"), F.lit(None).cast("string").alias("s"))
        frontier = frontier.union(reached.filter("is_call AND to_symbol IS NOT NULL").select(F.lit("S"), "to_file", "to_symbol")).distinct()
        files = files.union(frontier.select("f"))
    files = files.distinct()
    out = files.select(F.lit("files").alias("section"), "value")
    out = out.union(scanned.filter("value IS NOT NULL").distinct().select(F.lit("symbols"), "value"))
    out = out.union(files.filter(is_test_file("value")).select(F.lit("tests"), "value"))
    return out.orderBy("section", "value")


def without_tests(found: DataFrame) -> DataFrame:
    """found: of impact().  Its files that are no tests."""
    return found.filter("section = 'files'").select("value").join(found.filter("section = 'tests'").select("value"), "value", "left_anti")
