"""Symbol search in tiers, ranked by the file's PageRank; and the ranked map within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import fold, fold_text, ordered, symbol_line, token_cost

MODES = ("exact", "prefix", "substring")


def name_matches(name: str, mode: str) -> Column:
    """exact minds case; the others fold A-Z.  % and _ stand for themselves."""
    if mode not in MODES:
        raise ValueError(f"invalid mode: {mode}")
    if mode == "exact":
        return F.col("name") == name
    folded = F.lit(fold_text(name))
    return F.startswith(fold("name"), folded) if mode == "prefix" else F.contains(fold("name"), folded)


def find_symbols(symbols: DataFrame, name: str, mode: str = "exact", kind: str | None = None) -> DataFrame:
    found = symbols.filter(name_matches(name, mode))
    found = found.filter(F.col("kind") == kind) if kind is not None else found
    return found.orderBy("file", "line", *[c for c in ("ord",) if c in symbols.columns])


def tier(query: str) -> Column:
    """0 exact, 1 prefix, 2 substring, null otherwise."""
    return F.when(name_matches(query, "exact"), 0).when(name_matches(query, "prefix"), 1).when(name_matches(query, "substring"), 2)


def with_rank(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    return rows.join(ranks.select("file", "rank"), "file", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))


def find_ranked(symbols: DataFrame, ranks: DataFrame, query: str, kind: str | None = None, top_k: int | None = 20, collation: str | None = None) -> DataFrame:
    """Rows (tier, rank, file, line, kind, name, signature): by tier, rank, file and line; of rows
    with equal file, name and line the first.  One scan: the tier is a function of the name."""
    hits = symbols.withColumn("tier", tier(query)).filter("tier IS NOT NULL" if query else "false")
    hits = hits.filter(F.col("kind") == kind) if kind is not None else hits
    # equal names have one tier, so the first is that of the least ord
    first = hits.groupBy("file", "name", "line", "tier").agg(F.min(F.struct("ord", "kind", "signature")).alias("first"))
    hits = first.select("tier", "file", "line", "name", "first.kind", "first.signature", "first.ord")
    best = with_rank(hits, ranks).orderBy("tier", F.desc("rank"), ordered("file", collation), "line", "ord")
    best = best.limit(top_k) if top_k is not None else best
    return best.select("tier", "rank", "file", "line", "kind", "name", "signature", "ord")


def map_lines(symbols: DataFrame, ranks: DataFrame) -> DataFrame:
    """Lines of a map: each file with symbols, then its symbols.  Rows (file, rank, is_symbol, line,
    ord, text, cost)."""
    files = with_rank(symbols.select("file").distinct(), ranks)
    heads = files.select("file", "rank", F.lit(0).alias("is_symbol"), F.lit(0).alias("line"), F.lit(0).alias("ord"), F.col("file").alias("text"))
    body = F.concat(F.lit("  "), F.concat_ws("  ", F.col("line").cast("string"), "kind", "name", "signature"))
    lines = symbols.join(files, "file").select("file", "rank", F.lit(1).alias("is_symbol"), "line", "ord", body.alias("text"))
    return heads.unionByName(lines).withColumn("cost", token_cost("text"))


def fill_budget(lines: DataFrame, budget: int, collation: str | None = None) -> DataFrame:
    """The lines that fit, in file order of rank; `truncated` tells whether any did not.  Costs are at
    least one, so only the first `budget` + 1 lines can matter: the running sum, which needs
    them in one place, is bounded."""
    keys = (F.desc("rank"), ordered("file", collation), "is_symbol", "line", "ord")
    first = lines.orderBy(*keys).limit(budget + 1)
    so_far = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    summed = first.withColumn("total", F.sum("cost").over(so_far)).withColumn("truncated", F.max("total").over(whole) > budget)
    return summed.filter(F.col("total") <= budget).orderBy(*keys)


def find_lines(found: DataFrame) -> DataFrame:
    return found.select(symbol_line().alias("text"))
