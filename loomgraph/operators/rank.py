"""PageRank of a weighted multigraph.

Below a bound on its links a graph is ranked by one numpy task; above, by a DataFrame loop with one
action a round.  Both follow the same recurrence: what nodes without links hold is spread over
all, self-loops count, rounds end when the ranks move less than tol in sum, or after `iterations`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.frames import checkpointed

#: links up to which one task ranks the graph
KERNEL_LINKS = 500_000
DIGITS = 12


def link_weights(links: DataFrame) -> DataFrame:
    """links: src, dst.  Rows (src, dst, w): w parallel links."""
    return links.groupBy("src", "dst").agg(F.count("*").alias("w"))


def all_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes: node.  Adds the ends of links that it lacks."""
    return nodes.select("node").union(links.select("src")).union(links.select("dst")).filter("node IS NOT NULL").distinct()


def rank_arrays(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, damping: float, iterations: int, tol: float) -> np.ndarray:
    out = np.bincount(src, w, minlength=n)
    part, dangling, r = damping * w / out[src], out == 0, np.full(n, 1.0 / n)
    for _ in range(iterations):
        base = (1 - damping) / n + damping * r[dangling].sum() / n
        new = base + np.bincount(dst, r[src] * part, minlength=n)
        moved, r = np.abs(new - r).sum(), new
        if moved < tol:
            break
    return r


def _kernel(nodes: DataFrame, weights: DataFrame, damping: float, iterations: int, tol: float) -> DataFrame:
    rows = weights.select("src", "dst", F.col("w").cast("double").alias("w")).unionByName(nodes.select(F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("w")))

    def work(batches):
        t = pa.Table.from_batches(batches_) if (batches_ := list(batches)) else None
        if t is None or not t.num_rows:
            return
        # every node has a row of its own as a source
        names = sorted(set(t.column("src").to_pylist()), key=lambda s: s.encode())
        at = {s: i for i, s in enumerate(names)}
        t = t.filter(pa.compute.is_valid(t.column("dst")))
        src, dst = (np.array([at[x] for x in t.column(c).to_pylist()], np.int64) for c in ("src", "dst"))
        ranks = rank_arrays(len(names), src, dst, t.column("w").to_numpy(), damping, iterations, tol)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ranks)], ["node", "rank"])

    # bounded: KERNEL_LINKS links and their ends, or as many nodes
    return rows.coalesce(1).sortWithinPartitions("src", "dst").mapInArrow(work, "node string, rank double")


def _loop(nodes: DataFrame, weights: DataFrame, damping: float, iterations: int, tol: float) -> DataFrame:
    n = nodes.count()
    totals = weights.groupBy("src").agg(F.sum("w").alias("total"))
    edges = checkpointed(weights.join(totals, "src").select("src", "dst", (damping * F.col("w") / F.col("total")).alias("part")))
    base = nodes.join(totals, nodes["node"] == totals["src"], "left").select("node", F.col("total").isNull().alias("dangling"))
    state = checkpointed(base.withColumns({"rank": F.lit(1.0 / n), "moved": F.lit(0.0)}))
    held = state.agg(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0))).first()[0]
    for _ in range(iterations):
        floor = (1 - damping) / n + damping * held / n
        got = state.join(edges, state["node"] == edges["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("part")).alias("got"))
        new = F.lit(floor) + F.coalesce("got", F.lit(0.0))
        state = checkpointed(state.join(got, state["node"] == got["dst"], "left").select("node", "dangling", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")))
        held, moved = state.agg(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)), F.sum("moved")).first()
        if moved < tol:
            break
    return state.select("node", "rank")


def page_rank(nodes: DataFrame, links: DataFrame, damping: float = 0.85, iterations: int = 30, tol: float = 1e-6, kernel_links: int = KERNEL_LINKS) -> DataFrame:
    """nodes: node; links: src, dst.  Rows (node, rank); an empty graph has none."""
    # both are read several times, and may stand on long plans
    everyone, weights = checkpointed(all_nodes(nodes, links)), checkpointed(link_weights(links))
    if everyone.isEmpty():
        return everyone.select("node", F.lit(0.0).alias("rank")).limit(0)
    size = weights.limit(kernel_links + 1).count() + everyone.limit(kernel_links + 1).count()
    rank = _kernel if size <= kernel_links else _loop
    return rank(everyone, weights, damping, iterations, tol)


def file_links(edges: DataFrame) -> DataFrame:
    return edges.filter("callee_file IS NOT NULL").select(F.col("caller_file").alias("src"), F.col("callee_file").alias("dst"))


def file_ranks(symbols: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """Rows (file, rank) of every file with a symbol or an edge; every resolved edge is a link.  Ranks
    are rounded to DIGITS, so that files of equal rank tie, whatever the order of the sums."""
    nodes = symbols.select(F.col("file").alias("node")).union(edges.select("caller_file"))
    return page_rank(nodes, file_links(edges), **options).select(F.col("node").alias("file"), F.round("rank", DIGITS).alias("rank"))
