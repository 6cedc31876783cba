"""Exact top-k by inner product, block at a time.

Vectors, each component x taken as floor(64 x), are packed by ranges of vec_id into blocks: a forward
index (the rows) and the largest and least value of every term (component).  For a query these
give a bound on the scores in a block: the sum over terms of the larger of q*max and q*min.  A
query is scored against blocks in falling order of bound, through their forward indexes, until the
next bound is below its k-th score.

Over the cluster that takes two passes.  Queries, in chunks, meet the bounds of all blocks (two
rows of terms a block).  First each query is scored in the LEAD blocks that promise it most, which
gives it a k-th score; then a chunk is sent only those blocks whose bound reaches the k-th score of
one of its queries, in cells of bounded size, and each query only looks at its own of these.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no
part, nor do rows with null vec_id; rows with equal vec_id are rows of their own, as queries and as
candidates (of each other too); shorter vectors are taken as ending in zeros; without queries or
candidates there are no rows; scores beyond a long count as the nearest long; further columns are
ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import partitions, slices, stored, table, trimmed

#: vectors of a block, queries of a chunk, blocks of a cell, bounds of blocks that a chunk meets at once
BLOCK, CHUNK, CELL, BOUNDS = 512, 1024, 16, 4096
#: blocks that a query is scored in first
LEAD = 2
PACKED = "id long, n int, dims int, ids binary, rows binary, highs binary, lows binary"
ASKED = "id long, n int, dims int, ids binary, own binary, rows binary"
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _row(schema: str, values: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    values = [v.tobytes() if isinstance(v, np.ndarray) else v for v in values]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[t]) for v, (_, t) in zip(values, columns, strict=True)], [n for n, _ in columns])


def _packed(ident: int, ids: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
    m = _matrix(rows)
    return _row(PACKED, [ident, len(ids), m.shape[1], np.array(ids, "<i8"), m, m.max(axis=0), m.min(axis=0)])


def _matrix(vectors: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def quantised(vector: list) -> np.ndarray | None:
    if not vector or None in vector:
        return None
    v = np.floor(64 * np.array(vector, np.float64))
    return v if np.isfinite(v).all() else None


def pack_blocks(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """vectors: vec_id, embedding.  Stored blocks of neighbours in vec_id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ids, rows = TaskContext.get().partitionId() << 32, [], []
        for batch in trimmed(batches):
            for i, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                v = quantised(vector)
                if v is None:
                    continue
                ids.append(i)
                rows.append(v)
                if len(ids) == block:
                    yield _packed(made, ids, rows)
                    ids, rows, made = [], [], made + 1
        if ids:
            yield _packed(made, ids, rows)

    n = partitions(vectors.sparkSession)
    known = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return stored(known.repartitionByRange(n, "vec_id").sortWithinPartitions("vec_id", "embedding").mapInArrow(work, PACKED), "blocks")


def query_chunks(blocks: DataFrame, divisor: int, chunk: int = CHUNK) -> DataFrame:
    """Stored chunks of the vectors whose vec_id the divisor divides; own: their block and row in it."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for some in slices(batch, "rows", 32_000_000):
                for r in some.to_pylist():
                    ids, m = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["rows"], "<f8").reshape(r["n"], r["dims"])
                    for k in np.flatnonzero(ids % divisor == 0).tolist():
                        yield _row(ASKED, [int(ids[k]), 1, r["dims"], ids[k : k + 1], np.array([r["id"], k], "<i8"), m[k]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = TaskContext.get().partitionId() << 32, []

        def full():
            ids, own = (np.frombuffer(b"".join(r[c] for r in held), "<i8") for c in ("ids", "own"))
            m = _matrix([np.frombuffer(r["rows"], "<f8") for r in held])
            return _row(ASKED, [made, len(held), m.shape[1], ids, own, m])

        for batch in trimmed(batches):
            for some in slices(batch, "rows", 32_000_000):
                for r in some.to_pylist():
                    held.append(r)
                    if len(held) == chunk:
                        yield full()
                        held, made = [], made + 1
        if held:
            yield full()

    single = stored(blocks.mapInArrow(one, ASKED), "asked")
    # so few tasks that most chunks are full
    tasks = max(1, single.count() // chunk)
    return stored(single.repartitionByRange(tasks, "id").sortWithinPartitions("id", "own").mapInArrow(work, ASKED), "queries")


def _products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as integers, exact: in doubles where no sum can leave their exact range."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(rows).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q @ rows.T).astype(np.int64)
    a, b = [[int(x) for x in r] for r in q.tolist()], [[int(x) for x in r] for r in rows.tolist()]
    return np.array([[min(MOST, max(LEAST, sum(x * y for x, y in zip(u, v, strict=True)))) for v in b] for u in a], np.int64)


def wide(m: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def bounds(queries: np.ndarray, highs: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """For queries and blocks: no score is higher.  The sums' rounding is that of their terms."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.maximum(queries, 0) @ highs.T + np.minimum(queries, 0) @ lows.T
        terms = np.abs(queries) @ np.maximum(np.abs(highs), np.abs(lows)).T
        return np.nan_to_num(out + terms * (queries.shape[1] + 4) * 2.0**-52, nan=np.inf, posinf=np.inf, neginf=np.inf)


def search_blocks(own: np.ndarray, queries: np.ndarray, blocks: list[tuple[int, np.ndarray, np.ndarray]], bound: np.ndarray, kth: np.ndarray, k: int):
    """(query number, vec_id, score) of each query's k best in the blocks, best first, of those that
    reach its kth score so far, and how many pairs of query and block were scored.  blocks: number,
    ids, rows; own: block and row of each query; bound: -inf where a query leaves a block out."""
    n, kth = len(queries), kth.copy()
    order = np.argsort(-bound, axis=1, kind="stable")
    who, what, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    scored = 0
    for step in range(len(blocks)):
        turn = order[:, step]
        best = bound[np.arange(n), turn]
        active = (best >= kth) & (best > -np.inf)
        if not active.any():
            break
        parts = [(who, what, score)]
        for b in np.unique(turn[active]).tolist():
            sel = np.flatnonzero(active & (turn == b))
            number, ids, rows = blocks[b]
            s = _products(queries[sel], rows)
            scored += len(sel)
            other = (own[sel, 0] != number)[:, None] | (np.arange(len(ids))[None, :] != own[sel, 1][:, None])
            i, j = np.nonzero((s >= kth[sel][:, None]) & other)
            parts.append((sel[i], ids[j], s[i, j]))
        who, what, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = np.lexsort((what, ~score, who))
        who, what, score = who[at], what[at], score[at]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        kth[who[rank == k - 1]] = np.maximum(kth[who[rank == k - 1]], score[rank == k - 1])
        who, what, score = who[rank < k], what[rank < k], score[rank < k]
    return who, what, score, scored


def _asked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["own"], "<i8").reshape(-1, 2), np.frombuffer(r["rows"], "<f8").reshape(r["n"], r["dims"])


def _met(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[dict, list[dict]]]:
    """Of rows sorted by cell and kind: the chunk of each cell and its other rows."""
    cell, chunk, others = None, None, []
    for batch in trimmed(batches):
        for some in slices(batch, column, 32_000_000):
            for r in some.to_pylist():
                if (r["chunk"], r["cell"]) != cell:
                    if chunk and others:
                        yield chunk, others
                    cell, chunk, others = (r["chunk"], r["cell"]), None, []
                if r["kind"] == 0:
                    chunk = r
                else:
                    others.append(r)
    if chunk and others:
        yield chunk, others


KTH = "array<struct<who: long, score: long>>"
PROMISING = "chunk long, block long, who binary, bound binary"


def _kth(r: dict) -> np.ndarray:
    """k-th scores so far, by query."""
    out = np.full(r["n"], LEAST)
    for x in r["kth"] or ():
        out[x["who"]] = x["score"]
    return out


def promising(queries: DataFrame, blocks: DataFrame, first: bool) -> DataFrame:
    """Stored rows (chunk, block, who, bound) of the blocks that queries of a chunk are to be scored
    in: who they are, and the bounds.  At first those of the LEAD highest bounds among the blocks that
    a task meets at once; then the others, where the bound reaches the query's k-th score."""
    spark = queries.sparkSession
    sets = max(1, -(-blocks.count() // BOUNDS))
    # every chunk for every set of bounds, in cells of bounded size
    asked = queries.withColumn("chunk", F.col("id")).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sets - 1).cast("long"))))
    sides = blocks.select(F.pmod(F.xxhash64("id"), F.lit(sets)).alias("cell"), "id", F.lit(0).alias("n"), "dims", F.col("highs").alias("ids"), F.col("lows").alias("own"))
    sides = sides.join(asked.select("chunk", "cell"), "cell").withColumns({"kind": F.lit(1), "rows": F.lit(None).cast("binary"), "kth": F.lit(None).cast(KTH)})
    rows = asked.withColumn("kind", F.lit(0)).unionByName(sides)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, others in _met(batches, "ids"):
            _, _, q = _asked(chunk)
            dims = max(q.shape[1], *(r["dims"] for r in others))
            highs, lows = (_matrix([np.frombuffer(r[c], "<f8") for r in others]) for c in ("ids", "own"))
            bound = bounds(wide(q, dims), wide(highs, dims), wide(lows, dims))
            lead = np.zeros(bound.shape, bool)
            np.put_along_axis(lead, np.argsort(-bound, axis=1, kind="stable")[:, :LEAD], True, axis=1)
            want = lead if first else ~lead & (bound >= _kth(chunk)[:, None])
            for j in np.flatnonzero(want.any(axis=0)).tolist():
                who = np.flatnonzero(want[:, j])
                yield _row(PROMISING, [chunk["chunk"], others[j]["id"], who.astype("<u2"), bound[who, j]])

    dealt = rows.repartition(partitions(spark), "chunk", "cell").sortWithinPartitions("chunk", "cell", "kind", "id")
    return stored(dealt.mapInArrow(work, PROMISING), "promising")


def scored(queries: DataFrame, blocks: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Stored rows (chunk, who, query_id, vec_id, score): the k best of each query in a cell of blocks."""
    cells = max(1, -(-blocks.count() // CELL))
    placed = pairs.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)))
    theirs = placed.join(blocks.drop("highs", "lows").withColumnRenamed("id", "block"), "block").withColumn("kind", F.lit(1)).withColumn("kth", F.lit(None).cast(KTH))
    asked = placed.select("chunk", "cell").distinct().join(queries.withColumnRenamed("id", "chunk"), "chunk").withColumn("kind", F.lit(0))
    rows = asked.unionByName(theirs, allowMissingColumns=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, others in _met(batches, "rows"):
            ids, own, q = _asked(chunk)
            dims = max(q.shape[1], *(r["dims"] for r in others))
            bound = np.full((len(q), len(others)), -np.inf)
            for j, r in enumerate(others):
                bound[np.frombuffer(r["who"], "<u2"), j] = np.frombuffer(r["bound"], "<f8")
            held = [(r["block"], np.frombuffer(r["ids"], "<i8"), wide(np.frombuffer(r["rows"], "<f8").reshape(r["n"], r["dims"]), dims)) for r in others]
            who, what, score, _ = search_blocks(own, wide(q, dims), held, bound, _kth(chunk), k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), chunk["chunk"])), pa.array(who), pa.array(ids[who]), pa.array(what), pa.array(score)], ["chunk", "who", "query_id", "vec_id", "score"])

    dealt = rows.repartition(partitions(queries.sparkSession), "chunk", "cell").sortWithinPartitions("chunk", "cell", "kind", "block")
    return stored(dealt.mapInArrow(work, "chunk long, who long, query_id long, vec_id long, score long"), "scored")


def best_of(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("chunk", "who").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 20, divisor: int = 20) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each vector whose vec_id the divisor divides, its
    k best others, ties to the smaller vec_id."""
    blocks = pack_blocks(vectors)
    queries = query_chunks(blocks, divisor)
    fresh = queries.withColumn("kth", F.lit(None).cast(KTH))
    first = scored(fresh, blocks, promising(fresh, blocks, True), k)
    # a row for each chunk, of as many numbers as it has queries
    kth = best_of(first, k).filter(F.col("rank") == k).groupBy(F.col("chunk").alias("id")).agg(F.collect_list(F.struct("who", "score")).alias("kth"))
    ready = stored(queries.join(kth, "id", "left"), "queries")
    second = scored(ready, blocks, promising(ready, blocks, False), k)
    return best_of(first.unionByName(second), k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS r, q.vec_id AS query_id, d.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.r <> d.r),
t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""
