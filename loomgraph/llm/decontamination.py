"""Benchmark decontamination: containment of short test items in long documents.

Items are partitioned by their number of shingles, into ranges from a power of two to the next.  A
range's upper end u sets the size of the sketches in it (an item's least shingle hashes, MOST at
most: containment MinHash, the sketch of the small set is looked up in the large one, which needs
none) and how many sketch values a candidate has at least.  A document at the threshold t misses
u - ceil(t u) of an item's shingles at most; where a sketch of MOST can be larger than that, no
candidate is lost; in the ranges above, the number asked for is one that a document at the
threshold falls short of with a probability below LOST.  Candidates are then verified by exact
containment of the shingles' words.

All work is DataFrame expressions.  Sketches and candidates are stored, so that the planner sees
their true sizes and broadcasts them only below its threshold; else it joins by sorted shuffle,
over salted keys: a passage may be in most documents.

Defined results: items of fewer than five words are sought as one shingle of all their words;
items or texts without words match nothing; rows with null ids take no part; rows of equal doc_id
are one document, rows of equal item_id one item; empty tables give no rows; further columns are
ignored."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import LOWER, UPPER, stored, table, word_array

SHINGLE = 5
PERCENT = 80
MOST, LOST = 64, 1e-12
SALTS = 16


def shingles(words: DataFrame, key: str, k: int, text: bool) -> DataFrame:
    """words: key, words.  Rows (key, h[, s]): hash, and words if asked for, of each place's shingle."""
    at = [F.get("words", F.col("pos") + i) for i in range(k)]
    rows = words.select(key, "words", F.posexplode("words").alias("pos", "w")).filter(F.col("pos") <= F.size("words") - k)
    out = rows.select(key, F.xxhash64(F.lit(k), *at).alias("h"), *([F.concat_ws(" ", *at).alias("s")] if text else []))
    return out


def item_shingles(items: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Distinct shingles of each item, stored: item_id, k, h, s, q."""
    words = items.filter("item_id IS NOT NULL").select("item_id", word_array(F.col("text").cast("string")).alias("words"))
    parts = []
    for k in range(1, size + 1):
        some = words.filter(F.size("words") >= k if k == size else F.size("words") == k)
        parts.append(shingles(some, "item_id", k, True).withColumn("k", F.lit(k)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.distinct()
    return stored(rows.join(rows.groupBy("item_id").agg(F.count("*").alias("q")), "item_id").select("item_id", "k", "h", "s", "q"), "item-shingles")


def range_bounds(percent: int = PERCENT, ranges: int = 40) -> list[tuple[int, int, int]]:
    """Of items with 2**j to u = 2**(j+1) - 1 shingles: u, the size of their sketches, and how many
    of the values may be absent from a candidate."""
    out = []
    for j in range(ranges):
        u = 2 ** (j + 1) - 1
        spare = u * (100 - percent) // 100
        size = min(MOST, 2 * spare + 1)
        if size <= spare:
            # of MOST values drawn from the item, each is absent with a chance of 1 - t at most
            tail, spare, t = 0.0, size, percent / 100
            while spare > 0 and tail + (p := math.comb(size, spare) * (1 - t) ** spare * t ** (size - spare)) <= LOST:
                tail, spare = tail + p, spare - 1
        out.append((u, size, spare))
    return out


def sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """items: item_id, k, h, q.  Stored rows (h, item_id, least): a sketch value and how many
    values of its item's sketch a candidate has at least."""
    bounds = range_bounds(percent)
    most, spare = F.lit(bounds[-1][1]), F.lit(bounds[-1][2])
    for u, size, absent in reversed(bounds[:-1]):
        most, spare = F.when(F.col("q") <= u, size).otherwise(most), F.when(F.col("q") <= u, absent).otherwise(spare)
    order = Window.partitionBy("item_id").orderBy(F.xxhash64("h", F.lit(7)), "h")
    ranked = items.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    least = F.greatest(F.lit(1), F.least(F.col("q"), most) - spare)
    return stored(ranked.select("h", "item_id", least.cast("long").alias("least")), "sketches")


def salted(rows: DataFrame) -> DataFrame:
    """A small side, once for each salt."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def salt(key: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(3)), F.lit(SALTS)).cast("int")


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """docs: doc_id, text; items: item_id, text.  Rows (doc_id, item_id, n_item, n_shared,
    containment) of the pairs whose share of the item's distinct shingles reaches percent/100."""
    wanted = item_shingles(items, size)
    lengths = sorted(r[0] for r in wanted.select("k").distinct().collect())  # `size` values at most
    sketch = sketches(wanted, percent)
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))
    words = texts.select("doc_id", word_array("text").alias("words"))

    def of(some: DataFrame, text: bool) -> DataFrame | None:
        parts = [shingles(some, "doc_id", k, text) for k in lengths]
        out = parts[0] if parts else shingles(some, "doc_id", size, text).limit(0)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    hits = of(words, False).withColumn("salt", salt("doc_id")).join(salted(sketch), ["h", "salt"]).drop("salt").distinct()
    found = hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.first("least").alias("least"))
    candidates = stored(found.filter("n >= least").select("doc_id", "item_id"), "candidates")
    near = texts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", word_array("text").alias("words"))
    shared = of(near, True).withColumn("salt", salt("doc_id")).join(salted(wanted.select("h", "s", "item_id", "q")), ["h", "s", "salt"]).drop("salt").distinct()
    exact = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.first("q").alias("n_item"))
    exact = exact.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent).join(candidates, ["doc_id", "item_id"], "left_semi")
    return exact.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP4_SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
ik AS (SELECT item_id, w, least({SHINGLE}, len(w)) AS k FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, list_slice(w, p, p + k - 1) AS g
       FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM ik)),
iq AS (SELECT item_id, count(*) AS n_item FROM ig GROUP BY item_id),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
ks AS (SELECT DISTINCT k FROM ik),
dg AS (SELECT DISTINCT doc_id, list_slice(w, p, p + k - 1) AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN ig USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM s JOIN iq USING (item_id) WHERE n_shared * 100 >= n_item * {PERCENT}
"""
