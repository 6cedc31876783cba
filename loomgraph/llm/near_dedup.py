"""Near-duplicates by fast similarity sketches, banding and exact verification.

Texts with equal shingle sets are one class, found by digest.  Each class has a sketch: in round
after round every shingle is hashed to a bin, and a bin keeps the least value of the first round
that reaches it; from round t on each round fills one bin with the least value of all shingles,
so that every coordinate is filled.  Classes that agree on a band of the sketch are in one bucket,
tied to the least member in their batch, and these to the bucket's least; what is tied together is a
family, and all links are inside families.  Families of few members and shingles are verified whole in one place.  In others the ties
are verified first, then blocks of members against blocks, but no two blocks of one component; a
block too has few members and shingles (one text may have more).

Bands: 25 of 5 coordinates; a pair at the threshold 0.85 is missed with probability 4e-7.

Defined results: null or empty texts have no shingles and are linked with nothing; rows with null
doc_id have a null component and are kept; rows are judged by their text, so equal rows get equal
results; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import BATCH, LOWER, UPPER, alone, mix, partitions, shingle_sets, slices, stored, table, trimmed
from loomgraph.llm.components import connected_components

BINS, ROWS, BANDS = 128, 5, 25
SALTS = 8
#: documents of a family, or of a block, that one task compares, and shingles that they have together
BLOCK, SHINGLES = 256, 500_000


def sketches(values: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Sketch of each non-empty set values[offsets[i]:offsets[i+1]]; empty sets get unfilled bins.
    A value's high bits are its round, so values of earlier rounds are smaller."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * bins, empty)
    doc, active = np.repeat(np.arange(n), sizes), sizes > 0
    for i in range(2 * bins):
        h = mix(values, 1000 + i)
        low = (h % np.uint64(bins)).astype(np.int64) if i < bins else np.full(len(h), i - bins)
        np.minimum.at(out, doc * bins + low, (np.uint64(i) << np.uint64(56)) | (h >> np.uint64(8)))
        active &= (out.reshape(n, bins) == empty).any(axis=1)
        keep = active[doc]
        if not keep.all():
            doc, values = doc[keep], values[keep]
        if not len(doc):
            break
    return out.reshape(n, bins)


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.empty((len(sketch), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(sketch), b, np.uint64)
        for j in range(rows):
            k = mix(k ^ sketch[:, b * rows + j], j)
        keys[:, b] = k
    return keys


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, digest and band keys of each row, stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in alone(batches):
            for some in slices(batch, "text", BATCH // 8):
                values, offsets = shingle_sets(some.column("text"), shingle)
                keys = band_keys(sketches(values, offsets))
                raw = memoryview(values.tobytes())
                digests = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                cols = [some.column("doc_id"), pa.array(np.diff(offsets)), pa.array(digests), pa.array([k.tobytes() for k in keys])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "digest", "bands"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(texts.mapInArrow(work, "doc_id long, n_shingles long, digest binary, bands binary"), "signatures", BATCH)


def _pairs(a: np.ndarray, b: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Pairs of different numbers, each once, and what goes with them."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = a != b
    keep[1:] &= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return [a[keep], b[keep], *(x[order][keep] for x in more)]


def ties(classes: DataFrame) -> DataFrame:
    """Stored edges (a, b), both of one bucket, that tie each bucket together.  classes: id, bands.  Each
    batch ties members to its own least one, and only these meet over all batches: a bucket
    sends a row a batch, however many members it has."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            if not batch.num_rows:
                continue
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), BANDS)
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.uint64).view(np.int64)
            order = np.lexsort((ids, keys))
            ids, keys = ids[order], keys[order]
            first = np.append(True, keys[1:] != keys[:-1])
            least = ids[first]
            a, b, key = _pairs(ids, least[np.cumsum(first) - 1], keys)
            # a bucket's row has its least member twice
            columns = np.append(keys[first], key), np.append(least, a), np.append(least, b)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "a", "b"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in trimmed(batches):
            if not batch.num_rows:
                continue
            keys, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "a", "b"))
            first = np.append(True, keys[1:] != keys[:-1])
            least = a[first]
            if keys[0] == last:
                least[0] = held
            last, held = keys[-1], least[-1]
            a, b = _pairs(a, np.where(a == b, least[np.cumsum(first) - 1], b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    n = partitions(classes.sparkSession)
    rows = classes.mapInArrow(within, "key long, a long, b long")
    return stored(rows.repartition(n, "key").sortWithinPartitions("key", "a").mapInArrow(across, "a long, b long"), "ties")


def linked_pairs(sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """Index pairs whose similarity reaches percent/100; with labels only pairs of different ones,
    with sides only pairs across.  Counts of common shingles come from a matrix product over
    the shingles that more than one set has."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    doc = np.repeat(np.arange(n), sizes)
    shingle, index, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = df[index] > 1
    doc, index = doc[common], index[common]
    used, index = np.unique(index, return_inverse=True)
    inter = np.zeros((n, n), np.int64)
    for s in range(0, len(used), 8192):
        part = (index >= s) & (index < s + 8192)
        m = np.zeros((n, min(8192, len(used) - s)), np.float32)
        m[doc[part], index[part] - s] = 1
        inter += np.rint(m @ m.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    hit = (100 * inter >= percent * union) & (inter > 0)
    if labels is not None:
        hit &= labels[:, None] != labels[None, :]
    if side is not None:
        hit &= side[:, None] != side[None, :]
    return np.argwhere(np.triu(hit, 1))


def forest(n: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root of each of n nodes, the pairs that joined two trees)."""
    root, used = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            used.append((a, b))
    return np.array([find(x) for x in range(n)]), np.array(used, np.int64).reshape(-1, 2)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, across batches of a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in trimmed(batches):
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]


def small_families(members: DataFrame, percent: int) -> DataFrame:
    """members: family, id, set.  Rows (id, label)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "family"):
            ids = t.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            sets = _sets(t)
            root, _ = forest(len(ids), linked_pairs([sets[i] for i in order], percent))
            yield pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(ids[order][root])], ["id", "label"])

    n = partitions(members.sparkSession)
    return members.repartition(n, "family").sortWithinPartitions("family").mapInArrow(work, "id long, label long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked.  sets: id, set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                inter = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * inter >= percent * (len(u) + len(v) - inter))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    return left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").mapInArrow(work, "a long, b long")


def large_families(tied: DataFrame, families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) enough to connect each component of large families.
    families: family, id; tied: a, b."""
    inside = tied.join(families.select(F.col("id").alias("a")), "a", "left_semi").distinct()
    first = stored(verified(inside, sets, percent), "links")
    labels = connected_components(first)
    rows = families.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    rows = rows.join(sets.select("id", (F.length("set") / 8).alias("shingles")), "id")
    sizes = rows.groupBy("family", "label").agg(F.count("*").alias("count"))
    # components of their own get blocks of their own; small ones share
    own = F.col("count") >= BLOCK // 8
    rows = stored(rows.join(sizes, ["family", "label"]).withColumn("pure", F.when(own, F.col("label"))), "family-rows")
    tally = rows.groupBy("family", "pure").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("shingles") / SHINGLES)).cast("int").alias("chunks"))
    blocks = tally.select("family", "pure", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "chunks")
    blocks = stored(blocks.withColumn("block", F.xxhash64("family", F.coalesce("pure", F.lit(-1)), "chunk")), "blocks")
    one, two = blocks.select("family", F.col("block").alias("p"), F.col("pure").alias("pp")), blocks.select("family", F.col("block").alias("q"), F.col("pure").alias("qq"))
    pairs = one.join(two, "family").filter((F.col("p") <= F.col("q")) & ~(F.coalesce(F.col("pp") == F.col("qq"), F.lit(False))))
    pairs = pairs.select("p", "q", F.xxhash64("p", "q").alias("pair"))
    ends = pairs.select(F.col("p").alias("block"), "pair", F.lit(0).alias("side")).unionByName(pairs.filter("p <> q").select(F.col("q").alias("block"), "pair", F.lit(1).alias("side")))
    of = tally.select(F.col("family").alias("f"), F.col("pure").alias("tp"), "chunks")
    placed = rows.join(of, (F.col("family") == F.col("f")) & F.col("pure").eqNullSafe(F.col("tp")))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks").cast("long")).cast("int"))
    placed = placed.select("id", "label", F.xxhash64("family", F.coalesce("pure", F.lit(-1)), "chunk").alias("block"))
    dealt = placed.join(ends, "block").join(sets, "id").select("pair", "side", "label", "set")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "pair"):
            label, side = (t.column(c).to_numpy() for c in ("label", "side"))
            pairs = linked_pairs(_sets(t), percent, label, side if side.any() else None)
            # what is one component already needs one link to another, not one a member
            labels, at = np.unique(label, return_inverse=True)
            _, used = forest(len(labels), np.unique(at[pairs], axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(labels[used[:, 0]], pa.int64()), pa.array(labels[used[:, 1]], pa.int64())], ["a", "b"])

    n = partitions(tied.sparkSession)
    second = dealt.repartition(n, "pair").sortWithinPartitions("pair").mapInArrow(work, "a long, b long")
    return stored(first.unionByName(second), "links")


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5) -> DataFrame:
    """docs: doc_id, text.  One row each: doc_id, n_shingles, component_id, kept."""
    signed = signatures(docs, shingle)
    spark = docs.sparkSession
    # equal sets have equal bands
    classes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    tied = ties(classes.select("id", "bands"))
    family = connected_components(tied).withColumnRenamed("label", "family")

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in alone(batches):
            for some in slices(batch, "text", BATCH // 8):
                values, offsets = shingle_sets(some.column("text"), shingle)
                raw = memoryview(values.tobytes())
                found = [bytes(raw[8 * a : 8 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(found, pa.binary())], ["id", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sets = stored(texts.join(family.select("id"), "id", "left_semi").mapInArrow(as_sets, "id long, set binary").filter("length(set) > 0").dropDuplicates(["id", "set"]), "sets", BATCH)
    sizes = family.join(sets.select("id", F.length("set").alias("bytes")), "id").groupBy("family").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sized = family.join(sizes, "family").withColumn("small", (F.col("n") <= BLOCK) & (F.col("bytes") <= 8 * SHINGLES))
    found = [small_families(sized.filter("small").join(sets, "id").select("family", "id", "set"), percent)]
    large = stored(sized.filter("NOT small").select("family", "id"), "large")
    if not large.isEmpty():
        found.append(connected_components(large_families(tied, large, sets, percent)))
    labels = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    # two texts under one doc_id can be in two places: the smaller label holds for both
    labels = labels.groupBy("id").agg(F.min("label").alias("label"))
    named = stored(classes.join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("component")), "components")
    salted = named.select(F.col("digest").alias("d"), "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    out = signed.select("doc_id", "n_shingles", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    met = out.join(salted, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    return met.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, list_slice(w, p, p + 4) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL)
      JOIN n s ON s.doc_id = x JOIN n t ON t.doc_id = y WHERE 100 * i >= 85 * (s.n + t.n - i)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
