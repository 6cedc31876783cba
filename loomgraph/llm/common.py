"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java regular expression of the white space that separates words.
SPACE = "[\\x20\\x09-\\x0D]+"
#: bytes of texts that a Python task gets at a time, where the session's 64 MB are too many
BATCH = 8 << 20
#: what a Python worker keeps from task to task
KEPT: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def workspace(spark: SparkSession, name: str) -> str:
    """URI of a new folder that the driver and all executors share: below
    spark.checkpoint.dir where the cluster names it, else below the session's checkpoint folder, else
    (in a session of one machine, as in tests) below a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_by_session = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_by_session.isDefined():
            base = set_by_session.get()
        elif spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            base = "file://" + tempfile.mkdtemp(prefix="loom-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if base.startswith("/"):
        base = "file://" + base
    elif base.startswith("file:/") and not base.startswith("file:///"):
        base = "file://" + base[5:]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int | None):
    """Jobs started meanwhile send Python tasks batches of about so many bytes (a row at least), if the
    session has more; None: as the session says.  All rows go, in more batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    if size is None or 0 < most <= size:
        yield
        return
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """The rows of df, written as Parquet to a shared folder and read again: cuts lineage,
    and survives the loss of executors.  batch: as in batches_of()."""
    spark, path = df.sparkSession, workspace(df.sparkSession, name)
    with batches_of(spark, batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def ascii_lower(c: Column | str) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_array(c: Column | str) -> Column:
    """Words of a text (null: none), A-Z in lower case, JVM side."""
    text = F.btrim(ascii_lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, SPACE))


def slices(batch: pa.RecordBatch, column: str, chars: int = 4_000_000):
    """Row ranges of a batch whose texts have about so many bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser (splitmix) of unsigned integers, elementwise."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trimmed(batches):
    """The same batches; at their end the worker gives freed memory back, so that what one task
    needed doesn't stay with a worker that other tasks use."""
    yield from batches
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def alone(batches):
    """As trimmed(), for tasks that need much themselves: first the worker lets go what other operators'
    tasks keep in it."""
    if KEPT:
        KEPT.clear()
        give_back()
    yield from trimmed(batches)


def compact(texts: pa.Array) -> pa.Array:
    """The same texts (null: empty), not as a part of a larger array: some kernels misread parts."""
    return pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")


def tokenised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Words of each text, A-Z in lower case.  Returns the hash of every token, the number of
    tokens of each text, the distinct words, and each token's index among these."""
    lowered = pc.ascii_lower(compact(texts))
    lists = pc.ascii_split_whitespace(lowered)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py() and len(flat):
        parent = np.repeat(np.arange(len(lengths)), lengths)[full.to_numpy(zero_copy_only=False)]
        flat, lengths = flat.filter(full), np.bincount(parent, minlength=len(lengths)).astype(np.int64)
    coded = flat.dictionary_encode()
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return word_hashes(words)[index] if words else np.zeros(0, np.uint64), lengths, words, index


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as 64-bit hashes: (hashes, offsets), those of text i
    sorted in hashes[offsets[i]:offsets[i+1]].  A text of fewer words has them all as one
    shingle, one without words has none."""
    tokens, lengths, _, _ = tokenised(texts)
    n = len(lengths)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    counts = np.where(lengths >= k, lengths - k + 1, np.minimum(lengths, 1))
    total = int(counts.sum())
    doc = np.repeat(np.arange(n), counts)
    at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    padded = np.concatenate([tokens, np.zeros(k, np.uint64)])
    width = np.repeat(np.minimum(lengths, k), counts)
    value = mix(width.astype(np.uint64), 77)
    for j in range(k):
        value = np.where(j < width, mix(value ^ padded[at + j], j), value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(total, bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[keep], value[keep]
    return value, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int64)
