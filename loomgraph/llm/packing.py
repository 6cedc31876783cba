"""Packing of documents into sequences of a fixed capacity.

Only longer documents are cut, into pieces of the capacity.  The histogram of piece lengths, of
at most `capacity` rows, decides everything: patterns of up to three length classes that fill a
sequence are fitted to it by non-negative least squares, the repeat counts are rounded down, and
what remains is placed by best fit, on counts rather than pieces.  The plan gives each run of
equally long pieces its sequences; each piece finds its own by its rank among those of its
length, counted without gathering them.

Defined results: null or empty texts have only the end id; equal rows are packed as often as they
occur; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import slices, stored, table, trimmed
from loomgraph.llm.tokenizing import tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces_of(docs: DataFrame, name: str, end_id: int, capacity: int, keep_ids: bool = False, memo: int = 600_000, batch: int | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text), with the number of the task that made them and their rank
    among its pieces of that length.  Stored, so that ranks stay as they are."""

    chars = min(4_000_000, batch // 8) if batch else 4_000_000

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, part = tokenizer(name, memo), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in trimmed(batches):
            for some in slices(batch, "text", chars):
                rows, ids = [], []
                for d, coded in zip(some.column("doc_id").to_pylist(), coder.encode_array(some.column("text")), strict=True):
                    coded += end
                    for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                        data = coded[at : at + 4 * capacity]
                        n = len(data) // 4
                        rows.append((d, k, at // 4, n, zlib.crc32(data), part, int(seen[n])))
                        seen[n] += 1
                        if keep_ids:
                            ids.append(np.frombuffer(data, "<u4").astype(np.int64))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                names = [c.split()[0] for c in PIECES.split(", ")]
                if keep_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(texts.mapInArrow(cut, PIECES + (", ids array<long>" if keep_ids else "")), "pieces", batch)


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Active-set solution of min |ax - b| over x >= 0."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    scale = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds or 4 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= scale:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if z.min(initial=1) > 0:
                break
            bad = z <= 0
            old = x[at]
            step = float(np.min(old[bad] / np.maximum(old[bad] - z[bad], 1e-300)))
            x[at] = old + step * (z - old)
            active[at[x[at] <= scale * 1e-3]] = False
            x[~active] = 0
        x[:] = 0
        x[at] = z
    return x


def patterns_of(classes: int, used: np.ndarray) -> list[tuple[int, ...]]:
    """All ways to fill a sequence exactly with up to three length classes that occur."""
    has = set(np.flatnonzero(used).tolist())
    out: list[tuple[int, ...]] = [(classes,)] if classes in has else []
    out += [(p, classes - p) for p in range(1, classes // 2 + 1) if p in has and classes - p in has]
    out += [(p, q, classes - p - q) for p in range(1, classes // 3 + 1) if p in has for q in range(p, (classes - p) // 2 + 1) if q in has and classes - p - q in has]
    return out


class Plan:
    """Places of the pieces of each length: runs of (length, first rank, number of pieces, first
    sequence, offset).  open: groups of equal sequences by the room they have left."""

    def __init__(self, histogram: dict[int, int], capacity: int, classes: int = 256):
        self.capacity, self.unit = capacity, max(1, -(-capacity // classes))
        self.left = dict(sorted(histogram.items()))
        self.used: dict[int, int] = defaultdict(int)
        self.open: dict[int, list[tuple[int, list]]] = defaultdict(list)
        self.rooms: list[int] = []
        self._patterns()
        self._best_fit()

    def _take(self, length: int, n: int) -> int:
        first = self.used[length]
        self.used[length] += n
        self.left[length] -= n
        return first

    def _add(self, room: int, n: int, slots: list) -> None:
        if not self.open[room]:
            bisect.insort(self.rooms, room)
        self.open[room].append((n, slots))

    def _patterns(self) -> None:
        classes = self.capacity // self.unit
        counts = np.zeros(classes + 1)
        within: dict[int, list[int]] = defaultdict(list)
        for length, n in self.left.items():
            c = -(-length // self.unit)
            if c <= classes:
                counts[c] += n
                within[c].append(length)
        patterns = patterns_of(classes, counts)
        if not patterns:
            return
        a = np.zeros((classes + 1, len(patterns)))
        for j, p in enumerate(patterns):
            for c in p:
                a[c, j] += 1
        repeats = np.floor(nonnegative_least_squares(a, counts) + 1e-9).astype(np.int64)
        for j in np.argsort(-repeats):
            p, n = patterns[j], int(repeats[j])
            while n > 0:
                # the longest of one class go with the shortest of the next
                picks = [self._pick(within[c], last=k % 2 == 0) for k, c in enumerate(p)]
                if None in picks:
                    break
                n -= self._repeat(picks, n)

    def _pick(self, lengths: list[int], last: bool) -> int | None:
        while lengths and not self.left[lengths[-1 if last else 0]]:
            lengths.pop(-1 if last else 0)
        return lengths[-1 if last else 0] if lengths else None

    def _repeat(self, lengths: list[int], n: int) -> int:
        """Opens up to n sequences of these lengths, as many as there are pieces for, but one at least
        unless a length is needed more often than it occurs."""
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        n = min(n, *(self.left[x] // k for x, k in need.items()))
        if n == 0:
            return 1 << 60  # what is left of these classes goes to best fit
        slots, at = [], 0
        for x in lengths:
            slots.append((x, self._take(x, n), at))
            at += x
        self._add(self.capacity - at, n, slots)
        return n

    def _best_fit(self) -> None:
        for length in sorted(self.left, reverse=True):
            while n := self.left[length]:
                k = bisect.bisect_left(self.rooms, length)
                if k == len(self.rooms):
                    fit = min(n, self.capacity // length)
                    m = n // fit
                    slots = [(length, self._take(length, m), i * length) for i in range(fit)]
                    self._add(self.capacity - fit * length, m, slots)
                    continue
                room = self.rooms[k]
                m, slots = self.open[room].pop()
                if m > n:
                    self.open[room].append((m - n, [(x, r + n, at) for x, r, at in slots]))
                if not self.open[room]:
                    self.rooms.pop(k)
                m = min(m, n)
                self._add(room - length, m, [*slots, (length, self._take(length, m), self.capacity - room)])

    def runs(self) -> tuple[np.ndarray, int]:
        """Rows (length, first rank, first sequence, offset) in order, and the number of sequences."""
        out, total = [], 0
        for room in sorted(self.open):
            for n, slots in self.open[room]:
                out += [(x, r, total, at) for x, r, at in slots]
                total += n
        return np.array(sorted(out), np.int64).reshape(-1, 4), total


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (length, part, nth, ...)."""
    tally = stored(pieces.groupBy("part", "length").count(), "piece-counts")
    # at most `capacity` rows reach the driver
    histogram = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs, _ = Plan(histogram, capacity).runs()
    keys = (runs[:, 0] << np.int64(44)) + runs[:, 1]
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = tally.select("part", "length", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("before"))
    # rows of `before` grow with the parts: met by a shuffle, never sent to every task
    ranked = pieces.join(before.hint("merge"), ["part", "length"])
    schema = pieces.drop("part", "nth").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("nth").to_numpy(zero_copy_only=False) + batch.column("before").to_numpy(zero_copy_only=False)
            run = runs[np.searchsorted(keys, (length << np.int64(44)) + rank, "right") - 1]
            cols = [batch.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(run[:, 2] + rank - run[:, 1]), pa.array(run[:, 3])], schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, name: str, end_id: int, capacity: int = 4096, keep_ids: bool = False, memo: int = 600_000, batch: int | None = None) -> DataFrame:
    """docs: doc_id, text.  One row per piece: doc_id, piece, start, length, ids_crc32, its ids if
    asked for, sequence_id and offset.  memo: words whose ids each worker keeps; batch: bytes of texts
    that a task gets at a time (None: as the session says)."""
    return pack(pieces_of(docs, name, end_id, capacity, keep_ids, memo, batch), capacity)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 1)
