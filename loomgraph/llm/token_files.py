"""Token-id files coded by a static range asymmetric numeral system.

A file holds segments of whole documents.  A segment has one frequency table, shared by its
blocks; each block is coded alone, its symbols dealt in turn to interleaved coder lanes, so that
vector operations advance all lanes at once.  The footer's index names, for every block, its
place, first token (a checkpoint at which decoding may enter) and checksum.

Defined results: a null or empty text has only the end id; documents with null doc_id come
first; rows with equal doc_id are kept, next to each other in any order; an empty table gives no
file and no rows; further columns are ignored."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import open_fs, partitions, slices, stored, table, trimmed, workspace
from loomgraph.llm.tokenizing import tokenizer

MAGIC = b"LOOMRANS1\n"
LOW = np.uint64(1 << 31)
WORD = np.uint64(0xFFFFFFFF)
SHIFT = np.uint64(32)
LANES = 1024
BLOCK = 262_144


def lanes_of(n: int) -> int:
    return max(1, min(LANES, n // 64))


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, frequency of each, bits): every symbol gets one of the 2**bits slots, the rest
    are shared in proportion to the counts."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    bits = max(18, int(len(symbols)).bit_length() + 2)
    spare = (1 << bits) - len(symbols)
    freq = 1 + counts.astype(np.int64) * spare // max(1, int(counts.sum()))
    freq[np.argmax(counts)] += (1 << bits) - int(freq.sum())
    return symbols, freq, bits


def encode_block(index: np.ndarray, freq: np.ndarray, start: np.ndarray, bits: int) -> bytes:
    n, k, b = len(index), lanes_of(len(index)), np.uint64(bits)
    f, c = freq[index], start[index]
    limit = f << np.uint64(63 - bits)
    x, out = np.full(k, LOW, np.uint64), []
    for s in range((n - 1) // k * k, -1, -k):
        fs = f[s : s + k]
        y = x[: len(fs)]
        over = y >= limit[s : s + k]
        out.append((y[over] & WORD).astype("<u4"))
        y = np.where(over, y >> SHIFT, y)
        q = y // fs
        x[: len(fs)] = (q << b) + (y - q * fs) + c[s : s + k]
    return x.astype("<u8").tobytes() + np.concatenate(out[::-1]).tobytes()


def decode_block(data: bytes, n: int, width: np.ndarray, bias: np.ndarray, symbol: np.ndarray, bits: int) -> np.ndarray:
    """width, bias, symbol: frequency, place within its symbol's slots, and symbol of each slot."""
    k, b, mask = lanes_of(n), np.uint64(bits), np.uint64((1 << bits) - 1)
    x = np.frombuffer(data, "<u8", k).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * k).astype(np.uint64)
    out, p = np.empty(n, np.uint32), 0
    for s in range(0, n, k):
        y = x[: min(k, n - s)]
        slot = (y & mask).astype(np.int64)
        out[s : s + len(y)] = symbol[slot]
        y = width[slot] * (y >> b) + bias[slot]
        low = np.flatnonzero(y < LOW)
        y[low] = (y[low] << SHIFT) | words[p : p + len(low)]
        p += len(low)
        x[: len(y)] = y
    if p != len(words):
        raise ValueError("a block does not end where its index says")
    return out


def _packed(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.diff(a, prepend=0).astype("<i8").tobytes() for a in arrays), 1)


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    flat = np.frombuffer(zlib.decompress(data), "<i8")
    return [np.cumsum(flat[i : i + n]) for i in range(0, len(flat), n)]


class FileWriter:
    """Appends segments to an open binary file."""

    def __init__(self, out):
        self.out, self.at, self.segments, self.first = out, 0, [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> list[int]:
        self.out.write(data)
        self.at += len(data)
        return [self.at - len(data), len(data), zlib.crc32(data)]

    def segment(self, doc_ids: list, parts: list[bytes]) -> None:
        ids = np.frombuffer(b"".join(parts), "<u4")
        symbols, freq, bits = frequencies(ids)
        number = np.zeros(int(symbols[-1]) + 1, np.int64)
        number[symbols] = np.arange(len(symbols))
        index = number[ids]
        start = (np.cumsum(freq) - freq).astype(np.uint64)
        lengths = np.array([len(p) // 4 for p in parts], np.int64)
        known = np.array([d is not None for d in doc_ids], np.int64)
        docs = _packed(np.array([d or 0 for d in doc_ids], np.int64), known, lengths)
        entry = {"first": self.first, "tokens": len(ids), "docs": len(parts), "bits": bits, "symbols": len(symbols)}
        entry |= {"table": self._put(_packed(symbols.astype(np.int64), freq)), "index": self._put(docs), "blocks": []}
        f = freq.astype(np.uint64)
        for s in range(0, len(ids), BLOCK):
            part = index[s : s + BLOCK]
            entry["blocks"].append([*self._put(encode_block(part, f, start, bits)), self.first + s, len(part)])
        self.segments.append(entry)
        self.first += len(ids)

    def close(self) -> None:
        footer = zlib.compress(json.dumps(self.segments).encode())
        self._put(footer)
        self._put(len(footer).to_bytes(8, "little") + MAGIC)


def read_footer(f, size: int) -> list[dict]:
    f.seek(size - 8 - len(MAGIC))
    tail = f.read(8 + len(MAGIC))
    if tail[8:] != MAGIC:
        raise ValueError("not a token file, or cut short")
    n = int.from_bytes(tail[:8], "little")
    f.seek(size - 8 - len(MAGIC) - n)
    return json.loads(zlib.decompress(f.read(n)))


def _checked(f, place: list[int]) -> bytes:
    f.seek(place[0])
    data = f.read(place[1])
    if len(data) != place[1] or zlib.crc32(data) != place[2]:
        raise ValueError("checksum of a token file does not match")
    return data


def _slots(f, entry: dict):
    symbols, freq = _unpacked(_checked(f, entry["table"]), entry["symbols"])
    start = np.cumsum(freq) - freq
    slot = np.repeat(np.arange(len(symbols)), freq)
    bias = np.arange(1 << entry["bits"], dtype=np.uint64) - start[slot].astype(np.uint64)
    return freq[slot].astype(np.uint64), bias, symbols[slot].astype(np.uint32)


def read_segment(f, entry: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, number of ids of each, all ids) of one segment of an open file."""
    ids, known, lengths = _unpacked(_checked(f, entry["index"]), entry["docs"])
    slots = _slots(f, entry)
    tokens = [decode_block(_checked(f, b[:3]), b[4], *slots, entry["bits"]) for b in entry["blocks"]]
    return [int(d) if k else None for d, k in zip(ids, known, strict=True)], lengths, np.concatenate(tokens)


def read_tokens(f, entry: dict, begin: int, end: int) -> np.ndarray:
    """Ids begin to end (file-wide) of a segment, decoding only the blocks that hold them."""
    slots = _slots(f, entry)
    hit = [b for b in entry["blocks"] if b[3] < end and b[3] + b[4] > begin]
    got = np.concatenate([decode_block(_checked(f, b[:3]), b[4], *slots, entry["bits"]) for b in hit] or [np.zeros(0, np.uint32)])
    first = hit[0][3] if hit else begin
    return got[max(0, begin - first) : end - first]


MANIFEST = "part int, path string, bytes long, n_docs long, n_tokens long, segments int"


def write_token_files(docs: DataFrame, folder: str, name: str, end_id: int, segment_tokens: int = 2_000_000) -> DataFrame:
    """Writes docs (doc_id, text) to files in ascending doc_id order and returns the manifest,
    itself stored.  A task that runs again writes another file; only files in the manifest count."""
    spark = docs.sparkSession
    n = partitions(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, part = tokenizer(name), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        path = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.rans"
        out = writer = None
        ids, parts, held, n_docs = [], [], 0, 0
        for batch in trimmed(batches):
            for piece in slices(batch, "text", 18_000_000):
                for d, coded in zip(piece.column("doc_id").to_pylist(), coder.encode_array(piece.column("text")), strict=True):
                    ids.append(d)
                    parts.append(coded + end)
                    held += len(coded) // 4 + 1
                    n_docs += 1
                    if held >= segment_tokens:
                        if writer is None:
                            fs, at = open_fs(path)
                            fs.create_dir(at.rpartition("/")[0], recursive=True)
                            out = fs.open_output_stream(at)
                            writer = FileWriter(out)
                        writer.segment(ids, parts)
                        ids, parts, held = [], [], 0
        if parts and writer is None:
            fs, at = open_fs(path)
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            out = fs.open_output_stream(at)
            writer = FileWriter(out)
        if parts:
            writer.segment(ids, parts)
        if writer:
            writer.close()
            out.close()
            row = [[part], [path], [writer.at], [n_docs], [writer.first], [len(writer.segments)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["part", "path", "bytes", "n_docs", "n_tokens", "segments"])

    # text is read once to sample the ranges' limits from doc_id alone, and once to be dealt
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return stored(ordered.mapInArrow(write, MANIFEST), "token-manifest")


DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_documents(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files of a manifest, decoded in parallel by segment: start is the number
    of ids before the document's own in all files."""
    spark = manifest.sparkSession
    # one row per file, so the running sum over them is small
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    work = manifest.withColumn("before", before).select("path", "bytes", "before", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment"))
    schema = DOCUMENT + (", ids array<long>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for row in batch.to_pylist():
                fs, at = open_fs(row["path"])
                with fs.open_input_file(at) as f:
                    entry = read_footer(f, row["bytes"])[row["segment"]]
                    doc_ids, lengths, ids = read_segment(f, entry)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), lengths.tolist(), strict=True)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(row["before"] + entry["first"] + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return work.repartition(partitions(spark), "path", "segment").mapInArrow(read, schema)


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "tokens")
    return read_documents(write_token_files(table(spark, sf_dir, "documents"), folder, "byte_bpe_50k.json", 2))
