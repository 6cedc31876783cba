"""Hierarchical Pitman-Yor language model of three words over a corpus, in Spark.

The model and its Gibbs sampler are those of `pitman_yor`: every two words that precede a word have
a restaurant, whose parent is the one of the last word alone, whose parent is that of all words.

1. A part of the documents numbers its words.  Parts send their words and counts to groups by hash;
   these add up, give every word a number (frequent words get small ones) and send numbers and
   counts back: all counts cover the whole corpus.
2. A part sends its distinct cells (u v w) with their training counts to buckets by v, so that a
   bucket has whole restaurants of (v) and (u v) at both levels.  Cells after a word with more
   than half a bucket's tokens are dealt by (v, w); the restaurants that buckets share so meet
   by sums of customers and tables.
3. Rounds: each bucket moves its customers by Gibbs, then buckets send the groups their customers
   at level 1 by word, and those of shared restaurants by context, and get the totals.  Strengths are
   drawn from what all restaurants say of them.
4. A bucket sends each part the log10 probabilities of its cells, averaged over the last rounds; the
   part adds them up by document.

Numbers go as sorted differences in byte planes.  Parts, buckets and states are files of the shared
folder, so that jobs have short lineages, and tasks that run again write the same.  The driver has
sums, strengths and the frequent words: two for each bucket at most.

Defined results: a null or empty text is one end token; a null doc_id counts as training text;
rows with equal doc_id are scored each by itself; without training tokens all words are unknown;
an empty table gives no rows; further columns are ignored.  The rows of docs must come in the same
order when read again, as those of files do."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import mix, open_fs, partitions, slices, stored, table, tokenised, trimmed, word_hashes, workspace
from loomgraph.llm.near_dedup import _groups
from loomgraph.llm.pitman_yor import Level, Restaurants, Settings, drawn_strength, seat, strength_sums

#: a hash that no word has in practice; numbers of the places before and after a document
END = np.uint64(0x454E44)
BEFORE, FIRST_WORD = 0, 1
SENT = "grp long, src long, data binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def is_held(doc_id: int | None, s: Settings) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % s.folds == s.held


# --- arrays as bytes ------------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers: of each the bytes that it needs, as planes, compressed."""
    out = []
    for x in arrays:
        x = np.ascontiguousarray(x).astype("<u8")
        width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
        data = pa.compress(planes, "zstd", asbytes=True)
        out += [len(x).to_bytes(8, "little"), bytes([width]), len(data).to_bytes(8, "little"), data]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width, size = int.from_bytes(data[at : at + 8], "little"), data[at + 8], int.from_bytes(data[at + 9 : at + 17], "little")
        planes = np.frombuffer(pa.decompress(data[at + 17 : at + 17 + size], n * width, "zstd", asbytes=True), np.uint8)
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = planes.reshape(width, n).T
        out.append(x.reshape(-1).view("<u8").astype(np.int64))
        at += 17 + size
    return out


def stepped(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences, but the numbers themselves where runs start."""
    out = np.diff(x, prepend=0)
    out[starts] = x[starts]
    return out


def summed_up(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    x = np.cumsum(steps)
    return x - np.repeat(x[starts] - steps[starts], np.diff(np.append(starts, len(x))))


def starts_of(x: np.ndarray) -> np.ndarray:
    """Places where runs of equal numbers begin."""
    return np.flatnonzero(np.diff(x, prepend=-1))


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of numbers that rise: the distinct ones, and each one's place among them."""
    starts = starts_of(x)
    return x[starts], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and each one's place among them; without a sort unless they are far apart."""
    top = int(x.max(initial=0))
    if top > 4 * len(x):
        return np.unique(x, return_inverse=True)
    there = np.zeros(top + 1, bool)
    there[x] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[x].astype(np.int64)


def width(known: np.ndarray) -> int:
    """Bits of a place among so many."""
    return max(1, (len(known) - 1).bit_length())


def save(path: str, *arrays: np.ndarray) -> None:
    """Writes a file of the shared folder, whole or not at all; a task that runs again writes the same."""
    fs, at = open_fs(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    temp = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as f:
        f.write(packed(*arrays))
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        fs.move(temp, at)
    else:
        fs.delete_file(temp)


def load(path: str) -> list[np.ndarray]:
    fs, at = open_fs(path)
    with fs.open_input_stream(at) as f:
        return unpacked(f.read())


def forget(folder: str, begins: tuple[str, ...]) -> None:
    """Deletes files of the shared folder that no later task reads, those that tasks cut short left too."""
    fs, at = open_fs(folder)
    for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        if f.base_name.startswith(begins):
            fs.delete_file(f.path)


def sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["grp", "src", "data"])


def run_again(rows: DataFrame, work: Callable[[int], list[tuple[int, int, bytes]]]) -> DataFrame:
    """rows: src.  What work gives for each, as SENT."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for src in batch.column("src").to_pylist():
                yield sent(work(src))

    return rows.mapInArrow(each, SENT)


def exchange(rows: DataFrame, total, keep, sums: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """rows: SENT.  total(grp, sources, datas) gives a reply to each source, sums and numbers for
    the driver; keep(src, replies in the order of grp) files them.  Rows of group -1 hold sums of
    their own.  Returns the sources, sums and numbers."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "grp"):
            group, sources, datas = t.column("grp")[0].as_py(), t.column("src").to_pylist(), t.column("data").to_pylist()
            if group < 0:
                yield sent([(group, -1, np.sum([np.frombuffer(d) for d in datas], axis=0).tobytes())])
                continue
            replies, added, numbers = total(group, sources, datas)
            yield sent([(group, s, r) for s, r in zip(sources, replies, strict=True)])
            yield sent([(group, -1, np.asarray(added, np.float64).tobytes() + np.asarray(numbers, np.int64).tobytes())])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "src"):
            src, datas = t.column("src")[0].as_py(), t.column("data").to_pylist()
            if src >= 0:
                keep(src, datas)
                yield sent([(0, src, b"")])
            else:
                added = np.sum([np.frombuffer(d[: 8 * sums]) for d in datas], axis=0)
                yield sent([(0, -1, added.tobytes() + b"".join(d[8 * sums :] for d in datas))])

    n = partitions(rows.sparkSession)
    replies = dealt(rows, "grp").sortWithinPartitions("grp", "src").mapInArrow(answer, SENT)
    done = stored(replies.repartition(n, "src").sortWithinPartitions("src", "grp").mapInArrow(back, SENT), "exchanged")
    said = done.filter("src = -1").first()
    data = said["data"] if said else bytes(8 * sums)
    return done.filter("src >= 0").select("src"), np.frombuffer(data[: 8 * sums]), np.frombuffer(data[8 * sums :], np.int64)


def dealt(rows: DataFrame, number: str) -> DataFrame:
    """Rows by buckets or groups, which are numbered without gaps: as many in one partition as in another."""
    n = partitions(rows.sparkSession)
    return rows.repartitionById(n, F.pmod(F.col(number), F.lit(n)).cast("int"))


def release(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver has collected what refers to them."""
    spark.sparkContext._jvm.System.gc()


# --- parts of the documents -----------------------------------------------------------------


def parts(docs: DataFrame, folder: str, s: Settings, groups: int) -> DataFrame:
    """Files of each part: its tokens as numbers of its words (by group and count), and its documents.
    Rows: the words of a part in a group, their hashes, counts and training counts."""

    def part(batch: pa.RecordBatch, src: int) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_pylist()
        _, lengths, words, index = tokenised(batch.column("text"))
        hashes = np.append(word_hashes(words), END)
        group = (mix(hashes, 3) % np.uint64(groups)).astype(np.int64)
        n = len(ids)
        counts = np.append(np.bincount(index, minlength=len(words)), n)
        order = np.lexsort((hashes, -counts, group))
        # a word's number: small for frequent ones, and telling its group
        starts = np.searchsorted(group[order], np.arange(groups))
        number = np.empty(len(order), np.int64)
        number[order] = (np.arange(len(order)) - starts[group[order]]) * groups + group[order]
        token = np.full(len(index) + n, number[-1])
        token[np.arange(len(index)) + np.repeat(np.arange(n), lengths)] = number[index]
        held = np.array([is_held(i, s) for i in ids])
        numbers = np.array([i or 0 for i in ids], np.int64)
        save(f"{folder}/part-{src}", token, starts, lengths + 1, numbers.view(np.uint64), np.array([i is None for i in ids]), held)
        taught = np.repeat(~held, lengths + 1)
        train = np.bincount(starts[token % groups] + token // groups, taught, minlength=len(order)).astype(np.int64)
        hashes, counts = hashes[order], counts[order]
        cuts = [*starts.tolist(), len(order)]
        return sent([(g, src, packed(hashes[a:b], counts[a:b], train[a:b])) for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src = TaskContext.get().partitionId() << 32
        for batch in trimmed(batches):
            size = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            pieces = -(-size // s.part_bytes)
            for some in slices(batch, "text", size // max(1, pieces) + 1):
                yield part(some, src)
                src += 1

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(work, SENT)


def numbered(rows: DataFrame, folder: str, groups: int, frequent: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Files of each part: the numbers and training counts of its words.  Returns the parts, sums
    (training tokens, known words, all tokens), and the words with more tokens than `frequent`, each as number, tokens."""

    def total(group: int, sources: list[int], datas: list[bytes]):
        hashes, counts, train = zip(*map(unpacked, datas), strict=True)
        sizes = np.cumsum([0, *map(len, hashes)])
        hashes = np.concatenate(hashes).view(np.uint64)
        counts, train = np.concatenate(counts), np.concatenate(train)
        words, at = np.unique(hashes, return_inverse=True)
        every, taught = (np.bincount(at, x, minlength=len(words)).astype(np.int64) for x in (counts, train))
        order = np.argsort(-every, kind="stable")
        number = np.empty(len(words), np.int64)
        number[order] = FIRST_WORD + group + groups * np.arange(len(words))
        often = np.flatnonzero(every > frequent)
        replies = [packed(number[at[a:b]], taught[at[a:b]]) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        return replies, [taught.sum(), (taught > 0).sum(), every.sum()], np.stack([number[often], every[often]], axis=1).reshape(-1)

    def keep(src: int, replies: list[bytes]) -> None:
        numbers, train = zip(*map(unpacked, replies), strict=True)
        save(f"{folder}/words-{src}", np.concatenate(numbers), np.concatenate(train))

    return exchange(rows, total, keep, 3)


class Part:
    """The tokens of a part, and its distinct cells (u, v, w) in the order of their buckets, by v, w, u."""

    def __init__(self, folder: str, src: int, hot: np.ndarray, buckets: int):
        token, starts, self.lengths, self.ids, self.null, held = load(f"{folder}/part-{src}")
        numbers, self.train = load(f"{folder}/words-{src}")
        token = starts[token % len(starts)] + token // len(starts)
        self.token, self.held = token, held.astype(bool)
        self.taught = np.repeat(~self.held, self.lengths)
        # words of the part in the order of their numbers
        known, at = ranked(np.append(numbers, BEFORE))
        w = at[token]
        first = np.cumsum(self.lengths) - self.lengths
        v = np.concatenate([[0], w[:-1]])
        v[first] = 0
        u = np.concatenate([[0], v[:-1]])
        u[first] = 0
        bits, more = width(known), None
        if 3 * bits < 64:
            key = (v << bits | w) << bits | u
        else:  # words of two million and more
            more, key = np.unique(v << bits | w, return_inverse=True)
            key = key << bits | u
        cells, cell = np.unique(key, return_inverse=True)
        pair, u = cells >> bits, known[cells & (1 << bits) - 1]
        if more is not None:
            pair = more[pair]
        v, w = known[pair >> bits], known[pair & (1 << bits) - 1]
        bucket = bucket_of(v, w, hot, buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        to = np.empty(len(order), np.int64)
        to[order] = np.arange(len(order))
        self.cell, self.v, self.w, self.u, bucket = to[cell], v[order], w[order], u[order], bucket[order]
        self.starts = starts_of(bucket)
        self.buckets = bucket[self.starts]

    def file(self, path: str, total: int) -> None:
        """Files the documents, with the sums that need their words, and the places of their cells."""
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        n_known = np.bincount(doc, (self.train > 0)[self.token], minlength=len(self.lengths)).astype(np.int64)
        base = np.bincount(doc, np.log10((self.train + 1) / total)[self.token], minlength=len(self.lengths))
        save(path, self.cell, self.lengths, self.ids.view(np.uint64), self.null, self.held, n_known, base.view(np.uint64))

    def runs(self, src: int) -> list[tuple[int, int, bytes]]:
        count = np.bincount(self.cell, self.taught, minlength=len(self.v)).astype(np.int64)
        ends = np.append(self.starts[1:], len(self.v))
        return [(int(b), src, coded(self.v[i:j], self.w[i:j], self.u[i:j], count[i:j])) for b, i, j in zip(self.buckets, self.starts, ends, strict=True)]


def bucket_of(v: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    key = mix(v.astype(np.uint64), 5)
    split = np.isin(v, hot)
    key[split] = mix(key[split] ^ mix(w[split].astype(np.uint64), 6), 5)
    return (key % np.uint64(buckets)).astype(np.int64)


def coded(v, w, u, count) -> bytes:
    new_v = np.diff(v, prepend=-1) != 0
    new_w = new_v | (np.diff(w, prepend=-1) != 0)
    vs, ws = np.flatnonzero(new_v), np.flatnonzero(new_w)
    first = np.searchsorted(ws, vs)
    return packed(np.diff(v[vs], prepend=0), np.diff(np.append(first, len(ws))), stepped(w[ws], first), np.diff(np.append(ws, len(v))), stepped(u, ws), count)


def decoded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    v, pairs, w, cells, u, count = unpacked(data)
    first, ws = np.cumsum(pairs) - pairs, np.cumsum(cells) - cells
    return np.repeat(np.repeat(np.cumsum(v), pairs), cells), np.repeat(summed_up(w, first), cells), summed_up(u, ws), count


# --- buckets --------------------------------------------------------------------------------


class Bucket:
    """Cells of a bucket put together, sorted by v, w, u; pairs (v, w) and contexts (u, v) found."""

    def __init__(self, runs: list[bytes]):
        v, w, u, count = zip(*map(decoded, runs), strict=True)
        self.sizes = np.array([len(x) for x in v])
        v, w, u = map(np.concatenate, (v, w, u))
        known, at = ranked(np.concatenate([v, w, u]))
        bits, (v, w, u) = width(known), at.reshape(3, len(v))
        low = (1 << bits) - 1
        if 3 * bits < 64:
            cells, self.cell = np.unique((v << bits | w) << bits | u, return_inverse=True)
            pairs, self.pair = runs_of(cells >> bits)
        else:
            pairs, pair = np.unique(v << bits | w, return_inverse=True)
            cells, self.cell = np.unique(pair << bits | u, return_inverse=True)
            self.pair = cells >> bits
        u, v, w = cells & low, pairs >> bits, pairs & low
        self.count = np.bincount(self.cell, np.concatenate(count), minlength=len(cells)).astype(np.int64)
        words, self.word = ranked(w)
        befores, self.before = runs_of(v)
        contexts, self.context = np.unique(self.before[self.pair] << bits | u, return_inverse=True)
        self.words, self.befores = known[words], known[befores]
        self.of, self.first = contexts >> bits, known[contexts & low]  # of contexts: v's place, u


def shared_keys(before: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys of contexts (u, v); of (v) with u = -1."""
    return mix(mix(before.astype(np.uint64), 11) ^ mix((first + 2).astype(np.uint64), 12), 13)


class Model:
    """Files of the buckets in the folder, by bucket: cells, state and totals of each round."""

    def __init__(self, folder: str, hot: np.ndarray, groups: int, s: Settings):
        self.folder, self.hot, self.groups, self.s = folder, hot, groups, s

    def put(self, b: int, parts: list[int], bucket: Bucket) -> None:
        """Files the cells, where the cells of the parts' runs are among them, and what goes to the groups.
        Numbers that rise within a pair, a word before or a run are filed as steps."""
        shared = np.isin(bucket.befores, self.hot)
        shared3 = np.flatnonzero(shared[bucket.of])
        shared2 = np.flatnonzero(shared)
        keys = np.concatenate([shared_keys(bucket.befores[bucket.of[shared3]], bucket.first[shared3]), shared_keys(bucket.befores[shared2], np.full(len(shared2), -1))])
        sizes = np.array([len(bucket.first), len(bucket.befores), len(bucket.words)])
        by_word = np.argsort(bucket.words % self.groups, kind="stable")
        by_key = np.lexsort((keys, keys % np.uint64(self.groups)))
        in_before = np.arange(len(bucket.of)) - np.searchsorted(bucket.of, bucket.of)  # of contexts, which are sorted by v
        context = stepped(in_before[bucket.context], starts_of(bucket.pair))
        word = stepped(bucket.word, starts_of(bucket.before))
        save(f"{self.folder}/cells-{b}", bucket.count, np.diff(bucket.pair, prepend=0), context, word, np.diff(bucket.before, prepend=0), np.bincount(bucket.of), sizes)
        save(f"{self.folder}/places-{b}", bucket.words, by_word, shared3, shared2, keys, by_key)
        runs = np.cumsum(bucket.sizes) - bucket.sizes
        save(f"{self.folder}/runs-{b}", np.array(parts), bucket.sizes, stepped(bucket.cell, runs))

    def places(self, b: int) -> dict:
        """The bucket's words, its shared contexts, and the order in which they go to the groups."""
        words, by_word, shared3, shared2, keys, by_key = load(f"{self.folder}/places-{b}")
        return {"words": words, "by_word": by_word, "shared3": shared3, "shared2": shared2, "keys": keys.view(np.uint64), "by_key": by_key}

    def get(self, b: int) -> tuple[Restaurants, dict]:
        count, pair, context, word, before, contexts, sizes = load(f"{self.folder}/cells-{b}")
        pair, before = np.cumsum(pair), np.cumsum(before)
        context = summed_up(context, starts_of(pair)) + (np.cumsum(contexts) - contexts)[before[pair]]
        own = Restaurants(count, pair, context, summed_up(word, starts_of(before)), before, tuple(sizes.tolist()))
        return own, self.places(b)

    def at(self, b: int, k: int, level: Level, got: tuple[Restaurants, dict] | None = None) -> tuple[Restaurants, dict]:
        """The bucket's restaurants as round k left them, with the totals of that meeting; got: the
        same bucket's of another round, to be set to this one."""
        r, places = got or self.get(b)
        tables, r.customers2, r.tables2 = load(f"{self.folder}/state{k}-{b}")
        r.tables[r.some] = tables
        customers, roots, shared_customers, shared_tables = load(f"{self.folder}/met{k}-{b}")
        c3, t3, c2, t2, _ = r.own()
        n = len(places["shared3"])
        for mine, theirs in ((c3, shared_customers), (t3, shared_tables)):
            mine[places["shared3"]] = theirs[:n]
        for mine, theirs in ((c2, shared_customers), (t2, shared_tables)):
            mine[places["shared2"]] = theirs[n:]
        r.met(level, k, c3, t3, c2, t2, level.root(k, customers, roots))
        return r, places

    def meet(self, b: int, k: int, r: Restaurants, places: dict, level: Level) -> list[tuple[int, int, bytes]]:
        """Files the bucket's state, gives what it sends: by group, customers of its words, customers and
        tables of its shared contexts; to group -1 the sums of its own contexts."""
        save(f"{self.folder}/state{k}-{b}", r.tables[r.some], r.customers2, r.tables2)
        c3, t3, c2, t2, c1 = r.own()
        every = np.arange(self.groups + 1)
        words, at = places["words"][places["by_word"]], c1[places["by_word"]]
        word_cut = np.searchsorted(words % self.groups, every)
        keys = places["keys"][places["by_key"]]
        customers, tables = (np.concatenate([x[places["shared3"]], y[places["shared2"]]])[places["by_key"]] for x, y in ((c3, c2), (t3, t2)))
        n = len(places["shared3"])
        kind = (places["by_key"] >= n).astype(np.int64)
        key_cut = np.searchsorted(keys % np.uint64(self.groups), every.astype(np.uint64))
        out = []
        for g in range(self.groups):
            a, z, i, j = word_cut[g], word_cut[g + 1], key_cut[g], key_cut[g + 1]
            if a == z and i == j:
                continue
            first = [np.diff(words[a:z], prepend=0), keys[i:j], kind[i:j]] if k == 0 else []
            out.append((g, b, packed(at[a:z], customers[i:j], tables[i:j], *first)))
        c3[places["shared3"]] = c2[places["shared2"]] = 0
        rng = np.random.default_rng([self.s.seed, 3, b, k])
        strengths = level.strengths[-1]
        ones = [(r.count == 1).sum(), (r.count == 2).sum(), (r.customers2 == 1).sum(), (r.customers2 == 2).sum()]
        sums = [*strength_sums(c3, t3, strengths[2], level.discounts[2], rng), *strength_sums(c2, t2, strengths[1], level.discounts[1], rng), *ones]
        out.append((-1, b, np.concatenate([np.zeros(4), sums]).tobytes()))
        return out

    def totals(self, k: int, level: Level):
        def total(group: int, sources: list[int], datas: list[bytes]):
            got = list(zip(*map(unpacked, datas), strict=True))
            words, shared = (np.cumsum([0, *map(len, got[i])]) for i in (0, 1))
            c1, customers, tables = map(np.concatenate, got[:3])
            if k == 0:
                number = np.concatenate([np.cumsum(x) for x in got[3]])
                place = np.unique(number, return_inverse=True)[1]
                _, first, key_place = np.unique(np.concatenate(got[4]), return_index=True, return_inverse=True)
                kind = np.concatenate(got[5])[first]
                save(f"{self.folder}/group-{group}", place, key_place, kind)
            else:
                place, key_place, kind = load(f"{self.folder}/group-{group}")
            rng = np.random.default_rng([self.s.seed, 4, group, k])
            c1 = np.bincount(place, c1).astype(np.int64) if len(place) else np.zeros(0, np.int64)
            customers, tables = (np.bincount(key_place, x, minlength=len(kind)).astype(np.int64) for x in (customers, tables))
            d, (s, _, _), (_, open1) = level.discounts, level.strengths[-1], level.roots[-1]
            t1 = np.minimum(c1, 1) if k == 0 else seat(c1, np.full(len(c1), (s + d[0] * open1) / (level.words + 1)), d[0], rng)
            replies = [packed(c1[place[a:z]], t1[place[a:z]], customers[key_place[i:j]], tables[key_place[i:j]]) for a, z, i, j in zip(words[:-1], words[1:], shared[:-1], shared[1:], strict=True)]
            sums = [c1.sum(), t1.sum(), (c1 == 1).sum(), (c1 == 2).sum()]
            for j in (0, 1):
                sums += strength_sums(customers[kind == j], tables[kind == j], level.strengths[-1][2 - j], d[2 - j], rng).tolist()
            return replies, [*sums, 0, 0, 0, 0], []

        def keep(b: int, replies: list[bytes]) -> None:
            places = self.places(b)
            got = [np.concatenate(x) for x in zip(*map(unpacked, replies), strict=True)]
            out = []
            for x, order in zip(got, (places["by_word"], places["by_word"], places["by_key"], places["by_key"]), strict=True):
                own = np.empty(len(order), np.int64)
                own[order] = x
                out.append(own)
            save(f"{self.folder}/met{k}-{b}", *out)

        return total, keep


def learn(cells: DataFrame, model: Model, words: int) -> tuple[DataFrame, Level]:
    """cells: SENT (bucket, part, run).  Puts the buckets together and samples in rounds; leaves each
    bucket's states and totals in the folder.  Returns the buckets."""
    s = model.s
    level = Level(words, strengths=[(1.0, 1.0, 1.0)], roots=[(0.0, 0.0)])
    rng = np.random.default_rng([s.seed, 2])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "grp"):
            b = t.column("grp")[0].as_py()
            model.put(b, t.column("src").to_pylist(), Bucket(t.column("data").to_pylist()))
            yield sent(model.meet(b, 0, *model.get(b), level))

    for k in range(s.rounds + 1):

        def again(b: int, k=k) -> list[tuple[int, int, bytes]]:
            r, places = model.at(b, k - 1, level)
            r.sample(k == 1, s.moves, np.random.default_rng([s.seed, 1, b, k]))
            return model.meet(b, k, r, places, level)

        if k == 0:
            rows = dealt(cells, "grp").sortWithinPartitions("grp", "src").mapInArrow(begin, SENT)
        else:
            rows = run_again(dealt(buckets, "src"), again)
        buckets, sums, _ = exchange(rows, *model.totals(k, level), 12)
        if k == 0:
            kept = lambda a, b: float(min(0.95, max(0.05, a / (a + 2 * b) if a + b else 0.5)))
            level.discounts = kept(*sums[2:4]), kept(*sums[10:12]), kept(*sums[8:10])
            level.strengths, level.roots = [], []
            strengths = (1.0, 1.0, 1.0)
        else:
            one = strength_sums(sums[:1], sums[1:2], level.strengths[-1][0], level.discounts[0], rng)
            strengths = drawn_strength(one, rng), drawn_strength(sums[6:8], rng), drawn_strength(sums[4:6], rng)
        if k == 0:
            forget(model.folder, ("part-", "words-"))  # the buckets have what they were for
        level.strengths.append(strengths)
        level.roots.append((float(sums[0]), float(sums[1])))
        release(cells.sparkSession)
    return buckets, level


#: of log10 probabilities that are sent: a millionth
UNIT = 2.0**-20


def values(buckets: DataFrame, model: Model, level: Level) -> DataFrame:
    """SENT (part, bucket, log10 probabilities of the part's cells in the bucket)."""
    s = model.s
    kept = range(max(0, s.rounds - s.keep + 1), s.rounds + 1)

    def work(b: int) -> list[tuple[int, int, bytes]]:
        parts, sizes, cell = load(f"{model.folder}/runs-{b}")
        cell = summed_up(cell, np.cumsum(sizes) - sizes)
        got = model.get(b)
        mean = sum(model.at(b, k, level, got)[0].probability() for k in kept) / len(kept)
        score = np.rint(-np.log10(mean) / UNIT).astype(np.int64)
        ends = np.cumsum([0, *sizes.tolist()])
        return [(p, b, packed(score[cell[a:z]])) for p, a, z in zip(parts.tolist(), ends[:-1], ends[1:], strict=True)]

    return run_again(buckets, work)


def score_documents(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """docs: doc_id, text.  Learns from the documents not held out and scores all."""
    s = s or Settings()
    spark = docs.sparkSession
    folder, n = workspace(spark, "restaurants"), partitions(spark)
    sources, sums, often = numbered(parts(docs, folder, s, n), folder, n, s.bucket_tokens // 2)
    tokens, known = int(sums[0]), int(sums[1])
    n_buckets = max(n, -(-int(sums[2]) // s.bucket_tokens))
    hot = np.sort(often.reshape(-1, 2)[:, 0])

    def runs(src: int) -> list[tuple[int, int, bytes]]:
        p = Part(folder, src, hot, n_buckets)
        p.file(f"{folder}/documents-{src}", tokens + known + 1)
        return p.runs(src)

    cells = run_again(sources.repartition(n, "src"), runs)
    model = Model(folder, hot, n_buckets, s)
    buckets, level = learn(cells, model, known)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "grp"):
            cell, lengths, ids, null, held, n_known, base = load(f"{folder}/documents-{t.column('grp')[0].as_py()}")
            score = -UNIT * np.concatenate([unpacked(d)[0] for d in t.column("data").to_pylist()])
            of_doc = np.bincount(np.repeat(np.arange(len(lengths)), lengths), score[cell], minlength=len(lengths))
            cols = [pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(lengths), pa.array(n_known), pa.array(np.full(len(lengths), tokens)), pa.array(base.view(np.float64)), pa.array(of_doc)]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in RESULT.split(", ")])

    scores = values(dealt(buckets, "src"), model, level)
    return scores.repartition(n, "grp").sortWithinPartitions("grp", "src").mapInArrow(together, RESULT)


def op5_language_model(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
