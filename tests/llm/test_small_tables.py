"""Odd tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, near_dedup, packing, token_files, warc
from loomgraph.llm.common import workspace
from loomgraph.llm.tokenizing import MemoTokenizer

WORDS = [f"w{i}" for i in range(400)]
TEXT = " ".join(WORDS[:60])
LONG = " ".join(f"{w}{i}" for i in range(40) for w in WORDS)


def documents(spark, rows):
    """With columns whose names operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, start int, n_tokens string, id string, a int, label string"
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x", "y", 2, "z") for i, t in rows], schema)


ROWS = [(5, TEXT), (1, None), (2, ""), (3, " \t\n"), (4, "Ümläut ß 日本語 <|endoftext|> a  b\n\nc"), (6, TEXT), (6, TEXT), (None, TEXT), (None, None), (7, LONG), (8, TEXT + " x"), (9, "one two")]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def ids_of(tokenizer, text, end):
    return tokenizer.tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_tokenizer_is_exact(name):
    t = MemoTokenizer(name, limit=50)
    texts = ["", None, "a  b ", "\n\na\n b", "x<|endoftext|> y", "\x1c a", "a b c", "é é ́x it's I'LL", "foo\x01bar", " \n", "日本 語　x", "a\x85b", LONG[:3000], "word, word. word", "<|x|>"]
    want = [np.array(t.tokenizer.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    for _ in range(3):
        assert t.encode(texts) == want and t.encode_array(pa.array(texts)) == want and t.encode_array(pa.array(["z", *texts]).slice(1)) == want


@pytest.mark.parametrize("n", [1, 2, 63, 64, 5000])
def test_rans_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 50_000, n), np.full(n, 7), np.minimum(r.geometric(0.01, n), 65_000)):
        symbols, freq, bits = token_files.frequencies(ids)
        start = (np.cumsum(freq) - freq).astype(np.uint64)
        data = token_files.encode_block(np.searchsorted(symbols, ids), freq.astype(np.uint64), start, bits)
        slot = np.repeat(np.arange(len(symbols)), freq)
        bias = np.arange(1 << bits, dtype=np.uint64) - start[slot]
        assert (token_files.decode_block(data, n, freq[slot].astype(np.uint64), bias, symbols[slot], bits) == ids).all()


def test_token_files(spark, docs, none):
    folder = workspace(spark, "t")
    manifest = token_files.write_token_files(docs, folder, "byte_bpe_50k.json", 2, segment_tokens=500)
    got = token_files.read_documents(manifest, with_ids=True).orderBy("start").collect()
    t, at = MemoTokenizer("byte_bpe_50k.json"), 0
    assert [r["doc_id"] for r in got] == [None, None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    text = dict(ROWS)
    for r in got:
        if r["doc_id"] is not None:
            assert r["ids"] == ids_of(t, text[r["doc_id"]], 2)
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    row = manifest.orderBy(F.desc("segments")).first()
    fs, path = token_files.open_fs(row["path"])
    with fs.open_input_file(path) as f:
        entries = token_files.read_footer(f, row["bytes"])
        whole = token_files.read_segment(f, entries[-1])[2]
        first = entries[-1]["first"]
        assert (token_files.read_tokens(f, entries[-1], first + 1, first + 3) == whole[1:3]).all()
    damaged = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(damaged[:40] + bytes([damaged[40] ^ 1]) + damaged[41:])
    with pytest.raises(Exception, match="checksum"):
        token_files.read_documents(manifest).collect()
    assert token_files.read_documents(token_files.write_token_files(none, folder, "byte_bpe_50k.json", 2)).collect() == []


def test_packing(docs, none):
    got = packing.pack_documents(docs, "word_bpe_49k.json", 1, capacity=64, keep_ids=True).collect()
    t, text = MemoTokenizer("word_bpe_49k.json"), dict(ROWS)
    for i in (4, 7, 9):
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert sum([r["ids"] for r in mine], []) == ids_of(t, text[i], 1) and all(r["length"] == 64 for r in mine[:-1]) and [r["start"] for r in mine] == [64 * k for k in range(len(mine))]
    places = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == places[r["sequence_id"]]
        places[r["sequence_id"]] += r["length"]
    assert max(places.values()) <= 64 and len(places) <= -(-sum(r["length"] for r in got) // 64) + 1
    assert packing.pack_documents(none, "word_bpe_49k.json", 1).collect() == []


def test_plans_place_every_piece():
    r = np.random.default_rng(3)
    for n, top in ((1, 5), (50, 100), (4000, 100), (4000, 30)):
        hist = Counter(np.minimum(1 + r.geometric(3 / top, n), top).tolist())
        runs, sequences = packing.Plan(dict(hist), 100).runs()
        filled = Counter()
        for length in hist:
            mine = [x for x in runs.tolist() if x[0] == length]
            firsts = [x[1] for x in mine] + [hist[length]]
            assert firsts[0] == 0
            for (_, first, seq, at), after in zip(mine, firsts[1:], strict=True):
                for k in range(after - first):
                    filled[seq + k] += length
        assert sum(filled.values()) == sum(k * v for k, v in hist.items()) and max(filled.values()) <= 100 and len(filled) == sequences
        assert sequences <= 1.03 * sum(k * v for k, v in hist.items()) / 100 + 2


def test_nnls():
    r = np.random.default_rng(0)
    a, x = r.random((20, 8)), np.maximum(0, r.normal(size=8))
    assert np.allclose(packing.nonnegative_least_squares(a, a @ x), x, atol=1e-6)
    assert (packing.nonnegative_least_squares(a, -np.ones(20)) == 0).all()


def brute_components(rows):
    sets = {}
    for i, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [i for i in sets if rows[i][0] is not None]
    for a in known:
        for b in known:
            inter = len(sets[a] & sets[b])
            if a < b and inter and (100 * inter >= 85 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i in known:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return Counter((rows[i][0], len(sets[i]), least[find(i)] if rows[i][0] is not None else None) for i in sets)


def near_rows():
    r = np.random.default_rng(8)
    rows = list(ROWS)
    for family in range(6):
        base = [f"f{family}x{i}" for i in range(120)]
        for k in range(12):
            w = list(base)
            for p in r.integers(0, 120, r.integers(0, 4)):
                w[p] = f"e{r.integers(0, 10**6)}"
            rows.append((100 + 20 * family + k, ("  " if k % 3 else "\n").join(w).upper() if k % 2 else " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [1024, 6])
def test_near_duplicates(spark, none, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_rows()
    got = near_dedup.near_duplicates(documents(spark, rows).repartition(4)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    if block == 6:
        assert near_dedup.near_duplicates(none).collect() == []


def test_sketches_fill_and_estimate():
    r = np.random.default_rng(2)
    common, extra = r.integers(0, 2**63, 300).astype(np.uint64), r.integers(0, 2**63, (2, 30)).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, extra[0]])), np.unique(np.concatenate([common, extra[1]])), common[:1], common[:0]]
    s = near_dedup.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (s[:3] != full).all() and (s[3] == full).all() and abs((s[0] == s[1]).mean() - 300 / 360) < 0.12


ITEMS = [(1, " ".join(WORDS[:20])), (2, "ONE two"), (3, None), (4, ""), (5, " ".join(WORDS[:10] + ["q"] * 1 + WORDS[10:30])), (None, TEXT), (6, "zz " * 9), (1, " ".join(WORDS[:20]))]


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in decontamination.contained_items(docs, items).collect()}
    want = {}
    text = dict(ROWS)
    for i, t in text.items():
        for j, u in dict(ITEMS).items():
            if i is None or j is None or not (u or "").split():
                continue
            a, b = (u.lower()).split(), (t or "").lower().split()
            k = min(5, len(a))
            s, d = {tuple(a[p : p + k]) for p in range(len(a) - k + 1)}, {tuple(b[p : p + k]) for p in range(len(b) - k + 1)}
            if 100 * len(s & d) >= 80 * len(s):
                want[i, j] = (len(s), len(s & d))
    assert got == want and (9, 2) in got and (5, 1) in got
    assert decontamination.contained_items(none, items).collect() == [] and decontamination.contained_items(docs, items.limit(0)).collect() == []


def test_warc(spark):
    long = "é" * 600
    rows = [(1, "http://a/ b\n", long), (3, None, long), (2, "u", long), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", long), (8, "u", "x\x1f\x8b\x08" * 900), (9, "u", LONG)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    files = warc.write_warc(warc.plan_records(pages), workspace(spark, "w"))
    for split in (100, 3000, 1 << 23):
        got = {r["page_id"]: r for r in warc.read_warc(files, split).collect()}
        assert len(got) == len(rows)
        for i, _, h in rows:
            data = (h or "").encode()
            r = got[i]
            assert r["payload_bytes"] == len(data) and r["refers_to"] == (3 if i in (1, 2) else None) and r["record_type"] == ("revisit" if i in (1, 2) else "response")
            assert bytes(r["payload"]) == (b"" if i in (1, 2) else data)
    assert warc.read_warc(warc.write_warc(warc.plan_records(pages.limit(0)), workspace(spark, "w"))).collect() == []


def test_an_archive_within_an_archive_stays_hidden():
    inner = warc.member(1, "u", b"x" * 50, "00" * 20, None, "2000-01-01T00:00:00Z")
    outer = warc.member(2, "u", inner * 3, "00" * 20, None, "2000-01-01T00:00:00Z")
    assert not any(warc.header_at(outer, k) for k in range(1, len(outer)) if outer[k : k + 3] == warc.GZIP)


def test_an_archive_shows_neither_stored_nor_fixed():
    inner = b"".join(warc.member(k, "u", bytes([k]) * 50, "00" * 20, None, "2000-01-01T00:00:00Z") for k in range(40))
    for make in (warc._deflated, warc._fixed, warc._split):
        assert zlib.decompressobj(31).decompress(make(inner)) == inner
    out = warc._split(inner)
    assert not any(warc.header_at(out, k) for k in range(1, len(out)) if out[k : k + 3] == warc.GZIP)


def test_a_record_that_cannot_be_hidden_is_an_error(monkeypatch):
    monkeypatch.setattr(warc, "header_at", lambda *_: {"warc-type": "response"})
    monkeypatch.setattr(warc, "_magics", lambda *_: [1])
    with pytest.raises(ValueError):
        warc.member(1, "u", b"x", "00" * 20, None, "2000-01-01T00:00:00Z")


def test_ranges_of_items_lose_no_candidate():
    bounds = decontamination.range_bounds()
    r = np.random.default_rng(1)
    for u, size, absent in bounds[:14]:
        assert size <= decontamination.MOST
        for q in {(u + 1) // 2, u}:
            missing = q * 20 // 100
            k = min(q, size)
            worst = max(int((r.permutation(q)[:k] < missing).sum()) for _ in range(300))
            assert k - worst >= max(1, k - absent)
            if 2 * missing + 1 <= size:
                assert missing <= absent


def test_long_items_are_found_by_bounded_sketches(spark):
    r = np.random.default_rng(2)
    words = [f"x{k}" for k in range(3000)]
    items = [(1, " ".join(words[:600])), (2, " ".join(words[600:2600])), (3, " ".join(words[2600:2640]))]
    part = lambda a, b: " ".join(words[a:b])
    noise = lambda: " ".join(f"y{k}" for k in r.integers(0, 10**6, 500))
    docs = [(1, f"{noise()} {part(0, 500)} {noise()}"), (2, f"{part(0, 400)} {noise()}"), (3, part(500, 3000)), (4, part(2600, 2640)), (5, noise())]
    got = decontamination.contained_items(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(1, 1), (3, 2), (3, 3), (4, 3)}


def test_families_of_long_texts_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHINGLES", 100)
    rows = near_rows()
    got = near_dedup.near_duplicates(documents(spark, rows).repartition(4)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Nothing:
        isDefined = staticmethod(lambda: False)
        getCheckpointDir = staticmethod(lambda: Nothing)
        sc = staticmethod(lambda: Nothing)

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"_jsc": Nothing, "master": "local-cluster[2,1,1024]"})()

    with pytest.raises(ValueError):
        workspace(Session(), "x")
