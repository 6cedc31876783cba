"""The language model against counts and a customer-by-customer sampler in one process."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.llm import language_model as lm
from loomgraph.llm import pitman_yor as py


def documents(spark, rows):
    schema = "doc_id long, text string, n_tokens string, src string, grp int, data string"
    return spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows], schema)


def is_held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def tokens(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", folded), None]


WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(f"{w}{i}" for i in range(40) for w in WORDS)
ODD = [(5, " ".join(WORDS[:60])), (1, None), (2, ""), (3, " \t\n"), (4, "Ümläut ß 日本語 a  b\n\nc A"), (6, "one"), (6, "two"), (6, "two"), (None, "one two"), (None, None), (7, LONG)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = ODD + [(20 + i, " ".join(WORDS[: 5 + i])) for i in range(30)]
    return rows, lm.score_documents(documents(spark, rows).repartition(3)).collect()


def test_counts_and_base_are_those_of_the_corpus(odd):
    rows, got = odd
    c = Counter(w for i, t in rows if not is_held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, is_held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def test_scores_are_logarithms_of_probabilities(odd):
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in odd[1])


def test_equal_texts_score_equally(odd):
    by_text = defaultdict(set)
    texts = dict(odd[0])
    for r in odd[1]:
        if r["doc_id"] in (1, 2, 3):
            assert not tokens(texts[r["doc_id"]])[:-1]
            by_text["empty"].add(round(r["score"], 9))
    assert len(by_text["empty"]) == 1


def test_empty_table(spark):
    assert lm.score_documents(documents(spark, [])).collect() == []


def test_without_training_text_all_words_are_unknown(spark):
    got = lm.score_documents(documents(spark, [(i, "a b") for i in range(60) if is_held(i)])).collect()
    assert got
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in got)


def test_numbers_survive_packing():
    r = np.random.default_rng(1)
    arrays = [r.integers(0, 2**k, n, np.uint64) for k, n in ((1, 9), (13, 1000), (40, 77), (63, 5), (8, 0))]
    got = lm.unpacked(lm.packed(*arrays))
    assert all((a.astype(np.int64) == b).all() for a, b in zip(arrays, got, strict=True))


def test_runs_of_cells_survive_coding():
    r = np.random.default_rng(2)
    cells = np.unique(r.integers(0, 9, (300, 3)), axis=0)
    got = lm.decoded(lm.coded(*cells.T, np.arange(len(cells))))
    assert (np.stack(got[:3], axis=1) == cells).all()
    assert (got[3] == np.arange(len(cells))).all()


def test_alone_is_the_share_of_lone_customers():
    r = np.random.default_rng(3)
    for c, d, a in ((5, 0.3, 2.0), (40, 0.7, 5.0), (300, 0.5, 20.0), (300, 0.8, 2.0)):
        lone, chance = 0.0, 0.0
        for _ in range(1500):
            sizes = [1]
            for i in range(1, c):
                if r.random() < (a + d * len(sizes)) / (a + i):
                    sizes.append(1)
                else:
                    weights = np.array(sizes) - d
                    sizes[int(r.choice(len(sizes), p=weights / weights.sum()))] += 1
            lone += sizes.count(1) / c
            chance += float(py.alone(np.array([c]), np.array([len(sizes)]), d)[0])
        assert abs(lone - chance) < 0.04 * lone, (c, d)


def test_seating_of_many_customers_is_unbiased():
    r = np.random.default_rng(8)
    for n, least in ((200, 4000), (1000, 4000), (10_000, 1500)):
        exact = np.ones(least)
        for i in range(1, n):
            exact += r.random(least) < 50 / (i - 0.75 * exact + 50)
        got = py.seat(np.full(4000, n), np.full(4000, 50.0), 0.75, r)
        assert abs(got.mean() / exact.mean() - 1) < 0.01, n


def restaurants(r, words=30):
    cells = np.unique(r.integers(0, words, (900, 3)) ** 2 // words, axis=0)  # v, w, u
    count = r.integers(0, 2, len(cells)) * r.geometric(0.3, len(cells))
    pairs, pair = np.unique(cells[:, 0] * words + cells[:, 1], return_inverse=True)
    context = cells[:, 0] * words + cells[:, 2]
    return py.Restaurants(count, pair, context, pairs % words, pairs // words, (words * words, words, words))


def test_moves_keep_tables_and_customers_in_step():
    r = np.random.default_rng(4)
    x = restaurants(r)
    level = py.Level(30, (0.4, 0.6, 0.7), [(1.0, 1.0, 1.0)], [(300.0, 30.0)])
    *own, c1 = x.own()
    x.met(level, 0, *own, level.root(0, c1, np.minimum(c1, 1)))
    x.seat_all(r)
    for _ in range(30):
        x.move(r)
        assert (x.tables <= x.count).all()
        assert ((x.tables > 0) == (x.count > 0)).all()
        assert (x.customers2 == np.bincount(x.pair, x.tables, minlength=len(x.word))).all()
        assert (x.tables2 <= x.customers2).all()
        assert ((x.tables2 > 0) == (x.customers2 > 0)).all()
    c3, t3, c2, t2, _ = x.own()
    assert (x.open3 == t3).all()
    assert (x.all2 == c2).all()
    assert (x.open2 == t2).all()


def test_probabilities_of_a_context_sum_to_one():
    r = np.random.default_rng(5)
    words, u = 12, 4
    v, w, first = (a.reshape(-1) for a in np.meshgrid(np.arange(3), np.arange(words), np.arange(u), indexing="ij"))
    pair = v * words + w
    x = py.Restaurants(r.poisson(0.8, len(v)), pair, v * u + first, np.tile(np.arange(words), 3), np.repeat(np.arange(3), words), (3 * u, 3, words))
    *own, c1 = x.own()
    t1 = np.minimum(c1, 1)
    level = py.Level(int((c1 > 0).sum()), (0.4, 0.6, 0.7), [(2.0, 1.0, 0.5)], [(float(c1.sum()), float(t1.sum()))])
    root = level.root(0, c1, t1)
    x.met(level, 0, *own, root)
    x.sample(True, 4, r)
    unknown = float(level.root(0, np.zeros(1), np.zeros(1))[0])
    assert np.isclose(root[c1 > 0].sum() + unknown, 1)
    missing = 1 - np.bincount(x.context, x.probability() * (c1 > 0)[w])
    at = np.arange(3 * u) // u
    low = (x.s[1] + x.d[1] * x.open2) * unknown / (x.s[1] + x.all2)
    assert np.allclose(missing, ((x.s[2] + x.d[2] * x.open3) * low[at]) / (x.s[2] + x.all3))


class Plain:
    """Restaurants as lists of table sizes; customers come and go one by one."""

    def __init__(self, discounts, words, r):
        self.d, self.words, self.r, self.s = discounts, words, r, [1.0, 1.0, 1.0]
        self.tables = [defaultdict(lambda: defaultdict(list)) for _ in range(3)]
        self.c, self.t = [Counter() for _ in range(3)], [Counter() for _ in range(3)]

    def p(self, k, u, w):
        low = 1 / (self.words + 1) if k == 0 else self.p(k - 1, u[1:], w)
        sizes = self.tables[k][u][w] if u in self.tables[k] and w in self.tables[k][u] else []
        return (sum(sizes) - self.d[k] * len(sizes) + (self.s[k] + self.d[k] * self.t[k][u]) * low) / (self.s[k] + self.c[k][u])

    def add(self, k, u, w):
        sizes, d = self.tables[k][u][w], self.d[k]
        low = 1 / (self.words + 1) if k == 0 else self.p(k - 1, u[1:], w)
        new = (self.s[k] + d * self.t[k][u]) * low
        x = self.r.random() * (sum(sizes) - d * len(sizes) + new)
        self.c[k][u] += 1
        for i, n in enumerate(sizes):
            x -= n - d
            if x < 0:
                sizes[i] += 1
                return
        sizes.append(1)
        self.t[k][u] += 1
        if k:
            self.add(k - 1, u[1:], w)

    def remove(self, k, u, w):
        sizes = self.tables[k][u][w]
        x = self.r.integers(sum(sizes))
        self.c[k][u] -= 1
        for i, n in enumerate(sizes):
            x -= n
            if x < 0:
                sizes[i] -= 1
                break
        if not sizes[i]:
            sizes.pop(i)
            self.t[k][u] -= 1
            if k:
                self.remove(k - 1, u[1:], w)

    def strengths(self):
        for k in range(3):
            y = x = 0.0
            for u, c in self.c[k].items():
                if c > 1:
                    x -= np.log(self.r.beta(self.s[k] + 1, c - 1))
                    y += sum(self.r.random() < self.s[k] / (self.s[k] + self.d[k] * i) for i in range(1, self.t[k][u]))
            self.s[k] = self.r.gamma(1 + y) / (1 + x)


def plain_scores(rows, sweeps=12, burn=6):
    sequences = [["<s>", "<s>", *t.split(), "</s>"] for _, t in rows]
    triples = [[((q[j - 2], q[j - 1]), q[j]) for j in range(2, len(q))] for q in sequences]
    taught = [x for (i, _), q in zip(rows, triples, strict=True) if not is_held(i) for x in q]
    cells = Counter(taught)
    two = Counter((u[1], w) for u, w in cells)
    one = Counter(w for _, w in two)
    ratio = lambda c: min(0.95, max(0.05, c[1] / (c[1] + 2 * c[2]) if c[1] + c[2] else 0.5))
    model = Plain([ratio(Counter(x.values())) for x in (one, two, cells)], len(one), np.random.default_rng(5))
    for u, w in taught:
        model.add(2, u, w)
    out = np.zeros(len(rows))
    for k in range(sweeps):
        for u, w in taught:
            model.remove(2, u, w)
            model.add(2, u, w)
        model.strengths()
        if k >= burn:
            out += [sum(np.log10(model.p(2, u, w)) for u, w in q) / (sweeps - burn) for q in triples]
    return out


@pytest.fixture(scope="module")
def chained():
    """Pairs of words, of which the first and the one before it tell the next; "the" is frequent."""
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"a{k} b{k % 7} the" for k in r.integers(0, 400, 12))) for i in range(250)]
    return rows, plain_scores(rows)


@pytest.mark.parametrize("bucket_tokens", [1_500_000, 900])
def test_scores_are_those_of_the_plain_sampler(spark, chained, bucket_tokens):
    rows, want = chained
    s = py.Settings(bucket_tokens=bucket_tokens)
    got = {x["doc_id"]: x["score"] for x in lm.score_documents(documents(spark, rows).repartition(3), s).collect()}
    held = [i for i, _ in rows if is_held(i)]
    a, b = sum(got[i] for i in held), sum(want[i] for i in held)
    print("held-out log10 probability", a, "plain sampler", b)
    assert len(held) > 20
    assert abs(a - b) < 0.01 * abs(b)
    a, b = sum(got.values()), want.sum()
    print("all", a, "plain sampler", b)
    assert abs(a - b) < 0.01 * abs(b)
    assert max(abs(got[i] - want[i]) / abs(want[i]) for i, _ in rows) < 0.05


def kneser_ney(rows):
    """log10 probability a token of held-out rows by interpolated Kneser-Ney of two words."""
    cells, totals, kinds, below = Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        if not is_held(i):
            q = ["<s>", *tokens(t)]
            cells.update(zip(q[:-1], q[1:], strict=True))
    for (u, w), n in cells.items():
        totals[u] += n
        kinds[u] += 1
        below[w] += 1
    some = Counter(cells.values())
    d = some[1] / (some[1] + 2 * some[2])
    some = Counter(below.values())
    e, n = some[1] / (some[1] + 2 * some[2]), sum(below.values())
    total = count = 0
    for i, t in rows:
        if is_held(i):
            q = ["<s>", *tokens(t)]
            for u, w in zip(q[:-1], q[1:], strict=True):
                low = max(below[w] - e, 0) / n + e * len(below) / n / (len(below) + 1)
                p = (max(cells[u, w] - d, 0) + d * kinds[u] * low) / totals[u] if totals[u] else low
                total, count = total + np.log10(p), count + 1
    return total / count


def test_held_out_text_is_likelier_than_by_kneser_ney(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [r for r in lm.score_documents(docs).collect() if r["held_out"]]
    mine, theirs = sum(r["score"] for r in got) / sum(r["n_tokens"] for r in got), kneser_ney(rows)
    print("held-out log10 a token", mine, "Kneser-Ney of two words", theirs)
    assert mine > theirs
