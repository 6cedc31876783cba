"""Exact top-k search against all inner products."""

from collections import Counter

import duckdb
import numpy as np
import pytest

from loomgraph.llm import topk_search as ts


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 3, 4) for i, v in rows], "vec_id long, embedding array<double>, id string, chunk int, kth int")


def brute(rows, k, divisor):
    """Counter of (query_id, rank, vec_id, score), every row against all others."""
    kept = [(i, q) for i, v in rows if i is not None and v is not None and (q := ts.quantised(v)) is not None]
    out = Counter()
    for n, (i, q) in enumerate(kept):
        if i % divisor == 0:
            products = ((sum(int(a) * int(b) for a, b in zip(q, v)), j) for m, (j, v) in enumerate(kept) if m != n)  # noqa: B905
            scores = sorted((-max(ts.LEAST, min(ts.MOST, s)), j) for s, j in products)
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k]))
    return out


def found(spark, rows, k, divisor, parts=4):
    return Counter(tuple(r) for r in ts.top_k(vectors(spark, rows).repartition(parts), k=k, divisor=divisor).collect())


@pytest.fixture(scope="module")
def odd():
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(1300)]
    copies = [(5000 + i, rows[40][1]) for i in range(30)]
    return rows + copies + [(None, [1.0] * 6), (6000, None), (6020, [1.0, None]), (6040, [float("nan")] * 6), (6060, []), (6080, [float("inf")]), (6100, [2.0, -1.0]), (40, rows[40][1])]


def test_random_vectors_with_odd_ones_and_ties(spark, odd):
    assert found(spark, odd, 7, 20) == brute(odd, 7, 20)


def test_rows_with_one_id_are_rows_of_their_own(spark):
    rows = [(3, [1.0, 2.0]), (3, [5.0, 5.0]), (3, [5.0, 5.0]), (4, [1.0, 0.0])]
    got = found(spark, rows, 20, 3)
    assert got == brute(rows, 20, 3)
    assert sum(got.values()) == 9


def test_few_candidates_and_empty_tables(spark):
    assert found(spark, [(20, [1.0]), (3, [2.0])], 20, 20) == Counter({(20, 1, 3, 8192): 1})
    assert not found(spark, [(20, [1.0])], 20, 20)
    assert not found(spark, [(3, [1.0]), (4, [1.0])], 20, 20)
    assert not found(spark, [], 20, 20)


def test_scores_beyond_a_long_count_as_the_nearest(spark):
    rows = [(20, [1e12, 1.0]), (3, [1e12, 0.0]), (4, [-1e12, 5.0]), (5, [0.0, 7.0]), (6, [1e200, 0.0]), (7, [1e306, -1e306]), (40, [1e306, 1e306])]
    got = found(spark, rows, 20, 20)
    assert got == brute(rows, 20, 20)
    assert (20, 3, 7, ts.MOST) in got


def test_sums_that_cancel_are_not_pruned(spark):
    # beyond 2**53 the bounds in doubles round away what decides
    rows = [(20, [2.0**26, 2.0**26, 1.0])] + [(1000 + i, [2.0**26, -(2.0**26), float(i)]) for i in range(700)]
    assert found(spark, rows, 20, 20) == brute(rows, 20, 20)


def test_the_sql_agrees_on_equal_ids(spark):
    rows = [(i % 50, [float(i % 7), float(i % 11)]) for i in range(120)]
    embeddings = vectors(spark, rows).toPandas()[["vec_id", "embedding"]]  # noqa: F841
    want = duckdb.sql(ts.OP7_SQL).fetchall()
    assert Counter(tuple(r) for r in ts.top_k(vectors(spark, rows)).select("query_id", "rank", "vec_id", "score").collect()) == Counter(want)


def blocks_of(r, n, size, dims, spread):
    return [(b, np.arange(b * size, b * size + size), np.floor(r.normal(size=(size, dims)) * 8) + spread * b) for b in range(n)]


def sides(blocks):
    return (np.array([f(m, axis=0) for _, _, m in blocks]) for f in (np.max, np.min))


def test_blocks_below_the_kth_score_are_not_scored():
    r = np.random.default_rng(0)
    blocks = blocks_of(r, 10, 50, 4, 60)
    q = np.ones((3, 4)) * 2
    bound = ts.bounds(q, *sides(blocks))
    who, what, score, scored = ts.search_blocks(np.full((3, 2), -1), q, blocks, bound, np.full(3, ts.LEAST), 5)
    assert scored == 3
    assert (what >= 450).all()
    assert (score[:5] == np.sort(blocks[9][2] @ q[0])[::-1][:5]).all()


def test_a_kth_score_from_elsewhere_prunes():
    r = np.random.default_rng(0)
    blocks = blocks_of(r, 10, 50, 4, 60)
    q = np.ones((2, 4)) * 2
    bound = ts.bounds(q, *sides(blocks))
    high = np.array([10**9, ts.LEAST])
    who, _, _, scored = ts.search_blocks(np.full((2, 2), -1), q, blocks, bound, high, 5)
    assert scored == 1
    assert set(who.tolist()) == {1}


def test_bounds_hold_for_every_row():
    r = np.random.default_rng(2)
    for scale in (1.0, 2.0**30, 1e150):
        blocks = [(b, ids, m * scale) for b, ids, m in blocks_of(r, 6, 40, 5, 3)]
        q = np.floor(r.normal(size=(9, 5)) * 64) * scale
        bound = ts.bounds(q, *sides(blocks))
        for j, (_, _, m) in enumerate(blocks):
            for i in range(len(q)):
                assert all(sum(int(a) * int(b) for a, b in zip(q[i], row, strict=True)) <= bound[i, j] for row in m)


def test_the_second_pass_sends_few_blocks_where_ranges_differ(spark, monkeypatch):
    sent = []
    real = ts.promising
    monkeypatch.setattr(ts, "promising", lambda q, b, first: sent.append(real(q, b, first)) or sent[-1])
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=4) + (i // 512)]) for i in range(512 * 24)]
    ts.top_k(vectors(spark, rows), divisor=20).collect()
    queries, blocks = 615, 24
    pairs = sum(len(x["who"]) // 2 for frame in sent for x in frame.collect())
    print("pairs of query and block scored:", pairs, "of", queries * blocks)
    assert pairs < 0.5 * queries * blocks
