"""Ties of buckets, components and links of large families: right, and few."""

import numpy as np
import pytest
from loomgraph.llm import components, near_dedup
from loomgraph.llm.common import stored
from pyspark.sql import functions as F


def brute(edges):
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    while True:
        new = dict(label)
        for a, b in edges:
            if a != b:
                new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("few", [500_000, 50])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    r = np.random.default_rng(3)
    edges = [tuple(e) for e in r.integers(-150, 150, (130, 2)).tolist()] + [(1000, k) for k in range(1001, 1200)] + [(2000, 2000)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert {x["id"]: x["label"] for x in got} == brute(edges) and len(got) == len(brute(edges))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_long_path_takes_no_rounds(spark):
    path = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(4)
    got = components.connected_components(path, max_rounds=0).collect()
    assert sorted(x["id"] for x in got) == list(range(3001)) and {x["label"] for x in got} == {0}


@pytest.mark.parametrize("batch", [7, 10_000])
def test_ties_are_within_buckets_and_connect_them(spark, batch):
    r = np.random.default_rng(4)
    bands = {int(i): r.integers(0, 60, near_dedup.BANDS).astype(np.uint64) + np.uint64(1000) * np.arange(near_dedup.BANDS, dtype=np.uint64) for i in r.permutation(400)[:90] - 200}
    for i in list(bands)[:30]:
        bands[i][5] = 77  # a bucket of a third of all
    rows = spark.createDataFrame([(i, bytearray(b.tobytes())) for i, b in bands.items()], "id long, bands binary").repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [(x["a"], x["b"]) for x in near_dedup.ties(rows).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all(a > b and (bands[a] == bands[b]).any() for a, b in got)
    assert brute(got) == brute([(a, b) for a in bands for b in bands if (bands[a] == bands[b]).any()])


def test_components_of_a_large_family_are_linked_once_a_pair_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    sets = {i: np.append(np.arange(100), 1000 + i).astype(np.uint64) for i in range(40)}
    tied = spark.createDataFrame([(i, i // 20 * 20) for i in range(40) if i % 20], "a long, b long")
    families = stored(spark.createDataFrame([(0, i) for i in range(40)], "family long, id long"), "f")
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "id long, set binary")
    got = [(x["a"], x["b"]) for x in near_dedup.large_families(tied, families, stored(rows, "s"), 85).collect()]
    assert set(brute(got).values()) == {0} and len(brute(got)) == 40
    # 38 ties; two components of four blocks each
    assert len(got) <= 38 + 16
