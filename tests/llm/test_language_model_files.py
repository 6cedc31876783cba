"""Cells of parts and buckets by their numbers' bits, and the files of a model."""

import os

import numpy as np
import pytest
from loomgraph.llm import language_model as lm
from loomgraph.llm.common import workspace


def test_ranks_are_those_of_a_sort():
    r = np.random.default_rng(5)
    for x in (r.integers(0, 900, 1000), r.integers(0, 10**12, 1000), np.zeros(3, np.int64), np.zeros(0, np.int64)):
        known, at = lm.ranked(x)
        assert np.array_equal(known, np.unique(x)) and np.array_equal(known[at], x)


@pytest.mark.parametrize("bits", [None, 30])
def test_buckets_are_put_together_from_runs(monkeypatch, bits):
    if bits:
        monkeypatch.setattr(lm, "width", lambda known: bits)
    r = np.random.default_rng(6)
    runs, want = [], {}
    for _ in range(4):
        cells = sorted({tuple(x) for x in (r.integers(0, 12, (300, 3)) * 10**6).tolist()})
        count = r.integers(0, 4, len(cells))
        runs.append(lm.coded(*np.array(cells).T, count))
        for x, n in zip(cells, count.tolist(), strict=True):
            want[x] = want.get(x, 0) + n
    b = lm.Bucket(runs)
    v, w, u = b.befores[b.before[b.pair]], b.words[b.word[b.pair]], b.first[b.context]
    cells = list(zip(v.tolist(), w.tolist(), u.tolist(), strict=True))
    assert cells == sorted(want) and dict(zip(cells, b.count.tolist(), strict=True)) == want
    assert np.array_equal(b.befores[b.of[b.context]], v) and len(b.of) == len({(x[0], x[2]) for x in want})
    again = np.concatenate([np.stack(lm.decoded(x)[:3], axis=1) for x in runs])
    assert np.array_equal(np.stack([v, w, u], axis=1)[b.cell], again)


def test_parts_are_taken_apart_once(spark, monkeypatch):
    folder = workspace(spark, "restaurants")
    monkeypatch.setattr(lm, "workspace", lambda *_: folder)
    docs = spark.createDataFrame([(i, f"a b c d{i % 9} a b {'e ' * (i % 5)}") for i in range(80)] + [(None, None)], "doc_id long, text string").repartition(3)
    lm.score_documents(docs).count()
    kinds = {f.rpartition("-")[0] for f in os.listdir(folder.removeprefix("file://"))}
    # tokens are gone once buckets have their cells: the documents' sums and places of cells stay
    assert {"documents", "cells", "places"} <= kinds and not {"part", "words"} & kinds
