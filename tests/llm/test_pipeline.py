"""Stages of the corpus pipeline against what they must keep."""

from collections import Counter

import corpus_pipeline
from loomgraph.llm.common import stored
from test_toxicity import texts_and_labels

WORDS = [f"w{i}" for i in range(400)]
TEXT = " ".join(WORDS[:60])


def documents(spark, rows):
    schema = "doc_id long, text string, toxic string, grade int, quality string, severity string"
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], schema)


def test_pipeline(spark, tmp_path):
    texts, labels = texts_and_labels(spark)
    clean = [(i, " ".join(f"c{i}v{k}" for k in range(40))) for i in range(10)]
    rows = clean + [(50, clean[3][1]), (51, clean[3][1] + " z"), (60, "aa bb " + " ".join(WORDS[:20]) + " cc dd"), (70, "vile awful vile awful vile"), (None, None), (80, "a\tb"), (80, "a\tb")]
    documents(spark, rows).union(texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(WORDS[:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        left.append(Counter(r["doc_id"] for r in docs.select("doc_id").collect() if r["doc_id"] is None or r["doc_id"] < 1000))
    first = Counter(i for i, _ in rows)
    assert left[0] == first - Counter([70])
    assert left[1] == left[0] - Counter([50, 51, 80]) and left[2] == left[1] - Counter([60]) and left[3] == left[2]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_drops_near_copies_from_80(spark):
    words = [f"n{k}" for k in range(80)]
    # 36 shingles of 44 (0.82), and of 46 (0.78)
    rows = [(1, " ".join(words[:40])), (2, " ".join(words[:48])), (3, " ".join(f"m{w}" for w in words[:40])), (4, " ".join(f"m{w}" for w in words[:50]))]
    left = corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect()
    assert sorted(r["doc_id"] for r in left) == [1, 3, 4]


def test_pipeline_judges_rows_without_id_by_their_text(spark, tmp_path):
    item, other = " ".join(WORDS[:20]), " ".join(WORDS[100:160])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [(3, TEXT), (None, TEXT), (None, other), (None, other), (None, None), (None, None), (7, "a b")])
    left = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == {(3, TEXT): 1, (None, other): 1, (None, None): 2, (7, "a b"): 1}
    assert left.columns == docs.columns
    leaky = documents(spark, [(3, TEXT), (None, "aa bb " + item + " cc"), (None, other), (None, None), (7, "a b")])
    left = corpus_pipeline.decontamination(spark, leaky, str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == {(None, other): 1, (None, None): 1, (7, "a b"): 1}


def test_texts_under_one_id_are_judged_each(spark, tmp_path):
    x, y = (" ".join(f"{c}{k}" for k in range(30)) for c in "xy")
    left = corpus_pipeline.near_dedup(spark, documents(spark, [(1, x), (5, x), (5, y), (7, y), (9, y)]), "")
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == {(1, x): 1, (5, y): 1}
    spark.createDataFrame([(1, x)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontamination(spark, documents(spark, [(5, x), (5, y)]), str(tmp_path))
    assert [(r["doc_id"], r["text"]) for r in left.collect()] == [(5, y)]


def test_a_column_named_like_the_key_stays(spark, tmp_path):
    docs = spark.createDataFrame([(1, TEXT, "k"), (2, TEXT, "l")], "doc_id long, text string, row_key string")
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert [tuple(r) for r in left.collect()] == [(1, TEXT, "k")]


def test_empty_tables_pass_all_stages(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
