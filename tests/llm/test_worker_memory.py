"""What Python workers hold of texts and of other operators' tables."""

import uuid

from pyspark.sql import functions as F

from loomgraph.llm import near_dedup, packing, tokenizing
from loomgraph.llm.common import BATCH

SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"


def spied(module, monkeypatch, folder):
    """Each batch whose texts the module's tasks take apart leaves its bytes and the worker's tokenizers in folder."""

    def slices(batch, column, *more, cut=module.slices):
        from loomgraph.llm import tokenizing

        (folder / uuid.uuid4().hex).write_text(f"{batch.nbytes} {len(tokenizing._LOADED)}")
        return cut(batch, column, *more)

    monkeypatch.setattr(module, "slices", slices)


def noted(folder):
    return [tuple(map(int, p.read_text().split())) for p in folder.iterdir()]


def long_words(spark):
    text = F.concat(F.repeat(F.lit("x"), 3_000_000), F.col("id").cast("string"))
    return spark.range(0, 8, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))


def test_near_dedup_gets_texts_in_small_batches(spark, tmp_path, monkeypatch):
    before = spark.conf.get(SIZE)
    spied(near_dedup, monkeypatch, tmp_path)
    found = near_dedup.near_duplicates(long_words(spark), 80).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == [(i, 1, i) for i in range(8)]
    sizes = [n for n, _ in noted(tmp_path)]
    assert sum(sizes) >= 24_000_000
    assert max(sizes) < BATCH + 4_000_000
    assert spark.conf.get(SIZE) == before


def test_packing_gets_texts_in_batches_of_the_size_asked_for(spark, tmp_path, monkeypatch):
    spied(packing, monkeypatch, tmp_path)
    docs = spark.range(0, 8, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b "), 1000).alias("text"))
    small = packing.pack_documents(docs, "word_bpe_49k.json", 1, batch=10_000).drop("sequence_id", "offset").collect()
    assert len(noted(tmp_path)) >= 2
    whole = packing.pack_documents(docs, "word_bpe_49k.json", 1).drop("sequence_id", "offset").collect()
    assert sorted(small) == sorted(whole)


def test_a_smaller_batch_of_the_session_stays(spark, tmp_path, monkeypatch):
    before = spark.conf.get(SIZE)
    spied(near_dedup, monkeypatch, tmp_path)
    spark.conf.set(SIZE, "1m")
    try:
        near_dedup.near_duplicates(long_words(spark), 80).collect()
    finally:
        spark.conf.set(SIZE, before)
    assert max(n for n, _ in noted(tmp_path)) < 4_000_000


def test_near_dedup_lets_tokenizers_of_packing_go(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}v{k}" for k in range(20))) for i in range(400)], "doc_id long, text string").repartition(8)
    packing.pack_documents(docs, "word_bpe_49k.json", 1).collect()
    spied(near_dedup, monkeypatch, tmp_path)
    near_dedup.near_duplicates(docs, 80).collect()
    assert {n for _, n in noted(tmp_path)} == {0}


def test_packing_keeps_its_tokenizer_from_task_to_task(monkeypatch):
    monkeypatch.setattr(tokenizing, "MemoTokenizer", lambda *a: object())
    assert tokenizing.tokenizer("one") is tokenizing.tokenizer("one")
    tokenizing._LOADED.clear()
