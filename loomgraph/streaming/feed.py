"""Indexing from a stream of changed sources: each micro-batch goes through the same steps as a run
over a tree.  Batches that come again change nothing, since unchanged hashes are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph import schema
from loomgraph.functions.text import language
from loomgraph.plans.index import CodeIndex


def follow(index: CodeIndex, sources: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """sources: streaming path, content (null: the file is gone), and optionally at, to order changes
    of one path within a batch."""

    def step(batch: DataFrame, _: int) -> None:
        rows = batch if "at" in batch.columns else batch.withColumn("at", F.lit(0))
        last = Window.partitionBy("path").orderBy(F.desc("at"), F.desc("content"))
        rows = rows.withColumn("place", F.row_number().over(last)).filter("place = 1").select("path", "content").persist()
        try:
            known = index.store.read("files")
            gone = rows.filter("content IS NULL").select("path")
            fresh = rows.filter("content IS NOT NULL").select("path", "content", language("path").alias("lang"), F.sha1("content").alias("hash"))
            # files that the batch does not name stay as they are
            stay = known.join(rows.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("content"), language("path").alias("lang"), "hash")
            index.reindex(fresh.unionByName(stay).join(gone, "path", "left_anti").select(*schema.SOURCES.names))
        finally:
            rows.unpersist()

    return sources.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
