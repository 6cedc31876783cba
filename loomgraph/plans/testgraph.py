"""A code-shaped graph derived from the part and lineitem tables, since the driver's tables hold no
source code; the same in SQL, as common table expressions; and a link graph of the pages.

`index` keeps the graph as an index on disk, as `CodeIndex` keeps that of a source tree: made once a
session and table folder, then read by the queries."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.frames import shared_folder
from loomgraph.operators.rank import file_ranks
from loomgraph.operators.resolve import build_edges
from loomgraph.sources.snapshots import Store

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=64)
def _rows(application: str, spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "part").count()


def _size(spark: SparkSession, sf_dir: str) -> int:
    return _rows(spark.sparkContext.applicationId, spark, sf_dir)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _size(spark, sf_dir)
    key, module = F.col("p_partkey"), F.floor(F.col("p_partkey") / 10)
    file = F.concat(F.when(module % 6 == 0, "tests/test_m").otherwise("src/m"), module.cast("string"), F.lit(".py"))
    kind = F.when(F.col("p_size") % 3 == 0, "function").when(F.col("p_size") % 3 == 1, "class").otherwise("method")
    name = F.concat(F.lit("fn_"), (key % (n * 3 // 4)).cast("string"))
    signature = F.when(F.col("p_size") % 10 != 0, F.col("p_type"))
    return _table(spark, sf_dir, "part").select(name.alias("name"), kind.alias("kind"), (key % 10 + 1).cast("int").alias("line"), signature.alias("signature"), file.alias("file"), (key % 10).cast("int").alias("ord"), key.alias("p_partkey"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _size(spark, sf_dir)
    s = symbols(spark, sf_dir).select("p_partkey", "file", "name")
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % n).alias("b")).distinct()
    one, two = s.select(F.col("p_partkey").alias("a"), "file", F.col("name").alias("caller")), s.select(F.col("p_partkey").alias("b"), F.col("name").alias("callee"))
    found = items.join(one, "a").join(two, "b").select("file", "caller", "callee").distinct()
    return found.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("caller", "callee")) - 1)


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = _size(spark, sf_dir) // 4 // 10
    s = symbols(spark, sf_dir).select(F.col("p_partkey").alias("a"), "file")
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.concat(F.lit("src.m"), ((F.col("l_partkey") * 3 + F.col("l_suppkey")) % modules).cast("string")).alias("ref"))
    found = items.join(s, "a").select("file", F.lit("python").alias("lang"), "ref").distinct()
    return found.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("ref")) - 1)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).select(F.col("file").alias("path")).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_edges(imports(spark, sf_dir), calls(spark, sf_dir), symbols(spark, sf_dir), paths(spark, sf_dir))


def new_store(spark: SparkSession, name: str = "index") -> Store:
    return Store(spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


@functools.lru_cache(maxsize=64)
def _index(application: str, spark: SparkSession, sf_dir: str) -> Store:
    store = new_store(spark)
    draft = store.draft()
    known, called, imported = (draft.write(n, f(spark, sf_dir)) for n, f in (("symbols", symbols), ("calls", calls), ("imports", imports)))
    files = draft.write("files", known.select(F.col("file").alias("path")).distinct().withColumn("hash", F.sha1("path")))
    linked = draft.write("edges", build_edges(imported, called, known, files.select("path")))
    draft.write("ranks", file_ranks(known, linked))
    draft.commit()
    return store


def index(spark: SparkSession, sf_dir: str) -> Store:
    return _index(spark.sparkContext.applicationId, spark, sf_dir)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").filter("url IS NOT NULL")
    return pages.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"))


#: the same tables in SQL
SQL = """
n AS (SELECT count(*) AS n FROM part),
symbols AS (
  SELECT 'fn_' || (p_partkey % (SELECT n * 3 // 4 FROM n)) AS name,
         CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'method' END AS kind,
         CAST(p_partkey % 10 + 1 AS INTEGER) AS line,
         CASE WHEN p_size % 10 <> 0 THEN p_type END AS signature,
         CASE WHEN (p_partkey // 10) % 6 = 0 THEN 'tests/test_m' ELSE 'src/m' END || (p_partkey // 10) || '.py' AS file,
         CAST(p_partkey % 10 AS INTEGER) AS ord, p_partkey
  FROM part),
calls AS (
  SELECT file, caller, callee, row_number() OVER (PARTITION BY file ORDER BY caller, callee) - 1 AS ord FROM (
    SELECT DISTINCT a.file, a.name AS caller, b.name AS callee
    FROM lineitem l JOIN symbols a ON a.p_partkey = l.l_partkey
    JOIN symbols b ON b.p_partkey = (l.l_partkey * 7 + l.l_suppkey) % (SELECT n FROM n))),
imports AS (
  SELECT file, ref, row_number() OVER (PARTITION BY file ORDER BY ref) - 1 AS ord FROM (
    SELECT DISTINCT a.file, 'src.m' || ((l.l_partkey * 3 + l.l_suppkey) % (SELECT n // 4 // 10 FROM n)) AS ref
    FROM lineitem l JOIN symbols a ON a.p_partkey = l.l_partkey)),
uniq AS (SELECT name, min(file) AS file FROM symbols GROUP BY name HAVING count(*) = 1),
paths AS (SELECT DISTINCT file AS path FROM symbols),
edges AS (
  SELECT i.file AS caller_file, CAST(NULL AS VARCHAR) AS caller_symbol, i.ref AS callee_name, p.path AS callee_file, 'import' AS kind, 'high' AS confidence, i.ord
  FROM imports i LEFT JOIN paths p ON p.path = replace(i.ref, '.', '/') || '.py'
  UNION ALL
  SELECT c.file, c.caller, c.callee, u.file, 'call', 'low', c.ord + 1073741824 FROM calls c JOIN uniq u ON u.name = c.callee WHERE c.caller <> c.callee)
"""
