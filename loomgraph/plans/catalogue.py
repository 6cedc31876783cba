"""One query per operator over the derived graph, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import clamp_depth, is_file_target, is_test_file, language, resolve_budget, resolve_depth, resolve_top_k, token_cost
from loomgraph.operators import rank, resolve, search, trace
from loomgraph.operators.frames import checkpointed
from loomgraph.operators.parse import parse_sources
from loomgraph.plans import testgraph as g
from loomgraph.plans.index import CodeIndex, language_distribution, table_counts
from loomgraph.sources.snapshots import open_store

ROUNDS, TOLERANCE, MAP_BUDGET = 30, 1e-6, 1500
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def _read(spark, sf_dir, *names: str) -> list[DataFrame]:
    return [g.index(spark, sf_dir).read(n) for n in names]


def _with(body: str, extra: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{g.SQL}{extra} {body}"


# --- search ---------------------------------------------------------------------------------

_FOUND = ("name", "kind", "line", "signature", "file")
_FOLD = "translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
for _name, _mode, _arg, _kind, _where in (
    ("find_exact", "exact", "fn_7", None, "name = 'fn_7'"),
    ("find_prefix", "prefix", "FN_1", None, f"starts_with({_FOLD}, 'fn_1')"),
    ("find_substring", "substring", "_10", None, f"contains({_FOLD}, '_10')"),
    ("find_kind", "prefix", "fn_1", "class", f"starts_with({_FOLD}, 'fn_1') AND kind = 'class'"),
):
    query(_with(f"SELECT name, kind, line, signature, file FROM symbols WHERE {_where}"), _name)(lambda s, d, m=_mode, a=_arg, k=_kind: g.index(s, d).find_symbols(a, m, k).select(*_FOUND))

_TIERED = f"""SELECT CASE WHEN name = 'fn_1' THEN 0 WHEN starts_with({_FOLD}, 'fn_1') THEN 1 ELSE 2 END AS tier, file, line, kind, name, signature, ord,
  row_number() OVER (PARTITION BY file, name, line ORDER BY ord) AS place FROM symbols WHERE contains({_FOLD}, 'fn_1')"""


@query(_with(f"SELECT tier, file, line, kind, name, signature FROM ({_TIERED}) WHERE place = 1 ORDER BY tier, file, line, ord LIMIT 20"))
def find_tiered_topk(spark, sf_dir):
    no_ranks = spark.createDataFrame([], "file string, rank double")
    return search.find_ranked(g.index(spark, sf_dir).read("symbols"), no_ranks, "fn_1").drop("rank", "ord")


def _rank_sql(nodes: str, links: str) -> str:
    """Rounds of the recurrence, written out; after the one that moves less than the tolerance (`d`)
    nothing changes.  The last is `ranked` (node, rank)."""
    parts = [f"nodes AS MATERIALIZED (SELECT DISTINCT node FROM ({nodes}))", f"w AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM ({links}) GROUP BY src, dst)", "o AS MATERIALIZED (SELECT src, sum(w) AS total FROM w GROUP BY src)", "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)", "d0 AS MATERIALIZED (SELECT false AS done)"]
    for i in range(1, ROUNDS + 1):
        p = f"r{i - 1}"
        parts.append(f"""r{i} AS MATERIALIZED (SELECT q.node, CASE WHEN (SELECT done FROM d{i - 1}) THEN q.rank ELSE (0.15::DOUBLE + 0.85::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM {p} WHERE node NOT IN (SELECT src FROM o))) / (SELECT count(*) FROM nodes) + coalesce(m.got, 0) END AS rank
  FROM {p} q LEFT JOIN (SELECT w.dst, sum(0.85::DOUBLE * r.rank * w.w / o.total) AS got FROM w JOIN {p} r ON r.node = w.src JOIN o ON o.src = w.src GROUP BY w.dst) m ON m.dst = q.node)""")
        parts.append(f"d{i} AS MATERIALIZED (SELECT coalesce(sum(abs(a.rank - b.rank)), 0) < {TOLERANCE} AS done FROM r{i} a JOIN {p} b ON a.node = b.node)")
    parts.append(f"ranked AS (SELECT node, round(rank, {rank.DIGITS}) AS rank FROM r{ROUNDS})")
    return ", " + ", ".join(parts)


_FILE_NODES = "SELECT file AS node FROM symbols UNION ALL SELECT caller_file FROM edges UNION ALL SELECT callee_file FROM edges WHERE callee_file IS NOT NULL"
_FILE_LINKS = "SELECT caller_file AS src, callee_file AS dst FROM edges WHERE callee_file IS NOT NULL"
_MICRO = "CAST(round(rank * 1e6) AS BIGINT)"


def _micro(ranks: DataFrame) -> DataFrame:
    return ranks.withColumn("rank", F.round(F.col("rank") * 1e6).cast("long"))


@query(_with(f"SELECT tier, {_MICRO} AS rank, file, line, kind, name, signature FROM ({_TIERED}) t JOIN ranked ON node = file WHERE place = 1 ORDER BY tier, ranked.rank DESC, file, line, ord LIMIT 20", _rank_sql(_FILE_NODES, _FILE_LINKS)))
def find_ranked(spark, sf_dir):
    return _micro(search.find_ranked(g.index(spark, sf_dir).read("symbols"), g.index(spark, sf_dir).read("ranks"), "fn_1")).drop("ord")


@query(_with(f"SELECT node AS file, {_MICRO} AS rank FROM ranked", _rank_sql(_FILE_NODES, _FILE_LINKS)))
def file_pagerank(spark, sf_dir):
    store = g.index(spark, sf_dir)
    return _micro(rank.file_ranks(store.read("symbols"), store.read("edges")))


_HREFS = "SELECT url AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages WHERE url IS NOT NULL"


@query("WITH l AS (" + _HREFS + ")" + _rank_sql("SELECT src AS node FROM l UNION ALL SELECT dst FROM l", "SELECT src, dst FROM l") + f" SELECT node, {_MICRO} AS rank FROM ranked")
def page_pagerank(spark, sf_dir):
    links = checkpointed(g.page_links(spark, sf_dir))
    return _micro(rank.page_rank(links.select(F.col("src").alias("node")), links))


@query(ORACLE["page_pagerank"])
def page_pagerank_loop(spark, sf_dir):
    """The form for graphs beyond one task."""
    links = checkpointed(g.page_links(spark, sf_dir))
    return _micro(rank.page_rank(links.select(F.col("src").alias("node")), links, kernel_links=0))


# --- aggregates -----------------------------------------------------------------------------


@query(_with("SELECT name, count(*) AS n, min(file) AS file FROM symbols GROUP BY name"))
def defs_per_name(spark, sf_dir):
    return resolve.definitions(g.index(spark, sf_dir).read("symbols"))


@query(_with("SELECT name, count(*) AS n FROM symbols GROUP BY name HAVING count(*) > 1"))
def ambiguous_names(spark, sf_dir):
    return resolve.ambiguous_names(g.index(spark, sf_dir).read("symbols"))


_LABELLED = "SELECT path FROM paths UNION ALL SELECT replace(path, '.py', '.go') FROM paths WHERE path LIKE 'tests/%' UNION ALL SELECT 'README'"


@query(_with(f"SELECT CASE regexp_extract(path, '(\\.[^.]*)$', 1) WHEN '.py' THEN 'py' WHEN '.go' THEN 'go' ELSE 'other' END AS label, count(*) AS n FROM ({_LABELLED}) GROUP BY 1"))
def language_distribution_(spark, sf_dir):
    p = g.index(spark, sf_dir).read("files").select("path")
    more = p.filter("path LIKE 'tests/%'").select(F.regexp_replace("path", r"\.py", ".go").alias("path"))
    return language_distribution(p.union(more).union(spark.createDataFrame([("README",)], "path string")))


@query(_with("SELECT 'files' AS table_name, count(*) AS n FROM paths UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'edges', count(*) FROM edges"))
def table_counts_(spark, sf_dir):
    store = g.index(spark, sf_dir)
    return table_counts({n: store.read(n) for n in ("files", "symbols", "edges")})


for _old, _new in (("language_distribution_", "language_distribution"), ("table_counts_", "table_counts")):
    QUERIES[_new], ORACLE[_new] = QUERIES.pop(_old), ORACLE.pop(_old)


@query(_with(f"SELECT src, dst, count(*) AS w FROM ({_FILE_LINKS}) GROUP BY src, dst"))
def link_weights(spark, sf_dir):
    return rank.link_weights(rank.file_links(g.index(spark, sf_dir).read("edges")))


# --- resolution -----------------------------------------------------------------------------

_EDGE = ("caller_file", "caller_symbol", "callee_name", "callee_file", "kind", "confidence")


@query(_with("SELECT caller_file, caller_symbol, callee_name, callee_file, kind, confidence FROM edges WHERE kind = 'call'"))
def resolve_calls(spark, sf_dir):
    return resolve.resolve_calls(*_read(spark, sf_dir, "calls", "symbols")).select(*_EDGE)


@query(_with("SELECT caller_file, caller_symbol, callee_name, callee_file, kind, confidence FROM edges WHERE kind = 'import'"))
def resolve_imports_py(spark, sf_dir):
    return resolve.resolve_imports(*_read(spark, sf_dir, "imports", "files")).select(*_EDGE)


#: references of TypeScript from every part's module: relative ones, every third to a folder with an index
_TS_REF = "CASE WHEN k % 3 = 0 THEN '../src/d' || k WHEN k % 3 = 1 THEN './m' || k ELSE 'pkg' || k END"
_TS_FILE = "'src/m' || a || '.ts'"


@query(
    _with(
        f"""SELECT {_TS_FILE} AS caller_file, CAST(NULL AS VARCHAR) AS caller_symbol, {_TS_REF} AS callee_name,
  CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'src/d' || k || '/index.ts' WHEN k % 3 = 1 AND k % 2 = 0 THEN 'src/m' || k || '.tsx' END AS callee_file, 'import' AS kind, 'high' AS confidence
  FROM (SELECT DISTINCT p_partkey // 10 AS a, (p_partkey * 7) % (SELECT n FROM n) AS k FROM part)"""
    )
)
def resolve_imports_ts(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(F.floor(F.col("p_partkey") / 10).alias("a"), (F.col("p_partkey") * 7 % part.count()).alias("k")).distinct()
    imports = rows.select(F.expr(_TS_FILE).alias("file"), F.lit("typescript").alias("lang"), F.expr(_TS_REF).alias("ref"), F.lit(0).alias("ord"))
    even = rows.filter("k % 2 = 0").select("k").distinct()
    known = even.select(F.expr("concat('src/d', k, '/index.ts')").alias("path")).union(even.select(F.expr("concat('src/m', k, '.tsx')")))
    return resolve.resolve_imports(imports, known).select(*_EDGE)


@query(_with("SELECT file, caller, callee FROM calls WHERE callee NOT IN (SELECT name FROM uniq)"))
def unresolved_calls(spark, sf_dir):
    return resolve.unresolved_calls(*_read(spark, sf_dir, "calls", "symbols"))


@query("SELECT doc_id AS path, sha1(coalesce(text, '')) AS hash FROM documents WHERE lang = 'de' OR n_chars % 5 = 0")
def changed_files(spark, sf_dir):
    """Against an index that lacks the texts of one language and has old hashes of some others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("hash", F.sha1(F.coalesce("text", F.lit(""))))
    stale = F.when(F.col("n_chars") % 5 == 0, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash"))
    old = docs.filter("lang <> 'de'").select(F.col("doc_id").alias("path"), stale.alias("hash"))
    return resolve.changed_files(docs.select(F.col("doc_id").alias("path"), "hash"), old)


@query(_with("SELECT name, kind, line, signature, file FROM symbols WHERE line % 2 = 1 OR file NOT LIKE 'tests/%' UNION ALL SELECT name || '_new', kind, line, NULL, file FROM symbols WHERE line % 2 = 0 AND file LIKE 'tests/%'").replace("line % 2 = 1 OR file NOT LIKE 'tests/%'", "file NOT LIKE 'tests/%'"))
def replace_symbols(spark, sf_dir):
    s = g.index(spark, sf_dir).read("symbols").select(*_FOUND)
    tests = s.filter("file LIKE 'tests/%'")
    new = tests.filter("line % 2 = 0").select(F.concat("name", F.lit("_new")).alias("name"), "kind", "line", F.lit(None).cast("string").alias("signature"), "file")
    return resolve.replace_rows(s, new, tests.select(F.col("file").alias("path")).distinct(), "file")


# --- edges ----------------------------------------------------------------------------------


_TOP = "(SELECT callee_name FROM edges WHERE kind = 'call' GROUP BY callee_name ORDER BY count(*) DESC, callee_name LIMIT 1)"
#: edges with their place in the order of the store
_PLACED = "caller_file, caller_symbol, callee_name, callee_file, kind, confidence, CAST(row_number() OVER (ORDER BY caller_file, callee_name, ord) AS INTEGER) AS place"


def top_name(edges: DataFrame) -> str:
    """The name that most calls go to."""
    return edges.filter("kind = 'call'").groupBy("callee_name").count().orderBy(F.desc("count"), "callee_name").first()[0]


def _placed(rows: DataFrame) -> DataFrame:
    """Sorted rows with their place: that of results small enough to be shown."""
    return rows.withColumn("at", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("at"))).drop("at")


for _name, _where, _call in (
    ("edges_from", "caller_file IN ('src/m1.py', 'tests/test_m6.py')", lambda store: store.get_edges_from(["src/m1.py", "tests/test_m6.py", "none.py"])),
    ("edges_from_nothing", "false", lambda store: store.get_edges_from([])),
    ("edges_from_file", "caller_file = 'src/m1.py'", lambda store: store.get_edges_from_file("src/m1.py")),
    ("edges_to_name", f"callee_name = {_TOP}", lambda store: store.get_edges_to_name(top_name(store.read("edges")))),
    ("edges_to_file", "callee_file = 'src/m7.py'", lambda store: store.get_edges_to_file("src/m7.py")),
):
    query(_with(f"SELECT {_PLACED} FROM edges WHERE {_where}"), _name)(lambda s, d, f=_call: _placed(f(g.index(s, d))).select(*_EDGE, "place"))


@query(_with("SELECT caller_file, caller_symbol, callee_name, callee_file, kind, confidence FROM edges"))
def all_edges(spark, sf_dir):
    return g.index(spark, sf_dir).get_all_edges().select(*_EDGE)


# --- reachability ---------------------------------------------------------------------------


def _callers_sql(depth: int) -> str:
    reached = f"""SELECT {_TOP}, 0 UNION
  SELECT m, d + 1 FROM (SELECT coalesce(e.caller_symbol, s.name) AS m, r.d FROM reached r JOIN edges e ON e.callee_name = r.n
    LEFT JOIN symbols s ON e.caller_symbol IS NULL AND s.file = e.caller_file WHERE r.d < {depth - 1}) WHERE m IS NOT NULL"""
    return _with("SELECT caller_file AS file, caller_symbol AS symbol, CASE WHEN caller_symbol IS NULL THEN 'import' ELSE 'call' END AS via, CAST(min(d) + 1 AS INTEGER) AS depth FROM reached JOIN edges ON callee_name = n GROUP BY caller_file, caller_symbol", f", reached(n, d) AS ({reached})", True)


def _callees_sql(depth: int) -> str:
    seed = f"seed AS (SELECT file, name FROM symbols WHERE name = (SELECT caller_symbol FROM edges WHERE kind = 'call' GROUP BY caller_symbol ORDER BY count(*) DESC, caller_symbol LIMIT 1) ORDER BY file, line, ord LIMIT 1)"
    reached = f"SELECT file, 0 FROM seed UNION SELECT e.callee_file, r.d + 1 FROM reached r JOIN edges e ON e.kind = 'call' AND e.caller_file = r.f WHERE r.d < {depth - 1}"
    return _with("SELECT e.callee_file AS file, e.callee_name AS symbol, 'call' AS via, CAST(min(d) + 1 AS INTEGER) AS depth FROM reached JOIN edges e ON e.kind = 'call' AND e.caller_file = f WHERE (e.callee_file, e.callee_name) NOT IN (SELECT (file, name) FROM seed) GROUP BY 1, 2", f", {seed}, reached(f, d) AS ({reached})", True)


def top_caller(edges: DataFrame) -> str:
    """The name that makes most calls."""
    return edges.filter("kind = 'call'").groupBy("caller_symbol").count().orderBy(F.desc("count"), "caller_symbol").first()[0]


def _callers(depth: int) -> Query:
    def run(spark, sf_dir):
        symbols, e = _read(spark, sf_dir, "symbols", "edges")
        return trace.trace_callers(symbols, e, top_name(e), depth)

    return run


def _callees(depth: int) -> Query:
    def run(spark, sf_dir):
        symbols, e = _read(spark, sf_dir, "symbols", "edges")
        return trace.trace_callees(symbols, e, top_caller(e), depth)

    return run


for _d in (1, 2, 3, 5):
    query(_callers_sql(_d), f"trace_callers_d{_d}")(_callers(_d))
for _d in (1, 2, 3, 5):
    query(_callees_sql(_d), f"trace_callees_d{_d}")(_callees(_d))


def _impact_sql(seeds: str, depth: int, sections: tuple[str, ...]) -> str:
    """Typed nodes: k is F or S; `e` has each edge with what it leads to from either end."""
    reached = f"""SELECT k, f, s, 0 FROM seeds UNION
  SELECT y.k, y.f, y.s, y.d FROM (
    SELECT unnest(CASE WHEN x.to_file IS NULL THEN [] WHEN x.is_call AND x.to_name IS NOT NULL THEN [{{'k': 'F', 'f': x.to_file, 's': NULL::VARCHAR}}, {{'k': 'S', 'f': x.to_file, 's': x.to_name}}] ELSE [{{'k': 'F', 'f': x.to_file, 's': NULL::VARCHAR}}] END) AS n, x.d + 1 AS d
    FROM (SELECT hit.*, r.d FROM reached r JOIN hit ON hit.k = r.k AND (hit.f = r.f OR hit.f IS NULL) AND (hit.s = r.s OR hit.s IS NULL) WHERE r.d < {depth}) x) z, LATERAL (SELECT z.n.k AS k, z.n.f AS f, z.n.s AS s, z.d AS d) y"""
    hit = """hit AS MATERIALIZED (
  SELECT 'F' AS k, caller_file AS f, NULL::VARCHAR AS s, callee_file AS to_file, callee_name AS to_name, kind = 'call' AS is_call, caller_symbol, callee_name FROM edges
  UNION ALL SELECT 'F', callee_file, NULL, caller_file, caller_symbol, kind = 'call', caller_symbol, callee_name FROM edges WHERE callee_file IS NOT NULL
  UNION ALL SELECT 'S', NULL, callee_name, caller_file, caller_symbol, kind = 'call', caller_symbol, callee_name FROM edges
  UNION ALL SELECT 'S', caller_file, caller_symbol, callee_file, callee_name, true, caller_symbol, callee_name FROM edges WHERE kind = 'call')"""
    files = "SELECT DISTINCT 'files' AS section, f AS value FROM reached WHERE f IS NOT NULL"
    scanned = f"(SELECT hit.* FROM reached r JOIN hit ON hit.k = r.k AND (hit.f = r.f OR hit.f IS NULL) AND (hit.s = r.s OR hit.s IS NULL) WHERE r.d < {depth} AND hit.is_call)"
    parts = {
        "files": files,
        "symbols": f"SELECT DISTINCT 'symbols' AS section, value FROM (SELECT caller_symbol AS value FROM {scanned} UNION SELECT callee_name FROM {scanned}) WHERE value IS NOT NULL",
        "tests": f"SELECT 'tests' AS section, value FROM ({files}) WHERE contains(value, 'test_') OR contains(value, 'tests/') OR ends_with(value, '_test.py')",
    }
    return _with(" UNION ALL ".join(parts[s] for s in sections), f", {hit}, seeds AS ({seeds}), reached(k, f, s, d) AS ({reached})", True)


_SYMBOL_SEEDS = f"SELECT 'F' AS k, file AS f, NULL::VARCHAR AS s FROM symbols WHERE name = {_TOP} UNION SELECT 'S', file, name FROM symbols WHERE name = {_TOP} UNION SELECT 'S', NULL, {_TOP}"
_FILE_SEEDS = "SELECT 'F' AS k, 'src/m7.py' AS f, NULL::VARCHAR AS s"


@query(_impact_sql(_SYMBOL_SEEDS, 2, ("files", "symbols", "tests")))
def impact_symbol(spark, sf_dir):
    symbols, e = _read(spark, sf_dir, "symbols", "edges")
    return trace.impact(symbols, e, symbol=top_name(e), depth=2)


@query(_impact_sql(_FILE_SEEDS, 1, ("files", "symbols", "tests")))
def impact_file(spark, sf_dir):
    return trace.impact(*_read(spark, sf_dir, "symbols", "edges"), file="src/m7.py", depth=1)


@query(_impact_sql(_SYMBOL_SEEDS, 1, ("tests",)))
def impact_tests(spark, sf_dir):
    symbols, e = _read(spark, sf_dir, "symbols", "edges")
    return trace.impact(symbols, e, symbol=top_name(e), depth=1).filter("section = 'tests'")


# --- edge cases of traces --------------------------------------------------------------------


@query(_with(f"SELECT file, name AS symbol, 'call' AS via, 0 AS depth FROM symbols WHERE name = 'fn_7' ORDER BY file, line, ord LIMIT 1"))
def trace_callers_d0(spark, sf_dir):
    return trace.trace_callers(*_read(spark, sf_dir, "symbols", "edges"), "fn_7", 0)


@query(_callers_sql(5))
def trace_callers_d99(spark, sf_dir):
    """Depths beyond five count as five."""
    symbols, e = _read(spark, sf_dir, "symbols", "edges")
    return trace.trace_callers(symbols, e, top_name(e), 99)


@query(_callees_sql(2))
def trace_callees_by_name(spark, sf_dir):
    """Calls without a file go to the one definition of their name."""
    symbols, e = _read(spark, sf_dir, "symbols", "edges")
    unknown = F.when(F.col("kind") == "import", F.col("callee_file")).alias("callee_file")
    return trace.trace_callees(symbols, e.select(*[unknown if c == "callee_file" else c for c in e.columns]), top_caller(e), 2)


_SEED = "(SELECT file, name FROM symbols WHERE name = (SELECT caller_symbol FROM edges WHERE kind = 'call' GROUP BY caller_symbol ORDER BY count(*) DESC, caller_symbol LIMIT 1) ORDER BY file, line, ord LIMIT 1)"


@query(_with(f"SELECT callee_file AS file, callee_name AS symbol, 'call' AS via, CAST(min(d) + 1 AS INTEGER) AS depth FROM reached JOIN edges ON kind = 'call' AND caller_file = f AND caller_symbol = s WHERE (callee_file, callee_name) NOT IN (SELECT (file, name) FROM {_SEED}) GROUP BY 1, 2", f", reached(f, s, d) AS (SELECT file, name, 0 FROM {_SEED} UNION SELECT callee_file, callee_name, d + 1 FROM reached JOIN edges ON kind = 'call' AND caller_file = f AND caller_symbol = s WHERE d < 2)", True))
def trace_callees_strict(spark, sf_dir):
    symbols, e = _read(spark, sf_dir, "symbols", "edges")
    return trace.trace_callees(symbols, e, top_caller(e), 3, strict=True)


@query(_with(f"SELECT *, CAST(row_number() OVER (ORDER BY depth, file, coalesce(symbol, '')) AS INTEGER) AS place FROM (SELECT DISTINCT caller_file AS file, caller_symbol AS symbol, CASE WHEN caller_symbol IS NULL THEN 'import' ELSE 'call' END AS via, 1 AS depth FROM edges WHERE callee_name = {_TOP})"))
def trace_order(spark, sf_dir):
    symbols, e = _read(spark, sf_dir, "symbols", "edges")
    return _placed(trace.trace_callers(symbols, e, top_name(e), 1))


@query(_impact_sql(_SYMBOL_SEEDS, 0, ("files", "tests")))
def impact_d0(spark, sf_dir):
    symbols, e = _read(spark, sf_dir, "symbols", "edges")
    return trace.impact(symbols, e, symbol=top_name(e), depth=0)


@query(_with("SELECT section, value, CAST(row_number() OVER (ORDER BY section, value) AS INTEGER) AS place FROM (" + "SELECT DISTINCT 'files' AS section, file AS value FROM symbols WHERE name = 'fn_7' UNION ALL SELECT DISTINCT 'tests', file FROM symbols WHERE name = 'fn_7' AND file LIKE 'tests/%')"))
def impact_order(spark, sf_dir):
    return _placed(trace.impact(*_read(spark, sf_dir, "symbols", "edges"), symbol="fn_7", depth=0))


@query(_with(f"SELECT DISTINCT file AS value FROM symbols WHERE name = {_TOP} AND NOT (contains(file, 'test_') OR contains(file, 'tests/') OR ends_with(file, '_test.py'))"))
def impact_files_without_tests(spark, sf_dir):
    symbols, e = _read(spark, sf_dir, "symbols", "edges")
    found = trace.impact(symbols, e, symbol=top_name(e), depth=0)
    return trace.without_tests(found)


# --- the store ------------------------------------------------------------------------------


def _copied(spark, sf_dir, *names: str):
    """A store of its own with some tables of the index."""
    store = g.new_store(spark, "copy")
    store.write({n: g.index(spark, sf_dir).read(n) for n in names})
    return store


@query(_with("SELECT path, CASE path WHEN 'src/m1.py' THEN 'new' ELSE sha1(path) END AS hash FROM paths UNION ALL SELECT 'more.py', 'x'"))
def upsert_file(spark, sf_dir):
    store = _copied(spark, sf_dir, "files")
    store.upsert_file("src/m1.py", "new")
    store.upsert_file("more.py", "x")
    return store.read("files")


@query(_with("SELECT name, kind, line, signature, file FROM symbols WHERE file <> 'src/m1.py' UNION ALL SELECT * FROM (VALUES ('a', 'function', 1, 'a()', 'src/m1.py'), ('b', 'class', 2, NULL, 'src/m1.py'))"))
def upsert_symbols(spark, sf_dir):
    store = _copied(spark, sf_dir, "symbols")
    store.upsert_symbols("src/m1.py", [("a", "function", 1, "a()"), ("b", "class", 2, None)])
    return store.read("symbols").select(*_FOUND)


@query(_with("SELECT caller_file, caller_symbol, callee_name, callee_file, kind, confidence FROM edges ANTI JOIN (SELECT 'src/m1.py' AS caller_file) USING (caller_file) UNION ALL SELECT * FROM (VALUES ('src/m1.py', CAST(NULL AS VARCHAR), 'os', CAST(NULL AS VARCHAR), 'import', 'high'), ('src/m1.py', 'a', 'b', 'src/m2.py', 'call', 'low'))"))
def upsert_edges(spark, sf_dir):
    store = _copied(spark, sf_dir, "edges")
    store.upsert_edges("src/m1.py", [(None, "os", None, "import", "high"), ("a", "b", "src/m2.py", "call", "low")])
    return store.get_all_edges().select(*_EDGE)


@query(_with("SELECT count(*) AS symbols, 'refused' AS kind, 'refused' AS edge_kind, 'refused' AS confidence, 'refused' AS mode FROM symbols"))
def guards(spark, sf_dir):
    """Writes with unknown kinds fail and change nothing; so does a search of an unknown mode."""
    store = _copied(spark, sf_dir, "symbols")

    def outcome(run) -> str:
        try:
            run()
        except Exception:
            return "refused"
        return "done"

    tried = [
        outcome(lambda: store.upsert_symbols("src/m1.py", [("a", "module", 1, None)])),
        outcome(lambda: store.upsert_edges("src/m1.py", [(None, "a", None, "inherits", "high")])),
        outcome(lambda: store.upsert_edges("src/m1.py", [(None, "a", None, "call", "maybe")])),
        outcome(lambda: store.find_symbols("a", "fuzzy")),
    ]
    known = store.read("symbols").agg(F.count("*").alias("symbols"))
    return known.select("symbols", *[F.lit(x).alias(n) for n, x in zip(("kind", "edge_kind", "confidence", "mode"), tried, strict=True)])


@query("SELECT name AS table_name, CAST(0 AS BIGINT) AS n FROM (VALUES ('files'), ('symbols'), ('edges')) AS t(name)")
def created_tables(spark, sf_dir):
    store = open_store(spark, g.new_store(spark, "empty").folder)
    return table_counts({n: store.read(n) for n in ("files", "symbols", "edges")})


@query(_with("SELECT 'index' AS \"check\", 'OK' AS status, 'files ' || (SELECT count(*) FROM paths) || ' | symbols ' || (SELECT count(*) FROM symbols) || ' | edges ' || (SELECT count(*) FROM edges) AS detail UNION ALL SELECT 'languages', 'OK', 'py ' || (SELECT count(*) FROM paths)"))
def doctor(spark, sf_dir):
    store = g.index(spark, sf_dir)
    return CodeIndex(spark, "/nowhere", store.folder).doctor().filter(F.col("check").isin("index", "languages"))


@query("SELECT 1 AS run, count(*) AS parsed, count(*) AS files FROM documents UNION ALL SELECT 2, 0, count(*) FROM documents UNION ALL SELECT 3, count(*) FILTER (n_chars % 2 = 0), count(*) FILTER (lang <> 'de') FROM documents WHERE lang <> 'de'")
def reindex_counts(spark, sf_dir):
    """A first run, one without changes, and one after texts changed and others went."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = CodeIndex(spark, "/nowhere", g.new_store(spark, "documents").folder)
    text = F.coalesce("text", F.lit(""))
    sources = lambda rows, content: rows.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), content.alias("content"), F.lit("python").alias("lang"), F.sha1(content).alias("hash"))
    edited = F.when(F.col("n_chars") % 2 == 0, F.concat(text, F.lit("\nx"))).otherwise(text)
    rows = []
    for run, source in enumerate((sources(docs, text), sources(docs, text), sources(docs.filter("lang <> 'de'"), edited)), 1):
        rows.append((run, index.reindex(source).files, index.store.rows("files")))
    return spark.createDataFrame(rows, "run int, parsed long, files long")


# --- more of resolution ---------------------------------------------------------------------


@query(_with("SELECT file AS caller_file, CAST(NULL AS VARCHAR) AS caller_symbol, r.ref AS callee_name, p.path AS callee_file, 'import' AS kind, 'high' AS confidence FROM (SELECT DISTINCT file, unnest(['.m' || k, '..src.m' || k, '.', '...up', '..tests.test_m' || k]) AS ref, unnest([regexp_replace(file, '/[^/]*$', '') || '/m' || k || '.py', 'src/m' || k || '.py', '', '', 'tests/test_m' || k || '.py']) AS want FROM (SELECT file, CAST(regexp_extract(file, '([0-9]+)', 1) AS BIGINT) + 1 AS k FROM symbols)) r LEFT JOIN paths p ON p.path = want"))
def resolve_imports_dots(spark, sf_dir):
    """Relative references of Python; beyond the root there is nothing."""
    files = g.index(spark, sf_dir).read("files")
    k = (F.regexp_extract("path", "([0-9]+)", 1).cast("long") + 1).cast("string")
    refs = F.array(F.concat(F.lit(".m"), k), F.concat(F.lit("..src.m"), k), F.lit("."), F.lit("...up"), F.concat(F.lit("..tests.test_m"), k))
    imports = files.select(F.col("path").alias("file"), F.lit("python").alias("lang"), F.posexplode(refs).alias("ord", "ref"))
    return resolve.resolve_imports(imports, files).select(*_EDGE)


@query(_with("SELECT replace(file, '.py', e.ext) AS caller_file, CAST(NULL AS VARCHAR) AS caller_symbol, ref AS callee_name, CAST(NULL AS VARCHAR) AS callee_file, 'import' AS kind, 'high' AS confidence FROM imports, (VALUES ('.go'), ('.java')) AS e(ext)"))
def resolve_imports_go_java(spark, sf_dir):
    imports, files = _read(spark, sf_dir, "imports", "files")
    both = [imports.withColumn("file", F.regexp_replace("file", r"\.py$", e)).withColumn("lang", F.lit(lang)) for e, lang in ((".go", "go"), (".java", "java"))]
    return resolve.resolve_imports(both[0].unionByName(both[1]), files).select(*_EDGE)


@query("SELECT DISTINCT source || e.ext AS path, e.lang AS lang FROM documents, (VALUES ('.py', 'python'), ('.ts', 'typescript'), ('.tsx', 'tsx'), ('.go', 'go'), ('.java', 'java'), ('.md', NULL), ('.pyc', NULL)) AS e(ext, lang)")
def languages(spark, sf_dir):
    ends = spark.createDataFrame([(e,) for e in (".py", ".ts", ".tsx", ".go", ".java", ".md", ".pyc")], "ext string")
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
    paths = sources.join(F.broadcast(ends)).select(F.concat("source", "ext").alias("path"))
    return paths.select("path", language("path").alias("lang"))


@query(_with(f"SELECT file || ':' || line || '  ' || kind || '  ' || name || coalesce('  ' || signature, '') AS text FROM symbols"))
def find_lines(spark, sf_dir):
    return search.find_lines(g.index(spark, sf_dir).read("symbols"))


@query("SELECT CAST(x AS INTEGER) AS x, CAST(least(greatest(x, 0), 5) AS INTEGER) AS clamped, CAST(greatest(1, least(x, 5)) AS INTEGER) AS depth, CAST(greatest(1, x) AS INTEGER) AS top_k, CAST(greatest(200, least(x, 8000)) AS INTEGER) AS budget FROM (VALUES (-3), (0), (1), (2), (5), (6), (199), (200), (1500), (8000), (8001)) AS t(x) UNION ALL SELECT NULL, 2, 2, 20, 1500")
def clamps(spark, sf_dir):
    values = [-3, 0, 1, 2, 5, 6, 199, 200, 1500, 8000, 8001, None]
    return spark.createDataFrame([(x, clamp_depth(x), resolve_depth(x), resolve_top_k(x), resolve_budget(x)) for x in values], "x int, clamped int, depth int, top_k int, budget int")


@query("SELECT t AS target, f AS is_file FROM (VALUES ('a.py', true), ('a/b', true), ('a.b', false), ('load', false), ('a.tsx', true), ('a\\b', true), ('py', false)) AS v(t, f)")
def file_targets(spark, sf_dir):
    return spark.createDataFrame([(t, is_file_target(t)) for t in ("a.py", "a/b", "a.b", "load", "a.tsx", "a\\b", "py")], "target string, is_file boolean")


# --- map and scalars ------------------------------------------------------------------------

_MAP = f""", lines AS (
  SELECT file, rank, 0 AS is_symbol, 0 AS line, 0 AS ord, file AS text FROM (SELECT DISTINCT file FROM symbols) JOIN ranked ON node = file
  UNION ALL SELECT file, rank, 1, line, ord, '  ' || line || '  ' || kind || '  ' || name || coalesce('  ' || signature, '') FROM symbols JOIN ranked ON node = file),
costs AS (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) + 1 AS cost FROM lines),
sums AS (SELECT *, CAST(sum(cost) OVER (ORDER BY rank DESC, file, is_symbol, line, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM costs)"""


@query(_with(f"SELECT file, is_symbol, line, text, cost, total FROM sums WHERE total <= {MAP_BUDGET}", _rank_sql(_FILE_NODES, _FILE_LINKS) + _MAP))
def map_budget(spark, sf_dir):
    lines = search.map_lines(*_read(spark, sf_dir, "symbols", "ranks"))
    return search.fill_budget(lines, MAP_BUDGET).select("file", "is_symbol", "line", "text", "cost", "total")


@query("SELECT doc_id, CAST(ceil((length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]'))) / 4.0) AS BIGINT) + 1 AS cost FROM documents")
def token_cost_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", token_cost("text").alias("cost"))


@query("SELECT doc_id, sha1(text) AS hash FROM documents")
def sha1_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha1("text").alias("hash"))


@query(_with("SELECT path, contains(path, 'test_') OR contains(path, 'tests/') OR ends_with(path, '_test.py') AS is_test FROM paths"))
def test_files(spark, sf_dir):
    return g.index(spark, sf_dir).read("files").select("path", is_test_file("path").alias("is_test"))


# --- parsers: small sources with known results ----------------------------------------------

SOURCES = {
    "parse_python": ("a.py", "python", "import os\nfrom .b import c\n\nclass K:\n    def m(self):\n        return run(os.getcwd())\n\ndef f():\n    g(); g()\n", [("symbol", "K", "class", 4), ("symbol", "m", "method", 5), ("symbol", "f", "function", 8), ("import", "os", "", 0), ("import", ".b", "", 0), ("call", "m", "run", 0), ("call", "m", "getcwd", 0), ("call", "f", "g", 0)]),
    "parse_ts": ("a.ts", "typescript", "import { x } from './x';\nexport class K {\n  m(): void { x(); }\n}\nconst f = (a: number) => this.go(a);\n", [("symbol", "K", "class", 2), ("symbol", "m", "method", 3), ("symbol", "f", "function", 5), ("import", "./x", "", 0), ("call", "m", "x", 0), ("call", "f", "go", 0)]),
    "parse_go": ("a.go", "go", 'package p\n\nimport "fmt"\n\ntype K struct{ n int }\n\nfunc (k *K) M() { fmt.Print(k.n) }\n\nfunc f() { g() }\n', [("symbol", "K", "class", 5), ("symbol", "M", "method", 7), ("symbol", "f", "function", 9), ("import", "fmt", "", 0), ("call", "M", "Print", 0), ("call", "f", "g", 0)]),
    "parse_java": ("A.java", "java", "import java.util.List;\n\npublic class A {\n    int m(int x) { return g(new B(x)); }\n}\n", [("symbol", "A", "class", 3), ("symbol", "m", "method", 4), ("import", "java.util.List", "", 0), ("call", "m", "g", 0), ("call", "m", "B", 0)]),
    "parse_tsx": ("a.tsx", "tsx", "import React from 'react';\nexport function App() {\n  return <div a={g(1)}>{h(`z ${k()}`)}</div>;\n}\n", [("symbol", "App", "function", 2), ("import", "react", "", 0), ("call", "App", "g", 0), ("call", "App", "h", 0), ("call", "App", "k", 0)]),
    "parse_python_nested": ("a.py", "python", "@wrap(1)\nasync def f(a: int = d()) -> None:\n    def inner():\n        return a.b.c(x())\n    return inner()\n\nclass K(Base):\n    @property\n    def p(self):\n        return [q(i) for i in self.r()]\n", [("symbol", "f", "function", 2), ("symbol", "inner", "function", 3), ("symbol", "K", "class", 7), ("symbol", "p", "method", 9), ("call", "f", "inner", 0), ("call", "inner", "c", 0), ("call", "inner", "x", 0), ("call", "p", "q", 0), ("call", "p", "r", 0)]),
    "parse_python_errors": ("a.py", "python", "def f(x=(1\n\ndef g(): return h(a)\nclass K: pass\n  def m(self): k(); l()\n", [("symbol", "f", "function", 1), ("symbol", "g", "function", 3), ("symbol", "K", "class", 4), ("symbol", "m", "method", 5), ("call", "g", "h", 0), ("call", "m", "k", 0), ("call", "m", "l", 0)]),
    "parse_ts_names": ("a.ts", "typescript", "const a = 1, b = () => { run(); }, c = (x: number) => go(x);\nclass K {\n  static async m() { await this.n(); }\n}\nexport default function main() { new K(); b?.(); }\n", [("symbol", "b", "function", 1), ("symbol", "c", "function", 1), ("symbol", "K", "class", 2), ("symbol", "m", "method", 3), ("symbol", "main", "function", 5), ("call", "b", "run", 0), ("call", "c", "go", 0), ("call", "m", "n", 0), ("call", "main", "b", 0)]),
    "parse_go_types": ("a.go", "go", 'package p\n\nimport (\n\t"fmt"\n\tu "x/util"\n)\n\ntype (\n\tA struct{ n int }\n\tB interface{ M() }\n)\n\nfunc (a A) M() {\n\tgo func() { u.Run() }()\n\tdefer fmt.Println(len(x))\n}\n', [("symbol", "A", "class", 9), ("symbol", "B", "class", 10), ("symbol", "M", "method", 13), ("import", "fmt", "", 0), ("import", "x/util", "", 0), ("call", "M", "Run", 0), ("call", "M", "Println", 0), ("call", "M", "len", 0)]),
    "parse_java_enum": ("E.java", "java", "enum E {\n  A { int m() { return f(); } },\n  B(g(1)) { void k() { h(); } };\n  void n() { q(); }\n}\n", [("symbol", "E", "class", 1), ("symbol", "m", "method", 2), ("symbol", "k", "method", 3), ("symbol", "n", "method", 4), ("call", "m", "f", 0), ("call", "k", "h", 0), ("call", "n", "q", 0)]),
}


def _parse(path: str, lang: str, text: str) -> Query:
    def run(spark, _):
        p = parse_sources(spark.createDataFrame([(path, text, lang)], "path string, content string, lang string"))
        out = p.select(F.lit("symbol").alias("section"), F.explode("symbols").alias("s")).select("section", "s.name", F.col("s.kind").alias("detail"), F.col("s.line").alias("line"))
        out = out.union(p.select(F.lit("import"), F.explode("imports"), F.lit(""), F.lit(0)))
        return out.union(p.select(F.lit("call"), F.explode("calls").alias("c")).select("call", "c.caller", "c.callee", F.lit(0)))

    return run


for _name, (_path, _lang, _text, _rows) in SOURCES.items():
    _values = ", ".join(f"('{a}', '{b}', '{c}', CAST({d} AS INTEGER))" for a, b, c, d in _rows)
    query(f"SELECT * FROM (VALUES {_values}) AS t(section, name, detail, line)", _name)(_parse(_path, _lang, _text))
