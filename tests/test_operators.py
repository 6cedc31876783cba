"""Operators on small tables with known results, and against plain Python on random graphs."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions import text
from loomgraph.operators import rank, resolve, search, trace


def symbols_df(spark, rows):
    return spark.createDataFrame([(n, k, line, s, f, i) for i, (n, k, line, s, f) in enumerate(rows)], schema.SYMBOLS)


def edges_df(spark, rows):
    return spark.createDataFrame([(*r, "high" if r[4] == "import" else "low", i) for i, r in enumerate(rows)], schema.EDGES)


def call(f, a, b, g):
    return f, a, b, g, "call"


def imp(f, ref, g):
    return f, None, ref, g, "import"


BASE_S = [(n, "function", 1, f"def {n}():", f"/{n}.py") for n in "abc"] + [("d", "function", 1, None, "/d.py")]
BASE_E = [call("/a.py", "a", "b", "/b.py"), call("/b.py", "b", "c", "/c.py"), imp("/a.py", "d", "/d.py")]


@pytest.fixture(scope="module")
def base(spark):
    return symbols_df(spark, BASE_S).cache(), edges_df(spark, BASE_E).cache()


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_traces(spark, base):
    s, e = base
    assert rows(trace.trace_callers(s, e, "c"), "symbol", "depth") == [("b", 1), ("a", 2)]
    assert rows(trace.trace_callers(s, e, "c", 1), "symbol", "depth") == [("b", 1)]
    assert rows(trace.trace_callees(s, e, "a"), "symbol", "depth") == [("b", 1), ("c", 2)]
    assert rows(trace.trace_callers(s, e, "nowhere"), "symbol") == []
    assert rows(trace.trace_callees(s, e, "nowhere"), "symbol") == []
    for f in (trace.trace_callers, trace.trace_callees):
        assert rows(f(s, e, "a", 0), "file", "symbol", "via", "depth") == [("/a.py", "a", "call", 0)]


def test_import_climbs_to_the_symbols_of_its_file(spark, base):
    s = base[0].union(symbols_df(spark, [("helper", "function", 9, None, "/a.py"), ("y", "function", 1, None, "/y.py")]))
    e = base[1].union(edges_df(spark, [call("/y.py", "y", "helper", "/a.py")]))
    assert rows(trace.trace_callers(s, e, "d"), "file", "symbol", "via", "depth") == [("/a.py", None, "import", 1), ("/y.py", "y", "call", 2)]


def test_cycles_chains_and_fallback(spark):
    s = symbols_df(spark, [("m", "function", 1, None, "/m.py"), ("n", "function", 1, None, "/n.py")])
    e = edges_df(spark, [call("/m.py", "m", "n", "/n.py"), call("/n.py", "n", "m", "/m.py")])
    assert rows(trace.trace_callers(s, e, "m", 99), "symbol", "depth") == [("n", 1), ("m", 2)]
    assert rows(trace.trace_callees(s, e, "m", 99), "symbol", "depth") == [("n", 1)]
    names = "abcdefg"
    s = symbols_df(spark, [(x, "function", 1, None, f"/{x}.py") for x in names])
    e = edges_df(spark, [call(f"/{x}.py", x, y, f"/{y}.py") for x, y in zip(names, names[1:])])
    assert len(rows(trace.trace_callees(s, e, "a", 99), "symbol")) == 5 == len(rows(trace.trace_callers(s, e, "g", 99), "symbol"))
    s = symbols_df(spark, [(n, "function", 1, None, f) for n, f in (("a", "/a.py"), ("b", "/b.py"), ("u", "/x.py"), ("u", "/y.py"))])
    e = edges_df(spark, [call("/a.py", "a", "u", None), call("/a.py", "a", "b", None)])
    assert rows(trace.trace_callees(s, e, "a"), "file", "symbol") == [("/b.py", "b")]


def test_impact(spark, base):
    s = base[0].union(symbols_df(spark, [("test_x", "function", 1, None, "/tests/test_x.py")]))
    e = base[1].union(edges_df(spark, [call("/tests/test_x.py", "test_x", "b", "/b.py")]))

    def by(df):
        out = collections.defaultdict(list)
        for r in df.collect():
            out[r["section"]].append(r["value"])
        return out

    got = by(trace.impact(s, e, file="/b.py", symbol="b"))
    assert len(got["files"]) == 5 and got["symbols"] == ["a", "b", "c", "test_x"] and got["tests"] == ["/tests/test_x.py"]
    got = by(trace.impact(*base, file="/a.py"))
    assert got["files"] == ["/a.py", "/b.py", "/c.py", "/d.py"] and got["symbols"] == ["a", "b", "c"]
    got = by(trace.impact(*base, symbol="b", depth=0))
    assert got["files"] == ["/b.py"] and not got["symbols"]


def brute_callers(symbols, edges, name, depth):
    found, queued, todo = {}, {name}, [(name, 0)]
    for n, d in todo:
        if d == depth:
            continue
        for f, who, callee, _, kind in edges:
            if callee != n:
                continue
            node = (f, who if kind == "call" else None)
            if node not in found:
                found[node] = d + 1
                for m in [node[1]] if node[1] else [x[0] for x in symbols if x[4] == f]:
                    if m not in queued:
                        queued.add(m)
                        todo.append((m, d + 1))
    return {(*k, v) for k, v in found.items()}


def brute_callees(symbols, edges, name, depth):
    start = min(((x[4], x[2]) for x in symbols if x[0] == name), default=None)
    if start is None:
        return set()
    found, seen, todo = {}, {(start[0], name)}, [(start[0], 0)]
    for f, d in todo:
        if d == depth:
            continue
        for g, _, callee, target, kind in edges:
            if g == f and kind == "call" and (target, callee) not in seen:
                seen.add((target, callee))
                found[(target, callee)] = d + 1
                todo.append((target, d + 1))
    return {(*k, v) for k, v in found.items()}


def test_traces_on_random_graphs(spark):
    r = random.Random(5)
    for _ in range(2):
        symbols = [(f"f{i}", "function", i % 3, None, f"/m{r.randrange(6)}.py") for i in range(18)]
        home = {s[0]: s[4] for s in symbols}
        edges = []
        for _ in range(25):
            a, b = r.choice(symbols), r.choice(symbols)
            edges.append(call(a[4], a[0], b[0], home[b[0]]) if r.random() < 0.75 else imp(a[4], b[0], b[4]))
        s, e = symbols_df(spark, symbols).cache(), edges_df(spark, edges).cache()
        for name in ("f1", "f7"):
            assert set(rows(trace.trace_callers(s, e, name, 3), "file", "symbol", "depth")) == brute_callers(symbols, edges, name, 3)
            assert set(rows(trace.trace_callees(s, e, name, 3), "file", "symbol", "depth")) == brute_callees(symbols, edges, name, 3)


def links(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, names):
    return spark.createDataFrame([(x,) for x in names], "node string")


def test_page_rank(spark):
    def ranks(names, pairs, **o):
        return {r["node"]: r["rank"] for r in rank.page_rank(nodes(spark, names), links(spark, pairs), **o).collect()}

    got = ranks("abcd", [("a", "b"), ("b", "c"), ("c", "a")])
    assert np.isclose(sum(got.values()), 1) and np.isclose(got["a"], got["b"]) and np.isclose(got["b"], got["c"]) and got["c"] > got["d"]
    got = ranks("a", [("a", "b"), ("a", "c")])
    assert np.isclose(sum(got.values()), 1) and np.isclose(got["b"], got["c"]) and got["b"] > 0
    got = ranks("", [("src", "hub"), ("src", "hub"), ("src", "other"), ("peer", "hub"), ("peer", "other")])
    assert got["hub"] > got["other"]
    assert rank.page_rank(nodes(spark, ""), links(spark, [])).collect() == []
    r = random.Random(1)
    pairs = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(90)]
    one, two = ranks(["x"], pairs), ranks(["x"], pairs, kernel_links=0)
    assert one.keys() == two.keys() and all(np.isclose(one[k], two[k], atol=1e-12) for k in one)


CALC = [("calculate", "function", 10, "def calculate(a)", "/calc.py"), ("calc", "function", 20, None, "/calc.py"), ("Calculator", "class", 30, "class Calculator:", "/calc.py"), ("calc_total", "method", 40, "def calc_total", "/calc.py"), ("recalculate", "function", 1, None, "/other.py"), ("Écalc", "function", 2, None, "/other.py"), ("unrelated", "function", 3, None, "/other.py")]


def test_find(spark):
    s = symbols_df(spark, CALC)
    n = lambda m, q, k=None: [r["name"] for r in search.find_symbols(s, q, m, k).collect()]
    assert n("exact", "calc") == ["calc"] and len(n("prefix", "calc")) == 4 and n("prefix", "calc_") == ["calc_total"]
    assert len(n("substring", "CALC")) == 6 and n("prefix", "calc", "class") == ["Calculator"] and n("prefix", "écalc") == []
    with pytest.raises(ValueError, match="invalid mode: EXACT"):
        n("EXACT", "x")
    none = spark.createDataFrame([], schema.RANKS)
    found = search.find_ranked(s, none, "calc")
    assert rows(found, "name") == [(x,) for x in ("calc", "calculate", "Calculator", "calc_total", "recalculate", "Écalc")]
    assert rows(search.find_lines(found), "text")[0] == ("/calc.py:20  function  calc",)
    assert search.find_ranked(s, none, "").collect() == [] and len(search.find_ranked(s, none, "calc", top_k=2).collect()) == 2
    ranks = spark.createDataFrame([("/other.py", 0.9), ("/calc.py", 0.1)], schema.RANKS)
    assert rows(search.find_ranked(s, ranks, "cal"), "name")[:1] == [("calculate",)] and rows(search.find_ranked(s, ranks, "ecalc", kind="function"), "name") == [("recalculate",)]
    twice = s.union(symbols_df(spark, CALC[:1]))
    assert len(search.find_ranked(twice, none, "calculate").collect()) == 2


def test_budget_is_the_greedy_fill(spark):
    s = symbols_df(spark, [(f"name_{i % 7}😀", "function", i, "x" * (i % 11) if i % 4 else None, f"/f{i % 5}.py") for i in range(60)])
    ranks = spark.createDataFrame([(f"/f{i}.py", [0.2, 0.5, 0.2, 0.1, 0.0][i]) for i in range(4)], schema.RANKS)
    lines = search.map_lines(s, ranks)
    for budget in (1, 40, 200, 10_000):
        want, used = [], 0
        for r in lines.orderBy(F.desc("rank"), "file", "is_symbol", "line", "ord").collect():
            cost = -(-len(r["text"].encode("utf-16-le")) // 2 // 4) + 1
            assert cost == r["cost"]
            if used + cost > budget:
                break
            used += cost
            want.append(r["text"])
        got = search.fill_budget(lines, budget).collect()
        assert [r["text"] for r in got] == want and all(r["truncated"] == (len(want) < 65) for r in got)


PATHS = ["a.py", "pkg/mod.py", "pkg/other.py", "pkg/sibling.py", "pkg_top/mod.py", "deep/__init__.py", "src/util.ts", "src/view/index.tsx", "lib/x.ts", "x.y/z.py", "pkg/x.ts"]


def resolved(spark, cases, compat=False):
    imports = spark.createDataFrame([(f, None, ref, i) for i, (f, ref) in enumerate(cases)], schema.IMPORTS)
    out = resolve.resolve_imports(imports, spark.createDataFrame([(p,) for p in PATHS], "path string"), compat)
    return [r["callee_file"] for r in out.orderBy("ord").collect()]


def test_imports(spark):
    cases = [("a.py", "os"), ("a.py", "pkg.mod"), ("a.py", "external.lib"), ("pkg/a.py", ".sibling"), ("pkg/a.py", "..pkg_top.mod"), ("a.py", "deep"), ("a.py", "..up"), ("a.py", "."), ("deep/a.py", "."), ("x.y/a.py", ".z"), ("m.go", "fmt"), ("M.java", "java.util.List"), ("pkg/a.py", "...x")]
    assert resolved(spark, cases) == [None, "pkg/mod.py", None, "pkg/sibling.py", "pkg_top/mod.py", "deep/__init__.py", None, None, "deep/__init__.py", "x.y/z.py", None, None, None]
    assert resolved(spark, [("x.y/a.py", ".z")], compat=True) == [None]
    ts = [("src/a.ts", "./util"), ("src/a.tsx", "./view"), ("pkg/a.ts", "../lib/x"), ("src/a.ts", "util"), ("src/a.ts", "./util.ts"), ("src/a.ts", "../../x"), ("src/deep/a.ts", "../util")]
    assert resolved(spark, ts) == ["src/util.ts", "src/view/index.tsx", "lib/x.ts", None, None, None, "src/util.ts"]
    assert resolved(spark, [("pkg/a.ts", "../lib/x")], compat=True) == ["pkg/x.ts"]


def test_calls(spark):
    s = symbols_df(spark, [("one", "function", 1, None, "b.py"), ("two", "function", 1, None, "b.py"), ("two", "class", 1, None, "c.py"), ("own", "function", 1, None, "a.py")])
    calls = spark.createDataFrame([("a.py", "f", c, i) for i, c in enumerate(("one", "two", "none", "own"))] + [("a.py", "own", "own", 9)], schema.CALLS)
    assert {(r["caller_symbol"], r["callee_name"], r["callee_file"]) for r in resolve.resolve_calls(calls, s).collect()} == {("f", "one", "b.py"), ("f", "own", "a.py")}
    assert {r["name"] for r in resolve.ambiguous_names(s).collect()} == {"two"}
    assert {r["callee"] for r in resolve.unresolved_calls(calls, s).collect()} == {"two", "none"}


def test_scalars(spark):
    assert [text.clamp_depth(x) for x in (-1, 0, 2, 9, None)] == [0, 0, 2, 5, 2] and [text.resolve_depth(x) for x in (0, 1.9, 99, "x", float("nan"), None)] == [1, 1, 5, 2, 2, 2]
    assert [text.resolve_top_k(x) for x in (0, 2.5, None)] == [1, 2, 20] and [text.resolve_budget(x) for x in (1, 500.5, 1e9, None)] == [200, 500, 8000, 1500]
    assert [text.is_file_target(x) for x in ("a.py", "a/b", "a\\b", "name", "a.rs")] == [True, True, True, False, False]
    assert [text.lang_from_path(x) for x in ("a.py", "a.tsx", "a.PY", "a")] == ["python", "tsx", None, None]
    names = ["latest_x.py", "contests/a.py", "a_test.go", "a.test.ts", "x/test_a.py", "b_test.py"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, p string")
    assert [r[0] for r in df.orderBy("i").select(text.is_test_file("p")).collect()] == [True, True, False, False, True, True]
    order = spark.createDataFrame([(x,) for x in ("b", "B", "a_b", "a1", "Ab")], "x string")
    assert [r[0] for r in order.orderBy(text.ordered("x", "UNICODE")).collect()] == ["a_b", "a1", "Ab", "b", "B"]
