"""Indexing of real trees, the store, the tools and the streaming feed."""

import os

import pytest
from pyspark.errors import PySparkException

from loomgraph.operators import parse
from loomgraph.operators.parse import register_functions
from loomgraph.plans import tools
from loomgraph.plans.index import CodeIndex, MissingIndex
from loomgraph.sources.snapshots import POINTER, ConflictingWrite, CorruptIndex, open_store
from loomgraph.sources.tree import read_tree, scan_source_files
from loomgraph.streaming.feed import follow


def put(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


TREE = {
    "hub.py": "def hub():\n    return leaf()\n",
    "leaf.py": "def leaf():\n    pass\n",
    "pkg/__init__.py": "",
    "pkg/_use.py": "import hub\nfrom . import x\ndef use():\n    hub()\n",
    "tests/test_use.py": "from pkg._use import use\ndef test_use():\n    use()\n",
    "util.ts": "export function util(): void {}\n",
    "app.ts": "import { util } from './util';\nfunction app() { util(); }\n",
    "m.go": "package m\n\nfunc Go() { Run() }\n",
    "J.java": "class J { void jay() {} }\n",
    "vendor/no.py": "def no(): pass\n",
    "node_modules/no.ts": "function no() {}\n",
    "notes.txt": "def no(): pass\n",
}


@pytest.fixture()
def tree(tmp_path):
    put(tmp_path, TREE)
    return tmp_path


def snapshot(index):
    return {n: sorted(map(tuple, index.table(n).drop("ord").collect()), key=repr) for n in ("files", "symbols", "edges", "imports", "calls")}


def test_scan(spark, tree):
    os.symlink(tree / "hub.py", tree / "link.py")
    got = {r["path"]: r for r in read_tree(spark, str(tree), 2).collect()}
    assert sorted(got) == sorted(k for k in TREE if not k.startswith(("vendor", "node_modules", "notes")))
    assert got["m.go"]["lang"] == "go" and len(got["m.go"]["hash"]) == 40 and scan_source_files(str(tree / "nowhere")) == []


def test_index_and_queries(spark, tree):
    index = CodeIndex(spark, str(tree))
    with pytest.raises(MissingIndex):
        index.find("x")
    assert tools.code_find(index, "x").startswith("No index")
    first = index.reindex()
    assert (first.files, first.symbols) == (9, 9)
    assert index.reindex().files == 0
    edges = {(r["caller_file"], r["caller_symbol"], r["callee_name"], r["callee_file"]) for r in index.table("edges").collect()}
    assert {("pkg/_use.py", None, "hub", "hub.py"), ("pkg/_use.py", None, ".", "pkg/__init__.py"), ("app.ts", None, "./util", "util.ts"), ("app.ts", "app", "util", "util.ts"), ("tests/test_use.py", None, "pkg._use", "pkg/_use.py"), ("hub.py", "hub", "leaf", "leaf.py")} <= edges
    assert tools.code_trace(index, "leaf", depth=9).split("\n") == ["1  call  hub.py  hub", "2  call  pkg/_use.py  use", "2  import  pkg/_use.py", "3  call  tests/test_use.py  test_use"] or tools.code_trace(index, "leaf", depth=9).split("\n")[1] == "2  import  pkg/_use.py"
    assert tools.code_trace(index, "use", "callees").split("\n") == ["1  call  hub.py  hub", "2  call  leaf.py  leaf"]
    assert tools.code_impact(index, "leaf.py", 5).split("\n")[-2:] == ["Tests:", "test:tests/test_use.py"]
    assert tools.code_find(index, "u", top_k=1).split("\n") == [tools.code_find(index, "u").split("\n")[0]]
    assert tools.code_find(index, "zzz").startswith('No symbol "zzz"')
    assert tools.code_map(index).startswith("Map: 8 files / 9 symbols") and "leaf.py" in tools.code_map(index)
    report = {r["check"]: (r["status"], r["detail"]) for r in index.doctor().collect()}
    assert report["index"][0] == "OK" and report["freshness"][0] == "FRESH" and report["languages"][1] == "go 1, java 1, py 5, ts 2" and ".gitignore" not in report
    (tree / ".git").mkdir()
    (tree / "later.py").write_text("")
    report = {r["check"]: r["status"] for r in index.doctor(lambda n: (_ for _ in ()).throw(ImportError("gone")) if n == "numpy" else None).collect()}
    assert report["freshness"] == "STALE" and report[".gitignore"] == "WARN" and report["dependency numpy"] == "FAIL" and report["dependency pyspark"] == "OK"


def test_incremental_is_like_new(spark, tree, tmp_path_factory):
    index = CodeIndex(spark, str(tree))
    index.reindex()
    put(tree, {"other.py": "def leaf():\n    pass\n", "hub.py": "def hub():\n    return 1\n"})
    (tree / "util.ts").unlink()
    assert index.reindex().files == 2
    fresh = CodeIndex(spark, str(tree), folder=f"file://{tmp_path_factory.mktemp('fresh')}/index")
    fresh.reindex()
    assert snapshot(index) == snapshot(fresh)
    index.store.vacuum()
    assert snapshot(index) == snapshot(fresh)


def test_compat_keeps_what_is_gone(spark, tree):
    index = CodeIndex(spark, str(tree), compat=True)
    index.reindex()
    (tree / "util.ts").unlink()
    index.reindex()
    assert "util.ts" in {r["path"] for r in index.table("files").collect()}


def test_corrupt_index(spark, tree):
    index = CodeIndex(spark, str(tree))
    index.reindex()
    (tree / ".loomgraph" / POINTER.format(1)).write_text("no json")
    assert {r["check"]: r["status"] for r in index.doctor().collect()}["index"] == "CORRUPT"
    assert "damaged index" in tools.code_find(index, "x") and "damaged index" in tools.reindex(index)
    with pytest.raises(CorruptIndex):
        open_store(spark, index.store.folder)


def test_store(spark, tmp_path):
    store = open_store(spark, f"file://{tmp_path}/store")
    assert store.get_all_edges().collect() == []
    store.upsert_file("/keep", "h1")
    store.upsert_file("/stale", "h1")
    store.upsert_file("/stale", "h2")
    assert store.get_files_changed([("/new", "x"), ("/keep", "h1"), ("/stale", "h3")]) == ["/new", "/stale"]
    store.upsert_symbols("/a.py", [("f", "function", 1, None), ("g", "class", 2, "class g:")])
    store.upsert_symbols("/b.py", [("f", "method", 1, "s")])
    store.upsert_symbols("/a.py", [("f", "function", 5, None)])
    assert [(r["file"], r["line"], r["signature"]) for r in store.find_symbols("f").collect()] == [("/a.py", 5, None), ("/b.py", 1, "s")]
    assert [r["file"] for r in store.find_symbols("F", "prefix", "method").collect()] == ["/b.py"]
    store.upsert_edges("/a.py", [(None, "x", "/b.py", "import", "high"), (None, "y", None, "import", "high"), ("f", "f", "/b.py", "call", "low")])
    store.upsert_edges("/b.py", [("f", "x", "/b.py", "call", "low")])
    n = lambda df: len(df.collect())
    assert (n(store.get_edges_from_file("/a.py")), n(store.get_edges_from(["/a.py", "/b.py"])), n(store.get_edges_from([])), n(store.get_edges_to_name("x")), n(store.get_edges_to_file("/b.py"))) == (3, 4, 0, 2, 3)
    for bad, run in (("invalid kind: module", lambda: store.upsert_symbols("/a.py", [("m", "module", 1, None)])), ("invalid edge kind: inherits", lambda: store.upsert_edges("/a.py", [(None, "x", None, "inherits", "high")])), ("invalid confidence: maybe", lambda: store.upsert_edges("/a.py", [(None, "x", None, "import", "maybe")]))):
        with pytest.raises(PySparkException, match=bad):
            run()
    assert n(store.get_edges_from_file("/a.py")) == 3 and n(store.find_symbols("f")) == 2


def test_table_function(spark):
    register_functions(spark)
    spark.createDataFrame([("def f():\n    g()\n", "python"), (None, "go")], "content string, lang string").createOrReplaceTempView("sources")
    got = spark.sql("SELECT section, name, callee FROM sources, LATERAL analyze_source(content, lang)").collect()
    assert {tuple(r) for r in got} == {("symbol", "f", None), ("call", "f", "g")}


def test_stream(spark, tmp_path):
    feed, index = tmp_path / "feed", CodeIndex(spark, str(tmp_path), folder=f"file://{tmp_path}/index")
    feed.mkdir()
    stream = spark.readStream.schema("path string, content string").json(str(feed))

    def send(name, *changes):
        spark.createDataFrame(list(changes), "path string, content string").coalesce(1).write.mode("append").json(str(feed))
        follow(index, stream, f"{tmp_path}/check").awaitTermination()

    send(1, ("a.py", "def a():\n    b()\n"), ("b.py", "def b():\n    pass\n"))
    assert [r["callee_file"] for r in index.table("edges").collect()] == ["b.py"]
    send(2, ("b.py", None), ("c.py", "def b():\n    pass\n"))
    assert [r["callee_file"] for r in index.table("edges").collect()] == ["c.py"] and {r["path"] for r in index.table("files").collect()} == {"a.py", "c.py"}


def versions(tree):
    return sorted(p.name for p in (tree / ".loomgraph").iterdir() if p.name.startswith("v-"))


def pointers(tree):
    return sorted(p.name for p in (tree / ".loomgraph").iterdir() if p.name.startswith("CURRENT"))


def test_a_run_without_changes_writes_nothing(spark, tree):
    index = CodeIndex(spark, str(tree))
    index.reindex()
    before = versions(tree), pointers(tree)
    again = index.reindex()
    assert (again.files, again.symbols) == (0, 9)
    assert (versions(tree), pointers(tree)) == before


def test_readers_see_all_of_a_write_or_none(spark, tree):
    index = CodeIndex(spark, str(tree))
    index.reindex()
    before = snapshot(index)
    draft = index.store.draft()
    draft.write("symbols", index.table("symbols").limit(0))
    draft.write("edges", index.table("edges").limit(0))
    assert snapshot(index) == before
    draft.commit()
    assert index.table("symbols").isEmpty()
    assert index.table("edges").isEmpty()
    assert index.table("files").count() == 9


def test_the_second_of_two_writers_fails(spark, tree):
    index = CodeIndex(spark, str(tree))
    index.reindex()
    one, two = index.store.draft(), index.store.draft()
    one.write("files", index.table("files").filter("path <> 'hub.py'"))
    two.write("files", index.table("files").limit(0))
    one.commit()
    with pytest.raises(ConflictingWrite):
        two.commit()
    assert index.table("files").count() == 8


def test_old_versions_go(spark, tree):
    index = CodeIndex(spark, str(tree))
    for k in range(4):
        put(tree, {"hub.py": f"def hub():\n    return {k}\n"})
        index.reindex()
    assert pointers(tree) == [POINTER.format(3), POINTER.format(4)]
    assert len(versions(tree)) == 2
    (tree / ".loomgraph" / "v-left").mkdir()
    index.store.vacuum()
    assert "v-left" in versions(tree)
    index.store.vacuum(orphans=True)
    assert len(versions(tree)) == 2


@pytest.mark.parametrize("harm", ["values", "lost"])
def test_a_full_check_reads_every_value(spark, tree, harm):
    index = CodeIndex(spark, str(tree))
    index.reindex()
    index.store.check(full=True)
    at = tree / ".loomgraph" / index.store.pointer()["symbols"]["at"]
    part = max(at.glob("part-*.parquet"), key=lambda p: p.stat().st_size)
    if harm == "lost":
        part.unlink()
    else:
        data = bytearray(part.read_bytes())
        data[4:60] = bytes(56)
        part.write_bytes(bytes(data))
    for crc in at.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(CorruptIndex):
        index.store.check(full=True)
    assert {r["check"]: r["status"] for r in index.doctor().collect()}["index"] == "CORRUPT"


def test_folders_to_skip_are_an_option(tree):
    put(tree, {"gen/a.py": "x = 1\n", "vendor/b.py": "x = 1\n"})
    assert any(p.endswith("gen/a.py") for p in scan_source_files(str(tree)))
    assert not any("/gen/" in p or "/vendor/" in p for p in scan_source_files(str(tree), ("gen",)))


def test_a_file_that_a_parser_fails_on_has_a_mark(monkeypatch):
    def fail(*_):
        raise RecursionError("too deep")

    assert parse.parse_one("def f():\n    pass\n", "python")["error"] is None
    monkeypatch.setattr(parse, "analyze", fail)
    assert parse.parse_one("x", "python") == {"symbols": [], "imports": [], "calls": [], "error": "RecursionError: too deep"}
    assert parse.parse_one("x", None)["error"] is None


def test_trees_are_read_through_their_file_system(spark, tree):
    rows = lambda root: sorted(tuple(r) for r in read_tree(spark, root).collect())
    assert rows(f"file://{tree}") == rows(str(tree))
    assert CodeIndex(spark, f"file://{tree}").reindex().files == 9
    assert CodeIndex(spark, str(tree)).reindex().files == 0
