"""CodeIndex: indexing of a source tree, and the queries over the result."""

from __future__ import annotations

import importlib.util
import os
import sys
import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions.text import language_label
from loomgraph.operators.parse import calls_of, imports_of, parse_sources, symbols_of
from loomgraph.operators.rank import file_ranks
from loomgraph.operators.resolve import build_edges, changed_files, replace_rows
from loomgraph.operators.search import fill_budget, find_ranked, map_lines
from loomgraph.operators.trace import impact, trace_callees, trace_callers
from loomgraph.sources.snapshots import CorruptIndex, Store
from loomgraph.sources.tree import read_tree, scan_source_files

INDEX = ".loomgraph"


@dataclass(frozen=True)
class Indexed:
    """files: parsed in this run; symbols: of the whole index; ms: time taken."""

    files: int
    symbols: int
    ms: int


class MissingIndex(Exception):
    """There is no index yet."""


class CodeIndex:
    """root: folder of sources, a path or a URI; folder: of the index, by default below root.  compat keeps old
    behaviour: vanished files stay, unchanged files keep their edges, and paths resolve as before."""

    def __init__(self, spark: SparkSession, root: str, folder: str | None = None, compat: bool = False):
        remote = "://" in root
        self.spark, self.root, self.compat = spark, root.rstrip("/") if remote else os.path.abspath(root), compat
        self.store = Store(spark, folder or f"{'' if remote else 'file://'}{self.root}/{INDEX}")

    # --- indexing

    def reindex(self, sources: DataFrame | None = None) -> Indexed:
        """Parses what is new or changed and resolves all edges again, so that a run on an old index
        gives what a run on none would; all tables change at once.  Without changes nothing is
        written.  sources: path, content, lang, hash; by default the tree."""
        began = time.time()
        self.store.check()
        old = {n: self.store.read(n) for n in schema.TABLES}
        # one walk and one read of the contents feed the comparison and the parsers
        disk = (sources if sources is not None else read_tree(self.spark, self.root)).persist(StorageLevel.MEMORY_AND_DISK)
        changed = changed_files(disk.select("path", "hash", "content", "lang"), old["files"])
        here, touched = disk.select("path"), changed.select("path")
        parsed = parse_sources(changed).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if self.store.exists():
                gone = old["files"].join(here, "path", "left_anti") if not self.compat else old["files"].limit(0)
                if touched.union(gone.select("path")).isEmpty():
                    return Indexed(0, self.store.rows("symbols"), int(1000 * (time.time() - began)))
            draft = self.store.draft()
            files = replace_rows(old["files"], changed.select("path", "hash"), touched, "path")
            symbols = replace_rows(old["symbols"], schema.guard_symbols(symbols_of(parsed)), touched, "file")
            imports = replace_rows(old["imports"], imports_of(parsed), touched, "file")
            calls = replace_rows(old["calls"], calls_of(parsed), touched, "file")
            if not self.compat:  # files that are gone go from the index
                keep = lambda df, c: df.join(here.select(F.col("path").alias(c)), c, "left_semi").select(df.columns)
                files, symbols, imports, calls = keep(files, "path"), keep(symbols, "file"), keep(imports, "file"), keep(calls, "file")
            symbols, imports, calls = draft.write("symbols", symbols), draft.write("imports", imports), draft.write("calls", calls)
            if self.compat:
                mine = lambda df: df.join(touched.select(F.col("path").alias("file")), "file", "left_semi")
                new = build_edges(mine(imports), mine(calls), symbols, here, compat=True)
                edges = replace_rows(old["edges"], new.select(old["edges"].columns), touched, "caller_file")
            else:
                edges = build_edges(imports, calls, symbols, files.select("path"))
            edges = draft.write("edges", schema.guard_edges(edges))
            draft.write("ranks", file_ranks(symbols, edges))
            draft.write("files", files)
            draft.commit()
            self.store.vacuum()
            return Indexed(parsed.count(), self.store.rows("symbols"), int(1000 * (time.time() - began)))
        finally:
            parsed.unpersist()
            disk.unpersist()

    # --- queries

    def table(self, name: str) -> DataFrame:
        if not self.store.exists():
            raise MissingIndex(f"no index: run reindex on {self.root}")
        return self.store.read(name)

    def ranks(self) -> DataFrame:
        return self.table("ranks")

    def find(self, query: str, kind: str | None = None, top_k: int | None = 20, collation: str | None = None) -> DataFrame:
        return find_ranked(self.table("symbols"), self.ranks(), query, kind, top_k, collation)

    def callers(self, name: str, depth=2, collation: str | None = None) -> DataFrame:
        return trace_callers(self.table("symbols"), self.table("edges"), name, depth, collation)

    def callees(self, name: str, depth=2, strict: bool = False, collation: str | None = None) -> DataFrame:
        return trace_callees(self.table("symbols"), self.table("edges"), name, depth, strict, collation)

    def impact(self, file: str | None = None, symbol: str | None = None, depth=2) -> DataFrame:
        return impact(self.table("symbols"), self.table("edges"), file, symbol, depth)

    def map(self, token_budget: int = 1500, collation: str | None = None) -> DataFrame:
        return fill_budget(map_lines(self.table("symbols"), self.ranks()), token_budget, collation)

    def doctor(self, try_load=None) -> DataFrame:
        """Rows (check, status, detail): what is installed, the index and whether it is fresh.  Like
        the count it rests on, freshness does not see edits."""
        rows = [("python", "OK" if sys.version_info >= (3, 10) else "WARN", sys.version.split()[0])]

        def found(name: str) -> None:
            if importlib.util.find_spec(name) is None:
                raise ImportError(f"no module {name}")

        for name in ("pyspark", "pyarrow", "numpy"):
            try:
                (try_load or found)(name)
                rows.append((f"dependency {name}", "OK", ""))
            except Exception as e:
                rows.append((f"dependency {name}", "FAIL", f"{str(e).splitlines()[0] if str(e) else type(e).__name__} -- install {name}"))
        if not self.store.exists():
            rows.append(("index", "MISSING", f"run reindex on {self.root}"))
        else:
            try:
                self.store.check(full=True)
                n = {t: self.store.rows(t) for t in ("files", "symbols", "edges")}
                rows.append(("index", "OK", f"files {n['files']} | symbols {n['symbols']} | edges {n['edges']}"))
                spread = language_distribution(self.store.read("files")).collect()
                rows.append(("languages", "OK", ", ".join(f"{r['label']} {r['n']}" for r in spread)))
                disk = len(scan_source_files(self.root))
                rows.append(("freshness", "FRESH" if disk == n["files"] else "STALE", f"disk {disk}, index {n['files']}" + ("" if disk == n["files"] else " -- run reindex")))
            except CorruptIndex:
                rows.append(("index", "CORRUPT", f"delete {self.store.folder} and run reindex"))
        if os.path.exists(os.path.join(self.root, ".git")):
            path = os.path.join(self.root, ".gitignore")
            lines = open(path, encoding="utf-8").read().split("\n") if os.path.exists(path) else []
            there = any(x.strip().startswith(INDEX) for x in lines)
            rows.append((".gitignore", "OK" if there else "WARN", "" if there else f"add {INDEX}/ to it"))
        return self.spark.createDataFrame(rows, "check string, status string, detail string")


def language_distribution(files: DataFrame) -> DataFrame:
    return files.groupBy(language_label("path").alias("label")).agg(F.count("*").alias("n")).orderBy("label")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows
