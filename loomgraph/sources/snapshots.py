"""Versioned Parquet snapshots of the tables of an index, and a store over them.

A write makes a new version next to the old one and then adds a numbered pointer, so that readers
see either all of it or none.  A pointer names the place and the rows of every table; tables that a
write doesn't change are named from the old version.  A number is given once: of two writers that
began from one pointer the second fails.  Tables are sorted by what they are looked up by, so that
scans skip most of a file."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.operators.resolve import changed_files, replace_rows
from loomgraph.operators.search import find_symbols

POINTER = "CURRENT-{:08d}.json"
_POINTERS = re.compile(r"CURRENT-(\d{8,})\.json")
#: what tables are sorted by
ORDER = {"files": ["path"], "symbols": ["name", "file"], "edges": ["callee_name", "caller_file"], "imports": ["file"], "calls": ["file"], "ranks": ["file"]}


class CorruptIndex(Exception):
    """The index is damaged; rebuild it."""


class ConflictingWrite(Exception):
    """Another writer changed the index meanwhile; nothing was written."""


class Snapshots:
    """Tables below a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._path(self.folder)
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(m[1]) for n in names if (m := _POINTERS.fullmatch(n)))

    def exists(self) -> bool:
        return bool(self._numbers())

    def pointer(self, number: int | None = None) -> dict[str, dict]:
        """Place (at) and rows of each table."""
        number = number if number is not None else max(self._numbers(), default=0)
        if not number:
            return {}
        try:
            stream = self._fs.open(self._path(f"{self.folder}/{POINTER.format(number)}"))
            try:
                tables = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            if not set(schema.TABLES) >= set(tables) or not all({"at", "rows"} <= set(t) for t in tables.values()):
                raise ValueError("unknown tables")
            return tables
        except (ValueError, TypeError, Py4JJavaError) as e:
            raise CorruptIndex(f"damaged index at {self.folder}: delete it and index again") from e

    def _at(self, name: str, at: str) -> DataFrame:
        return self.spark.read.schema(schema.TABLES[name]).parquet(f"{self.folder}/{at}")

    def read(self, name: str) -> DataFrame:
        """A table; an empty one if the index lacks it, as indexes of earlier versions may."""
        named = self.pointer().get(name)
        return self._at(name, named["at"]) if named else schema.empty(self.spark, schema.TABLES[name])

    def rows(self, name: str) -> int:
        return self.pointer().get(name, {"rows": 0})["rows"]

    def check(self, full: bool = False) -> None:
        """Raises CorruptIndex unless all tables have the rows that the pointer names.  full: reads every
        value of them, else only what files say of themselves."""
        tables = self.pointer()
        found = None
        for name, table in tables.items():
            df = self._at(name, table["at"])
            sums = [F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x") if full else F.lit(0).alias("x")]
            one = df.agg(*sums).withColumn("name", F.lit(name))
            found = one if found is None else found.unionByName(one)
        try:
            counts = {r["name"]: r["n"] for r in found.collect()} if found is not None else {}
        except Exception as e:
            raise CorruptIndex(f"damaged index at {self.folder}: delete it and index again") from e
        if any(counts[name] != table["rows"] for name, table in tables.items()):
            raise CorruptIndex(f"damaged index at {self.folder}: delete it and index again")

    def draft(self) -> Draft:
        return Draft(self)

    def write(self, tables: dict[str, DataFrame]) -> None:
        draft = self.draft()
        for name, df in tables.items():
            draft.write(name, df)
        draft.commit()

    def _point(self, number: int, tables: dict[str, dict]) -> None:
        draft = self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else jvm.java.net.URI("file:///"), self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, self._path(f"{self.folder}/{POINTER.format(number)}"), keep)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise ConflictingWrite(f"the index at {self.folder} was written meanwhile") from e
            raise

    def vacuum(self, keep: int = 2, orphans: bool = False) -> None:
        """Deletes all but the last pointers, and the versions that only those named; readers of these
        must be gone.  orphans: also versions that no pointer names, when nobody is writing."""
        numbers = self._numbers()
        versions = {n: {t["at"].split("/")[0] for t in self.pointer(n).values()} for n in (numbers if not orphans else numbers[-keep:])}
        used = set().union(*(versions[n] for n in numbers[-keep:]))
        dropped = set().union(*versions.values()) - used
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/{POINTER.format(n)}"), False)
        for s in self._fs.listStatus(self._path(self.folder)):
            name = s.getPath().getName()
            if name in dropped or (orphans and name.startswith("v-") and name not in used):
                self._fs.delete(s.getPath(), True)


class Draft:
    """A version being written: nobody sees its tables before commit()."""

    def __init__(self, store: Snapshots):
        self.store, self.version = store, f"v-{uuid.uuid4().hex}"
        self.base = max(store._numbers(), default=0)
        self.old = store.pointer(self.base) if self.base else {}
        self.new: dict[str, str] = {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Returns the table as it was written."""
        columns = [F.col(f.name).cast(f.dataType) for f in schema.TABLES[name]]
        last = [c for c in ("ord",) if c in df.columns]
        self.new[name] = f"{self.version}/{name}"
        # the ranges come from a sample: without this its rows would be computed twice
        rows = df.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sorted_ = rows.repartitionByRange(*ORDER[name]).sortWithinPartitions(*ORDER[name], *last)
            sorted_.write.parquet(f"{self.store.folder}/{self.new[name]}")
        finally:
            rows.unpersist()
        return self.store._at(name, self.new[name])

    def commit(self) -> None:
        counts = None
        for name, at in self.new.items():
            one = self.store._at(name, at).agg(F.count("*").alias("rows")).withColumn("name", F.lit(name))
            counts = one if counts is None else counts.unionByName(one)
        rows = {r["name"]: r["rows"] for r in counts.collect()} if counts is not None else {}
        tables = self.old | {name: {"at": at, "rows": rows[name]} for name, at in self.new.items()}
        self.store._point(self.base + 1, tables)


class Store(Snapshots):
    """Row-level access: writes replace the rows of a file, reads are ordered DataFrames."""

    def create(self) -> None:
        """Makes what tables are missing, empty; leaves the others."""
        missing = {n: schema.empty(self.spark, s) for n, s in schema.TABLES.items() if n not in self.pointer()}
        if missing:
            self.write(missing)

    def _keys(self, *paths: str) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in paths], "path string")

    def upsert_file(self, path: str, hash_: str) -> None:
        new = self.spark.createDataFrame([(path, hash_)], schema.FILES)
        self.write({"files": replace_rows(self.read("files"), new, self._keys(path), "path")})

    def get_files_changed(self, files: list[tuple[str, str]]) -> list[str]:
        disk = self.spark.createDataFrame([(p, h, i) for i, (p, h) in enumerate(files)], "path string, hash string, i int")
        return [r["path"] for r in changed_files(disk, self.read("files")).orderBy("i").collect()]

    def upsert_symbols(self, file: str, symbols: DataFrame | list[tuple]) -> None:
        """symbols: (name, kind, line, signature) in order."""
        if not isinstance(symbols, DataFrame):
            symbols = self.spark.createDataFrame([(*s, file, i) for i, s in enumerate(symbols)], schema.SYMBOLS)
        new = schema.guard_symbols(symbols.withColumn("file", F.lit(file)))
        self.write({"symbols": replace_rows(self.read("symbols"), new, self._keys(file), "file")})

    def upsert_edges(self, file: str, edges: DataFrame | list[tuple]) -> None:
        """edges: (caller_symbol, callee_name, callee_file, kind, confidence) in order; all get this
        file as their caller's."""
        if not isinstance(edges, DataFrame):
            edges = self.spark.createDataFrame([(file, *e, i) for i, e in enumerate(edges)], schema.EDGES)
        new = schema.guard_edges(edges.withColumn("caller_file", F.lit(file)))
        self.write({"edges": replace_rows(self.read("edges"), new, self._keys(file), "caller_file")})

    def _edges(self, edges: DataFrame) -> DataFrame:
        return edges.orderBy("caller_file", "callee_name", "ord")

    def get_all_edges(self) -> DataFrame:
        return self._edges(self.read("edges"))

    def get_edges_from(self, files: list[str]) -> DataFrame:
        keys = self._keys(*files).withColumnRenamed("path", "caller_file")
        return self._edges(self.read("edges").join(keys, "caller_file", "left_semi"))

    def get_edges_from_file(self, file: str) -> DataFrame:
        return self._edges(self.read("edges").filter(F.col("caller_file") == file))

    def get_edges_to_name(self, name: str) -> DataFrame:
        return self._edges(self.read("edges").filter(F.col("callee_name") == name))

    def get_edges_to_file(self, file: str) -> DataFrame:
        return self._edges(self.read("edges").filter(F.col("callee_file") == file))

    def find_symbols(self, name: str, mode: str = "exact", kind: str | None = None) -> DataFrame:
        return find_symbols(self.read("symbols"), name, mode, kind)


def open_store(spark: SparkSession, folder: str) -> Store:
    """Opens or makes a store; raises CorruptIndex if it cannot be read."""
    store = Store(spark, folder)
    store.check(full=True)
    store.create()
    return store
