"""Resolution of imports and calls to files, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import language


#: more imports than any file has room for
CALLS = 1 << 30


def definitions(symbols: DataFrame) -> DataFrame:
    """name, n (definitions of that name anywhere), file (the one file if n is 1)."""
    return symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("file").alias("file"))


def unique_definitions(symbols: DataFrame) -> DataFrame:
    return definitions(symbols).filter("n = 1").select("name", "file")


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls: file, caller, callee, ord.  Edges to names with one definition; none to oneself.  The
    planner broadcasts the names if they are few, else shuffles on them."""
    target = unique_definitions(symbols).select(F.col("name").alias("callee"), F.col("file").alias("callee_file"))
    kept = calls.filter("caller <> callee").join(target, "callee")
    return kept.select(F.col("file").alias("caller_file"), F.col("caller").alias("caller_symbol"), F.col("callee").alias("callee_name"), "callee_file", F.lit("call").alias("kind"), F.lit("low").alias("confidence"), "ord")


def _folders(file: Column) -> Column:
    parts = F.split(file, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def _joined(parts: Column, rest: Column) -> Column:
    return F.when(rest == "", F.array_join(parts, "/")).when(F.size(parts) == 0, rest).otherwise(F.concat(F.array_join(parts, "/"), F.lit("/"), rest))


def python_candidates(file: Column, ref: Column, compat: bool = False) -> Column:
    """Paths that a module may have, the likelier first; null above the root.  compat: dots of folder
    names turn into slashes, too."""
    dots = F.length(F.regexp_extract(ref, r"^(\.*)", 1))
    rest = F.regexp_replace(ref, r"^\.+", "")
    folders = _folders(file)
    up = F.size(folders) - (dots - 1)
    here = F.when(dots == 0, F.array().cast("array<string>")).when(up >= 0, F.slice(folders, F.lit(1), F.greatest(up, F.lit(0))))
    if compat:
        base = F.replace(_joined(here, rest), F.lit("."), F.lit("/"))
    else:
        base = _joined(here, F.replace(rest, F.lit("."), F.lit("/")))
    return F.when(here.isNotNull() & (base != ""), F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py"))))


def normal_path(path: Column, compat: bool = False) -> Column:
    """Without `.` and `..` steps; null above the root.  compat: from right to left, `..` goes with
    the step behind it instead of the one in front."""
    steps = F.filter(F.split(path, "/"), lambda x: (x != ".") & (x != ""))
    if compat:
        # state: steps kept, taken from the right; a `..` drops the one kept last
        kept = F.aggregate(F.reverse(steps), F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
        return F.array_join(F.reverse(kept), "/")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(acc.isNull() | ((x == "..") & (F.size(acc) == 0)), F.lit(None)).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    return F.array_join(kept, "/")


def typescript_candidates(file: Column, ref: Column, compat: bool = False) -> Column:
    near = ref.startswith("./") | ref.startswith("../")
    base = normal_path(_joined(_folders(file), ref), compat)
    return F.when(near & base.isNotNull(), F.array(*[F.concat(base, F.lit(e)) for e in (".ts", ".tsx", "/index.ts", "/index.tsx")]))


def resolve_imports(imports: DataFrame, paths: DataFrame, compat: bool = False) -> DataFrame:
    """imports: file, lang, ref, ord; paths: path.  One edge per import, to the first candidate that
    is a known path, or to null: so are all of Go and Java."""
    lang = F.coalesce("lang", language("file"))
    file, ref = F.col("file"), F.col("ref")
    some = F.when(lang == "python", python_candidates(file, ref, compat)).when(lang.isin("typescript", "tsx"), typescript_candidates(file, ref, compat))
    rows = imports.select("file", "ref", "ord", F.explode_outer(F.when(F.size(some) > 0, F.arrays_zip(F.sequence(F.lit(0), F.lit(3)).alias("i"), some.alias("p")))).alias("c"))
    known = paths.select("path").distinct()
    met = rows.select("file", "ref", "ord", F.col("c.i").alias("i"), F.col("c.p").alias("p")).join(known, F.col("p") == F.col("path"), "left")
    best = met.groupBy("file", "ref", "ord").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.col("i"))).alias("callee_file"))
    return best.select(F.col("file").alias("caller_file"), F.lit(None).cast("string").alias("caller_symbol"), F.col("ref").alias("callee_name"), "callee_file", F.lit("import").alias("kind"), F.lit("high").alias("confidence"), "ord")


def build_edges(imports: DataFrame, calls: DataFrame, symbols: DataFrame, paths: DataFrame, compat: bool = False) -> DataFrame:
    """Import edges of each file, then its call edges: ord runs on over both, from CALLS for calls."""
    one, two = resolve_imports(imports, paths, compat), resolve_calls(calls, symbols)
    return one.unionByName(two.withColumn("ord", F.col("ord") + CALLS))


def ambiguous_names(symbols: DataFrame) -> DataFrame:
    return definitions(symbols).filter("n > 1").select("name", "n")


def unresolved_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    return calls.join(unique_definitions(symbols).select(F.col("name").alias("callee")), "callee", "left_anti").select("file", "caller", "callee")


def changed_files(disk: DataFrame, files: DataFrame) -> DataFrame:
    """disk, files: path, hash.  Rows of disk that are new or whose hash differs."""
    old = files.select("path", F.col("hash").alias("old"))
    return disk.join(old, "path", "left").filter(~F.col("old").eqNullSafe(F.col("hash"))).drop("old")


def replace_rows(old: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """old without the rows of changed paths, and new."""
    return old.join(changed.select(F.col("path").alias(key)), key, "left_anti").select(old.columns).unionByName(new)
