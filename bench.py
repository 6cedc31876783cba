"""Times the headline queries on the tables in $BENCH_SF_DIR, and indexing of a generated tree, on
local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import random
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from loomgraph.plans import testgraph
from loomgraph.plans.catalogue import QUERIES
from loomgraph.plans.index import CodeIndex

NAMES = (
    "find_tiered_topk find_ranked defs_per_name resolve_calls resolve_imports_py changed_files replace_symbols link_weights file_pagerank page_pagerank "
    "trace_callers_d2 trace_callers_d5 trace_callees_d2 impact_symbol map_budget token_cost_documents sha1_documents"
).split()
FILES = 2000


def make_tree(root: str, n: int) -> None:
    r = random.Random(1)
    for i in range(n):
        lang = ("py", "py", "ts", "go", "java")[i % 5]
        folder = f"{root}/d{i % 40}"
        os.makedirs(folder, exist_ok=True)
        calls = [r.randrange(n) for _ in range(12)]
        if lang == "py":
            text = "".join(f"from d{c % 40}.m{c} import f{c}\n" for c in calls[:4]) + "".join(f"\ndef f{i}_{k}(a, b=1):\n    x = f{c}_0(a)\n    return obj.f{c}_1(x, b)\n" for k, c in enumerate(calls))
        elif lang == "ts":
            text = "".join(f"import {{ f{c} }} from '../d{c % 40}/m{c}';\n" for c in calls[:4]) + "".join(f"\nexport function f{i}_{k}(a: number): number {{\n  return f{c}_0(`${{a}}`) + obj.f{c}_1(a);\n}}\n" for k, c in enumerate(calls))
        elif lang == "go":
            text = 'package m\n\nimport "fmt"\n' + "".join(f"\nfunc f{i}_{k}(a int) int {{\n\tfmt.Println(a)\n\treturn f{c}_0(a)\n}}\n" for k, c in enumerate(calls))
        else:
            text = f"import java.util.List;\n\npublic class M{i} {{\n" + "".join(f"  public int f{i}_{k}(int a) {{ return f{c}_0(new M{c}().f{c}_1(a)); }}\n" for k, c in enumerate(calls)) + "}\n"
        with open(f"{folder}/m{i}.{lang}", "w") as f:
            f.write(text)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    tmp = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    try:
        spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
        began = time.time()
        testgraph.index(spark, sf_dir)  # the graph queries read it
        took["build_index"] = round(time.time() - began, 3)
        for name in NAMES:
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
        make_tree(f"{tmp}/tree", FILES)
        index = CodeIndex(spark, f"{tmp}/tree")
        for name in (f"cold_index_{FILES}_files", "warm_index"):
            began = time.time()
            index.reindex()
            took[name] = round(time.time() - began, 3)
    finally:
        spark.stop()
        shutil.rmtree(tmp, ignore_errors=True)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
