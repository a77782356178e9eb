"""What an index works out only when asked, and its steps against plain ones."""

import ast
import random

import pytest
from pyspark.sql import functions as F

import cairnway.source_queries  # noqa: F401  registers its queries
from cairnway.config import Options
from cairnway.operators import order, resolve
from cairnway.plans import fixpoint, index
from cairnway.queries import QUERIES
from cairnway.sources import extract

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["indexed_files", "indexed_entries"])
def test_nothing_is_put_in_order_for_rows_without_a_place(spark, monkeypatch, name):
    """The order took much of the time of both queries, and neither returns it."""
    def fail(*_):
        raise AssertionError("put in order")

    monkeypatch.setattr(order, "topological", fail)
    assert QUERIES[name](spark, SF).count() > 500


FILES = {
    "a/__init__.py": "", "a/m.py": "from . import n\nclass B: pass\nclass A: pass\nB = 1\n", "a/n.py": "import a.m\n", "a/test_m.py": "import a.m\n", "t/test_none.py": "", "conftest.py": "import a.n\n",
    "w/x.ts": "import {q} from './y.js'; import './z'; import './index'\nexport const k = 1\n", "w/y.ts": "", "w/z.tsx": "", "w/index.js": "import '.'\n",
}


@pytest.mark.parametrize("place", ["utility", "separate", "skip"])
def test_described_rows_are_those_of_the_order(spark, place):
    rows = [(p, "script" if p.startswith("w/") else "python", bytearray(text, "utf-8"), "h", False) for p, text in FILES.items()]
    seen = spark.createDataFrame(rows, "path string, language string, content binary, hash string, is_test boolean")
    found = index.index_files(seen, Options(test_pass=place, exclude_from_reading=("w/z*",)))
    columns = ["path", "pass", "paired_with", "layer", "complexity", "line_count", "depth", "fan_in", "fan_out", "reason"]
    get = lambda df, *names: sorted(map(str, df.select(*names).collect()))
    assert get(found.described, *columns) == get(found.order, *columns)
    whole = index.entries(found)
    some = [c for c in whole.columns if c not in ("index", "symbol_usage")]
    assert get(index.described_entries(found), *some) == get(whole, *some)
    assert {r.path: r.exports for r in whole.collect()}["a/m.py"] == ["B", "A"]
    assert "w/z.tsx" not in {r.path for r in whole.collect()}


def closure(n, edges):
    reach = {a: {b for x, b in edges if x == a} for a in range(n)}
    for _ in range(n):
        reach = {a: seen.union(*(reach[b] for b in seen)) for a, seen in reach.items()}
    return reach


@pytest.mark.parametrize(("seed", "one_task", "share"), [(0, 0, 0.05), (1, 0, 0.6), (2, 8, 0.05), (3, 1000, 0.05)])
def test_peeled_graphs_match_brute_force(spark, monkeypatch, seed, one_task, share):
    """Layers that are peeled off, a rest for one task or for the loops, and the way back; with cycles."""
    rng, n = random.Random(seed), 22
    edges = sorted({(i, rng.randrange(i)) for i in rng.choices(range(1, n), k=24)} | {(3, 8), (8, 3), (5, 5)})
    reach = closure(n, edges)
    members = {a: max([a, *(b for b in reach[a] if a in reach[b])]) for a in range(n) if a in reach[a]}
    free = [(a, b) for a, b in edges if a != b and not (a in members and members[a] == members.get(b))]
    depth = lambda x: max((depth(b) + 1 for a, b in free if a == x), default=0)
    monkeypatch.setattr(fixpoint, "PEELED_SHARE", share)
    files, table = spark.createDataFrame([(i,) for i in range(n)], "path long"), spark.createDataFrame(edges, "src long, dst long")
    got, deep = fixpoint.components_and_depths(files, table, one_task)
    assert dict(map(tuple, got.collect())) == members and dict(map(tuple, deep.collect())) == {x: depth(x) for x in range(n)}


@pytest.mark.parametrize("one_task", [0, 100])
def test_a_cycle_is_an_error_by_loops_and_in_one_task(spark, one_task):
    files, table = spark.createDataFrame([(i,) for i in range(5)], "path long"), spark.createDataFrame([(0, 1), (1, 2), (2, 1), (3, 2), (3, 4)], "src long, dst long")
    with pytest.raises(ValueError, match="cycle"):
        fixpoint.depths(files, table, one_task_edges=one_task)


def test_a_script_import_tries_a_few_names(spark):
    """One row a name and import, not one a suffix; the exact file comes first, then suffixes in their order."""
    files = spark.createDataFrame([(p,) for p in ("a/x.js", "a/x.ts", "a/x.d.ts", "a/d/index.mjs", "a/d.cjs", "a/.ts", "a/j.json")], "path string")
    imports = spark.createDataFrame([("a/m.ts", s, ["n"]) for s in ("./x.js", "./x", "./x.d", "./d", "./d/", "./j.json", "./j", ".")], "src string, source string, specifiers array<string>")
    found = resolve.resolve_script(imports, files)
    assert {(r.source, r.dst, tuple(r.specifiers)) for r in found.collect()} == {
        (s, d, ("n",)) for s, d in (("./x.js", "a/x.js"), ("./x", "a/x.ts"), ("./x.d", "a/x.d.ts"), ("./d", "a/d.cjs"), ("./d/", "a/d.cjs"), ("./j.json", "a/j.json"))
    }


CODE = """@mark(q())
def f(a=g(), *, b: h() = 1) -> i():
    import one, two.three
    class K:
        def m(self):
            x = lambda: y.z()
            async def n(): await o()
            if p():
                def hidden(): from .up import (b, a)
        match a:
            case r.s: t()
    return [y() for z in w() if v()], f"{a()}{c()!r:{d()}}", u()().b, (n := e())
class B(base(), key=c()):
    for i in x:
        with k() as l, m(): pass
    try: import four
    except* j() as e: pass
"""


def test_one_walk_finds_what_separate_walks_find():
    got, tree = extract.parse_python(CODE.encode()), ast.parse(CODE)
    called = lambda node: {extract._called(x.func) for x in ast.walk(node) if isinstance(x, ast.Call)} - {None}
    functions = {x.name: sorted(called(x)) for x in ast.walk(tree) if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef) and x.name != "hidden"}
    assert {f[0].rsplit(".", 1)[-1]: f[3] for f in got["functions"]} == functions and [f[0] for f in got["functions"]] == ["f", "f.K.m", "f.K.m.n"]
    deep = lambda node: max((deep(x) + (type(x) in extract.BLOCKS) for x in ast.iter_child_nodes(node)), default=0)
    assert got["nesting"] == deep(tree) == 5
    assert got["imports"] == [(".up", ["a", "b"], True), ("four", [], False), ("one", [], False), ("two.three", [], False)]


def test_names_of_exports_come_by_their_first_line(spark):
    read = spark.createDataFrame([("a", "python", [("z", "type", 3), ("b", "variable", 1), ("z", "class", 2), ("a", "function", 2)]), ("b", "script", [])], "path string, language string, exports array<struct<name:string,kind:string,line:int>>")
    read = read.withColumns({"imports": F.array(), "functions": F.array(), "nesting": F.lit(1), "has_guard": F.lit(True), "has_side_effects": F.lit(False)})
    got = {r.path: (r.export_names, r.type_share, r.n_exports, r.has_guard, r.nesting) for r in index.outlines(read).collect()}
    assert got == {"a": (["b", "a", "z"], 0.5, 4, True, 1), "b": ([], 0.0, 0, False, 0)}


def test_the_links_of_one_package_are_made_in_many_tasks(spark):
    """12,000 imports of a package of 300 files, some by the same file: bounded pieces, whole results."""
    files = spark.range(300).select(F.concat(F.lit("p/m"), "id", F.when(F.col("id") % 10 == 0, "_test.go").otherwise(".go")).alias("path"))
    links = spark.range(12_000).select(F.concat(F.lit("q/m"), F.col("id") % 11_000, F.lit(".go")).alias("src"), F.lit("ex.org/p").alias("source"), F.lit("p").alias("dst"))
    found = resolve.package_files(links, files)
    assert found.columns == links.columns
    counts = found.groupBy("dst").agg(F.count("*").alias("n"), F.count_distinct("src").alias("srcs")).collect()
    assert {r.dst for r in counts} == {f"p/m{i}.go" for i in range(300) if i % 10} and {(r.n, r.srcs) for r in counts} == {(12_000, 11_000)}
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.7 * sum(sizes)
    assert resolve.package_files(links.limit(0), files).count() == 0 and resolve.package_files(links, files.limit(0)).count() == 0
