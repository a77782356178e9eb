"""Trees, extraction, resolution, JSON documents and the event stream on small fixtures."""

import json
import random

from pyspark.sql import functions as F

from cairnway.functions import paths
from cairnway.functions.paths import glob_regex
from cairnway.operators import graph, order, resolve
from cairnway.operators.resolve import go_modules, resolve_go, resolve_python, resolve_script
from cairnway.sources import braces, documents, extract, tree, script
from cairnway.streaming import events


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_a_python_tree_becomes_a_graph(spark, tmp_path):
    write(
        tmp_path,
        {
            "app/__init__.py": "", "app/models.py": "class User:\n    pass\n_hidden = 1\nLIMIT = 3\n", "app/run.py": "from .models import User, LIMIT\nimport os, app.models\nfrom . import tools\ndef go():\n    for x in []:\n        if x:\n            pass\nif __name__ == '__main__':\n    go()\n",
            "app/tools.py": "__all__ = ['a']\na = b = 1\n", "app/broken.py": "def (", "node_modules/x/y.py": "import app", "skip/z.py": "import app", "tests/test_run.py": "from app.run import go\n", "notes.txt": "import x",
        },
    )
    files = tree.scan_tree(spark, str(tmp_path), {"": ["skip/", "# no"]}).cache()
    assert {r.path for r in files.collect()} == {"app/__init__.py", "app/models.py", "app/run.py", "app/tools.py", "app/broken.py", "tests/test_run.py"}
    assert {r.path for r in files.filter("is_test").collect()} == {"tests/test_run.py"}
    parsed = extract.extract_python(files).cache()
    run = parsed.filter("path = 'app/run.py'").first()
    assert [i.source for i in run.imports] == [".", ".models", "app.models", "os"] and run.nesting == 3 and run.has_guard
    assert [e.name for e in parsed.filter("path = 'app/models.py'").first().exports] == ["User", "LIMIT"]
    assert [e.name for e in parsed.filter("path = 'app/tools.py'").first().exports] == ["a"]
    imports = parsed.select(F.col("path").alias("src"), F.explode("imports").alias("i")).select("src", "i.source", "i.specifiers")
    resolved = resolve_python(imports, files)
    edges = {tuple(r) for r in graph.build_edges(imports, resolved, files).collect()}
    assert edges == {("app/run.py", "app/models.py"), ("app/run.py", "app/tools.py"), ("tests/test_run.py", "app/run.py")}
    assert [r.source for r in graph.external_deps(imports, resolved, files).collect()] == ["os"]


def test_scripts_resolve_by_suffix_and_index(spark):
    body = b"import a, { b } from './lib/a';\nimport '../x.service';\nconst c = require('react');\nexport * from './dir'\nexport class K {}\nexport const v = 1\nexport interface I {}\nexport default async function f() {}\n"
    files = spark.createDataFrame([(p, bytearray(body if p == "src/main.ts" else b"")) for p in ("src/main.ts", "src/lib/a.tsx", "x.service.ts", "src/dir/index.js")], "path string, content binary")
    read = extract.extract_script(files).cache()
    imports = read.select(F.col("path").alias("src"), F.explode("imports").alias("i")).select("src", "i.*")
    got = {(r.source, r.dst) for r in resolve_script(imports, files).collect()}
    assert got == {("./lib/a", "src/lib/a.tsx"), ("../x.service", "x.service.ts"), ("./dir", "src/dir/index.js")}
    assert {tuple(e[:2]) for r in read.collect() for e in r.exports} == {("K", "class"), ("v", "variable"), ("I", "type"), ("f", "default")}


def test_suffixes_of_script_imports_are_swapped(spark):
    files = spark.createDataFrame([(p,) for p in ("a/x.ts", "a/y.conf.ts", "a/z.js", "a/z.ts", "a/d/index.tsx", "a/.env.ts")], "path string")
    imports = spark.createDataFrame([("a/m.ts", s) for s in ("./x.js", "./y.conf", "./z.js", "./d", "./d/", "./.env", "../a/x.mjs", "react")], "src string, source string")
    got = {(r.source, r.dst) for r in resolve_script(imports, files).collect()}
    assert got == {("./x.js", "a/x.ts"), ("./y.conf", "a/y.conf.ts"), ("./z.js", "a/z.js"), ("./d", "a/d/index.tsx"), ("./d/", "a/d/index.tsx"), ("./.env", "a/.env.ts"), ("../a/x.mjs", "a/x.ts")}
    compat = {(r.source, r.dst) for r in resolve_script(imports.union(spark.createDataFrame([("a/m.ts", "./x.service")], imports.schema)), files, compat=True).collect()}
    assert compat == got - {("./y.conf", "a/y.conf.ts"), ("../a/x.mjs", "a/x.ts")} | {("./x.service", "a/x.ts")}


SCRIPT = """import d, {b as c, type e} from './b'
// import z from 'no'
const s = "export const q = 1; import q from 'no'";
export function go(x) {
  b(x); z?.k(); /* f() */
}
const h = async (a) => {
  go(a)
}
export const one = 1, two = {a: 1, b: [2, 3]}, three = (x) => x
export default class Foo extends Bar {
  constructor(a) { super(a); this.q.r(1) }
  async run(a: number): Promise<void> {
    if (a) { step(a) }
  }
  field = (y) => { other("g()", y) }
  *gen() { yield k() }
}
export { q as r, t as default }
export interface I { m(): void }
export enum E { A }
function* g() { w() }
module.exports = { go, other: 3, nested: { deep: 1 } }
export default 42
export { u } from './u'
"""


def test_the_scanner_reads_scripts():
    got = script.read_script(SCRIPT)
    assert got["imports"] == [("./b", ("b", "d", "e"), True), ("./u", ("u",), True)]
    assert sorted(got["exports"], key=lambda e: (e[2], e[0])) == [
        ("go", "function", 4), ("one", "variable", 10), ("three", "variable", 10), ("two", "variable", 10), ("Foo", "default", 11), ("q", "variable", 19), ("t", "default", 19),
        ("I", "type", 20), ("E", "type", 21), ("go", "variable", 23), ("nested", "variable", 23), ("other", "variable", 23), ("default", "default", 24), ("u", "variable", 25),
    ]
    assert got["functions"] == [
        ("go", 4, 6, ["b", "z.k"]), ("h", 7, 9, ["go"]), ("three", 10, 10, []), ("Foo.constructor", 12, 12, ["this.q.r"]), ("Foo.run", 13, 15, ["step"]), ("Foo.field", 16, 16, ["other"]),
        ("Foo.gen", 17, 17, ["k"]), ("g", 22, 22, ["w"]),
    ]
    assert script.read_script("module.exports = make()\n")["exports"] == [("default", "default", 1)]
    assert script.read_script("{ '" + "x" * 10_000) == {"imports": [], "exports": [], "functions": [], "has_guard": False}


FORMS = """const half = (a) => a / 2 / g(a)
const quoted = /[/'"`{]+/g, other = 1
export const typed: Map<string, (x: number) => void> = new Map()
const f: (a: A, b?: { c: number }) => B =
  async (a, b) => go(a)
const text = `one ${two(`in ${deep({ a: "}" })}`)} export const no = 1`
function over(a: string): string
function over(a: any): { b: C } { return h(a) }
export abstract class Box<T extends { a: B }> extends Base<T> implements I<X> {
  private readonly items: Array<() => void> = []
  static get size(): number { return this.items.length }
  handler = async <T,>(e: Event): Promise<void> => { on(e) }
  protected abstract draw(): void
  set value(v) { put(v) }
}
export type { Q } from './types'
export * as all from "./all"
const late = await import('./late'), b = require("./b"); const { c, d: e } = require('./c')
if (x) { const hidden = () => 1 }
import json, { a as b, type T } from "./json"; import './side'
export default (x) => x
"""


def test_the_scanner_knows_what_a_slash_and_a_template_are():
    got = script.read_script(FORMS)
    assert got["imports"] == [
        ("./types", ("Q",), True), ("./all", ("*",), True), ("./late", (), True), ("./b", ("b",), True), ("./c", ("c", "d"), True), ("./json", ("T", "a", "json"), True), ("./side", (), True),
    ]
    assert got["exports"] == [("typed", "variable", 3), ("Box", "class", 9), ("default", "default", 21)]
    assert got["functions"] == [
        ("half", 1, 1, ["g"]), ("f", 4, 5, ["go"]), ("over", 8, 8, ["h"]), ("Box.size", 11, 11, []), ("Box.handler", 12, 12, ["on"]), ("Box.value", 14, 14, ["put"]),
    ]


def test_the_scanner_takes_time_in_proportion():
    import time

    def seconds(piece, n):
        start = time.perf_counter()
        script.read_script(piece * n)
        return time.perf_counter() - start

    for piece in ("const a: \n", "class A ", "function f<", "(", "import {", "const f = x => 1\n", "`${", "'", "} = require('a') ", "var a = b,\n", "<", "/"):
        seconds(piece, 500)
        assert seconds(piece, 16_000) < 3 * 8 * seconds(piece, 2_000) + 1, piece


GO = """package main
import "fmt"
import (
\tx "ex.org/m/p"
\t. "dot"
\t// "no"
\t_ "blank/y"
)
const A = 1
const (
\tB, c = 1, 2
\tD = iota
)
type (
\tS struct {
\t\tInner int
\t}
\tI interface { Do() }
\tAlias = string
)
type T struct{ X int }
type G[K any] struct{}
var V, w = 1, 2
var (
\tU int
)
func (r *R) Do(a int) {
\tfmt.Println(x.Y(), "f()")
}
func main() {
}
func Gen[T any](x T) T { return h(x) }
"""


def test_the_scanner_reads_go():
    got = braces.read_go(GO)
    assert got["imports"] == [("fmt", (), False), ("ex.org/m/p", ("x",), False), ("dot", (".",), False), ("blank/y", ("_",), False)]
    assert sorted(got["exports"], key=lambda e: e[2]) == [
        ("A", "variable", 9), ("B", "variable", 11), ("D", "variable", 12), ("S", "class", 15), ("I", "type", 18), ("Alias", "type", 19), ("T", "class", 21), ("G", "class", 22),
        ("V", "variable", 23), ("U", "variable", 25), ("R.Do", "function", 27), ("Gen", "function", 32),
    ]
    assert got["functions"] == [("R.Do", 27, 29, ["fmt.Println", "x.Y"]), ("main", 30, 31, []), ("Gen", 32, 32, ["h"])] and got["has_guard"]
    assert not braces.read_go(GO.replace("package main", "package other"))["has_guard"]


def test_go_imports_become_directories(spark):
    body = b'package main\nimport (\n\t"fmt"\n\tx "ex.org/m/pkg/a"\n)\nimport "ex.org/m"\nfunc (r *R) Do() {}\nfunc hidden() {}\ntype S struct {\n}\ntype N int\nvar V = 1\n'
    files = spark.createDataFrame([("src/cmd/main.go", bytearray(body)), ("lib/a.go", bytearray(body)), ("src/go.mod", bytearray(b"// m\nmodule ex.org/m\n\ngo 1.22\n")), ("go.mod", bytearray(b"module ex.org"))], "path string, content binary")
    modules = go_modules(files)
    assert {tuple(r) for r in modules.collect()} == {("ex.org/m", "src"), ("ex.org", "")}
    read = extract.extract_go(files.filter("path like '%.go'")).cache()
    imports = read.select(F.col("path").alias("src"), F.explode("imports").alias("i")).select("src", "i.*")
    got = {(r.src, r.source, r.dst) for r in resolve_go(imports, modules).collect()}
    # The nearest go.mod above a file counts.
    assert got == {("src/cmd/main.go", "ex.org/m/pkg/a", "src/pkg/a"), ("src/cmd/main.go", "ex.org/m", "src"), ("lib/a.go", "ex.org/m/pkg/a", "m/pkg/a"), ("lib/a.go", "ex.org/m", "m")}
    assert {tuple(e[:2]) for r in read.filter("path = 'lib/a.go'").collect() for e in r.exports} == {("R.Do", "function"), ("S", "class"), ("N", "type"), ("V", "variable")}


def test_globs_and_ignore_lines(spark):
    listed = spark.createDataFrame([("a/b.py",), ("b.py",), ("a/x/b.py",), ("k/keep.log",), ("k/drop.log",)], "path string")
    hits = lambda c: sorted(r.path for r in listed.filter(c).collect())
    assert hits(F.col("path").rlike(glob_regex("**/b.py"))) == ["a/b.py", "a/x/b.py"]
    assert hits(F.col("path").rlike(glob_regex("[!a]*"))) == ["b.py", "k/drop.log", "k/keep.log"]
    rules = tree.rules_of(spark.createDataFrame([("", 0, "*.log"), ("", 1, "!keep.log"), ("a", 0, "/b.py")], "at string, line int, text string"))
    assert sorted(r.path for r in tree.ignored(listed.withColumn("is_dir", F.lit(False)), rules).collect()) == ["a/b.py", "k/drop.log"]


def test_json_documents_become_tables(spark, tmp_path):
    entry = {"index": 0, "path": "a.py", "layer": "core", "imports": ["b.py"], "imported_by": [], "exports": ["x"]}
    whole = {"version": "1", "reading_order": [entry], "dependency_graph": {"a.py": {"imports": ["b.py"], "imported_by": []}}, "content_hashes": {"a.py": "12345678"}}
    (tmp_path / "m.json").write_text(json.dumps(whole, indent=2))
    (tmp_path / "n.json").write_text("{}")
    maps = documents.read_map(spark, str(tmp_path))
    assert documents.order_of(maps).first().path == "a.py" and [tuple(r) for r in documents.edges_of(maps).collect()] == [("a.py", "b.py")]
    assert [tuple(r) for r in documents.hashes_of(maps).collect()] == [("a.py", "12345678")]


def test_the_stream_keeps_the_last_write(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [(2, "complete_file", {"file": "a", "status": "skimmed", "summary": "s"}), (1, "mark_flagged", {"file": "a"}), (3, "nonsense", {"file": "b"}), (4, "mark_read", {"file": "b", "note": "n"})]
    (source / "1.json").write_text("\n".join(json.dumps({"id": i, "tool": t, "params": json.dumps(p)}) for i, t, p in rows))
    stream = events.checked(events.read_events(spark, str(source)))
    states = events.running_status(events.status_updates(stream.filter("error is null")))
    run = lambda: states.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(str(tmp_path / f"out{i}"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out0")).collect()} == {("a", 2, "skimmed", None, "s"), ("b", 4, "confirmed", "n", None)}
    (source / "2.json").write_text(json.dumps({"id": 5, "tool": "mark_read", "params": json.dumps({"file": "a"})}))
    run()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out1")).collect()} == {("a", 5, "confirmed", None, "s")}


def test_subscribers_get_their_tools(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    rows = [(i, t) for i, t in enumerate(("mark_read", "clear_all", "highlight_range", "mark_flagged", "get_read_status"))]
    (source / "1.json").write_text("\n".join(json.dumps({"id": i, "tool": t, "params": "{}"}) for i, t in rows))
    hear = lambda name: lambda df, batch: seen.append((name, sorted(r.id for r in df.collect())))
    wanted = {"mark_read mark_flagged clear_all": hear("tree"), "highlight_range clear_all": hear("marks")}
    stream = events.checked(events.read_events(spark, str(source))).filter("error is null")
    events.fan_out(stream, wanted, str(tmp_path / "cp")).awaitTermination()
    assert seen == [("tree", [0, 1, 3]), ("marks", [1, 2])]


def test_changed_and_deleted_documents_are_seen(spark, tmp_path):
    seen, at = [], str(tmp_path / "d" / "*.json")
    (tmp_path / "d").mkdir()
    look = lambda before: events.on_snapshots(spark, at, before, lambda df: seen.append(sorted((r.path.rsplit("/", 1)[1], r.change) for r in df.collect())))
    now = look(None)
    (tmp_path / "d" / "a.json").write_text("{}")
    (tmp_path / "d" / "b.json").write_text("{}")
    now = look(now)
    now = look(now)
    (tmp_path / "d" / "a.json").write_text("{'longer': 1}")
    (tmp_path / "d" / "b.json").unlink()
    now = look(now)
    assert seen == [[("a.json", "new"), ("b.json", "new")], [("a.json", "modified"), ("b.json", "removed")]]
    state = spark.createDataFrame([("a", "confirmed"), ("b", "unread"), ("c", "flagged")], "path string, status string")
    shown, changed = events.synced(spark.createDataFrame([("a", "unread"), ("b", "unread"), ("z", "skimmed")], "path string, status string"), state)
    assert shown.count() == 3 and {tuple(r) for r in changed.collect()} == {("a", "confirmed"), ("c", "flagged"), ("z", None)}


def test_paths_below_a_root(spark):
    df = spark.createDataFrame([("/repo/a.py",), ("/repo2/a.py",), ("/repo",), ("a.py",)], "path string")
    assert [r[0] for r in df.select(paths.below_root(F.col("path"), "/repo/")).collect()] == ["a.py", None, None, None]
    assert [r[0] for r in df.select(order.is_script_entry(F.concat("path", F.lit("/index.ts")))).collect()] == [True] * 4


def test_code_lines_see_all_line_ends_and_blanks(spark):
    rng = random.Random(1)
    pieces = list("ab# \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　​") + ["\r\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(800)] + ["x = 1\r\n\r\n\t# c\r\n\t\r\ny = 2", None]
    want = [sum(1 for line in (t or "").splitlines() if line.strip() and not line.strip().startswith("#")) for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(paths.code_lines(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == want and want[-2] == 2


def test_go_packages_can_stand_for_their_files(spark):
    files = spark.createDataFrame([("a/x.go",), ("a/y.go",), ("a/y_test.go",), ("b/z.go",)], "path string")
    links = spark.createDataFrame([("b/z.go", "m/a", "a"), ("b/z.go", "m/none", "none")], "src string, source string, dst string")
    assert {tuple(r) for r in resolve.package_files(links, files).collect()} == {("b/z.go", "m/a", "a/x.go"), ("b/z.go", "m/a", "a/y.go")}
    imports = spark.createDataFrame([("a/b/c.ts", "../x")], "src string, source string")
    tree_ = spark.createDataFrame([("a/x.ts",)], "path string")
    assert resolve.resolve_script(imports, tree_).count() == 1 and resolve.resolve_script(imports, tree_, compat=True).count() == 0
