"""A small tree from files to its reading order, the options, and the state operators around it."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from cairnway.config import Options, parse_options, read_options
from cairnway.operators import graph, order, progress, reports
from cairnway.plans.index import entries, index, ordered
from cairnway.sources import documents, extract, git, tree, tree_source
from cairnway.streaming import events

TREE = {
    "app/__init__.py": "", "app/models.py": "class User:\n    pass\n_hidden = 1\nLIMIT = 3\n",
    "app/run.py": "from .models import User, LIMIT\nimport os, app.models\nfrom . import tools\nfrom . import more\ndef go():\n    pass\nclass K:\n    def m(self):\n        self.a.b(f()().c, go().x.y())\n        def inner(): pass\nif '__main__' == __name__:\n    go()\n",
    "app/tools.py": "__all__ = ['a']\na = b = 1\nimport app.run\n", "app/more.py": "print(1)\n", "app/broken.py": "def (", "tests/test_run.py": "from app.run import go\n", "tests/test_zz.py": "x = 1\n",
    "w/a.ts": "import d, {b as c, type e} from './b'\nexport function go(x) {\n  b(x); z.k();\n}\nconst h = async (a) => {\n  go(a)\n}\n",
    "w/b.ts": "export const b = 1\nexport { q as r }\nconst { m, n: o } = require('./a')\nimport * as all from 'react'\n",
    "g/m.go": "package main\nimport (\n\tx \"ex.org/m/p\"\n)\nfunc (r *R) Do(a int) {\n\tfmt.Println(x.Y())\n}\nfunc main() {\n}\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    out = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (out / name).parent.mkdir(parents=True, exist_ok=True)
        (out / name).write_text(text)
    return out


@pytest.fixture(scope="module")
def found(spark, root):
    return index(spark, str(root))


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_links_cycles_and_layers(found):
    assert rows(found.edges, "src", "dst") == {
        ("app/run.py", "app/models.py"), ("app/run.py", "app/tools.py"), ("app/run.py", "app/more.py"), ("app/tools.py", "app/run.py"),
        ("tests/test_run.py", "app/run.py"), ("w/a.ts", "w/b.ts"), ("w/b.ts", "w/a.ts"),
    }
    assert rows(found.external, "source") == {("os",), ("react",), ("ex.org/m/p",)}
    assert rows(found.cycles, "path") == {("app/run.py",), ("app/tools.py",), ("w/a.ts",), ("w/b.ts",)}
    layers = dict(map(tuple, found.layers.select("path", "layer").collect()))
    assert layers["app/run.py"] == "entry" and layers["app/models.py"] == "foundation" and layers["tests/test_run.py"] == "features"
    assert {("b", "w/b.ts", 1), ("go", "app/run.py", 1), ("K", "app/run.py", 0)} <= rows(found.usage, "name", "path", "callers")


def test_functions_have_qualified_names_and_calls(found):
    got = {(r.path, r.name, r.line, r.end_line): r.calls for r in found.functions.collect()}
    assert got == {
        ("app/run.py", "go", 5, 6): [], ("app/run.py", "K.m", 8, 10): ["f", "go", "self.a.b", "x.y"], ("app/run.py", "K.m.inner", 10, 10): [],
        ("w/a.ts", "go", 2, 4): ["b", "z.k"], ("w/a.ts", "h", 5, 7): ["go"],
        ("g/m.go", "R.Do", 5, 7): ["fmt.Println", "x.Y"], ("g/m.go", "main", 8, 9): [],
    }
    assert rows(found.imports.filter("src like 'w/%'"), "source", F.array_join("specifiers", ",")) == {("./b", "b,d,e"), ("./a", "m,n"), ("react", "*")}


def test_the_order_leaves_out_trivial_package_files(found):
    got = [(r.path, r["pass"]) for r in found.order.orderBy("index").collect()]
    assert got[:4] == [("app/models.py", "contracts"), ("app/run.py", "contracts"), ("tests/test_run.py", "contracts"), ("app/more.py", "data_flow")]
    assert got[-1] == ("tests/test_zz.py", "utility") and "app/__init__.py" not in dict(got) and len(got) == 10
    reasons = dict(map(tuple, found.order.select("path", "reason").collect()))
    assert reasons["tests/test_run.py"] == "Test file for app/run.py." and reasons["app/models.py"] == "Contract surface (foundation layer). Imported by 1 file(s)."
    assert rows(entries(found).filter("path = 'app/run.py'"), F.array_join("imports", ","), F.array_join("exports", ",")) == {("app/models.py,app/more.py,app/tools.py", "go,K")}


@pytest.mark.parametrize(("place", "last"), [("skip", []), ("separate", ["tests/test_run.py", "tests/test_zz.py"])])
def test_places_of_tests(found, place, last):
    got = [r.path for r in ordered(found.layers, found.edges, Options(test_pass=place, exclude_from_reading=("app/b*",))).orderBy("index").collect()]
    assert sorted(got[7:]) == last and len(got) == 7 + len(last) and "app/broken.py" not in got


def test_options_are_checked(tmp_path):
    assert read_options(tmp_path) == Options() and Options(skip_tests=True).tests == "skip"
    (tmp_path / "config.json").write_text('{"test_pass": "separate", "layer_thresholds": {"core": "2"}, "other": 1}')
    assert read_options(tmp_path).layer_thresholds == {"core": 2}
    (tmp_path / "config.toml").write_text('[exclude_from_reading]\n"**/x.py" = true\n[custom_pass_overrides]\n"a/*" = "contracts"\n')
    assert read_options(tmp_path).exclude_from_reading == ("**/x.py",)
    for bad in ({"test_pass": "late"}, {"skip_tests": 1}, {"layer_thresholds": {"core": -1}}, {"layer_thresholds": 3}, {"custom_pass_overrides": {"a": "b"}}, {"exclude_from_reading": [1]}, {"integration_fan_in_threshold": "x"}, {"tie_breaking": "dice"}):
        with pytest.raises(ValueError):
            parse_options(bad)


def test_a_language_is_registered_once():
    with pytest.raises(ValueError):
        extract.register("go", [".go2"], extract.extract_go)
    for suffixes in ([".py"], ["rs"], []):
        with pytest.raises(ValueError):
            extract.register("rust", suffixes, extract.extract_go)
    try:
        extract.register("rust", [".rs"], extract.extract_go)
        assert tree.LANGUAGES["rust"] == ".rs"
    finally:
        extract.LANGUAGES.pop("rust", None), tree.LANGUAGES.pop("rust", None)


def test_entry_rules(spark):
    df = spark.createDataFrame([("a/cli.py", 3, False, False), ("a/x.py", 0, False, True), ("a/y.py", 1, False, True), ("a/z.py", 9, True, False), ("a/tool.py", 9, False, False)], "path string, n long, g boolean, s boolean")
    hit = order.is_entry(F.col("path"), F.col("n"), F.col("g"), F.col("s"), {"t": "a.tool:main"})
    assert {r.path for r in df.filter(hit).collect()} == {"a/cli.py", "a/x.py", "a/z.py", "a/tool.py"}


def test_lone_directories_are_drawn_together(spark):
    files = spark.createDataFrame([(p, "core") for p in ("a/b/c/x.py", "a/b/c/d/y.py", "e/f/1.py", "e/g/h/2.py", "top.py")], "path string, layer string")
    assert rows(graph.dir_tree(files), "dir", "label", "n_files", "n_below") == {("a/b/c", "a/b/c", 1, 2), ("a/b/c/d", "d", 1, 1), ("e", "e", 0, 2), ("e/f", "f", 1, 1), ("e/g/h", "g/h", 1, 1)}


STATE = "path string, status string, note string, summary string"


def test_policies_of_updates(spark):
    state = spark.createDataFrame([("a", "unread", "n0", "s0"), ("b", "skimmed", "n1", "s1")], STATE)
    updates = spark.createDataFrame([("a", 1, "flagged", "x", "y"), ("a", 2, "confirmed", None, None), ("c", 1, "flagged", "why", None)], "path string, seq long, status string, note string, summary string")
    kept = ("b", "skimmed", "n1", "s1")
    get = lambda policy: rows(progress.apply_updates(state, updates, policy), "path", "status", "note", "summary")
    assert get("library") == {("a", "confirmed", None, "y"), kept}
    assert get("tool") == {("a", "confirmed", None, None), kept, ("c", "flagged", "why", None)}
    assert get("editor") == {("a", "confirmed", "n0", "s0"), kept, ("c", "flagged", None, None)}
    odd = spark.createDataFrame([("a", "read"), ("z", "flagged"), ("b", None), ("b", "unread")], "path string, status string")
    assert rows(progress.checked_updates(odd, state), "path", "error") == {("a", "unknown status: read"), ("z", "untracked: z"), ("b", "unknown status: none"), ("b", None)}


def test_state_helpers(spark):
    order_ = spark.createDataFrame([(0, "a"), (1, "b")], "index long, path string")
    assert rows(progress.new_state(order_, "t"), "path", "status", "started_at") == {("a", "unread", "t"), ("b", "unread", "t")}
    changes = spark.createDataFrame([("g", "new"), ("g/x", "new"), ("gg", "modified")], "path string, change string")
    assert rows(progress.outside_dir(changes, "g"), "path") == {("gg",)}
    assert rows(progress.with_unchanged(changes, order_), "path", "change") == {("g", "new"), ("g/x", "new"), ("gg", "modified"), ("a", "unchanged"), ("b", "unchanged")}
    state = spark.createDataFrame([("a", "confirmed", None, None), ("b", "flagged", None, None)], STATE)
    assert rows(progress.decorated(state, order_.filter("path = 'b'")), "path", "badge") == {("a", "\u2713"), ("b", "\u25b8")}
    lines = spark.createDataFrame([("a", 1, "def f():"), ("a", 2, "class G:"), ("a", 3, "x = 1")], "path string, line int, body string")
    exports = spark.createDataFrame([("a", "G"), ("b", "f")], "path string, name string")
    assert rows(progress.declared_exports(lines, exports), "path", "line", "name") == {("a", 2, "G")}
    auto = spark.createDataFrame([("a", 1, "old"), ("b", 1, "keep")], "path string, line int, title string")
    given = spark.createDataFrame([("a", 4, "mine")], "path string, line int, title string")
    assert rows(progress.lens_with_overrides(auto, given), "path", "line", "title") == {("a", 4, "mine"), ("b", 1, "keep")}
    words = spark.createDataFrame([("b",), ("A",), ("a",), ("B",)], "w string")
    assert [r.w for r in graph.by_locale(words, "w").collect()] == ["a", "A", "b", "B"]


ENTRY = "index int, path string, layer string, reason string, complexity string, line_count int, imports array<string>, imported_by array<string>, exports array<string>"


def test_texts(spark):
    order_ = spark.createDataFrame([(0, "m.py", "core", "", "low", 3, [], ["n.py"], []), (1, "n.py", "entry", "Because.", "low", 9, ["m.py", "q.py"], [], ["go"])], ENTRY)
    state = spark.createDataFrame([("m.py", "flagged", "odd", None), ("n.py", "unread", None, None), ("z.py", "flagged", None, "sum")], STATE)
    dashes = "-" * 50
    assert rows(reports.next_text(order_, state), "text") == {(f"-- Next: n.py {'-' * 37}\nLayer: entry | Lines: 9 | Complexity: low\nWhy now: Because.\n\nDependencies (imports):\n  [flagged] m.py -- (no summary)\n  [unread] q.py\n\nExports: go\n{dashes}",)}
    assert rows(reports.flagged_texts(order_, state), "text") == {
        (f"-- Flagged: m.py {'-' * 30}\nLayer: core | Lines: 3\nOriginal note: \"odd\"\nUsed by: n.py\n{dashes}",),
        (f"-- Flagged: z.py {'-' * 30}\nLayer: unknown | Lines: 0\nOriginal note: (no note)\nOriginal summary: \"sum\"\n{dashes}",),
    }
    want = "Progress: 2/3 files (67%)\n  confirmed: 0\n  flagged: 2\n  skimmed: 0\n  unread: 1\n\nCurrent layer: entry (0% complete)\nNext file: n.py\nFlagged files awaiting second pass: 2\n\nSessions: 4 | Avg pace: ~0 files/session"
    assert rows(reports.status_text(order_, state, 4), "text") == {(want,)}
    done = state.filter("path = 'm.py'")
    assert reports.all_read_text(done, 2).first().text == "All 1 files read!\n\n  confirmed: 0\n  flagged: 1\n  skimmed: 0\n\nSessions: 2\n\n1 file(s) flagged for second pass. Run /read-flagged to review."
    assert reports.status_text(order_.limit(1), done, 0).first().text.split("\n")[6:8] == ["All layers complete", "Next file: (none -- all files read)"]
    assert rows(progress.lens_titles(order_), "path", "title") == {("m.py", "Called by: n.py"), ("n.py", "Called by: none (potential dead code) | Calls: m.py, q.py")}


def test_the_command_line_writes_tables(spark, root, tmp_path, capsys):
    from cairnway.__main__ import main

    assert main([str(root / "absent")]) == 1
    assert main([str(root), "--out", str(tmp_path / "out"), "--verbose"]) == 0
    said = capsys.readouterr().out
    assert "entry: 1 files, from app/run.py" in said and "contracts: 3" in said
    assert spark.read.parquet(str(tmp_path / "out" / "entries")).count() == 10
    maps = documents.read_map(spark, str(tmp_path / "out" / "map.json"))
    assert [r["index"] for r in documents.order_of(maps).collect()] == list(range(10)) and ("app/run.py", "app/more.py") in rows(documents.edges_of(maps), "src", "dst")
    one = maps.first()
    assert one.total_files == 10 and set(one.layers) == set(order.LAYERS) and one.layers["entry"].files == ["app/run.py"] and len(one.content_hashes) == 11
    later = maps.withColumn("generated_at", F.lit("later"))
    assert documents.map_hash(maps).collect() == documents.map_hash(later).collect()
    assert rows(documents.hashes_or_none(spark, str(tmp_path / "out" / "map.json")), "path") == {(p,) for p in one.content_hashes}
    assert documents.hashes_or_none(spark, str(tmp_path / "none")).count() == 0
    body = json.loads((tmp_path / "out" / "map.json").read_text())
    assert list(body) == sorted(body) and list(body["reading_order"][0]) == sorted(body["reading_order"][0]) and body["dependency_graph"]["app/run.py"]["imports"]
    begun = json.loads((tmp_path / "out" / "progress.json").read_text())
    assert begun["sessions"] == 1 and begun["stats"] == {"total": 10, "confirmed": 0, "flagged": 0, "skimmed": 0, "unread": 10}
    assert begun["files"]["app/run.py"]["status"] == "unread" and begun["map_hash"] == documents.map_hash(maps).first().hash
    # A second run refreshes: what was read of unchanged files stays.
    begun["files"]["app/run.py"] |= {"status": "confirmed", "read_at": "2026-01-01T00:00:00Z", "summary": "runs"}
    begun["files"]["app/tools.py"]["exports_read"] = {"a": {"read_at": "2026-01-01T00:00:00Z", "summary": None}}
    begun["next_unread_index"] = 4
    (tmp_path / "out" / "progress.json").write_text(json.dumps(begun))
    (root / "app" / "more.py").write_text("print(2)\n")
    assert main([str(root), "--out", str(tmp_path / "out")]) == 0
    later = json.loads((tmp_path / "out" / "progress.json").read_text())
    run = later["files"]["app/run.py"]
    assert (run["status"], run["note"], run["summary"], later["next_unread_index"]) == ("flagged", "stale: depends on app/more.py", "runs", 0) and later["stats"]["flagged"] == 1
    assert later["files"]["app/tools.py"]["exports_read"]["a"]["read_at"] == "2026-01-01T00:00:00Z" and run["exports_read"] == {}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(("map.json.", "progress.json."))]


def test_git_answers(spark, tmp_path):
    run = lambda *words: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *words], check=True, capture_output=True)
    assert not git.is_repository(str(tmp_path / "absent")) and git.head(str(tmp_path)) is None
    run("init", "-q", "-b", "trunk")
    (tmp_path / "a.py").write_text("1")
    (tmp_path / "é b.py").write_text("1")
    run("add", "."), run("commit", "-qm", "one")
    first = git.head(str(tmp_path))
    (tmp_path / "a.py").rename(tmp_path / "c.py")
    (tmp_path / "é b.py").write_text("2")
    run("add", "."), run("commit", "-qm", "two")
    assert git.is_repository(str(tmp_path)) and git.branch(str(tmp_path)) == "trunk" and git.has_commit(str(tmp_path), first)
    assert not git.has_commit(str(tmp_path), "-h") and git.diff(spark, str(tmp_path), "nothing") is None
    assert rows(progress.git_changes(git.diff(spark, str(tmp_path), first)), "path", "change") == {("a.py", "removed"), ("c.py", "new"), ("é b.py", "modified")}
    run("checkout", "-q", first)
    assert git.branch(str(tmp_path)) is None


def test_ignore_files_are_read_as_directories_are_met(spark, tmp_path):
    files = {".gitignore": "*.py[co]\nout/\n!keep.py\n/top.py\n", "a/.gitignore": "x[0-9].py\n", "node_modules/.gitignore": "*", "out/.gitignore": "!b.py"}
    files |= dict.fromkeys(("a/m.py", "a/m.pyc", "a/x1.py", "a/xy.py", "a/b/x2.py", "out/b.py", "top.py", "a/top.py", "node_modules/q.py", "keep.py"), "")
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert rows(tree.scan_tree(spark, str(tmp_path)), "path") == {("a/m.py",), ("a/xy.py",), ("a/top.py",), ("keep.py",)}
    assert ("a/x1.py",) in rows(tree.scan_tree(spark, str(tmp_path), ignore_name=None), "path")
    paths = spark.createDataFrame([("a.pyc", False), ("a.py[co]", False), ("x/!.c", False), ("x/b.c", False), ("x/].c", False)], "path string, is_dir boolean")
    rules = lambda lines: tree.rules_of(spark.createDataFrame([("", i, x) for i, x in enumerate(lines)], "at string, line int, text string"))
    hits = lambda *lines: {r.path for r in tree.ignored(paths, rules(lines)).collect()}
    assert hits("*.py[co]") == {"a.pyc"} and hits("x/[!b].c") == {"x/!.c", "x/].c"} and hits("x/[]].c") == {"x/].c"} and hits("\\*.pyc") == set()


def test_highlights_and_export_marks(spark):
    say = lambda i, tool, **p: (i, tool, json.dumps(p))
    log = [
        say(1, "highlight_range", file="a", start=1, end=2), say(2, "clear_all"), say(3, "highlight_range", file="a", start=5, end=6), say(4, "highlight_range", file="b", start=1, end=1),
        say(5, "clear_highlights", file="b"), say(6, "highlight_range", file="a", start=3, end=3), say(7, "mark_export_read", file="a", export="f"), say(8, "mark_export_read", file="a", export="f"), say(9, "mark_export_read", file="a"),
    ]
    table = spark.createDataFrame(log, events.EVENT)
    assert [(r.path, [tuple(x) for x in r.ranges]) for r in events.highlights(table).collect()] == [("a", [(5, 6), (3, 3)])]
    assert rows(events.export_marks(table), "path", "name", "seq") == {("a", "f", 7)}
    assert events.highlights(table.limit(0)).count() == 0


def test_changed_documents_are_passed_on(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    for i in range(2):
        (source / f"{i}.json").write_text(json.dumps({"n": i}, indent=1))
        events.on_change(spark, str(source), "n int", lambda df, _: seen.append([r.n for r in df.collect()]), str(tmp_path / "cp")).awaitTermination()
    assert seen == [[0], [1]]


def test_thousands_of_ignore_files_stay_rows(spark, tmp_path):
    for i in range(500):
        folder = tmp_path / f"p{i % 30}" / f"q{i}"
        folder.mkdir(parents=True)
        (folder / ".gitignore").write_text(f"*.tmp.py\n!keep{i}.tmp.py\r\nsub/\n")
        for name in ("a.py", "b.tmp.py", f"keep{i}.tmp.py"):
            (folder / name).write_text("")
    (tmp_path / "p0/q0/sub").mkdir()
    (tmp_path / "p0/q0/sub/c.py").write_text("")
    (tmp_path / ".gitignore").write_text("q1*/\n!q1/\n")
    kept = {r.path for r in tree.scan_tree(spark, str(tmp_path)).select("path").collect()}
    wanted = [i for i in range(500) if i == 1 or not str(i).startswith("1")]
    assert kept == {f"p{i % 30}/q{i}/{name}" for i in wanted for name in ("a.py", f"keep{i}.tmp.py")}


def test_the_tree_source_lists_what_conditions_leave(spark, tmp_path):
    for name in ("a/m.py", "a/b/n.go", "a/b/c/d/o.py", "z/p.py", "z/dist/q.py", "top.ts", "notes.txt", ".hidden.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "link.py").symlink_to(tmp_path / "top.ts")
    whole = tree_source.read_tree(spark, str(tmp_path), shards=2)
    assert {(r.path, r.language, bytes(r.content).decode()) for r in whole.collect()} == {
        (p, lang, p) for p, lang in (("a/m.py", "python"), ("a/b/n.go", "go"), ("a/b/c/d/o.py", "python"), ("z/p.py", "python"), ("top.ts", "script"), ("notes.txt", None), (".hidden.py", "python"))
    }
    below = whole.filter(F.col("path").startswith("a/b/") & F.col("language").isin("python", "go"))
    assert {r.path for r in below.collect()} == {"a/b/n.go", "a/b/c/d/o.py"}
    reader = tree_source.TreeReader(str(tmp_path), 50, False, tree_source.LANGUAGES)
    assert not list(reader.pushFilters([tree_source.StringStartsWith(("path",), "a/b/"), tree_source.EqualTo(("language",), "python")]))
    assert {s.folder for s in reader.partitions()} == {"", "a", "a/b", "a/b/c", "a/b/c/d"} and [r[0] for s in reader.partitions() for r in reader.read(s)] == ["a/b/c/d/o.py"]
    with pytest.raises(NotADirectoryError):
        tree_source.TreeReader(str(tmp_path / "none"), 2, False, {}).partitions()
