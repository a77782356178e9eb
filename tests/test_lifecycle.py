"""The progress from its start to a refresh, against what one would write down by hand."""

import subprocess

import pytest

from cairnway.sources import documents
from cairnway.operators import lifecycle, reports
from cairnway.plans import staging

ORDER = "index int, path string, layer string, reason string, complexity string, line_count int, imports array<string>, imported_by array<string>, exports array<string>"
UPDATES = "path string, seq long, status string, note string, summary string, at string"


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(0, "a.py", "core", "", "low", 1, [], ["b.py"], ["A"]), (1, "b.py", "core", "Why.", "low", 2, ["a.py"], ["c.py"], []), (2, "c.py", "entry", "", "high", 3, ["b.py"], [], []), (3, "d.py", "entry", "", "low", 4, [], [], [])]
    return spark.createDataFrame(rows, ORDER)


def files(progress):
    return {r.path: tuple(r)[1:] for r in progress.files.select("path", "status", "read_at", "note", "summary").collect()}


def meta(progress):
    return progress.meta.first()


def test_create_start_and_complete(spark, entries):
    begun = lifecycle.create(entries, "h1", "T0")
    m = meta(begun)
    assert (m.sessions, m.started_at, m.last_session, m.next_unread_index, m.map_hash, m.git_commit) == (1, "T0", "T0", 0, "h1", None)
    assert files(begun) == dict.fromkeys(("a.py", "b.py", "c.py", "d.py"), ("unread", None, None, None))
    again = lifecycle.session_started(begun, "T1")
    assert (meta(again).sessions, meta(again).started_at, meta(again).last_session) == (2, "T0", "T1")
    updates = spark.createDataFrame([("a.py", 1, "confirmed", "n", "s", "T2"), ("b.py", 2, "flagged", "x", None, "T3"), ("b.py", 3, "skimmed", None, None, "T4"), ("z.py", 4, "confirmed", None, None, "T5")], UPDATES)
    done = lifecycle.completed(again, entries, updates)
    assert files(done) == {"a.py": ("confirmed", "T2", "n", "s"), "b.py": ("skimmed", "T4", None, None), "c.py": ("unread", None, None, None), "d.py": ("unread", None, None, None)}
    assert meta(done).next_unread_index == 2
    back = lifecycle.updated(done, spark.createDataFrame([("a.py", 9, "unread", None, None, "T9")], UPDATES))
    assert files(back)["a.py"] == ("unread", None, None, "s") and meta(lifecycle.advanced(back, entries)).next_unread_index == 2
    row = lifecycle.with_stats(done).first()
    assert (row.total, row.confirmed, row.flagged, row.skimmed, row.unread) == (4, 1, 0, 1, 2)


def test_a_map_hash_is_compared(spark, entries):
    begun = lifecycle.create(entries, "h1", "T0")
    assert lifecycle.is_current(begun, "h1", strict=True).first().is_current and not lifecycle.is_current(begun, "h2").first().is_current
    with pytest.raises(Exception, match="another map: h1"):
        lifecycle.is_current(begun, "h2", strict=True).collect()


def test_refresh_by_hash_and_by_diff(spark, entries):
    updates = spark.createDataFrame([(p, i, "confirmed", None, p, "T1") for i, p in enumerate(("a.py", "b.py", "c.py", "d.py"))], UPDATES)
    read = lifecycle.completed(lifecycle.create(entries, "h1", "T0"), entries, updates)
    assert meta(read).next_unread_index == 4
    edges = spark.createDataFrame([("b.py", "a.py"), ("c.py", "b.py")], "src string, dst string")
    changes = spark.createDataFrame([("a.py", "modified"), ("b.py", "unchanged"), ("c.py", "unchanged"), ("d.py", "removed"), ("e.py", "new")], "path string, change string")
    order = entries.select("index", "path").union(spark.createDataFrame([(4, "e.py")], "index int, path string")).filter("path <> 'c.py'")
    now = lifecycle.begun_or_refreshed(read, order, "h2", changes, edges, "c2", "main")
    assert files(now) == {"a.py": ("unread", None, None, None), "b.py": ("flagged", "T1", "stale: depends on a.py", "b.py"), "e.py": ("unread", None, None, None)}
    assert (meta(now).map_hash, meta(now).next_unread_index, meta(now).git_commit, meta(now).git_branch, meta(now).sessions) == ("h2", 0, "c2", "main", 1)
    diff = spark.createDataFrame([("M", "a.py", None), ("D", "d.py", None), ("A", ".guide/map.json", None)], "status string, path string, new_path string")
    git = lifecycle.refreshed_by_diff(read, diff, edges, "c2", None, ".guide")
    assert files(git) == {"a.py": ("unread", None, None, None), "b.py": ("flagged", "T1", "stale: depends on a.py", "b.py"), "c.py": ("flagged", "T1", "stale: depends on a.py", "c.py")}
    assert meta(git).map_hash == "h1" and meta(git).git_branch is None
    fresh = lifecycle.begun_or_refreshed(None, entries, "h", changes, edges)
    assert meta(fresh).sessions == 1 and meta(fresh).git_commit is None and len(files(fresh)) == 4


def test_refresh_in_a_repository(spark, entries, tmp_path):
    run = lambda *words: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *words], check=True, capture_output=True)
    begun = lifecycle.create(entries, "h", "T0")
    edges = spark.createDataFrame([("b.py", "a.py")], "src string, dst string")
    ask = lambda p: lifecycle.refreshed_in_repository(p, str(tmp_path), edges, ".guide")
    assert ask(begun) is None  # no stored commit
    run("init", "-q", "-b", "trunk")
    for name in ("a.py", "b.py"):
        (tmp_path / name).write_text("1")
    run("add", "."), run("commit", "-qm", "one")
    first = lifecycle.git.head(str(tmp_path))
    read = lifecycle.updated(lifecycle.with_git_state(begun, first, "old"), spark.createDataFrame([("b.py", 1, "confirmed", None, None, "T1")], UPDATES))
    same = ask(read)
    assert meta(same).git_branch == "trunk" and files(same) == files(read)
    assert ask(lifecycle.with_git_state(begun, "0" * 40, None)) is None  # the commit is gone
    (tmp_path / "a.py").write_text("2")
    run("commit", "-qam", "two")
    now = ask(read)
    assert files(now)["b.py"][:3] == ("flagged", "T1", "stale: depends on a.py") and meta(now).git_commit == lifecycle.git.head(str(tmp_path))


def test_session_context_and_tool_status(spark, entries):
    state = spark.createDataFrame([("a.py", "confirmed", "is a", None), ("b.py", "unread", None, None), ("d.py", "skimmed", None, None), ("c.py", "flagged", "is c", "n")], "path string, status string, summary string, note string")
    current = spark.createDataFrame([("b.py",)], "path string")
    got = [r.line for r in reports.session_context(entries, state, current).orderBy("rank", "at", "line").collect()]
    head = "-- Next: b.py "
    assert got == [
        head + "-" * 37, "Layer: core | Lines: 2 | Complexity: low", "Why now: Why.", "", "Dependencies (imports):", '  [confirmed] a.py -- "is a"', "Used by: c.py (unread, later)", "",
        "Previously read:", '  c.py -- "is c"', "  d.py -- (no summary)", "-" * 50,
    ]
    lone = [r.line for r in reports.session_context(entries, state.limit(0), spark.createDataFrame([("d.py",)], "path string")).orderBy("rank", "at").collect()]
    assert lone[1:] == ["Layer: entry | Lines: 4 | Complexity: low", "-" * 50]
    with pytest.raises(KeyError):
        reports.entry_of(entries, "nowhere.py")
    assert reports.entry_of(entries, "c.py").first().complexity == "high"
    row = reports.tool_status(entries, state, 9, 3).first()
    assert (row.total, row.unread, row.current_layer, row.current_layer_pct, row.next_file, row.flagged_count, row.sessions) == (9, 6, "core", 50, "b.py", 1, 3)


def test_exports_read_come_through_every_transition(spark, tmp_path):
    entries = spark.createDataFrame([(0, "a.py"), (1, "b.py"), (2, "c.py")], "index int, path string")
    begun = lifecycle.create(entries, "h", "T0")
    marks = spark.createDataFrame([("a.py", "f", 1, "T1", "first"), ("a.py", "f", 2, "T2", "again"), ("b.py", "g", 3, "T3", None), ("x.py", "h", 4, "T4", None)], "path string, name string, seq long, at string, summary string")
    read = lifecycle.exports_read(begun, marks)
    exports = lambda p: {tuple(r) for r in lifecycle.exports_of(p).select("path", "name", "read_at", "summary").collect()}
    assert exports(read) == {("a.py", "f", "T2", "again"), ("b.py", "g", "T3", None), ("x.py", "h", "T4", None)}
    assert {r.path: r.status for r in read.files.collect()}["x.py"] == "unread"
    path = f"{tmp_path}/progress.json"
    documents.write_document(documents.progress_document(read), path)
    back = documents.progress_of(documents.read_progress(spark, path))
    assert exports(back) == exports(read)
    updates = spark.createDataFrame([("a.py", 5, "confirmed", None, None, "T5")], UPDATES)
    done = lifecycle.confirmed_exports_read(lifecycle.updated(back, updates), spark.createDataFrame([("a.py", "f"), ("a.py", "k"), ("c.py", "z")], "path string, name string"))
    assert exports(done) == exports(read) | {("a.py", "k", "T5", None)}
    changes = spark.createDataFrame([("b.py", "modified"), ("x.py", "removed"), ("a.py", "unchanged")], "path string, change string")
    none = spark.createDataFrame([], "src string, dst string")
    now = lifecycle.refreshed(done, changes, none, entries, "h2")
    documents.write_document(documents.progress_document(now), path)
    assert exports(documents.progress_of(documents.read_progress(spark, path))) == {("a.py", "f", "T2", "again"), ("a.py", "k", "T5", None)}


def test_what_a_run_has_staged_can_be_deleted(spark):
    since = staging.held(spark)
    table, other = staging.staged(spark.range(3), "one"), staging.staged(spark.range(4), "two")
    assert (table.count(), other.count()) == (3, 4) and staging.clear(spark, since) == 2 and staging.clear(spark, since) == 0
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(table.inputFiles()[0])
