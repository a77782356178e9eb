"""Fixpoints and the greedy order against brute force on random graphs."""

import random
import time

import pytest

from cairnway.operators import graph, order, progress
from cairnway.plans import fixpoint, spread


def frames(spark, n, edges):
    return spark.createDataFrame([(i,) for i in range(n)], "path long"), spark.createDataFrame(edges, "src long, dst long")


def closure(n, edges):
    reach = [set() for _ in range(n)]
    for a, b in edges:
        reach[a].add(b)
    changed = True
    while changed:
        changed = False
        for a in range(n):
            new = set().union(*(reach[b] for b in reach[a])) - reach[a] if reach[a] else set()
            if new:
                reach[a] |= new
                changed = True
    return reach


@pytest.mark.parametrize(("seed", "one_task"), [(1, 0), (2, 0), (1, 100), (2, 100), (5, 6)])
def test_components_match_mutual_reachability(spark, seed, one_task):
    rng = random.Random(seed)
    n = 16
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(22)})
    reach = closure(n, edges)
    want = {(a, max([a, *(b for b in reach[a] if a in reach[b])])) for a in range(n) if a in reach[a]}
    assert {tuple(r) for r in fixpoint.components(frames(spark, n, edges)[1], one_task).collect()} == want


def test_depth_is_the_longest_path_and_ignores_cycle_edges(spark):
    edges = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 3), (3, 2)]
    files, table = frames(spark, 6, edges)
    members = fixpoint.components(table)
    got = dict(map(tuple, fixpoint.depths(files, fixpoint.acyclic(table, members)).collect()))
    assert got == {0: 2, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0}


def random_dag(rng, n, extra):
    """Chains, branches and joins: node i imports smaller ones."""
    return sorted({(i, i - 1) for i in range(1, n) if rng.random() < 0.8} | {(i, rng.randrange(i)) for i in rng.choices(range(1, n), k=extra)})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_depths_match_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = random_dag(rng, 40, 12)
    want = {}
    for i in range(40):
        want[i] = max((want[b] + 1 for a, b in edges if a == i), default=0)
    files, table = frames(spark, 40, edges)
    assert dict(map(tuple, fixpoint.depths(files, table).collect())) == want


def test_a_long_chain_takes_few_rounds_and_a_cycle_is_an_error(spark):
    n = 5000
    files, table = frames(spark, n, [(i + 1, i) for i in range(n - 1)])
    began = time.time()
    assert fixpoint.depths(files, table).agg({"depth": "max"}).first()[0] == n - 1
    far = fixpoint.reach(files.filter("path = 0"), table)
    assert far.agg({"level": "max"}).first()[0] == n - 1 and far.count() == n - 1
    assert time.time() - began < 240
    for ring in ([(0, 1), (1, 2), (2, 0), (3, 0)], [(0, 1), (0, 2), (1, 0), (1, 2)]):
        with pytest.raises(ValueError):
            fixpoint.depths(*frames(spark, 4, ring))


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_reach_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [*random_dag(rng, n, 8), *[(rng.randrange(n), rng.randrange(n)) for _ in range(4)]]
    seeds, closed = set(rng.sample(range(n), 3)), set(rng.sample(range(n), 4))
    want, level, now = {}, 0, {s: s for s in seeds}
    while now:
        level += 1
        step = {}
        for a, b in edges:
            if b in now and a not in closed and a not in want:
                step[a] = min(step.get(a, n), now[b])
        want |= {a: (s, level) for a, s in step.items()}
        now = step
    _, table = frames(spark, n, edges)
    of = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "path long")
    got = fixpoint.reach(of(seeds), table, of(closed)).select("path", "seed", "level").collect()
    assert {r.path: (r.seed, r.level) for r in got} == want and len(got) == len(want)


def test_reach_stops_at_excluded_files_and_names_the_first_seed(spark):
    edges = [(1, 0), (2, 1), (3, 2), (4, 0), (5, 4), (6, 7), (2, 7)]  # 1 imports 0, ...
    _, table = frames(spark, 8, edges)
    seeds = spark.createDataFrame([(0,), (7,)], "path long")
    blocked = spark.createDataFrame([(4,)], "path long")
    got = {tuple(r) for r in fixpoint.reach(seeds, table, blocked).select("path", "seed", "level").collect()}
    assert got == {(1, 0, 1), (2, 7, 1), (6, 7, 1), (3, 7, 2)}


def test_degrees_sum_to_edges(spark):
    files, table = frames(spark, 5, [(0, 1), (0, 2), (3, 1)])
    rows = graph.node_metrics(files, table).collect()
    assert sum(r.fan_in for r in rows) == sum(r.fan_out for r in rows) == 3
    assert {r.path for r in rows if r.is_leaf} == {0, 3, 4}


def test_greedy_order_matches_a_resorting_loop(spark):
    rng = random.Random(4)
    names = [f"d/m{i}.py" for i in range(14)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(18)})
    edges = [(a, b) for a, b in edges if a != b]
    rank = {p: (rng.randrange(3), -sum(b == p for _, b in edges), p) for p in names}
    waiting = {p: {b for a, b in edges if a == p} for p in names}
    want = []
    while ready := sorted((p for p in names if p not in want and waiting[p] <= set(want)), key=rank.get):
        want.append(ready[0])
    want += sorted((p for p in names if p not in want), key=rank.get)
    files = spark.createDataFrame([("r", "data_flow", p, rank[p][0], -rank[p][1]) for p in names], "repo_id string, pass string, path string, layer_rank int, fan_in long")
    table = spark.createDataFrame([("r", a, b) for a, b in edges], "repo_id string, src string, dst string")
    got = [r.path for r in order.reading_order(files, table).orderBy("index").collect()]
    assert got == want


def test_paired_tests_follow_and_others_come_last(spark):
    rows = [("r", "contracts", "a/types.py", 0, 1), ("r", "data_flow", "a/run.py", 1, 0), ("r", "utility", "t/test_types.py", 1, 0), ("r", "utility", "t/test_else.py", 1, 0), ("r", "utility", "t/conftest.py", 1, 0)]
    files = spark.createDataFrame(rows, "repo_id string, pass string, path string, layer_rank int, fan_in long")
    none = spark.createDataFrame([], "repo_id string, src string, dst string")
    got = [r.path for r in order.reading_order(files, none).orderBy("index").collect()]
    assert got == ["a/types.py", "t/test_types.py", "a/run.py", "t/conftest.py", "t/test_else.py"]


def test_a_null_summary_keeps_the_one_before(spark):
    rows = [("a", 1, "skimmed", "x", "first"), ("a", 2, "confirmed", None, None)]
    got = progress.latest_status(spark.createDataFrame(rows, "path string, seq long, status string, note string, summary string")).first()
    assert (got.status, got.note, got.summary) == ("confirmed", None, "first")


def test_renames_are_a_removal_and_an_addition(spark):
    rows = [("A", "a", None), ("M", "b", None), ("D", "c", None), ("R100", "d", "e"), ("X", "f", None)]
    got = {tuple(r) for r in progress.git_changes(spark.createDataFrame(rows, "status string, path string, new_path string")).collect()}
    assert got == {("a", "new"), ("b", "modified"), ("c", "removed"), ("d", "removed"), ("e", "new")}


@pytest.mark.parametrize(("seed", "links", "task_files"), [(0, 60, 3), (1, 90, 1)])
def test_large_passes_are_put_in_order_by_phases(spark, seed, links, task_files):
    """Two repositories whose paths are the same; with cycles, or with all links one way."""
    rng = random.Random(seed)
    names = [f"m{i}" for i in range(30)]
    pairs = {tuple(rng.sample(range(30), 2)) for _ in range(links)}
    pairs = {(max(p), min(p)) for p in pairs} if seed else pairs | {(0, 1), (1, 0), (2, 2)}
    files = spark.createDataFrame([(f"r{i % 2}", "p", n, rng.randrange(3), rng.randrange(4)) for i, n in enumerate(names)], "repo_id string, pass string, path string, layer_rank int, fan_in long")
    edges = spark.createDataFrame([(r, names[a], names[b]) for r in ("r0", "r1") for a, b in pairs], "repo_id string, src string, dst string")
    whole = {tuple(r) for r in order.topological(files, edges).collect()}
    assert len(whole) == 30 and {tuple(r) for r in order.topological(files, edges, task_files).collect()} == whole


def test_dependents_are_exact_where_few_and_estimated_where_many(spark):
    """A star of chains with a cycle: 600 files depend on the hub, few on the others."""
    edges = [(i, i // 3 if i % 3 else 0) for i in range(1, 600)] + [(600, 1), (1, 600)]
    files, table = frames(spark, 602, edges)
    behind = {}
    for a, b in edges:
        behind.setdefault(b, set()).add(a)
    want = {}
    for p in range(602):
        seen, todo = set(), [p]
        while todo:
            new = behind.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        want[p] = seen - {p}
    got = {r.path: r for r in spread.dependents(files, table, most=30).collect()}
    assert set(got) == set(want) and any(not r.exact for r in got.values())
    for p, r in got.items():
        assert r.exact == (len(want[p]) < 30)
        assert set(r.dependents) == want[p] and r.n_dependents == len(want[p]) if r.exact else abs(r.n_dependents - len(want[p])) <= 0.1 * len(want[p]) + 1
