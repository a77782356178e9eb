"""Layers, passes and the reading order."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway.functions.paths import basename, glob_regex, in_utility_dir, is_test, stem, tested_stem
from cairnway.plans import fixpoint
from cairnway.plans.ranks import numbered
from cairnway.plans.staging import scratch, staged

LAYERS = ("foundation", "core", "features", "integration", "entry")
PASSES = ("contracts", "data_flow", "utility")
#: File stems that state contracts (fixed values).
CONTRACT_STEMS = ("types", "interfaces", "models", "schema", "constants")
#: File names that start programs (fixed values).
ENTRY_FILES = ("main.py", "__main__.py", "app.py", "server.py", "cli.py")


def layer(depth: Column, fan_in: Column, is_entry: Column, core: int = 1, features: int = 3, integration_fan_in: int = 3) -> Column:
    """An entry wins; then by depth, and deep files by fan-in."""
    return (
        F.when(is_entry, "entry").when(depth <= 0, "foundation").when(depth <= core, "core").when(depth < features, "features")
        .when(fan_in >= integration_fan_in, "integration").otherwise("features")
    )


def is_entry_file(path: Column, has_guard: Column | bool = False) -> Column:
    return basename(path).isin(*ENTRY_FILES) | F.lit(has_guard) if isinstance(has_guard, bool) else basename(path).isin(*ENTRY_FILES) | has_guard


def layer_counts(files: DataFrame) -> DataFrame:
    """``layer, n_files``; all five layers are present."""
    spark = files.sparkSession
    all_layers = spark.createDataFrame([(x,) for x in LAYERS], "layer string")
    counts = files.groupBy("layer").agg(F.count("*").alias("n_files"))
    return all_layers.join(counts, "layer", "left").na.fill(0, ["n_files"])


def is_contract(path: Column, type_share: Column, fan_in: Column, fan_out: Column) -> Column:
    return stem(path).isin(*CONTRACT_STEMS) | (type_share >= 0.5) | ((fan_in >= 3) & (fan_out <= 1))


def glob_override(path: Column, overrides: dict[str, str]) -> Column:
    """The value of the first matching glob in sorted order, else null."""
    out = F.lit(None).cast("string")
    for glob, value in sorted(overrides.items(), reverse=True):
        out = F.when(path.rlike(glob_regex(glob)), value).otherwise(out)
    return out


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    out = F.lit(False)
    for glob in globs:
        out = out | path.rlike(glob_regex(glob))
    return out


def reading_pass(path: Column, type_share: Column, fan_in: Column, fan_out: Column, overrides: dict[str, str] | None = None) -> Column:
    """Override, utility directory, contract, else data flow; overrides hold for non-test files."""
    given = F.when(~is_test(path), glob_override(path, overrides or {}))
    natural = F.when(in_utility_dir(path), "utility").when(is_contract(path, type_share, fan_in, fan_out), "contracts").otherwise("data_flow")
    return F.coalesce(given, natural)


def reason(pass_: Column, layer_: Column, fan_in: Column, fan_out: Column, paired_with: Column | None = None) -> Column:
    """Why a file stands where it does, in words."""
    where = F.concat(F.lit(" ("), layer_, F.lit(" layer)."))
    contract = F.concat(F.lit("Contract surface"), where, F.when(fan_in > 0, F.format_string(" Imported by %d file(s).", fan_in)).otherwise(""))
    flow = F.concat(F.lit("Data flow path"), where, F.when(fan_out > 0, F.format_string(" Depends on %d file(s).", fan_out)).otherwise(""))
    said = F.when(pass_ == "contracts", contract).when(pass_ == "data_flow", flow).otherwise(F.concat(F.lit("Utility code"), where))
    if paired_with is None:
        return said
    return F.when(paired_with.isNotNull(), F.concat(F.lit("Test file for "), paired_with, F.lit("."))).otherwise(said)


def is_script_entry(path: Column) -> Column:
    """Whether a script's stem is one that starts programs; nothing else depends on it."""
    return stem(path).isin("index", "main", "app")


def is_trivial_init(path: Column, n_imports: Column, n_exports: Column, n_functions: Column) -> Column:
    """A package file without functions that does not pass on what it imports."""
    return (basename(path) == "__init__.py") & (n_functions == 0) & ~((n_imports > 0) & (n_exports > 0))


def is_reexport(path: Column, n_imports: Column, n_exports: Column) -> Column:
    return (basename(path) == "__init__.py") & (n_imports > 0) & (n_exports > 0)


def in_scripts(path: Column, scripts: dict[str, str]) -> Column:
    """Whether a declared script (``module.leaf:function``) names the file's stem as its leaf."""
    return stem(path).isin(*sorted({spec.split(":")[0].rsplit(".", 1)[-1] for spec in scripts.values()})) if scripts else F.lit(False)


def is_entry(path: Column, fan_in: Column, has_guard: Column, has_side_effects: Column, scripts: dict[str, str] | None = None) -> Column:
    """A program guard, a telling name, a declared script, or a module that acts when loaded and that nothing imports."""
    return has_guard | basename(path).isin(*ENTRY_FILES) | in_scripts(path, scripts or {}) | ((fan_in == 0) & has_side_effects)


def pair_tests(files: DataFrame) -> DataFrame:
    """``test, impl``: each test file with the first implementation file of its stem; conftest has none."""
    tests = files.filter(is_test(F.col("path")) & (basename(F.col("path")) != "conftest.py")).select(F.col("path").alias("test"), tested_stem(F.col("path")).alias("_s"))
    impls = files.filter(~is_test(F.col("path"))).groupBy(stem(F.col("path")).alias("_s")).agg(F.min("path").alias("impl"))
    return tests.join(impls, "_s").select("test", "impl")


PLACED = "repo_id string, pass string, path string, pos long"


def _greedy(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Kahn's order by (layer rank, -fan_in, path); files on or behind a cycle come last, by the same key.  Repositories, passes and blocks are apart."""
    key = {(r.repo_id, r.reading_pass, r.path): (r.block, r.layer_rank, -r.fan_in, r.path, r.repo_id, r.reading_pass) for r in nodes.rename(columns={"pass": "reading_pass"}).itertuples()}
    pending, unlocks = dict.fromkeys(key, 0), {p: [] for p in key}
    for repo, reading, src, dst in zip(edges["repo_id"], edges["pass"], edges["src"], edges["dst"], strict=True):
        pending[repo, reading, src] += 1  # a file waits for what it imports
        unlocks[repo, reading, dst].append((repo, reading, src))
    ready = [(k, p) for p, k in key.items() if not pending[p]]
    heapq.heapify(ready)
    order = []
    while ready:
        at = heapq.heappop(ready)[1]
        order.append(at)
        for p in unlocks[at]:
            pending[p] -= 1
            if pending[p] == 0:
                heapq.heappush(ready, (key[p], p))
    done = set(order)
    order += sorted((p for p in key if p not in done), key=key.get)
    repos, passes, paths = zip(*order, strict=True) if order else ((), (), ())
    return pd.DataFrame({"repo_id": repos, "pass": passes, "path": paths, "pos": range(len(order))})


#: Files of one repository's pass that one task puts in order; larger passes are split.
TASK_FILES = 100_000
GROUP = ["repo_id", "pass"]


def topological(files: DataFrame, edges: DataFrame, task_files: int = TASK_FILES) -> DataFrame:
    """``repo_id, pass, path, pos``: the greedy order inside each repository and pass.

    ``files(repo_id, pass, path, layer_rank, fan_in)``, ``edges(repo_id, src, dst)``.  A pass of at most ``task_files`` files is put in order by
    one task; a larger one is first cut into phases (``phases``), which are put in order side by side.
    """
    ends = lambda end: files.select("repo_id", F.col("path").alias(end), F.col("pass").alias(f"_{end}"))
    own = edges.join(ends("src"), ["repo_id", "src"]).join(ends("dst"), ["repo_id", "dst"]).filter("_src = _dst").select("repo_id", F.col("_src").alias("pass"), "src", "dst").distinct()
    nodes = files.select(*GROUP, "path", "layer_rank", "fan_in")
    large = staged(nodes.groupBy(*GROUP).agg(F.count("*").alias("n")).filter(F.col("n") > task_files).select(*GROUP), "large-passes")
    whole = lambda nodes, edges: nodes.withColumn("block", F.lit("")).groupBy(*GROUP).cogroup(edges.groupBy(*GROUP)).applyInPandas(_greedy, PLACED)
    if large.isEmpty():
        return whole(nodes, own)
    rest = lambda df, how: df.join(large, GROUP, how)
    return whole(rest(nodes, "left_anti"), rest(own, "left_anti")).union(_in_phases(rest(nodes, "left_semi"), staged(rest(own, "left_semi"), "order-edges"), task_files))


def phases(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``nodes`` with ``name``: the largest ``key`` among each node and all that it waits for, directly or not, inside its ``GROUP`` and ``block``.

    In the greedy order a file with a larger key than all before it comes up only when everything that a smaller key can release
    is placed.  So files come up in order of this value, and those that share it follow the file that has it as its key.
    """
    with scratch(nodes.sparkSession) as stage:
        by = [*GROUP, "block"]
        now = stage(nodes.withColumn(name, F.col("key")), "phases")
        moved = now
        while True:
            met = edges.join(moved.select(*by, F.col("path").alias("dst"), name), [*by, "dst"]).groupBy(*by, F.col("src").alias("path")).agg(F.max(name).alias("_met"))
            moved = stage(now.join(met, [*by, "path"]).filter(F.col("_met") > F.col(name)).select(*by, "path", F.col("_met").alias(name)), "phases-moved")
            if moved.isEmpty():
                return staged(now, "phases")
            now = stage(now.join(moved.withColumnRenamed(name, "_met"), [*by, "path"], "left").withColumn(name, F.coalesce("_met", name)).drop("_met"), "phases")


#: How often what is too large for a task is cut anew.
CUTS = 4


def _in_phases(nodes: DataFrame, edges: DataFrame, task_files: int) -> DataFrame:
    """The order of large passes.  Files on or behind a cycle never come up and go last, by key.  All others are cut into phases; a phase that is
    still too large starts with the file that names it, and what follows is cut again, ``CUTS`` times in all, before it goes to a task as it is."""
    key = F.struct(F.col("layer_rank").cast("long").alias("rank"), (-F.col("fan_in")).cast("long").alias("fan"), "path")
    # Paths are unique in a repository only.
    label = lambda c: F.concat_ws("\0", *GROUP, c)
    unlabel = [F.split("path", "\0")[i].alias(c) for i, c in enumerate([*GROUP, "path"])]
    linked = edges.select(label("src").alias("src"), label("dst").alias("dst"))
    rings = staged(fixpoint.components(linked).select("path"), "order-rings")
    none = F.array().cast("array<struct<rank:bigint,fan:bigint,path:string>>")
    late = staged((rings if rings.isEmpty() else rings.union(fixpoint.reach(rings, linked).select("path"))).distinct().select(*unlabel), "order-late")
    todo = nodes.join(late, [*GROUP, "path"], "left_anti").withColumns({"key": key, "block": F.lit(""), "place": none})
    by, done = [*GROUP, "block"], []
    for cut in range(CUTS):
        todo = staged(todo, "order-todo")
        home = lambda end, todo=todo: todo.select(*GROUP, F.col("path").alias(end), F.col("block").alias(f"_{end}"))
        inside = edges.join(home("src"), [*GROUP, "src"]).join(home("dst"), [*GROUP, "dst"]).filter("_src = _dst").select(*GROUP, F.col("_src").alias("block"), "src", "dst")
        found = phases(todo, staged(inside, "order-inside"), "phase")
        found = found.withColumns({"block": F.concat_ws("\0", "block", "phase.path"), "place": F.concat("place", F.array("phase"))})
        sizes = found.groupBy(*by).agg((F.count("*") > task_files).alias("_large"))
        found = staged(found.join(sizes, by), "order-cut")
        final = F.lit(cut == CUTS - 1)
        done.append(found.filter(~F.col("_large") | (F.col("key") == F.col("phase")) | final).select(*by, "path", "layer_rank", "fan_in", "key", "place", (F.col("_large") & ~final).alias("_alone")))
        todo = found.filter(F.col("_large") & (F.col("key") != F.col("phase")) & ~final).select(*by, "path", "layer_rank", "fan_in", "key", "place")
        if todo.isEmpty():
            break
    rows = staged(reduce(DataFrame.union, done), "order-blocks")
    # Blocks are mostly small, so a task takes many; the place of a file that opens a large phase is before all of the phase.
    tasks = max(1, -(-4 * rows.count() // task_files))
    block = F.when("_alone", F.concat_ws("\0", "block", F.lit("first"))).otherwise(F.col("block")) if False else F.col("block")
    dealt = rows.select(*GROUP, "path", "layer_rank", "fan_in", block.alias("block"), F.pmod(F.xxhash64(*by), F.lit(tasks)).alias("_task"))
    ends = lambda end: rows.filter("not _alone").select(*GROUP, F.col("path").alias(end), F.col("block").alias(f"_{end}"))
    links = edges.join(ends("src"), [*GROUP, "src"]).join(ends("dst"), [*GROUP, "dst"]).filter("_src = _dst")
    links = links.select(*GROUP, "src", "dst", F.pmod(F.xxhash64(*GROUP, F.col("_src")), F.lit(tasks)).alias("_task"))
    placed = dealt.groupBy("_task").cogroup(links.groupBy("_task")).applyInPandas(_greedy, PLACED)
    inside = rows.join(placed, [*GROUP, "path"]).select(*GROUP, "path", "key", "place", "pos", F.lit(False).alias("late"))
    behind = nodes.join(late, [*GROUP, "path"], "left_semi").select(*GROUP, "path", key.alias("key"), none.alias("place"), F.lit(0).cast("long").alias("pos"), F.lit(True).alias("late"))
    every = inside.union(behind).withColumnRenamed("pos", "_pos")
    return numbered(every, GROUP, [F.col(c) for c in ("late", "place", "_pos", "key")], "pos").select(*GROUP, "path", "pos")


def plain_and_tests(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return files.filter(~is_test(F.col("path"))), files.filter(is_test(F.col("path")))


def _behind(plain: DataFrame, own: DataFrame, home: DataFrame, tests: str) -> DataFrame:
    """``own`` tests with the first implementation file of their stem among ``plain`` and what ``home(repo_id, path, pass, ...)`` says of that; ``pass`` is never null."""
    tested = own.select("repo_id", "path").withColumn("_s", F.when(basename(F.col("path")) != "conftest.py", tested_stem(F.col("path"))))
    stems = plain.groupBy("repo_id", stem(F.col("path")).alias("_s")).agg(F.min("path").alias("impl"))
    default = tests if tests in PASSES else "utility"
    found = tested.join(stems, ["repo_id", "_s"], "left").join(home.withColumnRenamed("path", "impl"), ["repo_id", "impl"], "left")
    more = [c for c in home.columns if c not in ("repo_id", "path", "pass")]
    return found.select("repo_id", "path", F.coalesce("pass", F.lit(default)).alias("pass"), *more, F.col("impl").alias("paired_with"))


def companions(files: DataFrame, tests: str = "utility") -> DataFrame:
    """``files`` with ``pass`` and ``paired_with`` as ``reading_order`` has them; nothing has to be put in order for that."""
    plain, own = plain_and_tests(files)
    rows = plain.withColumn("paired_with", F.lit(None).cast("string"))
    if tests == "skip" or own.isEmpty():
        return rows
    behind = _behind(plain, own, plain.select("repo_id", "path", "pass"), tests)
    return rows.unionByName(own.drop("pass").join(behind, ["repo_id", "path"]))


def reading_order(files: DataFrame, edges: DataFrame, tests: str = "utility") -> DataFrame:
    """``repo_id, index, path, pass, paired_with``: passes one after the other, paired tests right behind what they test, other tests last.

    ``files`` as for ``topological``.  ``tests``: the pass that tests without a pair are counted to, ``separate``
    (all tests come last, in greedy order) or ``skip`` (none come).
    """
    plain, own = plain_and_tests(files)
    placed = topological(plain, edges)
    rows = placed.select("repo_id", "path", "pass", "pos", F.lit(0).alias("_t"), F.lit(False).alias("_last"), F.lit(None).cast("string").alias("paired_with"))
    if tests != "skip":
        behind = _behind(plain, own, placed.select("repo_id", "path", "pass", "pos"), tests)
        last = F.col("pos").isNull()
        if tests == "separate":
            sorted_ = topological(own.withColumn("pass", F.lit("tests")), edges).select("repo_id", "path", "pos")
            behind, last = behind.drop("pos").join(sorted_, ["repo_id", "path"]), F.lit(True)
        rows = rows.union(behind.select("repo_id", "path", "pass", "pos", F.lit(1).alias("_t"), last.alias("_last"), "paired_with"))
    rank = F.when(F.col("_last"), 3).when(F.col("pass") == "contracts", 0).when(F.col("pass") == "data_flow", 1).otherwise(2)
    rows = rows.withColumns({"_rank": rank, "pos": F.coalesce("pos", F.lit(0))})
    return numbered(rows, ["repo_id"], [F.col(c) for c in ("_rank", "pos", "_t", "path")], "index").select("repo_id", F.col("index").cast("int").alias("index"), "path", "pass", "paired_with")


def complexity(lines: Column, functions: Column, nesting: Column) -> Column:
    """low, medium or high: two high votes, else one high or two medium."""
    high = (lines >= 200).cast("int") + (functions > 8).cast("int") + (nesting >= 4).cast("int")
    medium = ((lines >= 50) & (lines < 200)).cast("int") + ((functions >= 3) & (functions <= 8)).cast("int") + ((nesting >= 2) & (nesting < 4)).cast("int")
    return F.when(high >= 2, "high").when((high == 1) | (medium >= 2), "medium").otherwise("low")
