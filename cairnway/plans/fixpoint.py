"""Graph fixpoints as driver loops over staged frontiers.

Recursive SQL enumerates paths and stops at a row limit; these loops keep one row a node and
level.  Nodes with a single successor are not walked one by one: pointer jumping carries each to the first node behind it that
has none or several, in as many rounds as the logarithm of the longest chain.  Over what is left, each round takes
a few hops (``HOPS``) from the frontier, writes them to the shared folder and asks only whether anything is left.  What was
found is folded into one table every ``FOLD`` rounds, so that neither plans nor reading grow with depth, and the rounds' tables are deleted.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cairnway.plans.staging import scratch, staged

#: Counted edges that one task takes on to find components; more are trimmed and coloured in rounds.
ONE_TASK_EDGES = 200_000
#: Hops of a round, and rounds between foldings.
HOPS, FOLD = 2, 8
#: The least share of the edges that a round of peeling has to take for another one to follow.
PEELED_SHARE = 0.05

Stage = Callable[[DataFrame, str], DataFrame]


def jumped(single: DataFrame, stage: Stage) -> tuple[DataFrame, bool]:
    """``path, to, hops`` of ``single(path, to)``, nodes with one successor: the first node behind each that is not among them.

    Nodes whose way ends in a cycle are left out; also whether there are none.
    """
    now = stage(single.select("path", "to", F.lit(1).cast("long").alias("hops"), F.lit(True).alias("moved")), "pointers")
    most, way, whole = now.count(), 1, True
    while most:
        onward = now.select(F.col("path").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"))
        step = now.join(onward, "to", "left")
        step = step.select("path", F.coalesce("_to", "to").alias("to"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.col("_to").isNotNull().alias("moved"))
        now, way = stage(step, "pointers"), 2 * way
        whole = now.filter("moved").isEmpty()
        if whole or way > 2 * most:
            break
    return now.select("path", "to", "hops", "moved"), whole


def contracted(edges: DataFrame, pointers: DataFrame) -> DataFrame:
    """``edges`` as ``src, dst, hops`` without those of the ``jumped`` nodes, which are jumped over; an edge into one on the way to a cycle is left out."""
    rest = edges.join(pointers.select(F.col("path").alias("src")), "src", "left_anti")
    joined = rest.join(pointers.withColumnRenamed("path", "dst"), "dst", "left").filter(~F.coalesce("moved", F.lit(False)))
    return joined.select("src", F.coalesce("to", "dst").alias("dst"), (F.coalesce("hops", F.lit(0)) + 1).alias("hops"))


def walk(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``HOPS`` hops from ``start``, each with its number ``_hop``."""
    out, now = [], start
    for n in range(HOPS):
        now = step(now)
        out.append(now.withColumn("_hop", F.lit(n)))
    return reduce(DataFrame.union, out)


def peeled(edges: DataFrame, stage: Stage, least: int) -> tuple[list[DataFrame], DataFrame, int]:
    """``edges(src, dst)`` in layers, then what is left, and how many edges that is.

    A layer holds all edges of the files that nothing in the layers behind it or in the rest imports.  It ends with ``least`` edges left, or with a
    round that took few of them, as in long chains; cycles and what they import are always left.
    """
    layers, rest = [], stage(edges.select("src", "dst").distinct(), "edges")
    n, took = rest.count(), 1.0
    while n > least and took >= PEELED_SHARE:
        used = rest.select(F.col("dst").alias("src")).distinct().withColumn("_used", F.lit(True))
        tagged = stage(rest.join(used, "src", "left").select("src", "dst", F.col("_used").isNull().alias("top")), "peeled")
        layers.append(tagged.filter("top").select("src", "dst"))
        rest = tagged.filter("not top").select("src", "dst")
        left = rest.count()
        n, took = left, 1 - left / n
    return layers, rest, n


def longest_ways(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``path, depth`` of the nodes of ``(src, dst)`` rows; no depth on or in front of a cycle."""
    behind, pending, depth = defaultdict(list), defaultdict(int), {}
    for frame in frames:
        for a, b in zip(frame["src"], frame["dst"], strict=True):
            behind[b].append(a)
            pending[a] += 1
            depth[a] = depth[b] = 0
    ready = [x for x in depth if x not in pending]
    for at in ready:  # grows while it is walked
        for x in behind.get(at, ()):
            depth[x] = max(depth[x], depth[at] + 1)
            pending[x] -= 1
            if not pending[x]:
                ready.append(x)
    yield pd.DataFrame({"path": list(depth), "depth": pd.array([None if pending.get(x) else d for x, d in depth.items()], "Int64")})


def depths(files: DataFrame, edges: DataFrame, above: Sequence[DataFrame] = (), one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``path, depth``: the longest way to a file without imports; ``edges`` hold no cycle (see ``acyclic``), else ``ValueError``.

    Files that nothing imports are peeled off, layer after layer, until no more than ``one_task_edges`` edges are left for one task, or until that takes
    too many rounds and the loop over frontiers finds the rest.  Then each layer adds one hop to what it imports.  ``above``: layers peeled off before.
    """
    with scratch(files.sparkSession) as stage:
        layers, rest, n = peeled(edges, stage, one_task_edges)
        if n <= one_task_edges:
            kind = edges.schema["src"].dataType
            known = stage(rest.coalesce(1).mapInPandas(longest_ways, StructType([StructField("path", kind), StructField("depth", LongType())])), "depths")
            if not known.filter("depth is null").isEmpty():
                raise ValueError("the edges hold a cycle")
        else:
            known = _depths_by_frontiers(rest, stage)
        recent = [known]
        for layer in reversed([*above, *layers]):
            found = reduce(DataFrame.union, recent).select(F.col("path").alias("dst"), "depth")
            hop = layer.join(found, "dst", "left").groupBy(F.col("src").alias("path")).agg((F.max(F.coalesce("depth", F.lit(0))) + 1).alias("depth"))
            recent.append(stage(hop, "depth"))
            if len(recent) > FOLD:
                recent = [stage(reduce(DataFrame.union, recent), "depths")]
        rows = files.select("path").join(reduce(DataFrame.union, recent), "path", "left")
        return staged(rows.select("path", F.coalesce("depth", F.lit(0)).cast("int").alias("depth")), "depths")


def _depths_by_frontiers(edges: DataFrame, stage: Stage) -> DataFrame:
    """``path, depth`` of the nodes of ``edges``, which are staged and distinct; 0 may be left out."""
    degrees = edges.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n"), F.any_value("dst").alias("to"))
    jumps, whole = jumped(degrees.filter("n = 1"), stage)
    if not whole:
        raise ValueError("the edges hold a cycle")
    links = stage(contracted(edges, jumps), "contracted")
    most = links.count()
    frontier = links.select(F.col("dst").alias("path")).join(links.select(F.col("src").alias("path")), "path", "left_anti").distinct().withColumn("depth", F.lit(0).cast("long"))
    best, recent, n = None, [], 0

    def step(now: DataFrame) -> DataFrame:
        reached = links.join(now.select(F.col("path").alias("dst"), "depth"), "dst")
        return reached.groupBy(F.col("src").alias("path")).agg(F.max(F.col("depth") + F.col("hops")).alias("depth"))

    longest = lambda parts: reduce(DataFrame.union, parts).groupBy("path").agg(F.max("depth").alias("depth"))
    while most:
        hops = stage(walk(frontier, step), "depth")
        recent.append(hops.select("path", "depth"))
        frontier, n = hops.filter(F.col("_hop") == HOPS - 1).select("path", "depth"), n + HOPS
        if frontier.isEmpty():
            break
        if n > most:
            raise ValueError("the edges hold a cycle")
        if len(recent) == FOLD:
            best, recent = stage(longest([*recent, best] if best else recent), "depths"), []
    best = stage(longest([*recent, best] if best else recent) if recent or best else frontier, "depths")
    behind = jumps.join(best.select(F.col("path").alias("to"), "depth"), "to", "left").select("path", (F.col("hops") + F.coalesce("depth", F.lit(0))).alias("depth"))
    return best.join(jumps.select("path"), "path", "left_anti").select("path", "depth").union(behind)


def acyclic(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``edges`` without those inside a component; members keep their own depth."""
    a = members.select(F.col("path").alias("src"), F.col("scc").alias("_a"))
    b = members.select(F.col("path").alias("dst"), F.col("scc").alias("_b"))
    tagged = edges.join(a, "src", "left").join(b, "dst", "left")
    return tagged.filter(~F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)) & (F.col("src") != F.col("dst"))).select("src", "dst")


def reach(seeds: DataFrame, edges: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """``path, seed, level``: files that depend on a seed, directly or not.

    ``seeds(path)``.  Excluded files are neither reported nor passed through.  A file keeps the
    first level that reaches it, and there the smallest seed.  Seeds are not reported, unless a cycle leads back (level > 0).
    """
    with scratch(seeds.sparkSession) as stage:
        starts = stage(seeds.select("path").distinct(), "seeds")
        edges = stage(edges.select("src", "dst").distinct(), "edges")
        closed = stage(excluded.select("path").distinct(), "closed") if excluded is not None else starts.limit(0)
        open_ = edges.join(closed.select(F.col("path").alias("src")), "src", "left_anti")
        # A way that comes to a closed file ends there, unless it is a seed.
        blocked = closed.join(starts, "path", "left_anti").select(F.col("path").alias("dst"))
        degrees = open_.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n"), F.any_value("dst").alias("to"))
        jumps = jumped(degrees.filter("n = 1").join(starts, "path", "left_anti"), stage)[0]
        links = stage(contracted(open_, jumps).join(blocked, "dst", "left_anti"), "contracted")
        frontier = starts.select("path", F.col("path").alias("seed"), F.lit(0).cast("long").alias("level"))
        best, recent = None, []

        def step(now: DataFrame) -> DataFrame:
            reached = links.join(now.select(F.col("path").alias("dst"), "seed", "level"), "dst")
            least = reached.groupBy(F.col("src").alias("path")).agg(F.min(F.struct((F.col("level") + F.col("hops")).alias("level"), "seed")).alias("_b"))
            return least.select("path", "_b.seed", "_b.level")

        def least(parts: list[DataFrame]) -> DataFrame:
            rows = reduce(DataFrame.union, parts).groupBy("path").agg(F.min(F.struct("level", "seed")).alias("_b"))
            return rows.select("path", "_b.seed", "_b.level")

        while not frontier.isEmpty():
            hops = walk(frontier, step)
            if best is not None or recent:
                known = reduce(DataFrame.union, [*recent, best] if best is not None else recent)
                known = known.select(F.col("path").alias("_path"), F.struct("level", "seed").alias("_known"))
                hops = hops.join(known, (F.col("path") == F.col("_path")) & (F.col("_known") <= F.struct("level", "seed")), "left_anti")
            hops = stage(hops, "reach")
            recent.append(hops.select("path", "seed", "level"))
            frontier = hops.filter(F.col("_hop") == HOPS - 1).select("path", "seed", "level")
            if len(recent) == FOLD:
                best, recent = stage(least([*recent, best] if best is not None else recent), "reached"), []
        found = least([*recent, best] if best is not None else recent) if recent or best is not None else frontier
        whole = found.unionByName(starts.select("path", F.col("path").alias("seed"), F.lit(0).cast("long").alias("level")))
        first = least([whole.select("path", "seed", "level")]).select(F.col("path").alias("to"), "seed", "level")
        behind = jumps.filter("not moved").join(blocked.withColumnRenamed("dst", "to"), "to", "left_anti").join(first, "to").select("path", "seed", (F.col("level") + F.col("hops")).alias("level"))
        return staged(found.select("path", "seed", "level").union(behind).select("path", "seed", F.col("level").cast("int").alias("level")), "reached")


def cores(edges: DataFrame) -> DataFrame:
    """``edges`` without those that touch a node lacking successors or predecessors, again and again."""
    now, n = staged(edges.select("src", "dst").distinct(), "core"), -1
    while n != (n := now.count()):
        now = staged(
            now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"),
            "core",
        )
    return now


def strong_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``path, scc`` of the components of two or more among ``(src, dst)`` rows: two depth-first walks, without recursion."""
    ahead, behind = defaultdict(list), defaultdict(list)
    for frame in frames:
        for a, b in zip(frame["src"], frame["dst"], strict=True):
            ahead[a].append(b)
            behind[b].append(a)
    left_last, seen = [], set()
    for start in list(ahead):
        if start in seen:
            continue
        seen.add(start)
        walk = [(start, iter(ahead[start]))]
        while walk:
            at, rest = walk[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                left_last.append(at)
                walk.pop()
            else:
                seen.add(step)
                walk.append((step, iter(ahead.get(step, ()))))
    waiting, rows = set(left_last), []
    for start in reversed(left_last):
        if start in waiting:
            waiting.discard(start)
            group = [start]
            for at in group:  # grows while it is walked
                new = [x for x in dict.fromkeys(behind.get(at, ())) if x in waiting]
                waiting.difference_update(new)
                group += new
            if len(group) > 1:
                name = max(group)
                rows += [(x, name) for x in group]
    yield pd.DataFrame(rows, columns=["path", "scc"])


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``path, scc``: members of strongly connected components of two or more, or with a self-loop; ``scc`` is the largest member.

    Peel and trim, colour forwards by the largest node that reaches each, then walk back from each colour's
    root inside its colour: what both reach is a component.  Repeat on what is left; as soon as that has no more
    than ``one_task_edges`` edges, one task finishes it.
    """
    loops = edges.filter("src = dst").select(F.col("src").alias("path"), F.col("src").alias("scc")).distinct()
    out = []
    left, n = peeled(edges.filter("src <> dst"), staged, one_task_edges)[1:]
    if n > one_task_edges:
        left = cores(left)
    while (n := left.count()) > 0:
        if n <= one_task_edges:
            kind = edges.schema["src"].dataType
            out.append(staged(left.coalesce(1).mapInPandas(strong_groups, StructType([StructField("path", kind), StructField("scc", kind)])), "scc"))
            break
        nodes = left.select(F.col("src").alias("path")).union(left.select("dst")).distinct()
        colour = staged(nodes.select("path", F.col("path").alias("colour")), "colour")
        while True:
            pushed = left.join(colour.withColumnRenamed("path", "src"), "src").groupBy(F.col("dst").alias("path")).agg(F.max("colour").alias("new"))
            merged = staged(colour.join(pushed, "path", "left").select("path", F.greatest("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") > F.col("colour")).alias("moved")), "colour")
            colour = merged.select("path", "colour")
            if merged.filter("moved").isEmpty():
                break
        tag = lambda end: colour.select(F.col("path").alias(end), F.col("colour").alias(f"_{end}"))
        inside = staged(left.join(tag("src"), "src").join(tag("dst"), "dst").filter("_src = _dst").select("src", "dst", F.col("_src").alias("colour")), "inside")
        back = staged(colour.filter("path = colour"), "back")
        layers = [back]
        while True:
            seen = reduce(DataFrame.union, layers)
            step = inside.join(back.select(F.col("path").alias("dst")), "dst", "left_semi").select(F.col("src").alias("path"), "colour").distinct()
            back = staged(step.join(seen.select("path"), "path", "left_anti"), "back")
            if back.isEmpty():
                break
            layers.append(back)
        members = staged(reduce(DataFrame.union, layers).select("path", F.col("colour").alias("scc")), "scc")
        sizes = members.groupBy("scc").agg(F.count("*").alias("n")).filter("n > 1")
        out.append(members.join(sizes, "scc", "left_semi").select("path", "scc"))
        gone = members.select("path")
        left = cores(left.join(gone.withColumnRenamed("path", "src"), "src", "left_anti").join(gone.withColumnRenamed("path", "dst"), "dst", "left_anti"))
    found = reduce(DataFrame.union, out) if out else loops.limit(0)
    return found.union(loops.join(found.select("path"), "path", "left_anti").select("path", "scc"))


def components_and_depths(files: DataFrame, edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> tuple[DataFrame, DataFrame]:
    """``components(edges)`` and ``depths(files, acyclic(edges, components))`` of edges that are peeled once: what is peeled off is in no cycle."""
    with scratch(files.sparkSession) as stage:
        above, rest, _ = peeled(edges.filter("src <> dst"), stage, one_task_edges)
        members = staged(components(rest.union(edges.filter("src = dst").select("src", "dst")), one_task_edges), "cycles")
        return members, depths(files, acyclic(rest, members), above, one_task_edges)
