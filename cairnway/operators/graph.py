"""The dependency graph as tables: ``files(path)``, ``imports(src, source)``, ``resolved(src, source, dst)``, ``edges(src, dst)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnway.plans.fixpoint import reach
from cairnway.plans.staging import staged


def build_edges(imports: DataFrame, resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct edges whose target is a known file."""
    return known_edges(imports.select("src", "source").join(resolved, ["src", "source"]), files)


def known_edges(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """As ``build_edges``, where ``resolved`` holds nothing but the imports in question."""
    return resolved.select("src", "dst").distinct().join(files.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst")


def external_uses(imports: DataFrame, resolved: DataFrame, files: DataFrame) -> DataFrame:
    """``src, source``: imports that no known file answers."""
    known = resolved.join(files.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "source")
    return imports.select("src", "source").join(known, ["src", "source"], "left_anti")


def external_deps(imports: DataFrame, resolved: DataFrame, files: DataFrame) -> DataFrame:
    """``source, imported_by`` of the external uses; where a source may have very many importers, ``external_counts`` counts them instead."""
    return external_uses(imports, resolved, files).groupBy("source").agg(F.array_sort(F.collect_set("src")).alias("imported_by"))


def external_counts(imports: DataFrame, resolved: DataFrame, files: DataFrame) -> DataFrame:
    """``source, n_files``: how many files use an external source."""
    return external_uses(imports, resolved, files).groupBy("source").agg(F.count_distinct("src").alias("n_files"))


def node_metrics(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``path, fan_in, fan_out, is_leaf, is_root``; counts are pre-aggregated, so a hub costs one row a task."""
    end = lambda name, n_in, n_out: F.struct(F.col(name).alias("path"), F.lit(n_in).alias("i"), F.lit(n_out).alias("o"))
    degrees = edges.select(F.explode(F.array(end("src", 0, 1), end("dst", 1, 0))).alias("e")).groupBy("e.path").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    joined = files.join(degrees, "path", "left").na.fill(0, ["fan_in", "fan_out"])
    return joined.withColumns({"is_leaf": F.col("fan_in") == 0, "is_root": F.col("fan_out") == 0})


def adjacency(edges: DataFrame) -> DataFrame:
    """``path, imports, imported_by``: both sorted neighbour lists of every linked file."""
    out = edges.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    into = edges.groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("imported_by"))
    none = F.array().cast(out.schema["imports"].dataType)
    return out.join(into, "path", "full").select("path", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def symbol_usage(exports: DataFrame, uses: DataFrame) -> DataFrame:
    """``exports(path, name)`` with ``callers`` and ``used_by``; ``uses(src, dst, name)``.  Unused exports stay, with 0."""
    named = uses.select(F.col("dst").alias("path"), "name", "src").distinct()
    joined = exports.select("path", "name").distinct().join(named, ["path", "name"], "left")
    return joined.groupBy("path", "name").agg(F.count("src").alias("callers"), F.array_sort(F.collect_set("src")).alias("used_by"))


def caller_tier(count: str = "fan_in"):
    """0 dead, 1-2 low, 3-7 normal, 8 and more hot."""
    n = F.col(count)
    return F.when(n == 0, "dead").when(n <= 2, "low").when(n <= 7, "normal").otherwise("hot")


def importance_tier(score: str = "importance"):
    n = F.col(score)
    return F.when(n >= 0.75, "critical").when(n >= 0.5, "important").when(n >= 0.25, "standard").otherwise("low")


def cycle_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges inside a strongly connected component, self-loops included; ``members(path, scc)``."""
    a = members.select(F.col("path").alias("src"), F.col("scc").alias("_a"))
    b = members.select(F.col("path").alias("dst"), F.col("scc").alias("_b"))
    return edges.join(a, "src").join(b, "dst").filter("_a = _b").select("src", "dst")


def induced_subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in ``keep(path)``."""
    return edges.join(keep.select(F.col("path").alias("src")), "src", "left_semi").join(keep.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst")


def feature_areas(files: DataFrame, depth: int = 1) -> DataFrame:
    """``files(path, layer)`` rolled up by their first ``depth`` directories."""
    parts = F.split("path", "/")
    area = F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1)), "/")
    return files.groupBy(area.alias("area")).agg(F.count("*").alias("n_files"), F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"))


def backbone(files: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` most imported files (a report of fixed length)."""
    return files.orderBy(F.desc("fan_in"), "path").limit(k).select("path", "fan_in")


def find_symbol(order: DataFrame) -> DataFrame:
    """``symbol, path``: for each exported name the first file of the order that exports it; ``order(index, path, exports)``."""
    named = order.select("index", "path", F.explode("exports").alias("symbol"))
    return named.groupBy("symbol").agg(F.min_by("path", F.struct("index", "path")).alias("path"))


def blast_result(symbol: str, order: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """One row ``symbol, source_file, affected_files, affected_count``: the files that depend on the symbol's file, sorted; no row if nothing exports it.

    More than ``most`` files are counted only (``affected_files`` is null); ``fixpoint.reach`` gives them as rows.
    """
    home = find_symbol(order.select("index", "path", F.filter("exports", lambda x: x == symbol).alias("exports")))
    home = staged(home, "symbol")  # a row at most
    found = reach(home.select("path"), edges).select("path")
    total = found.agg(F.count("*").alias("affected_count"))
    named = found.orderBy("path").limit(most + 1).agg(F.array_sort(F.collect_list("path")).alias("affected_files"))
    few = F.when(F.col("affected_count") <= most, F.col("affected_files")).alias("affected_files")
    rows = home.join(F.broadcast(total), F.lit(True)).join(F.broadcast(named), F.lit(True))  # single rows
    return rows.select("symbol", F.col("path").alias("source_file"), few, "affected_count")


def dir_tree(files: DataFrame, group: str = "layer") -> DataFrame:
    """Directories of ``files(path, <group>)`` with chains of lone directories drawn together.

    ``<group>, dir, label, n_files, n_below``: a directory whose only content is one directory is merged into it, and
    ``label`` holds the merged names.  ``n_files``: files in the directory itself; ``n_below``: in it and below.
    """
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.struct(F.array_join(F.slice("parts", F.lit(1), k), "/").alias("dir"), (k == F.size("parts") - 1).alias("own")))
    above = files.select(group, parts.alias("parts")).filter(F.size("parts") > 1).select(group, F.explode(ups).alias("u")).select(group, "u.*")
    dirs = above.groupBy(group, "dir").agg(F.count_if("own").alias("n_files"), F.count("*").alias("n_below"))
    parent = F.when(F.contains("dir", F.lit("/")), F.regexp_replace("dir", "/[^/]*$", ""))
    dirs = dirs.withColumn("parent", parent)
    children = dirs.filter("parent is not null").groupBy(group, F.col("parent").alias("dir")).agg(F.count("*").alias("n_dirs"))
    dirs = dirs.join(children, [group, "dir"], "left").withColumn("chained", (F.col("n_files") == 0) & (F.coalesce("n_dirs", F.lit(0)) == 1))
    # A kept directory's label begins below its nearest kept ancestor: the deepest of its prefixes that is kept.
    kept = staged(dirs.filter("not chained").select(group, "dir", "n_files", "n_below"), "dirs")
    depth = F.size(F.split("dir", "/"))
    prefixes = kept.select(group, "dir", F.explode(F.when(depth > 1, F.transform(F.sequence(F.lit(1), depth - 1), lambda k: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), k), "/")))).alias("up"))
    nearest = prefixes.join(kept.select(group, F.col("dir").alias("up")), [group, "up"], "left_semi").groupBy(group, "dir").agg(F.max(F.length("up")).alias("_cut"))
    label = F.when(F.col("_cut").isNull(), F.col("dir")).otherwise(F.substr("dir", F.col("_cut") + 2))
    return kept.join(nearest, [group, "dir"], "left").select(group, "dir", label.alias("label"), "n_files", "n_below")


def by_locale(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in the order of a reader's alphabet instead of code points."""
    return rows.orderBy(*[F.collate(c, "UNICODE") for c in columns], *columns)


def contract_ratio(exports: DataFrame) -> DataFrame:
    """``path, type_share``: the share of a file's ``exports(path, name, kind)`` that are types or classes."""
    return exports.groupBy("path").agg(F.avg(F.col("kind").isin("type", "class").cast("double")).alias("type_share"))
