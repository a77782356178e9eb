"""Source trees as tables: names from a data source, pruned by rules that are rows."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnway.functions.paths import basename, bracket, dirname, short_hash, stem, suffix
from cairnway.plans.staging import staged
from cairnway.sources.tree_source import LANGUAGES, read_tree

def language(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, ends in LANGUAGES.items():
        out = F.when(suffix(path).isin(*ends.split()), name).otherwise(out)
    return out


def in_test_dir_or_name(path: Column) -> Column:
    """The walker's own test flag: by name, or below a directory called tests or test."""
    named = (basename(path) == "conftest.py") | stem(path).rlike("^(test_.*|.*_test)$")
    return named | F.arrays_overlap(F.split(dirname(path), "/"), F.array(F.lit("tests"), F.lit("test")))


def ignore_regex(pattern: str) -> str:
    """One line of an ignore file as a regular expression over a path relative to that file: ``*`` and ``?`` stay inside a name, ``**`` crosses directories."""
    anchored = "/" in pattern.rstrip("/")
    out = ""
    for piece in re.findall(r"\*\*/|/\*\*|\*+|\?|\[!?\]?[^\]]*\]|\\.|.", pattern.strip("/"), re.S):
        if piece[0] == "[" and len(piece) > 1:
            out += bracket(piece[1:-1])
        else:
            out += {"**/": "(?:.*/)?", "/**": "/.*", "?": "[^/]"}.get(piece, "[^/]*" if piece[0] == "*" else re.escape(piece[-1]))
    return ("^" if anchored else "(?:^|/)") + out + ("/" if pattern.endswith("/") else "(?:/|$)")


RULES = "at string, line int, pattern string, drops boolean"


def rules_of(lines: DataFrame) -> DataFrame:
    """``at, line, pattern, drops``: the rules among the ``lines(at, line, text)`` of ignore files in the directories ``at`` ("" is the root)."""

    @F.pandas_udf("string")
    def pattern(rules: pd.Series) -> pd.Series:
        return rules.map(lambda r: ignore_regex(r.removeprefix("!")))

    rule = lines.select("at", "line", F.trim("text").alias("rule")).filter("rule <> '' and not startswith(rule, '#')")
    return rule.select("at", "line", pattern("rule").alias("pattern"), (~F.startswith("rule", F.lit("!"))).alias("drops"))


def lines_of(files: DataFrame) -> DataFrame:
    """``at, line, text`` of ignore files ``(path, content)``."""
    return files.select(dirname(F.col("path")).alias("at"), F.posexplode(F.split(F.col("content").cast("string"), "\r\n|\n|\r")).alias("line", "text"))


def folders_of(path: Column) -> Column:
    """All directories that a path lies in, from the root ("")."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``path``: those of ``paths(path, is_dir)`` that some directory's rules drop.

    Each path meets the rules of the directories it lies in.  Of one directory's rules the last that matches decides; a deeper
    negation cannot bring back what a directory above drops.
    """
    named = F.when(F.col("is_dir"), F.concat("path", F.lit("/"))).otherwise(F.col("path"))
    met = paths.select("path", named.alias("_name"), F.explode(folders_of(F.col("path"))).alias("at")).join(rules, "at")
    inside = F.substr("_name", F.when(F.col("at") == "", 1).otherwise(F.char_length("at") + 2))
    hits = met.filter(F.rlike(inside, F.col("pattern"))).groupBy("path", "at").agg(F.max_by("drops", "line").alias("drops"))
    return hits.filter("drops").select("path").distinct()


def kept_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files(path, ...)`` but for those that are ignored themselves or lie in an ignored directory."""
    held = files.select("path", F.explode(folders_of(F.col("path"))).alias("folder")).filter("folder <> ''")
    folders = ignored(held.select(F.col("folder").alias("path")).distinct().withColumn("is_dir", F.lit(True)), rules)
    below = held.join(folders.withColumnRenamed("path", "folder"), "folder", "left_semi").select("path")
    return files.join(below.union(ignored(files.select("path", F.lit(False).alias("is_dir")), rules)), "path", "left_anti")


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """``path, content`` of ``paths(path)``; a file that cannot be read is left out."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["path"]:  # a file a frame: contents can be large
                try:
                    with open(os.path.join(root, name), "rb") as file:
                        yield pd.DataFrame({"path": [name], "content": [file.read()]})
                except OSError:
                    continue

    return paths.select("path").mapInPandas(read, "path string, content binary")


def scan_tree(spark: SparkSession, root: str, specs: dict[str, list[str]] | None = None, ignore_name: str | None = ".gitignore", extra: tuple[str, ...] = ()) -> DataFrame:
    """``path`` (relative to ``root``), ``language, content, hash, is_test`` of every source file, and of files named in ``extra`` (language null).

    ``root`` is a folder that all executors see under this name.  Spark's own file sources pass over names such as ``__init__.py``, so the names come from
    ``tree_source``; contents are read once, by the tasks that need them.  The rules of ignore files called ``ignore_name`` are rows,
    joined to what lies below them; ``specs`` adds rules of one's own by directory, before those of the files.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    names = staged(read_tree(spark, root, content=False).select("path"), "tree")
    own = [(at, i - len(lines), line) for at, lines in (specs or {}).items() for i, line in enumerate(lines)]
    lines = spark.createDataFrame(own, "at string, line int, text string")
    if ignore_name:
        lines = lines.union(lines_of(read_files(names.filter(basename(F.col("path")) == ignore_name), root)))
    rules = staged(rules_of(lines), "ignore-rules")
    wanted = names.filter(language(F.col("path")).isNotNull() | basename(F.col("path")).isin(*extra))
    files = read_files(kept_files(wanted, rules), root)
    return files.select("path", language(F.col("path")).alias("language"), "content", short_hash(F.col("content")).alias("hash"), in_test_dir_or_name(F.col("path")).alias("is_test"))
