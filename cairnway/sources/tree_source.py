"""Source trees as a batch data source: ``spark.read.format("source_tree").load(root)``.

A partition is a directory with all below it, or the files of one directory above those.  The planner lists directories level by level until there are
``shards`` of them, so it meets a bounded part of a large tree; the tasks walk the rest.  Conditions on ``language`` (equal, in) and on a
prefix of ``path`` are pushed down: directories that no such path can lie in are not listed.  ``content`` is read unless the option ``content`` is ``false``.

Defined results: links are left out, directories named in ``SKIPPED`` are not entered; what cannot be listed or read is left out; a root that is no
directory is an error.  The root is a folder that the driver and all executors see under one name.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

#: Directories that are never entered (fixed values).
SKIPPED = ("node_modules", "dist", "build", ".git", "__pycache__", "venv", ".venv", ".tox")
#: Suffixes by language (fixed values).
LANGUAGES = {"python": ".py .pyi", "script": ".ts .tsx .js .jsx .mjs .cjs", "go": ".go"}
SHARDS = 64


@dataclass(frozen=True)
class Shard(InputPartition):
    """A directory below the root: with all below it, or its own files only."""

    folder: str
    deep: bool


def listing(root: str, folder: str) -> tuple[list[str], list[str]]:
    """The directories and files of a directory, relative to the root and without links; nothing if it cannot be read."""
    try:
        with os.scandir(os.path.join(root, folder)) as entries:
            found = [(f"{folder}/{e.name}" if folder else e.name, e.is_dir()) for e in entries if not e.is_symlink()]
    except OSError:
        return [], []
    return sorted(p for p, is_dir in found if is_dir and os.path.basename(p) not in SKIPPED), sorted(p for p, is_dir in found if not is_dir)


class TreeReader(DataSourceReader):
    def __init__(self, root: str, shards: int, content: bool, languages: dict[str, str]):
        self.root, self.shards, self.content = root, shards, content
        self.by_suffix = {suffix: name for name, ends in languages.items() for suffix in ends.split()}
        self.prefixes: list[str] = []
        self.languages: list[frozenset] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("language",):
                self.languages.append(frozenset([f.value]))
            elif isinstance(f, In) and f.attribute == ("language",):
                self.languages.append(frozenset(f.value))
            else:
                yield f

    def language(self, path: str) -> str | None:
        return self.by_suffix.get(os.path.splitext(os.path.basename(path).lstrip("."))[1])

    def _enters(self, folder: str) -> bool:
        return all(f"{folder}/".startswith(p) or p.startswith(f"{folder}/") for p in self.prefixes)

    def _wants(self, path: str) -> bool:
        return all(path.startswith(p) for p in self.prefixes) and all(self.language(path) in names for names in self.languages)

    def partitions(self) -> list[Shard]:
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        level, above = [""], []
        while level and len(level) < self.shards:
            below = [d for folder in level for d in listing(self.root, folder)[0] if self._enters(d)]
            above += level
            level = below
        return [Shard(folder, False) for folder in above] + [Shard(folder, True) for folder in level]

    def read(self, partition: Shard) -> Iterator[tuple]:
        waiting = [partition.folder]
        while waiting:
            folders, files = listing(self.root, waiting.pop())
            if partition.deep:
                waiting += [d for d in folders if self._enters(d)]
            for path in filter(self._wants, files):
                body = None
                if self.content:
                    try:
                        with open(os.path.join(self.root, path), "rb") as file:
                            body = file.read()
                    except OSError:
                        continue
                yield path, self.language(path), body


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, language string, content binary"

    def reader(self, schema) -> TreeReader:
        languages = json.loads(self.options["languages"]) if "languages" in self.options else LANGUAGES
        return TreeReader(self.options["path"], int(self.options.get("shards", SHARDS)), self.options.get("content", "true").lower() == "true", languages)


def read_tree(spark: SparkSession, root: str, content: bool = True, shards: int = SHARDS) -> DataFrame:
    """``path, language, content`` of every file below ``root``; conditions reach the listing."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a planner's choice without bearing on results
    options = {"content": str(content).lower(), "shards": str(shards), "languages": json.dumps(LANGUAGES)}  # with those that were registered
    return spark.read.format("source_tree").options(**options).load(root)
