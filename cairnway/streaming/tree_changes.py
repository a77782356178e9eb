"""Changes of a source tree as a streaming source: files that are created, changed and deleted, once each, across restarts.

``spark.readStream.format("tree_changes").option("path", root).option("listings", folder)``.  An offset is the number of a listing; listings are written to
a folder of their own, so deletions are rows, and a batch that is read again compares the same two listings.

Defined results: ``path``, ``change`` (new, modified, removed), ``hash`` (null if removed); a file is told apart by its size and time of change;
links and directories named in ``SKIPPED`` are left out; the first batch holds every file as new.  Both folders are seen by the driver and all
executors under one name.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from cairnway.sources.tree_source import listing

SCHEMA = "path string, change string, hash string"


def present(root: str) -> Iterator[tuple[str, str]]:
    """``path, hash`` of every file, in order of path within each directory."""
    waiting = [""]
    while waiting:
        folders, files = listing(root, waiting.pop())
        waiting += reversed(folders)
        for path in files:
            try:
                seen = os.stat(os.path.join(root, path))
            except OSError:
                continue
            yield path, hashlib.sha256(f"{seen.st_mtime_ns}:{seen.st_size}".encode()).hexdigest()[:16]


class ChangesReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, listings: str):
        self.root, self.listings = root, listings

    def _path(self, number: int) -> str:
        return os.path.join(self.listings, f"{number}.json")

    def _listing(self, number: int) -> dict[str, str]:
        """The tree as it was at an offset; nothing at offset 0."""
        if number == 0:
            return {}
        with open(self._path(number), encoding="utf-8") as file:
            return json.load(file)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, now = self._listing(start["listing"]), dict(present(self.root))
        if before == now:
            return iter([]), start
        end = {"listing": start["listing"] + 1}
        os.makedirs(self.listings, exist_ok=True)
        aside = f"{self._path(end['listing'])}.new"
        with open(aside, "w", encoding="utf-8") as file:
            json.dump(now, file)
            file.flush()
            os.fsync(file.fileno())
        os.replace(aside, self._path(end["listing"]))
        return iter(self._compared(before, now)), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._compared(self._listing(start["listing"]), self._listing(end["listing"])))

    @staticmethod
    def _compared(before: dict[str, str], now: dict[str, str]) -> list[tuple]:
        changed = [(p, "modified" if p in before else "new", h) for p, h in now.items() if before.get(p) != h]
        return changed + [(p, "removed", None) for p in before if p not in now]

    def commit(self, end: dict) -> None:
        """Listings before the last finished batch are not read again."""
        for name in os.listdir(self.listings) if os.path.isdir(self.listings) else []:
            number = name.split(".")[0]
            if name.endswith(".json") and number.isdigit() and int(number) < end["listing"]:
                os.remove(os.path.join(self.listings, name))


class ChangesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> ChangesReader:
        return ChangesReader(self.options["path"], self.options["listings"])


def read_changes(spark: SparkSession, root: str, listings: str) -> DataFrame:
    """``path, change, hash`` as files below ``root`` come, change and go."""
    spark.dataSource.register(ChangesSource)
    return spark.readStream.format("tree_changes").option("path", root).option("listings", listings).load()
