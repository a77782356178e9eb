"""Running states of tool events with list and map state: highlights and export marks a workspace.

A workspace is a key; what is shown in it is a map of its files, so the state holds what is live and not what happened.  Clearing one file drops its
entry, clearing all drops the map.  With ``idle``, a workspace that stays silent for so many milliseconds is forgotten; the timers keep a query awake, so it is for
queries that run on, not for those that stop when all is read.  State is kept by RocksDB, which Spark asks for where states are maps and lists.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Workspace(StatefulProcessor):
    """Keeps one map a workspace, goes through events in order of ``id`` and gives what has changed; ids that were seen are passed over."""

    names: list[str]
    value = "value string"

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getMapState("live", "key string", self.value)
        self.last = handle.getValueState("last", "id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else -1
        touched: dict[str, None] = {}
        for r in pd.concat(list(rows)).sort_values("id").itertuples():
            if r.id > last:
                last = int(r.id)
                touched.update(dict.fromkeys(self.take(r)))
        self.last.update((last,))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame([(key[0], last, *self.shown(k)) for k in touched], columns=["workspace", "id", *self.names])

    def handleExpiredTimer(self, key: tuple, timers, expired) -> Iterator[pd.DataFrame]:
        gone = [k[0] for k in self.live.keys()]
        last = self.last.get()[0] if self.last.exists() else -1
        self.live.clear()
        yield pd.DataFrame([(key[0], last, *self.shown(k)) for k in gone], columns=["workspace", "id", *self.names])

    def close(self) -> None:
        pass

    def take(self, event) -> list[str]:
        """Changes the map by an event; the keys that are touched."""
        raise NotImplementedError

    def shown(self, key: str) -> tuple:
        raise NotImplementedError


class _Highlights(_Workspace):
    names = ["path", "ranges"]

    def take(self, event) -> list[str]:
        if event.tool == "clear_all" or event.tool == "clear_highlights" and event.path is None:
            gone = [k[0] for k in self.live.keys()]
            self.live.clear()
            return gone
        if event.path is None:
            return []
        if event.tool == "clear_highlights":
            self.live.removeKey((event.path,))
        else:
            ranges = json.loads(self.live.getValue((event.path,))[0]) if self.live.containsKey((event.path,)) else []
            self.live.updateValue((event.path,), (json.dumps([*ranges, [None if pd.isna(x) else int(x) for x in (event.start, event.end)]]),))
        return [event.path]

    def shown(self, key: str) -> tuple:
        return key, self.live.getValue((key,))[0] if self.live.containsKey((key,)) else None


class _Marks(_Workspace):
    names = ["path", "name", "seq"]

    def take(self, event) -> list[str]:
        key = json.dumps([event.path, event.name])
        if self.live.containsKey((key,)):
            return []
        self.live.updateValue((key,), (str(int(event.id)),))
        return [key]

    def shown(self, key: str) -> tuple:
        return (*json.loads(key), int(self.live.getValue((key,))[0]) if self.live.containsKey((key,)) else None)


def _running(rows: DataFrame, processor: _Workspace, schema: str) -> DataFrame:
    spark = rows.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # read when the query starts
    return rows.groupBy("workspace").transformWithStateInPandas(processor, schema, "Update", "None" if processor.idle is None else "ProcessingTime")


def running_highlights(events: DataFrame, idle: int | None = None) -> DataFrame:
    """``workspace, id, path, ranges`` of the files that an event has touched; ``ranges`` (null: none) as in ``events.highlights``.

    ``events(workspace, id, tool, params)``.
    """
    p = F.from_json("params", "file string, start int, end int")
    rows = events.filter(F.col("tool").isin("highlight_range", "clear_highlights", "clear_all"))
    rows = rows.select("workspace", "id", "tool", p["file"].alias("path"), p["start"].alias("start"), p["end"].alias("end"))
    shown = _running(rows, _Highlights(idle), "workspace string, id long, path string, ranges string")
    pairs = F.transform(F.from_json("ranges", "array<array<int>>"), lambda r: F.struct(r[0].alias("start"), r[1].alias("end")))
    return shown.withColumn("ranges", pairs)


def running_export_marks(events: DataFrame, idle: int | None = None) -> DataFrame:
    """``workspace, id, path, name, seq``: exports as they are first marked as read; ``seq`` is null when a silent workspace is forgotten."""
    p = F.from_json("params", "file string, export string")
    rows = events.filter("tool = 'mark_export_read'").select("workspace", "id", p["file"].alias("path"), p["export"].alias("name"))
    return _running(rows.filter("path is not null and name is not null"), _Marks(idle), "workspace string, id long, path string, name string, seq long")
