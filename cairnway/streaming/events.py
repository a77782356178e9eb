"""Tool events as a stream: newline-delimited JSON files, a keyed progress state, late updates dropped by number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnway.operators.progress import hash_diff
from cairnway.plans.staging import staged

EVENT = "id long, tool string, params string"
PARAMS = "file string, status string, note string, summary string, export string"
#: Tools that are let through (fixed values).
TOOLS = (
    "highlight_range clear_highlights open_file mark_read mark_flagged set_codelens show_blast_radius clear_blast_radius update_progress_tree clear_all "
    "get_next_briefing get_read_status get_flagged_files complete_file mark_export_read"
).split()


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """``id, tool, params`` (JSON text) as files arrive."""
    return spark.readStream.schema(EVENT).json(folder)


def checked(events: DataFrame) -> DataFrame:
    """Events with ``error``, null for known tools."""
    known = F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False))
    return events.withColumn("error", F.when(~known, F.concat(F.lit("unknown tool: "), F.coalesce("tool", F.lit("none")))))


def status_updates(events: DataFrame) -> DataFrame:
    """``path, seq, status, note, summary`` of the events that set a status."""
    p = F.from_json("params", PARAMS)
    status = F.when(F.col("tool") == "mark_read", "confirmed").when(F.col("tool") == "mark_flagged", "flagged").when(F.col("tool") == "complete_file", p["status"])
    rows = events.select(p["file"].alias("path"), F.col("id").alias("seq"), status.alias("status"), p["note"].alias("note"), p["summary"].alias("summary"))
    return rows.filter("path is not null and status is not null")


def running_status(updates: DataFrame) -> DataFrame:
    """The state of each file after every trigger: last write wins by ``seq``, an absent summary keeps the one before."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, status, note, summary = state.get if state.exists else (-1, None, None, None)
        rows = pd.concat(list(frames)).sort_values("seq")
        for r in rows.astype(object).where(rows.notna(), None).itertuples():
            if r.seq > seq:
                seq, status, note, summary = r.seq, r.status, r.note, r.summary if r.summary is not None else summary
        state.update((int(seq), status, note, summary))
        yield pd.DataFrame({"path": [key[0]], "seq": [seq], "status": [status], "note": [note], "summary": [summary]})

    shape = "seq long, status string, note string, summary string"
    return updates.groupBy("path").applyInPandasWithState(step, f"path string, {shape}", shape, "update", GroupStateTimeout.NoTimeout)


RANGES = "file string, start int, end int"


def highlights(events: DataFrame) -> DataFrame:
    """``path, ranges`` after a batch of events ``(id, tool, params)``: ranges are appended, clearing one file or all drops what came before.

    Files without ranges are left out.  A stream keeps its events as a table and calls this in ``foreachBatch``.
    """
    p = F.from_json("params", RANGES)
    rows = events.select("id", "tool", p["file"].alias("path"), p["start"].alias("start"), p["end"].alias("end"))
    all_ = rows.filter("tool = 'clear_all' or (tool = 'clear_highlights' and path is null)").agg(F.max("id").alias("_all"))  # one row
    own = rows.filter("tool = 'clear_highlights' and path is not null").groupBy("path").agg(F.max("id").alias("_own"))
    kept = rows.filter("tool = 'highlight_range' and path is not null").join(own, "path", "left").join(F.broadcast(all_), F.lit(True))
    kept = kept.filter(F.col("id") > F.greatest(F.coalesce("_own", F.lit(-1)), F.coalesce("_all", F.lit(-1))))
    ordered = F.array_sort(F.collect_list(F.struct("id", "start", "end")))
    return kept.groupBy("path").agg(F.transform(ordered, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("ranges"))


def export_marks(events: DataFrame) -> DataFrame:
    """``path, name, seq``: exports marked as read, with the first event that did so."""
    p = F.from_json("params", PARAMS)
    rows = events.filter("tool = 'mark_export_read'").select(p["file"].alias("path"), p["export"].alias("name"), "id")
    return rows.filter("path is not null and name is not null").groupBy("path", "name").agg(F.min("id").alias("seq"))


def fan_out(events: DataFrame, subscribers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Calls each subscriber with the rows of its tools (``"tool tool ..."``), batch by batch; a batch is read once."""

    def deliver(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            for tools, react in subscribers.items():
                react(rows.filter(F.col("tool").isin(*tools.split())), batch)
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def synced(shown: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The statuses of a state in place of all that were shown, and what changed by it: ``path, status`` (null: gone)."""
    now = state.select("path", "status")
    both = shown.select("path", F.col("status").alias("_was")).join(now, "path", "full")
    return now, both.filter(~F.col("_was").eqNullSafe(F.col("status"))).select("path", "status")


def snapshot(spark: SparkSession, files: str) -> DataFrame:
    """``path, hash`` of the documents that match a path or glob: what tells one version of a file from another."""
    listed = spark.read.format("binaryFile").load(files).select("path", F.xxhash64("modificationTime", "length").alias("hash"))  # contents are not read
    return listed.select("path", F.hex("hash").alias("hash"))


def on_snapshots(spark: SparkSession, files: str, before: DataFrame | None, react: Callable[[DataFrame], None]) -> DataFrame:
    """Calls ``react`` with ``path, change`` (new, modified, removed) since the snapshot ``before``, if there are any; returns the present one."""
    try:
        now = staged(snapshot(spark, files), "snapshot")
    except AnalysisException:  # nothing matches
        now = spark.createDataFrame([], "path string, hash string")
    changes = hash_diff(before if before is not None else now.limit(0), now).filter("change <> 'unchanged'")
    if not changes.isEmpty():
        react(changes)
    return now


def on_change(spark: SparkSession, folder: str, schema: str, react: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``react(rows, batch)`` for the documents that were added to ``folder`` since the last call (JSON, a document a file)."""
    changed = spark.readStream.schema(schema).option("multiLine", "true").json(folder)
    return changed.writeStream.foreachBatch(react).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
