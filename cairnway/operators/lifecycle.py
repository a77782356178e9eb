"""The reading progress from its start to a refresh: a row of facts and a table of files, changed together by whole transitions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway.operators.progress import apply_changes, apply_updates, export_cascade, git_changes, outside_dir, prune, status_counts, utc_now, with_unchanged
from cairnway.sources import git

VERSION = "1.0.0"


class Progress(NamedTuple):
    """``meta``: one row ``version, map_hash, started_at, last_session, sessions, next_unread_index, git_commit, git_branch``;
    ``files(path, status, read_at, note, summary)``; ``exports(path, name, read_at, summary)``: what was read of a file, None if nothing."""

    meta: DataFrame
    files: DataFrame
    exports: DataFrame | None = None

    def with_meta(self, **columns: Column) -> Progress:
        return self._replace(meta=self.meta.withColumns(columns))


def _moment(at: str | None) -> Column:
    return F.lit(at) if at else utc_now()


def create(order: DataFrame, map_hash: str, at: str | None = None) -> Progress:
    """Every ordered file unread, in the first session."""
    none, now = F.lit(None).cast("string"), _moment(at)
    meta = order.sparkSession.range(1).select(
        F.lit(VERSION).alias("version"), F.lit(map_hash).alias("map_hash"), now.alias("started_at"), now.alias("last_session"), F.lit(1).alias("sessions"),
        F.lit(0).cast("long").alias("next_unread_index"), none.alias("git_commit"), none.alias("git_branch"),
    )
    return Progress(meta, order.select("path", F.lit("unread").alias("status"), none.alias("read_at"), none.alias("note"), none.alias("summary")))


def exports_of(progress: Progress) -> DataFrame:
    """``path, name, read_at, summary`` of the exports that were read."""
    if progress.exports is None:
        return progress.files.sparkSession.createDataFrame([], "path string, name string, read_at string, summary string")
    return progress.exports.select("path", "name", "read_at", "summary")


def exports_read(progress: Progress, marks: DataFrame) -> Progress:
    """``marks(path, name, seq, at, summary)``: the last mark of an export holds; a file that is not tracked yet is added, unread."""
    last = marks.groupBy("path", "name").agg(F.max_by(F.struct("at", "summary"), "seq").alias("m"))
    new = last.select("path", "name", F.col("m.at").alias("read_at"), F.col("m.summary").alias("summary"))
    kept = exports_of(progress).join(new, ["path", "name"], "left_anti")
    none = F.lit(None).cast("string")
    added = marks.groupBy("path").agg(F.min_by("at", "seq").alias("read_at")).join(progress.files.select("path"), "path", "left_anti")
    added = added.select("path", F.lit("unread").alias("status"), "read_at", none.alias("note"), none.alias("summary"))
    return progress._replace(files=progress.files.unionByName(added), exports=kept.unionByName(new))


def confirmed_exports_read(progress: Progress, declared: DataFrame) -> Progress:
    """All ``declared(path, name)`` exports of confirmed files count as read with the file; those read before keep their time and summary."""
    own = exports_of(progress)
    confirmed = progress.files.filter("status = 'confirmed'").select("path", "read_at")
    whole = export_cascade(declared.select("path", "name").union(own.select("path", "name")).distinct(), own, confirmed)
    return progress._replace(exports=whole.join(own.select("path", "name", "summary"), ["path", "name"], "left"))


def _with_files(progress: Progress, files: DataFrame, changes: DataFrame) -> Progress:
    """New files in place of the old; exports of files that are gone or changed are forgotten."""
    if progress.exports is None:
        return progress._replace(files=files)
    reset = changes.filter(F.col("change").isin("new", "modified", "removed")).select("path")
    kept = exports_of(progress).join(reset, "path", "left_anti").join(files.select("path"), "path", "left_semi")
    return progress._replace(files=files, exports=kept)


def session_started(progress: Progress, at: str | None = None) -> Progress:
    return progress.with_meta(sessions=F.col("sessions") + 1, last_session=_moment(at))


def with_git_state(progress: Progress, commit: str | None, branch: str | None) -> Progress:
    return progress.with_meta(git_commit=F.lit(commit).cast("string"), git_branch=F.lit(branch).cast("string"))


def is_current(progress: Progress, map_hash: str, strict: bool = False) -> DataFrame:
    """One row ``is_current``: whether the progress belongs to the map of this hash; ``strict`` ends the job if not."""
    same = F.coalesce(F.col("map_hash") == map_hash, F.lit(False))
    if strict:
        same = F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("the progress belongs to another map: "), F.coalesce(F.substring("map_hash", 1, 12), F.lit("none")))).cast("boolean"))
    return progress.meta.select(same.alias("is_current"))


def updated(progress: Progress, updates: DataFrame) -> Progress:
    """``updates(path, seq, status, note, summary, at)`` of tracked files, in order of ``seq``: a read file keeps the time of its last update, an unread one has none."""
    files = apply_updates(progress.files, updates, "library")
    last = updates.groupBy("path").agg(F.max_by("at", "seq").alias("_at"), F.lit(True).alias("_hit"))
    times = progress.files.select("path", "read_at").join(last, "path", "left")
    times = times.select("path", F.when(F.col("_hit"), F.col("_at")).otherwise(F.col("read_at")).alias("read_at"))
    rows = files.join(times, "path")
    read_at = F.when(F.col("status") != "unread", F.col("read_at"))
    return progress._replace(files=rows.select("path", "status", read_at.alias("read_at"), "note", "summary"))


def advanced(progress: Progress, order: DataFrame) -> Progress:
    """The pointer on the first unread file from where it stands, else behind the order."""
    at = progress.meta.select(F.col("next_unread_index").alias("_at"))  # one row
    rows = order.select("index", "path").join(progress.files.select("path", "status"), "path", "left").join(F.broadcast(at), F.lit(True))
    first = F.min(F.when((F.col("status") == "unread") & (F.col("index") >= F.col("_at")), F.col("index"))).cast("long")
    pointer = rows.agg(F.coalesce(first, F.count("*")).alias("_next"))
    meta = progress.meta.join(F.broadcast(pointer), F.lit(True))
    return progress._replace(meta=meta.withColumn("next_unread_index", F.col("_next")).drop("_next"))


def completed(progress: Progress, order: DataFrame, updates: DataFrame) -> Progress:
    """Files are updated and the pointer goes on, in one transition."""
    return advanced(updated(progress, updates), order)


def refreshed(progress: Progress, changes: DataFrame, edges: DataFrame, order: DataFrame, map_hash: str) -> Progress:
    """After a new index: changes applied, files outside the order dropped, the pointer at the start."""
    files = prune(apply_changes(progress.files, changes, edges), order)
    return _with_files(progress, files, changes).with_meta(map_hash=F.lit(map_hash), next_unread_index=F.lit(0).cast("long"))


def refreshed_by_diff(progress: Progress, diff: DataFrame, edges: DataFrame, commit: str, branch: str | None, folder: str) -> Progress:
    """After ``diff(status, path, new_path)`` between commits; nothing is dropped but removed files, and ``folder`` does not count."""
    changes = with_unchanged(outside_dir(git_changes(diff), folder), progress.files)
    files = apply_changes(progress.files, changes, edges)
    return with_git_state(_with_files(progress, files, changes).with_meta(next_unread_index=F.lit(0).cast("long")), commit, branch)


def refreshed_in_repository(progress: Progress, root: str, edges: DataFrame, folder: str) -> Progress | None:
    """By the commits since the stored one; None where that is not possible, so that the caller compares hashes."""
    stored = progress.meta.first()["git_commit"]  # one row
    if stored is None or not git.is_repository(root) or not git.has_commit(root, stored):
        return None
    now, branch = git.head(root), git.branch(root)
    if now is None:
        return None
    if now == stored:
        return with_git_state(progress, now, branch)
    diff = git.diff(progress.files.sparkSession, root, stored, now)
    return None if diff is None else refreshed_by_diff(progress, diff, edges, now, branch, folder)


def begun_or_refreshed(
    before: Progress | None, order: DataFrame, map_hash: str, changes: DataFrame, edges: DataFrame, commit: str | None = None, branch: str | None = None, at: str | None = None
) -> Progress:
    """A new progress, or the one before after a new index; then the commit and branch, if there is a commit."""
    now = create(order, map_hash, at) if before is None else refreshed(before, changes, edges, order, map_hash)
    return now if commit is None else with_git_state(now, commit, branch)


def with_stats(progress: Progress) -> DataFrame:
    """The row of facts with ``total, confirmed, flagged, skimmed, unread``, counted anew."""
    return progress.meta.join(F.broadcast(status_counts(progress.files)), F.lit(True))  # single rows
