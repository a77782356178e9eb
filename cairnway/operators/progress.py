"""Snapshots, change sets and the reading-progress state as joins and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnway.functions.paths import declared_name, half_even_percent, half_up_percent
from cairnway.plans.fixpoint import reach
from cairnway.plans.staging import staged

STATUSES = ("confirmed", "flagged", "skimmed", "unread")
READ = ("confirmed", "flagged", "skimmed")


def hash_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change``: new, removed, modified or unchanged; both inputs are ``(path, hash)``."""
    both = old.select("path", F.col("hash").alias("_o")).join(new.select("path", F.col("hash").alias("_n")), "path", "full")
    change = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "modified").otherwise("unchanged")
    return both.select("path", change.alias("change"))


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("new", "modified", "removed", "unchanged")])


def git_changes(status_lines: DataFrame) -> DataFrame:
    """``status, path, new_path`` rows of a name-status listing as ``path, change``; a rename is a removal and an addition."""
    kind = F.substring("status", 1, 1)
    rows = F.when(kind == "R", F.array(F.struct(F.col("path").alias("path"), F.lit("removed").alias("change")), F.struct(F.col("new_path").alias("path"), F.lit("new").alias("change"))))
    one = F.when(kind == "A", "new").when(kind == "M", "modified").when(kind == "D", "removed")
    rows = rows.otherwise(F.array(F.struct(F.col("path").alias("path"), one.alias("change"))))
    return status_lines.select(F.explode(rows).alias("r")).select("r.*").filter(F.col("change").isNotNull())


def latest_status(updates: DataFrame) -> DataFrame:
    """``path, status, note, summary``: last write wins by ``seq``; a summary that is null keeps the one before."""
    last = updates.groupBy("path").agg(
        F.max_by(F.struct("status", "note"), "seq").alias("s"),
        F.max_by("summary", F.when(F.col("summary").isNotNull(), F.col("seq"))).alias("summary"),
    )
    return last.select("path", "s.status", "s.note", "summary")


def apply_changes(state: DataFrame, changes: DataFrame, edges: DataFrame) -> DataFrame:
    """The state after a change set: removed dropped, new and modified unread, what depends on modified files flagged.

    ``state(path, status, note, ...)``.  Unread, new and modified files are neither flagged nor passed through.  Other columns
    stay as they are, and are null for new and modified files.
    """
    reset = changes.filter(F.col("change").isin("new", "modified")).select("path")
    blocked = state.filter(F.col("status") == "unread").select("path").union(reset).distinct()
    seeds = changes.filter(F.col("change") == "modified").select("path")
    stale = reach(seeds, edges, blocked).select("path", F.concat(F.lit("stale: depends on "), F.col("seed").cast("string")).alias("_stale"))
    gone = changes.filter(F.col("change") == "removed").select("path")
    kept = state.join(gone, "path", "left_anti").join(changes.filter(F.col("change") == "modified").select("path", F.lit(True).alias("_m")), "path", "left").join(stale, "path", "left")
    status = F.when(F.col("_m"), "unread").when(F.col("_stale").isNotNull(), "flagged").otherwise(F.col("status"))
    values = {"path": F.col("path"), "status": status, "note": F.when(F.col("_m").isNull(), F.coalesce("_stale", "note"))}
    kept = kept.select(*[values.get(c, F.when(F.col("_m").isNull(), F.col(c))).alias(c) for c in state.columns])
    values = {"path": F.col("path"), "status": F.lit("unread")}
    added = changes.filter(F.col("change") == "new").select("path").distinct().join(state, "path", "left_anti")
    return kept.unionByName(added.select(*[values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in state.schema]))


def status_counts(state: DataFrame) -> DataFrame:
    """One row: total and each status; an unknown status counts as unread."""
    known = [F.count_if(F.col("status") == s).alias(s) for s in READ]
    return state.agg(F.count("*").alias("total"), *known, F.count_if(~F.coalesce(F.col("status").isin(*READ), F.lit(False))).alias("unread"))


def layer_progress(order: DataFrame, state: DataFrame) -> DataFrame:
    """``layer, n_read, n_files, percent`` (half to even) of ``order(index, path, layer)``."""
    seen = order.join(state.select("path", "status"), "path", "left").withColumn("_r", F.coalesce(F.col("status").isin(*READ), F.lit(False)))
    counts = seen.groupBy("layer").agg(F.count_if("_r").alias("n_read"), F.count("*").alias("n_files"))
    return counts.withColumn("percent", half_even_percent(F.col("n_read"), F.col("n_files")))


def current_layer(order: DataFrame, state: DataFrame, by_reading_order: bool = False) -> DataFrame:
    """The first layer with an unread file: by name with half-to-even percent, or by reading order with half-up percent."""
    seen = order.join(state.select("path", "status"), "path", "left").withColumn("_r", F.coalesce(F.col("status").isin(*READ), F.lit(False)))
    per = seen.groupBy("layer").agg(F.count_if("_r").alias("n_read"), F.count("*").alias("n_files"), F.min(F.when(~F.col("_r"), F.col("index"))).alias("_first"))
    open_ = per.filter(F.col("_first").isNotNull())
    rank = F.col("_first") if by_reading_order else F.col("layer")
    percent = (half_up_percent if by_reading_order else half_even_percent)(F.col("n_read"), F.col("n_files"))
    return open_.withColumn("percent", percent).orderBy(rank).limit(1).select("layer", "n_read", "n_files", "percent")


def next_unread(order: DataFrame, state: DataFrame, pointer: int = 0, untracked_unread: bool = False) -> DataFrame:
    """``index, path``: the first unread file from ``pointer`` on, then from the start; untracked files count or not."""
    joined = order.join(state.select("path", "status"), "path", "left" if untracked_unread else "inner").filter(F.coalesce("status", F.lit("unread")) == "unread")
    best = F.min_by(F.struct("index", "path"), F.struct(F.col("index") < pointer, F.col("index")))
    return joined.agg(best.alias("b")).select("b.*").filter(F.col("index").isNotNull())


def advance_pointer(order: DataFrame, state: DataFrame, pointer: int = 0) -> DataFrame:
    """One row ``pointer``: the first unread index from ``pointer`` on, else the length of the order."""
    joined = order.join(state.select("path", "status"), "path", "left")
    first = F.min(F.when((F.col("status") == "unread") & (F.col("index") >= pointer), F.col("index")))
    return joined.agg(F.coalesce(first.cast("long"), F.count("*")).alias("pointer"))


def flagged(order: DataFrame, state: DataFrame, unordered_first: bool = False) -> DataFrame:
    """Flagged files in reading order; files outside the order come last (index: its length) or first (index -1)."""
    rows = state.filter(F.col("status") == "flagged").join(order, "path", "left")
    if unordered_first:
        index = F.coalesce("index", F.lit(-1))
    else:
        rows = rows.join(F.broadcast(order.agg(F.count("*").alias("_n"))), F.lit(True))  # a single row
        index = F.coalesce("index", "_n")
    return rows.select("path", F.coalesce("layer", F.lit("unknown")).alias("layer"), index.cast("long").alias("index"), "note")


def dependency_status(edges: DataFrame, state: DataFrame, outer: bool = False) -> DataFrame:
    """``src, dst, status`` of imported files: those read, or with ``outer`` all, missing ones as unread."""
    joined = edges.join(state.select(F.col("path").alias("dst"), "status"), "dst", "left" if outer else "inner")
    if not outer:
        joined = joined.filter(F.col("status") != "unread")
    return joined.select("src", "dst", F.coalesce("status", F.lit("unread")).alias("status"))


def export_cascade(exports: DataFrame, read: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``path, name, read_at``: exports already read keep their time; others of confirmed files take the file's."""
    rows = exports.join(read.select("path", "name", F.col("read_at").alias("_own")), ["path", "name"], "left").join(confirmed.select("path", F.col("read_at").alias("_file")), "path", "left")
    return rows.select("path", "name", F.coalesce("_own", "_file").alias("read_at")).filter(F.col("read_at").isNotNull())


def first_names(paths: Column, most: int = 5) -> Column:
    """The first file names of a list of paths, then how many more."""
    shown = F.array_join(F.slice(F.transform(paths, lambda p: F.substring_index(p, "/", -1)), 1, most), ", ")
    return F.concat(shown, F.when(F.size(paths) > most, F.format_string(" ... +%d more", F.size(paths) - most)).otherwise(""))


def truncated_callers(usage: DataFrame, most: int = 5) -> DataFrame:
    """``path, title``: the first callers by name, then how many more."""
    none = F.lit("Called by: none (potential dead code)")
    return usage.select("path", F.when(F.size("used_by") == 0, none).otherwise(F.concat(F.lit("Called by: "), first_names(F.col("used_by"), most))).alias("title"))


def caller_titles(files: DataFrame, uses: DataFrame, most: int = 5) -> DataFrame:
    """``path, title`` as ``truncated_callers``, of ``uses(path, caller)``: only the callers that are shown are gathered, the others are counted."""
    own = uses.select("path", "caller").distinct()
    counts = own.groupBy("path").agg(F.count("*").alias("n"))
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("caller"))).filter(F.col("r") <= most)
    shown = first.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("r", F.substring_index(F.col("caller").cast("string"), "/", -1).alias("name")))).getField("name").alias("names"))
    rows = files.select("path").join(counts, "path", "left").join(shown, "path", "left")
    rest = F.when(F.col("n") > most, F.format_string(" ... +%d more", F.col("n") - most)).otherwise("")
    title = F.concat(F.lit("Called by: "), F.array_join("names", ", "), rest)
    return rows.select("path", F.coalesce(title, F.lit("Called by: none (potential dead code)")).alias("title"))


def lens_titles(neighbours: DataFrame, most: int = 5) -> DataFrame:
    """``path, title``: callers, and what a file calls if it calls anything; ``neighbours(path, imports, imported_by)``."""
    callers = truncated_callers(neighbours.withColumnRenamed("imported_by", "used_by").select("path", "used_by"), most).withColumnRenamed("title", "_c")
    calls = neighbours.select("path", F.when(F.size("imports") > 0, F.concat(F.lit("Calls: "), first_names(F.col("imports"), most))).alias("_d"))
    return callers.join(calls, "path").select("path", F.concat_ws(" | ", "_c", "_d").alias("title"))


def lens_with_overrides(automatic: DataFrame, given: DataFrame) -> DataFrame:
    """``path, line, title``: lines given for a file stand in for all automatic ones of that file."""
    return automatic.join(given.select("path").distinct(), "path", "left_anti").select("path", "line", "title").union(given.select("path", "line", "title"))


def new_state(order: DataFrame, at: str | None = None) -> DataFrame:
    """Every ordered file unread, as a state table; ``at`` is kept as ``started_at`` (now, if not given)."""
    started = F.lit(at) if at else utc_now()
    none = F.lit(None).cast("string")
    return order.select("path", F.lit("unread").alias("status"), none.alias("read_at"), none.alias("note"), none.alias("summary"), started.alias("started_at"))


def utc_now() -> Column:
    """The present time in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def checked_updates(updates: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Updates with ``error``: an unknown status, or (given a state) a file that it does not track."""
    status = F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("none"))))
    if state is None:
        return updates.withColumn("error", status)
    known = state.select("path", F.lit(True).alias("_known"))
    found = updates.join(known, "path", "left")
    return found.withColumn("error", F.coalesce(status, F.when(F.col("_known").isNull(), F.concat(F.lit("untracked: "), F.col("path").cast("string"))))).drop("_known")


def apply_updates(state: DataFrame, updates: DataFrame, policy: str = "library") -> DataFrame:
    """``path, status, note, summary`` after ``updates(path, seq, status, note, summary)``, in order of ``seq``.

    ``library``: a note is always replaced, a null summary keeps the one before, untracked files are left out.
    ``tool``: the last update's note and summary hold, null or not; untracked files are added.
    ``editor``: only the status changes; untracked files are added.
    """
    if policy == "library":
        last = latest_status(updates)
    else:
        best = updates.groupBy("path").agg(F.max_by(F.struct("status", "note", "summary"), "seq").alias("s"))
        last = best.select("path", "s.status", "s.note", "s.summary")
    new = last.select("path", F.col("status").alias("_s"), F.col("note").alias("_n"), F.col("summary").alias("_m"), F.lit(True).alias("_hit"))
    both = state.select("path", "status", "note", "summary").join(new, "path", "left" if policy == "library" else "full")
    hit = F.coalesce("_hit", F.lit(False))
    note = F.col("note") if policy == "editor" else F.when(hit, F.col("_n")).otherwise(F.col("note"))
    summary = {"library": F.coalesce("_m", "summary"), "tool": F.when(hit, F.col("_m")).otherwise(F.col("summary")), "editor": F.col("summary")}[policy]
    return both.select("path", F.when(hit, F.col("_s")).otherwise(F.col("status")).alias("status"), note.alias("note"), summary.alias("summary"))


def carried_counts(state: DataFrame, total: int | Column) -> DataFrame:
    """Counts by status under a total that is carried along: what is not read is the rest, never less than 0."""
    counts = status_counts(state)
    total = F.lit(total) if isinstance(total, int) else total
    rest = F.greatest(F.lit(0), total - F.col("confirmed") - F.col("flagged") - F.col("skimmed"))
    return counts.withColumns({"total": total.cast("long"), "unread": rest.cast("long")})


def prune(state: DataFrame, order: DataFrame) -> DataFrame:
    """The state without files that are not in the order."""
    return state.join(order.select("path"), "path", "left_semi")


def refresh(state: DataFrame, changes: DataFrame, edges: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """``path, status, note`` after a change set; with an ``order``, files outside it are dropped."""
    after = apply_changes(state, changes, edges)
    return after if order is None else prune(after, order)


def refresh_summary(state: DataFrame, changes: DataFrame, edges: DataFrame, order: DataFrame) -> DataFrame:
    """One row: files new, modified, removed, unchanged, stale (newly flagged for what they depend on) and pruned."""
    after = staged(apply_changes(state, changes, edges), "refreshed")
    stale = after.join(state.select("path", F.col("status").alias("_was"), F.col("note").alias("_note")), "path")
    stale = stale.filter((F.col("status") == "flagged") & ~F.col("note").eqNullSafe(F.col("_note"))).agg(F.count("*").alias("stale"))
    pruned = after.join(order.select("path"), "path", "left_anti").agg(F.count("*").alias("pruned"))
    return change_summary(changes).join(F.broadcast(stale), F.lit(True)).join(F.broadcast(pruned), F.lit(True))  # single rows


def outside_dir(changes: DataFrame, folder: str) -> DataFrame:
    """Changes but for the folder itself and what lies below it."""
    path = F.col("path").cast("string")
    return changes.filter((path != folder) & ~F.startswith(path, F.lit(folder + "/")))


def with_unchanged(changes: DataFrame, tracked: DataFrame) -> DataFrame:
    """Changes plus tracked files that are not among them, as unchanged."""
    rest = tracked.select("path").join(changes.select("path"), "path", "left_anti")
    return changes.select("path", "change").union(rest.select("path", F.lit("unchanged").alias("change")))


def export_progress(exports: DataFrame, read: DataFrame, state: DataFrame) -> DataFrame:
    """``path, n_read, n_exports, partial``: ``partial`` if some but not all exports are read and the file has no mark of its own."""
    seen = exports.select("path", "name").distinct().join(read.select("path", "name", F.lit(True).alias("_r")).distinct(), ["path", "name"], "left")
    per = seen.groupBy("path").agg(F.count("_r").alias("n_read"), F.count("*").alias("n_exports"))
    marked = state.filter(F.col("status").isin(*READ)).select("path", F.lit(True).alias("_m"))
    part = (F.col("n_read") > 0) & (F.col("n_read") < F.col("n_exports")) & F.col("_m").isNull()
    return per.join(marked, "path", "left").select("path", "n_read", "n_exports", part.alias("partial"))


def summaries_split(order: DataFrame, state: DataFrame, edges: DataFrame, current: DataFrame) -> DataFrame:
    """``path, bucket, status, summary``: read files other than the ``current(path)`` one, as its dependencies or general reading."""
    deps = edges.join(current.select(F.col("path").alias("src")), "src", "left_semi").select(F.col("dst").alias("path")).distinct().withColumn("_d", F.lit(True))
    read = state.filter(F.col("status") != "unread").join(current.select("path"), "path", "left_anti").join(order.select("path"), "path", "left_semi")
    return read.join(deps, "path", "left").select("path", F.when(F.col("_d"), "dependency").otherwise("general").alias("bucket"), "status", "summary")


def declared_exports(lines: DataFrame, exports: DataFrame) -> DataFrame:
    """``path, line, name``: lines ``(path, line, body)`` that declare a name which the file exports."""
    named = lines.select("path", "line", declared_name(F.col("body")).alias("name")).filter("name is not null")
    return named.join(exports.select("path", "name"), ["path", "name"], "left_semi").select("path", "line", "name")


#: Marks by status, and the mark of the file being read (fixed values).
BADGES = {"confirmed": "\u2713", "flagged": "!", "skimmed": "~"}
CURRENT_BADGE = "\u25b8"


def decorated(state: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """``path, badge``: a mark for each read file (none for others) and for the ``current(path)`` one."""
    badge = F.lit(None).cast("string")
    for status, mark in BADGES.items():
        badge = F.when(F.col("status") == status, mark).otherwise(badge)
    if current is None:
        return state.select("path", badge.alias("badge"))
    now = current.select("path", F.lit(CURRENT_BADGE).alias("_now"))
    return state.join(now, "path", "left").select("path", F.coalesce("_now", badge).alias("badge"))


def remaining(flagged_: DataFrame, resolved: DataFrame) -> DataFrame:
    """Flagged files that are not resolved yet."""
    return flagged_.join(resolved.select("path"), "path", "left_anti")


def session_pace(sessions: DataFrame) -> DataFrame:
    """``files_read, sessions`` with ``pace`` (half to even, 0 without sessions)."""
    return sessions.withColumn("pace", F.coalesce(F.bround(F.try_divide(F.col("files_read").cast("double"), F.col("sessions"))), F.lit(0.0)).cast("long"))


def indexed(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """A zero-based dense position inside each ``key``."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
