"""Report rows and their texts: small aggregates, written out by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway.functions.paths import half_even_percent
from cairnway.operators.order import LAYERS
from cairnway.operators.progress import carried_counts, current_layer, dependency_status, next_unread, status_counts

RULE = "-" * 50


def text_lines(*parts: Column) -> Column:
    """Lines of a text; null ones are left out."""
    return F.concat_ws("\n", *parts)


def headed(title: Column) -> Column:
    """A heading filled up with dashes to 50 characters, with one at least."""
    return F.concat(F.lit("-- Next: "), title, F.lit(" "), F.repeat(F.lit("-"), F.greatest(F.lit(1), F.lit(41) - F.length(title))))


def listed(label: str, names: Column, ending: str = "") -> Column:
    """``label: a, b``, or null for an empty list."""
    return F.when(F.size(names) > 0, F.concat(F.lit(label + ": "), F.array_join(names, ", "), F.lit(ending)))


def status_report(order: DataFrame, state: DataFrame) -> DataFrame:
    """Counts by status, the share read (half to even, 0 if there is nothing) and the next unread file, if any."""
    counts = status_counts(state)
    read = F.col("confirmed") + F.col("flagged") + F.col("skimmed")
    following = next_unread(order, state).select(F.col("path").alias("next_path"))  # one row at most
    return counts.withColumn("percent", half_even_percent(read, F.col("total"))).join(F.broadcast(following), F.lit(True), "left")


def status_text(order: DataFrame, state: DataFrame, sessions: int) -> DataFrame:
    """One row ``text``: the status report in words."""
    layer = current_layer(order, state).select(F.col("layer").alias("_l"), F.col("percent").alias("_p"))  # one row at most
    rows = status_report(order, state).join(F.broadcast(layer), F.lit(True), "left")
    read = F.col("confirmed") + F.col("flagged") + F.col("skimmed")
    pace = F.coalesce(F.bround(F.try_divide(read.cast("double"), F.lit(sessions))), F.lit(0.0)).cast("long")
    counts = [F.format_string(f"  {s}: %d", s) for s in ("confirmed", "flagged", "skimmed", "unread")]
    return rows.select(
        text_lines(
            F.format_string("Progress: %d/%d files (%d%%)", read, "total", "percent"), *counts, F.lit(""),
            F.when(F.col("_l").isNull(), "All layers complete").otherwise(F.format_string("Current layer: %s (%d%% complete)", "_l", "_p")),
            F.concat(F.lit("Next file: "), F.coalesce(F.col("next_path").cast("string"), F.lit("(none -- all files read)"))),
            F.format_string("Flagged files awaiting second pass: %d", "flagged"), F.lit(""),
            F.format_string("Sessions: %d | Avg pace: ~%d files/session", F.lit(sessions), pace),
        ).alias("text")
    )


def all_read_text(state: DataFrame, sessions: int) -> DataFrame:
    """One row ``text``: the closing message, with a hint if files are flagged."""
    hint = F.when(F.col("flagged") > 0, F.format_string("\n%d file(s) flagged for second pass. Run /read-flagged to review.", "flagged"))
    counts = [F.format_string(f"  {s}: %d", s) for s in ("confirmed", "flagged", "skimmed")]
    return status_counts(state).select(text_lines(F.format_string("All %d files read!", "total"), F.lit(""), *counts, F.lit(""), F.format_string("Sessions: %d", F.lit(sessions)), hint).alias("text"))


def next_briefing(order: DataFrame, state: DataFrame, edges: DataFrame) -> DataFrame:
    """The next unread file (untracked ones count) with its layer and its imports' statuses as sorted ``path=status`` texts."""
    chosen = next_unread(order, state, untracked_unread=True).select(F.col("path").alias("src"), "index")
    own = edges.join(F.broadcast(chosen.select("src")), "src", "left_semi")
    said = dependency_status(own, state, outer=True).groupBy("src").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col("dst").cast("string"), "status"))), ", ").alias("imports")
    )
    layered = chosen.join(order.select(F.col("path").alias("src"), "layer"), "src")
    return layered.join(said, "src", "left").select(F.col("src").alias("path"), "index", "layer", F.coalesce("imports", F.lit("")).alias("imports"))


def next_text(order: DataFrame, state: DataFrame) -> DataFrame:
    """``path, text``: the next unread file in words, with what is known of its imports.

    ``order`` holds the columns of a map document's entries.
    """
    chosen = next_unread(order, state).select("path")
    entry = order.join(F.broadcast(chosen), "path", "left_semi")
    deps = entry.select("path", F.posexplode("imports").alias("at", "dst"))
    known = state.select(F.col("path").alias("dst"), "status", "summary")
    quoted = F.when(F.length("summary") > 0, F.concat(F.lit('"'), F.col("summary"), F.lit('"'))).otherwise("(no summary)")
    unread = F.coalesce("status", F.lit("unread")) == "unread"
    line = F.when(unread, F.concat(F.lit("  [unread] "), F.col("dst"))).otherwise(F.concat(F.lit("  ["), F.col("status"), F.lit("] "), F.col("dst"), F.lit(" -- "), quoted))
    said = deps.join(known, "dst", "left").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("_d"))
    depended = F.when(F.size("_d") > 0, F.concat(F.lit("\nDependencies (imports):\n"), F.array_join("_d.line", "\n")))
    exported = listed("\nExports", F.col("exports"))
    return entry.join(said, "path", "left").select(
        "path",
        text_lines(
            headed(F.col("path")), F.format_string("Layer: %s | Lines: %d | Complexity: %s", "layer", "line_count", "complexity"),
            F.when(F.length("reason") > 0, F.concat(F.lit("Why now: "), F.col("reason"))), depended, exported,
            listed("Used by", F.col("imported_by"), " (unread, later)"), F.lit(RULE),
        ).alias("text"),
    )


def entry_of(order: DataFrame, path: str) -> DataFrame:
    """The order's row of a path; ``KeyError`` if there is none."""
    found = order.filter(F.col("path") == path)
    if found.isEmpty():
        raise KeyError(f"not in the reading order: {path}")
    return found


def session_context(order: DataFrame, state: DataFrame, current: DataFrame) -> DataFrame:
    """``rank, at, line``: what to know before the ``current(path)`` file is read, as lines in order.

    ``order`` holds the columns of a map document's entries.  Lines are rows, as the files read before may be many.
    """
    entry = order.join(F.broadcast(current.select("path")), "path", "left_semi")
    quoted = F.when(F.length("summary") > 0, F.concat(F.lit('"'), F.col("summary"), F.lit('"'))).otherwise("(no summary)")
    known = state.filter(F.coalesce("status", F.lit("unread")) != "unread")

    def rows(rank: int, df: DataFrame, *lines: Column) -> DataFrame:
        """Lines of the entry, null ones left out."""
        return df.select(F.posexplode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("at", "line")).select(F.lit(rank).alias("rank"), F.col("at").cast("long").alias("at"), "line")

    head = rows(
        0, entry, headed(F.col("path")), F.format_string("Layer: %s | Lines: %d | Complexity: %s", "layer", "line_count", "complexity"),
        F.when(F.length("reason") > 0, F.concat(F.lit("Why now: "), F.col("reason"))), F.when(F.size("imports") > 0, F.lit("")), F.when(F.size("imports") > 0, F.lit("Dependencies (imports):")),
    )
    deps = entry.select(F.posexplode("imports").alias("at", "dst")).join(known.select(F.col("path").alias("dst"), "status", "summary"), "dst", "left")
    said = F.when(F.col("status").isNull(), F.concat(F.lit("  [unread] "), "dst")).otherwise(F.concat(F.lit("  ["), "status", F.lit("] "), "dst", F.lit(" -- "), quoted))
    deps = deps.select(F.lit(1).alias("rank"), F.col("at").cast("long").alias("at"), said.alias("line"))
    shape = rows(2, entry, F.when(F.size("exports") > 0, F.lit("")), listed("Exports", F.col("exports")), listed("Used by", F.col("imported_by"), " (unread, later)"))
    own = entry.select(F.explode(F.concat("imports", F.array("path"))).alias("path"))
    general = known.join(own, "path", "left_anti").join(order.select("path", F.col("index").cast("long").alias("at")), "path", "left")
    general = general.select(F.lit(4).alias("rank"), "at", F.concat(F.lit("  "), "path", F.lit(" -- "), quoted).alias("line"))
    title = rows(3, general.limit(1), F.lit(""), F.lit("Previously read:"))
    return head.union(deps).union(shape).union(title).union(general).union(rows(5, entry, F.lit(RULE)))


def tool_status(order: DataFrame, state: DataFrame, total: int | Column, sessions: int | Column) -> DataFrame:
    """One row: counts under a carried total, the current layer by the reading order with its half-up percent, the next file (untracked ones count), sessions."""
    layer = current_layer(order, state, by_reading_order=True).select(F.col("layer").alias("current_layer"), F.col("percent").alias("_p"))  # one row at most
    following = next_unread(order, state, untracked_unread=True).select(F.col("path").alias("next_file"))
    rows = carried_counts(state, total).join(F.broadcast(layer), F.lit(True), "left").join(F.broadcast(following), F.lit(True), "left")
    sessions = F.lit(sessions) if isinstance(sessions, int) else sessions
    return rows.select(
        "total", "confirmed", "flagged", "skimmed", "unread", "current_layer", F.coalesce("_p", F.lit(0).cast("long")).alias("current_layer_pct"), "next_file",
        F.col("flagged").alias("flagged_count"), sessions.alias("sessions"),
    )


def flagged_texts(order: DataFrame, state: DataFrame) -> DataFrame:
    """``path, text``: every flagged file in words; files outside the order have the layer unknown and no lines."""
    rows = state.filter(F.col("status") == "flagged").select("path", "note", "summary").join(order, "path", "left")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    return rows.select(
        "path",
        text_lines(
            F.concat(F.lit("-- Flagged: "), F.col("path"), F.lit(" " + "-" * 30)),
            F.format_string("Layer: %s | Lines: %d", F.coalesce("layer", F.lit("unknown")), F.coalesce("line_count", F.lit(0))),
            F.concat(F.lit("Original note: "), F.when(F.length("note") > 0, quoted("note")).otherwise("(no note)")),
            F.when(F.length("summary") > 0, F.concat(F.lit("Original summary: "), quoted("summary"))),
            listed("Imports", F.col("imports")), listed("Used by", F.col("imported_by")), listed("Exports", F.col("exports")), F.lit(RULE),
        ).alias("text"),
    )


def index_summary(files: DataFrame) -> DataFrame:
    """``layer, line``: a line of text for each layer with its number of files and the first of them."""
    per = files.groupBy("layer").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    return per.select("layer", F.format_string("%s: %d files, from %s", "layer", "n", F.col("first").cast("string")).alias("line"))


def layer_lines(progress: DataFrame) -> DataFrame:
    """``rank, line`` of ``layer_progress`` rows, in canonical order; layers without files are not shown."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer")) - 1
    return progress.filter("n_files > 0").select(rank.alias("rank"), F.format_string("%s (%d/%d read)", "layer", "n_read", "n_files").alias("line"))


def size_estimate(files: DataFrame, per_session: int = 35) -> DataFrame:
    """One row: files, their lines, and the sessions that reading them takes; ``files(line_count)``."""
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("n_lines"), F.ceil(F.count("*") / per_session).alias("sessions"))
