"""Registered queries over source trees made of the driver's tables, and over the progress of reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnway.functions import paths as P
from cairnway.operators import graph, lifecycle, order, progress, reports, resolve
from cairnway.plans import fixpoint, index, spread, views
from cairnway.plans.staging import staged
from cairnway.plans.views import PYTHON_MODULE_SQL, PYTHON_PATH_SQL, table
from cairnway.queries import ORACLES, READ_SQL, SCC_SQL, VIEWS, changes, query, state, usage
from cairnway.sources import documents, tree
from cairnway.streaming import events

PY, SCRIPT, GO = (path for _, path, _ in views.SOURCES_SQL)
PARTS = f"(SELECT {', '.join(views.NUMBERS)} FROM part)"
SOUND = f"(SELECT * FROM {PARTS} WHERE k % 11 <> 0)"


def parsed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return index.parsed(views.sources(spark, d).filter("language is not null"))


def listed(column: str):
    return F.array_join(column, ",").alias(column)


IMPORTS_SQL = f"""SELECT {PY} AS src, x.source, '' AS specifiers, false AS is_relative FROM {SOUND} CROSS JOIN (SELECT unnest(['os', 'json']) AS source) x
UNION ALL SELECT {PY}, CASE WHEN a > 0 THEN {PYTHON_MODULE_SQL.format('a')} ELSE 'sys' END, CASE WHEN a > 0 THEN 'f' || a ELSE '' END, false FROM {SOUND}
UNION ALL SELECT {PY}, '.m' || b, 'C' || b, true FROM {SOUND}
UNION ALL SELECT {SCRIPT}, '../web' || (a % 4) || '/c' || a || '.js', 'def,x' || a, true FROM {PARTS} UNION ALL SELECT {SCRIPT}, 'react', '*', false FROM {PARTS}
UNION ALL SELECT {GO}, 'fmt', '', false FROM {PARTS} UNION ALL SELECT {GO}, 'ex.org/r' || (k % 3) || '/p' || a, 'y', false FROM {PARTS}"""


@query(IMPORTS_SQL)
def source_imports(spark, d):
    return parsed(spark, d)[0].select("src", "source", listed("specifiers"), "is_relative")


@query(f"""SELECT {PY} AS path, CASE n WHEN 0 THEN 'LIMIT_' || k WHEN 1 THEN 'f' || k WHEN 2 THEN 'C' || k ELSE 'LAST' END AS name, CASE n WHEN 1 THEN 'function' WHEN 2 THEN 'class' ELSE 'variable' END AS kind,
CASE n WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 7 ELSE 12 END AS line FROM {SOUND} CROSS JOIN (SELECT unnest(range(4)) AS n) x WHERE n < 3 OR k % 3 = 2
UNION ALL SELECT {SCRIPT}, x.name || CASE WHEN x.numbered THEN k::VARCHAR ELSE '' END, x.kind, x.line FROM {PARTS} CROSS JOIN (VALUES ('x', true, 'function', 4), ('K', true, 'class', 5), ('arrow', false, 'variable', 10),
('K', true, 'default', 10), ('left', true, 'variable', 11), ('right', false, 'variable', 11), ('I', true, 'type', 12)) x(name, numbered, kind, line)
UNION ALL SELECT {GO}, x.name || k || x.tail, x.kind, x.line FROM {PARTS} CROSS JOIN (VALUES ('A', '', 'variable', 7), ('S', '', 'class', 10), ('I', '', 'type', 11), ('S', '.Do', 'function', 13)) x(name, tail, kind, line)""")
def source_exports(spark, d):
    return parsed(spark, d)[1]


@query(f"""SELECT {PY} AS path, CASE n WHEN 0 THEN 'f' || k ELSE 'C' || k || '.m' END AS name, CASE n WHEN 0 THEN 5 ELSE 8 END AS line, CASE n WHEN 0 THEN 6 ELSE 10 END AS end_line,
CASE n WHEN 0 THEN 'f' || a || ',g.h,os.path.join' ELSE 'self.n' END AS calls FROM {SOUND} CROSS JOIN (SELECT unnest(range(2)) AS n) x
UNION ALL SELECT {SCRIPT}, CASE n WHEN 0 THEN 'x' || k WHEN 1 THEN 'K' || k || '.run' WHEN 2 THEN 'K' || k || '.field' ELSE 'arrow' END, l, l, CASE n WHEN 0 THEN 'g' || k WHEN 1 THEN 'this.s' WHEN 2 THEN 'other' ELSE 'x' || k END
FROM {PARTS} CROSS JOIN (VALUES (0, 4), (1, 6), (2, 7), (3, 9)) x(n, l)
UNION ALL SELECT {GO}, CASE n WHEN 0 THEN 'S' || k || '.Do' ELSE 'main' END, 13 + n, 13 + n, CASE n WHEN 0 THEN 'fmt.Println,y.F' ELSE 'run' END FROM {PARTS} CROSS JOIN (VALUES (0), (1)) x(n)""")
def source_functions(spark, d):
    return parsed(spark, d)[2].select("path", "name", "line", "end_line", listed("calls"))


@query(f"""SELECT {PY} AS path, CASE WHEN k % 11 = 0 THEN 0 ELSE 3 END AS nesting, k % 11 <> 0 AND k % 3 = 0 AS has_guard, k % 11 <> 0 AND k % 3 <> 2 AS has_side_effects,
CASE WHEN k % 11 = 0 THEN 0 ELSE 2 END AS n_defs FROM {PARTS}""")
def source_facts(spark, d):
    return parsed(spark, d)[3]


RESOLVED_SQL = f"""SELECT {PY} AS src, {PYTHON_MODULE_SQL.format('a')} AS source, {PYTHON_PATH_SQL.format('a')} AS dst FROM {SOUND} WHERE a > 0
UNION ALL SELECT {PY}, '.m' || b, {PYTHON_PATH_SQL.format('b')} FROM {SOUND} WHERE b > 0 AND (b % 5 = 0) = (k % 5 = 0)
UNION ALL SELECT {SCRIPT}, '../web' || (a % 4) || '/c' || a || '.js', 'web' || (a % 4) || '/c' || a || '.ts' FROM {PARTS}
UNION ALL SELECT {GO}, 'ex.org/r' || (k % 3) || '/p' || a, 'go' || (k % 3) || '/p' || a FROM {PARTS}"""


def resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Imports, what they resolve to, and the files."""
    files, imports = views.sources(spark, d), staged(parsed(spark, d)[0], "imports")
    return imports, index.resolve(imports, files.filter("language is not null"), index.go_modules(files)), files


@query(RESOLVED_SQL)
def resolved_imports(spark, d):
    return resolved(spark, d)[1].select("src", "source", "dst")


@query(f"SELECT DISTINCT src, dst FROM ({RESOLVED_SQL}) WHERE NOT starts_with(src, 'go')")
def source_edges(spark, d):
    """The graph of a tree, from its files to its edges."""
    imports, found, files = resolved(spark, d)
    return graph.build_edges(imports, found, files.filter("language is not null"))


@query(f"""SELECT CASE WHEN k % 8 = 7 THEN 'script' ELSE 'python' END AS language, path, substr(sha256('x = ' || k), 1, 8) AS hash, k % 8 IN (3, 4) AS is_test
FROM (SELECT k, {views.TREE_PATH_SQL} AS path FROM {PARTS}) WHERE k % 8 NOT IN (1, 2, 5, 6)""")
def scanned_tree(spark, d):
    return tree.scan_tree(spark, views.written_tree(spark, d)).select("language", "path", "hash", "is_test")


def indexed(spark: SparkSession, d: str) -> index.Index:
    files = views.sources(spark, d).withColumns({"hash": P.short_hash(F.col("content")), "is_test": tree.in_test_dir_or_name(F.col("path"))})
    return index.index_files(files)


FILES_SQL = f"""files AS (SELECT {PY} AS path, k, 'python' AS language, 12 + (k % 11 = 0)::INT AS line_count, k % 11 <> 0 AND k % 3 = 0 AS guard, k % 11 <> 0 AND k % 3 <> 2 AS acts, 0.0 AS share FROM {PARTS}
  UNION ALL SELECT {SCRIPT}, k, 'script', 12, false, false, 0.0 FROM {PARTS} UNION ALL SELECT {GO}, k, 'go', 14, false, false, 0.5 FROM {PARTS}),
links AS (SELECT DISTINCT src, dst FROM ({RESOLVED_SQL}) WHERE NOT starts_with(src, 'go')), steps AS (SELECT path, 0 AS n FROM files UNION SELECT l.src, s.n + 1 FROM steps s JOIN links l ON l.dst = s.path AND l.src <> l.dst),
deep AS (SELECT path, max(n) AS depth FROM steps GROUP BY path),
degrees AS (SELECT f.*, depth, (SELECT count(*) FROM links WHERE dst = f.path) AS fan_in, (SELECT count(*) FROM links WHERE src = f.path) AS fan_out FROM files f JOIN deep USING (path)),
placed AS (SELECT *, CASE WHEN guard OR (fan_in = 0 AND acts) THEN 'entry' WHEN depth = 0 THEN 'foundation' WHEN depth = 1 THEN 'core' WHEN depth < 3 OR fan_in < 3 THEN 'features' ELSE 'integration' END AS layer FROM degrees)"""


@query()
def indexed_files(spark, d):
    """A tree's files with degrees, depth and layer, from their texts."""
    return indexed(spark, d).layers.select("path", "fan_in", "fan_out", "depth", "layer", "complexity", "line_count")


ORACLES["indexed_files"] = f"WITH RECURSIVE {FILES_SQL} SELECT path, fan_in, fan_out, depth, layer, 'low' AS complexity, line_count FROM placed"


@query()
def indexed_entries(spark, d):
    """The rows of a map document but for their index, which is held by brute force elsewhere."""
    rows = index.described_entries(indexed(spark, d))
    return rows.select("path", "layer", "reason", "complexity", "line_count", listed("imports"), listed("imported_by"), listed("exports"))


ORACLES["indexed_entries"] = f"""WITH RECURSIVE {FILES_SQL} SELECT path, layer, CASE WHEN share >= 0.5 OR (fan_in >= 3 AND fan_out <= 1) THEN 'Contract surface (' || layer || ' layer).' || CASE WHEN fan_in > 0 THEN ' Imported by ' || fan_in || ' file(s).' ELSE '' END
ELSE 'Data flow path (' || layer || ' layer).' || CASE WHEN fan_out > 0 THEN ' Depends on ' || fan_out || ' file(s).' ELSE '' END END AS reason, 'low' AS complexity, line_count,
coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM links WHERE src = p.path), '') AS imports, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM links WHERE dst = p.path), '') AS imported_by,
CASE WHEN language = 'script' THEN 'x' || k || ',K' || k || ',arrow,left' || k || ',right,I' || k WHEN language = 'go' THEN 'A' || k || ',S' || k || ',I' || k || ',S' || k || '.Do'
WHEN k % 11 = 0 THEN '' ELSE 'LIMIT_' || k || ',f' || k || ',C' || k || CASE WHEN k % 3 = 2 THEN ',LAST' ELSE '' END END AS exports FROM placed p"""


@query("SELECT idx::INT AS \"index\", path::VARCHAR AS path, layer, idx::INT * 3 AS line_count FROM ord WHERE idx = 10")
def order_lookup(spark, d):
    return reports.entry_of(views.order_entries(spark, d), "10").select("index", "path", "layer", "line_count")


@query(f"SELECT path FROM (SELECT {PY} AS path, k FROM {PARTS}) WHERE NOT starts_with(path, 'pkg3/') AND NOT (k % 10 = 9)")
def order_exclusions(spark, d):
    """What stays in the order: no trivial package files, none that the configuration leaves out."""
    part = table(spark, d, "part").selectExpr(*views.NUMBERS)
    named = F.when(F.col("k") % 10 == 9, F.concat(F.lit("pkg"), "k", F.lit("/__init__.py"))).otherwise(F.expr(PY)).alias("path")
    p, none = F.col("path"), F.lit(0)
    return part.select(named).filter(~(order.is_trivial_init(p, none, none, none) | order.matches_any(p, ["pkg3/*"])))


def begun(spark: SparkSession, d: str) -> lifecycle.Progress:
    return lifecycle.create(views.order(spark, d), "hash", "2026-01-01T00:00:00Z")


def completed(spark: SparkSession, d: str) -> lifecycle.Progress:
    updates = views.updates(spark, d).withColumn("at", F.date_format(F.col("seq.ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return lifecycle.completed(begun(spark, d), views.order(spark, d), updates)


POINTER_SQL = "coalesce((SELECT min(idx) FROM ord JOIN st USING (path) WHERE status = 'unread'), (SELECT count(*) FROM ord))::BIGINT"
TIMED_SQL = "SELECT path, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS at FROM upd GROUP BY path"


@query(f"SELECT path, st.status, CASE WHEN st.status <> 'unread' THEN t.at END AS read_at, st.note, st.summary FROM ord JOIN st USING (path) JOIN ({TIMED_SQL}) t USING (path)")
def completed_progress(spark, d):
    return completed(spark, d).files


@query(f"""SELECT '1.0.0' AS version, 'hash' AS map_hash, '2026-01-01T00:00:00Z' AS started_at, '2026-01-02T00:00:00Z' AS last_session, 2 AS sessions, {POINTER_SQL} AS next_unread_index, 'abc' AS git_commit, 'main' AS git_branch,
count(*) AS total, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'flagged') AS flagged, count(*) FILTER (status = 'skimmed') AS skimmed, count(*) FILTER (NOT {READ_SQL}) AS unread FROM st""")
def progress_facts(spark, d):
    return lifecycle.with_stats(lifecycle.with_git_state(lifecycle.session_started(completed(spark, d), "2026-01-02T00:00:00Z"), "abc", "main"))


STALE_SQL = """, blk AS (SELECT path FROM cur WHERE status = 'unread' UNION SELECT path FROM chg2 WHERE change IN ('new', 'modified')),
hit AS (SELECT path AS node, path AS seed, 0 AS level FROM chg2 WHERE change = 'modified' UNION SELECT d.doc_id, h.seed, h.level + 1 FROM hit h JOIN documents d ON d.doc_id // 2 = h.node AND d.doc_id // 2 > 0 WHERE d.doc_id NOT IN (SELECT path FROM blk)),
stale AS (SELECT node, min(seed) AS seed FROM (SELECT *, min(level) OVER (PARTITION BY node) AS f FROM hit WHERE level > 0) WHERE level = f GROUP BY node),
after AS (SELECT c.path, CASE WHEN h.change = 'modified' THEN 'unread' WHEN s.node IS NOT NULL THEN 'flagged' ELSE c.status END AS status, CASE WHEN h.change = 'modified' THEN NULL ELSE 't' || c.path END AS read_at,
  CASE WHEN h.change = 'modified' THEN NULL WHEN s.node IS NOT NULL THEN 'stale: depends on ' || s.seed END AS note, CASE WHEN h.change = 'modified' THEN NULL ELSE 's' END AS summary
  FROM cur c LEFT JOIN chg2 h USING (path) LEFT JOIN stale s ON s.node = c.path WHERE h.change IS DISTINCT FROM 'removed'
  UNION ALL SELECT path, 'unread', NULL, NULL, NULL FROM chg2 WHERE change = 'new' AND path NOT IN (SELECT path FROM cur))"""


def read_documents(files: DataFrame) -> lifecycle.Progress:
    """One in four unread, the rest confirmed."""
    rows = files.select("path", F.when(F.col("path") % 4 == 0, "unread").otherwise("confirmed").alias("status"), F.concat(F.lit("t"), "path").alias("read_at"), F.lit(None).cast("string").alias("note"), F.lit("s").alias("summary"))
    return lifecycle.create(files.limit(0), "old", "2026-01-01T00:00:00Z")._replace(files=rows)


def halves(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("src"), F.expr("doc_id div 2").alias("dst")).filter("dst > 0")


def with_facts(now: lifecycle.Progress) -> DataFrame:
    return now.files.join(F.broadcast(now.meta.select("map_hash", "next_unread_index", "git_commit")), F.lit(True))  # one row


@query()
def refreshed_progress(spark, d):
    now = lifecycle.begun_or_refreshed(read_documents(views.old_hashes(spark, d)), views.new_hashes(spark, d).filter("path % 6 <> 0"), "new", changes(spark, d), halves(spark, d), "abc", None)
    return with_facts(now)


ORACLES["refreshed_progress"] = f"""WITH RECURSIVE {VIEWS}, cur AS (SELECT path, CASE WHEN path % 4 = 0 THEN 'unread' ELSE 'confirmed' END AS status FROM oldh), chg2 AS (SELECT * FROM chg) {STALE_SQL}
SELECT *, 'new' AS map_hash, 0::BIGINT AS next_unread_index, 'abc' AS git_commit FROM after WHERE path % 6 <> 0"""


@query()
def progress_after_diff(spark, d):
    docs = table(spark, d, "documents")
    diff = docs.filter("doc_id % 7 < 3").select(F.get(F.split(F.lit("A,M,D"), ","), (F.col("doc_id") % 7).cast("int")).alias("status"), F.col("doc_id").alias("path"), F.lit(None).cast("long").alias("new_path"))
    was = read_documents(docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("path")))
    return with_facts(lifecycle.refreshed_by_diff(was, diff, halves(spark, d), "abc", "main", ".guide"))


ORACLES["progress_after_diff"] = f"""WITH RECURSIVE {VIEWS}, cur AS (SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'unread' ELSE 'confirmed' END AS status FROM documents WHERE doc_id % 7 <> 0),
chg2 AS (SELECT doc_id AS path, CASE doc_id % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'modified' ELSE 'removed' END AS change FROM documents WHERE doc_id % 7 < 3) {STALE_SQL}
SELECT *, 'old' AS map_hash, 0::BIGINT AS next_unread_index, 'abc' AS git_commit FROM after"""


@query(f"""SELECT total, confirmed, flagged, skimmed, total - confirmed - flagged - skimmed AS unread, c.layer AS current_layer, coalesce(c.percent, 0)::BIGINT AS current_layer_pct,
(SELECT path FROM ord LEFT JOIN st USING (path) WHERE coalesce(status, 'unread') = 'unread' ORDER BY idx LIMIT 1) AS next_file, flagged AS flagged_count, 3 AS sessions
FROM (SELECT count(*) + 7 AS total, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'flagged') AS flagged, count(*) FILTER (status = 'skimmed') AS skimmed FROM st) s
LEFT JOIN (SELECT layer, round(100.0 * count(*) FILTER ({READ_SQL}) / count(*), 0) AS percent FROM ord LEFT JOIN st USING (path) GROUP BY layer HAVING count(*) FILTER (NOT {READ_SQL}) > 0 ORDER BY min(idx) FILTER (NOT {READ_SQL}) LIMIT 1) c ON true""")
def tool_status(spark, d):
    rows = state(spark, d)
    return reports.tool_status(views.order(spark, d), rows, rows.agg(F.count("*") + 7).first()[0], 3)


def named_state(spark: SparkSession, d: str) -> DataFrame:
    return state(spark, d).select(F.col("path").cast("string").alias("path"), "status", "note", "summary")


ENTRY_SQL = "(SELECT * FROM ord WHERE idx = 10)"
LINKS_SQL = "(SELECT src, dst FROM dag WHERE src IN (SELECT path FROM ord) AND dst IN (SELECT path FROM ord))"
SAID_SQL = "CASE WHEN length(summary) > 0 THEN '\"' || summary || '\"' ELSE '(no summary)' END"


@query(f"""SELECT rank, "at", line FROM (
SELECT 0 AS rank, row_number() OVER (ORDER BY n) - 1 AS "at", line FROM (SELECT unnest([0, 1, 2, 3, 4]) AS n, unnest(['-- Next: 10 ' || repeat('-', 39), 'Layer: ' || layer || ' | Lines: 30 | Complexity: low', 'Why now: Even.',
  CASE WHEN EXISTS (SELECT 1 FROM {LINKS_SQL} WHERE src = 10) THEN '' END, CASE WHEN EXISTS (SELECT 1 FROM {LINKS_SQL} WHERE src = 10) THEN 'Dependencies (imports):' END]) AS line FROM {ENTRY_SQL}) WHERE line IS NOT NULL
UNION ALL SELECT 1, row_number() OVER (ORDER BY dst) - 1, CASE WHEN coalesce(status, 'unread') = 'unread' THEN '  [unread] ' || dst ELSE '  [' || status || '] ' || dst || ' -- ' || {SAID_SQL} END
  FROM {LINKS_SQL} l LEFT JOIN st ON st.path = l.dst WHERE src = 10 AND EXISTS (SELECT 1 FROM {ENTRY_SQL})
UNION ALL SELECT 2, 0, 'Used by: ' || string_agg(src::VARCHAR, ', ' ORDER BY src) || ' (unread, later)' FROM {LINKS_SQL} WHERE dst = 10 HAVING count(*) > 0
UNION ALL SELECT 3, n, CASE n WHEN 0 THEN '' ELSE 'Previously read:' END FROM (SELECT unnest([0, 1]) AS n) WHERE EXISTS (SELECT 1 FROM st WHERE status <> 'unread' AND path <> 10 AND path NOT IN (SELECT dst FROM {LINKS_SQL} WHERE src = 10))
UNION ALL SELECT 4, path, '  ' || path || ' -- ' || {SAID_SQL} FROM st WHERE status <> 'unread' AND path <> 10 AND path NOT IN (SELECT dst FROM {LINKS_SQL} WHERE src = 10)
UNION ALL SELECT 5, 0, repeat('-', 50) FROM {ENTRY_SQL})""")
def session_context(spark, d):
    entries = views.order_entries(spark, d)
    current = entries.filter("path = '10'").select("path")
    return reports.session_context(entries, named_state(spark, d), current).select(F.col("rank").cast("int").alias("rank"), "at", "line")


@query(f"""SELECT path::VARCHAR AS path, concat_ws(chr(10), '-- Flagged: ' || path || ' ' || repeat('-', 30), 'Layer: ' || layer || ' | Lines: ' || idx * 3, 'Original note: ' || CASE WHEN length(note) > 0 THEN '"' || note || '"' ELSE '(no note)' END,
CASE WHEN length(summary) > 0 THEN 'Original summary: "' || summary || '"' END, 'Imports: ' || i.names, 'Used by: ' || o.names, CASE WHEN idx % 3 = 0 THEN 'Exports: f, g' END, repeat('-', 50)) AS text
FROM st JOIN ord USING (path) LEFT JOIN (SELECT src AS path, string_agg(dst::VARCHAR, ', ' ORDER BY dst) AS names FROM {LINKS_SQL} GROUP BY src) i USING (path)
LEFT JOIN (SELECT dst AS path, string_agg(src::VARCHAR, ', ' ORDER BY src) AS names FROM {LINKS_SQL} GROUP BY dst) o USING (path) WHERE status = 'flagged'""")
def flagged_texts(spark, d):
    return reports.flagged_texts(views.order_entries(spark, d), named_state(spark, d))


@query(f"""SELECT 'All ' || count(*) || ' files read!' || chr(10) || chr(10) || '  confirmed: ' || count(*) FILTER (status = 'confirmed') || chr(10) || '  flagged: ' || count(*) FILTER (status = 'flagged') || chr(10) || '  skimmed: ' || count(*) FILTER (status = 'skimmed')
|| chr(10) || chr(10) || 'Sessions: 5' || CASE WHEN count(*) FILTER (status = 'flagged') > 0 THEN chr(10) || chr(10) || count(*) FILTER (status = 'flagged') || ' file(s) flagged for second pass. Run /read-flagged to review.' ELSE '' END AS text FROM st WHERE {READ_SQL}""")
def all_read_text(spark, d):
    return reports.all_read_text(state(spark, d).filter(F.col("status").isin(*progress.READ)), 5)


def log(spark: SparkSession, d: str) -> DataFrame:
    """Events as tool calls."""
    tool = F.get(F.split(F.lit("highlight_range,clear_highlights,mark_export_read,highlight_range,clear_all,mark_read,unheard_of,highlight_range"), ","), (F.when(F.col("event_id") % 97 == 0, 4).otherwise((F.col("event_id") * 5 + F.col("user_id")) % 8)).cast("int"))
    known = F.when((tool == "clear_all") & (F.col("event_id") % 97 != 0), "highlight_range").otherwise(tool)
    params = F.to_json(F.struct(F.col("user_id").cast("string").alias("file"), (F.col("event_id") % 50).cast("int").alias("start"), (F.col("event_id") % 50 + 2).cast("int").alias("end"), F.col("event_type").alias("export")))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), known.alias("tool"), params.alias("params"))


LOG_SQL = """(SELECT event_id AS id, user_id::VARCHAR AS path, event_type, CASE WHEN event_id % 97 = 0 THEN 'clear_all' ELSE ['highlight_range', 'clear_highlights', 'mark_export_read', 'highlight_range', 'highlight_range', 'mark_read', 'unheard_of', 'highlight_range'][(event_id * 5 + user_id) % 8 + 1] END AS tool FROM events)"""


@query(f"""SELECT path, string_agg((id % 50) || '-' || (id % 50 + 2), ',' ORDER BY id) AS ranges FROM {LOG_SQL} e WHERE tool = 'highlight_range' AND id > coalesce((SELECT max(id) FROM {LOG_SQL} WHERE tool = 'clear_all'), -1)
AND id > coalesce((SELECT max(id) FROM {LOG_SQL} c WHERE c.tool = 'clear_highlights' AND c.path = e.path), -1) GROUP BY path""")
def highlights(spark, d):
    rows = events.highlights(log(spark, d))
    return rows.select("path", F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("ranges"))


@query(f"SELECT path, event_type AS name, min(id) AS seq FROM {LOG_SQL} WHERE tool = 'mark_export_read' GROUP BY ALL")
def export_marks(spark, d):
    return events.export_marks(log(spark, d))


@query(f"SELECT id, CASE WHEN tool = 'unheard_of' THEN 'unknown tool: unheard_of' END AS error FROM {LOG_SQL}")
def checked_events(spark, d):
    return events.checked(log(spark, d)).select("id", "error")


@query("""SELECT l_orderkey AS path, l_linenumber AS line, 'given' AS title FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT l_orderkey, l_linenumber, 'automatic' FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def lens_overrides(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), "l_returnflag")
    return progress.lens_with_overrides(lines.withColumn("title", F.lit("automatic")), lines.filter("l_returnflag = 'R'").withColumn("title", F.lit("given")))


@query(f"""SELECT {PY} AS path, CASE n WHEN 0 THEN 5 ELSE 7 END AS line, CASE n WHEN 0 THEN 'f' || k ELSE 'C' || k END AS name FROM {SOUND} CROSS JOIN (VALUES (0), (1)) x(n)
UNION ALL SELECT {SCRIPT}, CASE n WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 9 END, CASE n WHEN 0 THEN 'x' || k WHEN 1 THEN 'K' || k ELSE 'arrow' END FROM {PARTS} CROSS JOIN (VALUES (0), (1), (2)) x(n)""")
def declared_exports(spark, d):
    """Lines that declare what their file exports."""
    lines = views.sources(spark, d).filter("language <> 'go'").select("path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("at", "body"))
    return progress.declared_exports(lines.select("path", (F.col("at") + 1).alias("line"), "body"), parsed(spark, d)[1])


@query("SELECT path, name, CASE WHEN n >= 0.75 THEN 'critical' WHEN n >= 0.5 THEN 'important' WHEN n >= 0.25 THEN 'standard' ELSE 'low' END AS tier FROM (SELECT path, name, callers / 20 AS n FROM usage)")
def importance_tiers(spark, d):
    return usage(spark, d).select("path", "name", (F.col("callers") / 20).alias("importance")).select("path", "name", graph.importance_tier().alias("tier"))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'src/m' || s_suppkey || '.ts' END AS path, s_suppkey % 4 = 0 AS is_entry FROM supplier")
def rooted_paths(spark, d):
    """Absolute paths below a root, and of its neighbour."""
    named = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "/repo2/").otherwise("/repo/"), F.lit("src/m"), "s_suppkey", F.lit(".ts"))
    stems = F.concat(F.lit("a/"), F.when(F.col("s_suppkey") % 4 == 0, "index").otherwise("indexes"), F.lit(".tsx"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), P.below_root(named, "/repo").alias("path"), order.is_script_entry(stems).alias("is_entry"))


@query(f"""SELECT path, i > 0 AND e > 0 AS is_reexport, f = 0 AND NOT (i > 0 AND e > 0) AS is_trivial FROM (SELECT 'pkg' || k || '/__init__.py' AS path, k % 3 AS i, k % 2 AS e, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS f FROM {PARTS})""")
def package_files(spark, d):
    part = table(spark, d, "part").select(F.concat(F.lit("pkg"), "p_partkey", F.lit("/__init__.py")).alias("path"), (F.col("p_partkey") % 3).alias("i"), (F.col("p_partkey") % 2).alias("e"), (F.col("p_partkey") % 5 == 0).cast("int").alias("f"))
    p, i, e = F.col("path"), F.col("i"), F.col("e")
    return part.select("path", order.is_reexport(p, i, e).alias("is_reexport"), order.is_trivial_init(p, i, e, F.col("f")).alias("is_trivial"))


@query("SELECT layer, count(*) AS n_files, string_agg(idx::VARCHAR, ',' ORDER BY idx::VARCHAR) AS files FROM ord GROUP BY layer")
def map_layers(spark, d):
    """The layers of a map document."""
    none = spark.createDataFrame([], "path string, hash string")
    document = documents.map_document(views.order_entries(spark, d).withColumn("symbol_usage", F.lit(None).cast("map<string,struct<callers:int,used_by:array<string>>>")), none, "/repo", F.lit("now"))
    rows = document.select(F.explode("layers").alias("layer", "v")).filter(F.size("v.files") > 0)
    return rows.select("layer", F.size("v.files").cast("long").alias("n_files"), F.array_join("v.files", ",").alias("files"))


@query(f"SELECT path, status, read_at, note, summary FROM (SELECT path::VARCHAR AS path, st.status, CASE WHEN st.status <> 'unread' THEN t.at END AS read_at, st.note, st.summary FROM ord JOIN st USING (path) JOIN ({TIMED_SQL}) t USING (path))")
def progress_document(spark, d):
    """A progress written as a document and read back."""
    now = completed(spark, d)
    now = now._replace(files=now.files.withColumn("path", F.col("path").cast("string")))
    at = staged(spark.range(1), "document")  # names a folder of its own
    path = at.inputFiles()[0].rsplit("/", 1)[0] + ".json"
    documents.write_document(documents.progress_document(now), path)
    return documents.progress_of(documents.read_progress(spark, path)).files


@query()
def indexed_graph(spark, d):
    """Depth and components of a graph with cycles, as the index joins them."""
    edges = views.edges_cyc(spark, d)
    members = fixpoint.components(edges)
    return fixpoint.depths(views.nodes(spark, d).select("path"), fixpoint.acyclic(edges, members)).join(members, "path", "left").select("path", "depth", "scc")


ORACLES["indexed_graph"] = f"""WITH RECURSIVE {VIEWS} {SCC_SQL}, free AS (
  SELECT c.src, c.dst FROM cyc c LEFT JOIN scc a ON a.path = c.src LEFT JOIN scc b ON b.path = c.dst WHERE c.src <> c.dst AND (a.scc IS NULL OR b.scc IS NULL OR a.scc <> b.scc)
), way AS (SELECT path, 0 AS depth FROM nodes UNION SELECT f.src, w.depth + 1 FROM way w JOIN free f ON f.dst = w.path)
SELECT n.path, n.depth::INT AS depth, s.scc FROM (SELECT path, max(depth) AS depth FROM way GROUP BY path) n LEFT JOIN scc s USING (path)"""


@query("SELECT upd.path, 'e' || (ts % 3) AS name, strftime(max(t), '%H:%M:%S') AS read_at FROM (SELECT path, epoch_us(ts) AS ts, ts AS t FROM upd) upd JOIN ord USING (path) GROUP BY ALL")
def progress_exports(spark, d):
    """Exports that were read, by way of a progress document that is written and read back."""
    marks = views.updates(spark, d).join(views.order(spark, d).select("path"), "path").select(
        "path", F.concat(F.lit("e"), F.unix_micros(F.col("seq.ts").cast("timestamp")) % 3).alias("name"), "seq", F.date_format("seq.ts", "HH:mm:ss").alias("at"), F.lit(None).cast("string").alias("summary")
    )
    named = marks.withColumn("path", F.col("path").cast("string"))
    now = begun(spark, d)
    now = lifecycle.exports_read(now._replace(files=now.files.withColumn("path", F.col("path").cast("string"))), named)
    with_document = staged(documents.progress_document(now), "document")
    return lifecycle.exports_of(documents.progress_of(with_document)).select(F.col("path").cast("long").alias("path"), "name", "read_at")


@query("SELECT idx % 3 = 0 AS is_current, count(*) AS n FROM ord GROUP BY 1")
def current_maps(spark, d):
    """The stale-map check over one progress a user."""
    every = views.order(spark, d).select(F.when(F.col("index") % 3 == 0, "new").when(F.col("index") % 3 == 1, "old").alias("map_hash"))
    return lifecycle.is_current(lifecycle.Progress(every, every), "new").groupBy("is_current").agg(F.count("*").alias("n"))


@query("SELECT path, status FROM (SELECT coalesce(a.path, b.path) AS path, a.status AS was, b.status FROM (SELECT idx AS path, CASE WHEN idx % 2 = 0 THEN 'unread' ELSE 'skimmed' END AS status FROM ord WHERE idx % 5 <> 0) a FULL JOIN st b ON a.path = b.path) WHERE was IS DISTINCT FROM status")
def synced_status(spark, d):
    """What changes in what is shown when a state takes its place."""
    shown = views.order(spark, d).filter("index % 5 <> 0").select("path", F.when(F.col("index") % 2 == 0, "unread").otherwise("skimmed").alias("status"))
    return events.synced(shown, state(spark, d))[1]


PACKAGES = "SELECT p_partkey AS k, 'pkg' || (p_partkey % 9) || '/m' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '_test.go' WHEN p_partkey % 7 = 0 THEN '.py' ELSE '.go' END AS path FROM part"


@query(f"SELECT a.path AS src, b.path AS dst FROM ({PACKAGES}) a JOIN ({PACKAGES}) b ON starts_with(b.path, 'pkg' || (a.k % 5) || '/') WHERE a.path LIKE '%.go' AND b.path LIKE '%.go' AND b.path NOT LIKE '%_test.go'")
def go_package_links(spark, d):
    """Imports of Go packages as links to the files in them."""
    part = table(spark, d, "part").selectExpr("p_partkey AS k")
    end = F.when(F.col("k") % 4 == 0, "_test.go").when(F.col("k") % 7 == 0, ".py").otherwise(".go")
    files = part.select("k", F.concat(F.lit("pkg"), F.col("k") % 9, F.lit("/m"), "k", end).alias("path"))
    imports = files.filter(F.col("path").endswith(".go")).select(F.col("path").alias("src"), F.concat(F.lit("ex.org/r/pkg"), F.col("k") % 5).alias("source"))
    modules = spark.createDataFrame([("ex.org/r", "")], "module string, dir string")
    return resolve.package_files(resolve.resolve_go(imports, modules), files).select("src", "dst")


@query()
def dependents_of_all(spark, d):
    """Exact sets of dependents of all files at once; where there are more than 40 with the file itself, that there are."""
    rows = spread.dependents(views.nodes(spark, d).select("path"), views.edges_cyc(spark, d), most=40)
    return rows.select("path", "exact", F.when(F.col("exact"), F.col("n_dependents")).alias("n_dependents"), F.array_join("dependents", ",").alias("dependents"))


ORACLES["dependents_of_all"] = f"""WITH RECURSIVE {VIEWS}, clo AS (SELECT src, dst FROM cyc UNION SELECT c.src, e.dst FROM clo c JOIN cyc e ON e.src = c.dst),
met AS (SELECT n.path, count(c.src) AS n, coalesce(string_agg(c.src::VARCHAR, ',' ORDER BY c.src), '') AS who FROM nodes n LEFT JOIN clo c ON c.dst = n.path AND c.src <> n.path GROUP BY n.path)
SELECT path, n < 40 AS exact, CASE WHEN n < 40 THEN n END AS n_dependents, CASE WHEN n < 40 THEN who END AS dependents FROM met"""
