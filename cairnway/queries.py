"""Registered queries over the driver's tables and the DuckDB SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnway.functions import paths as P
from cairnway.operators import graph, order, progress, reports
from cairnway.plans import fixpoint, views
from cairnway.plans.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {VIEWS} {sql}"
        return f

    return keep


VIEWS = f"""
nodes AS (SELECT p_partkey AS path, {views.PATH_SQL} AS file, p_brand AS repo_id, p_size FROM part),
dag AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part) WHERE dst > 0 AND dst < src),
cyc AS (SELECT * FROM dag UNION SELECT p_partkey // 2, p_partkey FROM part WHERE p_size = 7 AND p_partkey > 3),
deg AS (SELECT n.path, n.file, n.repo_id, n.p_size, (SELECT count(*) FROM dag e WHERE e.dst = n.path) AS fan_in, (SELECT count(*) FROM dag e WHERE e.src = n.path) AS fan_out FROM nodes n),
lev AS (SELECT path, 0 AS d FROM nodes UNION SELECT e.src, lev.d + 1 FROM lev JOIN dag e ON e.dst = lev.path),
dep AS (SELECT path, max(d) AS depth FROM lev GROUP BY path),
lay AS (SELECT deg.*, dep.depth, CASE WHEN split_part(file, '/', 3) IN ('main.py', '__main__.py', 'app.py', 'server.py', 'cli.py') THEN 'entry' WHEN depth <= 0 THEN 'foundation' WHEN depth <= 1 THEN 'core' WHEN depth < 3 THEN 'features' WHEN fan_in >= 3 THEN 'integration' ELSE 'features' END AS layer FROM deg JOIN dep USING (path)),
ord AS (SELECT DISTINCT user_id AS idx, user_id AS path, ['foundation', 'core', 'features', 'integration', 'entry'][user_id % 5 + 1] AS layer FROM events),
upd AS (SELECT user_id AS path, ts, event_id, ['confirmed', 'flagged', 'skimmed', 'unread'][(length(event_type) + event_id) % 4 + 1] AS status, event_type AS note, CASE WHEN event_id % 3 = 0 THEN event_id::VARCHAR END AS summary FROM events),
st AS (SELECT path, arg_max(status, (ts, event_id)) AS status, arg_max(note, (ts, event_id)) AS note, arg_max(summary, (ts, event_id)) FILTER (summary IS NOT NULL) AS summary FROM upd GROUP BY path),
oldh AS (SELECT doc_id AS path, substr(sha256(coalesce(text, '')), 1, 8) AS hash FROM documents WHERE doc_id % 10 <> 1),
newh AS (SELECT doc_id AS path, substr(sha256(coalesce(text, '') || CASE WHEN doc_id % 10 = 3 THEN '!' ELSE '' END), 1, 8) AS hash FROM documents WHERE doc_id % 10 <> 2),
chg AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN o.hash <> n.hash THEN 'modified' ELSE 'unchanged' END AS change FROM oldh o FULL JOIN newh n ON o.path = n.path),
uses AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst, l_returnflag AS name FROM lineitem),
usage AS (SELECT p.p_partkey AS path, x.name, count(u.src) AS callers FROM part p CROSS JOIN (SELECT unnest(['A', 'N', 'R', 'X']) AS name) x LEFT JOIN uses u ON u.dst = p.p_partkey AND u.name = x.name GROUP BY ALL)
"""
READ_SQL = "coalesce(status IN ('confirmed', 'flagged', 'skimmed'), false)"


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_metrics(views.nodes(spark, d), views.edges_dag(spark, d))


def layered(spark: SparkSession, d: str) -> DataFrame:
    deep = fixpoint.depths(views.nodes(spark, d).select("path"), views.edges_dag(spark, d))
    rows = metrics(spark, d).join(deep, "path")
    return rows.withColumn("layer", order.layer(F.col("depth"), F.col("fan_in"), order.is_entry_file(F.col("file"))))


def state(spark: SparkSession, d: str) -> DataFrame:
    return progress.latest_status(views.updates(spark, d))


def usage(spark: SparkSession, d: str) -> DataFrame:
    exports = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.explode(F.array(*[F.lit(x) for x in "ANRX"])).alias("name"))
    uses = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("name"))
    return graph.symbol_usage(exports, uses)


def changes(spark: SparkSession, d: str) -> DataFrame:
    return progress.hash_diff(views.old_hashes(spark, d), views.new_hashes(spark, d))


@query("SELECT path, fan_in, fan_out, fan_in = 0 AS is_leaf, fan_out = 0 AS is_root FROM deg")
def degree_metrics(spark, d):
    return metrics(spark, d).select("path", "fan_in", "fan_out", "is_leaf", "is_root")


@query("SELECT dst AS path, string_agg(src::VARCHAR, ',' ORDER BY src) AS imported_by FROM dag GROUP BY dst")
def reverse_adjacency(spark, d):
    rows = graph.adjacency(views.edges_dag(spark, d)).filter(F.size("imported_by") > 0)
    return rows.select("path", F.array_join(F.transform("imported_by", lambda x: x.cast("string")), ",").alias("imported_by"))


@query("""SELECT source, count(DISTINCT src) AS n_files FROM (SELECT o.o_orderkey AS src, o.o_custkey AS source FROM orders o) i
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = i.source AND c.c_acctbal >= 0) GROUP BY source""")
def external_deps(spark, d):
    imports = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("source"))
    files = table(spark, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("path"))
    return graph.external_counts(imports, imports.select("src", "source", F.col("source").alias("dst")), files)


@query("""SELECT DISTINCT o.o_orderkey AS src, o.o_custkey AS dst FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal >= 0""")
def internal_edges(spark, d):
    imports = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("source"))
    files = table(spark, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("path"))
    return graph.build_edges(imports, imports.select("src", "source", F.col("source").alias("dst")), files)


@query("SELECT path, name, callers FROM usage")
def symbol_usage(spark, d):
    return usage(spark, d).select("path", "name", "callers")


@query("SELECT path, name FROM usage WHERE callers = 0")
def dead_symbols(spark, d):
    return usage(spark, d).filter("callers = 0").select("path", "name")


@query("SELECT path, fan_in, CASE WHEN fan_in = 0 THEN 'dead' WHEN fan_in <= 2 THEN 'low' WHEN fan_in <= 7 THEN 'normal' ELSE 'hot' END AS tier FROM deg")
def caller_tiers(spark, d):
    return metrics(spark, d).select("path", "fan_in", graph.caller_tier().alias("tier"))


@query("""SELECT path, CASE WHEN callers = 0 THEN 'Called by: none (potential dead code)' ELSE 'Called by: ' || array_to_string(list_transform(names[1:5], lambda x: x::VARCHAR), ', ') || CASE WHEN callers > 5 THEN ' ... +' || (callers - 5) || ' more' ELSE '' END END AS title
FROM (SELECT p.p_partkey AS path, count(u.src) AS callers, coalesce(list(u.src ORDER BY u.src) FILTER (u.src IS NOT NULL), []) AS names FROM part p LEFT JOIN uses u ON u.dst = p.p_partkey AND u.name = 'R' GROUP BY ALL)""")
def truncated_callers(spark, d):
    uses = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("caller"))
    return progress.caller_titles(table(spark, d, "part").select(F.col("p_partkey").alias("path")), uses)


@query("SELECT path, depth FROM dep")
def depth(spark, d):
    return fixpoint.depths(views.nodes(spark, d).select("path"), views.edges_dag(spark, d))


@query("SELECT path, layer FROM lay")
def layer_classify(spark, d):
    return layered(spark, d).select("path", "layer")


@query("SELECT x.layer, count(l.path) AS n_files FROM (SELECT unnest(['foundation', 'core', 'features', 'integration', 'entry']) AS layer) x LEFT JOIN lay l ON l.layer = x.layer GROUP BY x.layer")
def layer_counts(spark, d):
    return order.layer_counts(layered(spark, d).select("path", "layer"))


SCC_SQL = """, clo AS (SELECT src, dst FROM cyc UNION SELECT c.src, e.dst FROM clo c JOIN cyc e ON e.src = c.dst),
scc AS (SELECT a.src AS path, max(a.dst) AS scc FROM clo a JOIN clo b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)"""


@query()
def scc_members(spark, d):
    return fixpoint.components(views.edges_cyc(spark, d))


ORACLES["scc_members"] = f"WITH RECURSIVE {VIEWS} {SCC_SQL} SELECT path, scc FROM scc"


@query()
def cycle_edges(spark, d):
    edges = views.edges_cyc(spark, d)
    return graph.cycle_edges(edges, fixpoint.components(edges))


ORACLES["cycle_edges"] = f"WITH RECURSIVE {VIEWS} {SCC_SQL} SELECT c.src, c.dst FROM cyc c JOIN scc a ON a.path = c.src JOIN scc b ON b.path = c.dst WHERE a.scc = b.scc"

HIT_SQL = ", hit AS (SELECT src AS path FROM cyc WHERE dst = 5 UNION SELECT e.src FROM hit h JOIN cyc e ON e.dst = h.path)"


@query()
def blast_radius(spark, d):
    edges = views.edges_cyc(spark, d)
    seed = views.nodes(spark, d).filter("path = 5").select("path")
    return fixpoint.reach(seed, edges).select("path")


ORACLES["blast_radius"] = f"WITH RECURSIVE {VIEWS} {HIT_SQL} SELECT path FROM hit"

STALE_SQL = """, seedlev AS (SELECT path AS node, path AS seed, 0 AS level FROM nodes WHERE p_size = 3
  UNION SELECT e.src, s.seed, s.level + 1 FROM seedlev s JOIN dag e ON e.dst = s.node JOIN nodes n ON n.path = e.src AND n.p_size NOT IN (3, 9))
SELECT node AS path, level, min(seed) AS seed FROM (SELECT *, min(level) OVER (PARTITION BY node) AS first FROM seedlev WHERE level > 0) WHERE level = first GROUP BY node, level"""


@query()
def stale_notes(spark, d):
    nodes = views.nodes(spark, d)
    return fixpoint.reach(nodes.filter("p_size = 3").select("path"), views.edges_dag(spark, d), nodes.filter("p_size in (3, 9)").select("path"))


ORACLES["stale_notes"] = f"WITH RECURSIVE {VIEWS} {STALE_SQL}"


@query("SELECT src, dst FROM dag WHERE src IN (SELECT path FROM nodes WHERE p_size > 10) AND dst IN (SELECT path FROM nodes WHERE p_size > 10)")
def induced_subgraph(spark, d):
    return graph.induced_subgraph(views.edges_dag(spark, d), views.nodes(spark, d).filter("p_size > 10").select("path"))


STEM_SQL = "regexp_replace(split_part(file, '/', 3), '\\.[^.]*$', '')"
TEST_SQL = f"regexp_matches({STEM_SQL}, '^(test|test_.*|.*_test)$')"
PASS_SQL = f"""CASE WHEN NOT {TEST_SQL} AND file LIKE '%brass/%' THEN 'contracts' WHEN split_part(file, '/', 2) = 'utils' THEN 'utility'
WHEN {STEM_SQL} IN ('types', 'interfaces', 'models', 'schema', 'constants') OR (fan_in >= 3 AND fan_out <= 1) THEN 'contracts' ELSE 'data_flow' END"""


def passes(spark, d):
    given = {"*brass/*": "contracts"}
    rows = metrics(spark, d)
    return rows.withColumn("pass", order.reading_pass(F.col("file"), F.lit(0.0), F.col("fan_in"), F.col("fan_out"), given))


@query(f"SELECT path, {PASS_SQL} AS pass FROM deg")
def pass_assign(spark, d):
    return passes(spark, d).select("path", "pass")


@query(f"SELECT {PASS_SQL} AS pass, count(*) AS n_files FROM deg GROUP BY 1")
def pass_distribution(spark, d):
    return passes(spark, d).groupBy("pass").agg(F.count("*").alias("n_files"))


@query(f"SELECT path FROM deg WHERE {STEM_SQL} IN ('types', 'interfaces', 'models', 'schema', 'constants') OR (fan_in >= 3 AND fan_out <= 1)")
def contract_surface(spark, d):
    return metrics(spark, d).filter(order.is_contract(F.col("file"), F.lit(0.0), F.col("fan_in"), F.col("fan_out"))).select("path")


@query("SELECT path FROM nodes WHERE NOT regexp_matches(file, '^.*/utils/.*$') AND NOT regexp_matches(file, '^.*/m[0-4].*\\.py$')")
def glob_exclude(spark, d):
    return views.nodes(spark, d).filter(~order.matches_any(F.col("file"), ["*/utils/*", "*/m[0-4]*.py"])).select("path")


@query(f"""SELECT t.file AS test, min(i.file) AS impl FROM nodes t JOIN nodes i ON regexp_replace(regexp_replace(split_part(i.file, '/', 3), '\\.py$', ''), '^$', '') = regexp_replace(regexp_replace(split_part(t.file, '/', 3), '\\.py$', ''), '^test_', '')
WHERE split_part(t.file, '/', 3) LIKE 'test\\_%' ESCAPE '\\' AND split_part(i.file, '/', 3) NOT LIKE 'test\\_%' ESCAPE '\\' GROUP BY t.file""")
def test_pairing(spark, d):
    return order.pair_tests(views.nodes(spark, d).select(F.col("file").alias("path")))


@query()
def reading_order(spark, d):
    rank = F.array_position(F.array(*[F.lit(x) for x in order.LAYERS]), F.col("layer"))
    rows = layered(spark, d).withColumn("pass", order.reading_pass(F.col("file"), F.lit(0.0), F.col("fan_in"), F.col("fan_out"), {}))
    files = rows.select("repo_id", "pass", F.concat_ws("#", "file", "path").alias("named"), "path", rank.alias("layer_rank"), "fan_in")
    home = views.nodes(spark, d).select("path", "repo_id", F.concat_ws("#", "file", "path").alias("named"))
    a, b = home.select(F.col("path").alias("src"), "repo_id", F.col("named").alias("s")), home.select(F.col("path").alias("dst"), F.col("repo_id").alias("r2"), F.col("named").alias("t"))
    edges = views.edges_dag(spark, d).join(a, "src").join(b, "dst").filter("repo_id = r2").select("repo_id", F.col("s").alias("src"), F.col("t").alias("dst"))
    return order.reading_order(files.select("repo_id", "pass", F.col("named").alias("path"), "layer_rank", "fan_in"), edges)


# One step a row: the smallest file whose imports in its pass are all placed.
READING_ORDER_SQL = f"""WITH RECURSIVE base AS ({ORACLES["layer_classify"].replace("SELECT path, layer FROM lay", "SELECT path, file, repo_id, fan_in, fan_out, layer FROM lay")}), named AS (
  SELECT *, file || '#' || path AS name, split_part(file, '/', 2) AS folder, regexp_replace(split_part(file, '/', -1), '\\.[^.]*$', '') AS stem FROM base
), f AS (
  SELECT *, list_position(['foundation', 'core', 'features', 'integration', 'entry'], layer) AS rank, starts_with(stem, 'test_') AS is_test,
    CASE WHEN folder IN ('utils', 'helpers', 'lib') THEN 'utility' WHEN stem IN ('types', 'interfaces', 'models', 'schema', 'constants') OR (fan_in >= 3 AND fan_out <= 1) THEN 'contracts' ELSE 'data_flow' END AS pass
  FROM named
), plain AS (SELECT * FROM f WHERE NOT is_test), links AS (
  SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part) WHERE dst > 0 AND dst < src
), waits AS (
  SELECT a.name, list(b.name) AS deps FROM links l JOIN plain a ON a.path = l.src JOIN plain b ON b.path = l.dst AND b.repo_id = a.repo_id AND b.pass = a.pass GROUP BY a.name
), ready AS (
  SELECT p.repo_id, p.pass, p.name, p.rank, p.fan_in, coalesce(w.deps, []) AS deps FROM plain p LEFT JOIN waits w ON w.name = p.name
), steps AS (
  SELECT DISTINCT repo_id, pass, 0 AS n, []::VARCHAR[] AS placed FROM plain
  UNION ALL
  SELECT s.repo_id, s.pass, s.n + 1, list_append(any_value(s.placed), min({{'rank': r.rank, 'fan': -r.fan_in, 'name': r.name}}).name)
  FROM steps s JOIN ready r ON r.repo_id = s.repo_id AND r.pass = s.pass AND NOT list_contains(s.placed, r.name) AND list_has_all(s.placed, r.deps) GROUP BY s.repo_id, s.pass, s.n
), whole AS (
  SELECT repo_id, pass, arg_max(placed, n) AS placed FROM steps GROUP BY repo_id, pass
), placed AS (
  SELECT repo_id, pass, placed[pos] AS name, pos FROM (SELECT *, unnest(range(1, len(placed) + 1)) AS pos FROM whole)
), tests AS (
  SELECT t.repo_id, t.name, (SELECT min(p.name) FROM plain p WHERE p.repo_id = t.repo_id AND p.stem = regexp_replace(t.stem, '^test_', '')) AS impl FROM f t WHERE t.is_test
), every AS (
  SELECT repo_id, name, pass, pos, 0 AS t, false AS last, NULL::VARCHAR AS impl FROM placed
  UNION ALL SELECT x.repo_id, x.name, coalesce(p.pass, 'utility'), p.pos, 1, p.pos IS NULL, x.impl FROM tests x LEFT JOIN placed p ON p.repo_id = x.repo_id AND p.name = x.impl
)
SELECT repo_id, (row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN last THEN 3 WHEN pass = 'contracts' THEN 0 WHEN pass = 'data_flow' THEN 1 ELSE 2 END, coalesce(pos, 0), t, name) - 1)::INT AS "index",
  name AS path, pass, impl AS paired_with FROM every"""
ORACLES["reading_order"] = READING_ORDER_SQL


@query("SELECT path, change FROM chg")
def hash_diff(spark, d):
    return changes(spark, d)


@query("SELECT count(*) FILTER (change = 'new') AS \"new\", count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'unchanged') AS unchanged FROM chg")
def change_summary(spark, d):
    return progress.change_summary(changes(spark, d))


@query("SELECT path, status, note, summary FROM st")
def progress_latest(spark, d):
    return state(spark, d)


@query(f"SELECT count(*) AS total, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'flagged') AS flagged, count(*) FILTER (status = 'skimmed') AS skimmed, count(*) FILTER (NOT {READ_SQL}) AS unread FROM st")
def status_counts(spark, d):
    return progress.status_counts(state(spark, d))


@query(f"SELECT layer, count(*) FILTER ({READ_SQL}) AS n_read, count(*) AS n_files, round_even(100.0 * count(*) FILTER ({READ_SQL}) / count(*), 0)::BIGINT AS percent FROM ord LEFT JOIN st USING (path) GROUP BY layer")
def layer_progress(spark, d):
    return progress.layer_progress(views.order(spark, d), state(spark, d))


CURRENT_SQL = f"SELECT layer, count(*) FILTER ({READ_SQL}) AS n_read, count(*) AS n_files, {{round}}::BIGINT AS percent FROM ord LEFT JOIN st USING (path) GROUP BY layer HAVING count(*) FILTER (NOT {READ_SQL}) > 0 ORDER BY {{by}} LIMIT 1"


@query(CURRENT_SQL.format(round=f"round_even(100.0 * count(*) FILTER ({READ_SQL}) / count(*), 0)", by="layer"))
def current_layer(spark, d):
    return progress.current_layer(views.order(spark, d), state(spark, d))


@query(CURRENT_SQL.format(round=f"round(100.0 * count(*) FILTER ({READ_SQL}) / count(*), 0)", by=f"min(idx) FILTER (NOT {READ_SQL})"))
def current_layer_in_order(spark, d):
    return progress.current_layer(views.order(spark, d), state(spark, d), by_reading_order=True)


@query("SELECT idx AS \"index\", path FROM ord JOIN st USING (path) WHERE status = 'unread' ORDER BY idx < 20, idx LIMIT 1")
def next_unread(spark, d):
    return progress.next_unread(views.order(spark, d), state(spark, d), pointer=20)


@query("SELECT idx AS \"index\", path FROM ord LEFT JOIN (SELECT * FROM st WHERE path % 4 <> 0) s USING (path) WHERE coalesce(status, 'unread') = 'unread' ORDER BY idx LIMIT 1")
def next_unread_or_untracked(spark, d):
    return progress.next_unread(views.order(spark, d), state(spark, d).filter("path % 4 <> 0"), untracked_unread=True)


@query("SELECT coalesce((SELECT min(idx) FROM ord JOIN st USING (path) WHERE status = 'unread' AND idx >= 20), (SELECT count(*) FROM ord))::BIGINT AS pointer")
def advance_pointer(spark, d):
    return progress.advance_pointer(views.order(spark, d), state(spark, d), pointer=20)


FLAG_SQL = "SELECT s.path, coalesce(o.layer, 'unknown') AS layer, coalesce(o.idx, {missing})::BIGINT AS \"index\", s.note FROM st s LEFT JOIN (SELECT * FROM ord WHERE path % 7 <> 0) o USING (path) WHERE s.status = 'flagged'"


@query(FLAG_SQL.format(missing="(SELECT count(*) FROM ord WHERE path % 7 <> 0)"))
def flagged_last(spark, d):
    return progress.flagged(views.order(spark, d).filter("path % 7 <> 0"), state(spark, d))


@query(FLAG_SQL.format(missing="-1"))
def flagged_first(spark, d):
    return progress.flagged(views.order(spark, d).filter("path % 7 <> 0"), state(spark, d), unordered_first=True)


@query("SELECT e.src, e.dst, s.status FROM dag e JOIN st s ON s.path = e.dst WHERE s.status <> 'unread'")
def dependency_status(spark, d):
    return progress.dependency_status(views.edges_dag(spark, d), state(spark, d))


@query("SELECT e.src, e.dst, coalesce(s.status, 'unread') AS status FROM dag e LEFT JOIN st s ON s.path = e.dst")
def dependency_status_outer(spark, d):
    return progress.dependency_status(views.edges_dag(spark, d), state(spark, d), outer=True)


@query("SELECT user_id AS path, count(*) AS files_read, count(DISTINCT ts::DATE) AS sessions, round_even(count(*)::DOUBLE / count(DISTINCT ts::DATE), 0)::BIGINT AS pace FROM events GROUP BY user_id")
def session_pace(spark, d):
    seen = table(spark, d, "events").groupBy(F.col("user_id").alias("path")).agg(F.count("*").alias("files_read"), F.countDistinct(F.to_date("ts")).alias("sessions"))
    return progress.session_pace(seen)


@query("SELECT path, fan_in FROM deg ORDER BY fan_in DESC, path LIMIT 8")
def backbone_topk(spark, d):
    return graph.backbone(metrics(spark, d))


BLANK_SQL = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CODE_LINES_SQL = (
    r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), "
    rf"lambda x: regexp_matches(x, '^[{BLANK_SQL}]*[^{BLANK_SQL}#]')))"
)


@query(f"""SELECT doc_id, n AS code_lines, CASE WHEN (n >= 200)::INT + (w > 8000)::INT >= 2 THEN 'high' WHEN (n >= 200)::INT + (w > 8000)::INT = 1 OR (n >= 50 AND n < 200 AND w >= 3000) THEN 'medium' ELSE 'low' END AS complexity
FROM (SELECT doc_id, {CODE_LINES_SQL} AS n, length(coalesce(text, '')) AS w FROM documents)""")
def line_complexity(spark, d):
    rows = table(spark, d, "documents").select("doc_id", P.code_lines(F.col("text")).cast("long").alias("code_lines"), F.coalesce(F.char_length("text"), F.lit(0)).alias("w"))
    functions = F.when(F.col("w") > 8000, 9).when(F.col("w") >= 3000, 3).otherwise(0)
    return rows.select("doc_id", "code_lines", order.complexity(F.col("code_lines"), functions, F.lit(0)).alias("complexity"))


@query("SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 8) AS hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", P.short_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@query("SELECT split_part(file, '/', 1) AS area, count(*) AS n_files, array_to_string(list_sort(list_distinct(list(layer))), ',') AS layers FROM lay GROUP BY 1")
def dir_rollup(spark, d):
    return graph.feature_areas(layered(spark, d).select(F.col("file").alias("path"), "layer"))


@query("""SELECT l_orderkey AS path, l_linenumber AS name, max(l_shipdate)::DATE AS read_at FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL
UNION ALL SELECT DISTINCT l.l_orderkey, l.l_linenumber, o.o_orderdate::DATE FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F'
WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber AND r.l_returnflag = 'R')""")
def export_cascade(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("name"), "l_returnflag", "l_shipdate")
    read = lines.filter("l_returnflag = 'R'").groupBy("path", "name").agg(F.max(F.to_date("l_shipdate")).alias("read_at"))
    confirmed = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"), F.to_date("o_orderdate").alias("read_at"))
    return progress.export_cascade(lines.select("path", "name").distinct(), read, confirmed)


#: Documents' lines, one in three made a declaration of some language out of its own words.
SOURCE_LINE_SQL = """CASE (doc_id + line) % 12 WHEN 0 THEN concat('def f_', line, '(', body, '):') WHEN 3 THEN concat('  async  def g', line, ' (x):') WHEN 5 THEN concat('x; export default class K', line, ' {', body)
  WHEN 7 THEN concat('return async function   h', line, '(', body, ')') WHEN 9 THEN concat('export const v', line, ' = (a) => a') WHEN 10 THEN concat('def ', body) ELSE body END"""


@query(f"""SELECT doc_id, line, coalesce(nullif(regexp_extract(src, '\\bfunction\\s+(\\w+)', 1), ''), nullif(regexp_extract(src, '\\b(?:let|const|var)\\s+(\\w+)\\s*=\\s*(?:async\\s+)?(?:[^=]|\\([^)]*\\))\\s*=>', 1), ''),
nullif(regexp_extract(src, '\\bclass\\s+(\\w+)', 1), ''), nullif(regexp_extract(src, '^\\s*(?:async\\s+)?def\\s+(\\w+)\\s*\\(', 1), '')) AS name
FROM (SELECT doc_id, line, {SOURCE_LINE_SQL} AS src FROM (SELECT doc_id, line, string_split(coalesce(text, ''), chr(10))[line + 1] AS body
FROM (SELECT doc_id, text, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents)))""")
def declared_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "body"))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), P.declared_name(F.expr(SOURCE_LINE_SQL)).alias("name"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS \"index\" FROM conversations")
def reading_index(spark, d):
    return progress.indexed(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn").withColumn("index", F.col("index").cast("long"))


@query("SELECT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1)) AS href FROM pages)")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.expr("regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1)")).alias("href"))


@query()
def refreshed_state(spark, d):
    """The state after a change set; tests hold it against brute force."""
    diff = changes(spark, d)
    current = views.new_hashes(spark, d).select("path", F.when(F.col("path") % 4 == 0, "unread").otherwise("confirmed").alias("status"), F.lit(None).cast("string").alias("note"))
    edges = table(spark, d, "documents").select(F.col("doc_id").alias("src"), F.expr("doc_id div 2").alias("dst")).filter("dst > 0")
    return progress.apply_changes(current, diff, edges)


ORACLES["refreshed_state"] = f"""WITH RECURSIVE {VIEWS},
cur AS (SELECT path, CASE WHEN path % 4 = 0 THEN 'unread' ELSE 'confirmed' END AS status FROM newh),
modi AS (SELECT path FROM chg WHERE change = 'modified'), blk AS (SELECT path FROM cur WHERE status = 'unread' UNION SELECT path FROM chg WHERE change IN ('new', 'modified')),
hit AS (SELECT path AS node, path AS seed, 0 AS level FROM modi UNION SELECT d.doc_id, h.seed, h.level + 1 FROM hit h JOIN documents d ON d.doc_id // 2 = h.node AND d.doc_id // 2 > 0 WHERE d.doc_id NOT IN (SELECT path FROM blk)),
stale AS (SELECT node, min(seed) AS seed FROM (SELECT *, min(level) OVER (PARTITION BY node) AS f FROM hit WHERE level > 0) WHERE level = f GROUP BY node)
SELECT c.path, CASE WHEN m.path IS NOT NULL THEN 'unread' WHEN s.node IS NOT NULL THEN 'flagged' ELSE c.status END AS status,
CASE WHEN m.path IS NULL AND s.node IS NOT NULL THEN 'stale: depends on ' || s.seed END AS note FROM cur c LEFT JOIN modi m USING (path) LEFT JOIN stale s ON s.node = c.path"""


@query(f"""SELECT c.*, round_even(100.0 * (confirmed + flagged + skimmed) / total, 0)::BIGINT AS percent, (SELECT path FROM ord JOIN st USING (path) WHERE status = 'unread' ORDER BY idx LIMIT 1) AS next_path
FROM (SELECT count(*) AS total, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'flagged') AS flagged, count(*) FILTER (status = 'skimmed') AS skimmed, count(*) FILTER (NOT {READ_SQL}) AS unread FROM st) c""")
def status_report(spark, d):
    return reports.status_report(views.order(spark, d), state(spark, d))


@query("""SELECT n.path, n.idx AS "index", n.layer, coalesce((SELECT string_agg(t, ', ' ORDER BY t) FROM (SELECT e.dst || '=' || coalesce(s.status, 'unread') AS t FROM dag e LEFT JOIN st s ON s.path = e.dst WHERE e.src = n.path)), '') AS imports
FROM (SELECT o.* FROM ord o LEFT JOIN st s USING (path) WHERE coalesce(s.status, 'unread') = 'unread' ORDER BY o.idx LIMIT 1) n""")
def next_briefing(spark, d):
    return reports.next_briefing(views.order(spark, d), state(spark, d), views.edges_dag(spark, d))


@query("SELECT layer, layer || ': ' || count(*) || ' files, from ' || min(file) AS line FROM lay GROUP BY layer")
def index_summary(spark, d):
    return reports.index_summary(layered(spark, d).select(F.col("file").alias("path"), "layer"))


SHORT_SQL = "array_to_string(list_transform({names}[1:5], lambda x: x::VARCHAR), ', ') || CASE WHEN len({names}) > 5 THEN ' ... +' || (len({names}) - 5) || ' more' ELSE '' END"


@query(f"""SELECT n.path, CASE WHEN i.names IS NULL THEN 'Called by: none (potential dead code)' ELSE 'Called by: ' || {SHORT_SQL.format(names='i.names')} END || coalesce(' | Calls: ' || {SHORT_SQL.format(names='o.names')}, '') AS title
FROM nodes n LEFT JOIN (SELECT dst AS path, list(src ORDER BY src) AS names FROM dag GROUP BY dst) i USING (path) LEFT JOIN (SELECT src AS path, list(dst ORDER BY dst) AS names FROM dag GROUP BY src) o USING (path)""")
def lens_titles(spark, d):
    texts = lambda c: F.coalesce(F.transform(c, lambda x: x.cast("string")), F.array().cast("array<string>")).alias(c)
    found = views.nodes(spark, d).select("path").join(graph.adjacency(views.edges_dag(spark, d)), "path", "left")
    return progress.lens_titles(found.select("path", texts("imports"), texts("imported_by")))


def shipped(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files that export the names of their suppliers, in an order of their own."""
    named = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.collect_set(F.concat(F.lit("s"), "l_suppkey")).alias("exports"))
    return named.withColumn("index", F.col("path") % 97)


@query("SELECT 's' || l_suppkey AS symbol, arg_min(l_partkey, (l_partkey % 97, l_partkey)) AS path FROM lineitem GROUP BY 1")
def symbol_home(spark, d):
    return graph.find_symbol(shipped(spark, d))


@query()
def blast_result(spark, d):
    found = graph.blast_result("s3", shipped(spark, d), views.edges_cyc(spark, d))
    return found.withColumn("affected_files", F.array_join("affected_files", ","))


ORACLES["blast_result"] = f"""WITH RECURSIVE {VIEWS}, home AS (SELECT l_partkey AS path FROM lineitem WHERE l_suppkey = 3 ORDER BY l_partkey % 97, l_partkey LIMIT 1),
hit AS (SELECT src AS path FROM cyc WHERE dst IN (SELECT path FROM home) UNION SELECT e.src FROM hit h JOIN cyc e ON e.dst = h.path)
SELECT 's3' AS symbol, (SELECT path FROM home) AS source_file, (SELECT coalesce(array_to_string(list_sort(list(path)), ','), '') FROM hit) AS affected_files, (SELECT count(*) FROM hit) AS affected_count"""


@query()
def dir_tree(spark, d):
    return graph.dir_tree(views.nodes(spark, d).select(F.col("file").alias("path"), (F.col("p_size") % 25).alias("layer")))


ORACLES["dir_tree"] = f"""WITH RECURSIVE {VIEWS}, f AS (SELECT p_size % 25 AS layer, string_split(file, '/') AS parts FROM nodes),
up AS (SELECT layer, array_to_string(parts[1:k], '/') AS dir, k = len(parts) - 1 AS own FROM (SELECT layer, parts, unnest(range(1, len(parts))) AS k FROM f)),
d AS (SELECT layer, dir, count(*) FILTER (own) AS n_files, count(*) AS n_below FROM up GROUP BY ALL),
kid AS (SELECT layer, regexp_replace(dir, '/[^/]*$', '') AS dir, count(*) AS n FROM d WHERE contains(dir, '/') GROUP BY ALL),
keep AS (SELECT d.* FROM d LEFT JOIN kid USING (layer, dir) WHERE NOT (n_files = 0 AND coalesce(n, 0) = 1))
SELECT k.layer, k.dir, CASE WHEN max(length(u.dir)) IS NULL THEN k.dir ELSE substr(k.dir, max(length(u.dir)) + 2) END AS label, k.n_files, k.n_below
FROM keep k LEFT JOIN keep u ON u.layer = k.layer AND starts_with(k.dir, u.dir || '/') GROUP BY k.layer, k.dir, k.n_files, k.n_below"""


def tracked(spark: SparkSession, d: str) -> DataFrame:
    """Three in four users as tracked files with a note and a summary."""
    users = views.order(spark, d).filter("path % 4 <> 0")
    return users.select("path", F.lit("unread").alias("status"), F.lit("old").alias("note"), F.col("path").cast("string").alias("summary"))


@query("""SELECT policy, coalesce(s.path, u.path) AS path, coalesce(u.status, 'unread') AS status, CASE WHEN u.path IS NULL OR policy = 'editor' THEN s.note ELSE u.note END AS note,
CASE WHEN u.path IS NULL OR policy = 'editor' THEN s.summary WHEN policy = 'tool' THEN u.last ELSE coalesce(u.summary, s.summary) END AS summary
FROM (SELECT path, 'old' AS note, path::VARCHAR AS summary FROM ord WHERE path % 4 <> 0) s
FULL JOIN (SELECT st.*, t.summary AS last FROM st JOIN (SELECT path, summary, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS r FROM upd) t ON t.path = st.path AND t.r = 1) u ON u.path = s.path
CROSS JOIN (SELECT unnest(['library', 'tool', 'editor']) AS policy) p WHERE policy <> 'library' OR s.path IS NOT NULL""")
def update_policies(spark, d):
    after = [progress.apply_updates(tracked(spark, d), views.updates(spark, d), p).withColumn("policy", F.lit(p)) for p in ("library", "tool", "editor")]
    return after[0].union(after[1]).union(after[2])


@query("""SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click') THEN 'unknown status: ' || event_type WHEN user_id % 4 = 0 THEN 'untracked: ' || user_id END AS error FROM events""")
def update_errors(spark, d):
    """Event types as statuses: two of them stand for known ones."""
    status = F.when(F.col("event_type") == "view", "skimmed").when(F.col("event_type") == "click", "confirmed").otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("path"), status.alias("status"))
    return progress.checked_updates(rows, tracked(spark, d)).select("event_id", "error")


@query(f"SELECT 5000::BIGINT AS total, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'flagged') AS flagged, count(*) FILTER (status = 'skimmed') AS skimmed, greatest(0, 5000 - count(*) FILTER ({READ_SQL}))::BIGINT AS unread FROM st")
def carried_counts(spark, d):
    return progress.carried_counts(state(spark, d), 5000)


@query("SELECT path, 'unread' AS status, '2026-01-01T00:00:00Z' AS started_at FROM ord")
def progress_create(spark, d):
    return progress.new_state(views.order(spark, d), "2026-01-01T00:00:00Z").select("path", "status", "started_at")


@query()
def refresh_summary(spark, d):
    was = views.old_hashes(spark, d).select("path", F.when(F.col("path") % 4 == 0, "unread").otherwise("confirmed").alias("status"), F.lit(None).cast("string").alias("note"))
    edges = table(spark, d, "documents").select(F.col("doc_id").alias("src"), F.expr("doc_id div 2").alias("dst")).filter("dst > 0")
    return progress.refresh_summary(was, changes(spark, d), edges, views.new_hashes(spark, d).filter("path % 6 <> 0"))


ORACLES["refresh_summary"] = f"""WITH RECURSIVE {VIEWS}, modi AS (SELECT path FROM chg WHERE change = 'modified'),
blk AS (SELECT path FROM oldh WHERE path % 4 = 0 UNION SELECT path FROM chg WHERE change IN ('new', 'modified')),
hit AS (SELECT path AS node, 0 AS level FROM modi UNION SELECT d.doc_id, h.level + 1 FROM hit h JOIN documents d ON d.doc_id // 2 = h.node AND d.doc_id // 2 > 0 WHERE d.doc_id NOT IN (SELECT path FROM blk))
SELECT count(*) FILTER (change = 'new') AS "new", count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'unchanged') AS unchanged,
count(*) FILTER (change = 'unchanged' AND path IN (SELECT node FROM hit WHERE level > 0)) AS stale, count(*) FILTER (change <> 'removed' AND path % 6 = 0) AS pruned FROM chg"""


@query("""SELECT l_orderkey AS path, count(DISTINCT l_linenumber) FILTER (l_returnflag = 'R') AS n_read, count(DISTINCT l_linenumber) AS n_exports,
count(DISTINCT l_linenumber) FILTER (l_returnflag = 'R') > 0 AND count(DISTINCT l_linenumber) FILTER (l_returnflag = 'R') < count(DISTINCT l_linenumber) AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS partial FROM lineitem GROUP BY l_orderkey""")
def export_progress(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("name"), "l_returnflag")
    marks = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("unread").alias("status"))
    return progress.export_progress(lines, lines.filter("l_returnflag = 'R'"), marks)


@query(f"SELECT list_position(['foundation', 'core', 'features', 'integration', 'entry'], layer) - 1 AS rank, layer || ' (' || count(*) FILTER ({READ_SQL}) || '/' || count(*) || ' read)' AS line FROM ord LEFT JOIN st USING (path) GROUP BY layer")
def layer_lines(spark, d):
    return reports.layer_lines(progress.layer_progress(views.order(spark, d), state(spark, d)))


@query("SELECT st.path, CASE WHEN st.path IN (SELECT dst FROM dag WHERE src = 10) THEN 'dependency' ELSE 'general' END AS bucket, status, summary FROM st JOIN ord USING (path) WHERE status <> 'unread' AND st.path <> 10")
def summaries_split(spark, d):
    current = views.nodes(spark, d).filter("path = 10").select("path")
    return progress.summaries_split(views.order(spark, d), state(spark, d), views.edges_dag(spark, d), current)


@query(f"SELECT path, CASE WHEN path = 10 THEN '{progress.CURRENT_BADGE}' WHEN status = 'confirmed' THEN '{progress.BADGES['confirmed']}' WHEN status = 'flagged' THEN '!' WHEN status = 'skimmed' THEN '~' END AS badge FROM st")
def status_badges(spark, d):
    return progress.decorated(state(spark, d), views.order(spark, d).filter("path = 10"))


@query("SELECT path FROM st WHERE status = 'flagged' AND path NOT IN (SELECT path FROM ord WHERE layer = 'core')")
def flagged_remaining(spark, d):
    return progress.remaining(state(spark, d).filter("status = 'flagged'"), views.order(spark, d).filter("layer = 'core'")).select("path")


GIT_PATH = "concat('d', doc_id % 3, '/', doc_id)"


@query(f"""SELECT path, change FROM (SELECT {GIT_PATH} AS path, CASE doc_id % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'modified' WHEN 2 THEN 'removed' WHEN 3 THEN 'removed' END AS change FROM documents
UNION ALL SELECT concat('moved/', doc_id), 'new' FROM documents WHERE doc_id % 7 = 3) WHERE change IS NOT NULL AND NOT starts_with(path, 'd0/')
UNION ALL SELECT {GIT_PATH}, 'unchanged' FROM documents WHERE doc_id % 7 > 3 OR doc_id % 3 = 0""")
def git_changes(spark, d):
    docs = table(spark, d, "documents").select(F.expr(GIT_PATH).alias("path"), "doc_id")
    lines = docs.select(F.get(F.split(F.lit("A,M,D,R100,C75,T,U"), ","), (F.col("doc_id") % 7).cast("int")).alias("status"), "path", F.concat(F.lit("moved/"), "doc_id").alias("new_path"))
    return progress.with_unchanged(progress.outside_dir(progress.git_changes(lines), "d0"), docs)


@query(f"""SELECT count(*) AS n_files, sum(n)::BIGINT AS n_lines, ceil(count(*) / 35)::BIGINT AS sessions
FROM (SELECT {CODE_LINES_SQL} AS n FROM documents)""")
def size_estimate(spark, d):
    return reports.size_estimate(table(spark, d, "documents").select(P.code_lines(F.col("text")).alias("line_count")))


@query("SELECT l_partkey AS path, avg((l_returnflag IN ('A', 'R'))::INT::DOUBLE) AS type_share FROM lineitem GROUP BY 1")
def contract_ratio(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "type").when(F.col("l_returnflag") == "R", "class").otherwise("variable")
    return graph.contract_ratio(table(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), kind.alias("kind")))


@query("SELECT path FROM deg WHERE p_size = 1 OR split_part(file, '/', 3) IN ('main.py', '__main__.py', 'app.py', 'server.py', 'cli.py', 'm5.py') OR (fan_in = 0 AND p_size % 2 = 0)")
def entry_files(spark, d):
    hit = order.is_entry(F.col("file"), F.col("fan_in"), F.col("p_size") == 1, F.col("p_size") % 2 == 0, {"tool": "pkg.m5:main"})
    return metrics(spark, d).filter(hit).select("path")


@query("""SELECT path, CASE WHEN fan_in >= 3 THEN 'Contract surface (core layer).' || CASE WHEN fan_in > 0 THEN ' Imported by ' || fan_in || ' file(s).' ELSE '' END
WHEN fan_out > 1 THEN 'Data flow path (core layer).' || ' Depends on ' || fan_out || ' file(s).' ELSE 'Utility code (core layer).' END AS reason FROM deg""")
def reasons(spark, d):
    kind = F.when(F.col("fan_in") >= 3, "contracts").when(F.col("fan_out") > 1, "data_flow").otherwise("utility")
    return metrics(spark, d).select("path", order.reason(kind, F.lit("core"), F.col("fan_in"), F.col("fan_out")).alias("reason"))


@query(f"""SELECT concat_ws(chr(10), 'Progress: ' || r || '/' || n || ' files (' || round_even(100.0 * r / n, 0)::BIGINT || '%)', '  confirmed: ' || c, '  flagged: ' || f, '  skimmed: ' || s, '  unread: ' || (n - r), '',
coalesce('Current layer: ' || (SELECT layer || ' (' || percent || '% complete)' FROM ({CURRENT_SQL.format(round=f"round_even(100.0 * count(*) FILTER ({READ_SQL}) / count(*), 0)", by="layer")})), 'All layers complete'),
'Next file: ' || coalesce((SELECT path::VARCHAR FROM ord JOIN st USING (path) WHERE status = 'unread' ORDER BY idx LIMIT 1), '(none -- all files read)'), 'Flagged files awaiting second pass: ' || f, '',
'Sessions: 3 | Avg pace: ~' || round_even(r / 3, 0)::BIGINT || ' files/session') AS text
FROM (SELECT count(*) AS n, count(*) FILTER ({READ_SQL}) AS r, count(*) FILTER (status = 'confirmed') AS c, count(*) FILTER (status = 'flagged') AS f, count(*) FILTER (status = 'skimmed') AS s FROM st)""")
def status_text(spark, d):
    return reports.status_text(views.order(spark, d), state(spark, d), 3)
