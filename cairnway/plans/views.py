"""Graph-shaped views over the driver's tables, derived by Spark so that work grows with the tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnway.plans.staging import staging_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The path of part ``k``, in SQL that Spark and DuckDB share.
PATH_SQL = """concat(lower(replace(p_type, ' ', '_')), '/', CASE p_partkey % 9 WHEN 4 THEN 'utils' ELSE lower(replace(p_brand, '#', '_')) END, '/',
  CASE WHEN p_partkey % 10 = 3 THEN concat('test_m', p_partkey - 1) WHEN p_partkey % 50 = 7 THEN 'types' ELSE concat('m', p_partkey) END, '.py')"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, file, repo_id``: files keyed by part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.expr(PATH_SQL).alias("file"), F.col("p_brand").alias("repo_id"), "p_size")


def edges_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    both = part.select("src", F.explode(F.array(F.expr("src div 2"), F.expr("src div 3"))).alias("dst"))
    return both.filter("dst > 0 and dst < src").distinct()


def edges_cyc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = table(spark, sf_dir, "part").filter("p_size = 7 and p_partkey > 3").select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst"))
    return edges_dag(spark, sf_dir).union(back).distinct()


def order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``index, path, layer``: users as files in id order, with a layer each."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    names = F.array(*[F.lit(x) for x in ("foundation", "core", "features", "integration", "entry")])
    return users.select(F.col("user_id").alias("index"), F.col("user_id").alias("path"), F.get(names, (F.col("user_id") % 5).cast("int")).alias("layer"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, seq, status, note, summary``: events as status updates, in order of time and id."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*[F.lit(x) for x in ("confirmed", "flagged", "skimmed", "unread")]), ((F.length("event_type") + F.col("event_id")) % 4 + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("path"), F.struct("ts", "event_id").alias("seq"), status.alias("status"), F.col("event_type").alias("note"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).alias("summary"),
    )


def old_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("doc_id % 10 <> 1")
    return d.select(F.col("doc_id").alias("path"), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 8).alias("hash"))


def new_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("doc_id % 10 <> 2")
    body = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 10 == 3, "!").otherwise(""))
    return d.select(F.col("doc_id").alias("path"), F.substring(F.sha2(body, 256), 1, 8).alias("hash"))


#: The number ``k`` of a part, half of it and a neighbour, in SQL that Spark and DuckDB share; the sources below are made of them.
NUMBERS = ["p_partkey AS k", "CAST(floor(p_partkey / 2) AS BIGINT) AS a", "CAST(greatest(p_partkey - 7, 0) AS BIGINT) AS b"]
PYTHON_PATH_SQL = "concat('pkg', {0} % 7, CASE WHEN {0} % 5 = 0 THEN '/sub' ELSE '' END, '/m', {0}, '.py')"
PYTHON_MODULE_SQL = "concat('pkg', {0} % 7, CASE WHEN {0} % 5 = 0 THEN '.sub' ELSE '' END, '.m', {0})"
#: (language, path, lines) of each part's source files.
SOURCES_SQL = [
    ("python", PYTHON_PATH_SQL.format("k"), [
        "'import os, json'", f"CASE WHEN a > 0 THEN concat('from ', {PYTHON_MODULE_SQL.format('a')}, ' import f', a) ELSE 'import sys' END", "concat('from .m', b, ' import C', b, ' as c')",
        "concat('LIMIT_', k, ' = 1')", "concat('def f', k, '(x):')", "concat('    return f', a, '(os.path.join(x), g.h(x))')", "concat('class C', k, ':')", "'    def m(self):'",
        "'        for i in x:'", "'            self.n(i)'", "'_hidden = 2'",
        "CASE k % 3 WHEN 0 THEN concat('if __name__ == \"__main__\": f', k, '(1)') WHEN 1 THEN concat('f', k, '(2)') ELSE 'LAST = 3' END", "CASE WHEN k % 11 = 0 THEN 'def (' ELSE '' END",
    ]),
    ("script", "concat('web', k % 4, '/c', k, '.ts')", [
        "concat('import def, { x', a, ' as y } from \"../web', a % 4, '/c', a, '.js\";')", "'// import no from \"./no\"'", "'import * as all from \"react\";'",
        "concat('export function x', k, '(p) { return g', k, '(p, \"h()\"); }')", "concat('export class K', k, ' {')", "'  run(q) { this.s(q); }'", "'  field = (z) => { other(z); }'", "'}'",
        "concat('const arrow = async (v) => { x', k, '(v); };')", "concat('export { arrow as other, K', k, ' as default };')", "concat('module.exports = { left', k, ', right: 1 };')",
        "concat('export interface I', k, ' { m(): void }')",
    ]),
    ("go", "concat('go', k % 3, '/p', k, '/m.go')", [
        "concat('package ', CASE WHEN k % 2 = 0 THEN 'main' ELSE 'other' END)", "'import ('", "'  \"fmt\"'", "concat('  y \"ex.org/r', k % 3, '/p', a, '\"')", "')'", "'const ('", "concat('  A', k, ', b = 1, 2')",
        "')'", "'type ('", "concat('  S', k, ' struct { N int }')", "concat('  I', k, ' interface { Do() }')", "')'", "concat('func (r *S', k, ') Do() { fmt.Println(y.F(), \"f()\") }')", "'func main() { run() }'",
    ]),
]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, language, content``: three source files a part, and the roots of Go modules."""
    # Numbers are dealt out before texts are made of them, so that a table in few pieces keeps all tasks busy.
    part = table(spark, sf_dir, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism).selectExpr(*NUMBERS)
    out = spark.range(3).select(F.concat(F.lit("go"), "id", F.lit("/go.mod")).alias("path"), F.lit(None).cast("string").alias("language"), F.concat(F.lit("module ex.org/r"), "id").alias("text"))
    for language, path, lines in SOURCES_SQL:
        out = out.union(part.select(F.expr(path), F.lit(language), F.concat_ws("\n", *[F.expr(x) for x in lines])))
    return out.select("path", "language", F.col("text").cast("binary").alias("content"))


#: Paths of a tree with files that a scan passes over, and its ignore file.
TREE_PATH_SQL = """CASE k % 8 WHEN 1 THEN concat('node_modules/m', k, '.py') WHEN 2 THEN concat('src/m', k, '.txt') WHEN 3 THEN concat('src/tests/t', k, '.py') WHEN 4 THEN concat('src/test_', k, '.py')
  WHEN 5 THEN concat('out/m', k, '.py') WHEN 6 THEN concat('src/m', k, '.pyc') WHEN 7 THEN concat('src/w/m', k, '.tsx') ELSE concat('src/a', k % 13, '/m', k, '.py') END"""
TREE_IGNORE = "out/\n*.py[co]\n# no\n"


def written_tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder of the shared file system that holds one small file a part; it must be a mounted one, as trees are."""
    root = staging_root(spark)
    if not root.startswith(("file:", "/")):
        raise ValueError(f"a source tree is read from a mounted folder, not from {root}")
    at = os.path.join(root.removeprefix("file://").removeprefix("file:"), f"cairnway/tree-{uuid.uuid4().hex}")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text in zip(frame["path"], frame["text"], strict=True):
                os.makedirs(os.path.dirname(f"{at}/{path}"), exist_ok=True)
                with open(f"{at}/{path}", "w", encoding="utf-8") as file:
                    file.write(text)
            yield frame[["path"]]

    part = table(spark, sf_dir, "part").selectExpr(*NUMBERS)
    rows = part.select(F.expr(TREE_PATH_SQL).alias("path"), F.concat(F.lit("x = "), "k").alias("text"))
    rows.union(spark.createDataFrame([(".gitignore", TREE_IGNORE)], rows.schema)).mapInPandas(write, "path string").count()
    return at


def order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in the shape of a map document's entries, linked as parts are."""
    users = order(spark, sf_dir)
    links = edges_dag(spark, sf_dir).join(users.select(F.col("path").alias("src")), "src", "left_semi").join(users.select(F.col("path").alias("dst")), "dst", "left_semi")
    side = lambda key, other, name: links.groupBy(F.col(key).alias("path")).agg(F.transform(F.array_sort(F.collect_list(other)), lambda x: x.cast("string")).alias(name))
    none = F.array().cast("array<string>")
    rows = users.join(side("src", "dst", "imports"), "path", "left").join(side("dst", "src", "imported_by"), "path", "left")
    return rows.select(
        F.col("index").cast("int").alias("index"), F.col("path").cast("string").alias("path"), "layer", F.when(F.col("index") % 2 == 0, "Even.").otherwise("").alias("reason"), F.lit("low").alias("complexity"),
        (F.col("index") * 3).cast("int").alias("line_count"), F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"),
        F.when(F.col("index") % 3 == 0, F.array(F.lit("f"), F.lit("g"))).otherwise(none).alias("exports"),
    )
