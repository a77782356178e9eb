"""The two JSON documents as tables, and their sinks."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from cairnway.operators.lifecycle import Progress, exports_of, with_stats
from cairnway.operators.order import LAYERS

ENTRY = (
    "struct<index:int,path:string,layer:string,reason:string,complexity:string,line_count:int,imports:array<string>,imported_by:array<string>,"
    "exports:array<string>,symbol_usage:map<string,struct<callers:int,used_by:array<string>>>>"
)
MAP = (
    "version string, repo_root string, generated_at string, total_files int, content_hashes map<string,string>, "
    f"layers map<string,struct<description:string,files:array<string>>>, reading_order array<{ENTRY}>, "
    "dependency_graph map<string,struct<imports:array<string>,imported_by:array<string>>>"
)
PROGRESS = (
    "version string, map_hash string, started_at string, last_session string, sessions int, next_unread_index int, git_commit string, git_branch string, "
    "files map<string,struct<status:string,read_at:string,note:string,summary:string,exports_read:map<string,struct<read_at:string,summary:string>>>>, "
    "stats struct<total:int,confirmed:int,flagged:int,skimmed:int,unread:int>"
)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """Map documents; those without version, order or graph are left out."""
    read = spark.read.schema(MAP).option("multiLine", "true").json(path)
    return read.filter("version is not null and reading_order is not null and dependency_graph is not null")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.schema(PROGRESS).option("multiLine", "true").json(path)
    return read.filter("version is not null and files is not null and stats is not null")


def order_of(maps: DataFrame) -> DataFrame:
    return maps.select(F.explode("reading_order").alias("e")).select("e.*")


def edges_of(maps: DataFrame) -> DataFrame:
    return maps.select(F.explode("dependency_graph").alias("src", "g")).select("src", F.explode("g.imports").alias("dst"))


def hashes_of(maps: DataFrame) -> DataFrame:
    return maps.select(F.explode("content_hashes").alias("path", "hash"))


def state_of(progress: DataFrame) -> DataFrame:
    return progress.select(F.explode("files").alias("path", "f")).select("path", "f.*")


def progress_or_none(spark: SparkSession, path: str) -> Progress | None:
    """The progress of an earlier index; None if there is no readable one."""
    try:
        found = read_progress(spark, path)
    except AnalysisException:  # no such path
        return None
    return None if found.isEmpty() else progress_of(found)


def hashes_or_none(spark: SparkSession, path: str) -> DataFrame:
    """The hashes of an earlier index; an empty table if there is no readable one."""
    try:
        return hashes_of(read_map(spark, path))
    except AnalysisException:  # no such path
        return spark.createDataFrame([], "path string, hash string")


def map_document(entries: DataFrame, hashes: DataFrame, repo_root: str, generated_at: Column, version: str = "1.0.0") -> DataFrame:
    """One row in the shape of ``MAP``.

    A map document is a single JSON value by its format, so it holds one repository; larger sets stay tables.
    """
    entry = F.struct("index", "path", "layer", "reason", "complexity", "line_count", "imports", "imported_by", "exports", "symbol_usage")
    links = F.struct("path", F.struct("imports", "imported_by"))
    ordered = F.array_sort(F.collect_list(entry), lambda a, b: a["index"] - b["index"])
    body = entries.agg(F.count("*").cast("int").alias("total_files"), ordered.alias("reading_order"), F.map_from_entries(F.array_sort(F.collect_list(links))).alias("dependency_graph"))
    grouped = entries.groupBy("layer").agg(F.array_sort(F.collect_list("path")).alias("files"))
    names = grouped.sparkSession.createDataFrame([(x,) for x in LAYERS], "layer string").join(grouped, "layer", "left")
    none = F.array().cast("array<string>")
    layers = names.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", F.struct(F.concat("layer", F.lit(" layer")).alias("description"), F.coalesce("files", none).alias("files")))))).alias("layers"))
    known = hashes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "hash")))).alias("content_hashes"))
    one = body.join(layers, F.lit(True)).join(known, F.lit(True))  # single rows
    return one.select(
        F.lit(version).alias("version"), F.lit(repo_root).alias("repo_root"), generated_at.alias("generated_at"), "total_files", "content_hashes", "layers", "reading_order", "dependency_graph"
    )


def map_hash(maps: DataFrame) -> DataFrame:
    """``hash``: the SHA-256 of a map document without its time."""
    kept = F.to_json(F.struct(*[c for c in maps.columns if c != "generated_at"]))
    return maps.select(F.sha2(kept, 256).alias("hash"))


def progress_document(progress: Progress) -> DataFrame:
    """One row in the shape of ``PROGRESS``, with counts taken anew; one repository's files, as the format asks."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<read_at:string,summary:string>>"))
    read = exports_of(progress).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("read_at", "summary")))).alias("_read"))
    entry = F.struct("status", "read_at", "note", "summary", F.coalesce("_read", none).alias("exports_read"))
    files = progress.files.join(read, "path", "left").agg(F.map_from_entries(F.collect_list(F.struct("path", entry))).alias("files"))
    stats = F.struct(*[F.col(c).cast("int").alias(c) for c in ("total", "confirmed", "flagged", "skimmed", "unread")])
    one = with_stats(progress).join(files, F.lit(True))  # single rows
    return one.select(
        "version", "map_hash", "started_at", "last_session", F.col("sessions").cast("int").alias("sessions"), F.col("next_unread_index").cast("int").alias("next_unread_index"),
        "git_commit", "git_branch", "files", stats.alias("stats"),
    )


def progress_of(documents: DataFrame) -> Progress:
    """The tables of a progress document."""
    meta = documents.select("version", "map_hash", "started_at", "last_session", "sessions", F.col("next_unread_index").cast("long").alias("next_unread_index"), "git_commit", "git_branch")
    state = state_of(documents)
    exports = state.select("path", F.explode("exports_read").alias("name", "e")).select("path", "name", "e.read_at", "e.summary")
    return Progress(meta, state.select("path", "status", "read_at", "note", "summary"), exports)


def _sorted_fields(name: Column | str, kind: DataType) -> Column:
    """A value whose structs have their fields in order of name."""
    at = F.col(name) if isinstance(name, str) else name
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(at.isNotNull(), F.struct(*[_sorted_fields(at[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(at, lambda x: _sorted_fields(x, kind.elementType))
    if isinstance(kind, MapType):
        pairs = F.transform(F.map_entries(at), lambda e: F.struct(e["key"].alias("key"), _sorted_fields(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(pairs, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return at


def as_json(document: DataFrame) -> DataFrame:
    """``value``: the rows as indented JSON with sorted keys."""
    whole = _sorted_fields(F.struct(*document.columns), document.schema)
    return document.select(F.to_json(whole, {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def write_document(document: DataFrame, path: str) -> None:
    """A single row as one JSON file: written beside it first, then renamed over what is there, so that readers see a whole document."""
    spark = document.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    as_json(document).coalesce(1).write.text(aside.toString())  # one row
    try:
        part = next(s.getPath() for s in fs.listStatus(aside) if s.getPath().getName().startswith("part-"))
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf).rename(fs.makeQualified(part), fs.makeQualified(target), over)
        # A checksum beside a local file would make it unreadable once it is edited.
        fs.delete(jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.crc"), False)
    finally:
        fs.delete(aside, True)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, replacing what is there; the committer renames finished files, so readers see whole tables."""
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
