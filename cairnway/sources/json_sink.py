"""One large JSON document as a batch sink: ``df.write.format("json_document").mode("overwrite").option("path", file).save()``.

Rows are pieces of the document, ``section, kind, place, key, value``: a section is a member of the document, an ``object`` of keys, a ``list``, a single
``value``, or ``raw`` text inside braces, and ``value`` is JSON text.  Rows come range-partitioned and sorted (``pieces``), each task writes its range as one fragment beside the document, and
the commit copies the fragments one after the other into a new file and renames it over the old.  So no task and no row holds more than a fragment,
readers see a whole document, and a failed job leaves the old one.

Defined results: sections come in order of name, their rows in order of place, then key; sections without rows are given as ``empty``; the folder is one
that the driver and all executors see under one name.
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from cairnway.operators.lifecycle import Progress, exports_of, with_stats
from cairnway.operators.order import LAYERS

#: What stands around the rows of a section, and between two of them; the rows of ``raw`` carry their own marks.
BRACKETS = {"object": ("{", "}", ",\n"), "list": ("[", "]", ",\n"), "value": ("", "", ""), "raw": ("{", "}", "")}


@dataclass
class Fragment(WriterCommitMessage):
    """What a task has written: its file, and for each section in order the name, the kind and the bytes."""

    partition: int
    path: str
    sections: list[tuple[str, str, int]]


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, empty: dict[str, str]):
        self.path, self.empty = path, empty
        self.aside = f"{path}.{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Fragment:
        task = TaskContext.get()
        path = f"{self.aside}.{task.partitionId()}.{task.attemptNumber()}"
        sections: list[tuple[str, str, int]] = []
        with open(path, "wb") as file:
            for r in rows:
                goes_on = bool(sections) and sections[-1][0] == r.section
                piece = (f"{json.dumps(r.key)}: " if r.kind == "object" else "") + r.value
                data = (BRACKETS[r.kind][2] if goes_on else "").encode() + piece.encode()
                file.write(data)
                if goes_on:
                    sections[-1] = r.section, r.kind, sections[-1][2] + len(data)
                else:
                    sections.append((r.section, r.kind, len(data)))
        return Fragment(task.partitionId(), path, sections)

    def commit(self, messages: list[Fragment | None]) -> None:
        """Section after section: a fragment is copied a buffer at a time."""
        spans: dict[str, list[tuple[str, int, int]]] = {}
        kinds = dict(self.empty)
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            at = 0
            for section, kind, size in m.sections:
                kinds[section] = kind
                spans.setdefault(section, []).append((m.path, at, size))
                at += size
        whole = f"{self.aside}.whole"
        with open(whole, "wb") as out:
            out.write(b"{\n")
            for n, section in enumerate(sorted(kinds)):
                opening, closing, between = BRACKETS[kinds[section]]
                out.write((",\n" if n else "").encode() + f"{json.dumps(section)}: {opening}".encode())
                for i, (path, at, size) in enumerate(spans.get(section, [])):
                    out.write(between.encode() if i else b"")
                    with open(path, "rb") as part:
                        part.seek(at)
                        while size:
                            data = part.read(min(size, 1 << 20))
                            out.write(data)
                            size -= len(data)
                if kinds[section] == "value" and section not in spans:
                    out.write(b"null")
                out.write(closing.encode())
            out.write(b"\n}\n")
            out.flush()
            os.fsync(out.fileno())
        os.replace(whole, self.path)
        self._clear()

    def abort(self, messages: list[Fragment | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for path in glob.glob(f"{glob.escape(self.aside)}.*"):
            os.remove(path)


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_document"

    SHAPE = "section string, kind string, place long, key string, value string"

    def schema(self) -> str:
        return self.SHAPE

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        path = self.options["path"]
        if not overwrite and os.path.exists(path):
            raise FileExistsError(path)
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        return DocumentWriter(path, json.loads(self.options.get("empty", "{}")))


def write_pieces(pieces: DataFrame, path: str, empty: dict[str, str] | None = None) -> None:
    """Writes ``pieces(section, kind, place, key, value)`` as the document ``path``; ``empty``: the kinds of sections that may have no rows."""
    pieces.sparkSession.dataSource.register(DocumentSink)
    order = ["section", "place", "key"]
    rows = pieces.select("section", "kind", F.col("place").cast("long").alias("place"), "key", "value").repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.format("json_document").mode("overwrite").option("empty", json.dumps(empty or {})).save(path)


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.char_length(listed) - 2)


def write_map(entries: DataFrame, hashes: DataFrame, path: str, repo_root: str, generated_at: str, version: str = "1.0.0") -> None:
    """A map document in the shape of ``documents.MAP``, of any number of files: ``entries`` and ``hashes`` as ``documents.map_document`` takes them."""
    spark, zero, none = entries.sparkSession, F.lit(0), F.lit(None).cast("string")

    def pieces(df: DataFrame, section: str, kind: str, place: Column, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.lit(kind).alias("kind"), place.cast("long").alias("place"), key.alias("key"), value.alias("value"))

    facts = {"version": version, "repo_root": repo_root, "generated_at": generated_at}
    parts = [spark.createDataFrame([(k, "value", 0, None, json.dumps(v)) for k, v in facts.items()], DocumentSink.SHAPE)]
    parts.append(pieces(entries.agg(F.count("*").alias("n")), "total_files", "value", zero, none, F.col("n").cast("string")))
    parts.append(pieces(hashes, "content_hashes", "object", zero, F.col("path"), _quoted(F.col("hash"))))
    entry = F.struct("index", "path", "layer", "reason", "complexity", "line_count", "imports", "imported_by", "exports", "symbol_usage")
    parts.append(pieces(entries, "reading_order", "list", F.col("index"), F.col("path"), _json(entry)))
    parts.append(pieces(entries, "dependency_graph", "object", zero, F.col("path"), _json(F.struct("imports", "imported_by"))))
    # The files of a layer are a list inside an object: rows between them open and close it.
    heads = [(f'{"]}," if i else ""}{json.dumps(x)}: {{"description": {json.dumps(x + " layer")}, "files": [', 2 * i) for i, x in enumerate(LAYERS)] + [("]}", 2 * len(LAYERS))]
    parts.append(pieces(spark.createDataFrame(heads, "text string, n int"), "layers", "raw", F.col("n"), F.lit(""), F.col("text")))
    first = entries.groupBy("layer").agg(F.min("path").alias("_first"))
    place = 2 * F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer")) - 1
    mark = F.when(F.col("path") == F.col("_first"), "").otherwise(", ")
    parts.append(pieces(entries.select("path", "layer").join(first, "layer"), "layers", "raw", place, F.col("path"), F.concat(mark, _quoted(F.col("path")))))
    write_pieces(reduce(DataFrame.union, parts), path, {"content_hashes": "object", "reading_order": "list", "dependency_graph": "object"})


def write_progress(progress: Progress, path: str) -> None:
    """A progress document in the shape of ``documents.PROGRESS``, with counts taken anew, of any number of files."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    facts = with_stats(progress)
    stats = _json(F.struct(*[F.col(c).cast("int").alias(c) for c in ("total", "confirmed", "flagged", "skimmed", "unread")]))
    text = {c: F.coalesce(_quoted(F.col(c)), F.lit("null")) for c in ("version", "map_hash", "started_at", "last_session", "git_commit", "git_branch")}
    text |= {c: F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("sessions", "next_unread_index")} | {"stats": stats}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), v.alias("value")) for k, v in sorted(text.items())]))
    single = facts.select(rows.alias("r")).select("r.section", F.lit("value").alias("kind"), zero.alias("place"), none.alias("key"), "r.value")
    read = exports_of(progress).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("read_at", "summary"))))).alias("exports_read"))
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<read_at:string,summary:string>>"))
    files = progress.files.join(read, "path", "left").withColumn("exports_read", F.coalesce("exports_read", nothing))
    entry = _json(F.struct("status", "read_at", "note", "summary", "exports_read"))
    tracked = files.select(F.lit("files").alias("section"), F.lit("object").alias("kind"), zero.alias("place"), F.col("path").alias("key"), entry.alias("value"))
    write_pieces(single.union(tracked), path, {"files": "object"})
