"""Streaming sources and keyed states across restarts, and the document sink."""

import json
import os
import pickle
import socket
import time

import pytest
from pyspark.sql import functions as F

from cairnway.operators import lifecycle
from cairnway.sources import documents, json_sink
from cairnway.streaming import events, keyed, socket_source, tree_changes


def said(path, *messages):
    """Sends lines to a socket and gives what comes back."""
    for _ in range(200):
        try:
            client = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
            client.connect(path)
            break
        except OSError:
            time.sleep(0.1)
    with client:
        for m in messages:
            client.sendall(m if isinstance(m, bytes) else json.dumps(m).encode() + b"\n")
        client.shutdown(socket.SHUT_WR)
        data = b""
        while chunk := client.recv(65536):
            data += chunk
    return [json.loads(x) for x in data.split(b"\n") if x]


def test_events_of_a_socket_are_neither_lost_nor_repeated(spark, tmp_path):
    at, log, seen = str(tmp_path / "s.sock"), str(tmp_path / "log"), []

    def start():
        rows = socket_source.read_socket(spark, at, log)
        react = lambda df, _: seen.extend((r.id, r.request, r.tool, r.params) for r in df.collect())
        return rows.writeStream.foreachBatch(react).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()

    def wait(n):
        deadline = time.time() + 60
        while len(seen) < n and time.time() < deadline:
            time.sleep(0.2)

    query = start()
    replies = said(at, {"id": 7, "tool": "mark_read", "params": {"file": "a"}}, {"id": 8, "tool": "rm", "params": {}}, b"no json\n\n[1]\n", {"id": 9, "tool": "clear_all"})
    assert replies == [{"id": 7, "result": {"logged": 0}}, {"id": 8, "error": "Unknown tool: rm"}, {"id": 9, "result": {"logged": 1}}]
    wait(2)
    query.stop()
    # An event that was answered while no batch ran is read by the next start.
    socket_source.EventLog(log).append(json.dumps({"request": 1, "tool": "mark_read", "params": "null"}))
    query = start()
    wait(3)
    said(at, {"id": "x", "tool": "mark_flagged", "params": None})
    wait(4)
    query.stop()
    assert seen == [(0, 7, "mark_read", '{"file": "a"}'), (1, 9, "clear_all", "null"), (2, 1, "mark_read", "null"), (3, None, "mark_flagged", "null")]


def test_the_event_log_goes_on_and_forgets(tmp_path):
    log = socket_source.EventLog(str(tmp_path / "log"), segment=3)
    assert log.bounds() == (0, 0) and [log.append(f"e{i}") for i in range(8)] == list(range(8))
    with open(log._path(6), "ab") as file:
        file.write(b"half")  # a process died while it wrote
    again = pickle.loads(pickle.dumps(socket_source.EventLog(str(tmp_path / "log"), segment=3)))
    assert again.append("e8") == 8 and [x for _, x in again.read(2, 9)] == [f"e{i}" for i in range(2, 9)]
    again.forget(7)
    assert again.bounds() == (6, 9)
    listener = socket_source.Listener(str(tmp_path / "l.sock"), again)
    assert listener.answer(b'{"id": 1, "tool": "no"}') == {"id": 1, "error": "Unknown tool: no"}
    big = b"x" * (socket_source.MOST_BYTES + 70_000)
    assert said(str(tmp_path / "l.sock"), {"id": 1, "tool": "clear_all"}) == [{"id": 1, "result": {"logged": 9}}]
    client = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
    client.connect(str(tmp_path / "l.sock"))
    with pytest.raises(OSError):
        client.sendall(big)
        client.sendall(big)
    assert socket_source.socket_path(str(tmp_path)) == socket_source.socket_path(f"{tmp_path}/") and len(os.path.basename(socket_source.socket_path("/x"))) == 9 + 16 + 5


def test_files_come_change_and_go_once_across_restarts(spark, tmp_path):
    root, seen = tmp_path / "tree", []
    (root / "a").mkdir(parents=True)
    (root / "a/one.py").write_text("1")
    (root / "two.py").write_text("2")

    def run():
        seen.clear()
        rows = tree_changes.read_changes(spark, str(root), str(tmp_path / "listings"))
        rows.writeStream.foreachBatch(lambda df, _: seen.extend((r.path, r.change) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted(seen)

    assert run() == [("a/one.py", "new"), ("two.py", "new")]
    (root / "two.py").unlink()
    (root / "a/one.py").write_text("changed")
    (root / "b.py").write_text("3")
    assert run() == [("a/one.py", "modified"), ("b.py", "new"), ("two.py", "removed")]
    assert run() == []


def log_of(spark, rows):
    return spark.createDataFrame([("w", i, t, json.dumps(p)) for i, t, p in rows], "workspace string, id long, tool string, params string")


def test_running_states_equal_their_batch_forms(spark, tmp_path):
    log = [
        (1, "highlight_range", {"file": "a", "start": 1, "end": 2}), (2, "highlight_range", {"file": "b", "start": 3, "end": 4}), (3, "mark_export_read", {"file": "a", "export": "f"}),
        (4, "clear_all", {}), (5, "highlight_range", {"file": "a", "start": 5, "end": 6}), (6, "highlight_range", {"file": "a", "start": 7, "end": 7}),
        (7, "mark_export_read", {"file": "a", "export": "f"}), (8, "highlight_range", {"file": "c", "start": 1, "end": 1}), (9, "clear_highlights", {"file": "c"}), (10, "mark_export_read", {"file": "b", "export": "g"}),
    ]
    folder = str(tmp_path / "in")
    shown, marks = {}, {}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for part in (log[:3], log[3:7], log[2:]):  # the last repeats some
            log_of(spark, part).coalesce(1).write.mode("append").json(folder)
            rows = spark.readStream.schema("workspace string, id long, tool string, params string").json(folder)
            for running, kept, key in ((keyed.running_highlights(rows), shown, "path"), (keyed.running_export_marks(rows), marks, "name")):

                def keep(df, _, kept=kept, key=key):
                    for r in df.orderBy("id").collect():
                        kept[r.path if key == "path" else (r.path, r.name)] = [tuple(x) for x in r.ranges] if key == "path" and r.ranges is not None else r.seq if key == "name" else None

                q = running.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / f"cp-{key}")).trigger(availableNow=True).start()
                q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    table = log_of(spark, log).drop("workspace")
    assert {k: v for k, v in shown.items() if v} == {r.path: [tuple(x) for x in r.ranges] for r in events.highlights(table).collect()}
    assert marks == {(r.path, r.name): r.seq for r in events.export_marks(table).collect()}


def test_documents_are_written_in_fragments(spark, tmp_path):
    entries = spark.range(500).select(
        F.col("id").cast("int").alias("index"), F.concat(F.lit('d "q"/f'), "id").alias("path"), F.element_at(F.array(*[F.lit(x) for x in json_sink.LAYERS]), (F.col("id") % 4 + 1).cast("int")).alias("layer"),
        F.lit("Why.").alias("reason"), F.lit("low").alias("complexity"), F.lit(3).alias("line_count"), F.array(F.lit("x")).alias("imports"), F.array().cast("array<string>").alias("imported_by"),
        F.array(F.lit("f")).alias("exports"), F.lit(None).cast("map<string,struct<callers:int,used_by:array<string>>>").alias("symbol_usage"),
    ).repartition(7)
    hashes = entries.select("path", F.lit("0a").alias("hash"))
    path, other = f"{tmp_path}/map.json", f"{tmp_path}/one.json"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        json_sink.write_map(entries, hashes, path, "/r", "T")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    documents.write_document(documents.map_document(entries, hashes, "/r", F.lit("T")), other)
    ours, theirs = json.load(open(path)), json.load(open(other))
    theirs["layers"] = {k: {**v, "files": sorted(v["files"])} for k, v in theirs["layers"].items()}
    assert ours == theirs and os.listdir(tmp_path) == sorted(os.listdir(tmp_path)) or set(os.listdir(tmp_path)) >= {"map.json", "one.json"}
    assert documents.order_of(documents.read_map(spark, path)).count() == 500
    # A job that fails leaves the old document and nothing beside it.
    bad = spark.range(3).select(F.lit("s").alias("section"), F.lit("list").alias("kind"), "id", F.lit("").alias("key"), F.when(F.col("id") == 2, F.raise_error(F.lit("no")).cast("string")).otherwise("1").alias("value"))
    with pytest.raises(Exception, match="no"):
        json_sink.write_pieces(bad.withColumnRenamed("id", "place"), path)
    assert json.load(open(path)) == ours and {x for x in os.listdir(tmp_path) if not x.startswith(".")} == {"map.json", "one.json"}
    begun = lifecycle.create(entries, "h", "T0")
    marks = spark.createDataFrame([('d "q"/f1', "f", 1, "T1", None)], "path string, name string, seq long, at string, summary string")
    json_sink.write_progress(lifecycle.exports_read(begun, marks), f"{tmp_path}/p.json")
    documents.write_document(documents.progress_document(lifecycle.exports_read(begun, marks)), other)
    assert json.load(open(f"{tmp_path}/p.json")) == json.load(open(other))
