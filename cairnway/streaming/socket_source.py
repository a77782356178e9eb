"""Tool events from a Unix socket as a streaming source with replayable offsets.

``spark.readStream.format("tool_socket").option("socket", path).option("log", folder)``.  The source listens on the socket; a client sends one JSON object a
line, ``{"id", "tool", "params"}``, and gets one line back.  An event is appended to a log, and the log is synced, before its answer goes out; an
offset is a position in that log.  So a query that is stopped and started again from its checkpoint neither loses nor repeats an
answered event, and what a finished batch has read is deleted from the log, a segment at a time.

Defined results: ``id`` is the position in the log, ``request`` the client's number (null if it is none), ``tool``, ``params`` as JSON text; an unknown
tool is answered with an error and not logged; a line that is no JSON object is passed over; a connection that holds more than
``MOST_BYTES`` without a line's end is closed.  ``log`` is a folder that the driver and all executors see under one name.
"""

from __future__ import annotations

import hashlib
import json
import os
import socket
import tempfile
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Bytes of an unfinished line that a connection may hold (fixed value).
MOST_BYTES = 1 << 20
#: Tools that a client may call (fixed values).
TOOLS = frozenset(
    "highlight_range clear_highlights open_file mark_read mark_flagged set_codelens show_blast_radius clear_blast_radius update_progress_tree clear_all "
    "get_next_briefing get_read_status get_flagged_files complete_file mark_export_read".split()
)
#: Events of one segment of the log, and of one batch.
SEGMENT, BATCH = 10_000, 50_000
SCHEMA = "id long, request long, tool string, params string"


def socket_path(root: str) -> str:
    """The socket of a workspace: named by the first 16 hex digits of the SHA-256 of its real path."""
    key = hashlib.sha256(os.path.realpath(root).rstrip("/").encode()).hexdigest()[:16]
    return os.path.join(tempfile.gettempdir(), f"cairnway-{key}.sock")


class EventLog:
    """Numbered lines in segment files, named by the number of their first line."""

    def __init__(self, folder: str, segment: int = SEGMENT):
        self.folder, self.segment = folder, segment
        self.tail: tuple[int, int, int] | None = None  # first line, lines and bytes of the last segment, known to the process that appends

    def _segments(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in os.listdir(self.folder) if n.endswith(".jsonl")) if os.path.isdir(self.folder) else []

    def _path(self, first: int) -> str:
        return os.path.join(self.folder, f"{first:020d}.jsonl")

    def _lines(self, first: int) -> list[bytes]:
        with open(self._path(first), "rb") as file:
            return [line for line in file.read().split(b"\n")[:-1]]  # what has no end yet was not answered

    def bounds(self) -> tuple[int, int]:
        """The first line that is kept, and the number of the next one."""
        segments = self._segments()
        return (segments[0], segments[-1] + len(self._lines(segments[-1]))) if segments else (0, 0)

    def append(self, line: str) -> int:
        os.makedirs(self.folder, exist_ok=True)
        if self.tail is None:
            segments = self._segments()
            held = self._lines(segments[-1]) if segments else []
            self.tail = segments[-1] if segments else 0, len(held), sum(map(len, held)) + len(held)
        first, count, size = self.tail
        if count >= self.segment:
            first, count, size = first + count, 0, 0
        data = line.encode() + b"\n"
        with open(self._path(first), "r+b" if os.path.exists(self._path(first)) else "wb") as file:
            file.truncate(file.seek(size))  # behind the last whole line
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        self.tail = first, count + 1, size + len(data)
        return first + count

    def read(self, start: int, end: int) -> Iterator[tuple[int, str]]:
        for first in self._segments():
            if first < end:
                for n, line in enumerate(self._lines(first), first):
                    if start <= n < end:
                        yield n, line.decode()

    def forget(self, before: int) -> None:
        """Deletes segments that end before a line; the last one stays, as it carries the numbers on."""
        segments = self._segments()
        for first, following in zip(segments, segments[1:], strict=False):
            if following <= before:
                os.remove(self._path(first))


class Listener:
    """Answers clients of one socket in threads of this process and logs their events."""

    def __init__(self, path: str, log: EventLog):
        self.log, self.lock = log, threading.Lock()
        if os.path.exists(path):  # left by a process that is gone
            os.remove(path)
        self.server = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
        self.server.bind(path)
        self.server.listen()
        threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self) -> None:
        while True:
            client, _ = self.server.accept()
            threading.Thread(target=self._serve, args=(client,), daemon=True).start()

    def _serve(self, client: socket.socket) -> None:
        held = b""
        with client:
            try:
                while chunk := client.recv(65_536):
                    held += chunk
                    *lines, held = held.split(b"\n")
                    for line in lines:
                        if (reply := self.answer(line)) is not None:
                            client.sendall(json.dumps(reply).encode() + b"\n")
                    if len(held) > MOST_BYTES:
                        return
            except OSError:  # the client is gone
                return

    def answer(self, line: bytes) -> dict | None:
        try:
            message = json.loads(line)
        except ValueError:
            return None
        if not isinstance(message, dict):
            return None
        request, tool = message.get("id"), message.get("tool")
        if tool not in TOOLS:
            return {"id": request, "error": f"Unknown tool: {tool}"}
        with self.lock:
            at = self.log.append(json.dumps({"request": request if isinstance(request, int) else None, "tool": tool, "params": json.dumps(message.get("params"))}))
        return {"id": request, "result": {"logged": at}}


_LISTENERS: dict[str, Listener] = {}


class SocketReader(SimpleDataSourceStreamReader):
    """Runs beside the driver; what is sent to executors is the log's folder only."""

    def __init__(self, path: str, folder: str):
        self.path, self.log = path, EventLog(folder)

    def _listen(self) -> None:
        if self.path not in _LISTENERS:
            _LISTENERS[self.path] = Listener(self.path, self.log)

    def initialOffset(self) -> dict:
        self._listen()
        return {"line": self.log.bounds()[0]}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self._listen()
        end = {"line": max(start["line"], min(self.log.bounds()[1], start["line"] + BATCH))}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = ((n, json.loads(line)) for n, line in self.log.read(start["line"], end["line"]))
        return iter([(n, e["request"], e["tool"], e["params"]) for n, e in rows])

    def commit(self, end: dict) -> None:
        self.log.forget(end["line"])


class SocketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tool_socket"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SocketReader:
        return SocketReader(self.options["socket"], self.options["log"])


def read_socket(spark: SparkSession, path: str, log: str) -> DataFrame:
    """``id, request, tool, params`` of the events that clients of the socket ``path`` send."""
    spark.dataSource.register(SocketSource)
    return spark.readStream.format("tool_socket").option("socket", path).option("log", log).load()
