"""State of a migration, its control over HTTP, and a facade for single writes."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from tidemark.operators.mor_table import MorTable
from tidemark.runtime.config import ErrorCode, MigrationError

#: Which state may follow which.
TRANSITIONS = {
    "IDLE": {"RUNNING", "STOPPED"},
    "RUNNING": {"PAUSED", "CAN_COMMIT", "COMMITTING", "STOPPED", "ERROR"},
    "PAUSED": {"RUNNING", "STOPPED", "ERROR"},
    "CAN_COMMIT": {"RUNNING", "PAUSED", "COMMITTING", "STOPPED", "ERROR"},
    "COMMITTING": {"COMMITTED", "ERROR"},
    "COMMITTED": set(),
    "STOPPED": {"RUNNING"},
    "ERROR": {"STOPPED"},
}


#: A word for people on each state.
PHASES = {
    "IDLE": "not started",
    "RUNNING": "catching up",
    "PAUSED": "paused",
    "CAN_COMMIT": "ready for the cutover",
    "COMMITTING": "committing",
    "COMMITTED": "committed",
    "STOPPED": "stopped",
    "ERROR": "failed",
}


class Migration:
    """Drives a stream through pause, resume and cutover. ``start`` gives a running StreamingQuery, from its checkpoint if there is one."""

    def __init__(self, start: Callable, ready: Callable[[], bool] = lambda: True, snapshot_done: Callable[[], bool] = lambda: True):
        self._start, self._ready, self._snapshot_done = start, ready, snapshot_done
        self._lock, self._query, self.state, self.error = threading.RLock(), None, "IDLE", None

    def _to(self, state: str) -> None:
        if state not in TRANSITIONS[self.state]:
            raise MigrationError(ErrorCode.STATE, f"{self.state} can't become {state}")
        self.state = state

    def start(self) -> None:
        with self._lock:
            self._to("RUNNING")
            self._query = self._start()

    def pause(self) -> None:
        with self._lock:
            self._to("PAUSED")
            self._query.stop()

    def resume(self) -> None:
        """Go on from the checkpoint: the snapshot isn't read again, and must have been read."""
        with self._lock:
            if not self._snapshot_done():
                raise MigrationError(ErrorCode.STATE, "the snapshot isn't complete yet")
            self._to("RUNNING")
            self._query = self._start()

    def can_commit(self) -> bool:
        """Derived from the counters on every call."""
        with self._lock:
            if self.state in ("RUNNING", "CAN_COMMIT"):
                self.state = "CAN_COMMIT" if self._ready() else "RUNNING"
            return self.state == "CAN_COMMIT"

    def commit(self) -> None:
        """Cutover: drain what is there, stop, mark committed."""
        with self._lock:
            if not self.can_commit():
                raise MigrationError(ErrorCode.STATE, "not ready for the cutover")
            self._to("COMMITTING")
            try:
                if self._query.isActive:
                    self._query.processAllAvailable()
                    self._query.stop()
                self._to("COMMITTED")
            except Exception as e:
                self.error, self.state = str(e), "ERROR"
                raise

    def stop(self) -> None:
        with self._lock:
            if self._query is not None and self._query.isActive:
                self._query.stop()
            self._to("STOPPED")

    def progress(self) -> dict:
        last = self._query.lastProgress if self._query is not None else None
        return {"state": self.state, "phase": PHASES[self.state], "canCommit": self.can_commit(), "error": self.error, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else None}


def each(migrations: dict[str, Migration], action: str) -> dict[str, str]:
    """Do something to every migration; returns the errors of those that failed, by name."""
    failed = {}
    for name, m in migrations.items():
        try:
            getattr(m, action)()
        except Exception as e:
            failed[name] = str(e)
    return failed


def serve(migration: Migration, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """GET /progress and /canCommit, POST /pause, /resume and /commit, all in JSON; 404, 405, 409 and 500 for errors."""
    reads = {"/progress": migration.progress, "/canCommit": lambda: {"canCommit": migration.can_commit()}}
    writes = {"/pause": migration.pause, "/resume": migration.resume, "/commit": migration.commit}

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, own: dict, other: dict) -> None:
            code, body = 200, None
            try:
                if self.path in own:
                    body = own[self.path]() or {"state": migration.state}
                else:
                    code, body = (405, {"error": "method not allowed"}) if self.path in other else (404, {"error": "not found"})
            except MigrationError as e:
                code, body = 409, {"error": str(e), "code": e.code.value}
            except Exception as e:
                code, body = 500, {"error": str(e)}
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer(reads, writes)

        def do_POST(self) -> None:
            self._answer(writes, reads)

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


class Writer:
    """Single writes and lists of them as batches of a table; for tests and small tools, not for volume.

    Its clock goes on from the largest position in the table, whoever wrote it, so its writes are the newest.
    """

    def __init__(self, spark: SparkSession, table: MorTable):
        self._spark, self._table, self._clock, self._version = spark, table, 0, -1

    def write(self, ns: str, events: list[tuple[str, dict | None, dict | None]]) -> int:
        """Apply (op, before, after) in order; returns how many."""
        rows = []
        if self._table._manifest()["version"] != self._version:
            self._clock = max(self._clock, self._table.clock())
        for op, before, after in events:
            self._clock += 1
            rows.append((ns, op, json.dumps(before) if before is not None else None, json.dumps(after) if after is not None else None, 1, self._clock, 1))
        if rows:
            self._table.apply(self._spark.createDataFrame(rows, "ns string, op string, before_doc string, after_doc string, phase int, ts_t bigint, ts_i bigint"))
            self._version = self._table._manifest()["version"]
        return len(rows)

    def insert(self, ns: str, doc: dict) -> int:
        return self.write(ns, [("c", None, doc)])

    def replace(self, ns: str, doc: dict) -> int:
        return self.write(ns, [("u", {"_id": doc["_id"]}, doc)])

    def update(self, ns: str, key, puts: dict | None = None, drops: list[str] = ()) -> int:
        patch = {**({"$set": puts} if puts else {}), **({"$unset": dict.fromkeys(drops, True)} if drops else {})}
        return self.write(ns, [("u", {"_id": key}, patch)]) if patch else 0

    def delete(self, ns: str, key) -> int:
        return self.write(ns, [("d", {"_id": key}, None)])
