"""Whole runs: snapshot and log of all namespaces to one table, and verification with an exit code."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import compare, fold, namespace, parse, verify
from tidemark.operators.mor_table import MorTable
from tidemark.runtime.config import ErrorCode, MigrationError, SyncConfig
from tidemark.session import materialise
from tidemark.sources.feeds import history_lost, snapshot_events
from tidemark.streaming.apply import each_batch, entries_to_events, put_aside, run_with_retry


class Sync:
    """Namespaces that the rules accept go to the target under their mapped names: the snapshot first, then the log from before it on.

    All namespaces are one feed, so there is one stream and one table for them all. Snapshot rows sort before the log,
    so the log may begin before the snapshot was read.

    Schema changes are a barrier within a batch: drops of collections and databases undo what stands below them, on the
    target and in the batch; at a rename the changes up to it are applied first, then the documents move, then the rest
    follows. Renames of namespaces without documents cost nothing.

    Under STRICT writes a create of a document that is there is a conflict, and updates of missing documents do nothing.
    FAIL applies what comes before the first conflict and ends the run with an error, SKIP leaves conflicting creates
    out, UPSERT lets them replace.

    Callbacks, all with DataFrames: ``on_ddl`` gets the schema changes of each batch, ``on_events`` its events before
    they are applied, ``on_conflict`` the creates that conflict. Changes that can't be applied go to the folder that the
    configuration names for dead letters.
    """

    def __init__(
        self,
        spark: SparkSession,
        config: SyncConfig,
        table: MorTable,
        on_snapshot_done: Callable[[], None] = lambda: None,
        on_ddl: Callable[[DataFrame], None] | None = None,
        on_events: Callable[[DataFrame, int], None] | None = None,
        on_conflict: Callable[[DataFrame], None] | None = None,
    ):
        self.spark, self.config, self.table = spark, config.validate(), table
        self._done, self._on_ddl, self._on_events, self._on_conflict = on_snapshot_done, on_ddl, on_events, on_conflict
        self._map = spark.createDataFrame(list(config.transform.items()), "source_ns string, target_ns string")

    def _rules(self, ns: str = "ns"):
        return namespace.accepted(ns, ";".join(self.config.white), ";".join(self.config.black))

    def _renamed(self, events: DataFrame) -> DataFrame:
        return namespace.map_namespaces(events, self._map).withColumn("ns", F.col("target_ns")).drop("target_ns", "target_db", "target_coll")

    def snapshot(self, docs: DataFrame, batch_ms: int, meanwhile: DataFrame | None = None) -> None:
        """Apply the snapshot (ns, _id, doc); a document without ``_id`` gets that of its row.

        ``meanwhile`` are schema changes logged since the read began: namespaces that they end aren't copied any further,
        as the log brings what is left of them.
        """
        if self.config.mode == "INCREMENTAL":
            raise MigrationError(ErrorCode.STATE, "an incremental run has no snapshot")
        docs = docs.where(self._rules())
        if meanwhile is not None:
            ended = namespace.endings(meanwhile, namespace.discover(docs)).select("ns").distinct()
            docs = docs.join(ended, "ns", "left_anti")
        rows = snapshot_events(docs, batch_ms)
        key = F.to_json(F.struct("_id"))
        self.table.apply(self._renamed(rows).select("ns", "op", key.alias("before_doc"), "after_doc", "phase", F.lit(0).cast("bigint").alias("ts_t"), F.lit(0).cast("bigint").alias("ts_i")))
        self._done()

    def check_history(self, log: DataFrame, starts: DataFrame) -> None:
        """Raise if the log no longer reaches back to a start position (shard, start_t, start_i); there is one row per shard."""
        lost = [r["shard"] for r in history_lost(log, starts).where("lost").select("shard").orderBy("shard").collect()]
        if lost:
            raise MigrationError(ErrorCode.HISTORY_LOST, f"the log of {', '.join(lost)} begins after the start position: take a new snapshot")

    def _is_stream(self, rows: DataFrame) -> bool:
        """Whether rows are change-stream messages rather than log entries; they must be what the configuration asks for."""
        found = "operation_type" in rows.columns
        if self.config.capture_mode != "AUTO" and found != (self.config.capture_mode == "CHANGE_STREAM"):
            raise MigrationError(ErrorCode.CAPTURE, f"these aren't rows of capture mode {self.config.capture_mode}")
        return found

    def _ddl(self, batch: DataFrame) -> DataFrame:
        """Schema changes of accepted namespaces, under their target names: (ddl_type, database, collection, target, ts_t, ts_i, ...)."""
        rows = parse.stream_ddl(batch) if self._is_stream(batch) else parse.log_ddl(batch)
        here = F.concat_ws(".", "database", "collection")
        rows = rows.withColumn("ns", here).where(F.when(F.col("collection").isNull(), ~namespace.is_system(F.concat(F.col("database"), F.lit(".x")))).otherwise(self._rules()))
        mapped = self._renamed(rows).withColumn("collection", F.when(F.col("collection").isNotNull(), parse.collection("ns"))).withColumn("database", F.when(F.col("collection").isNotNull(), parse.database("ns")).otherwise(F.col("database")))
        to = self._renamed(mapped.drop("ns").withColumn("ns", F.col("target"))) if self.config.transform else mapped.drop("ns").withColumn("ns", F.col("target"))
        return to.withColumn("target", F.col("ns")).drop("ns")

    def _events(self, batch: DataFrame) -> DataFrame:
        rows = batch.where(self._rules())
        return self._renamed(parse.stream_events(rows, 0) if self._is_stream(rows) else entries_to_events(rows))

    def apply_batch(self, batch: DataFrame, batch_id: int | None = None, stream: str = "") -> None:
        """Apply a batch of log entries or messages, with its schema changes in their place."""
        if self.config.mode == "FULL":
            raise MigrationError(ErrorCode.STATE, "a run of the snapshot only has no log")
        changes = materialise(self._ddl(batch), "schema-changes")
        if self._on_ddl is not None:
            self._on_ddl(changes)
        events = self._events(batch)
        if self.config.dead_letters:
            put_aside(events, self.config.dead_letters, batch_id or 0)
        if self._on_events is not None:
            self._on_events(events, batch_id or 0)
        drops = changes.where("ddl_type in ('DROP_COLLECTION', 'DROP_DATABASE')").select("database", "collection", "ts_t", "ts_i")
        drops = drops if drops.limit(1).count() else None
        moves = self._moves(changes, events)
        at = F.struct(F.col("ts_t").alias("t"), F.col("ts_i").alias("i"))
        low = None
        if moves or self.config.write_mode == "STRICT":
            events = materialise(events, "events")  # parsed once, read by each segment
        for t, i, source, target in moves:
            high = F.struct(F.lit(t).cast("bigint").alias("t"), F.lit(i).cast("bigint").alias("i"))
            self._write(events.where((at <= high) if low is None else (at <= high) & (at > low)), drops)
            self.table.rename(source, target, t, i)
            low = high
        self._write(events if low is None else events.where(at > low), drops, batch_id, stream)

    def _moves(self, changes: DataFrame, events: DataFrame) -> list[tuple]:
        """Renames in order, of those whose source or target has documents; they come to the driver, which applies them one by one."""
        renames = changes.where("ddl_type = 'RENAME_COLLECTION' and target is not null").select("ts_t", "ts_i", F.concat_ws(".", "database", "collection").alias("source"), "target").distinct()
        if not renames.limit(1).count():
            return []
        used = events.select("ns").unionByName(self.table.namespaces()).unionByName(renames.select(F.col("target").alias("ns")).intersect(renames.select("source"))).distinct()
        hit = renames.withColumn("ns", F.explode(F.array("source", "target"))).join(used, "ns", "left_semi").drop("ns").distinct()
        return [tuple(r) for r in hit.orderBy("ts_t", "ts_i", "source").collect()]

    def _write(self, events: DataFrame, drops: DataFrame | None, batch_id: int | None = None, stream: str = "") -> None:
        if self.config.write_mode == "STRICT":
            events = self._strict(events)
        self.table.apply(events, batch_id, stream, drops)

    def _strict(self, events: DataFrame) -> DataFrame:
        """The events that take effect under strict writes, given what the table holds; raises at a conflict under FAIL."""
        keyed = events.withColumn("_id", F.coalesce(F.get_json_object("before_doc", "$._id"), F.get_json_object("after_doc", "$._id"))).withColumn("seq", F.lit(0).cast("bigint")).where("_id is not null")
        there = self.table.read().select("ns", F.col("doc_key").alias("_id"), F.lit(True).alias("_there"))
        rows = fold.effective(keyed.join(there, ["ns", "_id"], "left"), self.config.on_conflict, "_there").drop("_there", "seq", "epoch")
        rows = materialise(rows, "strict")
        bad = rows.where("conflict")
        if self._on_conflict is not None:
            self._on_conflict(bad)
        if self.config.on_conflict == "FAIL":
            first = bad.agg(F.min(F.struct("phase", "ts_t", "ts_i", "ns", "_id")).alias("f")).first()["f"]
            if first is not None:
                before = F.struct("phase", "ts_t", "ts_i") < F.struct(F.lit(first["phase"]), F.lit(first["ts_t"]).cast("bigint"), F.lit(first["ts_i"]).cast("bigint"))
                self.table.apply(rows.where(before & F.col("effective")))
                raise MigrationError(ErrorCode.WRITE, f"duplicate key {first['_id']} in {first['ns']} at {first['ts_t']}:{first['ts_i']}")
        return rows.where("effective")

    def start(self, rows: DataFrame, checkpoint: str, available_now: bool = False, history: tuple[DataFrame, DataFrame] | None = None) -> StreamingQuery:
        """Apply log entries or change-stream messages as they come. ``history`` (log, starts) is checked first, as :meth:`check_history` does."""
        if history is not None:
            self.check_history(*history)
        return each_batch(rows, self.apply_batch, checkpoint, available_now)

    def run(self, rows: Callable[[], DataFrame], checkpoint: str, attempts: int = 10, base_ms: int = 1000, history: tuple[DataFrame, DataFrame] | None = None, **options) -> int:
        """Apply all there is, restarting after failures; conflicts and lost history end it at once. Returns the failures."""

        def fatal(e: Exception) -> bool:
            own = isinstance(e, MigrationError) and e.code in (ErrorCode.WRITE, ErrorCode.HISTORY_LOST, ErrorCode.CAPTURE, ErrorCode.STATE)
            return own or any(code.value in str(e) for code in (ErrorCode.WRITE, ErrorCode.HISTORY_LOST, ErrorCode.CAPTURE, ErrorCode.STATE))

        return run_with_retry(lambda: self.start(rows(), checkpoint, True, history), attempts, base_ms, fatal, **options)


def verify_copies(source: DataFrame, target: DataFrame, ns_map: DataFrame, config: SyncConfig, mode: str = "FULL") -> tuple[DataFrame, int]:
    """(report by namespace, exit code): COUNT, ID or FULL; 0 if every namespace passes, 1 if not, 2 if there is none."""
    rules = namespace.accepted("ns", ";".join(config.white), ";".join(config.black))
    a, b = source.where(rules), compare.to_source_ns(target, ns_map).where(rules)
    if mode == "COUNT":
        report = verify.counts(a, b, ["ns"])
    elif mode in ("ID", "FULL"):
        pairs = _pairs(a, b, config, mode)
        report = verify.report(pairs, ["ns"])
    else:
        raise ValueError(f"no such mode: {mode}")
    return report, verify.exit_code(report).first()["exit_code"]


def _pairs(a: DataFrame, b: DataFrame, config: SyncConfig, mode: str) -> DataFrame:
    content = verify.exact_digest("doc", tuple(config.ignore_fields)) if mode == "FULL" else None
    return verify.paired(a, b, ["ns", "_id", "id_type"], content, latest="copied_at" if "copied_at" in a.columns and "copied_at" in b.columns else None)


def verify_samples(source: DataFrame, target: DataFrame, ns_map: DataFrame, config: SyncConfig, mode: str = "FULL") -> DataFrame:
    """The first findings of each namespace, as many as the configuration says."""
    rules = namespace.accepted("ns", ";".join(config.white), ";".join(config.black))
    pairs = _pairs(source.where(rules), compare.to_source_ns(target, ns_map).where(rules), config, mode)
    return verify.samples(pairs, ["ns", "_id", "id_type"], ["ns"], config.verify_samples)


def main(arguments: list[str]) -> int:
    """``python -m tidemark.runtime.sync SOURCE TARGET NS_MAP MODE [--key=value ...]``: verify two Parquet copies."""
    from tidemark.runtime.config import load
    from tidemark.session import build_session

    places, options = [a for a in arguments if not a.startswith("--")], [a for a in arguments if a.startswith("--")]
    if len(places) != 4:
        print(main.__doc__, file=sys.stderr)
        return 2
    spark = build_session()
    config, tables = load("", options), [spark.read.parquet(p) for p in places[:3]]
    report, code = verify_copies(*tables, config, places[3])
    report.orderBy("ns").show(1000, False)
    if code == 1 and places[3] != "COUNT":
        verify_samples(*tables, config, places[3]).show(config.verify_samples, False)
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
