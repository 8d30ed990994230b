"""Applying a stream of changes to a merge-on-read table, and state kept by key.

The sink is idempotent: a micro-batch carries its stream's id and its own into the table's manifest, so a batch that is
replayed after a failure between the table's commit and the stream's checkpoint changes nothing, and another stream, or
the same one with a new checkpoint, isn't taken for a replay. The checkpoint is written after the sink, never before.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.operators import parse
from tidemark.operators.mor_table import MorTable, unusable
from tidemark.operators.progress import retry_delay_ms  # noqa: F401  the same rule as run_with_retry, for reports
from tidemark.sources.feeds import without_migrations
from tidemark.store import Store


def entries_to_events(entries: DataFrame) -> DataFrame:
    """Log entries in the event envelope, without those that a balancer wrote."""
    return parse.log_events(without_migrations(entries) if "from_migrate" in entries.columns else entries)


def stream_id(df: DataFrame, checkpoint: str) -> str:
    """The id that a checkpoint gives its stream; a new checkpoint is another stream."""
    return json.loads(Store(df.sparkSession, checkpoint).read("metadata"))["id"]


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int, str], None], checkpoint: str, available_now: bool = True, **trigger) -> StreamingQuery:
    """Start a stream that gives every micro-batch, kept in memory meanwhile, with its id and that of its stream."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            apply(batch, batch_id, stream_id(batch, checkpoint))
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(**trigger) if trigger else writer).start()


def put_aside(events: DataFrame, folder: str, batch_id: int) -> None:
    """Write the changes that can't be applied, with the reason, to a folder of dead letters; a replay writes them again."""
    events.withColumn("_error", unusable()).where("_error is not null").write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def start_apply(entries: DataFrame, table: MorTable, checkpoint: str, dead_letters: str | None = None, available_now: bool = True, on_events: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Apply log entries as they come. ``dead_letters`` is a folder for changes that can't be applied; ``on_events`` gets the events of each batch before they are applied."""

    def apply(batch: DataFrame, batch_id: int, stream: str) -> None:
        events = entries_to_events(batch)
        if dead_letters is not None:
            put_aside(events, dead_letters, batch_id)
        if on_events is not None:
            on_events(events, batch_id)
        table.apply(events, batch_id, stream)

    return each_batch(entries, apply, checkpoint, available_now, **trigger)


def run_with_retry(start: Callable[[], StreamingQuery], attempts: int = 10, base_ms: int = 1000, fatal: Callable[[Exception], bool] = lambda e: False, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run a stream to its end, restarting it from its checkpoint after failures; the pause doubles each time. Returns the failures."""
    failures = 0
    while True:
        try:
            start().awaitTermination()
            return failures
        except Exception as e:
            failures += 1
            if fatal(e) or failures > attempts:
                raise
            sleep(base_ms * 2 ** (failures - 1) / 1000)


class _KeyState(StatefulProcessor):
    """Per key: how many entries, and the greatest sequence."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "events bigint, last_seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        events, last = self._state.get() if self._state.exists() else (0, -1)
        for part in rows:
            events, last = events + len(part), max(last, int(part["seq"].max()))
        self._state.update((int(events), int(last)))
        yield pd.DataFrame({"key": [key[0]], "events": [int(events)], "last_seq": [int(last)]})

    def close(self) -> None:
        pass


#: Fixed value: the provider that keeps state on disk; without it state must fit in memory, and the function below needs it.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(stream: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, events, last_seq), updated by each micro-batch; the state lives in RocksDB, which the session must name as provider."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("bigint").alias("seq"))
    return rows.groupBy("key").transformWithStateInPandas(_KeyState(), "key string, events bigint, last_seq bigint", "Update", "None")
