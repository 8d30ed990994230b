"""Streams over folders of captured files: log entries and change-stream messages, in Parquet or JSON lines.

Spark's own file source does the reading, so any file system that the cluster reaches will do. Its checkpoint holds the
files that were read, not the last name, so a file that lands late under an earlier name is read by the next batch. How
much a batch takes is bounded by files or bytes: what lands faster than it is applied waits in the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.parse import stream_op
from tidemark.sources.feeds import log_window, stream_after

ENTRIES = "entry_id bigint, shard string, ts struct<t:bigint,i:bigint>, v int, op string, ns string, o string, o2 string, wall timestamp_ntz, from_migrate boolean, landed_at timestamp_ntz"
MESSAGES = (
    "delivery_id bigint, shard string, batch_no int, _id string, operation_type string, ns string, document_key string, full_document string, updated_fields string, removed_fields array<string>, "
    "cluster_time struct<t:bigint,i:bigint>, wall_time timestamp_ntz, landed_at timestamp_ntz"
)


def _stream(spark: SparkSession, folder: str, schema: str, kind: str, max_files: int | None, max_bytes: str | None, pattern: str | None) -> DataFrame:
    # a late file may be of any age
    reader = spark.readStream.schema(schema).option("maxFileAge", "36500d")
    for name, value in (("maxFilesPerTrigger", max_files), ("maxBytesPerTrigger", max_bytes), ("pathGlobFilter", pattern)):
        if value is not None:
            reader = reader.option(name, value)
    return reader.format(kind).load(folder)


def log_stream(spark: SparkSession, folder: str, kind: str = "parquet", max_files: int | None = None, max_bytes: str | None = None, after: tuple[int, int] | None = None, pattern: str | None = None) -> DataFrame:
    """Log entries as files land; with ``after``, those after a position. ``kind`` is parquet or json."""
    rows = _stream(spark, folder, ENTRIES, kind, max_files, max_bytes, pattern)
    return rows if after is None else log_window(rows, after, (1 << 62, 0))


def message_stream(spark: SparkSession, folder: str, kind: str = "parquet", max_files: int | None = None, max_bytes: str | None = None, token: str | None = None, operation_time: tuple[int, int] | None = None, where: str | None = None, pattern: str | None = None) -> DataFrame:
    """Change-stream messages as files land: after a resume token, else from an operation time, else all; ``where`` is a user's predicate.

    Messages that change the schema are part of it; an invalidate ends a change stream, so what it says comes as a DDL
    before it and it is left out.
    """
    rows = _stream(spark, folder, MESSAGES, kind, max_files, max_bytes, pattern).where(F.lower("operation_type") != "invalidate")
    if token is not None or operation_time is not None:
        rows = stream_after(rows, token, operation_time)
    return rows if where is None else rows.where(stream_op().isNull() | F.expr(where))


def start_position(before_snapshot: str | None, stored: str | None, configured: str | None, latest: str | None) -> str | None:
    """Where to begin: while a snapshot is being read the position taken before it, else the stored one, else the one asked for, else the latest."""
    return before_snapshot or stored or configured or latest
