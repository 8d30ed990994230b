"""Progress of a migration, and whether it may be cut over. Pure expressions; the time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: States of a migration; of several, the first in this order counts.
STATES = ("ERROR", "COMMITTING", "PAUSED", "RUNNING", "CAN_COMMIT", "COMMITTED", "STOPPED", "IDLE")


def counters(events: DataFrame, ddl: DataFrame | None = None) -> DataFrame:
    """(ns, snapshot_rows, log_rows, last_ts_ms), and with schema changes (ns) also ddl_rows, of each namespace."""
    rows = events.select("ns", "op", "ts_ms")
    if ddl is not None:
        rows = rows.unionByName(ddl.select("ns", F.lit("ddl").alias("op"), F.lit(None).cast("bigint").alias("ts_ms")))
    counts = [F.count_if(F.col("op") == "r").alias("snapshot_rows"), F.count_if(F.col("op").isin("c", "u", "d")).alias("log_rows"), F.max("ts_ms").alias("last_ts_ms")]
    if ddl is not None:
        counts.append(F.count_if(F.col("op") == "ddl").alias("ddl_rows"))
    return rows.groupBy("ns").agg(*counts)


def percent(done: Column, total: Column, complete: Column) -> Column:
    """Whole percent, between 0 and 100; 100 once complete."""
    part = F.when(total > 0, F.floor(done * 100 / total)).otherwise(0)
    return F.when(complete, F.lit(100).cast("bigint")).otherwise(F.least(F.greatest(part, F.lit(0)), F.lit(100)).cast("bigint"))


def remaining(done: Column, total: Column) -> Column:
    return F.greatest(total - done, F.lit(0))


def lag_ms(last_event: Column, now: Column) -> Column:
    """Milliseconds behind; null before the first event."""
    return F.when(last_event.isNotNull(), F.greatest(now - last_event, F.lit(0)))


def lag_acceptable() -> Column:
    """From columns incremental, received (ms, null before the first), idle_ms, drained, lag, max_lag."""
    return (
        F.when(~F.col("incremental"), True)
        .when(F.col("received").isNull(), False)
        .when((F.col("idle_ms") >= F.col("max_lag")) & F.col("drained"), True)
        .otherwise(F.coalesce(F.col("lag") <= F.col("max_lag"), F.lit(False)))
    )


def readiness() -> Column:
    """Why a migration can't be cut over yet, or READY. Columns as lag_acceptable, and full_done, pending, state. What is counted is in the text."""
    ms = F.coalesce(F.col("lag").cast("string"), F.lit("unknown"))
    return (
        F.when(F.col("state").isin("ERROR", "STOPPED", "COMMITTED"), F.concat(F.lit("NOT_RUNNING: "), "state"))
        .when(F.col("state") == "IDLE", "NOT_STARTED")
        .when(F.col("state").isin("PAUSED", "COMMITTING"), F.col("state"))
        .when(~F.col("full_done"), "WAITING_SNAPSHOT")
        .when(F.col("incremental") & F.col("received").isNull(), "WAITING_FIRST_EVENT")
        .when(F.col("pending") > 0, F.concat(F.lit("DRAINING: "), F.col("pending").cast("string")))
        .when(~lag_acceptable(), F.concat(F.lit("LAGGING: "), ms, F.lit(" ms of "), F.col("max_lag").cast("string")))
        .otherwise("READY")
    )


def phase() -> Column:
    """What a migration is doing, from columns state, full (it copies), incremental (it follows the log) and full_done. Fixed values."""
    copying = F.col("full") & ~F.col("full_done")
    return (
        F.when(F.col("state") == "IDLE", "NOT_STARTED")
        .when(F.col("state").isin("RUNNING", "PAUSED"), F.concat(F.when(F.col("state") == "PAUSED", "PAUSED_").otherwise(""), F.when(copying, "INITIAL_COPY").when(F.col("incremental"), "CHANGE_EVENT_APPLY").otherwise("RUNNING")))
        .when(F.col("state") == "CAN_COMMIT", "READY_TO_COMMIT")
        .when(F.col("state").isin("COMMITTING", "COMMITTED", "STOPPED", "ERROR"), F.col("state"))
        .otherwise("UNKNOWN")
    )


def state_rank(state: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), F.col(state) if isinstance(state, str) else state)


def roll_up(children: DataFrame) -> DataFrame:
    """One row over (done, total, started_ms, last_ts_ms, full_done, state, can_commit) of the namespaces.

    The state is the first in STATES, in whatever order the namespaces come.
    """
    return children.agg(
        F.count("*").alias("namespaces"),
        F.sum("done").alias("done"),
        F.sum("total").alias("total"),
        F.min("started_ms").alias("started_ms"),
        F.max("last_ts_ms").alias("last_ts_ms"),
        F.coalesce(F.bool_and("full_done"), F.lit(False)).alias("full_done"),
        F.min_by("state", state_rank("state")).alias("state"),
        (F.coalesce(F.bool_and("can_commit"), F.lit(False)) & (F.count("*") > 0)).alias("can_commit"),
    )


def retry_delay_ms(attempt: Column, base_ms: int = 1000) -> Column:
    """Delay before a retry: the base, doubled each time."""
    return (F.lit(base_ms) * F.pow(F.lit(2), attempt)).cast("bigint")
