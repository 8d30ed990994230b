"""Change feeds and snapshots as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.positions import token_hex, token_position

#: Order of changes: the snapshot before the log, then log position, then arrival.
ORDER = ["phase", "ts_t", "ts_i", "seq"]


def user_feed(events: DataFrame) -> DataFrame:
    """A change feed from the events table: (ns, _id, op, is_patch, value, k, event_type, phase, ts_t, ts_i, seq).

    signup creates, purchase replaces, click and view patch, error deletes. A click sets value and k, a view sets k and
    unsets value.
    """
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    return events.select(
        F.lit("app.user").alias("ns"),
        F.col("user_id").cast("string").alias("_id"),
        op.alias("op"),
        F.col("event_type").isin("click", "view").alias("is_patch"),
        "value",
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
        "event_type",
        F.lit(1).alias("phase"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_t"),
        F.col("event_id").alias("ts_i"),
        F.col("event_id").alias("seq"),
    )


def snapshot(df: DataFrame, ns: str, key: str) -> DataFrame:
    """Rows of a table as read events: (ns, _id, op = r, and the columns). No sort: the target doesn't depend on order."""
    return df.select(F.lit(ns).alias("ns"), F.col(key).cast("string").alias("_id"), F.lit("r").alias("op"), "*")


def snapshot_events(docs: DataFrame, batch_ms: int) -> DataFrame:
    """Snapshot documents in the event envelope; the time of the read is a parameter, so that a run can be repeated."""
    return docs.select(
        "ns",
        F.substring_index("ns", ".", 1).alias("source_db"),
        F.expr("substring(ns, instr(ns, '.') + 1)").alias("source_collection"),
        "_id",
        F.lit("r").alias("op"),
        F.lit(None).cast("string").alias("before_doc"),
        F.col("doc").alias("after_doc"),
        F.lit(batch_ms).cast("bigint").alias("cluster_time_ms"),
        F.lit(batch_ms).cast("bigint").alias("ts_ms"),
        F.lit(0).alias("phase"),
    )


#: Type numbers of ids that are ordered as numbers (double, int, long, decimal); others are ordered as text.
NUMERIC_IDS = (1, 16, 18, 19)


def id_order() -> Column:
    """What ids of one type are ordered by."""
    return F.struct(F.when(F.col("id_type").isin(*NUMERIC_IDS), F.col("_id").try_cast("decimal(38,10)")).alias("number"), F.col("_id").alias("text"))


def id_type_bounds(docs: DataFrame) -> DataFrame:
    """Least and greatest id, in the order of its type, and count, of each id type of each namespace."""
    return docs.groupBy("ns", "id_type").agg(F.min(id_order()).getField("text").alias("min_id"), F.max(id_order()).getField("text").alias("max_id"), F.count("*").alias("docs"))


#: Bounds and defaults of the number of documents in a range.
LEAST_RANGE, MOST_RANGE, DEFAULT_DOC_BYTES = 1024, 1_024_000, 1024


def range_doc_count(mb: int, avg_bytes: Column) -> Column:
    """Documents of an id range of ``mb`` megabytes, at least one, for documents of this average size."""
    size = F.when(avg_bytes > 0, avg_bytes).otherwise(DEFAULT_DOC_BYTES)
    return F.least(F.greatest(F.round(F.lit(max(1, mb) * 1048576.0) / size).cast("bigint"), F.lit(LEAST_RANGE)), F.lit(MOST_RANGE))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Number the rows of each group by order, from 1, without sending a group to one task.

    Rows are range-partitioned by group and order and numbered within partitions; the partitions' counts, one row for
    each partition and group, give the offsets.
    """
    from tidemark.session import materialise

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_part", F.shiftright("_at", 33)), "numbered")
    from pyspark.sql import Window

    counts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")
    counts = counts.withColumn("_before", before).drop("_n")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_part"]]
    joined = placed.alias("a").join(counts.alias("b"), same)
    return joined.select("a.*", (F.col("a._at") - F.col("b._first") + F.col("b._before") + 1).alias(name)).drop("_at", "_part")


def range_scan(docs: DataFrame, range_size: int) -> DataFrame:
    """Documents with the number of their id range (``piece``) of ``range_size`` documents; each range lies in one partition or in neighbouring ones."""
    rows = numbered(docs.withColumn("_order", id_order()), ["ns", "id_type"], ["_order"])
    return rows.withColumn("piece", F.floor((F.col("rn") - 1) / range_size)).drop("rn")


def id_ranges(docs: DataFrame, range_size: int) -> DataFrame:
    """Half-open id ranges of ``range_size`` documents of each namespace and id type; the last one is closed.

    (ns, id_type, piece, min_id, end_id, closed, docs)
    """
    from pyspark.sql import Window

    pieces = range_scan(docs.select("ns", "id_type", "_id"), range_size)
    bounds = pieces.groupBy("ns", "id_type", "piece").agg(F.min("_order").getField("text").alias("min_id"), F.max("_order").getField("text").alias("max_id"), F.count("*").alias("docs"))
    after = F.lead("min_id").over(Window.partitionBy("ns", "id_type").orderBy("piece"))
    return bounds.withColumn("next_id", after).select("ns", "id_type", "piece", "min_id", F.coalesce("next_id", "max_id").alias("end_id"), F.col("next_id").isNull().alias("closed"), "docs")


def range_predicate(min_id: str | None = None, end_id: str | None = None, closed: bool = False, id_type: int | None = None) -> Column:
    """The rows of an id range, in the order of the ids' type; with no bound at all, every row."""
    out, number = F.lit(True), id_type in NUMERIC_IDS
    own = F.col("_id").try_cast("decimal(38,10)") if number else F.col("_id")
    bound = lambda x: F.lit(x).cast("decimal(38,10)") if number else F.lit(x)
    if id_type is not None:
        out = out & (F.col("id_type") == id_type)
    if min_id is not None:
        out = out & (own >= bound(min_id))
    if end_id is not None:
        out = out & ((own <= bound(end_id)) if closed else (own < bound(end_id)))
    return out


def log_window(oplog: DataFrame, after: tuple[int, int], until: tuple[int, int]) -> DataFrame:
    """Entries after one position and up to another. Both bounds reach the scan through ``ts.t``."""
    t, i = F.col("ts.t"), F.col("ts.i")
    low = (t > after[0]) | ((t == after[0]) & (i > after[1]))
    high = (t < until[0]) | ((t == until[0]) & (i <= until[1]))
    return oplog.where((t >= after[0]) & (t <= until[0]) & low & high)


def watched_entries(oplog: DataFrame, ns: str, index_collection: bool = True) -> DataFrame:
    """Entries that can concern a namespace: its own, its database's commands, and old index builds."""
    db = ns.split(".", 1)[0]
    names = [ns, f"{db}.$cmd"] + ([f"{db}.system.indexes"] if index_collection else [])
    return oplog.where(F.col("ns").isin(names))


def log_bounds(oplog: DataFrame) -> DataFrame:
    """Earliest and latest position of each shard."""
    at = F.struct(F.col("ts.t").alias("t"), F.col("ts.i").alias("i"))
    return oplog.groupBy("shard").agg(F.min(at).alias("a"), F.max(at).alias("b")).select("shard", F.col("a.t").alias("first_t"), F.col("a.i").alias("first_i"), F.col("b.t").alias("last_t"), F.col("b.i").alias("last_i"))


def history_lost(oplog: DataFrame, starts: DataFrame) -> DataFrame:
    """(shard, start_t, start_i, lost): a start before the earliest entry has lost history; one at 0 asks for all there is."""
    bounds = log_bounds(oplog)
    early = (F.col("start_t") < F.col("first_t")) | ((F.col("start_t") == F.col("first_t")) & (F.col("start_i") < F.col("first_i")))
    return starts.join(bounds, "shard").select("shard", "start_t", "start_i", ((F.col("start_t") > 0) & early).alias("lost"))


def stream_after(changes: DataFrame, token: str | None = None, operation_time: tuple[int, int] | None = None) -> DataFrame:
    """Messages from a start on: after the position of a resume token; else from an operation time, inclusive; else all.

    A message without a cluster time has the position in its token, if that carries one, and is left out otherwise.
    """
    own = F.struct(F.col("cluster_time.t").alias("t"), F.col("cluster_time.i").alias("i"))
    at = F.when(F.col("cluster_time").isNotNull(), own).otherwise(token_position(token_hex(F.col("_id"))))
    rows = changes.withColumn("_at", at).where("_at is not null")
    if token is not None:
        rows = rows.where(F.col("_at") > token_position(token_hex(F.lit(token))))
    elif operation_time is not None:
        rows = rows.where(F.col("_at") >= F.struct(F.lit(operation_time[0]).cast("bigint").alias("t"), F.lit(operation_time[1]).cast("bigint").alias("i")))
    return rows.drop("_at")


def without_migrations(oplog: DataFrame) -> DataFrame:
    """Entries that a balancer wrote while moving data are not changes."""
    return oplog.where(~F.coalesce("from_migrate", F.lit(False)))


def update_lookup(events: DataFrame, current: DataFrame, key: str, current_key: str, mode: str = "UPDATE_LOOKUP") -> DataFrame:
    """Add ``full``, the current row of each event's key: DEFAULT adds null, REQUIRED fails where there is none."""
    if mode == "DEFAULT":
        return events.withColumn("full", F.lit(None).cast(current.schema.simpleString()))
    if mode not in ("UPDATE_LOOKUP", "WHEN_AVAILABLE", "REQUIRED"):
        raise ValueError(f"no such mode: {mode}")
    rows = current.select(F.col(current_key).cast("string").alias("_lookup"), F.struct("*").alias("full"))
    joined = events.join(rows, F.col(key) == F.col("_lookup"), "left").drop("_lookup")
    if mode == "REQUIRED":
        joined = joined.withColumn("full", F.when(F.col("full").isNotNull(), F.col("full")).otherwise(F.raise_error("no current document for an update")))
    return joined
