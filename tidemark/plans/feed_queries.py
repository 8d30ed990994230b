"""Queries on the user feed: keyed state, writes, routing, and streams run to the end of what has landed. With their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.operators import fold, parse, progress, routing
from tidemark.operators.mor_table import MorTable
from tidemark.session import read_table, work_path
from tidemark.sources import feeds
from tidemark.streaming import apply, log_source


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.user_feed(read_table(spark, sf_dir, "events"))


def _fields() -> dict:
    click, view = F.col("event_type") == "click", F.col("event_type") == "view"
    none = F.lit(False)
    return {"value": (click, view), "k": (click | view, none), "event_type": (none, none)}


#: The feed in SQL.
E = """
    e AS (SELECT 'app.user' AS ns, CAST(user_id AS VARCHAR) AS _id,
                 CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
                 event_type IN ('click', 'view') AS is_patch, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type,
                 1 AS phase, CAST(floor(epoch(ts)) AS BIGINT) AS ts_t, event_id AS ts_i, event_id AS seq FROM events)"""
#: Fields after a fold over the rows of r.
FOLD = """
    l AS (SELECT ns, _id, arg_max(op, (ts_t, ts_i)) AS last_op FROM r GROUP BY ns, _id),
    v AS (SELECT ns, _id, arg_max({'x': CASE WHEN op = 'd' OR event_type = 'view' THEN NULL ELSE value END}, (ts_t, ts_i)) AS s FROM r GROUP BY ns, _id),
    kk AS (SELECT ns, _id, arg_max({'x': CASE WHEN op = 'd' THEN NULL ELSE k END}, (ts_t, ts_i)) AS s FROM r GROUP BY ns, _id),
    t AS (SELECT ns, _id, arg_max({'x': CASE WHEN op = 'd' THEN NULL ELSE event_type END}, (ts_t, ts_i)) AS s FROM r WHERE NOT is_patch GROUP BY ns, _id)
    SELECT l.ns, l._id, v.s.x AS value, kk.s.x AS k, t.s.x AS event_type
    FROM l LEFT JOIN v USING (ns, _id) LEFT JOIN kk USING (ns, _id) LEFT JOIN t USING (ns, _id) WHERE last_op <> 'd'"""
#: Epochs and first creates under strict writes.
STRICT = """
    ep AS (SELECT *, coalesce(sum(CASE WHEN op = 'd' THEN 1 ELSE 0 END) OVER (PARTITION BY ns, _id ORDER BY ts_t, ts_i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM e),
    fc AS (SELECT *, min(CASE WHEN op = 'c' THEN seq END) OVER (PARTITION BY ns, _id, epoch) AS first_c FROM ep),
    x AS (SELECT *, op = 'c' AND seq > first_c AS conflict, coalesce(first_c < seq, FALSE) AS created FROM fc)"""


def lww_upsert(spark, sf_dir):
    """Documents alive after the feed, when every update is a whole document."""
    return fold.latest(_feed(spark, sf_dir), ["event_type", "value", "k"])


def delete_apply(spark, sf_dir):
    """Keys whose last event is a delete."""
    last = _feed(spark, sf_dir).groupBy(*fold.KEY).agg(F.max_by("op", fold.position()).alias("op"), F.max("seq").alias("seq"))
    return last.where("op = 'd'").drop("op")


def patch_fold(spark, sf_dir):
    """Documents alive after the feed, patches applied field by field."""
    return fold.patch_fold(_feed(spark, sf_dir), _fields())


def strict_skip(spark, sf_dir):
    """Under strict writes, conflicting creates skipped."""
    return fold.strict(_feed(spark, sf_dir), _fields(), "SKIP")


def strict_upsert(spark, sf_dir):
    """Under strict writes, conflicting creates replace."""
    return fold.strict(_feed(spark, sf_dir), _fields(), "UPSERT")


def strict_fail_count(spark, sf_dir):
    """How many creates conflict, and where an ordered write would stop."""
    return fold.conflicts(_feed(spark, sf_dir))


def dup_keys(spark, sf_dir):
    """Conflicting creates by key."""
    return fold.duplicate_keys(_feed(spark, sf_dir))


def write_action(spark, sf_dir):
    """What an upserting and a strict sink do with each event."""
    return _feed(spark, sf_dir).select("seq", fold.write_action().alias("upsert_action"), fold.write_action(write_mode="STRICT").alias("strict_action"))


def write_counts(spark, sf_dir):
    """Counters of an upserting sink."""
    return fold.write_counts(_feed(spark, sf_dir))


def batch_counts(spark, sf_dir):
    """Write batches of a thousand events."""
    return fold.batches(_feed(spark, sf_dir))


def landed_watermark(spark, sf_dir):
    """Where the writes have landed, if every event from a purchase of user 7 on is pending."""
    return fold.landed_watermark(_feed(spark, sf_dir), (F.col("_id") == "7") & (F.col("event_type") == "purchase"))


def same_id_conflicts(spark, sf_dir):
    """Events whose key is in their write batch already."""
    return fold.same_id_conflicts(_feed(spark, sf_dir))


def pre_image(spark, sf_dir):
    """Each event with its key's value just before."""
    return fold.pre_image(_feed(spark, sf_dir), ["value", "event_type"]).select("seq", "_id", F.col("before.value").alias("value_before"), F.col("before.event_type").alias("type_before"))


def before_choice(spark, sf_dir):
    """The document before an update or delete: the pre-image, else the key."""
    rows = fold.pre_image(_feed(spark, sf_dir), ["event_type"]).where("op in ('u', 'd')")
    return rows.select("seq", F.coalesce(F.col("before.event_type"), F.concat(F.lit("key:"), "_id")).alias("before"))


def update_lookup(spark, sf_dir):
    """Patches with the current customer of their key, where there is one."""
    joined = feeds.update_lookup(_feed(spark, sf_dir).where("is_patch"), read_table(spark, sf_dir, "customer"), "_id", "c_custkey")
    return joined.select("seq", "_id", F.col("full.c_name").alias("c_name"), F.col("full.c_mktsegment").alias("c_mktsegment"))


def upsert_merge(spark, sf_dir):
    """Customers after the last event of each: a delete removes, others set the balance to the event's value."""
    last = _feed(spark, sf_dir).groupBy("_id").agg(F.max_by(F.struct("op", "value"), fold.position()).alias("l")).select("_id", "l.op", F.col("l.value").alias("balance"))
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("_id"), F.col("c_acctbal").alias("balance"))
    return fold.upsert(customers, last, ["_id"])


def snapshot_plus_incremental(spark, sf_dir):
    """Customers as a snapshot and their orders as the log: the last order's total, else the snapshot's balance."""
    snap = read_table(spark, sf_dir, "customer").select(F.lit("shop.customer").alias("ns"), F.col("c_custkey").cast("string").alias("_id"), F.lit("r").alias("op"), F.lit(0).alias("phase"), F.lit(0).cast("bigint").alias("ts_t"), F.lit(0).cast("bigint").alias("ts_i"), F.lit(0).cast("bigint").alias("seq"), F.col("c_acctbal").alias("amount"))
    orders = read_table(spark, sf_dir, "orders")
    log = orders.select(F.lit("shop.customer").alias("ns"), F.col("o_custkey").cast("string").alias("_id"), F.lit("u").alias("op"), F.lit(1).alias("phase"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts_t"), F.col("o_orderkey").alias("ts_i"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("amount"))
    return fold.latest(snap.unionByName(log), ["amount"])


def route_bucket(spark, sf_dir):
    """Bucket of each key among 16."""
    return _feed(spark, sf_dir).select("_id").distinct().select("_id", routing.java_hash("_id").alias("hash"), routing.bucket("_id", 16).alias("bucket"))


def route_unique(spark, sf_dir):
    """With a unique index, every key goes to bucket 0."""
    rows = read_table(spark, sf_dir, "source_docs").select("ns", "_id")
    return rows.select("ns", routing.bucket("_id", 16, F.col("ns").startswith("shop.")).alias("bucket")).groupBy("ns", "bucket").agg(F.count("*").alias("docs"))


def bucket_histogram(spark, sf_dir):
    """Events and keys by bucket."""
    rows = _feed(spark, sf_dir).groupBy("_id").agg(F.count("*").alias("n"))
    return rows.groupBy(routing.bucket("_id", 16).alias("bucket")).agg(F.sum("n").alias("events"), F.count("*").alias("keys"))


def pow2(spark, sf_dir):
    """Ring sizes for every part size."""
    return read_table(spark, sf_dir, "part").select("p_partkey", routing.next_power_of_two(F.col("p_partkey") * 7, 64).alias("ring"))


def catch_up_window(spark, sf_dir):
    """Events after the middle of the feed and up to its end, all of them applied."""
    feed = _feed(spark, sf_dir)
    last = feed.agg(F.max("seq")).first()[0] or 0  # the upper bound, fixed before the run
    return feed.where((F.col("seq") > last // 2) & (F.col("seq") <= last)).groupBy("op").agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def _landed(spark: SparkSession, sf_dir: str, files: int = 2) -> DataFrame:
    """The events as a stream over files that have landed, one file a batch."""
    events, path = read_table(spark, sf_dir, "events"), work_path(spark, "landed")
    events.repartition(files).write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_apply(spark, sf_dir):
    """The upserting fold as a stream: micro-batches applied to a table as they come, then the table."""
    table, kept = MorTable(spark, work_path(spark, "stream")), ["event_type", "value", "k", "ts_t", "ts_i"]
    whole = feeds.user_feed(_landed(spark, sf_dir)).select("ns", "op", F.to_json(F.struct("_id")).alias("before_doc"), F.when(F.col("op") != "d", F.to_json(F.struct("_id", *kept))).alias("after_doc"), "phase", "ts_t", "ts_i")
    apply.each_batch(whole, lambda batch, n, stream: table.apply(batch, n, stream), work_path(spark, "checkpoint")).awaitTermination()
    text = lambda name: F.regexp_replace(F.col("fields")[name], '^"|"$', "")
    return table.read().select("ns", F.col("doc_key").alias("_id"), text("event_type").alias("event_type"), text("value").cast("double").alias("value"), *(text(c).cast("bigint").alias(c) for c in ("k", "ts_t", "ts_i")))


def stream_state(spark, sf_dir):
    """Per key: how many events, and the last sequence, as a stateful stream keeps them over its batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", apply.ROCKSDB)
    out = work_path(spark, "states")
    updates = apply.keyed_state(_landed(spark, sf_dir), "user_id", "event_id")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", work_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(updates.schema).parquet(out).groupBy(F.col("key").alias("_id")).agg(F.max("events").alias("events"), F.max("last_seq").alias("last_seq"))


def message_tail(spark, sf_dir):
    """Change-stream messages after a resume token, read as a stream, as events by operation."""
    token = '{"_data": "826553f3b7000000012b0200add0b090a4c1a81b"}'
    table, path, out = read_table(spark, sf_dir, "change_stream"), work_path(spark, "landed"), work_path(spark, "tail")
    table.repartition(3).write.parquet(path)
    rows = log_source.message_stream(spark, path, max_files=1, token=token)

    def write(batch: DataFrame, n: int, stream: str) -> None:
        parse.stream_events(batch, 0).write.mode("overwrite").parquet(f"{out}/batch={n}")

    apply.each_batch(rows, write, work_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).groupBy("ns", "op").agg(F.count("*").alias("events"))


def start_offset(spark, sf_dir):
    """Where reading starts: the stored offset, else the position that the first run took before its snapshot, else the latest."""
    journal = read_table(spark, sf_dir, "sync_runs").where("capture_mode = 'OPLOG'")
    stored = journal.where("run_state = 'COMMITTED'").groupBy("shard").agg(F.max_by("end_offset", F.struct("logged_at", "run_id")).alias("stored"))
    first = journal.groupBy("shard").agg(F.min_by("start_offset", F.struct("logged_at", "run_id")).alias("before_snapshot"))
    bounds = feeds.log_bounds(read_table(spark, sf_dir, "oplog_entries"))
    return bounds.join(stored, "shard", "left").join(first, "shard", "left").select("shard", F.coalesce("stored", "before_snapshot", F.concat_ws(":", "last_t", "last_i")).alias("start"))


def offset_format(spark, sf_dir):
    """Positions as stored text, and read back."""
    from tidemark.functions.positions import offset_position

    text = F.concat_ws(":", "ts.t", "ts.i")
    return read_table(spark, sf_dir, "oplog_entries").select("entry_id", text.alias("offset"), offset_position(text).getField("t").alias("t"), offset_position(text).getField("i").alias("i"))


def retry_delays(spark, sf_dir):
    """Delays of ten retries."""
    return spark.range(10).select(F.col("id").alias("attempt"), progress.retry_delay_ms(F.col("id")).alias("delay_ms"))


def events_tumbling(spark, sf_dir):
    """Events by hour: added for users, the feed itself needs no windows."""
    rows = read_table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", "total")


def events_session(spark, sf_dir):
    """Sessions of a user, ended by an hour without events."""
    rows = read_table(spark, sf_dir, "events").groupBy(F.session_window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("events"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "events")


def id_intersect(spark, sf_dir):
    """Users that are customers."""
    return _feed(spark, sf_dir).select("_id").intersect(read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("_id")))


def id_except(spark, sf_dir):
    """Customers without events."""
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("_id")).exceptAll(_feed(spark, sf_dir).select("_id").distinct())


QUERIES = {
    f.__name__: f
    for f in (
        lww_upsert, delete_apply, patch_fold, strict_skip, strict_upsert, strict_fail_count, dup_keys, write_action, write_counts, batch_counts, landed_watermark, same_id_conflicts,
        pre_image, before_choice, update_lookup, upsert_merge, snapshot_plus_incremental, route_bucket, route_unique, bucket_histogram, pow2, catch_up_window, stream_apply, stream_state, message_tail,
        start_offset, offset_format, retry_delays, events_tumbling, events_session, id_intersect, id_except,
    )
}

_LWW = f"""WITH {E}, l AS (SELECT ns, _id, arg_max({{'op': op, 'event_type': event_type, 'value': value, 'k': k, 'ts_t': ts_t, 'ts_i': ts_i}}, (ts_t, ts_i)) AS l FROM e GROUP BY ns, _id)
        SELECT ns, _id, l.event_type AS event_type, l.value AS value, l.k AS k, l.ts_t AS ts_t, l.ts_i AS ts_i FROM l WHERE l.op <> 'd'"""
_HASH = """
    h AS (SELECT _id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(_id, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, x: (a * 31 + x) % 4294967296) AS u FROM (SELECT DISTINCT _id FROM ids)),
    b AS (SELECT _id, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS hash FROM h),
    buckets AS (SELECT _id, hash, ((hash % 16) + 16) % 16 AS bucket FROM b)"""

ORACLES = {
    "lww_upsert": _LWW,
    "stream_apply": _LWW,
    "delete_apply": f"WITH {E} SELECT ns, _id, max(seq) AS seq FROM e GROUP BY ns, _id HAVING arg_max(op, (ts_t, ts_i)) = 'd'",
    "patch_fold": f"WITH {E}, r AS (SELECT * FROM e), {FOLD}",
    "strict_skip": f"WITH {E}, {STRICT}, r AS (SELECT * FROM x WHERE op = 'd' OR (op = 'c' AND NOT conflict) OR (op = 'u' AND created)), {FOLD}",
    "strict_upsert": f"WITH {E}, {STRICT}, r AS (SELECT * FROM x WHERE op IN ('d', 'c') OR (op = 'u' AND created)), {FOLD}",
    "strict_fail_count": f"WITH {E}, {STRICT} SELECT ns, count(*) AS conflicts, min(seq) AS first_seq FROM x WHERE conflict GROUP BY ns",
    "dup_keys": f"WITH {E}, {STRICT} SELECT ns, _id, count(*) AS duplicates FROM x WHERE conflict GROUP BY ns, _id",
    "write_action": f"""WITH {E} SELECT seq, CASE WHEN op = 'd' THEN 'DELETE' WHEN is_patch THEN 'UPDATE_UPSERT' ELSE 'REPLACE_UPSERT' END AS upsert_action,
        CASE WHEN op = 'c' THEN 'INSERT' WHEN op = 'd' THEN 'DELETE' WHEN is_patch THEN 'UPDATE' ELSE 'REPLACE' END AS strict_action FROM e""",
    "write_counts": f"WITH {E} SELECT ns, count(*) FILTER (op = 'c' OR (op = 'u' AND NOT is_patch)) AS replaced, count(*) FILTER (op = 'u' AND is_patch) AS patched, count(*) FILTER (op = 'd') AS deleted, CAST(0 AS BIGINT) AS ignored FROM e GROUP BY ns",
    "batch_counts": f"WITH {E} SELECT ns, CAST(floor((seq - 1) / 1000.0) AS BIGINT) AS batch, count(*) AS rows FROM e GROUP BY ALL",
    "landed_watermark": f"WITH {E} SELECT ns, coalesce(min(seq) FILTER (_id = '7' AND event_type = 'purchase') - 1, max(seq)) AS landed FROM e GROUP BY ns",
    "same_id_conflicts": f"WITH {E} SELECT ns, CAST(floor((seq - 1) / 1000.0) AS BIGINT) AS batch, count(*) - count(DISTINCT _id) AS conflicts FROM e GROUP BY ALL HAVING count(*) > count(DISTINCT _id)",
    "pre_image": f"WITH {E} SELECT seq, _id, lag(value) OVER w AS value_before, lag(event_type) OVER w AS type_before FROM e WINDOW w AS (PARTITION BY ns, _id ORDER BY ts_t, ts_i)",
    "before_choice": f"WITH {E}, w AS (SELECT seq, op, _id, lag(event_type) OVER (PARTITION BY ns, _id ORDER BY ts_t, ts_i) AS b FROM e) SELECT seq, coalesce(b, 'key:' || _id) AS before FROM w WHERE op IN ('u', 'd')",
    "update_lookup": f"WITH {E} SELECT seq, _id, c_name, c_mktsegment FROM e LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = _id WHERE is_patch",
    "upsert_merge": f"""WITH {E}, l AS (SELECT _id, arg_max({{'op': op, 'value': value}}, (ts_t, ts_i)) AS l FROM e GROUP BY _id),
        c AS (SELECT CAST(c_custkey AS VARCHAR) AS _id, c_acctbal FROM customer)
        SELECT coalesce(c._id, l._id) AS _id, CASE WHEN l._id IS NULL THEN c_acctbal ELSE l.l.value END AS balance FROM c FULL JOIN l ON c._id = l._id WHERE l._id IS NULL OR l.l.op <> 'd'""",
    "snapshot_plus_incremental": """WITH a AS (
          SELECT CAST(c_custkey AS VARCHAR) AS _id, 0 AS phase, CAST(0 AS BIGINT) AS ts_t, CAST(0 AS BIGINT) AS ts_i, c_acctbal AS amount FROM customer UNION ALL
          SELECT CAST(o_custkey AS VARCHAR), 1, CAST(floor(epoch(o_orderdate)) AS BIGINT), o_orderkey, o_totalprice FROM orders),
        l AS (SELECT _id, arg_max({'amount': amount, 't': ts_t, 'i': ts_i}, (phase, ts_t, ts_i)) AS l FROM a GROUP BY _id)
        SELECT 'shop.customer' AS ns, _id, l.amount AS amount, l.t AS ts_t, l.i AS ts_i FROM l""",
    "route_bucket": f"WITH {E}, ids AS (SELECT _id FROM e), {_HASH} SELECT _id, hash, bucket FROM buckets",
    "route_unique": f"""WITH ids AS (SELECT _id FROM source_docs), {_HASH}
        SELECT ns, CASE WHEN ns LIKE 'shop.%' THEN CAST(0 AS BIGINT) ELSE bucket END AS bucket, count(*) AS docs FROM source_docs JOIN buckets USING (_id) GROUP BY ALL""",
    "bucket_histogram": f"WITH {E}, ids AS (SELECT _id FROM e), {_HASH}, n AS (SELECT _id, count(*) AS n FROM e GROUP BY _id) SELECT bucket, CAST(sum(n) AS BIGINT) AS events, count(*) AS keys FROM n JOIN buckets USING (_id) GROUP BY bucket",
    "pow2": "SELECT p_partkey, CASE WHEN p_partkey * 7 <= 64 THEN CAST(64 AS BIGINT) ELSE CAST(power(2, ceil(log2(CAST(p_partkey * 7 AS DOUBLE)))) AS BIGINT) END AS ring FROM part",
    "catch_up_window": f"WITH {E}, m AS (SELECT max(seq) AS last FROM e) SELECT op, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq FROM e, m WHERE seq > last // 2 AND seq <= last GROUP BY op",
    "stream_state": f"WITH {E} SELECT _id, count(*) AS events, max(seq) AS last_seq FROM e GROUP BY _id",
    "start_offset": """WITH b AS (SELECT shard, max(ts) AS last FROM oplog_entries GROUP BY shard),
        s AS (SELECT shard, arg_max(end_offset, (logged_at, run_id)) AS stored FROM sync_runs WHERE capture_mode = 'OPLOG' AND run_state = 'COMMITTED' GROUP BY shard),
        f AS (SELECT shard, arg_min(start_offset, (logged_at, run_id)) AS first FROM (SELECT * FROM sync_runs WHERE capture_mode = 'OPLOG' QUALIFY row_number() OVER (PARTITION BY shard ORDER BY logged_at, run_id) = 1) GROUP BY shard)
        SELECT shard, coalesce(stored, f.first, last.t || ':' || last.i) AS start FROM b LEFT JOIN s USING (shard) LEFT JOIN f USING (shard)""",
    "message_tail": """WITH p AS (SELECT *, coalesce(cluster_time.t * 4294967296 + cluster_time.i, CASE WHEN upper(hex) LIKE '82%' THEN CAST('0x' || substr(hex, 3, 8) AS BIGINT) * 4294967296 + CAST('0x' || substr(hex, 11, 8) AS BIGINT) END) AS pos
          FROM (SELECT *, CASE WHEN _id LIKE '{%' THEN json_extract_string(_id, '$._data') ELSE _id END AS hex FROM change_stream))
        SELECT ns, CASE operation_type WHEN 'insert' THEN 'c' WHEN 'delete' THEN 'd' ELSE 'u' END AS op, count(*) AS events FROM p
        WHERE operation_type IN ('insert', 'update', 'replace', 'delete') AND pos > CAST('0x6553f3b7' AS BIGINT) * 4294967296 + 1 GROUP BY ALL""",
    "offset_format": "SELECT entry_id, ts.t || ':' || ts.i AS offset, ts.t AS t, ts.i AS i FROM oplog_entries",
    "retry_delays": "SELECT CAST(i AS BIGINT) AS attempt, CAST(1000 * power(2, i) AS BIGINT) AS delay_ms FROM range(10) r(i)",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_session": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
        SELECT user_id, min(ts) AS started, count(*) AS events FROM s GROUP BY user_id, no""",
    "id_intersect": f"WITH {E} SELECT _id FROM e INTERSECT SELECT CAST(c_custkey AS VARCHAR) FROM customer",
    "id_except": f"WITH {E} SELECT CAST(c_custkey AS VARCHAR) AS _id FROM customer EXCEPT SELECT _id FROM e",
}
