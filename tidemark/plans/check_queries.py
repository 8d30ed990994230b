"""Queries on verification and progress. With their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import compare, parse, progress, verify
from tidemark.plans.log_queries import DDL
from tidemark.session import read_table

KEY = ["ns", "_id", "id_type"]
NOW_MS = 1_700_010_000_000


def _copies(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    source, target, ns_map = (read_table(spark, sf_dir, t) for t in ("source_docs", "target_docs", "ns_map"))
    return source, compare.to_source_ns(target, ns_map)


def _orders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders, and a perturbed copy: some removed, some with another price, some added."""
    orders = read_table(spark, sf_dir, "orders").select(F.lit("shop.orders").alias("ns"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    kept = orders.where("key % 97 <> 0").withColumn("price", F.when(F.col("key") % 101 == 0, F.col("price") + 1).otherwise(F.col("price")))
    extra = orders.where("key % 103 = 0").withColumn("key", F.col("key") + 1_000_000_000)
    return orders, kept.unionByName(extra)


def _order_pairs(spark, sf_dir) -> DataFrame:
    a, b = _orders(spark, sf_dir)
    return verify.paired(a, b, ["ns", "key"], F.to_json(F.struct("price", "o_orderstatus")))


def verify_count(spark, sf_dir):
    """Documents of each namespace on both sides."""
    return verify.counts(*_copies(spark, sf_dir), ["ns"])


def verify_id(spark, sf_dir):
    """Missing, extra and common keys of each namespace."""
    return verify.report(verify.paired(*_copies(spark, sf_dir), KEY), ["ns"]).drop("content_mismatch")


def verify_missing(spark, sf_dir):
    """Keys missing on the target."""
    return verify.missing(verify.paired(*_copies(spark, sf_dir), KEY), KEY)


def verify_extra(spark, sf_dir):
    """Keys missing on the source."""
    return verify.extra(verify.paired(*_copies(spark, sf_dir), KEY), KEY)


def verify_full(spark, sf_dir):
    """Missing, extra and differing orders."""
    return verify.report(_order_pairs(spark, sf_dir), ["ns"])


def verify_samples(spark, sf_dir):
    """The first fifty findings."""
    return verify.samples(_order_pairs(spark, sf_dir), ["ns", "key"], ["ns"]).select("ns", "key", "kind", F.col("rank").cast("bigint").alias("rank"))


def verify_pass(spark, sf_dir):
    """Whether each namespace passes by keys."""
    return verify.report(verify.paired(*_copies(spark, sf_dir), KEY), ["ns"]).select("ns", "passed")


def verify_multi(spark, sf_dir):
    """Verdict and exit code over all namespaces, for the copies and for a copy of the copy."""
    source, target = _copies(spark, sf_dir)
    bad = verify.exit_code(verify.report(verify.paired(source, target, KEY), ["ns"])).withColumn("run", F.lit("copies"))
    good = verify.exit_code(verify.report(verify.paired(source, source, KEY), ["ns"])).withColumn("run", F.lit("itself"))
    return bad.unionByName(good).select("run", "namespaces", "passed", F.col("exit_code").cast("bigint").alias("exit_code"))


def deep_equal(spark, sf_dir):
    """Documents of both sides with equal content, whatever the order of their keys and the writing of their numbers."""
    source, target = _copies(spark, sf_dir)
    same = verify.exact_digest("doc", compare.IGNORED)
    a = source.select(*KEY, same.alias("a"))
    b = target.select(*KEY, same.alias("b")).groupBy(*KEY).agg(F.min("b").alias("b"))
    return a.join(b, KEY).groupBy("ns").agg(F.count("*").alias("compared"), F.count_if(F.col("a") == F.col("b")).alias("equal"))


def progress_counters(spark, sf_dir):
    """Rows of snapshot, log and schema changes of each namespace, and the last event time."""
    ddl = parse.log_ddl(read_table(spark, sf_dir, "oplog_entries")).where("collection is not null").select(F.concat_ws(".", "database", "collection").alias("ns"))
    return progress.counters(read_table(spark, sf_dir, "transfer_events"), ddl)


def _children(spark, sf_dir) -> DataFrame:
    """Namespaces with their counters, sizes and made-up states."""
    rows = progress.counters(read_table(spark, sf_dir, "transfer_events"))
    total = F.col("snapshot_rows") + F.length("ns") * 10
    state = F.when(F.length("ns") % 3 == 0, "RUNNING").when(F.length("ns") % 3 == 1, "CAN_COMMIT").otherwise("COMMITTED")
    return rows.select("ns", F.col("snapshot_rows").alias("done"), total.alias("total"), (F.col("last_ts_ms") - 1000).alias("started_ms"), "last_ts_ms", (F.length("ns") % 2 == 0).alias("full_done"), state.alias("state"), F.lit(True).alias("can_commit"))


def progress_percent(spark, sf_dir):
    """Whole percent and remaining documents."""
    done, total = F.col("done"), F.col("total")
    return _children(spark, sf_dir).select("ns", progress.percent(done, total, F.col("full_done")).alias("percent"), progress.remaining(done, total).cast("bigint").alias("remaining"))


def lag_ms(spark, sf_dir):
    """How far each namespace is behind a given time."""
    return progress.counters(read_table(spark, sf_dir, "transfer_events")).select("ns", progress.lag_ms(F.col("last_ts_ms"), F.lit(NOW_MS)).alias("lag_ms"))


def _gates(spark) -> DataFrame:
    rows = [
        (n, inc, received, idle, drained, lag, 10_000, full, pending, state)
        for n, (inc, received, idle, drained, lag, full, pending, state) in enumerate(
            [
                (False, None, 0, False, None, True, 0, "RUNNING"), (True, None, 0, True, None, True, 0, "RUNNING"), (True, 5, 20_000, True, 90_000, True, 0, "RUNNING"), (True, 5, 20_000, False, 90_000, True, 3, "RUNNING"),
                (True, 5, 10, True, 9_000, True, 0, "RUNNING"), (True, 5, 10, True, 11_000, True, 0, "RUNNING"), (True, 5, 10, True, 9_000, False, 0, "RUNNING"), (True, 5, 10, True, 9_000, True, 0, "ERROR"),
                (True, None, 0, True, None, False, 0, "IDLE"), (True, 5, 10, True, 9_000, True, 0, "PAUSED"), (True, 5, 10, True, 9_000, True, 0, "COMMITTING"),
            ]
        )
    ]
    return spark.createDataFrame(rows, "run int, incremental boolean, received bigint, idle_ms bigint, drained boolean, lag bigint, max_lag bigint, full_done boolean, pending bigint, state string")


def commit_gate(spark, sf_dir):
    """Whether the lag allows the cutover."""
    return _gates(spark).select("run", progress.lag_acceptable().alias("acceptable"))


def readiness(spark, sf_dir):
    """What a cutover waits for."""
    return _gates(spark).select("run", progress.readiness().alias("readiness"))


def phases(spark, sf_dir):
    """What each kind of migration does in each state."""
    rows = [(n, state, full, inc, done) for n, (state, full, inc, done) in enumerate((s, f, i, d) for s in progress.STATES for f, i, d in ((True, False, False), (True, True, False), (True, True, True), (False, True, False), (True, False, True)))]
    return spark.createDataFrame(rows, "run int, state string, full boolean, incremental boolean, full_done boolean").select("run", "state", progress.phase().alias("phase"))


def multi_progress(spark, sf_dir):
    """Progress over all namespaces."""
    return progress.roll_up(_children(spark, sf_dir)).select("namespaces", "done", F.col("total").cast("bigint").alias("total"), "started_ms", "last_ts_ms", "full_done")


def multi_state(spark, sf_dir):
    """State over all namespaces."""
    return progress.roll_up(_children(spark, sf_dir)).select("state")


def multi_can_commit(spark, sf_dir):
    """Whether all namespaces can be cut over; none at all can't."""
    rows = _children(spark, sf_dir)
    every, none = progress.roll_up(rows), progress.roll_up(rows.where("false"))
    return every.select(F.lit("every").alias("over"), "can_commit").unionByName(none.select(F.lit("none").alias("over"), "can_commit"))


def estimated_docs(spark, sf_dir):
    """Documents of each namespace."""
    return read_table(spark, sf_dir, "source_docs").groupBy("ns").agg(F.count("*").alias("docs"))


QUERIES = {
    f.__name__: f
    for f in (
        verify_count, verify_id, verify_missing, verify_extra, verify_full, verify_samples, verify_pass, verify_multi, deep_equal, progress_counters, progress_percent, lag_ms, commit_gate, readiness, phases,
        multi_progress, multi_state, multi_can_commit, estimated_docs,
    )
}

#: Keys of both copies, by the source's namespaces.
_KEYS = """
    s AS (SELECT DISTINCT ns, _id, id_type FROM source_docs),
    t AS (SELECT DISTINCT coalesce(source_ns, ns) AS ns, _id, id_type FROM target_docs LEFT JOIN ns_map ON target_ns = ns),
    p AS (SELECT coalesce(s.ns, t.ns) AS ns, coalesce(s._id, t._id) AS _id, coalesce(s.id_type, t.id_type) AS id_type, s.ns IS NOT NULL AS a, t.ns IS NOT NULL AS b FROM s FULL JOIN t ON s.ns = t.ns AND s._id = t._id AND s.id_type = t.id_type)"""
_IDS = f"{_KEYS}, r AS (SELECT ns, count(*) FILTER (a AND NOT b) AS missing_on_target, count(*) FILTER (b AND NOT a) AS missing_on_source, count(*) FILTER (a AND b) AS compared FROM p GROUP BY ns)"
_ORDERS = """
    x AS (SELECT o_orderkey AS key, o_totalprice AS price, o_orderstatus FROM orders),
    y AS (SELECT key, CASE WHEN key % 101 = 0 THEN price + 1 ELSE price END AS price, o_orderstatus FROM x WHERE key % 97 <> 0 UNION ALL SELECT key + 1000000000, price, o_orderstatus FROM x WHERE key % 103 = 0),
    p AS (SELECT coalesce(x.key, y.key) AS key, CASE WHEN y.key IS NULL THEN 'missingOnTarget' WHEN x.key IS NULL THEN 'missingOnSource' WHEN x.price <> y.price OR x.o_orderstatus <> y.o_orderstatus THEN 'contentMismatch' END AS kind, x.key IS NOT NULL AND y.key IS NOT NULL AS in_both FROM x FULL JOIN y ON x.key = y.key)"""
_CHILDREN = """
    c AS (SELECT ns, count(*) FILTER (op = 'r') AS done, count(*) FILTER (op = 'r') + length(ns) * 10 AS total, max(ts_ms) - 1000 AS started_ms, max(ts_ms) AS last_ts_ms, length(ns) % 2 = 0 AS full_done,
            CASE length(ns) % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'CAN_COMMIT' ELSE 'COMMITTED' END AS state FROM transfer_events GROUP BY ns)"""
#: The documents of both sides as sorted (path, type, value) lists; numbers as doubles.
_LEAVES = """
    RECURSIVE src AS (SELECT 's' AS side, ns, _id, id_type, doc FROM source_docs UNION ALL
      SELECT DISTINCT ON (1, 2, 3, 4) 't', coalesce(source_ns, ns), _id, id_type, doc FROM target_docs LEFT JOIN ns_map ON target_ns = ns),
    w AS (
      SELECT side, ns, _id, id_type, x.key AS path, json_type(x.value) AS kind, x.value AS v FROM src, json_each(doc) x WHERE x.key NOT IN ('_class', 'updatedAt')
      UNION ALL
      SELECT side, ns, _id, id_type, w.path || '/' || x.key, json_type(x.value), x.value FROM w, json_each(w.v) x WHERE w.kind IN ('OBJECT', 'ARRAY')),
    f AS (SELECT side, ns, _id, id_type, list_sort(list(path || '=' || CASE WHEN kind IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'N' || CAST(CAST(v AS DOUBLE) AS VARCHAR) WHEN kind IN ('OBJECT', 'ARRAY') THEN kind ELSE kind || CAST(v AS VARCHAR) END)) AS l FROM w GROUP BY ALL)"""

ORACLES = {
    "verify_count": """WITH a AS (SELECT ns, count(*) AS n FROM source_docs GROUP BY ns), b AS (SELECT coalesce(source_ns, ns) AS ns, count(*) AS n FROM target_docs LEFT JOIN ns_map ON target_ns = ns GROUP BY 1)
        SELECT coalesce(a.ns, b.ns) AS ns, coalesce(a.n, 0) AS source_count, coalesce(b.n, 0) AS target_count, coalesce(a.n, 0) = coalesce(b.n, 0) AS passed FROM a FULL JOIN b ON a.ns = b.ns""",
    "verify_id": f"WITH {_IDS} SELECT *, missing_on_target = 0 AND missing_on_source = 0 AS passed FROM r",
    "verify_missing": f"WITH {_KEYS} SELECT ns, _id, id_type FROM p WHERE a AND NOT b",
    "verify_extra": f"WITH {_KEYS} SELECT ns, _id, id_type FROM p WHERE b AND NOT a",
    "verify_full": f"""WITH {_ORDERS} SELECT 'shop.orders' AS ns, count(*) FILTER (kind = 'missingOnTarget') AS missing_on_target, count(*) FILTER (kind = 'missingOnSource') AS missing_on_source,
        count(*) FILTER (kind = 'contentMismatch') AS content_mismatch, count(*) FILTER (in_both) AS compared, count(kind) = 0 AS passed FROM p""",
    "verify_samples": f"WITH {_ORDERS}, n AS (SELECT 'shop.orders' AS ns, key, kind, row_number() OVER (ORDER BY key) AS rank FROM p WHERE kind IS NOT NULL) SELECT * FROM n WHERE rank <= 50",
    "verify_pass": f"WITH {_IDS} SELECT ns, missing_on_target = 0 AND missing_on_source = 0 AS passed FROM r",
    "verify_multi": f"""WITH {_IDS} SELECT 'copies' AS run, count(*) AS namespaces, bool_and(missing_on_target = 0 AND missing_on_source = 0) AS passed, CAST(CASE WHEN bool_and(missing_on_target = 0 AND missing_on_source = 0) THEN 0 ELSE 1 END AS BIGINT) AS exit_code FROM r
        UNION ALL SELECT 'itself', count(DISTINCT ns), TRUE, 0 FROM source_docs""",
    "deep_equal": f"WITH {_LEAVES} SELECT a.ns, count(*) AS compared, count(*) FILTER (a.l = b.l) AS equal FROM f a JOIN f b ON a.side = 's' AND b.side = 't' AND a.ns = b.ns AND a._id = b._id AND a.id_type = b.id_type GROUP BY a.ns",
    "progress_counters": f"""WITH {DDL}, d AS (SELECT database || '.' || collection AS ns, count(*) AS n FROM ddl WHERE collection IS NOT NULL GROUP BY 1),
        e AS (SELECT ns, count(*) FILTER (op = 'r') AS snapshot_rows, count(*) FILTER (op IN ('c', 'u', 'd')) AS log_rows, max(ts_ms) AS last_ts_ms FROM transfer_events GROUP BY ns)
        SELECT coalesce(e.ns, d.ns) AS ns, coalesce(snapshot_rows, 0) AS snapshot_rows, coalesce(log_rows, 0) AS log_rows, last_ts_ms, coalesce(n, 0) AS ddl_rows FROM e FULL JOIN d ON d.ns = e.ns""",
    "progress_percent": f"WITH {_CHILDREN} SELECT ns, CAST(CASE WHEN full_done THEN 100 ELSE least(greatest(done * 100 // total, 0), 100) END AS BIGINT) AS percent, CAST(greatest(total - done, 0) AS BIGINT) AS remaining FROM c",
    "lag_ms": f"SELECT ns, greatest({NOW_MS} - max(ts_ms), 0) AS lag_ms FROM transfer_events GROUP BY ns",
    "commit_gate": "SELECT * FROM (VALUES (0, TRUE), (1, FALSE), (2, TRUE), (3, FALSE), (4, TRUE), (5, FALSE), (6, TRUE), (7, TRUE), (8, FALSE), (9, TRUE), (10, TRUE)) t(run, acceptable)",
    "readiness": "SELECT * FROM (VALUES (0, 'READY'), (1, 'WAITING_FIRST_EVENT'), (2, 'READY'), (3, 'DRAINING: 3'), (4, 'READY'), (5, 'LAGGING: 11000 ms of 10000'), (6, 'WAITING_SNAPSHOT'), (7, 'NOT_RUNNING: ERROR'), (8, 'NOT_STARTED'), (9, 'PAUSED'), (10, 'COMMITTING')) t(run, readiness)",
    "phases": """WITH s AS (SELECT unnest(['ERROR', 'COMMITTING', 'PAUSED', 'RUNNING', 'CAN_COMMIT', 'COMMITTED', 'STOPPED', 'IDLE']) AS state, unnest(range(8)) AS n),
        k AS (SELECT * FROM (VALUES (0, 'INITIAL_COPY'), (1, 'INITIAL_COPY'), (2, 'CHANGE_EVENT_APPLY'), (3, 'CHANGE_EVENT_APPLY'), (4, 'RUNNING')) v(m, word))
        SELECT CAST(n * 5 + m AS INTEGER) AS run, state, CASE state WHEN 'IDLE' THEN 'NOT_STARTED' WHEN 'RUNNING' THEN word WHEN 'PAUSED' THEN 'PAUSED_' || word WHEN 'CAN_COMMIT' THEN 'READY_TO_COMMIT' ELSE state END AS phase FROM s, k""",
    "multi_progress": f"WITH {_CHILDREN} SELECT count(*) AS namespaces, CAST(sum(done) AS BIGINT) AS done, CAST(sum(total) AS BIGINT) AS total, min(started_ms) AS started_ms, max(last_ts_ms) AS last_ts_ms, bool_and(full_done) AS full_done FROM c",
    "multi_state": f"WITH {_CHILDREN} SELECT arg_min(state, CASE state WHEN 'RUNNING' THEN 4 WHEN 'CAN_COMMIT' THEN 5 ELSE 6 END) AS state FROM c",
    "multi_can_commit": "SELECT * FROM (VALUES ('every', TRUE), ('none', FALSE)) t(over, can_commit)",
    "estimated_docs": "SELECT ns, count(*) AS docs FROM source_docs GROUP BY ns",
}
