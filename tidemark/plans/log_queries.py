"""Queries on logs, change streams and snapshots: sources, parsing, filters. With their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import transit
from tidemark.functions.positions import token_hex
from tidemark.operators import ddl, namespace, parse, routing, structure
from tidemark.operators.mor_table import MorTable
from tidemark.runtime.config import SyncConfig
from tidemark.runtime.sync import Sync
from tidemark.session import read_table, work_path
from tidemark.sources import capability, feeds

#: The namespace that single-namespace queries watch, and the time of a snapshot or batch.
WATCHED, BATCH_MS = "shop.order_line", 1_700_000_000_000


def _oplog(spark, sf_dir):
    return read_table(spark, sf_dir, "oplog_entries")


def _changes(spark, sf_dir):
    return read_table(spark, sf_dir, "change_stream")


def snapshot_scan(spark, sf_dir):
    """Customers as read events."""
    return feeds.snapshot(read_table(spark, sf_dir, "customer"), "shop.customer", "c_custkey").select("ns", "_id", "op", "c_name", "c_acctbal")


def snapshot_envelope(spark, sf_dir):
    """Source documents in the event envelope."""
    return feeds.snapshot_events(read_table(spark, sf_dir, "source_docs"), BATCH_MS).select("ns", "source_db", "source_collection", "_id", "op", "after_doc", "cluster_time_ms", "ts_ms", "phase")


def id_type_bounds(spark, sf_dir):
    """Id bounds of each namespace and id type."""
    return feeds.id_type_bounds(read_table(spark, sf_dir, "source_docs"))


def id_range_split(spark, sf_dir):
    """Id ranges of a hundred documents."""
    return feeds.id_ranges(read_table(spark, sf_dir, "source_docs"), 100)


def range_scan_counts(spark, sf_dir):
    """Documents that a parallel scan reads in each range."""
    scanned = feeds.range_scan(read_table(spark, sf_dir, "source_docs"), 100)
    return scanned.groupBy("ns", "id_type", "piece").agg(F.count("*").alias("docs"), F.sum(F.octet_length("doc")).alias("bytes"))


def range_doc_count(spark, sf_dir):
    """Documents of a 32 MB range, by average size."""
    sizes = read_table(spark, sf_dir, "source_docs").groupBy("ns").agg(F.avg(F.octet_length("doc")).alias("avg"))
    return sizes.select("ns", feeds.range_doc_count(32, F.col("avg")).alias("range_docs"))


def range_filter(spark, sf_dir):
    """Documents in half-open, closed and unbounded ranges."""
    docs = read_table(spark, sf_dir, "source_docs")
    half = feeds.range_predicate("100000", "100500", id_type=16)
    closed = feeds.range_predicate("100000", "100500", True, 16)
    return docs.agg(F.count_if(half).alias("half_open"), F.count_if(closed).alias("closed"), F.count_if(feeds.range_predicate()).alias("every"))


def oplog_window(spark, sf_dir):
    """Entries of a window, start exclusive and end inclusive."""
    return feeds.log_window(_oplog(spark, sf_dir), (1700000100, 1), (1700000900, 2)).select("entry_id", "shard", F.col("ts.t").alias("ts_t"), F.col("ts.i").alias("ts_i"))


def oplog_ns_filter(spark, sf_dir):
    """Entries that can concern one namespace."""
    return feeds.watched_entries(_oplog(spark, sf_dir), WATCHED).select("entry_id", "ns", "op")


def oplog_bounds(spark, sf_dir):
    """Earliest and latest position of each shard."""
    return feeds.log_bounds(_oplog(spark, sf_dir))


def history_lost(spark, sf_dir):
    """Which start positions lie before what the log still has."""
    at = F.array(*(F.struct(F.lit(t).cast("bigint").alias("start_t"), F.lit(i).cast("bigint").alias("start_i")) for t, i in ((0, 0), (1600000000, 1), (1700000500, 1))))
    starts = _oplog(spark, sf_dir).select("shard").distinct().select("shard", F.explode(at).alias("at")).select("shard", "at.*")
    return feeds.history_lost(_oplog(spark, sf_dir), starts)


RESUME = '{"_data": "826553f3b7000000012b0200add0b090a4c1a81b"}'


def cs_resume(spark, sf_dir):
    """Messages after a resume token, by operation."""
    return feeds.stream_after(_changes(spark, sf_dir), RESUME).groupBy("operation_type").agg(F.count("*").alias("messages"))


def cs_start_time(spark, sf_dir):
    """Messages from an operation time on, by operation."""
    return feeds.stream_after(_changes(spark, sf_dir), operation_time=(1700000695, 1)).groupBy("operation_type").agg(F.count("*").alias("messages"))


def skip_migrate(spark, sf_dir):
    """Entries by operation, without those that a balancer wrote."""
    return feeds.without_migrations(_oplog(spark, sf_dir)).groupBy("shard", "op").agg(F.count("*").alias("entries"))


def user_pipeline_filter(spark, sf_dir):
    """A user's predicate on messages."""
    rows = _changes(spark, sf_dir).where((F.col("operation_type") == "insert") & (F.get_json_object("full_document", "$.qty").try_cast("int") > 50))
    return rows.select("delivery_id", "ns")


def ns_discover(spark, sf_dir):
    """User namespaces of the snapshot and the log."""
    return namespace.discover(read_table(spark, sf_dir, "source_docs"), _oplog(spark, sf_dir).where("ns <> ''"))


def _hellos(spark):
    return spark.createDataFrame(
        [(1, "isdbgrid", None, None), (2, None, "rs0", ["a:1", "b:1"]), (3, None, "rs0", None), (4, None, None, ["a:1"]), (5, None, None, None), (6, "isdbgrid", "rs0", ["a:1"])],
        "server int, msg string, set_name string, hosts array<string>",
    )


def topology_classify(spark, sf_dir):
    """Topology from a server's hello."""
    return _hellos(spark).select("server", capability.topology().alias("topology"))


VERSIONS = ("3.2.22", "3.4.24", "3.6.0", "4.0.28", "4.4.0", "5.0.9", "6.0", "7.0.1", "v4.2.1-rc0", "")


def version_gates(spark, sf_dir):
    """What versions can do."""
    v = F.col("version")
    return spark.createDataFrame([(x,) for x in VERSIONS], "version string").select(
        "version", capability.version_part(v, 0).alias("major"), capability.version_part(v, 1).alias("minor"), capability.supports_oplog(v).alias("oplog"), capability.supports_change_stream(v).alias("change_stream"), capability.log_format(v).alias("log_format")
    )


def _requests(spark):
    rows = [(m, t, v, inc) for m in ("AUTO", "OPLOG", "CHANGE_STREAM") for t in ("STANDALONE", "REPLICA_SET", "SHARDING") for v in ("3.4.24", "4.4.0", "7.0.0") for inc in (True, False)]
    return spark.createDataFrame(rows, "requested string, topology string, version string, incremental boolean")


def capture_resolve(spark, sf_dir):
    """The capture mode, or why there is none."""
    return _requests(spark).select("*", capability.capture_mode().alias("resolved"))


def capture_validate(spark, sf_dir):
    """Which requests can be served."""
    return _requests(spark).select("*", capability.is_capable().alias("capable"))


def oplog_kind(spark, sf_dir):
    """Kind of each entry for one watched namespace."""
    return _oplog(spark, sf_dir).select("entry_id", parse.entry_kind(WATCHED).alias("kind"))


def oplog_crud(spark, sf_dir):
    """Change events of the log, by their keys and operators."""
    rows = parse.log_events(_oplog(spark, sf_dir))
    return rows.select("entry_id", "ns", "op", F.get_json_object("before_doc", "$._id").isNotNull().alias("has_before"), F.array_join(F.array_sort(F.json_object_keys("after_doc")), ",").alias("after_keys"), "ts_ms", "ts_t", "ts_i")


def strip_v(spark, sf_dir):
    """Keys of update payloads in operator form, without the version field."""
    rows = parse.log_events(_oplog(spark, sf_dir)).where("op = 'u'")
    return rows.select("entry_id", F.array_contains(F.json_object_keys("after_doc"), "$v").alias("has_v"), parse.is_patch("after_doc").alias("is_patch"))


def v1_index_normalize(spark, sf_dir):
    """Old index builds as commands."""
    rows = parse.index_command(_oplog(spark, sf_dir))
    spec = F.get_json_object("command", "$.indexes[0]")
    return rows.select("entry_id", F.get_json_object("command", "$.createIndexes").alias("coll"), F.get_json_object(spec, "$.name").alias("index_name"), F.get_json_object(spec, "$.key").alias("key"), F.array_join(F.array_sort(F.json_object_keys(spec)), ",").alias("options"))


def diff_normalize(spark, sf_dir):
    """Paths that each update of the log sets or unsets."""
    rows = parse.patch_operations(_oplog(spark, sf_dir).where("op = 'u' and o like '%\"diff\"%'"), "entry_id", "o")
    return rows.select("entry_id", "action", "path")


def op_normalize(spark, sf_dir):
    """Event operation of each message."""
    return _changes(spark, sf_dir).select("delivery_id", parse.stream_op().alias("op"))


def update_desc(spark, sf_dir):
    """Paths that each update message sets or unsets."""
    rows = _changes(spark, sf_dir).where("operation_type = 'update'").select("delivery_id", parse.update_payload().alias("payload"))
    return parse.patch_operations(rows.where("payload is not null"), "delivery_id", "payload").select("delivery_id", "action", "path")


def event_time(spark, sf_dir):
    """Event time of each message."""
    return _changes(spark, sf_dir).select("delivery_id", parse.event_time(BATCH_MS).alias("event_ms"))


def cs_ddl(spark, sf_dir):
    """Schema changes of the change stream, each as a command of the log's form."""
    return parse.stream_ddl(_changes(spark, sf_dir)).select("delivery_id", "ddl_type", "database", "collection", "command", "ts_t", "ts_i")


def oplog_ddl(spark, sf_dir):
    """Schema changes of the log."""
    return parse.log_ddl(_oplog(spark, sf_dir)).select("entry_id", "ddl_type", "database", "collection", "target", "index_name")


def transit_types(spark, sf_dir):
    """Tagged values of documents in the transit encoding."""
    doc = lambda path: parse.transit_value(F.get_json_object("doc", path))
    return read_table(spark, sf_dir, "source_docs").select("ns", "_id", "id_type", doc("$.made").alias("made"), doc("$.rate").alias("rate"), doc("$.owner").alias("owner"))


def ts_format(spark, sf_dir):
    """Positions as UTC times."""
    return _oplog(spark, sf_dir).select("entry_id", parse.position_text(F.col("ts.t")).alias("at"))


def extract_id(spark, sf_dir):
    """Key of each change event."""
    return read_table(spark, sf_dir, "transfer_events").select("seq", parse.extract_id().alias("doc_id"))


def token_digest(spark, sf_dir):
    """Tokens, twice and thrice as long, as a log line shows them."""
    token = F.concat("_id", "_id", "_id")
    return _changes(spark, sf_dir).select("delivery_id", parse.token_digest(token).alias("digest"), token_hex(F.col("_id")).alias("hex"))


def offset_path(spark, sf_dir):
    """Files of stored offsets."""
    rows = _oplog(spark, sf_dir).where("ns <> ''").select("ns", "shard").distinct()
    return rows.select("ns", "shard", parse.offset_file(F.col("ns"), F.col("shard"), "offset").alias("file"))


def progress_line(spark, sf_dir):
    """Runs as log lines."""
    rows = read_table(spark, sf_dir, "sync_runs").where("run_state <> 'RUNNING'").distinct()
    return rows.select("run_id", parse.log_line(run=F.col("run_id"), shard=F.col("shard"), state=F.col("run_state"), end=F.col("end_offset")).alias("line"))


def ns_system(spark, sf_dir):
    """Entries of system and of user namespaces."""
    return _oplog(spark, sf_dir).groupBy("ns").agg(F.count("*").alias("entries")).withColumn("is_system", namespace.is_system("ns"))


def ns_white(spark, sf_dir):
    """Namespaces that a white list keeps."""
    return read_table(spark, sf_dir, "source_docs").where(namespace.accepted("ns", white="shop; crm.visit ;;shop")).groupBy("ns").agg(F.count("*").alias("docs"))


def ns_black(spark, sf_dir):
    """Namespaces that a black list leaves."""
    return read_table(spark, sf_dir, "source_docs").where(namespace.accepted("ns", black="shop;crm.visit")).groupBy("ns").agg(F.count("*").alias("docs"))


def rule_parse(spark, sf_dir):
    """Rule lists, parsed."""
    rows = spark.createDataFrame([(1, " a ; b.c;;a;"), (2, ""), (3, "x.y"), (4, ";;")], "id int, rules string")
    return rows.select("id", F.array_join(namespace.parse_rules("rules"), "|").alias("parsed"), F.size(namespace.parse_rules("rules")).cast("bigint").alias("n"))


def ns_map(spark, sf_dir):
    """Target namespace of every source document."""
    mapped = namespace.map_namespaces(read_table(spark, sf_dir, "source_docs"), read_table(spark, sf_dir, "ns_map"))
    return mapped.groupBy("ns", "target_ns", "target_db", "target_coll").agg(F.count("*").alias("docs"))


def ns_invalidate(spark, sf_dir):
    """Namespaces that each schema change of the log ends: by a drop, a database's drop, or a rename from or to them."""
    oplog = _oplog(spark, sf_dir)
    return namespace.endings(parse.log_ddl(oplog), namespace.discover(oplog.where("ns <> ''"))).select("entry_id", "ddl_type", "ns")


def is_patch(spark, sf_dir):
    """Which updates are patches."""
    return read_table(spark, sf_dir, "transfer_events").where("op = 'u'").select("seq", parse.is_patch("after_doc").alias("is_patch"))


def index_plan(spark, sf_dir):
    """Indexes that some shard's log creates, without those that it drops and those that expire rows."""
    oplog = _oplog(spark, sf_dir)
    wanted = parse.index_specs(oplog).where("name is not null").select("ns", "name", F.col("expire_seconds").isNotNull().alias("expires"))
    dropped = parse.log_ddl(oplog).where("ddl_type = 'DROP_INDEXES'").select(F.concat_ws(".", "database", "collection").alias("ns"), F.col("index_name").alias("name"))
    return ddl.index_plan(wanted, dropped)


def index_specs(spark, sf_dir):
    """Indexes that the log creates, with their options."""
    return parse.index_specs(_oplog(spark, sf_dir)).select("entry_id", "ns", "name", "is_unique", "sparse", "expire_seconds", "hidden")


def structure_options(spark, sf_dir):
    """Collections that the log creates, with their options."""
    return structure.collections(_oplog(spark, sf_dir)).select("entry_id", "ns", "kind", "capped", "size", "expire_seconds", "view_on", F.col("collation.locale").alias("locale"), "options")


def bootstrap_plan(spark, sf_dir):
    """What a target, on which the change stream's collections and the log's dropped indexes exist, lacks of the log's structure."""
    oplog = _oplog(spark, sf_dir)
    there = parse.stream_ddl(_changes(spark, sf_dir)).where("ddl_type = 'CREATE_COLLECTION'").select(F.concat_ws(".", "database", "collection").alias("ns"))
    dropped = parse.log_ddl(oplog).where("ddl_type = 'DROP_INDEXES'").select(F.concat_ws(".", "database", "collection").alias("ns"), F.col("index_name").alias("name"))
    return structure.missing(structure.collections(oplog), parse.index_specs(oplog), there, dropped).select("step", "action", "ns", "name")


def transit_documents(spark, sf_dir):
    """Whole documents in the transit encoding."""
    rows = transit.transit_documents(read_table(spark, sf_dir, "source_docs").select("ns", "_id", "id_type", "doc"))
    field = lambda path: F.get_json_object("doc", path)
    return rows.select("ns", "_id", "id_type", field("$.made").alias("made"), field("$.rate").alias("rate"), field("$.owner").alias("owner"), field("$.ship.city").alias("city"), field("$.updatedAt").alias("updated"))


def has_unique(spark, sf_dir):
    """Whether each namespace gets a unique index, by the options of its indexes."""
    return routing.has_unique(parse.index_specs(_oplog(spark, sf_dir)))


def unique_timeline(spark, sf_dir):
    """Whether a namespace has a unique index after each schema change."""
    oplog = _oplog(spark, sf_dir)
    return routing.unique_timeline(parse.log_ddl(oplog), parse.index_specs(oplog)).select("entry_id", "ns", "unique_now")


def ddl_segments(spark, sf_dir):
    """Changes by the segment between schema changes of their namespace."""
    oplog = _oplog(spark, sf_dir)
    events = parse.log_events(oplog).select("ns", "ts_t", "ts_i", "entry_id")
    return ddl.segments(events, parse.log_ddl(oplog)).groupBy("ns", "segment").agg(F.count("*").alias("events"))


def drop_resets(spark, sf_dir):
    """Changes left after the drops and renames of the log: a drop undoes what came before it, and a rename empties its source."""
    oplog = _oplog(spark, sf_dir)
    rows = parse.log_ddl(oplog)
    drops = rows.where("ddl_type like 'DROP%'").unionByName(rows.where("ddl_type = 'RENAME_COLLECTION'").withColumn("ddl_type", F.lit("DROP_COLLECTION")))
    return ddl.drop_resets(parse.log_events(oplog).select("ns", "ts_t", "ts_i"), drops).groupBy("ns").agg(F.count("*").alias("events"))


def rename_chain(spark, sf_dir):
    """Where renamed collections end: customers in chains of five."""
    rows = read_table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("db.c"), F.col("c_custkey")).alias("source"), F.concat(F.lit("db.c"), F.col("c_custkey") + 1).alias("target"))
    return ddl.rename_chain(rows)


def log_renames(spark, sf_dir):
    """Where each collection that the log renames ends."""
    rows = parse.log_ddl(_oplog(spark, sf_dir)).where("ddl_type = 'RENAME_COLLECTION'")
    return ddl.rename_chain(rows.select(F.concat_ws(".", "database", "collection").alias("source"), "target"))


def ddl_apply_catalog(spark, sf_dir):
    """Schema changes of the log applied to the catalog, under databases of this run's own, as statements."""
    own = f"tm{uuid.uuid4().hex[:12]}_"
    rows = parse.log_ddl(_oplog(spark, sf_dir)).withColumn("database", F.concat(F.lit(own), "database")).withColumn("target", F.concat(F.lit(own), "target"))
    once = rows.groupBy("ddl_type", "database", "collection", "target").agg(F.min("ts_t").alias("ts_t"), F.min("ts_i").alias("ts_i"))
    try:
        done = ddl.apply_to_catalog(spark, once, work_path(spark, "warehouse"))
    finally:
        for r in once.select("database").distinct().collect():  # one row per database
            spark.sql(f"DROP DATABASE IF EXISTS `{r['database']}` CASCADE")
    done = [s.replace(own, "") for s in done if not s.startswith("CREATE DATABASE")]
    return spark.createDataFrame([(k, s) for k, s in enumerate(done)], "step int, statement string")


def sync_with_ddl(spark, sf_dir):
    """Documents of each namespace on the target after the log is applied, with its drops and renames in their place and without a balancer's writes."""
    table = MorTable(spark, work_path(spark, "sync"))
    Sync(spark, SyncConfig(), table).apply_batch(_oplog(spark, sf_dir))
    return table.read().groupBy("ns").agg(F.count("*").alias("docs"))


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_scan, snapshot_envelope, id_type_bounds, id_range_split, range_scan_counts, range_doc_count, range_filter, oplog_window, oplog_ns_filter, oplog_bounds, history_lost, cs_resume, cs_start_time, skip_migrate,
        user_pipeline_filter, ns_discover, topology_classify, version_gates, capture_resolve, capture_validate, oplog_kind, oplog_crud, strip_v, v1_index_normalize, diff_normalize, op_normalize,
        update_desc, event_time, cs_ddl, oplog_ddl, transit_types, ts_format, extract_id, token_digest, offset_path, progress_line, ns_system, ns_white, ns_black, rule_parse, ns_map, ns_invalidate,
        is_patch, index_plan, index_specs, structure_options, bootstrap_plan, transit_documents, has_unique, unique_timeline, ddl_segments, drop_resets, rename_chain, log_renames, ddl_apply_catalog, sync_with_ddl,
    )
}

_DB, _COLL = "split_part(ns, '.', 1)", "CASE WHEN position('.' IN ns) > 0 THEN substr(ns, position('.' IN ns) + 1) END"
#: Schema changes of the log.
DDL = f"""
    k AS (SELECT *, {_DB} AS db, json_keys(o)[1] AS key, op = 'i' AND ns LIKE '%.system.indexes' AND json_extract(o, '$._id') IS NULL AND split_part(json_extract_string(o, '$.ns'), '.', 1) = {_DB} AS ix FROM oplog_entries),
    m AS (SELECT *, CASE WHEN ix THEN 'CREATE_INDEXES' WHEN op <> 'c' THEN NULL ELSE CASE key WHEN 'create' THEN 'CREATE_COLLECTION' WHEN 'createIndexes' THEN 'CREATE_INDEXES' WHEN 'commitIndexBuild' THEN 'CREATE_INDEXES'
              WHEN 'dropIndexes' THEN 'DROP_INDEXES' WHEN 'drop' THEN 'DROP_COLLECTION' WHEN 'renameCollection' THEN 'RENAME_COLLECTION' WHEN 'dropDatabase' THEN 'DROP_DATABASE' END END AS ddl_type FROM k),
    ddl AS (SELECT entry_id, ddl_type, db AS database,
              CASE WHEN ix THEN split_part(json_extract_string(o, '$.ns'), '.', 2) WHEN key = 'dropDatabase' THEN NULL WHEN key = 'renameCollection' THEN split_part(json_extract_string(o, '$.renameCollection'), '.', 2)
                   ELSE json_extract_string(o, '$.' || key) END AS collection,
              json_extract_string(o, '$.to') AS target, coalesce(json_extract_string(o, '$.name'), json_extract_string(o, '$.index'), json_extract_string(o, '$.indexes[0].name')) AS index_name, ts.t AS ts_t, ts.i AS ts_i
            FROM m WHERE ddl_type IS NOT NULL)"""
#: Change events of the log.
CRUD = f"crud AS (SELECT * FROM oplog_entries WHERE op IN ('i', 'u', 'd') AND o IS NOT NULL AND NOT coalesce({_COLL} LIKE 'system.%', FALSE) AND position('.' IN ns) > 0)"
_DIFF = """
    RECURSIVE d AS (
      SELECT entry_id, CAST('' AS VARCHAR) AS prefix, json_extract(o, '$.diff') AS j FROM oplog_entries WHERE op = 'u' AND o LIKE '%"diff"%'
      UNION ALL
      SELECT d.entry_id, d.prefix || substr(x.key, 2) || '.', x.value FROM d, json_each(d.j) x WHERE x.key LIKE 's_%'),
    ops AS (
      SELECT entry_id, CASE WHEN x.key = 'd' THEN '$unset' ELSE '$set' END AS action, prefix || y.key AS path FROM d, json_each(d.j) x, json_each(x.value) y WHERE x.key IN ('d', 'i', 'u') AND json_type(x.value) = 'OBJECT'
      UNION ALL
      SELECT entry_id, '$set', prefix || substr(x.key, 2) FROM d, json_each(d.j) x WHERE regexp_matches(x.key, '^u[0-9]+$'))"""
_MATRIX = """
    q AS (SELECT requested, topology, version, incremental FROM (VALUES ('AUTO'), ('OPLOG'), ('CHANGE_STREAM')) a(requested), (VALUES ('STANDALONE'), ('REPLICA_SET'), ('SHARDING')) b(topology), (VALUES ('3.4.24'), ('4.4.0'), ('7.0.0')) c(version), (VALUES (TRUE), (FALSE)) d(incremental)),
    r AS (SELECT *, CASE
        WHEN incremental AND topology = 'STANDALONE' THEN 'ERROR: a standalone server has no change log'
        WHEN requested = 'AUTO' AND version <> '3.4.24' AND topology <> 'STANDALONE' THEN 'CHANGE_STREAM'
        WHEN requested = 'AUTO' AND incremental AND topology = 'SHARDING' THEN 'ERROR: a sharded source needs ChangeStream, from 3.6 on'
        WHEN requested = 'AUTO' THEN 'OPLOG'
        WHEN NOT incremental THEN requested
        WHEN requested = 'OPLOG' AND topology = 'SHARDING' THEN 'ERROR: multi-shard OPLOG isn''t supported'
        WHEN requested = 'OPLOG' AND version = '7.0.0' THEN 'ERROR: this version''s OPLOG can''t be read'
        WHEN requested = 'CHANGE_STREAM' AND version = '3.4.24' THEN 'ERROR: ChangeStream needs 3.6'
        ELSE requested END AS resolved FROM q)"""
_RANGES = """
    n AS (SELECT ns, id_type, _id, row_number() OVER (PARTITION BY ns, id_type ORDER BY CASE WHEN id_type IN (1, 16, 18, 19) THEN TRY_CAST(_id AS DECIMAL(38, 10)) END, _id) - 1 AS rn FROM source_docs),
    b AS (SELECT ns, id_type, rn // 100 AS piece, arg_min(_id, rn) AS min_id, arg_max(_id, rn) AS max_id, count(*) AS docs FROM n GROUP BY ALL),
    ranges AS (SELECT ns, id_type, CAST(piece AS BIGINT) AS piece, min_id, coalesce(lead(min_id) OVER w, max_id) AS end_id, lead(min_id) OVER w IS NULL AS closed, docs FROM b WINDOW w AS (PARTITION BY ns, id_type ORDER BY piece))"""
_HEX = "upper(CASE WHEN _id LIKE '{%' THEN json_extract_string(_id, '$._data') ELSE _id END)"
#: Messages with their position, from the cluster time or the token.
_AT = f"p AS (SELECT operation_type, coalesce(cluster_time.t * 4294967296 + cluster_time.i, CASE WHEN {_HEX} LIKE '82%' THEN CAST('0x' || substr({_HEX}, 3, 8) AS BIGINT) * 4294967296 + CAST('0x' || substr({_HEX}, 11, 8) AS BIGINT) END) AS pos FROM change_stream)"

ORACLES = {
    "snapshot_scan": "SELECT 'shop.customer' AS ns, CAST(c_custkey AS VARCHAR) AS _id, 'r' AS op, c_name, c_acctbal FROM customer",
    "snapshot_envelope": f"SELECT ns, {_DB} AS source_db, {_COLL} AS source_collection, _id, 'r' AS op, doc AS after_doc, CAST({BATCH_MS} AS BIGINT) AS cluster_time_ms, CAST({BATCH_MS} AS BIGINT) AS ts_ms, 0 AS phase FROM source_docs",
    "id_type_bounds": f"WITH {_RANGES} SELECT ns, id_type, arg_min(_id, rn) AS min_id, arg_max(_id, rn) AS max_id, count(*) AS docs FROM n GROUP BY ns, id_type",
    "id_range_split": f"WITH {_RANGES} SELECT * FROM ranges",
    "range_scan_counts": """WITH n AS (SELECT ns, id_type, doc, row_number() OVER (PARTITION BY ns, id_type ORDER BY CASE WHEN id_type IN (1, 16, 18, 19) THEN TRY_CAST(_id AS DECIMAL(38, 10)) END, _id) - 1 AS rn FROM source_docs)
        SELECT ns, id_type, CAST(rn // 100 AS BIGINT) AS piece, count(*) AS docs, CAST(sum(strlen(doc)) AS BIGINT) AS bytes FROM n GROUP BY ALL""",
    "range_doc_count": "SELECT ns, least(greatest(CAST(round(33554432.0 / avg(strlen(doc))) AS BIGINT), 1024), 1024000) AS range_docs FROM source_docs GROUP BY ns",
    "range_filter": "SELECT count(*) FILTER (id_type = 16 AND _id >= '100000' AND _id < '100500') AS half_open, count(*) FILTER (id_type = 16 AND _id >= '100000' AND _id <= '100500') AS closed, count(*) AS every FROM source_docs",
    "oplog_window": "SELECT entry_id, shard, ts.t AS ts_t, ts.i AS ts_i FROM oplog_entries WHERE (ts.t > 1700000100 OR (ts.t = 1700000100 AND ts.i > 1)) AND (ts.t < 1700000900 OR (ts.t = 1700000900 AND ts.i <= 2))",
    "oplog_ns_filter": "SELECT entry_id, ns, op FROM oplog_entries WHERE ns IN ('shop.order_line', 'shop.$cmd', 'shop.system.indexes')",
    "oplog_bounds": "SELECT shard, min(ts).t AS first_t, min(ts).i AS first_i, max(ts).t AS last_t, max(ts).i AS last_i FROM oplog_entries GROUP BY shard",
    "history_lost": """WITH b AS (SELECT shard, min(ts) AS a FROM oplog_entries GROUP BY shard)
        SELECT shard, CAST(t AS BIGINT) AS start_t, CAST(i AS BIGINT) AS start_i, t > 0 AND (t, i) < (a.t, a.i) AS lost FROM b, (VALUES (0, 0), (1600000000, 1), (1700000500, 1)) s(t, i)""",
    "cs_resume": f"WITH {_AT} SELECT operation_type, count(*) AS messages FROM p WHERE pos > 1700000695 * 4294967296 + 1 GROUP BY ALL",
    "cs_start_time": f"WITH {_AT} SELECT operation_type, count(*) AS messages FROM p WHERE pos >= 1700000695 * 4294967296 + 1 GROUP BY ALL",
    "skip_migrate": "SELECT shard, op, count(*) AS entries FROM oplog_entries WHERE NOT coalesce(from_migrate, FALSE) GROUP BY ALL",
    "user_pipeline_filter": "SELECT delivery_id, ns FROM change_stream WHERE operation_type = 'insert' AND TRY_CAST(json_extract_string(full_document, '$.qty') AS INTEGER) > 50",
    "ns_discover": f"""WITH a AS (SELECT ns FROM source_docs UNION SELECT ns FROM oplog_entries WHERE ns <> '')
        SELECT ns, {_DB} AS db, {_COLL} AS coll FROM a WHERE lower({_DB}) NOT IN ('admin', 'local', 'config') AND NOT coalesce({_COLL} LIKE 'system.%', FALSE) AND {_COLL} <> '$cmd'""",
    "topology_classify": "SELECT * FROM (VALUES (1, 'SHARDING'), (2, 'REPLICA_SET'), (3, 'REPLICA_SET'), (4, 'REPLICA_SET'), (5, 'STANDALONE'), (6, 'SHARDING')) t(server, topology)",
    "version_gates": """SELECT * FROM (VALUES ('3.2.22', 3, 2, TRUE, FALSE, 'V1'), ('3.4.24', 3, 4, TRUE, FALSE, 'V1'), ('3.6.0', 3, 6, TRUE, TRUE, 'V2'), ('4.0.28', 4, 0, TRUE, TRUE, 'V2'), ('4.4.0', 4, 4, TRUE, TRUE, 'V2'),
        ('5.0.9', 5, 0, TRUE, TRUE, 'V3'), ('6.0', 6, 0, TRUE, TRUE, 'V3'), ('7.0.1', 7, 0, FALSE, TRUE, NULL), ('v4.2.1-rc0', 4, 2, TRUE, TRUE, 'V2'), ('', 0, 0, TRUE, FALSE, 'V1')) t(version, major, minor, oplog, change_stream, log_format)""",
    "capture_resolve": f"WITH {_MATRIX} SELECT * FROM r",
    "capture_validate": f"WITH {_MATRIX} SELECT requested, topology, version, incremental, resolved NOT LIKE 'ERROR%' AS capable FROM r",
    "oplog_kind": f"""WITH {DDL} SELECT entry_id, CASE WHEN op IS NULL OR op = 'n' OR o IS NULL THEN 'SKIP' WHEN ix AND json_extract_string(o, '$.ns') = 'shop.order_line' THEN 'DDL'
        WHEN op IN ('i', 'u', 'd') AND ns = 'shop.order_line' THEN 'CRUD' WHEN op = 'c' AND db = 'shop' AND ddl_type IS NOT NULL THEN 'DDL' ELSE 'SKIP' END AS kind FROM m""",
    "oplog_crud": f"""WITH {_DIFF}, {CRUD}, dk AS (SELECT entry_id, string_agg(DISTINCT action, ',' ORDER BY action) AS keys FROM ops GROUP BY entry_id)
        SELECT c.entry_id, ns, CASE op WHEN 'i' THEN 'c' ELSE op END AS op,
          op <> 'i' AND json_extract(CASE op WHEN 'u' THEN o2 ELSE o END, '$._id') IS NOT NULL AS has_before,
          CASE WHEN op = 'd' THEN NULL WHEN op = 'u' AND dk.keys IS NOT NULL THEN dk.keys ELSE array_to_string(list_sort(list_filter(json_keys(o), lambda x: op = 'i' OR x <> '$v')), ',') END AS after_keys,
          ts.t * 1000 AS ts_ms, ts.t AS ts_t, ts.i AS ts_i FROM crud c LEFT JOIN dk ON dk.entry_id = c.entry_id""",
    "strip_v": f"WITH {CRUD} SELECT entry_id, FALSE AS has_v, len(list_filter(json_keys(o), lambda x: x LIKE '$%')) > 0 AS is_patch FROM crud WHERE op = 'u'",
    "v1_index_normalize": f"WITH {DDL} SELECT d.entry_id, collection AS coll, index_name, CAST(json_extract(o, '$.key') AS VARCHAR) AS key, array_to_string(list_sort(list_filter(json_keys(o), lambda x: x <> 'ns')), ',') AS options FROM ddl d JOIN m USING (entry_id) WHERE ix",
    "diff_normalize": f"WITH {_DIFF} SELECT entry_id, action, path FROM ops",
    "op_normalize": "SELECT delivery_id, CASE lower(operation_type) WHEN 'insert' THEN 'c' WHEN 'update' THEN 'u' WHEN 'replace' THEN 'u' WHEN 'delete' THEN 'd' END AS op FROM change_stream",
    "update_desc": """SELECT delivery_id, '$set' AS action, k AS path FROM (SELECT delivery_id, unnest(json_keys(updated_fields)) AS k FROM change_stream WHERE operation_type = 'update' AND updated_fields IS NOT NULL)
        UNION ALL SELECT delivery_id, '$unset', unnest(removed_fields) FROM change_stream WHERE operation_type = 'update'""",
    "event_time": f"SELECT delivery_id, coalesce(cluster_time.t * 1000, {BATCH_MS}) AS event_ms FROM change_stream",
    "cs_ddl": f"""SELECT delivery_id, CASE lower(operation_type) WHEN 'create' THEN 'CREATE_COLLECTION' WHEN 'createindexes' THEN 'CREATE_INDEXES' WHEN 'dropindexes' THEN 'DROP_INDEXES' WHEN 'drop' THEN 'DROP_COLLECTION' WHEN 'rename' THEN 'RENAME_COLLECTION' ELSE 'DROP_DATABASE' END AS ddl_type,
        {_DB} AS database, {_COLL} AS collection, '{{"' || CASE lower(operation_type) WHEN 'createindexes' THEN 'createIndexes' WHEN 'dropindexes' THEN 'dropIndexes' ELSE lower(operation_type) END || '":"' || {_COLL} || '"}}' AS command, cluster_time.t AS ts_t, cluster_time.i AS ts_i FROM change_stream WHERE lower(operation_type) IN ('create', 'createindexes', 'dropindexes', 'drop', 'rename', 'dropdatabase')""",
    "oplog_ddl": f"WITH {DDL} SELECT entry_id, ddl_type, database, collection, target, index_name FROM ddl",
    "transit_types": """SELECT ns, _id, id_type,
        CASE WHEN json_type(doc, '$.made') = 'OBJECT' THEN CAST(epoch_ms(CAST(json_extract_string(doc, '$.made."$date"') AS TIMESTAMP)) AS VARCHAR) ELSE json_extract_string(doc, '$.made') END AS made,
        coalesce(json_extract_string(doc, '$.rate."$numberDecimal"'), json_extract_string(doc, '$.rate')) AS rate, coalesce(json_extract_string(doc, '$.owner."$oid"'), json_extract_string(doc, '$.owner')) AS owner FROM source_docs""",
    "transit_documents": """WITH m AS (SELECT *, json_extract_string(doc, '$.made."$date"') AS d, json_extract_string(doc, '$.updatedAt."$date"') AS u FROM source_docs)
        SELECT ns, _id, id_type, coalesce(CAST(epoch_ms(CAST(d AS TIMESTAMP)) AS VARCHAR), json_extract_string(doc, '$.made')) AS made,
        coalesce(json_extract_string(doc, '$.rate."$numberDecimal"'), json_extract_string(doc, '$.rate')) AS rate, coalesce(json_extract_string(doc, '$.owner."$oid"'), json_extract_string(doc, '$.owner')) AS owner,
        json_extract_string(doc, '$.ship.city') AS city, coalesce(CAST(epoch_ms(CAST(u AS TIMESTAMP)) AS VARCHAR), json_extract_string(doc, '$.updatedAt')) AS updated FROM m""",
    "index_specs": f"""WITH {DDL}, s AS (SELECT m.entry_id, d.database || '.' || d.collection AS ns, unnest(CASE WHEN json_extract(o, '$.indexes') IS NULL THEN [o::JSON] ELSE CAST(json_extract(o, '$.indexes') AS JSON[]) END) AS s
          FROM m JOIN ddl d USING (entry_id) WHERE d.ddl_type = 'CREATE_INDEXES')
        SELECT entry_id, ns, json_extract_string(s, '$.name') AS name, coalesce(json_extract_string(s, '$.unique') IN ('true', '1'), FALSE) AS is_unique, coalesce(json_extract_string(s, '$.sparse') IN ('true', '1'), FALSE) AS sparse,
          CAST(json_extract_string(s, '$.expireAfterSeconds') AS BIGINT) AS expire_seconds, coalesce(json_extract_string(s, '$.hidden') IN ('true', '1'), FALSE) AS hidden FROM s""",
    "structure_options": f"""SELECT entry_id, {_DB} || '.' || json_extract_string(o, '$.create') AS ns, CASE WHEN json_extract(o, '$.viewOn') IS NOT NULL THEN 'view' WHEN json_extract(o, '$.timeseries') IS NOT NULL THEN 'timeseries' ELSE 'collection' END AS kind,
        coalesce(json_extract_string(o, '$.capped') IN ('true', '1'), FALSE) AS capped, CAST(json_extract_string(o, '$.size') AS BIGINT) AS size, CAST(json_extract_string(o, '$.expireAfterSeconds') AS BIGINT) AS expire_seconds, json_extract_string(o, '$.viewOn') AS view_on,
        json_extract_string(o, '$.collation.locale') AS locale, '{{' || array_to_string(list_transform(list_sort(list_filter(json_keys(o), lambda x: x NOT IN ('create', 'idIndex', 'v', 'lsid', '$db'))), lambda x: '"' || x || '":' || CAST(json_extract(o, '$."' || x || '"') AS VARCHAR)), ',') || '}}' AS options
        FROM oplog_entries WHERE op = 'c' AND json_keys(o)[1] = 'create'""",
    "bootstrap_plan": f"""WITH {DDL}
        SELECT DISTINCT 1 AS step, 'CREATE_COLLECTION' AS action, database || '.' || collection AS ns, CAST(NULL AS VARCHAR) AS name FROM ddl WHERE ddl_type = 'CREATE_COLLECTION'
          AND database || '.' || collection NOT IN (SELECT ns FROM change_stream WHERE lower(operation_type) = 'create')
        UNION ALL SELECT DISTINCT 2, 'CREATE_INDEX', database || '.' || collection, index_name FROM ddl d WHERE ddl_type = 'CREATE_INDEXES' AND index_name <> '_id_'
          AND NOT EXISTS (SELECT 1 FROM ddl x WHERE x.ddl_type = 'DROP_INDEXES' AND x.database = d.database AND x.collection = d.collection AND x.index_name = d.index_name)""",
    "ts_format": "SELECT entry_id, strftime(make_timestamp(ts.t * 1000000), '%Y-%m-%d %H:%M:%S') || '+0000' AS at FROM oplog_entries",
    "extract_id": "SELECT seq, coalesce(json_extract_string(after_doc, '$._id'), json_extract_string(before_doc, '$._id')) AS doc_id FROM transfer_events",
    "token_digest": f"SELECT delivery_id, CASE WHEN length(_id || _id || _id) > 120 THEN substr(_id || _id || _id, 1, 117) || '...' ELSE _id || _id || _id END AS digest, {_HEX} AS hex FROM change_stream",
    "offset_path": f"SELECT DISTINCT ns, shard, regexp_replace({_DB}, '[^a-zA-Z0-9._-]', '_', 'g') || '__' || regexp_replace({_COLL}, '[^a-zA-Z0-9._-]', '_', 'g') || '__' || regexp_replace(shard, '[^a-zA-Z0-9._-]', '_', 'g') || '.offset' AS file FROM oplog_entries WHERE ns <> ''",
    "progress_line": """WITH r AS (SELECT DISTINCT * FROM sync_runs WHERE run_state <> 'RUNNING')
        SELECT run_id, 'run=' || run_id || ' shard=' || shard || ' state=' || run_state || ' end=' || CASE WHEN regexp_matches(trim(coalesce(end_offset, '')), '^[A-Za-z0-9._:/()-]+$') THEN trim(end_offset) ELSE '"' || replace(replace(trim(coalesce(end_offset, '')), '\\', '\\\\'), '"', '\\"') || '"' END AS line FROM r""",
    "ns_system": f"SELECT ns, count(*) AS entries, lower({_DB}) IN ('admin', 'local', 'config') OR coalesce({_COLL} LIKE 'system.%', FALSE) AS is_system FROM oplog_entries GROUP BY ns",
    "ns_white": f"SELECT ns, count(*) AS docs FROM source_docs WHERE {_DB} = 'shop' OR ns = 'crm.visit' GROUP BY ns",
    "ns_black": f"SELECT ns, count(*) AS docs FROM source_docs WHERE NOT ({_DB} = 'shop' OR ns = 'crm.visit') GROUP BY ns",
    "rule_parse": "SELECT * FROM (VALUES (1, 'a|b.c', CAST(2 AS BIGINT)), (2, '', CAST(0 AS BIGINT)), (3, 'x.y', CAST(1 AS BIGINT)), (4, '', CAST(0 AS BIGINT))) t(id, parsed, n)",
    "ns_map": "SELECT ns, coalesce(target_ns, ns) AS target_ns, split_part(coalesce(target_ns, ns), '.', 1) AS target_db, split_part(coalesce(target_ns, ns), '.', 2) AS target_coll, count(*) AS docs FROM source_docs LEFT JOIN ns_map ON source_ns = ns GROUP BY ALL",
    "ns_invalidate": f"""WITH {DDL} SELECT entry_id, ddl_type, database || '.' || collection AS ns FROM ddl WHERE ddl_type IN ('RENAME_COLLECTION', 'DROP_COLLECTION')
        UNION SELECT entry_id, ddl_type, target FROM ddl WHERE ddl_type = 'RENAME_COLLECTION'
        UNION SELECT entry_id, ddl_type, n.ns FROM ddl JOIN (SELECT DISTINCT ns, {_DB} AS db FROM oplog_entries) n ON n.db = database WHERE ddl_type = 'DROP_DATABASE'""",
    "is_patch": "SELECT seq, coalesce(len(list_filter(json_keys(after_doc), lambda x: x LIKE '$%')) > 0 AND len(list_filter(json_keys(after_doc), lambda x: x NOT LIKE '$%' AND x <> '_id')) = 0, FALSE) AS is_patch FROM transfer_events WHERE op = 'u'",
    "index_plan": f"WITH {DDL} SELECT DISTINCT database || '.' || collection AS ns, index_name AS name FROM ddl d WHERE ddl_type = 'CREATE_INDEXES' AND index_name <> '_id_' AND NOT EXISTS (SELECT 1 FROM ddl x WHERE x.ddl_type = 'DROP_INDEXES' AND x.database = d.database AND x.collection = d.collection AND x.index_name = d.index_name)",
    "has_unique": f"WITH {DDL} SELECT d.database || '.' || d.collection AS ns, coalesce(bool_or(o LIKE '%\"unique\":true%' AND index_name <> '_id_'), FALSE) AS has_unique FROM m JOIN ddl d USING (entry_id) WHERE d.ddl_type = 'CREATE_INDEXES' GROUP BY 1",
    "unique_timeline": f"""WITH {DDL}, s AS (SELECT d.*, d.database || '.' || d.collection AS ns, o LIKE '%"unique":true%' AND index_name <> '_id_' AS u FROM ddl d JOIN m USING (entry_id))
        SELECT a.entry_id, a.ns, EXISTS (SELECT 1 FROM s b WHERE b.ns = a.ns AND b.ddl_type = 'CREATE_INDEXES' AND b.u AND (b.ts_t, b.ts_i, b.entry_id) <= (a.ts_t, a.ts_i, a.entry_id)
          AND NOT EXISTS (SELECT 1 FROM s c WHERE c.ns = a.ns AND (c.ddl_type IN ('DROP_COLLECTION', 'RENAME_COLLECTION') OR (c.ddl_type = 'DROP_INDEXES' AND c.index_name = b.index_name))
            AND (c.ts_t, c.ts_i, c.entry_id) BETWEEN (b.ts_t, b.ts_i, b.entry_id) AND (a.ts_t, a.ts_i, a.entry_id))) AS unique_now FROM s a WHERE a.ns IS NOT NULL""",
    "ddl_segments": f"""WITH {DDL}, {CRUD},
        u AS (SELECT ns, ts.t AS t, ts.i AS i, 0 AS d FROM crud UNION ALL SELECT database || '.' || collection, ts_t, ts_i, 1 FROM ddl),
        s AS (SELECT ns, d, sum(d) OVER (PARTITION BY ns ORDER BY t, i, d DESC ROWS UNBOUNDED PRECEDING) AS segment FROM u)
        SELECT ns, CAST(segment AS BIGINT) AS segment, count(*) AS events FROM s WHERE d = 0 GROUP BY ALL""",
    "drop_resets": f"""WITH {DDL}, {CRUD}, g AS (SELECT database, collection, max((ts_t, ts_i)) AS at FROM ddl WHERE ddl_type IN ('DROP_COLLECTION', 'RENAME_COLLECTION', 'DROP_DATABASE') GROUP BY ALL)
        SELECT c.ns, count(*) AS events FROM crud c WHERE NOT EXISTS (SELECT 1 FROM g WHERE ((g.collection IS NULL AND g.database = split_part(c.ns, '.', 1)) OR g.database || '.' || g.collection = c.ns) AND (c.ts.t, c.ts.i) <= g.at) GROUP BY c.ns""",
    "ddl_apply_catalog": f"""WITH {DDL}, once AS (SELECT database, collection, min(ts_t) AS t, min(ts_i) AS i FROM ddl WHERE ddl_type = 'CREATE_COLLECTION' GROUP BY ALL)
        SELECT CAST(row_number() OVER (ORDER BY t, i, database, collection) - 1 AS INTEGER) AS step, 'CREATE TABLE IF NOT EXISTS `' || database || '`.`' || collection || '` (_id STRING, doc STRING) USING parquet' AS statement FROM once""",
    "sync_with_ddl": f"""WITH {_DIFF}, {DDL}, {CRUD},
        own AS (SELECT entry_id, ns, op, (ts.t, ts.i) AS pos, CAST(CASE WHEN op = 'u' THEN json_extract_string(o2, '$._id') ELSE json_extract_string(o, '$._id') END AS VARCHAR) AS k FROM crud
          WHERE NOT coalesce(from_migrate, FALSE) AND lower(split_part(ns, '.', 1)) NOT IN ('admin', 'local', 'config')
            AND (op <> 'u' OR entry_id IN (SELECT entry_id FROM ops) OR (o NOT LIKE '%"diff"%' AND (len(list_filter(json_keys(o), lambda x: x LIKE '$%' AND x <> '$v')) = 0 OR len(json_keys(o, '$."$set"')) > 0 OR len(json_keys(o, '$."$unset"')) > 0)))),
        ends AS (SELECT database || '.' || collection AS ns, (ts_t, ts_i) AS pos FROM ddl WHERE ddl_type IN ('DROP_COLLECTION', 'RENAME_COLLECTION')),
        last AS (SELECT ns, k, arg_max(op, pos) AS op, max(pos) AS pos FROM own WHERE k IS NOT NULL GROUP BY ns, k)
        SELECT ns, count(*) AS docs FROM last l WHERE op <> 'd' AND NOT EXISTS (SELECT 1 FROM ends e WHERE e.ns = l.ns AND e.pos >= l.pos) GROUP BY ns""",
    "log_renames": f"""WITH RECURSIVE {DDL}, r AS (SELECT database || '.' || collection AS source, min(target) AS target FROM ddl WHERE ddl_type = 'RENAME_COLLECTION' GROUP BY 1),
        c AS (SELECT source, target FROM r UNION SELECT c.source, r.target FROM c JOIN r ON r.source = c.target)
        SELECT source, target AS final FROM c WHERE target NOT IN (SELECT source FROM r)""",
    "rename_chain": "SELECT 'db.c' || c_custkey AS source, 'db.c' || ((c_custkey // 5 + 1) * 5) AS final FROM customer WHERE c_custkey % 5 <> 0",
}
