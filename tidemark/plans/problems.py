"""Queries of the data problems p1 to p6, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import compare, dedup, drift, incremental, mor_table, skew
from tidemark.session import read_table, ship, work_path


def _p1_run(spark: SparkSession, sf_dir: str) -> tuple[incremental.IncrementalRunner, DataFrame]:
    """A run over both logs, committed; and the landed rows it read."""
    oplog, changes, journal = (read_table(spark, sf_dir, t) for t in ("oplog_entries", "change_stream", "sync_runs"))
    runner = incremental.IncrementalRunner(spark, work_path(spark, "runs"))
    runner.take(oplog, changes, incremental.committed_runs(journal, changes))
    return runner, incremental.landed_rows(oplog, changes)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that no committed run has processed: what the next run takes and commits."""
    out = _p1_run(spark, sf_dir)[0].output()
    return out if out is not None else spark.createDataFrame([], incremental._POSITIONS)


def p1_next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per shard and mode: the limit that the run fixed, how many positions it took, and between which."""
    runner, rows = _p1_run(spark, sf_dir)
    at = F.struct("pos_t", "pos_i")
    todo = p1_out.groupBy("shard", "capture_mode").agg(F.count("*").alias("pending"), F.min(at).alias("a"), F.max(at).alias("b")) if (p1_out := runner.output()) is not None else None
    limit = incremental.landed_positions(rows).groupBy("shard", "capture_mode").agg(F.max("landed").alias("limit_us"), F.count("*").alias("positions"))
    if todo is None:
        todo = limit.select("shard", "capture_mode", F.lit(0).cast("long").alias("pending"), F.lit(None).cast("struct<pos_t:bigint,pos_i:bigint>").alias("a"), F.lit(None).cast("struct<pos_t:bigint,pos_i:bigint>").alias("b"))
    return limit.join(todo, ["shard", "capture_mode"], "left").select(
        "shard", "capture_mode", "limit_us", "positions", F.coalesce("pending", F.lit(0).cast("long")).alias("pending"), F.col("a.pos_t").alias("first_t"), F.col("a.pos_i").alias("first_i"), F.col("b.pos_t").alias("last_t"), F.col("b.pos_i").alias("last_i")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents missing on a side, and fields that differ."""
    source, target, ns_map = (read_table(spark, sf_dir, t) for t in ("source_docs", "target_docs", "ns_map"))
    return compare.compare(source, compare.to_source_ns(target, ns_map))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar fields of the documents alive after all changes: the snapshot is one version of the table, the log the next."""
    events = read_table(spark, sf_dir, "transfer_events")
    table = mor_table.MorTable(spark, work_path(spark, "mor"))
    table.apply(events.where("phase = 0")).apply(events.where("phase is null or phase <> 0"))
    return mor_table.scalar_fields(table.read())


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes whose quantity is that of the account's change just before."""
    return skew.repeated_quantities(read_table(spark, sf_dir, "transfer_events"))


def p4_ns_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per namespace, of which one has four tenths."""
    return skew.skewed_counts(read_table(spark, sf_dir, "transfer_events"), "ns")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of fields from a file of a shard to the next."""
    return drift.drift_report(read_table(spark, sf_dir, "oplog_entries"))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All logged documents in one consistent schema."""
    from tidemark.session import materialise

    documents = materialise(drift.log_documents(read_table(spark, sf_dir, "oplog_entries")), "log-documents")
    return drift.consistent_table(documents, drift.table_layout(drift.infer_union(documents)))


#: As so many runs p6_found reads the change stream, in the order of its batches.
P6_RUNS = 3


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of change-stream messages that are copies of a kept one."""
    seen = dedup.SeenMessages(spark, work_path(spark, "seen"))
    deliveries = dedup.message_identifiers(read_table(spark, sf_dir, "change_stream"), "batch_no")
    for batch in dedup.in_order(deliveries, P6_RUNS):
        seen.admit(batch)
    return seen.copies()


def p6_oplog_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries captured again."""
    return dedup.keep_first_entries(read_table(spark, sf_dir, "oplog_entries"))


QUERIES = {f.__name__: f for f in (p1_found, p1_next_run, p2_found, p3_found, p4_found, p4_ns_rows, p5_found, p5_table, p6_found, p6_oplog_copies)}

#: Positions with their landing, and those that no committed run spans.
_P1 = """
    landed AS (
          SELECT shard, 'OPLOG' AS capture_mode, ts.t AS pos_t, ts.i AS pos_i, min(landed_at) AS at FROM oplog_entries GROUP BY ALL
          UNION ALL
          SELECT shard, 'CHANGE_STREAM', cluster_time.t, cluster_time.i, min(landed_at) FROM change_stream WHERE cluster_time IS NOT NULL GROUP BY ALL),
        last AS (
          SELECT DISTINCT ON (shard, capture_mode, run_id) * FROM sync_runs ORDER BY logged_at DESC),
        token AS (
          SELECT upper(regexp_extract(_id, '([0-9A-Fa-f]{16,})', 1)) AS hex, min(cluster_time) AS ct FROM change_stream WHERE _id IS NOT NULL AND cluster_time IS NOT NULL GROUP BY 1),
        runs AS (
          SELECT l.*, upper(regexp_extract(start_offset, '([0-9A-Fa-f]{16,})', 1)) AS s_hex, upper(regexp_extract(end_offset, '([0-9A-Fa-f]{16,})', 1)) AS e_hex
          FROM last l WHERE run_state = 'COMMITTED'),
        spans AS (
          SELECT r.shard, r.capture_mode, r.read_at,
            CASE WHEN start_offset IS NULL THEN -1 WHEN r.capture_mode = 'CHANGE_STREAM' THEN s.ct.t * 4294967296 + s.ct.i
                 WHEN start_offset LIKE '{%' THEN json_extract(start_offset, '$."$timestamp".t')::BIGINT * 4294967296 + json_extract(start_offset, '$."$timestamp".i')::BIGINT
                 ELSE split_part(start_offset, ':', 1)::BIGINT * 4294967296 + split_part(start_offset, ':', 2)::BIGINT END AS lo,
            CASE WHEN r.capture_mode = 'CHANGE_STREAM' THEN e.ct.t * 4294967296 + e.ct.i
                 WHEN end_offset LIKE '{%' THEN json_extract(end_offset, '$."$timestamp".t')::BIGINT * 4294967296 + json_extract(end_offset, '$."$timestamp".i')::BIGINT
                 ELSE split_part(end_offset, ':', 1)::BIGINT * 4294967296 + split_part(end_offset, ':', 2)::BIGINT END AS hi
          FROM runs r LEFT JOIN token s ON s.hex = r.s_hex LEFT JOIN token e ON e.hex = r.e_hex),
        pending AS (SELECT p.* FROM landed p
          WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.shard = p.shard AND s.capture_mode = p.capture_mode AND p.at <= s.read_at
                            AND p.pos_t * 4294967296 + p.pos_i > s.lo AND p.pos_t * 4294967296 + p.pos_i <= s.hi))"""
#: Documents of both copies, cut into fields: (side, ns, _id, id_type, parent, path, open, text); a field that isn't an object
#: of plain fields is compared whole, as the sorted list of its inner values with numbers as doubles.
_P2 = """
    RECURSIVE src AS (
      SELECT 's' AS side, ns, _id, id_type, doc FROM source_docs UNION ALL
      SELECT * FROM (SELECT DISTINCT ON (1, 2, 3, 4) 't', coalesce(source_ns, ns), _id, id_type, doc FROM target_docs LEFT JOIN ns_map ON target_ns = ns ORDER BY copied_at DESC, doc DESC)),
    o AS (
      SELECT side, ns, _id, id_type, CAST('' AS VARCHAR) AS parent, x.key AS path, x.value AS v FROM src, json_each(doc) x WHERE x.key NOT IN ('_class', 'updatedAt')
      UNION ALL
      SELECT side, ns, _id, id_type, o.path, o.path || '.' || x.key, x.value FROM o, json_each(o.v) x WHERE json_type(o.v) = 'OBJECT' AND NOT (len(json_keys(o.v)) = 1 AND json_keys(o.v)[1] LIKE '$%')),
    f AS (SELECT *, json_type(v) = 'OBJECT' AND NOT coalesce(len(json_keys(v)) = 1 AND json_keys(v)[1] LIKE '$%', FALSE) AS open FROM o),
    d AS (
      SELECT side, ns, _id, id_type, path, CAST('' AS VARCHAR) AS sub, v FROM f WHERE NOT open
      UNION ALL
      SELECT side, ns, _id, id_type, d.path, sub || '/' || x.key, x.value FROM d, json_each(d.v) x WHERE json_type(d.v) IN ('OBJECT', 'ARRAY')),
    texts AS (SELECT side, ns, _id, id_type, path, list_sort(list(sub || '=' || CASE WHEN json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'N' || CAST(CAST(v AS DOUBLE) AS VARCHAR) WHEN json_type(v) IN ('OBJECT', 'ARRAY') THEN json_type(v) ELSE json_type(v) || CAST(v AS VARCHAR) END)) AS l FROM d GROUP BY ALL),
    n AS (SELECT f.side, f.ns, f._id, f.id_type, parent, f.path, open, l FROM f LEFT JOIN texts t ON t.side = f.side AND t.ns = f.ns AND t._id = f._id AND t.id_type = f.id_type AND t.path = f.path),
    keys AS (SELECT coalesce(a.ns, b.ns) AS ns, coalesce(a._id, b._id) AS _id, coalesce(a.id_type, b.id_type) AS id_type, a.ns IS NOT NULL AS s, b.ns IS NOT NULL AS t
             FROM (FROM src WHERE side = 's') a FULL JOIN (FROM src WHERE side = 't') b ON a.ns = b.ns AND a._id = b._id AND a.id_type = b.id_type),
    m AS (SELECT coalesce(a.ns, b.ns) AS ns, coalesce(a._id, b._id) AS _id, coalesce(a.id_type, b.id_type) AS id_type, coalesce(a.path, b.path) AS path, coalesce(a.parent, b.parent) AS parent,
             a.ns IS NULL OR b.ns IS NULL AS lone, coalesce(a.open AND b.open, FALSE) AS inner_node, NOT coalesce(a.open AND b.open, FALSE) AND (a.open IS DISTINCT FROM b.open OR a.l IS DISTINCT FROM b.l) AS differs
          FROM (FROM n WHERE side = 's') a FULL JOIN (FROM n WHERE side = 't') b ON a.ns = b.ns AND a._id = b._id AND a.id_type = b.id_type AND a.path = b.path)"""
#: Changes in order, each once: (key, pos, op, doc), where pos is one number for (phase, t, i).
_P3 = """
    once AS (SELECT DISTINCT ON (ts_t, ts_i) *, json_extract(before_doc, '$._id') AS b, json_extract(after_doc, '$._id') AS a FROM transfer_events WHERE op IN ('c', 'r', 'u', 'd') ORDER BY seq),
    ev AS (SELECT ns, CAST(CASE WHEN coalesce(b, a) IS NULL THEN NULL ELSE coalesce(before_doc->>'$._id', after_doc->>'$._id') END AS VARCHAR) AS k, (coalesce(phase, 1) * 10000000000 + ts_t) * 1000000 + ts_i AS pos, op, after_doc AS doc,
              op = 'u' AND len(list_filter(json_keys(after_doc), lambda x: x LIKE '$%')) > 0 AS patch FROM once),
    base AS (SELECT ns, k, max(pos) AS pos, arg_max(op, pos) AS op, arg_max(doc, pos) AS doc FROM ev WHERE k IS NOT NULL AND NOT patch GROUP BY ns, k),
    late AS (SELECT e.ns, e.k, e.pos, e.doc FROM ev e LEFT JOIN base b ON b.ns = e.ns AND b.k = e.k WHERE e.k IS NOT NULL AND patch AND (b.pos IS NULL OR e.pos > b.pos)),
    puts AS (SELECT ns, k, pos, x.key AS path, x.value AS v FROM late, json_each(json_extract(doc, '$."$set"')) x),
    cuts AS (SELECT ns, k, pos, path, TRUE AS puts FROM puts UNION ALL SELECT ns, k, pos, x.key, FALSE FROM late, json_each(json_extract(doc, '$."$unset"')) x),
    roots AS (SELECT ns, k, pos, x.key AS path, x.value AS v FROM base, json_each(doc) x WHERE op <> 'd' AND x.key <> '_id' UNION ALL SELECT ns, k, pos, path, v FROM puts),
    tree AS (SELECT ns, k, pos, path, v FROM roots UNION ALL SELECT ns, k, pos, tree.path || '.' || x.key, x.value FROM tree, json_each(tree.v) x WHERE json_type(tree.v) = 'OBJECT')"""
#: Deliveries with the least delivery of their token and of their own identity, and the links between these.
_P6 = """
    ids AS (SELECT delivery_id, upper(nullif(regexp_extract(_id, '"?([0-9A-Fa-f]{16,})"?', 1), '')) AS tok,
              CASE WHEN cluster_time IS NOT NULL AND ns IS NOT NULL AND shard IS NOT NULL AND document_key IS NOT NULL
                   THEN shard || '|' || cluster_time.t || '|' || cluster_time.i || '|' || ns || '|' || CAST(list_sort(list_transform(json_keys(document_key), lambda x: x || '=' || CAST(json_extract(document_key, '$."' || x || '"') AS VARCHAR))) AS VARCHAR) END AS own
            FROM change_stream),
    c AS (SELECT delivery_id, coalesce(min(delivery_id) OVER (PARTITION BY tok), delivery_id) AS a0, tok, own, min(delivery_id) OVER (PARTITION BY own) AS b0 FROM ids),
    ab AS (SELECT delivery_id, CASE WHEN tok IS NULL THEN delivery_id ELSE a0 END AS a, CASE WHEN own IS NULL THEN delivery_id ELSE b0 END AS b FROM c),
    links AS (SELECT DISTINCT a AS u, b AS v FROM ab WHERE a <> b UNION SELECT DISTINCT b, a FROM ab WHERE a <> b),
    reach AS (SELECT u AS x, u AS y FROM links UNION SELECT r.x, l.v FROM reach r JOIN links l ON l.u = r.y),
    root AS (SELECT x, min(y) AS root FROM reach GROUP BY x)"""
#: Fields of each file by type, the report's comparison of a file with the one before, and renames by equal values.
_P5 = """
    RECURSIVE once AS (SELECT DISTINCT ON (shard, ts) * FROM oplog_entries WHERE op IN ('i', 'u') AND ns NOT LIKE 'config.%' AND ns NOT LIKE '%.system.%' AND ns NOT LIKE '%.$cmd' ORDER BY file_no, entry_id),
    docs AS (
      SELECT shard, ns, 'o' AS part, file_no, ts, o AS doc FROM once WHERE op = 'i' OR len(list_filter(json_keys(o), lambda x: x LIKE '$%')) = 0
      UNION ALL SELECT shard, ns, 'o2', file_no, ts, o2 FROM once WHERE op = 'u' AND o2 IS NOT NULL),
    tree AS (
      SELECT shard, ns, part, file_no, ts, CAST(json_extract(doc, '$._id') AS VARCHAR) AS id, x.key AS path, x.value AS v FROM docs, json_each(doc) x
      UNION ALL
      SELECT shard, ns, part, file_no, ts, tree.id, tree.path || '.' || x.key, x.value FROM tree, json_each(tree.v) x WHERE json_type(tree.v) = 'OBJECT' AND NOT (len(json_keys(tree.v)) = 1 AND json_keys(tree.v)[1] LIKE '$%')),
    vals AS (SELECT *, CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN json_keys(v)[1] ELSE 'number' END AS kind FROM tree
             WHERE NOT (json_type(v) = 'OBJECT' AND len(json_keys(v)) > 0 AND NOT (len(json_keys(v)) = 1 AND json_keys(v)[1] LIKE '$%'))),
    files AS (SELECT shard, ns, part, file_no, lag(file_no) OVER (PARTITION BY shard, ns, part ORDER BY file_no) AS old FROM (SELECT DISTINCT shard, ns, part, file_no FROM docs)),
    counted AS (SELECT shard, ns, part, file_no, path, kind, count(*) AS n FROM vals GROUP BY ALL),
    fields AS (SELECT shard, ns, part, file_no, path, arg_max(kind, (n, CASE kind WHEN '$date' THEN 6 WHEN '$numberDecimal' THEN 5 WHEN 'array' THEN 8 WHEN 'bool' THEN 7 WHEN 'number' THEN 4 WHEN '$oid' THEN 3 ELSE 1 END)) FILTER (kind IS NOT NULL) AS kind FROM counted GROUP BY ALL),
    now AS (SELECT f.shard, f.ns, f.part, g.file_no, g.old, path, kind FROM fields f JOIN files g USING (shard, ns, part, file_no) WHERE old IS NOT NULL),
    was AS (SELECT f.shard, f.ns, f.part, g.file_no, g.old, path, kind FROM fields f JOIN files g ON g.shard = f.shard AND g.ns = f.ns AND g.part = f.part AND g.old = f.file_no),
    ch AS (SELECT coalesce(a.shard, b.shard) AS shard, coalesce(a.ns, b.ns) AS ns, coalesce(a.part, b.part) AS part, coalesce(a.file_no, b.file_no) AS file_no, coalesce(a.old, b.old) AS old, coalesce(a.path, b.path) AS path,
              CASE WHEN a.path IS NULL THEN 'removed' WHEN b.path IS NULL THEN 'added' WHEN a.kind <> b.kind THEN 'retyped' END AS kind
           FROM now a FULL JOIN was b ON a.shard = b.shard AND a.ns = b.ns AND a.part = b.part AND a.file_no = b.file_no AND a.path = b.path),
    olds AS (SELECT c.shard, c.ns, c.part, c.file_no, c.path, v.id, arg_max(v.v, v.ts) AS v FROM ch c JOIN vals v ON c.kind = 'removed' AND v.shard = c.shard AND v.ns = c.ns AND v.part = c.part AND v.file_no = c.old AND v.path = c.path
             JOIN (SELECT shard, ns, part, file_no, id, max(ts) AS ts FROM tree GROUP BY ALL) l ON l.shard = v.shard AND l.ns = v.ns AND l.part = v.part AND l.file_no = v.file_no AND l.id = v.id AND l.ts = v.ts WHERE v.kind IS NOT NULL GROUP BY ALL),
    firsts AS (SELECT shard, ns, part, file_no, id, min(ts) AS ts FROM tree GROUP BY ALL),
    shared AS (SELECT o.*, f.ts FROM olds o JOIN firsts f ON f.shard = o.shard AND f.ns = o.ns AND f.part = o.part AND f.file_no = o.file_no AND f.id = o.id),
    pairs AS (SELECT s.shard, s.ns, s.part, s.file_no, s.path, v.path AS new_path, count(*) AS n FROM shared s JOIN vals v ON v.shard = s.shard AND v.ns = s.ns AND v.part = s.part AND v.file_no = s.file_no AND v.id = s.id AND v.ts = s.ts AND CAST(v.v AS VARCHAR) = CAST(s.v AS VARCHAR)
             JOIN ch c ON c.kind = 'added' AND c.shard = v.shard AND c.ns = v.ns AND c.part = v.part AND c.file_no = v.file_no AND c.path = v.path GROUP BY ALL),
    totals AS (SELECT shard, ns, part, file_no, path, count(*) AS n FROM shared GROUP BY ALL),
    one AS (SELECT p.shard, p.ns, p.part, p.file_no, p.path, min(new_path) AS new_path FROM pairs p JOIN totals t ON t.shard = p.shard AND t.ns = p.ns AND t.part = p.part AND t.file_no = p.file_no AND t.path = p.path AND t.n = p.n GROUP BY ALL),
    moved AS (SELECT shard, ns, part, file_no, min(path) AS path, new_path FROM one GROUP BY ALL)"""

#: Cells of the consistent table: (entry_id, doc_part, name, branch, text), a path's columns named in order of path and type,
#: with an underscore more for each name that was there before, whatever its case.
_P5_TABLE = """
    RECURSIVE once AS (SELECT DISTINCT ON (shard, ts) * FROM oplog_entries WHERE op IN ('i', 'u') AND ns NOT LIKE 'config.%' AND ns NOT LIKE '%.system.%' AND ns NOT LIKE '%.$cmd' ORDER BY file_no, entry_id),
    docs AS (
      SELECT entry_id, shard, ns, 'o' AS doc_part, file_no, o AS doc FROM once WHERE op = 'i' OR len(list_filter(json_keys(o), lambda x: x LIKE '$%')) = 0
      UNION ALL SELECT entry_id, shard, ns, 'o2', file_no, o2 FROM once WHERE op = 'u' AND o2 IS NOT NULL),
    tree AS (
      SELECT entry_id, doc_part, x.key AS path, x.value AS v FROM docs, json_each(doc) x
      UNION ALL
      SELECT entry_id, doc_part, tree.path || '.' || x.key, x.value FROM tree, json_each(tree.v) x WHERE json_type(tree.v) = 'OBJECT' AND NOT (len(json_keys(tree.v)) = 1 AND json_keys(tree.v)[1] LIKE '$%')),
    leaf AS (
      SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'array'
                  WHEN 'OBJECT' THEN CASE json_keys(v)[1] WHEN '$date' THEN 'date' WHEN '$oid' THEN 'objectId' WHEN '$numberDecimal' THEN 'decimal' WHEN '$numberLong' THEN 'number' ELSE 'object' END ELSE 'number' END AS kind,
        CASE WHEN json_type(v) = 'OBJECT' AND len(json_keys(v)) = 1 AND json_type(v, '$."' || json_keys(v)[1] || '"') = 'VARCHAR' THEN json_extract_string(v, '$."' || json_keys(v)[1] || '"')
             WHEN json_type(v) = 'VARCHAR' THEN v->>'$' ELSE CAST(v AS VARCHAR) END AS text
      FROM tree WHERE json_type(v) <> 'NULL' AND NOT (json_type(v) = 'OBJECT' AND len(json_keys(v)) > 0 AND NOT (len(json_keys(v)) = 1 AND json_keys(v)[1] LIKE '$%'))),
    kinds AS (SELECT path, count(DISTINCT kind) AS n FROM leaf GROUP BY path),
    wide AS (
      SELECT entry_id, doc_part, path, '' AS kind, replace(path, '.', '__') AS name, 'string' AS branch, text FROM leaf JOIN kinds USING (path) WHERE n > 1
      UNION ALL SELECT entry_id, doc_part, path, kind, replace(path, '.', '__') || CASE WHEN n > 1 THEN '__' || kind ELSE '' END, CASE kind WHEN 'number' THEN 'double' WHEN 'bool' THEN 'boolean' ELSE 'string' END, text FROM leaf JOIN kinds USING (path)),
    named AS (
      SELECT path, kind, name || repeat('_', CAST(row_number() OVER (PARTITION BY lower(name) ORDER BY path, kind) - 1 + CASE WHEN lower(name) IN ('entry_id', 'shard', 'ns', 'doc_part', 'file_no') THEN 1 ELSE 0 END AS INTEGER)) AS column_name
      FROM (SELECT DISTINCT path, kind, name FROM wide)),
    cells AS (SELECT entry_id, doc_part, column_name, branch, text FROM wide JOIN named USING (path, kind))"""

ORACLES = {
    "p5_table": f"""WITH {_P5_TABLE}
        SELECT * FROM (SELECT entry_id, shard, ns, doc_part, file_no FROM docs)
        LEFT JOIN (PIVOT (SELECT entry_id, doc_part, column_name, text FROM cells WHERE branch = 'string') ON column_name USING any_value(text) GROUP BY entry_id, doc_part) USING (entry_id, doc_part)
        LEFT JOIN (PIVOT (SELECT entry_id, doc_part, column_name, CAST(text AS DOUBLE) AS x FROM cells WHERE branch = 'double') ON column_name USING any_value(x) GROUP BY entry_id, doc_part) USING (entry_id, doc_part)
        LEFT JOIN (PIVOT (SELECT entry_id, doc_part, column_name, CAST(text AS BOOLEAN) AS x FROM cells WHERE branch = 'boolean') ON column_name USING any_value(x) GROUP BY entry_id, doc_part) USING (entry_id, doc_part)""",
    "p4_ns_rows": "SELECT ns, count(*) AS rows FROM transfer_events GROUP BY ns",
    "p6_oplog_copies": """
        SELECT entry_id FROM (
          SELECT entry_id, min(entry_id) OVER (PARTITION BY shard, ts) AS first FROM oplog_entries WHERE shard IS NOT NULL AND ts IS NOT NULL)
        WHERE entry_id <> first""",
    "p1_found": f"WITH {_P1} SELECT shard, capture_mode, pos_t, pos_i FROM pending",
    "p1_next_run": f"""WITH {_P1},
        limits AS (SELECT shard, capture_mode, epoch_us(max(landed.at)) AS limit_us, count(*) AS positions FROM landed GROUP BY ALL),
        todo AS (SELECT shard, capture_mode, count(*) AS pending, min((pos_t, pos_i)) AS a, max((pos_t, pos_i)) AS b FROM pending GROUP BY ALL)
        SELECT shard, capture_mode, limit_us, positions, coalesce(t.pending, 0) AS pending, a[1] AS first_t, a[2] AS first_i, b[1] AS last_t, b[2] AS last_i FROM limits LEFT JOIN todo t USING (shard, capture_mode)""",
    "p4_found": """
        WITH once AS (
          SELECT ts_t, ts_i, arg_min(after_doc, seq) AS doc FROM transfer_events
          WHERE op IN ('c', 'u') AND json_extract_string(after_doc, '$.acct') IS NOT NULL GROUP BY ts_t, ts_i),
        seen AS (
          SELECT json_extract_string(doc, '$.acct') AS acct, ts_t, ts_i, TRY_CAST(json_extract_string(doc, '$.qty') AS DOUBLE) AS qty FROM once),
        w AS (SELECT *, lag(qty) OVER (PARTITION BY acct ORDER BY ts_t, ts_i) AS before FROM seen)
        SELECT acct, ts_t, ts_i FROM w WHERE qty = before""",
    "p2_found": f"""WITH {_P2}
        SELECT ns, _id, id_type, CASE WHEN t THEN 'missingOnSource' ELSE 'missingOnTarget' END AS diff_kind, '' AS field_path FROM keys WHERE NOT (s AND t)
        UNION ALL
        SELECT m.ns, m._id, m.id_type, 'contentMismatch', m.path FROM m JOIN keys k ON k.ns = m.ns AND k._id = m._id AND k.id_type = m.id_type AND k.s AND k.t
          LEFT JOIN m p ON p.ns = m.ns AND p._id = m._id AND p.id_type = m.id_type AND p.path = m.parent
        WHERE m.differs AND (m.parent = '' OR p.inner_node)""",
    "p3_found": f"""WITH RECURSIVE {_P3}
        SELECT ns, k AS doc_key, path AS field_path, CASE WHEN json_type(v) = 'NULL' THEN 'null' ELSE v->>'$' END AS field_value FROM tree l
        WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY') AND NOT EXISTS (
          SELECT 1 FROM cuts c WHERE c.ns = l.ns AND c.k = l.k AND c.pos > l.pos AND (c.path = l.path OR starts_with(l.path, c.path || '.') OR (c.puts AND starts_with(c.path, l.path || '.'))))""",
    "p5_found": f"""WITH {_P5}
        SELECT shard, ns, part AS doc_part, file_no, kind AS drift_kind, path AS field_path, '' AS new_path FROM ch c WHERE kind IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM moved m WHERE m.shard = c.shard AND m.ns = c.ns AND m.part = c.part AND m.file_no = c.file_no AND ((kind = 'removed' AND m.path = c.path) OR (kind = 'added' AND m.new_path = c.path)))
        UNION ALL SELECT shard, ns, part, file_no, 'renamed', path, new_path FROM moved""",
    "p6_found": f"""WITH RECURSIVE {_P6}
        SELECT delivery_id FROM ab LEFT JOIN root ON x = least(a, b) WHERE delivery_id <> coalesce(root, least(a, b))""",
}
