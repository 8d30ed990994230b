import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import transit
from tidemark.functions.register import register_functions
from tidemark.operators import ddl, namespace, parse
from tidemark.operators.mor_table import MorTable, scalar_fields
from tidemark.runtime import sync
from tidemark.runtime.config import ErrorCode, MigrationError, SyncConfig
from tidemark.session import read_table, work_path
from tidemark.streaming import log_source


def test_snapshot_then_log_with_rules_and_names(spark, tmp_path):
    docs = spark.createDataFrame([("shop.a", "1", '{"_id":1,"v":1}'), ("shop.b", "1", '{"_id":1,"v":1}'), ("crm.a", "1", '{"_id":1}'), ("shop.a", "2", '{"_id":2,"v":1}')], "ns string, _id string, doc string")
    folder = tmp_path / "log"
    folder.mkdir()
    entries = [("u", "shop.a", {"$set": {"v": 2}}, {"_id": 1}), ("d", "shop.a", {"_id": 2}, None), ("i", "shop.c", {"_id": 9, "v": 9}, None), ("i", "crm.a", {"_id": 9}, None), ("c", "shop.$cmd", {"create": "c"}, None)]
    with open(folder / "0.jsonl", "w") as f:
        f.writelines(json.dumps({"entry_id": k, "shard": "s", "ts": {"t": 10 + k, "i": 1}, "op": op, "ns": ns, "o": json.dumps(o), "o2": o2 and json.dumps(o2)}) + "\n" for k, (op, ns, o, o2) in enumerate(entries))
    done, changes = [], []
    table = MorTable(spark, work_path(spark, "sync"))
    run = sync.Sync(spark, SyncConfig(white=["shop"], transform={"shop.a": "new.a"}), table, lambda: done.append(1), lambda df: changes.extend(df.collect()))
    run.snapshot(docs, 5)
    run.start(log_source.log_stream(spark, str(folder), "json"), str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    assert {tuple(r) for r in scalar_fields(table.read()).collect()} == {("new.a", "1", "v", "2"), ("shop.b", "1", "v", "1"), ("shop.c", "9", "v", "9")}
    assert done == [1] and [c["ddl_type"] for c in changes] == ["CREATE_COLLECTION"]


def entries(spark, *rows):
    return spark.createDataFrame([(k, "s", (t, 1), op, ns, json.dumps(o), o2 and json.dumps(o2), bool(m)) for k, (t, op, ns, o, o2, m) in enumerate((*r, None, None)[:6] for r in rows)], "entry_id bigint, shard string, ts struct<t:bigint,i:bigint>, op string, ns string, o string, o2 string, from_migrate boolean")


def keys(table):
    return {(r["ns"], r["doc_key"]) for r in table.read().collect()}


def test_schema_changes_are_a_barrier(spark):
    table = MorTable(spark, work_path(spark, "sync"))
    run = sync.Sync(spark, SyncConfig(transform={"d.a": "new.a"}), table)
    insert = lambda t, ns, k: (t, "i", ns, {"_id": k})
    command = lambda t, db, o: (t, "c", f"{db}.$cmd", o)
    run.apply_batch(entries(spark, insert(1, "d.a", 1), insert(1, "d.b", 1), insert(1, "e.x", 1), (2, "d", "d.a", {"_id": 1}, None, True)))
    assert keys(table) == {("new.a", "1"), ("d.b", "1"), ("e.x", "1")}  # a balancer's delete is none
    run.apply_batch(
        entries(
            spark, insert(3, "d.a", 2), command(4, "d", {"drop": "a"}), insert(5, "d.a", 3), insert(6, "d.t", 1), command(7, "d", {"renameCollection": "d.t", "to": "d.b"}), insert(8, "d.t", 2), insert(8, "d.b", 9),
            command(9, "d", {"renameCollection": "d.none", "to": "d.nothing"}), command(10, "e", {"dropDatabase": 1}), insert(11, "e.y", 1),
        )
    )
    assert keys(table) == {("new.a", "3"), ("d.b", "1"), ("d.t", "2"), ("d.b", "9"), ("e.y", "1")}
    version = table._manifest()["version"]
    run.apply_batch(entries(spark, command(12, "z", {"renameCollection": "z.none", "to": "z.nothing"})))
    assert table._manifest()["version"] == version + 1


def test_strict_writes(spark):
    rows = [(2, "i", "d.a", {"_id": 1, "v": 2}), (3, "i", "d.a", {"_id": 2, "v": 3}), (4, "u", "d.a", {"$set": {"v": 4}}, {"_id": 9}), (5, "u", "d.a", {"$set": {"w": 5}}, {"_id": 1}), (6, "i", "d.a", {"_id": 2, "v": 6}), (7, "d", "d.a", {"_id": 2}), (8, "i", "d.a", {"_id": 2, "v": 8})]
    want = {"SKIP": {("1", "v", "1"), ("1", "w", "5"), ("2", "v", "8")}, "UPSERT": {("1", "v", "2"), ("1", "w", "5"), ("2", "v", "8")}, "FAIL": {("1", "v", "1")}}
    for policy, fields in want.items():
        table, bad = MorTable(spark, work_path(spark, "sync")), []
        run = sync.Sync(spark, SyncConfig(write_mode="STRICT", on_conflict=policy), table, on_conflict=lambda df, bad=bad: bad.extend(r["ts_t"] for r in df.collect()))
        run.apply_batch(entries(spark, (1, "i", "d.a", {"_id": 1, "v": 1})))
        if policy == "FAIL":
            with pytest.raises(MigrationError, match="duplicate key 1"):
                run.apply_batch(entries(spark, *rows))
        else:
            run.apply_batch(entries(spark, *rows))
        assert {tuple(r)[1:] for r in scalar_fields(table.read()).collect()} == fields and sorted(bad) == [2, 6]


def test_what_a_run_refuses(spark, tmp_path):
    table = MorTable(spark, work_path(spark, "sync"))
    log = entries(spark, (5, "i", "d.a", {"_id": 1}), (6, "i", "d.a", {"v": 1}))
    run = sync.Sync(spark, SyncConfig(dead_letters=str(tmp_path / "dead")), table)
    with pytest.raises(MigrationError, match="HISTORY_LOST"):
        run.check_history(log, spark.createDataFrame([("s", 3, 1)], "shard string, start_t bigint, start_i bigint"))
    run.check_history(log, spark.createDataFrame([("s", 5, 1)], "shard string, start_t bigint, start_i bigint"))
    run.apply_batch(log, 0)
    assert [r["_error"] for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == ["no key"] and keys(table) == {("d.a", "1")}
    for config, act in ((SyncConfig(mode="FULL"), lambda r: r.apply_batch(log)), (SyncConfig(mode="INCREMENTAL"), lambda r: r.snapshot(log, 1)), (SyncConfig(capture_mode="CHANGE_STREAM"), lambda r: r.apply_batch(log))):
        with pytest.raises(MigrationError):
            act(sync.Sync(spark, config, table))
    calls = []

    def lost():
        calls.append(1)
        raise MigrationError(ErrorCode.HISTORY_LOST, "gone")

    with pytest.raises(MigrationError):
        run.run(lost, str(tmp_path / "c"))
    assert calls == [1]
    with pytest.raises(MigrationError, match="HISTORY_LOST"):
        run.run(lambda: log, str(tmp_path / "c"), history=(log, spark.createDataFrame([("s", 3, 1)], "shard string, start_t bigint, start_i bigint")))


def test_a_snapshot_leaves_out_what_ended_meanwhile(spark):
    table = MorTable(spark, work_path(spark, "sync"))
    docs = spark.createDataFrame([("d.a", "1", '{"_id":1}'), ("d.b", "1", '{"_id":1}'), ("e.x", "1", '{"_id":1}'), ("f.x", "1", '{"_id":1}')], "ns string, _id string, doc string")
    meanwhile = parse.log_ddl(entries(spark, (1, "c", "d.$cmd", {"drop": "a"}), (2, "c", "e.$cmd", {"dropDatabase": 1}), (3, "c", "f.$cmd", {"create": "y"})))
    sync.Sync(spark, SyncConfig(), table).snapshot(docs, 5, meanwhile)
    assert keys(table) == {("d.b", "1"), ("f.x", "1")}


def test_messages_of_a_change_stream(spark, small):
    table = MorTable(spark, work_path(spark, "sync"))
    changes = read_table(spark, small, "change_stream")
    sync.Sync(spark, SyncConfig(capture_mode="CHANGE_STREAM"), table).apply_batch(changes)
    whole = MorTable(spark, work_path(spark, "sync")).apply(parse.stream_events(changes, 0).where(namespace.accepted("ns")))
    assert keys(table) == keys(whole) and keys(table)


def test_verification_ends_with_a_code(spark, small):
    source, target, ns_map = (read_table(spark, small, t) for t in ("source_docs", "target_docs", "ns_map"))
    none = ns_map.limit(0)
    for mode, code in (("COUNT", 0), ("ID", 0), ("FULL", 0)):
        assert sync.verify_copies(source, source, none, SyncConfig(), mode)[1] == code
    report, code = sync.verify_copies(source, target, ns_map, SyncConfig(ignore_fields=["_class", "updatedAt"]))
    assert code == 1 and report.where("content_mismatch > 0").count()
    assert sync.verify_copies(source.limit(0), target.limit(0), ns_map, SyncConfig(), "ID")[1] == 2


def test_transit_values():
    doc = {"d": {"$date": "2024-01-01T00:00:00Z"}, "n": {"$date": {"$numberLong": "5"}}, "t": {"$timestamp": {"t": 3, "i": 9}}, "x": {"$numberDecimal": "1.10"}, "o": [{"$oid": "a" * 24}, {"b": {"$numberLong": "7"}}], "r": {"$regularExpression": {"pattern": "a.", "options": "i"}}, "z": {"$minKey": 1}, "bin": {"$binary": {"base64": "AA==", "subType": "04"}}, "c": {"$code": "f()", "$scope": {}}, "bad": {"$date": "no"}}
    assert transit.to_transit(doc) == {"d": 1704067200000, "n": 5, "t": 3000, "x": "1.10", "o": ["a" * 24, {"b": 7}], "r": "a.", "z": None, "bin": "AA==", "c": "f()", "bad": None}
    assert transit.from_transit({"_id": "b" * 24, "x": "c" * 24}) == {"_id": {"$oid": "b" * 24}, "x": "c" * 24} and transit.from_transit({"_id": "b"}) == {"_id": "b"}


def test_functions_in_sql(spark):
    register_functions(spark)
    row = spark.sql("""SELECT tm_java_hash('hello world') AS h, tm_bucket('hello world', 16) AS b, tm_bucket(NULL, 16) AS n, tm_java_hash('') AS e,
        tm_normalise_update('{"$v":2,"diff":{"u":{"a":1}}}') AS u, tm_transit('{"a":{"$numberLong":"3"}}') AS t""").first()
    assert (row["h"], row["b"], row["n"], row["e"]) == (1794106052, 4, 0, 0) and json.loads(row["u"]) == {"$set": {"a": 1}} and json.loads(row["t"]) == {"a": 3}


def test_error_texts_and_codes(spark):
    df = spark.createDataFrame([("Ns Not Found", 136), ("other", 1), (None, None)], "m string, c int")
    assert [r[0] for r in df.select(namespace.is_gone("m")).collect()] == [True, False, None]
    assert [r[0] for r in df.select(namespace.is_gone("m", F.lit(26))).collect()] == [True, True, True]
    assert [r[0] for r in df.select(namespace.is_history_lost("c")).collect()] == [True, False, None]


def test_schema_changes_in_the_catalog(spark, tmp_path):
    rows = [("CREATE_COLLECTION", "tmt_a", "x", None, 1), ("CREATE_COLLECTION", "tmt_a", "y", None, 2), ("RENAME_COLLECTION", "tmt_a", "x", "tmt_a.z", 3), ("RENAME_COLLECTION", "tmt_a", "y", "tmt_b.y", 4), ("DROP_COLLECTION", "tmt_a", "z", None, 5), ("CREATE_INDEXES", "tmt_a", "z", None, 6)]
    changes = spark.createDataFrame([(*r, 1) for r in rows], "ddl_type string, database string, collection string, target string, ts_t bigint, ts_i bigint")
    ddl.apply_to_catalog(spark, changes, f"file://{tmp_path}")
    tables = lambda db: [t.name for t in spark.catalog.listTables(db) if not t.isTemporary]
    assert not tables("tmt_a") and tables("tmt_b") == ["y"]
    gone = changes.limit(1).withColumn("ddl_type", F.lit("DROP_DATABASE"))
    ddl.apply_to_catalog(spark, gone)
    ddl.apply_to_catalog(spark, gone.withColumn("database", F.lit("tmt_b")))
    assert not spark.catalog.databaseExists("tmt_a") and not spark.catalog.databaseExists("tmt_b")
