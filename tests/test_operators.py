"""Small cases of the operators, and random logs against a sequential interpreter."""

import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.operators import ddl, fold, namespace, parse, routing, structure, verify
from tidemark.operators.mor_table import State, apply_change, flatten
from tidemark.operators.parse import diff_operators, normalise_update
from tidemark.sources import capability, feeds


def test_update_forms():
    cases = {
        '{"$v":1,"$set":{"a":1}}': {"$set": {"a": 1}},
        '{"_id":1,"a":2}': {"_id": 1, "a": 2},
        '{"$v":2,"diff":{"d":{"b":false},"u":{"a":2},"i":{"d":1}}}': {"$set": {"a": 2, "d": 1}, "$unset": {"b": False}},
        '{"$v":2,"diff":{"ssize":{"u":{"h":9}}}}': {"$set": {"size.h": 9}},
        '{"$v":2,"diff":{"stags":{"a":true,"u0":"x","u12":{"y":1}}}}': {"$set": {"tags.0": "x", "tags.12": {"y": 1}}},
        '{"$v":2,"diff":{"stags":{"a":true,"l":1}}}': {"$set": {}},
        '{"$v":2,"diff":{"sa":{"sb":{"sc":{"d":{"e":false}}}}}}': {"$unset": {"a.b.c.e": False}},
    }
    for text, want in cases.items():
        assert json.loads(normalise_update(text)) == want
    assert normalise_update("no json") == "no json" and normalise_update(None) is None
    assert diff_operators({"u": {"ab": 1}, "ux": 2}) == ({"ab": 1}, {})


def test_range_predicates(spark):
    df = spark.createDataFrame([(x, 2) for x in "abmyz"] + [("m", 7)], "_id string, id_type int")
    ids = lambda p: sorted(r["_id"] for r in df.where(p).collect())
    assert ids(feeds.range_predicate("a", "z", False, 2)) == list("abmy")
    assert ids(feeds.range_predicate("a", "z", True, 2)) == list("abmyz")
    assert len(ids(feeds.range_predicate())) == 6


def test_capture_modes(spark):
    def resolved(requested, topology, version, incremental=True):
        df = spark.createDataFrame([(requested, topology, version, incremental)], "requested string, topology string, version string, incremental boolean")
        return df.select(capability.capture_mode()).first()[0]

    assert resolved("AUTO", "REPLICA_SET", "4.4.0") == "CHANGE_STREAM"
    assert resolved("AUTO", "REPLICA_SET", "3.4.24") == "OPLOG"
    assert resolved("AUTO", "SHARDING", "4.4.0") == "CHANGE_STREAM"
    assert "ChangeStream" in resolved("AUTO", "SHARDING", "3.4.24")
    assert "multi-shard OPLOG" in resolved("OPLOG", "SHARDING", "4.4.0")
    assert resolved("OPLOG", "REPLICA_SET", "4.4.0") == "OPLOG"


def test_namespace_rules(spark):
    df = spark.createDataFrame([("shop.a",), ("Admin.x",), ("shop.system.views",), (None,), ("crm.b",), ("nodot",)], "ns string")
    keep = lambda **kw: {r["ns"] for r in df.where(namespace.accepted("ns", **kw)).collect()}
    assert keep() == {"shop.a", "crm.b", "nodot"} and keep(white="shop") == {"shop.a"} and keep(black="crm.b; ") == {"shop.a", "nodot"}
    with pytest.raises(ValueError):
        namespace.accepted("ns", white="a", black="b")


def test_hash_of_any_text(spark):
    texts = ["", "0", "149", "hello world", "żółć", "中文", "😀x", "a" * 500, None]

    def java(s):
        h = 0
        for k in range(0, len(b := s.encode("utf-16-be")), 2):
            h = (h * 31 + int.from_bytes(b[k : k + 2], "big")) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", routing.java_hash("t").alias("h"), routing.bucket("t", 16).alias("b")).collect()
    for r in rows:
        assert r["h"] == (None if r["t"] is None else java(r["t"])) and r["b"] == (0 if r["t"] is None else java(r["t"]) % 16)


def test_fail_policy_raises(spark):
    feed = spark.createDataFrame([("n", "1", "c", False, 1, 1, 1, k, k, "x") for k in (1, 2)], "ns string, _id string, op string, is_patch boolean, value int, k int, phase int, ts_t bigint, seq bigint, event_type string").withColumn("ts_i", F.col("seq"))
    fields = {"value": (F.lit(False), F.lit(False))}
    with pytest.raises(Exception, match="duplicate key 1"):
        fold.strict(feed, fields, "FAIL").collect()
    assert fold.strict(feed, fields, "SKIP").count() == 1


def test_required_lookup_fails_on_a_miss(spark):
    events = spark.createDataFrame([("1",), ("2",)], "_id string")
    now = spark.createDataFrame([(1, "a")], "id int, name string")
    assert feeds.update_lookup(events, now, "_id", "id").where("full is null").count() == 1
    assert feeds.update_lookup(events, now, "_id", "id", "DEFAULT").where("full is null").count() == 2
    with pytest.raises(Exception, match="no current document"):
        feeds.update_lookup(events, now, "_id", "id", "REQUIRED").collect()


def test_rename_cycle_ends(spark):
    renames = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "source string, target string")
    assert {tuple(r) for r in ddl.rename_chain(renames).collect()} == {("a", "c"), ("b", "c"), ("x", "y")}
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string")
    assert ddl.rename_chain(cycle, rounds=3).count() == 2


def test_canonical_text(spark):
    df = spark.createDataFrame([('{"a":1.0,"b":{"y":[1,2.50],"x":"1"},"_class":"Z","n":null}',), ('{"n":null,"b":{"x":"1","y":[1.0,2.5]},"a":1}',), ('{"n":null,"b":{"x":1,"y":[1.0,2.5]},"a":1}',), ("text",), (None,)], "d string")
    a, b, c, d, e = (r[0] for r in df.select(verify.canonical_text("d", ("_class",))).collect())
    assert a == b != c and d == "text" and e is None
    a, b, c, _, _ = (r[0] for r in df.select(verify.exact_digest("d", ("_class",))).collect())
    assert a == b != c


def test_log_lines_and_tokens(spark):
    df = spark.createDataFrame([("a b", "x" * 130, 'q"'), (None, "y" * 120, "ok")], "a string, t string, q string")
    rows = df.select(parse.log_line(a=F.col("a"), q=F.col("q")), parse.token_digest("t")).collect()
    assert rows[0][0] == 'a="a b" q="q\\""' and rows[1][0] == 'a="" q=ok'
    odd = spark.createDataFrame([(" (x) ", "a\\b")], "a string, q string").select(parse.log_line(a=F.col("a"), q=F.col("q"))).first()[0]
    assert odd == 'a=(x) q="a\\\\b"'
    assert len(rows[0][1]) == 120 and rows[0][1].endswith("...") and rows[1][1] == "y" * 120


PATHS = st.sampled_from(["a", "b", "o", "o.x", "o.y", "o.x.z", "l"])
VALUES = st.recursive(st.integers(0, 3) | st.sampled_from(["s", "t"]) | st.none(), lambda v: st.dictionaries(st.sampled_from("xyz"), v, max_size=2), max_leaves=3)
CHANGES = st.one_of(
    st.tuples(st.just("c"), st.dictionaries(st.sampled_from("abo"), VALUES, max_size=3)),
    st.tuples(st.just("d"), st.none()),
    st.tuples(st.just("u"), st.builds(lambda p, v: {"$set": {p: v}}, PATHS, VALUES)),
    st.tuples(st.just("u"), st.builds(lambda p: {"$unset": {p: True}}, PATHS)),
)


def leaves_of(state):
    state.replay()
    return dict(state.taken_apart()) if state.alive else None


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(CHANGES, max_size=9), st.randoms(), st.integers(1, 4))
def test_folding_in_any_order_and_any_batches(changes, random, batches):
    """Folded one by one in order; or shuffled, repeated, cut into batches, each merged into the image of the ones before."""
    want = State()
    docs = None
    for k, (op, doc) in enumerate(changes):
        apply_change(want, op, (1, k, 1), doc, json.dumps(doc))
        if op == "d":
            docs = None
        elif op == "c":
            docs = flatten(doc)
        else:
            docs = {} if docs is None else docs
            (path, value), = (doc.get("$set") or doc["$unset"]).items()
            docs = {p: v for p, v in docs.items() if p != path and not p.startswith(path + ".")}
            if "$set" in doc:
                docs = {p: v for p, v in docs.items() if not path.startswith(p + ".")} | flatten({path: value})
    assert leaves_of(want) == docs
    arrived = [(k, *c) for k, c in enumerate(changes)] * 2
    random.shuffle(arrived)
    image = State()
    for b in range(batches):
        part = State()
        for k, op, doc in arrived[b::batches]:
            apply_change(part, op, (1, k, 1), doc, json.dumps(doc))
        first, second = (image, part) if random.random() < 0.5 else (part, image)
        joined = State()
        joined.merge(first)
        joined.merge(second)
        joined.replay()
        image = State()
        image.reset, image.alive, image.fields = joined.reset, joined.alive, dict(joined.taken_apart()) if joined.alive else {}
        image.load_ops(joined.ops_text())
    assert (image.taken_apart() if image.alive else None) == docs


def command_log(spark, *rows):
    return spark.createDataFrame([(k, op, ns, json.dumps(o), (k, 1)) for k, (op, ns, o) in enumerate(rows)], "entry_id bigint, op string, ns string, o string, ts struct<t:bigint,i:bigint>")


def test_every_index_of_a_command_counts(spark):
    log = command_log(
        spark,
        ("c", "d.$cmd", {"createIndexes": "a", "indexes": [{"key": {"x": 1}, "name": "x_1", "unique": True}, {"key": {"y": 1}, "name": "y_1", "expireAfterSeconds": 5}]}),
        ("i", "d.system.indexes", {"ns": "d.a", "key": {"z": 1}, "name": 'q"z', "unique": True, "sparse": True}),
        ("c", "d.$cmd", {"dropIndexes": "a", "index": ["x_1", "y_1"]}),
        ("c", "d.$cmd", {"dropIndexes": "a", "index": "*"}),
        ("c", "d.$cmd", {"drop": "a"}),
    )
    rows = [(r["entry_id"], r["ddl_type"], r["index_name"]) for r in parse.log_ddl(log).orderBy("entry_id", "index_name").collect()]
    assert rows == [(0, "CREATE_INDEXES", "x_1"), (0, "CREATE_INDEXES", "y_1"), (1, "CREATE_INDEXES", 'q"z'), (2, "DROP_INDEXES", "x_1"), (2, "DROP_INDEXES", "y_1"), (3, "DROP_INDEXES", "*"), (4, "DROP_COLLECTION", None)]
    command = json.loads(parse.index_command(log).first()["command"])
    assert command == {"createIndexes": "a", "indexes": [{"key": {"z": 1}, "name": 'q"z', "unique": True, "sparse": True}]}
    specs = {r["name"]: r for r in parse.index_specs(log).collect()}
    assert specs["x_1"]["is_unique"] and not specs["y_1"]["is_unique"] and specs["y_1"]["expire_seconds"] == 5 and specs['q"z']["sparse"]
    plan = ddl.index_plan(parse.index_specs(log).select("ns", "name", F.col("expire_seconds").isNotNull().alias("expires")), spark.createDataFrame([], "ns string, name string"))
    assert {r["name"] for r in plan.collect()} == {"x_1", 'q"z'}


def test_unique_indexes_over_time(spark):
    build = lambda name, unique=True: ("c", "d.$cmd", {"createIndexes": "a", "indexes": [{"key": {"k": 1}, "name": name, "unique": unique}]})
    drop = lambda name: ("c", "d.$cmd", {"dropIndexes": "a", "index": name})
    log = command_log(spark, build("p"), build("q"), drop("p"), build("r", False), drop("q"), build("p"), drop("*"), build("s"), ("c", "d.$cmd", {"dropDatabase": 1}), build("t"), ("c", "d.$cmd", {"renameCollection": "d.a", "to": "d.b"}))
    rows = routing.unique_timeline(parse.log_ddl(log), parse.index_specs(log)).orderBy("entry_id").collect()
    assert [r["unique_now"] for r in rows] == [True, True, True, True, False, True, False, True, False, True, False]


def test_schema_changes_of_a_stream_as_commands(spark):
    rows = [(1, "rename", "d.a", "d.b", None), (2, "createIndexes", "d.a", None, '{"indexes":[{"key":{"x":1},"name":"x_1","unique":true},{"key":{"y":1},"name":"y_1"}]}'), (3, "dropIndexes", "d.a", None, '{"indexes":[{"name":"x_1"}]}'), (4, "dropDatabase", "d", None, None), (5, "invalidate", None, None, None), (6, "drop", 'd.q"', None, None)]
    df = spark.createDataFrame([(*r, (7, 1)) for r in rows], "delivery_id bigint, operation_type string, ns string, to_ns string, operation_description string, cluster_time struct<t:bigint,i:bigint>")
    found = [(r["delivery_id"], r["target"], r["index_name"], json.loads(r["command"])) for r in parse.stream_ddl(df).orderBy("delivery_id", "index_name").collect()]
    assert found == [
        (1, "d.b", None, {"renameCollection": "d.a", "to": "d.b"}), (2, None, "x_1", {"createIndexes": "a", "indexes": [{"key": {"x": 1}, "name": "x_1", "unique": True}]}), (2, None, "y_1", {"createIndexes": "a", "indexes": [{"key": {"y": 1}, "name": "y_1"}]}),
        (3, None, "x_1", {"dropIndexes": "a", "index": "x_1"}), (4, None, None, {"dropDatabase": 1}), (6, None, None, {"drop": 'q"'}),
    ]


def test_a_rename_without_a_target(spark):
    plain = spark.createDataFrame([(1, "rename", "d.a", (7, 1))], "delivery_id bigint, operation_type string, ns string, cluster_time struct<t:bigint,i:bigint>")
    assert parse.stream_ddl(plain).first()["command"] is None
    with pytest.raises(Exception, match="a rename without a target"):
        parse.stream_ddl(plain.withColumn("to_ns", F.lit(None).cast("string"))).collect()


def test_segments_against_a_count(spark):
    import random

    rng = random.Random(3)
    marks = [("d", rng.choice("ab"), rng.randint(1, 40), rng.randint(1, 2)) for _ in range(60)]
    events = [(f"d.{rng.choice('abc')}", rng.randint(1, 40), rng.randint(1, 2), k) for k in range(400)] + [(None, 1, 1, 999)]
    got = ddl.segments(spark.createDataFrame(events, "ns string, ts_t bigint, ts_i bigint, n int"), spark.createDataFrame(marks, "database string, collection string, ts_t bigint, ts_i bigint"))
    want = {(*e, sum(f"{d}.{c}" == e[0] and (t, i) <= e[1:3] for d, c, t, i in marks)) for e in events}
    assert {tuple(r) for r in got.collect()} == want


def test_namespaces_that_end(spark):
    rows = spark.createDataFrame([(1, "DROP_COLLECTION", "d", "a", None), (2, "RENAME_COLLECTION", "d", "b", "e.c"), (3, "DROP_DATABASE", "d", None, None), (4, "CREATE_INDEXES", "d", "a", None)], "entry_id int, ddl_type string, database string, collection string, target string")
    known = spark.createDataFrame([("d.a", "d"), ("d.z", "d"), ("e.c", "e")], "ns string, db string")
    assert {(r["entry_id"], r["ns"]) for r in namespace.endings(rows, known).collect()} == {(1, "d.a"), (2, "d.b"), (2, "e.c"), (3, "d.a"), (3, "d.z")}


def test_structure_that_a_target_lacks(spark):
    log = command_log(
        spark,
        ("c", "d.$cmd", {"create": "a", "capped": True, "size": 4096, "max": 9, "validator": {"x": {"$gt": 1}}, "collation": {"locale": "de", "strength": 2, "backwards": False}, "idIndex": {"v": 2}}),
        ("c", "d.$cmd", {"create": "t", "timeseries": {"timeField": "at", "metaField": "m", "granularity": "hours"}, "expireAfterSeconds": 60.0}),
        ("c", "d.$cmd", {"create": "v", "viewOn": "a", "pipeline": [{"$match": {"x": 1}}]}),
        ("c", "d.$cmd", {"create": "there"}),
        ("c", "d.$cmd", {"createIndexes": "a", "indexes": [{"key": {"x": 1}, "name": "x_1", "weights": {"x": 2}, "collation": {"locale": "fr"}}, {"key": {"y": 1}, "name": "y_1", "expireAfterSeconds": 5}, {"key": {"_id": 1}, "name": "_id_"}, {"key": {"z": 1}, "name": "z_1"}]}),
    )
    made = {r["ns"]: r for r in structure.collections(log).collect()}
    a = made["d.a"]
    assert (a["kind"], a["capped"], a["size"], a["max"], json.loads(a["validator"])) == ("collection", True, 4096, 9, {"x": {"$gt": 1}}) and a["collation"].asDict() == {"locale": "de", "caseLevel": None, "caseFirst": None, "strength": 2, "numericOrdering": None, "alternate": None, "maxVariable": None, "normalization": None, "backwards": False}
    assert "idIndex" not in a["options"] and (made["d.t"]["time_field"], made["d.t"]["granularity"], made["d.t"]["expire_seconds"]) == ("at", "HOURS", 60) and made["d.v"]["kind"] == "view"
    specs = parse.index_specs(log)
    assert json.loads(specs.where("name = 'x_1'").first()["spec"])["weights"] == {"x": 2} and specs.where("name = 'x_1'").first()["collation"] == "fr"
    existing = spark.createDataFrame([("d.there",)], "ns string")
    plan = structure.missing(structure.collections(log), specs, existing, spark.createDataFrame([("d.a", "z_1")], "ns string, name string"))
    assert [(r["action"], r["ns"], r["name"]) for r in plan.orderBy("step", "ns").collect()] == [("CREATE_COLLECTION", "d.a", None), ("CREATE_COLLECTION", "d.t", None), ("CREATE_INDEX", "d.a", "x_1"), ("CREATE_VIEW", "d.v", None)]
    broken = spark.createDataFrame([("d.v", "view", "{}")], "ns string, kind string, options string")
    with pytest.raises(Exception, match="a view needs"):
        structure.missing(broken, specs, existing, specs).collect()


@pytest.mark.parametrize("per_slice", [4, 1])
def test_hot_keys_under_strict_writes(spark, per_slice):
    """A key with most of the feed, cut into slices of a few rows, comes out as without cuts; pre-images likewise."""
    import random

    rng = random.Random(11)
    rows = [("n", "hot" if rng.random() < 0.7 else rng.choice("ab"), rng.choice("ccudduur"), 0 if k == 0 else 1, rng.randint(1, 30), k, k) for k in range(300)]
    rows.append((None, None, "c", 1, 5, 999, 999))
    feed = spark.createDataFrame([(*r, r[1] == "a") for r in rows], "ns string, _id string, op string, phase int, ts_t bigint, ts_i bigint, seq bigint, there boolean")
    for policy, there in (("SKIP", None), ("UPSERT", "there")):
        cut, whole = (fold.effective(feed, policy, there, **kw).select("seq", "epoch", "effective", "conflict").collect() for kw in ({"rows_per_slice": per_slice}, {"split": False}))
        assert sorted(cut) == sorted(whole)
    by = {}
    for r in sorted(rows, key=lambda r: r[3:7]):
        by.setdefault(r[:2], []).append(r)
    want = {b[6]: a[2] for rs in by.values() for a, b in zip(rs, rs[1:])}
    got = {r["seq"]: r["before"]["op"] for r in fold.pre_image(feed, ["op"], per_slice).where("before is not null").collect()}
    assert got == want
