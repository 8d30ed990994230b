"""The data problems against sequential versions, over whole tables and over unusual ones."""

import datetime
import json

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.operators import compare, dedup, drift, incremental, mor_table, skew, slices
from tidemark.session import read_table, work_path


def got(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


# p1


def pending(oplog, changes, runs, **kw):
    return incremental.pending_positions(incremental.landed_positions(incremental.landed_rows(oplog, changes)), incremental.committed_runs(runs, changes), **kw)


@pytest.mark.parametrize("per_slice", [incremental.SLICE_ROWS, 7])
def test_pending_positions(spark, small, rows, per_slice):
    o, c, r = (read_table(spark, small, t) for t in ("oplog_entries", "change_stream", "sync_runs"))
    assert got(pending(o, c, r, rows_per_slice=per_slice)) == brute.pending(rows("oplog_entries"), rows("change_stream"), rows("sync_runs"))


def test_a_run_takes_the_pending_positions(spark, small, rows, shape):
    name, change = shape
    o, c, r = (change(read_table(spark, small, t)) for t in ("oplog_entries", "change_stream", "sync_runs"))
    want = set() if name == "empty" else brute.pending(rows("oplog_entries"), rows("change_stream"), rows("sync_runs"))
    runner = incremental.IncrementalRunner(spark, work_path(spark, "runs"))
    journal = incremental.committed_runs(r, c)
    limit = runner.take(o, c, journal)
    assert (got(runner.output()) == want) if limit is not None else not want
    assert runner.take(o, c, journal) is None


def at_hour(h):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)


def test_a_broken_run_is_taken_again_and_later_rows_by_the_next_run(spark):
    schema = "shard string, ts struct<t:bigint,i:bigint>, landed_at timestamp_ntz"
    first = [("s", (t, 1), at_hour(0)) for t in range(1, 6)]
    second = first + [("s", (3, 1), at_hour(1)), ("s", (2, 5), at_hour(1)), ("s", (9, 1), at_hour(1))]
    landed = lambda rows: (spark.createDataFrame(rows, schema), None)
    journal = spark.createDataFrame([], incremental._JOURNAL)
    runner = incremental.IncrementalRunner(spark, work_path(spark, "runs"))

    def broken():
        raise OSError("lost")

    with pytest.raises(OSError):
        runner.take(*landed(first), journal, broken)
    assert runner.output() is None and runner.watermark() is None
    runner.take(*landed(first), journal)
    runner.take(*landed(second), journal)
    assert sorted((r["pos_t"], r["pos_i"]) for r in runner.output().collect()) == [(1, 1), (2, 1), (2, 5), (3, 1), (4, 1), (5, 1), (9, 1)]


def test_runs_in_parts_take_what_one_run_takes(spark, small, rows):
    """Rows as they land in four parts, a run after each: every position once, and those of all rows at the end."""
    o, c, r = (read_table(spark, small, t) for t in ("oplog_entries", "change_stream", "sync_runs"))
    runner = incremental.IncrementalRunner(spark, work_path(spark, "runs"))
    at = F.unix_micros(F.col("landed_at").cast("timestamp"))
    cuts = o.select("landed_at").unionByName(c.select("landed_at")).agg(F.percentile_approx(at, [0.25, 0.5, 0.75])).first()[0]
    nobody = spark.createDataFrame([], incremental._JOURNAL)
    for cut in (*cuts, 1 << 62):
        runner.take(o.where(at <= cut), c.where(at <= cut), nobody)
    assert got(runner.output()) == brute.pending(rows("oplog_entries"), rows("change_stream"), [])
    late = incremental._landed_after(o, cuts[1])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(landed_at" in late


def test_outliers_and_bursts_are_cut(spark):
    """An entry at position 1 far from the rest, and a burst within one second, leave slices of about the same size."""
    rows = spark.range(20_000).select(F.lit("s").alias("shard"), F.lit("OPLOG").alias("capture_mode"), F.when(F.col("id") == 0, 1).when(F.col("id") < 8000, 1_700_000_000).otherwise(1_700_000_000 + F.col("id")).cast("bigint").alias("pos_t"), F.col("id").alias("pos_i")).withColumn("_at", slices.ordinal("pos_t", "pos_i"))
    cuts = slices.find_cuts(rows, incremental.KEYS, "_at", 20_000, 1000)
    sizes = [r["count"] for r in slices.with_slice(rows, cuts, incremental.KEYS, F.col("_at")).groupBy("slice").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 2500


def test_offsets_that_cannot_be_read_cover_nothing(spark):
    at = datetime.datetime(2024, 1, 1)
    log = spark.createDataFrame([("s", (5, 1), at), ("s", (6, 1), at)], "shard string, ts struct<t:bigint,i:bigint>, landed_at timestamp_ntz")
    later = at + datetime.timedelta(hours=1)
    schema = "run_id bigint, shard string, capture_mode string, run_state string, start_offset string, end_offset string, read_at timestamp_ntz, logged_at timestamp_ntz"
    for start, end, left in ((None, "5:1", {6}), ("nonsense", "9:9", {5, 6}), (None, None, {5, 6}), (None, '{"$timestamp": {"i": 1, "t": 6}}', set()), ("5:1", "6:1", {5})):
        runs = spark.createDataFrame([(1, "s", "OPLOG", "COMMITTED", start, end, later, later)], schema)
        found = incremental.pending_positions(incremental.landed_positions(incremental.landed_rows(log, None)), incremental.committed_runs(runs))
        assert {r["pos_t"] for r in found.collect()} == left


def test_tokens_of_another_form_are_looked_up(spark):
    at = datetime.datetime(2024, 1, 1)
    changes = spark.createDataFrame([("s", "AB01", (5, 1), at), ("s", "AB02", (6, 1), at)], "shard string, _id string, cluster_time struct<t:bigint,i:bigint>, landed_at timestamp_ntz")
    runs = spark.createDataFrame([(1, "s", "CHANGE_STREAM", "COMMITTED", None, '{"_data": "ab01"}', at, at)], "run_id bigint, shard string, capture_mode string, run_state string, start_offset string, end_offset string, read_at timestamp_ntz, logged_at timestamp_ntz")
    found = incremental.pending_positions(incremental.landed_positions(incremental.landed_rows(None, changes)), incremental.committed_runs(runs, changes))
    assert {r["pos_t"] for r in found.collect()} == {6}


def test_runner_neither_skips_nor_repeats(spark, small, monkeypatch):
    monkeypatch.setattr(incremental, "MOST_SEGMENTS", 1)
    table = read_table(spark, small, "oplog_entries").select("entry_id", "shard", "ts", "landed_at")
    log = incremental.CommitLog(spark, work_path(spark, "log"))
    runner = incremental.IncrementalRunner(spark, work_path(spark, "runs"))
    assert runner.run(log, lambda df: df) is None
    part = lambda k: table.where(F.pmod(F.xxhash64("entry_id"), F.lit(3)) == k)

    def broken():
        raise OSError("lost")

    assert log.append(part(0)) == 1
    with pytest.raises(OSError):
        runner.run(log, lambda df: df, before_commit=broken)
    assert runner.output() is None and runner.watermark() is None
    assert runner.run(log, lambda df: df) == 1
    log.append(part(1))
    log.append(part(2))
    with pytest.raises(OSError):
        runner.run(log, lambda df: df, before_commit=broken)
    assert runner.run(log, lambda df: df) == 3
    assert runner.run(log, lambda df: df) is None
    out = runner.output()
    assert out.count() == out.select("shard", "ts").distinct().count() == table.select("shard", "ts").distinct().count()


def test_what_becomes_visible_later_is_never_skipped(spark):
    """A row with the oldest landing and position of all, appended after a run, is processed by the next; only new commits are read."""
    schema = "shard string, ts struct<t:bigint,i:bigint>, landed_at timestamp_ntz"
    log = incremental.CommitLog(spark, work_path(spark, "log"))
    runner = incremental.IncrementalRunner(spark, work_path(spark, "runs"))
    log.append(spark.createDataFrame([("s", (5, 1), at_hour(5)), ("s", (6, 1), at_hour(6))], schema))
    runner.run(log, lambda df: df)
    log.append(spark.createDataFrame([("s", (1, 1), at_hour(0)), ("s", (5, 1), at_hour(9)), (None, (1, 1), at_hour(0)), ("s", None, at_hour(0))], schema))
    read = []
    runner.run(log, lambda df: read.append(sorted(r["ts"]["t"] for r in df.collect())) or df)
    assert read == [[1]] and sorted(r["ts"]["t"] for r in runner.output().collect()) == [1, 5, 6]
    assert len(log.read(1, 2).inputFiles()) < len(log.read(0, 2).inputFiles())


# p2


def test_differences(spark, small, rows, shape):
    name, change = shape
    s, t, m = (read_table(spark, small, x) for x in ("source_docs", "target_docs", "ns_map"))
    found = got(compare.compare(change(s), compare.to_source_ns(change(t), m)))
    assert found == (set() if name == "empty" else brute.differences(rows("source_docs"), rows("target_docs"), rows("ns_map")))


def docs(spark, *rows):
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(ns, i, k, d, at + datetime.timedelta(seconds=n)) for n, (ns, i, k, d) in enumerate(rows)], "ns string, _id string, id_type int, doc string, copied_at timestamp_ntz")


def test_differences_field_by_field(spark):
    a = {"n": 1, "big": 9007199254740993, "t": {"$date": "x"}, "o": {"p": 1, "q": {"r": 1}}, "l": [1, {"a": 1, "b": 2}], "nil": None, "b": True, "s": "1", "only": {"x": 1}, "_class": "A", "e": {}}
    b = {"n": 1.0, "big": 9007199254740992, "t": {"$date": "y"}, "o": {"p": 2, "q": {"r": 1.0}}, "l": [1.0, {"b": 2, "a": 1}], "b": 1, "s": 1, "updatedAt": 5, "e": {"z": 1}}
    found = got(compare.compare(docs(spark, ("n", "1", 2, json.dumps(a))), docs(spark, ("n", "1", 2, json.dumps(b)))))
    assert {f[4] for f in found} == {"t", "o.p", "nil", "b", "s", "only", "e.z"} and {f[3] for f in found} == {"contentMismatch"}


def test_texts_that_are_no_objects_differ_as_a_whole(spark):
    source = docs(spark, ("n", "1", 2, "broken"), ("n", "2", 2, "broken"), ("n", "3", 2, '{"a": 1}'), ("n", "4", 2, None), ("n", "5", 2, "[1]"))
    target = docs(spark, ("n", "1", 2, "damaged"), ("n", "2", 2, "broken"), ("n", "3", 2, "broken"), ("n", "4", 2, '{"a": 1}'), ("n", "5", 2, "[2]"))
    assert {r[1:] for r in got(compare.compare(source, target))} == {("1", 2, "contentMismatch", ""), ("3", 2, "contentMismatch", ""), ("4", 2, "contentMismatch", "a"), ("5", 2, "contentMismatch", "")}


def test_newest_copy_counts_and_nulls_are_keys(spark):
    long = json.dumps({"x": "y" * 200_000})
    source = docs(spark, ("n", "1", 2, long), (None, None, None, None), ("n", "2", 2, "broken"))
    target = docs(spark, *[("n", "1", 2, '{"x": 1}')] * 50, ("n", "1", 2, long), (None, None, None, "{}"), ("n", "1", 7, long))
    assert got(compare.compare(source, target)) == {("n", "2", 2, "missingOnTarget", ""), ("n", "1", 7, "missingOnSource", "")}
    assert got(compare.compare(source, docs(spark, ("n", "1", 2, "{}")), content=False)) == {("n", "2", 2, "missingOnTarget", ""), (None, None, None, "missingOnTarget", "")}


# p3


def current(spark, *batches):
    table = mor_table.MorTable(spark, work_path(spark, "mor"))
    for b in batches:
        table.apply(b)
    return table


def test_current_documents(spark, small, rows, shape):
    name, change = shape
    e = change(read_table(spark, small, "transfer_events"))
    table = current(spark, e.where("phase = 0"), e.where("phase is null or phase <> 0"))
    assert got(mor_table.scalar_fields(table.read())) == (set() if name == "empty" else brute.current(rows("transfer_events")))


def test_any_batching_gives_the_same_documents(spark, small, rows):
    e = read_table(spark, small, "transfer_events")
    parts = [e.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == k) for k in range(4)]
    table = current(spark, *parts, parts[2])
    assert got(mor_table.scalar_fields(table.read())) == brute.current(rows("transfer_events"))


def events(spark, *rows):
    return spark.createDataFrame([(s, ns, op, b and json.dumps(b), a and json.dumps(a), p, t, i) for s, (ns, op, b, a, p, t, i) in enumerate(rows)], "seq bigint, ns string, op string, before_doc string, after_doc string, phase int, ts_t bigint, ts_i bigint")


PATCHES = [
    ("n", "r", None, {"_id": 1, "a": 1, "o": {"x": 1, "y": "q\"\\\n"}}, 0, 9, 1),
    ("n", "u", {"_id": 1}, {"$set": {"o.x": 2.50, "new.deep.er": None}}, 1, 1, 1),
    ("n", "u", {"_id": 1}, {"$set": {"o": {"z": True}}, "$unset": {"a": True}}, 1, 3, 1),
    ("n", "u", {"_id": 1}, {"$set": {"o.w": "t", "a.b": 1}}, 1, 4, 1),
    ("n", "u", {"_id": 1}, {"$set": {}}, 1, 5, 1),
    ("n", "u", {"_id": 2}, {"$set": {"k": 1}}, 1, 6, 1),
    ("n", "d", {"_id": 3}, None, 1, 6, 2),
    ("n", "u", {"_id": 3}, {"$set": {}}, 1, 7, 1),
    ("n", "x", {"_id": 4}, {"_id": 4, "v": 1}, 1, 7, 2),
    ("n", None, None, {"_id": 4, "v": 1}, 1, 7, 3),
    ("n", "c", None, {"_id": 5, "l": "x" * 100_000}, 1, 8, 1),
    ("n", "d", {"_id": 5}, None, 1, 8, 2),
    ("n", "u", {"_id": 5}, {"$set": {"back": 1}}, 1, 8, 3),
    ("n", "u", None, {"v": 1}, 1, 9, 9),
]


@pytest.mark.parametrize("order", [1, -1])
def test_patches_in_any_order_of_arrival(spark, order):
    rows = PATCHES[::order]
    want = {("n", "1", "o.z", "true"), ("n", "1", "o.w", "t"), ("n", "1", "new.deep.er", "null"), ("n", "1", "a.b", "1"), ("n", "2", "k", "1"), ("n", "5", "back", "1")}
    one = current(spark, events(spark, *rows))
    each = current(spark, *(events(spark, *rows[k : k + 4]) for k in range(0, len(rows), 4)))
    assert got(mor_table.scalar_fields(one.read())) == want == got(mor_table.scalar_fields(each.read()))


def test_unset_below_a_scalar_that_a_set_removed(spark):
    rows = [("n", "c", None, {"_id": 1, "a": 5}, 1, 1, 1), ("n", "u", {"_id": 1}, {"$set": {"a.b": 1}}, 1, 2, 1), ("n", "u", {"_id": 1}, {"$unset": {"a.b": 1}}, 1, 3, 1)]
    for batches in ([rows], [rows[:1], rows[1:2], rows[2:]], [rows[2:], rows[1:2], rows[:1]], [rows[::2], rows[1:2]]):
        table = current(spark, *(events(spark, *b) for b in batches))
        assert [r["fields"] for r in table.read().collect()] == [{}]


PATHS = ("a", "a.b", "a.b.c", "a.d", "e")


def random_changes(rng, n):
    """Changes of one document, its paths lying above and below each other."""
    out = []
    for t in range(1, n + 1):
        kind = rng.random()
        value = lambda: rng.choice([1, "x", None, {"b": 2}, {"b": {"c": 3}}, {}, [1]])
        if kind < 0.1:
            out.append(("d", t, None))
        elif kind < 0.25:
            out.append(("c", t, {"_id": 1, "a": value(), "e": value()}))
        else:
            sets = rng.sample(PATHS, rng.randint(0, 1))
            unsets = [p for p in rng.sample(PATHS, rng.randint(0, 1)) if p not in sets]
            out.append(("u", t, {"$set": {p: value() for p in sets}, "$unset": {p: True for p in unsets}}))
    return out


def test_any_batching_of_patches_on_scalar_parents():
    """The fold of random changes in random batches and orders of arrival, through the text form of images, is the sequential one."""
    import random

    rng = random.Random(7)
    for _ in range(1500):
        changes = random_changes(rng, rng.randint(1, 8))
        rows = [{"seq": t, "ns": "n", "op": op, "before_doc": '{"_id":1}', "after_doc": doc and json.dumps(doc), "phase": 1, "ts_t": t, "ts_i": 1} for op, t, doc in changes]
        want = {f[2:] for f in brute.current(rows)}
        arrival = changes + rng.sample(changes, rng.randint(0, len(changes)))
        rng.shuffle(arrival)
        image, at = [], 0
        while at < len(arrival):
            size = rng.randint(1, 4)
            state = mor_table.State()
            for op, t, doc in arrival[at : at + size]:
                mor_table.apply_change(state, op, (1, t, 1), mor_table.parse_raw(json.dumps(doc)) if doc else None, json.dumps(doc))
            at += size
            if state.reset is not None or state.ops:
                image.append(mor_table._row(("n", "1"), state, False))
            image = [tuple(c[0] for c in b.to_pydict().values()) for b in mor_table._fold_by_key(iter([mor_table._images(image)])) if b.num_rows]
        fields = json.loads(image[0][3]) if image and image[0][2] else {}
        got_fields = {(p, json.loads(v) if v[0] == '"' else v) for p, v in fields.items() if v[0] not in "[{"}
        assert got_fields == want, (arrival, got_fields, want)


def test_delete_vectors_hide_superseded_rows(spark):
    table = current(spark, events(spark, *[("n", "c", None, {"_id": k, "v": 1}, 1, k, 1) for k in range(50)]))
    table.apply(events(spark, *[("n", "u", {"_id": k}, {"_id": k, "v": 2}, 1, 100 + k, 1) for k in range(0, 50, 2)]))
    manifest = table._manifest()
    assert table._placed(*(n for n, _ in manifest["data"])).count() == 75 and len(manifest["deleted"]) == 1
    assert {r["fields"]["v"] for r in table.read().where("doc_key % 2 = 0").collect()} == {"2"} and table.read().count() == 50


def test_a_small_batch_moves_little(spark):
    """The index finds the few files and images that a batch supersedes; the rest of the table is neither shuffled nor rewritten."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    table = current(spark, events(spark, *[("n", "c", None, {"_id": k, "v": "x" * 50}, 1, k, 1) for k in range(4000)]))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([n for n in table.store.names(table._manifest()["data"][0][0]) if n.startswith("part")]) == 4
    table.apply(events(spark, ("n", "u", {"_id": 7}, {"$set": {"v": 2}}, 1, 9000, 1), ("n", "c", None, {"_id": "new"}, 1, 9001, 1)))
    manifest = table._manifest()
    assert [rows for _, rows in manifest["data"]] == [4000, 2]
    marks = table._read(mor_table.VECTORS, manifest["deleted"][0][0])
    assert marks.agg(F.sum(F.expr("bitmap_count(bits)"))).first()[0] == 1
    before = dict(manifest, data=manifest["data"][:1], deleted=[])
    fetch = table._superseded(before, marks, *table._touched(marks))
    assert len([f for f in fetch.inputFiles() if "/data-" in f]) == 1 and fetch.count() == 1
    assert "Exchange hashpartitioning" not in fetch._jdf.queryExecution().executedPlan().toString()


def test_more_touched_files_than_can_be_named(spark, small, rows, monkeypatch):
    monkeypatch.setattr(mor_table, "MOST_NAMED_FILES", 1)
    monkeypatch.setattr(mor_table, "MOST_BROADCAST", 0)
    e = read_table(spark, small, "transfer_events")
    table = current(spark, *(e.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == k) for k in range(3)))
    assert got(mor_table.scalar_fields(table.read())) == brute.current(rows("transfer_events"))


def test_compaction_and_vacuum_keep_the_documents(spark, small, rows, monkeypatch):
    monkeypatch.setattr(mor_table, "MOST_SEGMENTS", 2)
    e = read_table(spark, small, "transfer_events")
    parts = [e.where(F.pmod(F.xxhash64("seq"), F.lit(5)) == k) for k in range(5)]
    table = current(spark, *parts[:4])
    assert len(table._manifest()["index"]) < 4 and len(table._manifest()["deleted"]) <= 2
    table.compact(0.1)
    assert len(table._manifest()["data"]) < 4
    table.apply(parts[4]).compact(0.0)
    gone = table.vacuum()
    assert gone and len(table._manifest()["data"]) == 1 and not table._manifest()["deleted"]
    assert got(mor_table.scalar_fields(table.read())) == brute.current(rows("transfer_events"))


def test_replayed_batch_is_skipped_within_its_stream(spark):
    table = mor_table.MorTable(spark, work_path(spark, "mor"))
    batch = events(spark, ("n", "c", None, {"_id": 1, "v": 1}, 1, 1, 1))
    table.apply(batch, 5, "a").apply(batch, 5, "a")
    assert table._manifest()["version"] == 1
    table.apply(events(spark, ("n", "c", None, {"_id": 2, "v": 1}, 1, 1, 1)), 0, "b")
    assert table.read().count() == 2


def test_one_of_two_writers_commits(spark):
    table = mor_table.MorTable(spark, work_path(spark, "mor"))
    batch = events(spark, ("n", "c", None, {"_id": 1, "v": 1}, 1, 1, 1))
    old = table._manifest()
    table.apply(batch)
    with pytest.raises(RuntimeError):
        table._commit(dict(old))


def dropped(spark, *rows):
    return spark.createDataFrame(rows, "database string, collection string, ts_t bigint, ts_i bigint")


def test_drops_and_renames(spark):
    c = lambda ns, k, t, v=1: (ns, "c", None, {"_id": k, "v": v}, 1, t, 1)
    table = current(spark, events(spark, c("d.a", 1, 1), c("d.a", 2, 9), c("d.b", 1, 1), c("e.a", 1, 1)))
    table.apply(events(spark, c("d.a", 3, 4), c("d.a", 4, 6)), drops=dropped(spark, ("d", "a", 5, 1)))
    keys = lambda: {(r["ns"], r["doc_key"]) for r in table.read().collect()}
    assert keys() == {("d.a", "2"), ("d.a", "4"), ("d.b", "1"), ("e.a", "1")}
    table.apply(events(spark, c("d.a", 5, 3), c("d.a", 6, 7)))  # a late change from before the drop
    assert keys() == {("d.a", "2"), ("d.a", "4"), ("d.a", "6"), ("d.b", "1"), ("e.a", "1")}
    table.rename("d.a", "d.b", 10, 1)
    assert keys() == {("d.b", "2"), ("d.b", "4"), ("d.b", "6"), ("e.a", "1")}
    table.apply(events(spark, ("d.b", "u", {"_id": 2}, {"$set": {"w": 2}}, 1, 11, 1), c("d.a", 7, 12)), drops=dropped(spark, ("e", None, 20, 1)))
    assert {(r["ns"], r["doc_key"], *sorted(r["fields"].items())) for r in table.read().where("doc_key in ('2', '7')").collect()} == {("d.b", "2", ("v", "1"), ("w", "2")), ("d.a", "7", ("v", "1"))}
    assert ("e.a", "1") not in keys()


def test_unusable_changes_are_named(spark):
    rows = [("n", "c", None, {"_id": 1}, 1, 1, 1), (None, "c", None, {"_id": 1}, 1, 1, 1), ("n", "c", None, {"_id": 1}, 1, None, 1), ("n", "x", None, {"_id": 1}, 1, 1, 1), ("n", "c", None, [1], 1, 1, 1), ("n", "c", None, {"v": 1}, 1, 1, 1), ("n", "d", {"_id": 1}, None, 1, 1, 1), ("n", None, None, None, 1, 1, 1)]
    found = [r[0] for r in events(spark, *rows).orderBy("seq").select(mor_table.unusable()).collect()]
    assert found == [None, "no namespace", "no position", "unknown op", "broken document", "no key", None, "unknown op"]


def test_texts_that_utf8_cannot_hold(spark):
    row = ("n", "c", None, '{"_id": "k\\ud800", "v": "x\\ud800", "deep": ' + "[" * 40 + "]" * 40 + "}", 1, 1, 1)
    df = spark.createDataFrame([row[:3] + row[3:]], "ns string, op string, before_doc string, after_doc string, phase int, ts_t bigint, ts_i bigint")
    assert current(spark, df).read().count() == 1


# p4


@pytest.mark.parametrize("per_slice", [None, 10, 1])
def test_repeated_quantities(spark, small, rows, per_slice):
    changes = skew.account_changes(read_table(spark, small, "transfer_events")).cache()
    found = skew.with_previous(changes, "acct", ("ts_t", "ts_i"), "qty", per_slice)
    assert got(found.where("previous.any and qty = previous.value").select("acct", "ts_t", "ts_i")) == brute.repeats(rows("transfer_events"))


def test_a_key_of_a_thousandth_is_split_when_large(spark):
    """Heavy is counted in rows of a task, and one second's burst is cut by its steps."""
    n = 100_000
    changes = spark.range(n).select(F.when(F.col("id") % 1000 == 0, "burst").when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("acct"), F.lit(7).cast("bigint").alias("ts_t"), F.col("id").alias("ts_i"), (F.col("id") % 2000 < 1000).cast("double").alias("qty")).cache()
    assert set(skew.heavy_keys(changes, "acct", 4, 50)[0]) == {"burst", "hot"} and skew.heavy_keys(changes.limit(0), "acct", 4) == ({}, 1)
    hot = changes.where("acct in ('burst', 'hot')").withColumn("_at", slices.ordinal("ts_t", "ts_i"))
    sizes = slices.with_slice(hot, slices.find_cuts(hot, ["acct"], "_at", n, 50), ["acct"], F.col("_at")).groupBy("acct", "slice").count()
    most = {r["acct"]: (r["n"], r["m"]) for r in sizes.groupBy("acct").agg(F.count("*").alias("n"), F.max("count").alias("m")).collect()}
    assert most["burst"][0] >= 2 and most["hot"][0] >= 300 and max(m for _, m in most.values()) < 250
    found = skew.with_previous(changes, "acct", ("ts_t", "ts_i"), "qty", 50).where("previous.any").groupBy("acct").agg(F.count("*").alias("n"), F.count_if(F.col("qty") == F.col("previous.value")).alias("same"))
    assert {tuple(r) for r in found.collect()} == {("burst", 99, 0), ("hot", 33299, found.where("acct = 'hot'").first()["same"])}


def test_heavy_rows_follow_the_tasks():
    assert skew.heavy_rows(400_000, 10) == 10_000 and skew.heavy_rows(10**10, 20_000) < skew.MOST_ROWS
    assert skew.heavy_rows(10**9, 10) == skew.MOST_ROWS and skew.heavy_rows(0, 8) == 1


def test_places_among_cuts(spark):
    for cuts in ([], [5], [1, 2, 3], list(range(0, 200, 3))):
        df = spark.range(-2, 205).select("id", F.array(*(F.lit(c).cast("bigint") for c in cuts)).cast("array<bigint>").alias("cuts"))
        got_places = {r["id"]: r["n"] for r in df.where(F.lit(bool(cuts))).select("id", slices.cuts_below(F.col("cuts"), F.col("id")).alias("n")).collect()}
        assert all(n == sum(c < k for c in cuts) for k, n in got_places.items())


def test_repeated_quantities_of_unusual_tables(spark, small, rows, shape):
    name, change = shape
    found = got(skew.repeated_quantities(change(read_table(spark, small, "transfer_events")), 20))
    assert found == (set() if name == "empty" else brute.repeats(rows("transfer_events")))


def test_quantities_that_are_no_numbers(spark):
    rows = [("n", "c", None, {"_id": k, "acct": "A", "qty": q}, 1, k, 1) for k, q in enumerate([1, 1.0, None, None, "x", "x", 2, 2])]
    assert got(skew.repeated_quantities(events(spark, *rows))) == {("A", 1, 1), ("A", 7, 1)}


# p5


def test_drift(spark, small, rows, shape):
    name, change = shape
    found = got(drift.drift_report(change(read_table(spark, small, "oplog_entries"))))
    assert found == (set() if name == "empty" else brute.drift(rows("oplog_entries")))


def log(spark, *files):
    rows, n = [], 0
    for file_no, entries in enumerate(files, 1):
        for doc in entries:
            n += 1
            rows.append((n, "s", file_no, (n, 1), "i", "d.c", json.dumps(doc) if doc is not None else None, None))
    return spark.createDataFrame(rows, "entry_id bigint, shard string, file_no int, ts struct<t:bigint,i:bigint>, op string, ns string, o string, o2 string")


def test_drift_kinds(spark):
    first = [{"_id": 1, "a": 1, "b": "x", "c": 1, "e": None, "g": {"h": 1}}, {"_id": 2, "a": 2, "b": "y", "c": 2, "e": 1}]
    second = [{"_id": 1, "a2": 1, "b": [1], "d": "n", "e": None, "g": {"h": {"$date": "2024-01-01T00:00:00Z"}}}, {"_id": 2, "a2": 2.0, "b": [2], "e": "s"}]
    found = {r[4:] for r in got(drift.drift_report(log(spark, first, second)))}
    assert found == {("renamed", "a", "a2"), ("retyped", "b", ""), ("removed", "c", ""), ("added", "d", ""), ("retyped", "e", ""), ("retyped", "g.h", "")}


def test_drift_without_documents_in_both_files_is_no_rename(spark):
    assert {r[4] for r in got(drift.drift_report(log(spark, [{"_id": 1, "a": 1}], [{"_id": 2, "b": 1}])))} == {"removed", "added"}
    assert {r[4] for r in got(drift.drift_report(log(spark, [{"_id": 1, "a": None}], [{"_id": 1, "b": None}])))} == {"removed", "added"}


def test_consistent_table(spark):
    documents = drift.log_documents(log(spark, [{"_id": 1, "p": 1, "file_no": "x", "q": {"r": True}}], [{"_id": 2, "p": "two"}, {"_id": 3, "p": {"$numberDecimal": "3.10"}}], [None]))
    table = drift.consistent_table(documents, drift.table_layout(drift.infer_union(documents)))
    rows = {r["_id"]: r for r in table.collect()}
    assert rows[1]["p"] == "1" and rows[1]["p__number"] == 1.0 and rows[1]["file_no_"] == "x" and rows[1]["q__r"] is True
    assert rows[2]["p__string"] == "two" and rows[3]["p__decimal"] == "3.10" and rows[3]["p__number"] is None
    assert drift.consistent_table(documents.limit(0), []).count() == 0


def test_names_that_differ_in_case_only(spark, tmp_path):
    documents = drift.log_documents(log(spark, [{"_id": 1, "SKU": "A", "sku": 1, "File_No": 3}], [{"_id": 2, "SKU": "B", "Sku": True, "l": [1, {"b": 2.50}], "bad": {"$numberLong": "x"}}]))
    table = drift.consistent_table(documents, drift.table_layout(drift.infer_union(documents)))
    table.write.parquet(str(tmp_path / "t"))
    rows = {r["_id"]: r for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert rows[1]["SKU"] == "A" and rows[1]["sku__"] == 1.0 and rows[2]["Sku_"] is True and rows[1]["File_No_"] == 3.0
    assert rows[2]["l"] == '[1,{"b":2.5}]' and rows[2]["bad"] is None


# p6


def copies(spark, df, batches=1):
    seen = dedup.SeenMessages(spark, work_path(spark, "seen"))
    out = [seen.admit(dedup.message_identifiers(df if batches == 1 else df.where(F.pmod(F.xxhash64("delivery_id"), F.lit(batches)) == k))) for k in range(batches)]
    return seen, out


def test_copies(spark, small, rows, shape):
    name, change = shape
    seen, (result,) = copies(spark, change(read_table(spark, small, "change_stream")))
    want = set() if name == "empty" else {(d,) for d in brute.copies(rows("change_stream"))}
    assert got(result.where("not admitted").select("delivery_id")) == want == got(seen.copies())


def test_copies_by_batches_in_order(spark, small, rows, monkeypatch):
    monkeypatch.setattr(dedup, "MOST_SEGMENTS", 2)
    seen = dedup.SeenMessages(spark, work_path(spark, "seen"))
    for batch in dedup.in_order(dedup.message_identifiers(read_table(spark, small, "change_stream"), "batch_no"), 4):
        seen.admit(batch)
    want = {(d,) for d in brute.copies(rows("change_stream"))}
    assert got(seen.copies()) == want and len(seen._manifest()["bits"]) <= 2
    assert seen.admitted().count() == len(rows("change_stream")) - len(want)
    codes = seen.dictionary().agg(F.count("*"), F.countDistinct("code"), F.countDistinct("kind", "id"), F.min("code"), F.max("code")).first()
    assert codes[0] == codes[1] == codes[2] == codes[4] + 1 and codes[3] == 0  # dense, each once


def test_copies_in_any_batches_are_settled(spark, small, rows):
    """Batches in no order: messages admitted apart and linked later are settled by copies()."""
    seen, out = copies(spark, read_table(spark, small, "change_stream"), 3)
    assert got(seen.copies()) == {(d,) for d in brute.copies(rows("change_stream"))}
    again = seen.admit(dedup.message_identifiers(read_table(spark, small, "change_stream")))
    assert again.where("admitted").count() == 0


def test_sparse_identifiers_take_dense_bits(spark):
    far = messages(spark, *[(k * 10**12, f"82{k:06X}", None, None) for k in range(1, 500)])
    seen, _ = copies(spark, far)
    bits = seen._read(dedup._BITS, seen._manifest()["bits"])
    assert bits.count() == 1 and seen._manifest()["codes"] == 499
    assert seen.admit(dedup.message_identifiers(far)).where("admitted").count() == 0


def test_a_batch_that_breaks_after_its_dictionary_is_admitted_again(spark, monkeypatch):
    batch = dedup.message_identifiers(messages(spark, (1, "8201", None, None), (2, "8201", None, None), (3, "8202", None, None)))
    seen = dedup.SeenMessages(spark, work_path(spark, "seen"))
    monkeypatch.setattr(dedup, "least_codes", lambda edges: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        seen.admit(batch)
    monkeypatch.undo()
    assert seen._manifest()["codes"] == 2 and not seen._manifest()["bits"]
    assert {r["delivery_id"] for r in seen.admit(batch).where("admitted").collect()} == {1, 3}


def messages(spark, *rows):
    return spark.createDataFrame([(d, "s", token, (t, 1) if t else None, "n", key) for d, token, t, key in rows], "delivery_id bigint, shard string, _id string, cluster_time struct<t:bigint,i:bigint>, ns string, document_key string")


def test_copies_of_copies(spark):
    chain = [(k, f"{'82' + '0' * 6}{k // 2:02X}", 100 + (k + 1) // 2, '{"_id": 1}') for k in range(1, 60)]
    rows = [*chain, (70, None, None, None), (71, None, None, None), (72, "zz", 900, "no json"), (73, None, 900, "no json"), (74, None, 901, '{"a":1,"b":{"c":1,"d":2}}'), (75, None, 901, '{ "b": {"d": 2, "c": 1}, "a": 1 }')]
    _, (result,) = copies(spark, messages(spark, *rows))
    assert got(result.where("not admitted").select("delivery_id")) == {(k,) for k in [*range(2, 60), 73, 75]}


def test_a_later_copy_is_held_back(spark):
    first = messages(spark, (10, "8201", 5, '{"_id": 1}'), (11, "8202", 6, '{"_id": 2}'))
    second = messages(spark, (1, "8201", None, None), (12, None, 6, '{"_id":2}'), (13, "8203", 7, '{"_id": 3}'), (14, "8203", 7, '{"_id": 3}'))
    seen = dedup.SeenMessages(spark, work_path(spark, "seen"))
    assert {r["delivery_id"] for r in seen.admit(dedup.message_identifiers(first)).where("admitted").collect()} == {10, 11}
    assert {r["delivery_id"] for r in seen.admit(dedup.message_identifiers(second)).where("admitted").collect()} == {13}
    # a token that a held-back copy alone bore is known, too
    third = messages(spark, (20, "82AA", 5, '{"_id": 1}'))
    fourth = messages(spark, (30, "82AA", None, None), (31, "82BB", None, None))
    assert seen.admit(dedup.message_identifiers(third)).where("admitted").count() == 0
    assert {r["delivery_id"] for r in seen.admit(dedup.message_identifiers(fourth)).where("admitted").collect()} == {31}
