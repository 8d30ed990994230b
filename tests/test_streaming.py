"""Streaming: restart from a checkpoint in the middle of a log equals one batch run."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.mor_table import MorTable, scalar_fields
from tidemark.session import read_table, work_path
from tidemark.sources.feeds import stream_after
from tidemark.streaming import apply, log_source


def fields(df):
    return {tuple(r) for r in scalar_fields(df).collect()}


@pytest.fixture(scope="module")
def captured(spark, small, tmp_path_factory):
    """The log of a shard in six captured files; returns the folder and a function that lands files."""
    folder, hidden = tmp_path_factory.mktemp("log"), tmp_path_factory.mktemp("hidden")
    rows = [r.asDict(True) for r in read_table(spark, small, "oplog_entries").orderBy("file_no", "entry_id").select("entry_id", "shard", "ts", "op", "ns", "o", "o2").collect()]
    rows += [{"entry_id": 10**6, "shard": "s", "ts": None, "op": "i", "ns": "a.b", "o": '{"_id": 1}', "o2": None}, {"entry_id": 10**6 + 1, "shard": "s", "ts": {"t": 1, "i": 1}, "op": "i", "ns": "a.b", "o": '{"v": 1}', "o2": None}]
    for k in range(6):
        with open(hidden / f"{k:03d}.jsonl", "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in rows[k::6])

    def land(names):
        for n in names:
            os.rename(hidden / f"{n:03d}.jsonl", folder / f"{n:03d}.jsonl")

    return str(folder), land


def test_stream_in_parts_equals_batch(spark, captured, tmp_path):
    folder, land = captured
    land([0, 1])
    table = MorTable(spark, work_path(spark, "stream"))

    def start():
        entries = log_source.log_stream(spark, folder, "json")
        return apply.start_apply(entries, table, str(tmp_path / "checkpoint"), dead_letters=str(tmp_path / "dead"))

    start().awaitTermination()
    first = table._manifest()["version"]
    start().awaitTermination()  # nothing new: no version
    assert table._manifest()["version"] == first
    land([2, 3, 4, 5])
    failures = iter([True, False])

    def flaky():
        if next(failures, False):
            raise OSError("lost")
        return start()

    assert apply.run_with_retry(flaky, base_ms=1, sleep=lambda s: None) == 1
    batch = spark.read.schema(log_source.ENTRIES).json(folder)
    whole = MorTable(spark, work_path(spark, "batch")).apply(apply.entries_to_events(batch))
    assert fields(table.read()) == fields(whole.read()) and fields(whole.read())
    dead = spark.read.parquet(str(tmp_path / "dead"))
    assert {(r["entry_id"], r["_error"]) for r in dead.collect()} >= {(10**6, "no position"), (10**6 + 1, "no key")}


def test_late_files_and_admission(spark, tmp_path):
    """A file that lands later under an earlier name is read, and a batch takes no more files than it may."""
    folder, sizes = tmp_path / "in", []
    folder.mkdir()

    def land(name, *ids):
        with open(folder / name, "w") as f:
            f.writelines(json.dumps({"entry_id": k, "ts": {"t": k, "i": 1}, "op": "i", "ns": "a.b", "o": json.dumps({"_id": k})}) + "\n" for k in ids)

    def run():
        rows = log_source.log_stream(spark, str(folder), "json", max_files=1, after=(1, 1))
        apply.each_batch(rows, lambda batch, n, stream: sizes.append(sorted(r["entry_id"] for r in batch.collect())), str(tmp_path / "c")).awaitTermination()

    land("5.json", 1, 2)
    land("6.json", 3)
    run()
    land("1.json", 4, 5)
    run()
    assert sorted(sizes[:2]) == [[2], [3]] and sizes[2:] == [[4, 5]]


def test_messages_from_a_token_on(spark, small, tmp_path):
    rows = read_table(spark, small, "change_stream")
    source = str(tmp_path / "in")
    rows.repartition(3).write.parquet(source)
    first = rows.where("cluster_time is not null").selectExpr("percentile_approx(cluster_time.t, 0.5) as t").first()["t"]
    stream = log_source.message_stream(spark, source, operation_time=(first, 0), where="ns like 'shop.%'")
    seen = []
    apply.each_batch(stream, lambda batch, n, s: seen.extend(r["delivery_id"] for r in batch.collect()), str(tmp_path / "c")).awaitTermination()
    want = stream_after(rows, operation_time=(first, 0)).where("lower(operation_type) <> 'invalidate' and (lower(operation_type) not in ('insert', 'update', 'replace', 'delete') or ns like 'shop.%')")
    assert sorted(seen) == sorted(r["delivery_id"] for r in want.collect()) and seen
    assert [log_source.start_position(*[None] * k, *"bscl"[k:]) for k in range(4)] == list("bscl")


def test_state_by_key(spark, small, tmp_path):
    events = read_table(spark, small, "events")
    source = str(tmp_path / "in")
    events.orderBy("event_id").repartition(2).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = apply.keyed_state(stream, "user_id", "event_id").writeStream.outputMode("update").format("memory").queryName("keyed").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["key"]: (r["e"], r["s"]) for r in spark.table("keyed").groupBy("key").agg(F.max("events").alias("e"), F.max("last_seq").alias("s")).collect()}
    want = {str(r["user_id"]): (r["e"], r["s"]) for r in events.groupBy("user_id").agg(F.count("*").alias("e"), F.max("event_id").alias("s")).collect()}
    assert got == want


def test_retries_end(spark):
    calls, waits = [], []

    def start():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        apply.run_with_retry(start, attempts=3, base_ms=1000, sleep=waits.append)
    assert len(calls) == 4 and waits == [1, 2, 4]
    with pytest.raises(OSError):
        apply.run_with_retry(start, fatal=lambda e: True, sleep=waits.append)
    assert len(calls) == 5


def test_progress_and_counters(spark, captured, tmp_path):
    import time

    from tidemark.streaming import listener

    folder, _ = captured
    lines = []
    watch = listener.ProgressLog(lines.append)
    spark.streams.addListener(watch)
    try:
        entries = listener.counted(log_source.log_stream(spark, folder, "json"))
        query = entries.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(50):
            if any(x.startswith("ended") for x in lines):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(watch)
    assert watch.totals["entries"] > watch.totals["changes"] > 0 and watch.totals["dropped"] >= 1
    assert lines[0].startswith("started") and any(x.startswith("progress batch=0") for x in lines)
