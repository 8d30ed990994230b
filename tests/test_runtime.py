import json
import urllib.error
import urllib.request

import pytest

from tidemark.operators.mor_table import MorTable, scalar_fields
from tidemark.runtime import config, control, offsets
from tidemark.session import work_path


def test_configuration():
    text = "# a comment\nwhite = shop; crm.visit ;\nbuckets: 8\ntransform=a.b:c.d;e:f\nignore.fields=x, y\n"
    c = config.load(text, ["--verify-samples=7", "other"])
    assert (c.white, c.verify_samples, c.transform, c.ignore_fields) == (["shop", "crm.visit"], 7, {"a.b": "c.d", "e": "f"}, ["x", "y"])
    assert c.unused == {"buckets": config.NO_COUNTERPART["buckets"]}
    for bad in ("white=a\nblack=b", "verify_samples=0", "verify_samples=x", "mode=HALF", "nothing=1", "unused=1"):
        with pytest.raises(config.MigrationError) as e:
            config.load(bad)
        assert e.value.code is config.ErrorCode.CONFIG


def test_offset_stores(spark, tmp_path):
    for store in (offsets.MemoryOffsetStore(), offsets.FileOffsetStore(str(tmp_path / "a" / "b.offset")), offsets.SharedOffsetStore(spark, work_path(spark, "offsets"))):
        assert store.load() is None
        store.save("1:2")
        store.save("3:4")
        assert store.load() == "3:4"
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["b.offset"]


class Query:
    lastProgress = None

    def __init__(self):
        self.isActive, self.drained = True, False

    def stop(self):
        self.isActive = False

    def processAllAvailable(self):
        self.drained = True


def test_states_of_a_migration():
    started, ready = [], [False]
    m = control.Migration(lambda: started.append(Query()) or started[-1], lambda: ready[0])
    with pytest.raises(config.MigrationError):
        m.pause()
    m.start()
    m.pause()
    m.resume()
    assert len(started) == 2 and not started[0].isActive and not m.can_commit()
    with pytest.raises(config.MigrationError):
        m.commit()
    ready[0] = True
    assert m.can_commit() and m.progress()["state"] == "CAN_COMMIT"
    m.commit()
    assert m.state == "COMMITTED" and started[1].drained
    assert control.each({"a": m}, "pause").keys() == {"a"}
    early = control.Migration(Query, snapshot_done=lambda: False)
    early.start()
    early.pause()
    with pytest.raises(config.MigrationError):
        early.resume()


def test_http():
    m = control.Migration(Query)
    server = control.serve(m)
    url = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, method="GET"):
        try:
            with urllib.request.urlopen(urllib.request.Request(url + path, method=method)) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert call("/progress")[1]["state"] == "IDLE" and call("/pause", "POST")[0] == 409
    m.start()
    assert call("/canCommit") == (200, {"canCommit": True}) and call("/commit", "POST") == (200, {"state": "COMMITTED"})
    assert call("/commit")[0] == 405 and call("/progress", "POST")[0] == 405 and call("/nothing")[0] == 404
    server.shutdown()


def test_single_writes(spark):
    table = MorTable(spark, work_path(spark, "writes"))
    w = control.Writer(spark, table)
    w.insert("n", {"_id": 1, "a": 1})
    w.write("n", [("c", None, {"_id": 2, "a": 1}), ("d", {"_id": 1}, None)])
    w.update("n", 2, {"a": 3, "b.c": 4}, ["x"])
    assert w.update("n", 2) == 0
    assert {tuple(r)[1:] for r in scalar_fields(table.read()).collect()} == {("2", "a", "3"), ("2", "b.c", "4")}
    w.replace("n", {"_id": 2, "z": 1})
    w.delete("n", 5)
    assert {tuple(r)[1:] for r in scalar_fields(table.read()).collect()} == {("2", "z", "1")}


def test_a_second_writer_goes_on_from_the_table(spark):
    table = MorTable(spark, work_path(spark, "writes"))
    control.Writer(spark, table).insert("n", {"_id": 1, "a": 1})
    a, b = control.Writer(spark, table), control.Writer(spark, table)
    for k, w in enumerate((a, b, a, b)):
        w.update("n", 1, {"a": k})
    assert {r["fields"]["a"] for r in table.read().collect()} == {"3"}


def test_intermediate_tables_can_be_released(spark):
    from tidemark import session
    from tidemark.store import Store

    table = session.materialise(spark.range(3), "numbers")
    folder = session._run_dir(spark)
    assert table.count() == 3 and any(n.startswith("numbers-") for n in Store(spark, folder).names())
    kept = dict(session._run_dirs)
    session._run_dirs.clear()
    own = session.work_path(spark, "x")  # another folder, so that other tests keep theirs
    spark.range(1).write.parquet(own)
    session.release(spark)
    assert not Store(spark, own.rsplit("/", 1)[0]).names()
    session._run_dirs.update(kept)
