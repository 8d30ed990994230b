from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, queries
from tidemark.session import materialise, read_table


def test_water_filling():
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 10), "gone": (0.4, 5), "zero": (0.0, 5)}
    out = mixing.allot(targets, {"a": 100, "b": 1000, "c": 1000, "zero": 50}, 1000)
    assert out == {"a": 100.0, "b": pytest.approx(540), "c": pytest.approx(360), "gone": 0.0, "zero": 0.0}
    assert sum(mixing.allot(targets, {"a": 100, "b": 10, "c": 1}, 10_000).values()) == 130
    assert mixing.allot({}, {}, 5) == {} and mixing.allot({"a": (1.0, 0)}, {"a": 9}, 5) == {"a": 0.0}


def sized(spark, rows):
    return materialise(spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint"), "sized")


def targets(spark, *rows):
    return spark.createDataFrame(rows, "source_name string, target_share double, max_repeats int")


@pytest.mark.parametrize("range_rows", [200_000, 7])
def test_shares_and_repeats(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    table = sized(spark, [(k, "big" if k < 300 else "small" if k < 310 else "unlisted", 10 + k % 5) for k in range(400)])
    want = targets(spark, ("big", 0.8, 1), ("small", 0.2, 3), ("ghost", 0.1, 2))
    chosen = mixing.mix(table, want).collect()
    copies = Counter((r["source"], r["doc_id"]) for r in chosen)
    assert len(set((r["doc_id"], r["copy"]) for r in chosen)) == len(chosen)
    assert max(n for (s, _), n in copies.items() if s == "big") == 1 and max(n for (s, _), n in copies.items() if s == "small") == 3
    report = {r["source_name"]: r for r in mixing.shares(table, mixing.mix(table, want), want).collect()}
    for s in ("big", "small"):
        assert abs(report[s]["chosen_tokens"] - report[s]["wanted_tokens"]) <= 14
    assert report["ghost"]["chosen_tokens"] == 0 and sum(r["reached_share"] for r in report.values()) == pytest.approx(1, abs=1e-5)
    total = sum(r["wanted_tokens"] for r in report.values())
    assert all(0 < r["position"] <= total for r in chosen) and [r["position"] for r in chosen] == sorted(r["position"] for r in chosen)


def test_the_reachable_total_is_the_default(spark):
    table = sized(spark, [(k, "big" if k < 3000 else "small", 10) for k in range(3030)])
    want = targets(spark, ("big", 0.8, 1), ("small", 0.2, 3), ("ghost", 0.3, 2), ("never", 0.3, 0))
    report = {r["source_name"]: r["reached_share"] for r in mixing.shares(table, mixing.mix(table, want), want).collect()}
    assert report["big"] == pytest.approx(0.8, abs=0.005) and report["small"] == pytest.approx(0.2, abs=0.005)
    more = {r["source_name"]: r["reached_share"] for r in mixing.shares(table, mixing.mix(table, want, 30_000), want, 30_000).collect()}
    assert more["small"] == pytest.approx(900 / 30_000, abs=0.001)


def test_curriculum_takes_the_same_in_every_step():
    allotted = {"a": 500.0, "b": 300.0, "c": 200.0}
    out = mixing.curriculum(allotted, {"a": [4.0, 3.0, 2.0, 1.0], "c": [0.0, 1.0, 2.0, 3.0]})
    assert all(sum(out[s]) == pytest.approx(n) for s, n in allotted.items())
    assert all(sum(row[k] for row in out.values()) == pytest.approx(250, rel=1e-5) for k in range(4))
    assert out["a"] == sorted(out["a"], reverse=True) and out["c"][0] == 0 and out["c"][1:] == sorted(out["c"][1:])
    assert mixing.curriculum(allotted, {}) == {s: [pytest.approx(n)] for s, n in allotted.items()}
    for bad in ({"a": [0.0, 0.0]}, {"a": [1.0, 1.0], "b": [1.0]}, {"a": [1.0, 0.0], "b": [1.0, 0.0], "c": [1.0, 0.0]}, {"a": [1.0, 0.0], "b": [1.0, 0.0]}):
        with pytest.raises(ValueError):
            mixing.curriculum(allotted, bad)


def test_positions_are_offsets_of_training(spark):
    """Up to any position the mix holds about as many tokens, and within a step each source gives what its weights say."""
    table = sized(spark, [(k, "abc"[k % 3], 3 + k % 5) for k in range(6000)])
    want = targets(spark, ("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 1))
    schedules = {"a": [4.0, 3.0, 2.0, 1.0], "c": [0.0, 1.0, 2.0, 3.0]}
    rows = mixing.mix(table, want, schedules=schedules)
    at = 0
    for r in rows.collect():
        at += r["tokens"]
        assert abs(at - r["position"]) < 40
    for r in mixing.shares_over_time(table, rows, want, schedules).collect():
        assert r["reached_share"] == pytest.approx(r["wanted_share"], abs=0.01)


def test_shares_against_sql(spark, small):
    """Totals, targets and shares of the real documents, from the sized table by another engine."""
    import duckdb

    docs = materialise(mixing.sized_documents(read_table(spark, small, "documents")), "sized")
    docs_sized, want = docs.toArrow(), read_table(spark, small, "mix_targets").toArrow()  # noqa: F841  read by name
    rows = duckdb.sql("""
        WITH held AS (SELECT source AS s, sum(tokens) AS n FROM docs_sized GROUP BY source),
        able AS (SELECT source_name AS s, target_share AS t, n * max_repeats AS cap FROM want JOIN held ON s = source_name),
        total AS (SELECT sum(t) AS weight, min(cap / t) * sum(t) AS n FROM able)
        SELECT a.s, total.n * t / weight, t / weight FROM able a, total""").fetchall()
    got = {r["source_name"]: r for r in mixing.shares(docs, queries.p8_mix(spark, small), read_table(spark, small, "mix_targets")).collect()}
    assert {s for s, r in got.items() if r["chosen_rows"]} == {s for s, _, _ in rows}
    longest, total = docs.agg(F.max("tokens")).first()[0], sum(wanted for _, wanted, _ in rows)
    for s, wanted, share in rows:
        assert got[s]["wanted_tokens"] == pytest.approx(wanted) and abs(got[s]["chosen_tokens"] - wanted) <= longest
        assert got[s]["reached_share"] == pytest.approx(share, abs=2 * longest / total)


def test_unusual_tables(spark):
    table = sized(spark, [(1, None, 5), (2, "a", 5), (2, "a", 5), (None, "a", 5)])
    rows = mixing.mix(table, targets(spark, ("a", None, 1), ("a", 0.5, None), (None, 0.5, 1))).collect()
    assert len(rows) == 3
    assert mixing.mix(table.limit(0), targets(spark, ("a", 0.5, 1))).count() == 0
    assert mixing.mix(table, spark.createDataFrame([], "source_name string, target_share double, max_repeats int")).count() == 0
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "hello there", None), (4, "hello there", "s")], "doc_id bigint, text string, source string").withColumn("tokens", F.lit("x"))
    assert [tuple(r) for r in mixing.sized_documents(docs).collect()] == [(4, "s", 2)]


def test_whole_tables(spark, small):
    rows = queries.p8_mix(spark, small)
    listed = {r["source_name"]: r["max_repeats"] for r in read_table(spark, small, "mix_targets").collect()}
    assert rows.count() and all(r["m"] <= listed[r["source"]] for r in rows.groupBy("source").agg(F.max("copy").alias("m")).collect())
    assert queries.p8_shares(spark, small).count() == len(listed) and queries.p8_curriculum(spark, small).count() >= 4
