"""Plans are the ones wanted: filters and columns reach the scan, one shuffle where one is enough, nothing is paired with everything."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fold, verify
from tidemark.plans import catalog
from tidemark.session import read_table
from tidemark.sources import feeds


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def exchanges(df) -> int:
    text = plan(df).split("\n\n")[0]
    return len(re.findall(r"\bExchange\b", text))


def test_filters_and_columns_reach_the_scan(spark, small):
    oplog = read_table(spark, small, "oplog_entries")
    text = plan(feeds.log_window(oplog, (1700000100, 1), (1700000900, 2)).select("entry_id"))
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(ts\.t,1700000100\).*", text) and "o2" not in re.search(r"ReadSchema: (.*)", text)[1]
    text = plan(feeds.watched_entries(oplog, "shop.order_line").select("entry_id"))
    assert "In(ns, [" in text


def test_key_verification_never_reads_documents(spark, small):
    source, target = (read_table(spark, small, t) for t in ("source_docs", "target_docs"))
    text = plan(verify.paired(source, target, ["ns", "_id", "id_type"]))
    assert all("doc" not in schema for schema in re.findall(r"ReadSchema: (.*)", text))


def test_one_shuffle_for_a_fold(spark, small):
    feed = feeds.user_feed(read_table(spark, small, "events"))
    assert exchanges(fold.latest(feed, ["value"])) == 1
    assert exchanges(fold.effective(feed, split=False)) == 1


@pytest.mark.parametrize("name", ["lww_upsert", "patch_fold", "strict_skip", "verify_full", "verify_id", "oplog_kind", "oplog_ddl", "upsert_merge", "snapshot_plus_incremental", "ddl_segments", "ns_map"])
def test_nothing_is_paired_with_everything(spark, small, name):
    text = plan(catalog.queries()[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_row_functions_in_the_fold(spark, small):
    text = plan(fold.patch_fold(feeds.user_feed(read_table(spark, small, "events")), {"value": (F.lit(True), F.lit(False))}))
    assert "Python" not in text and "ArrowEval" not in text
