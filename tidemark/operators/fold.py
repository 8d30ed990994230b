"""Keyed state from change feeds: what each event does, and what remains.

A feed has (ns, _id, op, is_patch, phase, ts_t, ts_i, seq) and flat fields. Everything is an algebraic aggregate where the
policy allows, so Spark reduces the feed before the one shuffle by key; only the strict policies and pre-images need
windows, in which keys with most of a feed are cut into slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.skew import split_heavy, with_previous
from tidemark.operators.slices import ordinal
from tidemark.sources.feeds import ORDER

KEY = ["ns", "_id"]


def position() -> Column:
    return F.struct(*ORDER)


def write_action(op: Column | str = "op", patch: Column | str = "is_patch", write_mode: str = "UPSERT") -> Column:
    """What a sink does with an event."""
    o = F.col(op) if isinstance(op, str) else op
    p = F.col(patch) if isinstance(patch, str) else patch
    upsert = write_mode == "UPSERT"
    return (
        F.when(o.isin("c", "r"), "REPLACE_UPSERT" if upsert else "INSERT")
        .when((o == "u") & p, "UPDATE_UPSERT" if upsert else "UPDATE")
        .when(o == "u", "REPLACE_UPSERT" if upsert else "REPLACE")
        .when(o == "d", "DELETE")
        .otherwise("NOOP")
    )


def latest(feed: DataFrame, fields: list[str]) -> DataFrame:
    """The last full document of each key that doesn't end with a delete: one partial aggregate, one shuffle."""
    last = feed.where("op in ('c', 'r', 'u', 'd')").groupBy(*KEY).agg(F.max_by(F.struct("op", *fields, "ts_t", "ts_i"), position()).alias("l"))
    return last.where("l.op <> 'd'").select(*KEY, *(F.col(f"l.{f}").alias(f) for f in [*fields, "ts_t", "ts_i"]))


def patch_fold(feed: DataFrame, fields: dict[str, tuple[Column, Column]], alive: Column | None = None) -> DataFrame:
    """Documents after patches, field by field: the last event that touches a field decides it.

    ``fields`` gives for each field when a patch sets it and when it unsets it; replacements set and deletes unset all.
    A patch of a missing document creates it.
    """
    pos = position()
    whole = ~F.col("is_patch")
    columns = []
    for name, (sets, unsets) in fields.items():
        touched = whole | sets | unsets
        kept = F.when((F.col("op") != "d") & (whole | sets), F.col(name))
        columns.append(F.max_by(F.when(touched, F.struct(kept.alias("v"))), F.when(touched, pos)).getField("v").alias(name))
    last = F.max_by(F.col("op"), pos).alias("_last")
    return feed.where("op in ('c', 'r', 'u', 'd')").groupBy(*KEY).agg(last, *columns).where("_last <> 'd'").drop("_last")


def _number() -> Column:
    """A number in the order of positions: the snapshot of a key, which has one row, before its log."""
    return F.when(F.col("phase") < 1, F.lit(-(1 << 63))).otherwise(ordinal("ts_t", "ts_i"))


def _epochs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_deletes`` and ``_created`` before each row within ``keys``; sums that start at the first row of the window."""
    before = Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_deletes", F.coalesce(F.sum(F.when(F.col("op") == "d", 1).otherwise(0)).over(before), F.lit(0)))
    in_epoch = Window.partitionBy(*keys, "_deletes").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_created", F.coalesce(F.max(F.col("op").isin("c", "r")).over(in_epoch), F.lit(False)))


def effective(feed: DataFrame, on_conflict: str | None = None, there: str | None = None, rows_per_slice: int | None = None, split: bool = True) -> DataFrame:
    """Add ``epoch``, ``effective`` and ``conflict`` under strict writes.

    An epoch runs from one delete of the key to the next. The first create in it takes effect, later ones conflict (and
    take effect with UPSERT); an update takes effect after the first create. ``there`` names a column that is true where
    the document is in the target already.

    Keys with more rows than a task should get are cut into slices of their order, which are then carried on from one to
    the next: how many deletes lie before a slice, and whether a create follows the last of them. That reads the feed
    once more, and several times if there is such a key; ``split=False`` leaves it out, for feeds known to have none.
    """
    rows = feed.where("op in ('c', 'r', 'u', 'd')")
    sliced = None
    if split:
        rows = rows.withColumn("_key", F.to_json(F.array(*(F.col(k).cast("string") for k in KEY))))
        rows, sliced = split_heavy(rows, "_key", _number(), rows_per_slice)
    out = _epochs(rows, KEY)
    if sliced is not None:
        last_delete = F.max(F.when(F.col("op") == "d", F.struct(*ORDER)))
        last_create = F.max(F.when(F.col("op").isin("c", "r"), F.struct(*ORDER)))
        # one row per slice of a heavy key: its deletes, whether it ends with a create that no delete follows, whether it has any
        per = sliced.groupBy("_key", "_slice").agg(F.count_if(F.col("op") == "d").alias("_n"), last_delete.alias("_d"), last_create.alias("_c"))
        opened = F.when(F.col("_c").isNotNull() & (F.col("_d").isNull() | (F.col("_c") > F.col("_d"))), True).when(F.col("_d").isNotNull(), False)
        w = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = per.select(F.col("_key").alias("_k"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.coalesce(F.last(opened, ignorenulls=True).over(w), F.lit(False)).alias("_open"))
        within = _epochs(sliced, [*KEY, "_slice"]).join(carried, (F.col("_key") == F.col("_k")) & (F.col("_slice") == F.col("_s")), "left")
        within = within.withColumn("_created", F.col("_created") | ((F.col("_deletes") == 0) & F.col("_open"))).withColumn("_deletes", F.col("_deletes") + F.col("_before"))
        out = out.unionByName(within.drop("_k", "_s", "_before", "_open", "_slice"))
    created = F.col("_created")
    if there is not None:
        created = created | ((F.col("_deletes") == 0) & F.coalesce(F.col(there), F.lit(False)))
    create = F.col("op").isin("c", "r")
    takes = F.when(F.col("op") == "d", True).when(create, ~created | F.lit(on_conflict == "UPSERT")).otherwise(created)
    out = out.withColumn("effective", takes).withColumn("conflict", create & created)
    return out.withColumn("epoch", F.col("_deletes")).drop("_deletes", "_created", "_key")


def strict(feed: DataFrame, fields: dict[str, tuple[Column, Column]], on_conflict: str) -> DataFrame:
    """Documents under strict writes: SKIP drops conflicting creates, UPSERT lets them replace, FAIL raises at the first."""
    rows = effective(feed, on_conflict)
    if on_conflict == "FAIL":
        rows = rows.withColumn("effective", F.when(F.col("conflict"), F.raise_error(F.concat(F.lit("duplicate key "), "_id"))).otherwise(F.col("effective")))
    return patch_fold(rows.where("effective").drop("epoch", "effective", "conflict"), fields)


def conflicts(feed: DataFrame) -> DataFrame:
    """(ns, conflicts, first_seq): duplicate creates, and where an ordered batch would stop."""
    return effective(feed).where("conflict").groupBy("ns").agg(F.count("*").alias("conflicts"), F.min("seq").alias("first_seq"))


def duplicate_keys(feed: DataFrame) -> DataFrame:
    """(ns, _id, duplicates): creates of a document that is there."""
    return effective(feed).where("conflict").groupBy(*KEY).agg(F.count("*").alias("duplicates"))


def write_counts(feed: DataFrame) -> DataFrame:
    """What an upserting sink counts for each namespace: inserted or replaced, patched, deleted."""
    action = write_action()
    return feed.groupBy("ns").agg(
        F.count_if(action == "REPLACE_UPSERT").alias("replaced"),
        F.count_if(action == "UPDATE_UPSERT").alias("patched"),
        F.count_if(action == "DELETE").alias("deleted"),
        F.count_if(action == "NOOP").alias("ignored"),
    )


def batches(feed: DataFrame, size: int = 1000) -> DataFrame:
    """(ns, batch, rows): write batches of ``size`` events by sequence."""
    return feed.groupBy("ns", F.floor((F.col("seq") - 1) / size).alias("batch")).agg(F.count("*").alias("rows"))


def landed_watermark(feed: DataFrame, pending: Column) -> DataFrame:
    """(ns, landed): the largest sequence up to which every event is written, where ``pending`` holds for those that aren't."""
    low = F.min(F.when(pending, F.col("seq")))
    return feed.groupBy("ns").agg(F.coalesce(low - 1, F.max("seq")).alias("landed"))


def same_id_conflicts(feed: DataFrame, size: int = 1000) -> DataFrame:
    """(ns, batch, conflicts): events whose key is in the same write batch already, so that order matters within it."""
    keyed = feed.groupBy("ns", F.floor((F.col("seq") - 1) / size).alias("batch"), "_id").agg(F.count("*").alias("n"))
    return keyed.groupBy("ns", "batch").agg(F.sum(F.col("n") - 1).alias("conflicts")).where("conflicts > 0")


def upsert(target: DataFrame, changes: DataFrame, key: list[str], op: str = "op") -> DataFrame:
    """A target after one change for each key: replaced, inserted or (op d) removed. One full outer join by key."""
    columns = [c for c in target.columns if c not in key]
    new = changes.select(*key, op, F.struct(*columns).alias("_new"))
    old = target.select(*key, F.struct(*columns).alias("_old"))
    joined = old.join(new, key, "full_outer").where(F.col(op).isNull() | (F.col(op) != "d"))
    chosen = F.when(F.col(op).isNotNull(), F.col("_new")).otherwise(F.col("_old"))
    return joined.select(*key, chosen.alias("_row")).select(*key, *(F.col(f"_row.{c}").alias(c) for c in columns))


def pre_image(feed: DataFrame, fields: list[str], rows_per_slice: int | None = None) -> DataFrame:
    """Add ``before``: the fields of the key's event before this one. A key with most of the feed is cut into slices."""
    rows = feed.withColumn("_key", F.to_json(F.array(*(F.col(k).cast("string") for k in KEY))))
    found = with_previous(rows, "_key", tuple(ORDER), F.struct(*fields), rows_per_slice, _number())
    return found.withColumn("before", F.col("previous.value")).drop("previous", "_key")
