"""A few keys holding most records.

A frequent-items sketch, merged map-side, finds every key with more rows than a task should get: more than a quarter of
the mean of the tasks, or a million. Their rows are cut into slices of the order (all of it, so a burst at one second is
cut, too) by a broadcast join with the cuts; the rest takes an ordinary shuffle on the key. Both are united. Each slice's
first row then takes its predecessor from the last row of the slice before, so that results are those of the whole key.

What is broadcast or comes to the driver are heavy keys, cuts and slice edges: rows divided by the rows of a slice, and at
most MOST_SLICES, whatever the data. The sketch has SKETCH_ITEMS counters, so with more than about 1.5e11 rows the
threshold grows with them.

Defined cases: rows with a null key or a null position take no part; a position counts once for each key; a value that
is null or no number equals nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.slices import find_cuts, ordinal, with_slice
from tidemark.session import materialise

#: Counters that the sketch may use; it finds every key with more than 3.5 / SKETCH_ITEMS of the rows, and as it needs only
#: as many as there are keys near the threshold, fewer are taken for smaller data.
SKETCH_ITEMS, LEAST_ITEMS, MOST_HEAVY = 1 << 19, 1 << 13, 1 << 16
#: Most rows of one key that an ordinary task sorts.
MOST_ROWS = 1_000_000


def heavy_rows(count: int, tasks: int) -> int:
    """Rows from which a key is heavy: a quarter of the mean of the tasks, at most MOST_ROWS, at least what the sketch resolves."""
    return max(1, min(MOST_ROWS, count // (4 * tasks)), -(-7 * count // SKETCH_ITEMS), -(-count // (MOST_HEAVY - 1)))


def _sketch(df: DataFrame, key: str, limit: int, items: int) -> tuple[int, dict[str, int]]:
    """(rows, counts of the ``limit`` most frequent keys), in one pass; a key without a value has no count."""
    named = df.select(F.col(key).alias("k"))
    r = named.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(k, {limit}, {items}) filter (where k is not null)").alias("top")).first()
    return r["n"], {x["item"]: x["count"] for x in r["top"] or []}


def heavy_keys(df: DataFrame, key: str, tasks: int, rows: int | None = None) -> tuple[dict[str, int], int]:
    """(counts, never too low, of all keys with more rows than ``rows``, by default :func:`heavy_rows`; that number).

    One pass with as many counters as tasks call for; a second one with more only if the number of rows calls for them.
    """
    limit, items = 16 * tasks, max(LEAST_ITEMS, 1 << (56 * tasks).bit_length())
    count, top = _sketch(df, key, limit, items)
    if not count:
        return {}, 1
    rows = rows or heavy_rows(count, tasks)
    if 2 * count // rows > limit or 7 * count // rows > items:
        items = min(SKETCH_ITEMS, max(LEAST_ITEMS, 1 << (7 * count // rows).bit_length()))
        top = _sketch(df, key, min(MOST_HEAVY, max(1, 2 * count // rows), items), items)[1]
    return {k: n for k, n in top.items() if n > rows}, rows


def split_heavy(df: DataFrame, key: str, at: Column, rows_per_slice: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(light rows, heavy rows with ``_slice``): heavy keys are cut into slices of the order ``at``; None if there is none.

    ``df`` is read once if no key is heavy, and several times if one is, so it should be a written table or a plain scan.
    """
    heavy, rows = heavy_keys(df, key, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows_per_slice)
    if not heavy:
        return df, None
    named = df.sparkSession.createDataFrame([(k,) for k in sorted(heavy)], "heavy_key string")
    is_heavy = F.col(key) == F.col("heavy_key")  # fewer than MOST_HEAVY keys
    light = df.join(F.broadcast(named), is_heavy, "left_anti")
    hot = df.join(F.broadcast(named), is_heavy, "left_semi").withColumn("_at", at)
    cuts = materialise(find_cuts(hot, [key], "_at", sum(heavy.values()), rows), "cuts")
    return light, with_slice(hot, cuts, [key], F.col("_at"), "_slice").drop("_at")


def with_previous(df: DataFrame, key: str, order: tuple[str, ...], value: str | Column, rows_per_slice: int | None = None, at: Column | None = None) -> DataFrame:
    """Add ``previous``: (any, value) of the row just before in the key's order; df has each (key, *order) once.

    ``df`` is read several times, so it should be a written table. ``at`` is a number in the order, by default that of a
    position (t, i).
    """
    here = F.struct(F.lit(True).alias("any"), (F.col(value) if isinstance(value, str) else value).alias("value"))
    light, sliced = split_heavy(df, key, ordinal(*order) if at is None else at, rows_per_slice)
    light = light.withColumn("previous", F.lag(here).over(Window.partitionBy(key).orderBy(*order)))
    if sliced is None:
        return light
    within = sliced.withColumn("previous", F.lag(here).over(Window.partitionBy(key, "_slice").orderBy(*order)))
    # one row per slice
    edge = sliced.groupBy(key, "_slice").agg(F.max_by(here, F.struct(*order)).alias("last"))
    before = edge.withColumn("before", F.lag("last").over(Window.partitionBy(key).orderBy("_slice"))).select(F.col(key).alias("_k"), F.col("_slice").alias("_s"), "before")
    joined = within.join(F.broadcast(before), (F.col(key) == F.col("_k")) & (F.col("_slice") == F.col("_s")), "left")
    joined = joined.withColumn("previous", F.coalesce("previous", "before")).drop("_k", "_s", "before", "_slice")
    return light.unionByName(joined)


def skewed_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key by partial aggregation: a hot key is pre-aggregated before the shuffle, so no salt is needed."""
    return df.groupBy(key).agg(F.count("*").alias("rows"))


def account_changes(events: DataFrame) -> DataFrame:
    """(acct, ts_t, ts_i, qty): the changes with op c or u that name an account, each (ts_t, ts_i) once."""
    doc = F.from_json("after_doc", "acct string, qty string", {"mode": "PERMISSIVE"})
    rows = (
        events.where("op in ('c', 'u') and after_doc is not null and ts_t is not null and ts_i is not null")
        .select("ts_t", "ts_i", "seq", doc.alias("d"))
        .where("d.acct is not null")
        .select("ts_t", "ts_i", F.col("d.acct").alias("acct"), F.expr("try_cast(d.qty as double)").alias("qty"), "seq")
    )
    return rows.groupBy("ts_t", "ts_i").agg(F.min(F.struct("seq", "acct", "qty")).alias("r")).select("ts_t", "ts_i", "r.acct", "r.qty")


def repeated_quantities(events: DataFrame, rows_per_slice: int | None = None) -> DataFrame:
    """(acct, ts_t, ts_i) of the changes whose qty equals that of the account's change just before."""
    changes = materialise(account_changes(events), "account-changes")  # read by the sketch, the cuts and the windows
    found = with_previous(changes, "acct", ("ts_t", "ts_i"), "qty", rows_per_slice)
    return found.where("previous.any and qty = previous.value").select("acct", "ts_t", "ts_i")
