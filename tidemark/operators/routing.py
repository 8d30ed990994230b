"""Buckets by key. Spark's own hash partitioning runs the pipeline; these columns are for systems that expect the same buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def java_hash(text: Column | str) -> Column:
    """The 32-bit hash that the Java platform documents for strings: s[0]*31^(n-1) + ... + s[n-1] over UTF-16 units."""
    c = F.col(text) if isinstance(text, str) else text
    digits = F.hex(F.encode(c, "UTF-16BE"))
    places = F.sequence(F.lit(1), F.floor(F.length(digits) / 4).cast("int"))
    units = F.transform(places, lambda i: F.conv(F.substring(digits, (i - 1) * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    total = F.aggregate(units, F.lit(0).cast("bigint"), lambda a, x: (a * 31 + x) % F.lit(4294967296))
    signed = F.when(total >= 2147483648, total - F.lit(4294967296)).otherwise(total)
    return F.when(c.isNotNull(), F.when(F.length(c) == 0, F.lit(0).cast("bigint")).otherwise(signed))


def bucket(key: Column | str, n: int, unique: Column | bool = False) -> Column:
    """Bucket of a key; 0 for a null key, and for every key of a namespace with a unique index, which needs one order."""
    single = F.lit(unique) if isinstance(unique, bool) else unique
    return F.when(single, F.lit(0).cast("bigint")).otherwise(F.coalesce(F.pmod(java_hash(key), F.lit(n).cast("bigint")), F.lit(0).cast("bigint")))


def next_power_of_two(n: Column | str, least: int = 1024) -> Column:
    c = F.col(n) if isinstance(n, str) else n
    return F.when(c <= least, F.lit(least).cast("bigint")).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(c.cast("double")))).cast("bigint"))


def has_unique(indexes: DataFrame) -> DataFrame:
    """(ns, has_unique) from (ns, name, is_unique): a unique index other than that on _id."""
    return indexes.groupBy("ns").agg(F.coalesce(F.bool_or(F.col("is_unique") & (F.col("name") != "_id_")), F.lit(False)).alias("has_unique"))


def unique_timeline(ddl: DataFrame, specs: DataFrame) -> DataFrame:
    """(entry_id, ns, ts_t, ts_i, ddl_type, unique_now): whether the namespace has a unique index after each schema change.

    A unique index counts from its build to its own drop (a drop of ``*`` takes all), or to the drop or rename of its
    collection or the drop of its database, which reaches every collection that the log names. What a rename's target
    has is for a new probe. ``ddl`` and ``specs`` are those of one log; there are as many rows as schema changes.
    """
    ns = F.concat_ws(".", "database", "collection")
    unique = specs.where(F.col("is_unique") & (F.col("name") != "_id_")).select("entry_id", F.col("name").alias("index_name"), F.lit(True).alias("_unique")).distinct()
    rows = ddl.join(unique, ["entry_id", "index_name"], "left").withColumn("ns", ns)
    known = rows.where("collection is not null").select("database", "ns").distinct()
    own = rows.where("collection is not null")
    whole = rows.where("ddl_type = 'DROP_DATABASE'").drop("ns").join(known, "database")
    every = own.unionByName(whole.select(*own.columns))
    place = ["ts_t", "ts_i", "entry_id"]
    ends = F.col("ddl_type").isin("DROP_COLLECTION", "DROP_DATABASE", "RENAME_COLLECTION") | ((F.col("ddl_type") == "DROP_INDEXES") & (F.col("index_name") == "*"))
    every = every.withColumn("_epoch", F.sum(F.when(F.coalesce(ends, F.lit(False)), 1).otherwise(0)).over(Window.partitionBy("ns").orderBy(*place, F.col("index_name").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # an index's own state after each of its changes, and what that changes in the number of unique indexes
    there = F.when(F.col("ddl_type") == "CREATE_INDEXES", F.coalesce("_unique", F.lit(False)).cast("int")).when(F.col("ddl_type") == "DROP_INDEXES", 0)
    by_index = Window.partitionBy("ns", "_epoch", "index_name").orderBy(*place)
    every = every.withColumn("_there", F.when(F.col("index_name").isNotNull(), there)).withColumn("_delta", F.coalesce(F.col("_there") - F.coalesce(F.lag("_there").over(by_index), F.lit(0)), F.lit(0)))
    now = F.sum("_delta").over(Window.partitionBy("ns", "_epoch").orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)) > 0
    return every.select("entry_id", "ns", "ts_t", "ts_i", "ddl_type", now.alias("unique_now"))
