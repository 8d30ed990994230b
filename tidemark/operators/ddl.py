"""Schema changes in a feed: they cut it into segments, reset keys, and move namespaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.parse import collection, database
from tidemark.operators.slices import find_cuts, ordinal, with_slice
from tidemark.session import materialise


def segments(events: DataFrame, ddl: DataFrame) -> DataFrame:
    """Add ``segment`` to events of (ns, ts_t, ts_i): how many schema changes of its namespace come before it or at its position.

    Events and schema changes of a namespace are cut into the same slices of their order; within a slice they are sorted
    together and the schema changes counted as they pass, and those of the slices before are added. A namespace with
    most of the events spreads over as many tasks as it has slices, and work grows as n log n.
    """
    from tidemark.operators.skew import heavy_rows

    columns = events.columns
    name = F.when(F.col("collection").isNull(), F.col("database")).otherwise(F.concat_ws(".", "database", "collection"))
    marks = ddl.select(name.alias("ns"), F.col("ts_t").cast("bigint").alias("_t"), F.col("ts_i").cast("bigint").alias("_i"), F.lit(1).alias("_mark"), F.lit(None).alias("_row"))
    rows = events.select("ns", F.col("ts_t").cast("bigint").alias("_t"), F.col("ts_i").cast("bigint").alias("_i"), F.lit(0).alias("_mark"), F.struct(*columns).alias("_row"))
    both = materialise(marks.withColumn("_row", F.col("_row").cast(rows.schema["_row"].dataType)).unionByName(rows).withColumn("_at", ordinal("_t", "_i")), "marked-events")
    count = both.count()
    per_slice = heavy_rows(count, int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = with_slice(both, materialise(find_cuts(both, ["ns"], "_at", count, per_slice), "cuts"), ["ns"], F.col("_at"), "_slice")
    passed = F.sum("_mark").over(Window.partitionBy("ns", "_slice").orderBy("_t", "_i").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    per = sliced.groupBy("ns", "_slice").agg(F.sum("_mark").alias("_n"))  # one row per namespace and slice
    before = per.select(F.col("ns").alias("_ns"), F.col("_slice").alias("_s"), (F.sum("_n").over(Window.partitionBy("ns").orderBy("_slice")) - F.col("_n")).alias("_before"))
    counted = sliced.withColumn("_passed", passed).where("_mark = 0")
    joined = counted.join(before, F.col("ns").eqNullSafe(F.col("_ns")) & (F.col("_slice") == F.col("_s")), "left")
    return joined.select(*(F.col(f"_row.{c}").alias(c) for c in columns), (F.col("_passed") + F.coalesce("_before", F.lit(0))).cast("bigint").alias("segment"))


def drop_resets(events: DataFrame, ddl: DataFrame) -> DataFrame:
    """The events that no later drop of their collection or database undoes."""
    drops = ddl.where("ddl_type in ('DROP_COLLECTION', 'DROP_DATABASE')").select("database", F.when(F.col("ddl_type") == "DROP_COLLECTION", F.col("collection")).alias("coll"), F.struct("ts_t", "ts_i").alias("at"))
    of_coll = drops.where("coll is not null").groupBy(F.concat_ws(".", "database", "coll").alias("_ns")).agg(F.max("at").alias("_coll_drop"))
    of_db = drops.where("coll is null").groupBy(F.col("database").alias("_db")).agg(F.max("at").alias("_db_drop"))
    # one row per dropped collection or database; joined by size
    joined = events.join(of_coll, events["ns"] == F.col("_ns"), "left").join(of_db, database("ns") == F.col("_db"), "left")
    at = F.struct("ts_t", "ts_i")
    keep = (F.col("_coll_drop").isNull() | (at > F.col("_coll_drop"))) & (F.col("_db_drop").isNull() | (at > F.col("_db_drop")))
    return joined.where(keep).select(*events.columns)


def rename_chain(renames: DataFrame, rounds: int = 32) -> DataFrame:
    """(source, final) of (source, target): follows chains of renames by pointer doubling; a cycle ends after ``rounds``."""
    chain = renames.groupBy("source").agg(F.min("target").alias("final"))
    for _ in range(rounds):
        step = chain.select(F.col("source").alias("_s"), F.col("final").alias("_f"))
        chain = materialise(chain.join(step, chain["final"] == step["_s"], "left").select("source", F.coalesce("_f", "final").alias("final"), F.col("_f").isNotNull().alias("_moved")), "renames")
        if not chain.where("_moved").limit(1).count():
            break
        chain = chain.drop("_moved")
    return chain.select("source", "final")


def index_plan(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(ns, name) of the indexes still to build: those wanted, without that on _id and those that expire rows, not there yet."""
    todo = wanted.where((F.col("name") != "_id_") & ~F.coalesce("expires", F.lit(False))).select("ns", "name").distinct()
    return todo.join(existing.select("ns", "name").distinct(), ["ns", "name"], "left_anti")


def apply_to_catalog(spark, changes: DataFrame, location: str | None = None) -> list[str]:
    """Apply schema changes, in order, to Spark's catalog: databases and tables; indexes have no counterpart there.

    New databases lie under ``location``, by default in the session's warehouse. Returns the statements run. Only changes of
    collections and databases come to the driver, as the statements on the catalog must run there one by one.
    """
    done = []

    def name(db: str, coll: str) -> str:
        return f"`{db}`.`{coll}`"

    def database_of(db: str) -> str:
        return f"CREATE DATABASE IF NOT EXISTS `{db}`" + (f" LOCATION '{location}/{db}'" if location else "")

    own = changes.where("ddl_type in ('CREATE_COLLECTION', 'DROP_COLLECTION', 'DROP_DATABASE', 'RENAME_COLLECTION')")
    for r in own.orderBy("ts_t", "ts_i", "database", "collection").toLocalIterator():
        kind, db, coll = r["ddl_type"], r["database"], r["collection"]
        if kind == "CREATE_COLLECTION":
            todo = [database_of(db), f"CREATE TABLE IF NOT EXISTS {name(db, coll)} (_id STRING, doc STRING) USING parquet"]
        elif kind == "DROP_COLLECTION":
            todo = [f"DROP TABLE IF EXISTS {name(db, coll)}"]
        elif kind == "DROP_DATABASE":
            todo = [f"DROP DATABASE IF EXISTS `{db}` CASCADE"]
        elif kind == "RENAME_COLLECTION" and spark.catalog.tableExists(f"{db}.{coll}"):
            to_db, to_coll = r["target"].split(".", 1)
            todo = [database_of(to_db), f"DROP TABLE IF EXISTS {name(to_db, to_coll)}", f"ALTER TABLE {name(db, coll)} RENAME TO {name(to_db, to_coll)}"]
            if to_db != db:  # the catalog renames within a database only
                todo[2:] = [f"CREATE TABLE {name(to_db, to_coll)} USING parquet AS SELECT * FROM {name(db, coll)}", f"DROP TABLE {name(db, coll)}"]
        else:
            todo = []
        for statement in todo:
            spark.sql(statement)
        done += todo
    return done
