"""Structure of a source: collections, views and indexes with their options, and what a target still lacks of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.parse import database, first_key

#: Fields of a collation.
COLLATION = "locale string, caseLevel string, caseFirst string, strength string, numericOrdering string, alternate string, maxVariable string, normalization string, backwards string"
#: Fields of a create command that aren't options of the collection.
_NOT_OPTIONS = ("create", "idIndex", "v", "lsid", "$db")
#: Options that a view has.
_VIEW = ("viewOn", "pipeline")


def collation(text: Column) -> Column:
    """A collation's fields from JSON text: flags as booleans, the strength as a number; null without one."""
    c = F.from_json(text, COLLATION)
    flag = lambda name: F.lower(c[name]).isin("true", "1").alias(name)
    return F.when(text.isNotNull(), F.struct(c["locale"].alias("locale"), flag("caseLevel"), c["caseFirst"].alias("caseFirst"), c["strength"].try_cast("int").alias("strength"), flag("numericOrdering"), c["alternate"].alias("alternate"), c["maxVariable"].alias("maxVariable"), flag("normalization"), flag("backwards")))


def collections(oplog: DataFrame) -> DataFrame:
    """Collections and views that a log creates: (entry_id, ns, kind, capped, size, max, expire_seconds, validator, time_field, meta_field, granularity, view_on, pipeline, collation, options).

    kind is collection, timeseries or view; ``options`` is the JSON of all options, also those without a column.
    """
    rows = oplog.where((F.col("op") == "c") & (first_key("o") == "create"))
    option = lambda name: F.get_json_object("o", f"$.{name}")
    whole = lambda name: option(name).try_cast("double").cast("bigint")
    kept = F.map_filter(F.try_parse_json("o").try_cast("map<string,variant>"), lambda k, v: ~k.isin(*_NOT_OPTIONS))
    return rows.select(
        "entry_id",
        F.concat_ws(".", database("ns"), option("create")).alias("ns"),
        F.when(option("viewOn").isNotNull(), "view").when(option("timeseries").isNotNull(), "timeseries").otherwise("collection").alias("kind"),
        F.coalesce(F.lower(option("capped")).isin("true", "1"), F.lit(False)).alias("capped"),
        whole("size").alias("size"),
        whole("max").alias("max"),
        whole("expireAfterSeconds").alias("expire_seconds"),
        option("validator").alias("validator"),
        option("timeseries.timeField").alias("time_field"),
        option("timeseries.metaField").alias("meta_field"),
        F.upper(option("timeseries.granularity")).alias("granularity"),
        option("viewOn").alias("view_on"),
        option("pipeline").alias("pipeline"),
        collation(option("collation")).alias("collation"),
        F.to_json(kept).alias("options"),
    )


def missing(wanted: DataFrame, indexes: DataFrame, existing: DataFrame, existing_indexes: DataFrame, skip_expiring: bool = True) -> DataFrame:
    """What a target still lacks: (step, action, ns, name, spec), to be done in order of step.

    Collections come before the indexes on them and views last, since a view reads from collections. What exists, by
    namespace or by index name, is left as it is; indexes on _id are made with their collection, and those that expire
    documents would delete on both sides. ``wanted`` is (ns, kind, options), ``indexes`` (ns, name, key, spec,
    expire_seconds), the existing ones (ns) and (ns, name). A view without source or pipeline is an error.
    """
    todo = wanted.groupBy("ns").agg(F.max_by(F.struct("kind", "options"), F.struct("kind", "options")).alias("w")).join(existing.select("ns").distinct(), "ns", "left_anti").select("ns", "w.*")
    is_view = F.col("kind") == "view"
    whole = F.get_json_object("options", "$.viewOn").isNotNull() & F.get_json_object("options", "$.pipeline").isNotNull()
    spec = F.when(is_view & ~whole, F.raise_error(F.concat(F.lit("a view needs viewOn and pipeline: "), "ns"))).otherwise(F.col("options"))
    made = todo.select(F.when(is_view, 3).otherwise(1).alias("step"), F.when(is_view, "CREATE_VIEW").otherwise("CREATE_COLLECTION").alias("action"), "ns", F.lit(None).cast("string").alias("name"), spec.alias("spec"))
    views = todo.where(is_view).select("ns")
    keep = (F.col("name") != "_id_") & F.col("key").isNotNull() & (F.col("key") != "{}")
    if skip_expiring:
        keep = keep & F.col("expire_seconds").isNull()
    built = indexes.where(keep).groupBy("ns", "name").agg(F.max("spec").alias("spec")).join(existing_indexes.select("ns", "name").distinct(), ["ns", "name"], "left_anti").join(views, "ns", "left_anti")
    return made.unionByName(built.select(F.lit(2).alias("step"), F.lit("CREATE_INDEX").alias("action"), "ns", "name", "spec"))
