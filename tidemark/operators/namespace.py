"""Namespace rules: system namespaces, white and black lists, renaming, and which schema changes end a namespace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.parse import collection, database

#: Databases that hold no user data.
SYSTEM_DATABASES = ("admin", "local", "config")


def is_system(ns: Column | str) -> Column:
    """A null namespace, one of a system database (in any case), or a system collection."""
    c = F.col(ns) if isinstance(ns, str) else ns
    return c.isNull() | F.lower(database(c)).isin(*SYSTEM_DATABASES) | F.coalesce(collection(c).startswith("system."), F.lit(False))


def parse_rules(text: Column | str) -> Column:
    """The distinct rules of a ``;``-separated list, trimmed, without empty ones, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != ""))


def split_rules(text: str | None) -> list[str]:
    return list(dict.fromkeys(x for part in (text or "").split(";") if (x := part.strip())))


def accepted(ns: Column | str, white: str | None = None, black: str | None = None) -> Column:
    """Namespaces that the rules let through; a rule is a database or a namespace. Only one of the lists may be given."""
    keep, drop = split_rules(white), split_rules(black)
    if keep and drop:
        raise ValueError("a white list and a black list exclude each other")
    c = F.col(ns) if isinstance(ns, str) else ns
    user = ~is_system(c)
    if keep:
        return user & (c.isin(keep) | database(c).isin(keep))
    if drop:
        return user & ~(c.isin(drop) | database(c).isin(drop))
    return user


def map_namespaces(df: DataFrame, ns_map: DataFrame, source: str = "source_ns", target: str = "target_ns") -> DataFrame:
    """Add the target namespace, database and collection: by the map, else the same. The map is configuration; Spark broadcasts it by its size."""
    rules = ns_map.groupBy(F.col(source).alias("_from")).agg(F.min(target).alias("_to"))
    joined = df.join(rules, df["ns"] == F.col("_from"), "left").withColumn("target_ns", F.coalesce("_to", "ns")).drop("_from", "_to")
    return joined.withColumn("target_db", database("target_ns")).withColumn("target_coll", collection("target_ns"))


def discover(*frames: DataFrame) -> DataFrame:
    """(ns, db, coll): the user namespaces of these tables."""
    every = frames[0].select("ns")
    for f in frames[1:]:
        every = every.unionByName(f.select("ns"))
    return every.distinct().where(~is_system("ns") & (collection("ns") != "$cmd")).select("ns", database("ns").alias("db"), collection("ns").alias("coll"))


def ends_namespace(ns: str) -> Column:
    """Schema changes after which a namespace isn't there any more: its drop, its database's, and renames from or to it."""
    db, coll = ns.split(".", 1)
    here = F.col("database") == db
    moved = (F.col("ddl_type") == "RENAME_COLLECTION") & ((here & (F.col("collection") == coll)) | F.coalesce(F.col("target") == ns, F.lit(False)))
    return ((F.col("ddl_type") == "DROP_COLLECTION") & here & (F.col("collection") == coll)) | ((F.col("ddl_type") == "DROP_DATABASE") & here) | moved


def endings(ddl: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of schema changes with the ``ns`` that they end, one row per namespace; ``known`` (ns, db) are those of a dropped database."""
    here = F.concat_ws(".", "database", "collection")
    own = F.when(F.col("ddl_type") == "DROP_COLLECTION", F.array(here)).when(F.col("ddl_type") == "RENAME_COLLECTION", F.array_compact(F.array_distinct(F.array(here, F.col("target")))))
    single = ddl.where("ddl_type in ('DROP_COLLECTION', 'RENAME_COLLECTION')").withColumn("ns", F.explode(own))
    whole = ddl.where("ddl_type = 'DROP_DATABASE'").join(known.select("ns", F.col("db").alias("_db")), F.col("database") == F.col("_db")).drop("_db")
    return single.unionByName(whole)


#: Error codes and texts that say that a namespace or a cursor's target no longer exists.
GONE_CODES = (26, 175)
GONE_TEXTS = ("ns not found", "namespace not found", "namespace does not exist", "collection dropped", "collection not found", "collection renamed", "was renamed")


def is_gone(message: Column | str, code: Column | str | None = None) -> Column:
    """Errors that say, by code or by text, that a namespace or cursor target no longer exists."""
    text = F.lower(message).rlike("|".join(GONE_TEXTS))
    if code is None:
        return text
    c = F.col(code) if isinstance(code, str) else code
    return F.coalesce(c.isin(*GONE_CODES), F.lit(False)) | F.coalesce(text, F.lit(False))


#: Error codes of a log that no longer reaches back to the start position.
HISTORY_LOST_CODES = (136, 203, 234)


def is_history_lost(code: Column | str) -> Column:
    """Error codes of a log that no longer reaches back to the start position."""
    c = F.col(code) if isinstance(code, str) else code
    return c.isin(*HISTORY_LOST_CODES)
