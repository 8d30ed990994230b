"""What a source server can do: topology, versions, and how changes can be captured from it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def topology() -> Column:
    """From a server's hello reply (msg, set_name, hosts): a router says so, a replica set names itself."""
    is_set = (F.coalesce("set_name", F.lit("")) != "") | (F.coalesce(F.size("hosts"), F.lit(0)) > 0)
    return F.when(F.col("msg") == "isdbgrid", "SHARDING").when(is_set, "REPLICA_SET").otherwise("STANDALONE")


def version_part(version: Column, index: int) -> Column:
    """The number at a place of a dotted version; 0 where there is none."""
    parts = F.split(F.regexp_extract(version, r"(\d+(?:\.\d+)*)", 1), r"\.")
    return F.coalesce(F.try_element_at(parts, F.lit(index + 1)).try_cast("int"), F.lit(0))


def at_least(version: Column, major: int, minor: int = 0) -> Column:
    m, n = version_part(version, 0), version_part(version, 1)
    return (m > major) | ((m == major) & (n >= minor))


def log_format(version: Column) -> Column:
    """V1 below 3.6, V2 below 5.0, V3 below 7.0; later logs can't be read."""
    return F.when(~at_least(version, 3, 6), "V1").when(~at_least(version, 5), "V2").when(~at_least(version, 7), "V3")


def supports_oplog(version: Column) -> Column:
    return ~at_least(version, 7)


def supports_change_stream(version: Column) -> Column:
    return at_least(version, 3, 6)


def capture_mode() -> Column:
    """AUTO is the change stream where there is one, else the log of a replica set; other combinations give an error text.

    Columns: requested, topology, version, incremental.
    """
    stream, log = supports_change_stream(F.col("version")), supports_oplog(F.col("version"))
    topo = F.col("topology")
    auto = (
        F.when(~F.col("incremental"), F.when(stream & (topo != "STANDALONE"), "CHANGE_STREAM").otherwise("OPLOG"))
        .when(topo == "STANDALONE", "ERROR: a standalone server has no change log")
        .when(stream, "CHANGE_STREAM")
        .when(topo == "SHARDING", "ERROR: a sharded source needs ChangeStream, from 3.6 on")
        .otherwise("OPLOG")
    )
    return F.when(F.col("requested") == "AUTO", auto).when(
        F.col("incremental"),
        F.when(topo == "STANDALONE", "ERROR: a standalone server has no change log")
        .when((F.col("requested") == "OPLOG") & (topo == "SHARDING"), "ERROR: multi-shard OPLOG isn't supported")
        .when((F.col("requested") == "OPLOG") & ~log, "ERROR: this version's OPLOG can't be read")
        .when((F.col("requested") == "CHANGE_STREAM") & ~stream, "ERROR: ChangeStream needs 3.6")
        .otherwise(F.col("requested")),
    ).otherwise(F.col("requested"))


def is_capable() -> Column:
    return ~capture_mode().startswith("ERROR")
