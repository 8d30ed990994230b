"""Log entries and change-stream messages to one event envelope, by column expressions.

Documents stay extended JSON text. Only update diffs of the newest log format, which nest to any depth, are rewritten by
an Arrow function.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.docs import parse_raw
from tidemark.operators.mor_table import _text
from tidemark.session import ship

#: The first key of a command entry, and the kind of schema change that it is.
COMMANDS = {
    "create": "CREATE_COLLECTION",
    "createIndexes": "CREATE_INDEXES",
    "commitIndexBuild": "CREATE_INDEXES",
    "dropIndexes": "DROP_INDEXES",
    "drop": "DROP_COLLECTION",
    "renameCollection": "RENAME_COLLECTION",
    "dropDatabase": "DROP_DATABASE",
}
#: Change-stream operations that change the schema.
STREAM_DDL = {
    "create": "CREATE_COLLECTION",
    "createindexes": "CREATE_INDEXES",
    "dropindexes": "DROP_INDEXES",
    "drop": "DROP_COLLECTION",
    "rename": "RENAME_COLLECTION",
    "dropdatabase": "DROP_DATABASE",
}


def _lookup(value: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[value]


def database(ns: Column | str) -> Column:
    return F.substring_index(ns, ".", 1)


def collection(ns: Column | str) -> Column:
    """What follows the first dot; null without a dot."""
    c = F.col(ns) if isinstance(ns, str) else ns
    return F.when(F.instr(c, ".") > 0, F.substring(c, F.instr(c, ".") + 1, F.length(c)))


def first_key(doc: Column | str) -> Column:
    return F.json_object_keys(doc)[0]


def is_index_insert() -> Column:
    """An old index build: an insert without _id into system.indexes of its own database."""
    return (
        (F.col("op") == "i")
        & (collection("ns") == "system.indexes")
        & F.get_json_object("o", "$._id").isNull()
        & (database(F.get_json_object("o", "$.ns")) == database("ns"))
    )


def entry_kind(watched: str | None = None) -> Column:
    """CRUD, DDL or SKIP of a log entry; with ``watched``, only that namespace's entries aren't skipped."""
    own = F.lit(True) if watched is None else F.col("ns") == watched
    own_db = F.lit(True) if watched is None else database("ns") == watched.split(".", 1)[0]
    command = _lookup(first_key("o"), COMMANDS)
    index = is_index_insert() & (F.lit(True) if watched is None else F.get_json_object("o", "$.ns") == watched)
    return (
        F.when(F.col("op").isNull() | (F.col("op") == "n") | F.col("o").isNull(), "SKIP")
        .when(index, "DDL")
        .when(F.col("op").isin("i", "u", "d") & own & ~collection("ns").startswith("system."), "CRUD")
        .when((F.col("op") == "c") & own_db & command.isNotNull(), "DDL")
        .otherwise("SKIP")
    )


def _normal_update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("after_doc").to_pylist()
        out = [normalise_update(x) if op == "u" else x for op, x in zip(batch.column("op").to_pylist(), column)]
        k = batch.schema.get_field_index("after_doc")
        yield batch.set_column(k, batch.schema.field(k), pa.array(out, pa.string()))


def diff_operators(diff: dict, prefix: str = "") -> tuple[dict, dict]:
    """($set, $unset) of a diff: d unsets, i and u set, s<field> goes one level down; in an array, u<N> is element N.

    A lone truncation (l) has no operator form and changes nothing here.
    """
    puts, drops = {}, {}
    array = diff.get("a") is True or (prefix and "a" in diff)
    for key, value in diff.items():
        if key in ("d", "i", "u") and isinstance(value, dict):
            for path in value:
                if key == "d":
                    drops[prefix + path] = False
                else:
                    puts[prefix + path] = value[path]
        elif key[:1] == "s" and len(key) > 1 and isinstance(value, dict):
            more, less = diff_operators(value, f"{prefix}{key[1:]}.")
            puts |= more
            drops |= less
        elif array and key[:1] == "u" and key[1:].isdigit():
            puts[prefix + key[1:]] = value
    return puts, drops


def normalise_update(text: str | None) -> str | None:
    """An update's payload as a whole document or ``$set``/``$unset``, without ``$v``; broken text stays as it is."""
    doc = parse_raw(text)
    if not isinstance(doc, dict):
        return text
    if "$v" in doc and isinstance(doc.get("diff"), dict):
        puts, drops = diff_operators(doc["diff"])
        doc = {**({"$set": puts} if puts else {}), **({"$unset": drops} if drops else {})}
        return _text(doc if doc else {"$set": {}})
    return _text({k: v for k, v in doc.items() if k != "$v"})


def wall_ms(df: DataFrame, name: str) -> Column:
    """Milliseconds of a wall clock column; null where the table has no such column or the entry no such value."""
    return F.unix_millis(F.col(name).cast("timestamp")) if name in df.columns else F.lit(None).cast("bigint")


def log_events(oplog: DataFrame) -> DataFrame:
    """CRUD entries in the event envelope.

    (entry_id, shard, ns, op, before_doc, after_doc, cluster_time_ms, ts_ms, ts_t, ts_i, phase, wall_ms): ts_ms is the
    position's time; wall_ms the clock of the server that wrote the entry, where the log's version has it.
    """
    ship(oplog.sparkSession)
    op = F.when(F.col("op") == "i", "c").otherwise(F.col("op"))
    before = F.when(F.col("op") == "u", F.col("o2")).when(F.col("op") == "d", F.col("o"))
    after = F.when(F.col("op") != "d", F.col("o"))
    ms = F.col("ts.t") * 1000
    rows = oplog.where(entry_kind() == "CRUD").select(
        "entry_id", "shard", "ns", op.alias("op"), before.alias("before_doc"), after.alias("after_doc"), ms.alias("cluster_time_ms"), ms.alias("ts_ms"), F.col("ts.t").alias("ts_t"), F.col("ts.i").alias("ts_i"), F.lit(1).alias("phase"), wall_ms(oplog, "wall").alias("wall_ms")
    )
    return rows.mapInArrow(_normal_update, rows.schema)


_PATCH = pa.schema([("key", pa.int64()), ("action", pa.string()), ("path", pa.string()), ("value", pa.string())])


def patch_operations(df: DataFrame, key: str, update: str) -> DataFrame:
    """(key, action, path, value): one row per path that an update sets or unsets; whole documents give none."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = parse_raw(normalise_update(text))
                if isinstance(doc, dict):
                    for action in ("$set", "$unset"):
                        if isinstance(part := doc.get(action), dict):
                            out += [(k, action, p, _text(v) if action == "$set" else None) for p, v in part.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, _PATCH)], schema=_PATCH)

    return df.select(F.col(key).cast("bigint").alias(key), update).mapInArrow(run, f"`{key}` bigint, action string, path string, value string")


def stream_op() -> Column:
    """c, u or d of a change-stream operation. Others have no event: one unknown may be anything, so it isn't taken for an update."""
    kind = F.lower("operation_type")
    return F.when(kind == "insert", "c").when(kind.isin("update", "replace"), "u").when(kind == "delete", "d")


def update_payload() -> Column:
    """``$set`` and ``$unset`` of an update's description as JSON text; null if it changes nothing."""
    fields = F.when(F.col("updated_fields").isNotNull() & (F.regexp_replace("updated_fields", r"\s", "") != "{}"), F.col("updated_fields"))
    gone = F.when(F.size("removed_fields") > 0, F.to_json(F.map_from_arrays("removed_fields", F.transform("removed_fields", lambda _: F.lit(True)))))
    parts = F.array_compact(F.array(F.concat(F.lit('"$set":'), fields), F.concat(F.lit('"$unset":'), gone)))
    return F.when(F.size(parts) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def event_time(batch_ms: int) -> Column:
    """Milliseconds of the cluster time, else of the batch."""
    return F.coalesce(F.col("cluster_time.t") * 1000, F.lit(batch_ms))


def stream_events(changes: DataFrame, batch_ms: int, pre_image: str | None = None) -> DataFrame:
    """CRUD messages in the event envelope. ``pre_image`` names a column with the document before, where there is one."""
    op = stream_op()
    before = F.coalesce(F.col(pre_image), F.col("document_key")) if pre_image else F.col("document_key")
    after = F.when(op == "c", F.col("full_document")).when(F.lower("operation_type") == "replace", F.col("full_document")).when(op == "u", F.coalesce(update_payload(), F.col("full_document")))
    return changes.where(op.isNotNull()).select(
        "delivery_id", "shard", "ns", op.alias("op"), F.when(op != "c", before).alias("before_doc"), after.alias("after_doc"), event_time(batch_ms).alias("cluster_time_ms"), event_time(batch_ms).alias("ts_ms"), F.col("cluster_time.t").alias("ts_t"), F.col("cluster_time.i").alias("ts_i"), F.lit(1).alias("phase"), wall_ms(changes, "wall_time").alias("wall_ms")
    )


def stream_ddl(changes: DataFrame) -> DataFrame:
    """Schema changes of a change stream; an invalidate is none.

    Where the table has them, ``to_ns`` gives a rename's target, and ``operation_description`` (JSON) the indexes: one
    row per index built or dropped. ``command`` is the change in the form of a log's command. A rename without a target is
    an error where the table has targets; where it has none, the command is null.
    """
    kind = _lookup(F.lower("operation_type"), STREAM_DDL)
    text = lambda name: F.col(name) if name in changes.columns else F.lit(None).cast("string")
    rows = changes.where(kind.isNotNull()).select("delivery_id", kind.alias("ddl_type"), database("ns").alias("database"), collection("ns").alias("collection"), text("to_ns").alias("target"), text("operation_description").alias("_d"), F.col("cluster_time.t").alias("ts_t"), F.col("cluster_time.i").alias("ts_i"))
    specs = F.from_json(F.get_json_object("_d", "$.indexes"), "array<string>")
    rows = rows.withColumn("spec", F.explode_outer(F.coalesce(specs, F.array().cast("array<string>"))))
    rows = rows.withColumn("index_name", F.get_json_object("spec", "$.name"))
    quoted = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    verb = F.map_from_arrays(F.array(*map(F.lit, STREAM_DDL.values())), F.array(*map(F.lit, ("create", "createIndexes", "dropIndexes", "drop", "renameCollection", "dropDatabase"))))[F.col("ddl_type")]
    body = (
        F.when((F.col("ddl_type") == "RENAME_COLLECTION") & F.col("target").isNull() & F.lit("to_ns" not in changes.columns), F.lit(None).cast("string"))
        .when((F.col("ddl_type") == "RENAME_COLLECTION") & F.col("target").isNull(), F.raise_error(F.concat(F.lit("a rename without a target: delivery "), F.col("delivery_id").cast("string"))))
        .when(F.col("ddl_type") == "RENAME_COLLECTION", F.concat(quoted(F.concat_ws(".", "database", "collection")), F.lit(',"to":'), quoted(F.col("target"))))
        .when(F.col("ddl_type") == "DROP_DATABASE", F.lit("1"))
        .when((F.col("ddl_type") == "CREATE_INDEXES") & F.col("spec").isNotNull(), F.concat(quoted(F.col("collection")), F.lit(',"indexes":['), "spec", F.lit("]")))
        .when((F.col("ddl_type") == "DROP_INDEXES") & F.col("index_name").isNotNull(), F.concat(quoted(F.col("collection")), F.lit(',"index":'), quoted(F.col("index_name"))))
        .otherwise(quoted(F.col("collection")))
    )
    command = F.concat(F.lit('{"'), verb, F.lit('":'), body, F.lit("}"))
    return rows.select("delivery_id", "ddl_type", "database", "collection", "target", "index_name", command.alias("command"), "ts_t", "ts_i")


def log_ddl(oplog: DataFrame) -> DataFrame:
    """Schema changes of a log: (entry_id, ddl_type, database, collection, target, index_name, ts_t, ts_i).

    Index builds of every format come out alike: an insert into system.indexes, a command, or the end of a build; one row
    for each index that a command builds or names in a list to drop. A drop of ``*`` names all indexes but that on _id.
    """
    key = first_key("o")
    index = is_index_insert()
    kind = F.when(index, "CREATE_INDEXES").otherwise(_lookup(key, COMMANDS))
    named = F.when(index, collection(F.get_json_object("o", "$.ns"))).when(key == "dropDatabase", F.lit(None)).when(key == "renameCollection", collection(F.get_json_object("o", "$.renameCollection"))).otherwise(F.from_json("o", "map<string,string>")[key])
    built = F.transform(F.from_json(F.get_json_object("o", "$.indexes"), "array<string>"), lambda spec: F.get_json_object(spec, "$.name"))
    dropped = F.from_json(F.when(F.get_json_object("o", "$.index").startswith("["), F.get_json_object("o", "$.index")), "array<string>")
    single = F.array(F.coalesce(F.get_json_object("o", "$.name"), F.get_json_object("o", "$.index")))
    names = F.when(F.size(built) > 0, built).when(F.size(dropped) > 0, dropped).otherwise(single)
    rows = oplog.where((index | (F.col("op") == "c")) & kind.isNotNull())
    return rows.select("entry_id", kind.alias("ddl_type"), database("ns").alias("database"), named.alias("collection"), F.get_json_object("o", "$.to").alias("target"), F.explode(names).alias("index_name"), F.col("ts.t").alias("ts_t"), F.col("ts.i").alias("ts_i"))


#: Fields of an index insert that aren't options of the index.
_NOT_OPTIONS = ("ns",)


def index_command(oplog: DataFrame) -> DataFrame:
    """(entry_id, command): index builds by insert, rewritten as a createIndexes command with an indexes array; every option stays."""
    fields = F.map_filter(F.from_json("o", "map<string,string>"), lambda k, v: ~k.isin(*_NOT_OPTIONS))
    doc = F.try_parse_json("o").try_cast("map<string,variant>")
    spec = F.to_json(F.map_filter(doc, lambda k, v: ~k.isin(*_NOT_OPTIONS)))
    command = F.to_json(F.struct(collection(F.get_json_object("o", "$.ns")).alias("createIndexes"), F.lit("@").alias("indexes")))
    whole = F.concat(F.expr("substring(_c, 1, length(_c) - 4)"), F.lit("["), F.coalesce("_s", F.to_json("_f")), F.lit("]}"))
    return oplog.where(is_index_insert()).select("entry_id", command.alias("_c"), spec.alias("_s"), fields.alias("_f")).select("entry_id", whole.alias("command"))


def extract_id() -> Column:
    """The ``_id`` of the document after, else before, as text."""
    return F.coalesce(F.get_json_object("after_doc", "$._id"), F.get_json_object("before_doc", "$._id"))


def is_patch(doc: Column | str, id_field: str = "_id") -> Column:
    """An update document: some key starts with ``$``, and any other is the id."""
    keys = F.json_object_keys(doc)
    return F.coalesce(F.exists(keys, lambda k: k.startswith("$")) & F.forall(keys, lambda k: k.startswith("$") | (k == id_field)), F.lit(False))


def position_text(seconds: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ssZ`` in UTC, whatever the session's zone."""
    return F.concat(F.date_format(F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds), "yyyy-MM-dd HH:mm:ss"), F.lit("+0000"))


def token_digest(token: Column | str) -> Column:
    """A token short enough for a log line: more than 120 characters are cut to 117 and three dots."""
    c = F.col(token) if isinstance(token, str) else token
    return F.when(F.length(c) > 120, F.concat(F.substring(c, 1, 117), F.lit("..."))).otherwise(c)


def offset_file(ns: Column, shard: Column, suffix: str) -> Column:
    """File name of a stored offset: ``db__collection__shard.suffix`` with everything unusual as an underscore."""
    clean = lambda c: F.regexp_replace(c, r"[^a-zA-Z0-9._-]", "_")
    return F.concat(F.concat_ws("__", clean(database(ns)), clean(collection(ns)), clean(shard)), F.lit("." + suffix))


def log_line(**columns: Column) -> Column:
    """``k=v k=v``; values that aren't plain (letters, digits and ``._:/()-``) are quoted, with quotes and backslashes escaped; ends are trimmed."""
    parts = []
    for name, value in columns.items():
        text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
        plain = text.rlike(r"^[A-Za-z0-9._:/()-]+$")
        escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        parts.append(F.concat(F.lit(name + "="), F.when(plain, text).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))))
    return F.concat_ws(" ", *parts)


def transit_value(value: Column) -> Column:
    """A tagged value in the transit encoding: dates as milliseconds, object ids and decimals as text, the rest as it is."""
    date = F.get_json_object(value, "$.$date")
    ms = F.unix_millis(F.to_timestamp(date))
    return F.coalesce(F.when(date.isNotNull(), ms.cast("string")), F.get_json_object(value, "$.$oid"), F.get_json_object(value, "$.$numberDecimal"), F.get_json_object(value, "$.$numberLong"), value)


def index_specs(oplog: DataFrame) -> DataFrame:
    """One row per index that a log creates, in whatever form: its key and options.

    (entry_id, ns, name, key, is_unique, sparse, expire_seconds, partial_filter, collation, hidden, spec): collation is
    its locale, ``spec`` the JSON of the index with all its options, also those without a column.
    """
    many = F.from_json(F.get_json_object("o", "$.indexes"), "array<string>")
    single = F.array(F.col("o"))
    rows = oplog.where(is_index_insert() | ((F.col("op") == "c") & first_key("o").isin("createIndexes", "commitIndexBuild")))
    coll = F.when(is_index_insert(), collection(F.get_json_object("o", "$.ns"))).otherwise(F.from_json("o", "map<string,string>")[first_key("o")])
    spec = rows.select("entry_id", F.concat_ws(".", database("ns"), coll).alias("ns"), F.explode(F.coalesce(many, single)).alias("s"))
    option = lambda name: F.get_json_object("s", f"$.{name}")
    yes = lambda name: F.coalesce(F.lower(option(name)).isin("true", "1", "1.0"), F.lit(False))
    kept = F.map_filter(F.try_parse_json("s").try_cast("map<string,variant>"), lambda k, v: ~k.isin("ns", "createIndexes"))
    return spec.select(
        "entry_id", "ns", option("name").alias("name"), option("key").alias("key"), yes("unique").alias("is_unique"), yes("sparse").alias("sparse"), option("expireAfterSeconds").try_cast("double").cast("bigint").alias("expire_seconds"),
        option("partialFilterExpression").alias("partial_filter"), option("collation.locale").alias("collation"), yes("hidden").alias("hidden"), F.to_json(kept).alias("spec"),
    )
