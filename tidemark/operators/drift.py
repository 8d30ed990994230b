"""Schemas that drift between files.

Each file's documents are inferred in parallel: a batch gives, for every dotted path, how many values it has of each
type, and these counts are fused by a sum, so alternative types of a path are all kept (a tagged union). From the fused
counts come the report of changes between consecutive files, and one consistent table in which a path with conflicting
types has a column per type and a canonical text column beside them. Column names are unique whatever their case.

Defined cases: entries with a null shard, ts, ns or file are left out; broken or null documents have no fields; of
copies of an entry in its lowest file the one with the smallest entry_id counts; types that are equally frequent are
taken in alphabetical order; a field with only nulls in a file has no type there and is not retyped; an empty object is
a field of type object; if several added fields fit a removed one, the first by name is its new name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.functions.docs import Raw, canonical, leaves, parse, parse_raw, type_name
from tidemark.operators.mor_table import _text
from tidemark.session import materialise, ship

GROUP = ["shard", "ns", "doc_part"]
FIELDS = "shard string, ns string, doc_part string, file_no int, path string, type string, n bigint"
_FIELDS = pa.schema([("shard", pa.string()), ("ns", pa.string()), ("doc_part", pa.string()), ("file_no", pa.int32()), ("path", pa.string()), ("type", pa.string()), ("n", pa.int64())])
#: Most columns that the consistent table may get; more distinct paths than this are an error, never a silent cut.
MAX_COLUMNS = 5000


def log_documents(oplog: DataFrame) -> DataFrame:
    """(entry_id, shard, ns, doc_part, file_no, ts_t, ts_i, op, doc): documents of full writes (o) and of update keys (o2).

    The row_number filter is a window group limit, so copies are dropped before the shuffle as well as after.
    """
    coll = F.expr("substring(ns, instr(ns, '.') + 1)")
    kept = oplog.where("op in ('i', 'u') and shard is not null and file_no is not null and ts.t is not null and ts.i is not null and ns is not null").where(
        ~F.col("ns").startswith("config.") & ~coll.startswith("system.") & (coll != "$cmd")
    )
    first = Window.partitionBy("shard", "ts").orderBy("file_no", "entry_id")
    rows = kept.select("entry_id", "shard", "ts", "file_no", "op", "ns", "o", "o2").withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    # an update whose o has a $ field is a patch; top-level keys decide
    keys = F.expr("json_object_keys(o)")
    full = (F.col("op") == "i") | ~F.exists(F.coalesce(keys, F.array().cast("array<string>")), lambda k: k.startswith("$"))
    parts = F.array(
        F.struct(F.lit("o").alias("doc_part"), F.when(full, F.col("o")).alias("doc")),
        F.struct(F.lit("o2").alias("doc_part"), F.when(F.col("op") == "u", F.col("o2")).alias("doc")),
    )
    return rows.select("entry_id", "shard", "ns", "file_no", F.col("ts.t").alias("ts_t"), F.col("ts.i").alias("ts_i"), "op", F.explode(parts).alias("p")).where("p.doc is not null").select("entry_id", "shard", "ns", "p.doc_part", "file_no", "ts_t", "ts_i", "op", "p.doc")


def _count_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files: dict[tuple, dict] = {}
        for *file, text in zip(*(batch.column(c).to_pylist() for c in (*GROUP, "file_no", "doc"))):
            seen = files.setdefault(tuple(file), {})
            seen[None, None] = seen.get((None, None), 0) + 1  # the file has documents
            doc = parse(text)
            for path, value in leaves(doc) if isinstance(doc, dict) else ():
                key = (path, type_name(value))
                seen[key] = seen.get(key, 0) + 1
        rows = [(*file, *key, n) for file, seen in files.items() for key, n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_FIELDS), _FIELDS)], schema=_FIELDS)


def infer_union(documents: DataFrame) -> DataFrame:
    """(shard, ns, doc_part, file_no, path, type, n): the tagged union of every file; a null path counts the documents."""
    ship(documents.sparkSession)
    counts = documents.select(*GROUP, "file_no", "doc").mapInArrow(_count_types, FIELDS)
    return counts.groupBy(*GROUP, "file_no", "path", "type").agg(F.sum("n").alias("n"))


def file_changes(union: DataFrame) -> DataFrame:
    """(shard, ns, doc_part, file_no, old_file, drift_kind, field_path) between each file and the one before; no renames yet."""
    ranked = F.min(F.when(F.col("type").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("type").alias("type"))))
    fields = union.groupBy(*GROUP, "file_no", "path").agg(ranked.getField("type").alias("type"))
    # one row per file, so the window never holds the fields of a namespace
    w = Window.partitionBy(*GROUP).orderBy("file_no")
    files = union.where("path is null").select(*GROUP, "file_no").distinct()
    files = files.withColumn("before", F.lag("file_no").over(w)).withColumn("after", F.lead("file_no").over(w))
    placed = fields.join(files, [*GROUP, "file_no"])
    # each field is looked at as the new side of its own file and the old side of the next one
    sides = F.array(
        F.struct(F.col("file_no").alias("at"), F.col("before").alias("old_file"), F.lit(True).alias("new")),
        F.struct(F.col("after").alias("at"), F.col("file_no").alias("old_file"), F.lit(False).alias("new")),
    )
    both = placed.where("path is not null").select(*GROUP, "path", "type", F.explode(sides).alias("s")).where("s.at is not null and s.old_file is not null")
    is_new = F.col("s.new")
    compared = both.groupBy(*GROUP, F.col("s.at").alias("file_no"), F.col("s.old_file").alias("old_file"), F.col("path").alias("field_path")).agg(
        F.max(F.when(is_new, 1).otherwise(0)).alias("has_new"),
        F.max(F.when(is_new, 0).otherwise(1)).alias("has_old"),
        F.max(F.when(is_new, F.col("type"))).alias("new_type"),
        F.max(F.when(~is_new, F.col("type"))).alias("old_type"),
    )
    kind = F.when(F.col("has_new") == 0, "removed").when(F.col("has_old") == 0, "added").when(F.col("new_type") != F.col("old_type"), "retyped")
    return compared.select(*GROUP, "file_no", "old_file", kind.alias("drift_kind"), "field_path").where("drift_kind is not null")


_VALUES = pa.schema([("id", pa.string()), ("path", pa.string()), ("value", pa.string()), ("at", pa.int32()), ("new", pa.bool_()), ("shard", pa.string()), ("ns", pa.string()), ("doc_part", pa.string()), ("ts_t", pa.int64()), ("ts_i", pa.int64())])
VALUES = "id string, path string, value string, at int, new boolean, shard string, ns string, doc_part string, ts_t bigint, ts_i bigint"


def _candidate_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of candidate fields; a document without one of them still shows that it is present (null)."""
    for batch in batches:
        out = []
        for shard, ns, part, t, i, text, sides in zip(*(batch.column(c).to_pylist() for c in ("shard", "ns", "doc_part", "ts_t", "ts_i", "doc", "sides"))):
            doc = parse(text)
            if not isinstance(doc, dict) or "_id" not in doc:
                continue
            key = repr(canonical(doc["_id"]))
            fields = dict(leaves(doc))
            for side in sides:
                for path in side["paths"]:
                    value = fields.get(path)
                    out.append((key, path, None if value is None else repr(canonical(value)), side["at"], side["new"], shard, ns, part, t, i))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(_VALUES), _VALUES)], schema=_VALUES)


def renames(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """(shard, ns, doc_part, file_no, field_path, new_path) of the removed fields that live on under an added name.

    Only documents of files with both removed and added fields are read, and fields are paired through equal values of
    one document, never all with all. A document written several times in a file counts with its last writing in the
    old file and its first in the new one, the two that touch.
    """
    keys = [*GROUP, "file_no", "old_file"]
    cand = (
        changes.where("drift_kind in ('removed', 'added')")
        .groupBy(*keys)
        .agg(F.collect_list(F.when(F.col("drift_kind") == "removed", F.col("field_path"))).alias("gone"), F.collect_list(F.when(F.col("drift_kind") == "added", F.col("field_path"))).alias("come"))
        .where("size(gone) > 0 and size(come) > 0")
    )  # lists of field names: as long as a schema is wide
    sides = F.array(
        F.struct(F.col("old_file").alias("file_no"), F.struct(F.col("file_no").alias("at"), F.lit(False).alias("new"), F.col("gone").alias("paths")).alias("s")),
        F.struct(F.col("file_no").alias("file_no"), F.struct(F.col("file_no").alias("at"), F.lit(True).alias("new"), F.col("come").alias("paths")).alias("s")),
    )
    wanted = cand.select(*GROUP, F.explode(sides).alias("x")).groupBy(*GROUP, F.col("x.file_no").alias("file_no")).agg(F.collect_list("x.s").alias("sides"))
    read = documents.join(wanted, [*GROUP, "file_no"]).select(*GROUP, "ts_t", "ts_i", "doc", "sides")
    values = read.mapInArrow(_candidate_values, VALUES)
    at = [*GROUP, "at", "id", "path"]
    order = F.struct("ts_t", "ts_i")
    touch = F.when(F.first("new"), F.min_by("value", order)).otherwise(F.max_by("value", order))
    one = materialise(values.groupBy(*at, "new").agg(touch.alias("value")), "candidate-values")  # parsed once, read four times
    old, new = one.where("not new and value is not null"), one.where("new")
    ids = new.select(*GROUP, "at", "id").distinct()
    in_both = old.join(ids, [*GROUP, "at", "id"], "left_semi")
    totals = in_both.groupBy(*GROUP, "at", "path").agg(F.count("*").alias("docs"))
    matched = (
        in_both.alias("o")
        .join(new.where("value is not null").select(*GROUP, "at", "id", "value", F.col("path").alias("new_path")), [*GROUP, "at", "id", "value"])
        .groupBy(*GROUP, "at", "path", "new_path")
        .agg(F.count("*").alias("same"))
    )
    full = matched.join(totals, [*GROUP, "at", "path"]).where("same = docs")
    pick = full.withColumn("a", F.row_number().over(Window.partitionBy(*GROUP, "at", "path").orderBy("new_path"))).where("a = 1")
    pick = pick.withColumn("b", F.row_number().over(Window.partitionBy(*GROUP, "at", "new_path").orderBy("path"))).where("b = 1")
    return pick.select(*GROUP, F.col("at").alias("file_no"), F.col("path").alias("field_path"), "new_path")


def drift_report(oplog: DataFrame) -> DataFrame:
    """(shard, ns, doc_part, file_no, drift_kind, field_path, new_path): every change from a file to the next."""
    documents = materialise(log_documents(oplog), "log-documents")
    changes = materialise(file_changes(materialise(infer_union(documents), "union")), "file-changes")
    moved = materialise(renames(documents, changes), "renames")
    keys = [*GROUP, "file_no"]
    gone = moved.select(*keys, F.lit("removed").alias("drift_kind"), "field_path")
    come = moved.select(*keys, F.lit("added").alias("drift_kind"), F.col("new_path").alias("field_path"))
    rest = changes.join(gone.unionByName(come), [*keys, "drift_kind", "field_path"], "left_anti")
    rest = rest.select(*keys, "drift_kind", "field_path", F.lit("").alias("new_path"))
    return rest.unionByName(moved.select(*keys, F.lit("renamed").alias("drift_kind"), "field_path", "new_path"))


#: The column type of each branch; types that aren't listed are kept as text.
BRANCHES = {"number": "double", "string": "string", "bool": "boolean"}


def table_layout(union: DataFrame) -> list[tuple[str, list[str]]]:
    """(path, types) of every path over all files, in order of path: as many rows as the schema has columns."""
    rows = union.where("path is not null and type is not null").groupBy("path").agg(F.sort_array(F.collect_set("type")).alias("types")).orderBy("path").limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} paths: use infer_union, whose result is in rows")
    return [(r["path"], r["types"]) for r in rows]


def consistent_table(documents: DataFrame, layout: list[tuple[str, list[str]]]) -> DataFrame:
    """All documents in one schema: a column per path; a path with several types has its canonical text and a column per type."""
    ship(documents.sparkSession)
    keep = ["entry_id", *GROUP, "file_no"]
    taken = set(keep)

    def unique(name: str) -> str:
        """Catalogs and file formats take names that differ in case only for the same."""
        name = name.replace(".", "__")
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        return name

    schema, plan = T.StructType([documents.schema[c] for c in keep]), []
    for path, types in layout:
        if len(types) > 1:
            schema.add(unique(path), "string")
            plan.append((path, None, "string"))
        for kind in types:
            branch = BRANCHES.get(kind, "string")
            schema.add(unique(path if len(types) == 1 else f"{path}__{kind}"), branch)
            plan.append((path, kind, branch))
    arrow = {"double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [dict(leaves(d)) if isinstance(d := parse_raw(x), dict) else {} for x in batch.column("doc").to_pylist()]
            columns = [batch.column(c) for c in keep]
            for path, kind, branch in plan:
                columns.append(pa.array([_branch(d.get(path), kind, branch) for d in docs], arrow[branch]))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return documents.select(*keep, "doc").mapInArrow(convert, schema)


def _branch(value, kind: str | None, branch: str):
    """A value as its type's column holds it, or as canonical text: a string or a tagged string itself, all else as compact JSON with numbers as written."""
    if value is None or (kind is not None and type_name(value) != kind):
        return None
    if branch == "double":
        while isinstance(value, dict):
            value = next(iter(value.values()))
        try:
            return float(value)
        except (TypeError, ValueError):
            return None
    if branch == "boolean":
        return value
    inner = next(iter(value.values())) if isinstance(value, dict) and len(value) == 1 else value
    text = inner if isinstance(inner, str) and not isinstance(inner, Raw) else _text(value)
    return text if text.isascii() else text.encode("utf-8", "replace").decode()
