"""Differences between two copies of data.

Both copies go through one range exchange, so they are cut at the same split points; each partition is sorted by key
and then side, and a two-pointer merge reads it once, in batches, keeping only the documents of the key in hand.

Defined cases: a key is (ns, _id, id_type) with nulls equal to each other; of several rows of one key on one side the
one with the latest ``copied_at`` counts (then the largest text; nulls last); a null document is an object without
fields; a text that is no object differs as a whole from any other text, with an empty field_path; other columns are
ignored; empty tables give only missing keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.docs import differing_paths, parse
from tidemark.session import materialise, ship

SCHEMA = "ns string, _id string, id_type int, diff_kind string, field_path string"
_ARROW = pa.schema([("ns", pa.string()), ("_id", pa.string()), ("id_type", pa.int32()), ("diff_kind", pa.string()), ("field_path", pa.string())])
#: Top-level fields that a mapper or a clock writes, which don't count.
IGNORED = ("_class", "updatedAt")


COLUMNS = ["ns", "_id", "id_type", "doc", "copied_at"]


def to_source_ns(target: DataFrame, ns_map: DataFrame) -> DataFrame:
    """Documents of the target under the source's namespaces. ``ns_map`` is a small configuration table."""
    back = ns_map.where("target_ns is not null and source_ns is not null").groupBy(F.col("target_ns").alias("_from")).agg(F.min("source_ns").alias("_to"))
    joined = target.select(*COLUMNS).join(back, F.col("ns") == F.col("_from"), "left")
    return joined.withColumn("ns", F.coalesce("_to", "ns")).drop("_from", "_to")


def compare(source: DataFrame, target: DataFrame, ignored: tuple[str, ...] = IGNORED, content: bool = True) -> DataFrame:
    """One row per missing key and per differing field; ``content=False`` compares keys only and never reads documents."""
    ship(source.sparkSession)

    def side(df: DataFrame, mark: int) -> DataFrame:
        doc = F.col("doc") if content else F.lit(None).cast("string").alias("doc")
        return df.select("ns", "_id", F.col("id_type").cast("int").alias("id_type"), F.lit(mark).cast("byte").alias("side"), F.col("copied_at").alias("at"), doc.alias("doc"))

    both = side(source, 0).unionByName(side(target, 1))
    # written, since the range exchange reads its input twice: for the split points and for the rows
    both = materialise(both.mapInArrow(_newest, both.schema), "copies")
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["ns", "_id", "id_type"]
    merged = both.repartitionByRange(n, *key).sortWithinPartitions(*key, "side", F.desc("at"), F.desc("doc")).drop("at")
    skip = frozenset(ignored)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _merge(batches, skip)

    return merged.mapInArrow(merge, SCHEMA)


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of repeated rows of a key and side in a batch only the one that counts, so that a hot key shrinks before the exchange."""
    key = ["ns", "_id", "id_type", "side"]
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if table.group_by(key).aggregate([([], "count_all")]).num_rows == batch.num_rows:
            yield batch
            continue
        table = table.append_column("_row", pa.array(range(batch.num_rows), pa.int64()))
        order = table.sort_by([("at", "descending"), ("doc", "descending")])
        first = order.group_by(key, use_threads=False).aggregate([("_row", "first")])["_row_first"]
        yield batch.take(first.combine_chunks())


def _object(text: str | None, skip: frozenset) -> dict | None:
    """The fields that count; None for a text that is no object."""
    doc = parse(text) if text is not None else {}
    return {k: v for k, v in doc.items() if k not in skip} if isinstance(doc, dict) else None


def _merge(batches: Iterator[pa.RecordBatch], skip: frozenset) -> Iterator[pa.RecordBatch]:
    key, docs = None, [None, None]  # docs: (text,) of each side of the key in hand
    out: list[tuple] = []

    def close() -> None:
        if key is None:
            return
        if docs[1] is None:
            out.append((*key, "missingOnTarget", ""))
        elif docs[0] is None:
            out.append((*key, "missingOnSource", ""))
        elif docs[0] != docs[1]:
            a, b = _object(docs[0][0], skip), _object(docs[1][0], skip)
            for path in [""] if a is None or b is None else differing_paths(a, b):
                out.append((*key, "contentMismatch", path))

    for batch in batches:
        for ns, id_, kind, side, doc in zip(*(batch.column(c).to_pylist() for c in ("ns", "_id", "id_type", "side", "doc"))):
            if (now := (ns, id_, kind)) != key:
                close()
                key, docs = now, [None, None]
            if docs[side] is None:
                docs[side] = (doc,)
        if len(out) > 5000:
            yield _rows(out)
            out.clear()
    close()
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
