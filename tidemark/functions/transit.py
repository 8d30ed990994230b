"""The transit encoding of document values, which is lossy, and its way back. The engine itself keeps the tags (faithful).

Dates and timestamps become milliseconds, object ids and decimals text, binaries and codes their content; null,
undefined, minKey and maxKey become null; the order of fields isn't kept. On the way back a top-level id of 24 hex
digits becomes an object id again; nothing else gets its type back.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.functions.docs import is_tagged, parse
from tidemark.session import ship

_HEX = re.compile(r"[0-9a-fA-F]{24}")


def _millis(value) -> int | None:
    if isinstance(value, dict):
        value = next(iter(value.values()))
    if isinstance(value, (int, float)):
        return int(value)
    try:
        if re.fullmatch(r"-?\d+", value):
            return int(value)
        at = datetime.datetime.fromisoformat(value)
    except (TypeError, ValueError):
        return None
    at = at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)
    return (at - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) // datetime.timedelta(milliseconds=1)


def to_transit(value):
    """A value without tags."""
    if isinstance(value, list):
        return [to_transit(x) for x in value]
    if not isinstance(value, dict):
        return value
    if is_tagged(value) or set(value) == {"$code", "$scope"}:
        tag, inner = next(iter(value.items()))
        if tag == "$date":
            return _millis(inner)
        if tag == "$timestamp":
            return inner["t"] * 1000
        if tag in ("$numberInt", "$numberLong"):
            return int(inner)
        if tag == "$numberDouble":
            return float(inner)
        if tag == "$binary":
            return inner["base64"] if isinstance(inner, dict) else inner
        if tag == "$regularExpression":
            return inner["pattern"]
        if tag in ("$undefined", "$minKey", "$maxKey"):
            return None
        return inner if isinstance(inner, str) else json.dumps(inner, ensure_ascii=False, sort_keys=True)
    return {k: to_transit(v) for k, v in sorted(value.items())}


def from_transit(doc: dict, id_field: str = "_id") -> dict:
    """A document to be written: its id is an object id if it looks like one."""
    value = doc.get(id_field)
    return {**doc, id_field: {"$oid": value}} if isinstance(value, str) and _HEX.fullmatch(value) else dict(doc)


def transit_documents(df: DataFrame, column: str = "doc") -> DataFrame:
    """The table with its documents in the transit encoding; broken and null ones become null."""
    ship(df.sparkSession)
    k = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = (parse(x) for x in batch.column(k).to_pylist())
            texts = [None if d is None else json.dumps(to_transit(d), ensure_ascii=False, separators=(",", ":")) for d in docs]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, pa.string()))

    return df.mapInArrow(run, df.schema)
