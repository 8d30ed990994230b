"""Applying a stream of inserts, updates and deletes: a merge-on-read table with delete vectors and a key index.

The table is a folder of immutable Parquet files. ``data`` folders hold document images, ``index`` folders say for each
key at which positions of which files its images lie, ``deleted`` folders hold bitmaps of superseded positions, one per
file and block of 32,768. A version is a manifest that names the folders that make it up; it is put only if there is
none of that number.

A batch of changes is folded to one change per key and Arrow batch. The index gives the positions of the images of its
keys; these become bits of the batch's delete vector, and the same bits fetch the images, from those files only. Old
images and changes meet in one shuffle, the new images are appended, and their positions go to the index. So a batch
moves itself and the images it supersedes, whatever the size of the table; the index, three narrow columns, is read in
place when the batch is small and shuffled when Spark finds it too large to broadcast.

An image keeps the position of its last replacement or removal and the patches since, so a batch may hold any part of
the feed: repeated changes, and changes older than what was applied before, give the same table as in order.

Changes apply in the order (phase, ts_t, ts_i), each (ts_t, ts_i) once. c, r and a u without ``$`` fields replace the
document; a u with ``$set``/``$unset`` changes dotted paths and creates the document if there is none; one that changes
nothing does nothing; d removes; other ops do nothing. A drop of a collection or database removes all documents that
stand below its position, and every change below it, also one that comes in a later batch.

Defined cases: the key is the ``_id`` of before_doc, else of after_doc, as text; a change without a namespace, a key, a
position or (unless d) a readable after_doc does nothing (:func:`unusable` names it for a folder of dead letters); a
null phase counts as 1; setting a path below a scalar makes that an object, and unsetting it again leaves an empty one;
arrays and tagged values are single values; an empty object is not kept; a lone surrogate in a key becomes ``?``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.docs import Raw, is_tagged, parse, parse_raw
from tidemark.session import ship
from tidemark.store import Store, Versions

#: An image, and also a folded change: fields is JSON that maps dotted paths to JSON texts; r_* is the last reset; ops are the
#: patches since. A change holds the document as it came, after a mark, since only the last one of a key is ever taken apart.
IMAGE = "ns string, doc_key string, alive boolean, fields string, r_phase int, r_t bigint, r_i bigint, ops string"
_IMAGE = pa.schema([("ns", pa.string()), ("doc_key", pa.string()), ("alive", pa.bool_()), ("fields", pa.string()), ("r_phase", pa.int32()), ("r_t", pa.int64()), ("r_i", pa.int64()), ("ops", pa.string())])
INDEX = "ns string, doc_key string, file bigint, pos bigint"
VECTORS = "file bigint, block bigint, bits binary"
RESETS = "scope string, name string, t bigint, i bigint"
#: Bytes of a bitmap, whatever it holds; vectors up to so many bytes are broadcast, larger ones joined by a shuffle.
BITMAP_BYTES, MOST_BROADCAST = 4096, 64 << 20
#: Up to so many touched files are read by name; beyond that their folders are scanned.
MOST_NAMED_FILES = 10_000
#: So many segments of the index, vectors or data folders are kept before they are merged.
MOST_SEGMENTS, MOST_FOLDERS = 8, 64
_esc = json.encoder.encode_basestring
_WHOLE = "\x01"


def _text(value) -> str:
    """JSON text of a value, numbers as written."""
    kind = type(value)
    if kind is str:
        return _esc(value)
    if kind is Raw:
        return value
    if kind is dict:
        return "{" + ",".join(f"{_esc(k)}:{_text(v)}" for k, v in value.items()) + "}"
    if kind is list:
        return "[" + ",".join(map(_text, value)) + "]"
    return _PLAIN[value] if value is None or kind is bool else json.dumps(value)


_PLAIN = {None: "null", True: "true", False: "false"}


def flatten(doc: dict, prefix: str = "", out: dict | None = None) -> dict[str, str]:
    """Dotted path -> JSON text of each value that is no object."""
    out = {} if out is None else out
    for key, value in doc.items():
        kind = type(value)
        if kind is str:
            out[prefix + key] = _esc(value)
        elif kind is Raw:
            out[prefix + key] = value
        elif kind is dict and not is_tagged(value):
            flatten(value, f"{prefix}{key}.", out)
        else:
            out[prefix + key] = _text(value)
    return out


_compact = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


def _dump(value) -> str:
    """Compact JSON that UTF-8 can hold."""
    text = _compact(value)
    if not text.isascii():
        try:
            text.encode()
        except UnicodeEncodeError:  # a lone surrogate
            return json.dumps(value, separators=(",", ":"))
    return text


class State:
    """What is known of one document: the last reset, its fields, and of each path patched since the newest patch.

    A patch that sets a path also removes the scalars above it, and a later unset of the same path doesn't bring them
    back. So a path also keeps the place of its newest set: (place, value, place of the newest set), a place being
    (position, rank within the change).
    """

    __slots__ = ("reset", "alive", "fields", "ops")

    def __init__(self):
        self.reset, self.alive, self.fields, self.ops = None, False, {}, {}

    def taken_apart(self) -> dict[str, str]:
        """``fields`` as a dictionary; until it is needed it may be the text of an image or of a whole document."""
        if type(self.fields) is str:
            if self.fields[:1] == _WHOLE:
                self.fields = flatten({k: v for k, v in parse_raw(self.fields[1:]).items() if k != "_id"})
            else:
                self.fields = parse(self.fields)
        return self.fields

    def replace(self, pos: tuple, fields: dict | str | None) -> None:
        """Of a removal and a document at one position, which only a schema change gives, the document stays."""
        if self.reset is None or pos > self.reset or (pos == self.reset and fields is not None and not self.alive):
            self.reset, self.alive, self.fields = pos, fields is not None, fields or {}
            if self.ops:
                self.ops = {p: (at, value, put if put and put[0] > pos else None) for p, (at, value, put) in self.ops.items() if at[0] > pos}

    def patch(self, path: str, at: tuple, value: dict | None, put: tuple | None) -> None:
        """``value``: fields to put at the path, relative to the document; None unsets it."""
        if self.reset is not None and at[0] <= self.reset:
            return
        if put is not None and self.reset is not None and put[0] <= self.reset:
            put = None
        if (old := self.ops.get(path)) is not None:
            put = max(filter(None, (put, old[2])), default=None)
            if old[0] > at:
                at, value = old[:2]
        self.ops[path] = (at, value, put)

    def merge(self, other: State) -> None:
        if other.reset is not None:  # without one, the fields are those of the patches, which are merged below
            self.replace(other.reset, other.fields if other.alive else None)
        for path, (at, value, put) in other.ops.items():
            self.patch(path, at, value, put)

    def replay(self) -> None:
        """Bring ``fields`` up to date. The patches stay, so that older changes can still come in below them."""
        if not self.ops:
            return
        fields = self.taken_apart()
        steps = []
        for path, (at, value, put) in self.ops.items():
            if put is not None and put != at:
                steps.append((put, 0, path, None))
            steps.append((at, 1, path, value))
        steps.sort(key=lambda s: s[:3])
        for _, whole, path, value in steps:
            self.alive = True
            if value is not None or not whole:
                up = path
                while "." in up:
                    up = up.rpartition(".")[0]
                    fields.pop(up, None)
            if whole:
                fields.pop(path, None)
                below = path + "."
                for p in [p for p in fields if p.startswith(below)]:
                    del fields[p]
                if value is not None:
                    fields.update(value)

    def ops_text(self) -> str | None:
        return _dump([[p, *o] for p, o in self.ops.items()]) if self.ops else None

    def load_ops(self, text: str | None) -> State:
        if text:
            for path, at, value, put in json.loads(text):
                self.ops[path] = (_place(at), value, _place(put))
        return self


def _place(at: list | None) -> tuple | None:
    return None if at is None else (tuple(at[0]), at[1])


def apply_change(state: State, op: str, pos: tuple, doc: dict | None, text: str) -> None:
    """Note a change; ``text`` is what ``doc`` was parsed from."""
    if op == "d":
        state.replace(pos, None)
    elif op in ("c", "r") and doc is not None:
        state.replace(pos, _WHOLE + text)
    elif op == "u" and doc is not None:
        if not any(k[:1] == "$" for k in doc):
            state.replace(pos, _WHOLE + text)
            return
        puts, drops = doc.get("$set"), doc.get("$unset")
        rank = 0
        for path, value in (puts if isinstance(puts, dict) else {}).items():
            if path != "_id":
                state.patch(path, (pos, rank), flatten({path: value}), (pos, rank))
                rank += 1
        for path in drops if isinstance(drops, dict) else {}:
            if path != "_id":
                state.patch(path, (pos, rank), None, None)
                rank += 1


def _key_of(before: dict | None, after: dict | None) -> str | None:
    for doc in (before, after):
        if doc is not None and (value := doc.get("_id")) is not None:
            key = value if isinstance(value, str) else _text(value)
            return key if key.isascii() else key.encode("utf-8", "replace").decode()
    return None


def _document(text: str | None) -> dict | None:
    doc = parse_raw(text)
    return doc if isinstance(doc, dict) else None


def _row(key: tuple, s: State, final: bool = True) -> tuple:
    """A state as a row; a final one, an image, has its document taken apart."""
    fields = s.fields if s.alive else None
    if final and type(fields) is str and fields[:1] == _WHOLE:
        fields = s.taken_apart()
    return (*key, s.alive, _dump(fields) if type(fields) is dict else fields, *(s.reset or (None,) * 3), s.ops_text())


def _images(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_IMAGE), _IMAGE)], schema=_IMAGE)


def _fold_map_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One folded change per key and batch: a hot key shrinks here, before the shuffle."""
    for batch in batches:
        states: dict[tuple, State] = {}
        for ns, op, before, after, phase, t, i in zip(*(c.to_pylist() for c in batch.columns)):
            after_doc = _document(after)
            key = _key_of(_document(before), after_doc)
            if key is None:
                continue
            if (state := states.get((ns, key))) is None:
                state = states[ns, key] = State()
            apply_change(state, op, (phase, t, i), after_doc, after)
        yield _images([_row(key, s, False) for key, s in states.items() if s.reset is not None or s.ops])


def _fold_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by key: merges a key's changes and its image to the new image. A row that stands alone passes as it is."""
    key, rows, out = None, [], []

    def state_of(row: tuple) -> State:
        state = State()
        _, _, state.alive, fields, phase, t, i, ops = row
        state.reset = None if t is None else (phase, t, i)
        state.fields = fields or {}
        return state.load_ops(ops)

    state = None  # of the rows of the key before the last one, if there are several

    def close() -> None:
        if not rows:
            return
        last = rows.pop()
        if state is None and last[7] is None and (last[3] is None or last[3][:1] != _WHOLE):
            out.append(last)
            return
        whole = State() if state is None else state
        whole.merge(state_of(last))
        whole.replay()
        if whole.alive or whole.reset is not None:
            out.append(_row(key, whole))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] == key:
                if state is None:
                    state = State()
                state.merge(state_of(rows.pop()))
            else:
                close()
                key, state = row[:2], None
            rows.append(row)
        if len(out) >= 5000:
            yield _images(out)
            out.clear()
    close()
    if out:
        yield _images(out)


def unusable() -> Column:
    """Why a change (ns, op, before_doc, after_doc, ts_t, ts_i) can't be applied; null if it can."""
    doc = F.try_parse_json("after_doc")
    key = F.coalesce(F.try_variant_get(F.try_parse_json("before_doc"), "$._id", "string"), F.try_variant_get(doc, "$._id", "string"))
    return (
        F.when(F.col("ns").isNull(), "no namespace")
        .when(F.col("ts_t").isNull() | F.col("ts_i").isNull(), "no position")
        .when(F.coalesce(~F.col("op").isin("c", "r", "u", "d"), F.lit(True)), "unknown op")
        .when((F.col("op") != "d") & (doc.isNull() | ~F.startswith(F.schema_of_variant(doc), F.lit("OBJECT"))), "broken document")
        .when(key.isNull(), "no key")
    )


class MorTable:
    """A merge-on-read table in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, self.path)
        self._versions = Versions(self.store)

    def _manifest(self) -> dict:
        """The newest version. ``data`` and ``index`` entries are [folder, rows]."""
        return self._versions.newest() or {"version": 0, "folders": 0, "data": [], "index": [], "deleted": [], "streams": {}, "resets": None, "clock": 0}

    def _commit(self, manifest: dict) -> None:
        manifest["version"] += 1
        self._versions.commit(manifest["version"], manifest)

    def _read(self, schema: str, *folders: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _entries(self, segments: list, manifest: dict) -> DataFrame:
        """Index entries that lead to folders of this version; those of compacted folders are out of date."""
        known = [int(n.split("-")[1]) for n, _ in manifest["data"]]
        return self._read(INDEX, *(n for n, _ in segments)).where(F.shiftright("file", 40).isin(known))

    def _placed(self, *folders: str) -> DataFrame:
        """Images with the number of their file (folder, task, part) and their position in it."""
        path, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
        folder = F.substring_index(F.substring_index(path, "/data-", -1), "-", 1).cast("bigint")
        task = F.substring_index(F.expr("substring(_metadata.file_name, 6)"), "-", 1).cast("bigint")
        part = F.substring_index(F.substring_index(name, "-c", -1), ".", 1).cast("bigint")
        return self._read(IMAGE, *folders).select("*", (F.shiftleft(folder, 40) + F.shiftleft(task, 16) + part).alias("file"), F.col("_metadata.row_index").alias("pos"))

    def _files(self, folders: list[str], wanted: set[int]) -> list[str]:
        """Paths of files by number. One listing per folder, as every scan of them makes."""
        out = []
        for folder in folders:
            number = int(folder.split("-")[1])
            for name in self.store.names(folder):
                if name.startswith("part-"):
                    task, part = name[5:].split("-", 1)[0], name.rsplit("-c", 1)[1].split(".", 1)[0]
                    if (number << 40) + (int(task) << 16) + int(part) in wanted:
                        out.append(f"{folder}/{name}")
        return out

    def _vectors(self, folders: list[str]) -> DataFrame | None:
        if not folders:
            return None
        vectors = self._read(VECTORS, *folders)
        return vectors if len(folders) == 1 else vectors.groupBy("file", "block").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))

    def _marked(self, rows: DataFrame, vectors: DataFrame, bitmaps: int, keep: bool) -> DataFrame:
        """Rows whose bit is set (``keep``), or those whose bit isn't. A bitmap is 4 KB, so their number tells the size."""
        named = vectors.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "bits")
        named = F.broadcast(named) if bitmaps * BITMAP_BYTES <= MOST_BROADCAST else named.hint("shuffle_hash")
        joined = rows.join(named, (F.col("file") == F.col("_file")) & (F.expr("bitmap_bucket_number(pos + 1)") == F.col("_block")), "inner" if keep else "left")
        byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(pos + 1) div 8 + 1 as int), 1)")), 16, 10).cast("int")
        is_set = F.expr("getbit(_byte, cast(bitmap_bit_position(pos + 1) % 8 as int))") == 1
        joined = joined.withColumn("_byte", byte)
        return joined.where(is_set if keep else F.col("bits").isNull() | ~is_set).drop("_file", "_block", "bits", "_byte")

    def _live_rows(self, manifest: dict, folders: list[str]) -> DataFrame:
        """The images of these folders or files that no delete vector marks, tombstones included."""
        rows = self._placed(*folders)
        if not manifest["deleted"]:
            return rows
        names = [n for n, _ in manifest["deleted"]]
        return self._marked(rows, self._vectors(names), sum(n for _, n in manifest["deleted"]), keep=False)

    def apply(self, changes: DataFrame, batch_id: int | None = None, stream: str = "", drops: DataFrame | None = None) -> MorTable:
        """Apply a batch of (ns, op, before_doc, after_doc, phase, ts_t, ts_i) as one version.

        A batch id that isn't above the last one of the same stream is a replay after a failure, and is skipped; ids of
        different streams don't count for each other. ``drops`` (database, collection, ts_t, ts_i) are dropped
        collections, or databases where the collection is null; there are as many as schema changes.
        """
        manifest = self._manifest()
        if batch_id is not None and batch_id <= manifest["streams"].get(stream, -1):
            return self
        feed = changes.where("op in ('c', 'r', 'u', 'd') and ns is not null and ts_t is not null and ts_i is not null").select(
            "ns", "op", "before_doc", "after_doc", F.coalesce(F.col("phase"), F.lit(1)).cast("int").alias("phase"), F.col("ts_t").cast("long").alias("ts_t"), F.col("ts_i").cast("long").alias("ts_i")
        )
        extra = None
        if drops is not None:
            extra = self._drop(manifest, drops)
        if manifest["resets"]:
            feed = self._above(feed, self._read(RESETS, manifest["resets"]))
        if batch_id is not None:
            manifest["streams"][stream] = batch_id
        return self._merge(manifest, feed.mapInArrow(_fold_map_side, IMAGE), extra)

    def _above(self, feed: DataFrame, resets: DataFrame) -> DataFrame:
        """Changes above the last drop of their collection and database; one row per dropped name, joined by its size."""
        at, columns = F.struct(F.col("ts_t").alias("t"), F.col("ts_i").alias("i")), feed.columns
        for scope, name in (("collection", F.col("ns")), ("database", F.substring_index("ns", ".", 1))):
            last = resets.where(F.col("scope") == scope).select(F.col("name").alias("_name"), F.struct("t", "i").alias("_at"))
            feed = feed.join(last, name == F.col("_name"), "left").where((F.col("_at").isNull()) | ((F.col("phase") > 0) & (at > F.col("_at")))).select(*columns)
        return feed

    def _drop(self, manifest: dict, drops: DataFrame) -> DataFrame | None:
        """Add drops to the manifest's resets; returns a removal for every key that the index has below them."""
        scope = F.when(F.col("collection").isNull(), "database").otherwise("collection")
        new = drops.where("database is not null and ts_t is not null and ts_i is not null").select(scope.alias("scope"), F.concat_ws(".", "database", "collection").alias("name"), F.col("ts_t").cast("long").alias("t"), F.col("ts_i").cast("long").alias("i"))
        new = new.groupBy("scope", "name").agg(F.max(F.struct("t", "i")).alias("at")).select("scope", "name", "at.*")
        old = [manifest["resets"]] if manifest["resets"] else []
        folder = f"resets-{uuid.uuid4().hex[:12]}"
        every = self._read(RESETS, *old).unionByName(new).groupBy("scope", "name").agg(F.max(F.struct("t", "i")).alias("at")).select("scope", "name", "at.*")
        every.coalesce(1).write.parquet(f"{self.path}/{folder}")
        manifest["resets"] = folder
        if not manifest["index"]:
            return None
        every = self._read(RESETS, folder)  # older ones change nothing any more
        index = self._read(INDEX, *(n for n, _ in manifest["index"])).select("ns", "doc_key")
        hit = None
        for kind, name in (("collection", F.col("ns")), ("database", F.substring_index("ns", ".", 1))):
            part = index.join(every.where(F.col("scope") == kind).withColumnRenamed("name", "_name"), name == F.col("_name")).select("ns", "doc_key", "t", "i")
            hit = part if hit is None else hit.unionByName(part)
        return _removals(hit)

    def _merge(self, manifest: dict, deltas: DataFrame, extra: DataFrame | None = None) -> MorTable:
        """One version more: finds the images of the keys of ``deltas``, marks them, appends the new ones, extends the index."""
        if extra is not None:
            deltas = deltas.unionByName(extra)
        stamp = f"{manifest['folders'] + 1}-{uuid.uuid4().hex[:8]}"
        temporary = []
        if manifest["data"]:
            temporary.append(f"open-{stamp}")
            deltas.write.parquet(f"{self.path}/open-{stamp}")
            deltas = self._read(IMAGE, f"open-{stamp}")
            located = self._entries(manifest["index"], manifest).join(deltas.select("ns", "doc_key"), ["ns", "doc_key"], "left_semi")
            bits = located.groupBy("file", F.expr("bitmap_bucket_number(pos + 1)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(pos + 1))").alias("bits"))
            bits.write.parquet(f"{self.path}/deleted-{stamp}")
            marks = self._read(VECTORS, f"deleted-{stamp}")
            bitmaps, touched = self._touched(marks)
            if bitmaps:
                deltas = deltas.unionByName(self._superseded(manifest, marks, bitmaps, touched))
        images = deltas.repartition("ns", "doc_key").sortWithinPartitions("ns", "doc_key").mapInArrow(_fold_by_key, IMAGE)
        images.write.parquet(f"{self.path}/data-{stamp}")
        fresh = self._placed(f"data-{stamp}").select("ns", "doc_key", "file", "pos")
        fresh.write.parquet(f"{self.path}/index-{stamp}")
        rows = self._read(INDEX, f"index-{stamp}").count()
        if manifest["data"] and bitmaps:
            manifest["deleted"].append([f"deleted-{stamp}", bitmaps])
        manifest["folders"] += 1
        if rows:
            manifest["data"].append([f"data-{stamp}", rows])
            manifest["index"].append([f"index-{stamp}", rows])
        self._tidy(manifest)
        self._commit(manifest)
        for name in temporary:
            self.store.delete(name)
        if len(manifest["data"]) > MOST_FOLDERS:
            self.compact()
        return self

    def _touched(self, marks: DataFrame) -> tuple[int, list[int] | None]:
        """How many bitmaps a vector has, and the files that it marks, if they aren't too many to be named."""
        files = marks.groupBy("file").agg(F.count("*").alias("n")).limit(MOST_NAMED_FILES + 1).collect()
        if len(files) > MOST_NAMED_FILES:
            return marks.count(), None
        return sum(r["n"] for r in files), [r["file"] for r in files]

    def _superseded(self, manifest: dict, marks: DataFrame, bitmaps: int, touched: list[int] | None) -> DataFrame:
        """The live images at the marked positions, read from the files that have any."""
        folders = [n for n, _ in manifest["data"]]
        if touched is not None:
            folders = self._files(folders, set(touched)) or folders[:1]
        live = self._live_rows(manifest, folders)
        return self._marked(live, marks, bitmaps, keep=True).drop("file", "pos")

    def _tidy(self, manifest: dict) -> None:
        """Merge vectors, and index segments from the newest back while they are no larger than what is merged already."""
        stamp = uuid.uuid4().hex[:12]
        if len(manifest["deleted"]) > MOST_SEGMENTS:
            name = f"deleted-all-{stamp}"
            self._vectors([n for n, _ in manifest["deleted"]]).write.parquet(f"{self.path}/{name}")
            manifest["deleted"] = [[name, self._read(VECTORS, name).count()]]
        if len(manifest["index"]) > MOST_SEGMENTS:
            segments, merged, rows = list(manifest["index"]), [], 0
            while segments and (len(merged) < 2 or segments[-1][1] <= 2 * rows):
                merged.append(segments.pop())
                rows += merged[-1][1]
            entries = self._entries(merged, manifest)
            if manifest["deleted"]:  # a position that is dead is never looked up again
                entries = self._marked(entries, self._vectors([n for n, _ in manifest["deleted"]]), sum(n for _, n in manifest["deleted"]), keep=False)
            entries.repartition("ns", "doc_key").sortWithinPartitions("ns", "doc_key").write.parquet(f"{self.path}/index-all-{stamp}")
            manifest["index"] = [*segments, [f"index-all-{stamp}", self._read(INDEX, f"index-all-{stamp}").count()]]

    def compact(self, dead_share: float = 0.5) -> MorTable:
        """Rewrite the data folders of which so large a part is superseded, and the smallest ones if there are too many."""
        manifest = self._manifest()
        dead: dict[int, int] = {}
        if manifest["deleted"]:
            counts = self._vectors([n for n, _ in manifest["deleted"]]).groupBy(F.shiftright("file", 40).alias("f")).agg(F.sum(F.expr("bitmap_count(bits)")).alias("n"))
            dead = {r["f"]: r["n"] for r in counts.collect()}  # one row per data folder
        number = lambda name: int(name.split("-")[1])
        chosen = [n for n, rows in manifest["data"] if dead.get(number(n), 0) >= dead_share * rows]
        if len(manifest["data"]) - len(chosen) > MOST_FOLDERS // 2:
            left = sorted((rows, n) for n, rows in manifest["data"] if n not in chosen)
            chosen += [n for _, n in left[: len(left) - MOST_FOLDERS // 2]]
        if not chosen:
            return self
        stamp = f"{manifest['folders'] + 1}-{uuid.uuid4().hex[:8]}"
        live = self._live_rows(manifest, chosen).drop("file", "pos")
        live.repartition("ns", "doc_key").sortWithinPartitions("ns", "doc_key").write.parquet(f"{self.path}/data-{stamp}")
        self._placed(f"data-{stamp}").select("ns", "doc_key", "file", "pos").write.parquet(f"{self.path}/index-{stamp}")
        rows = self._read(INDEX, f"index-{stamp}").count()
        manifest["data"] = [[n, r] for n, r in manifest["data"] if n not in chosen]
        if manifest["deleted"]:
            kept = self._vectors([n for n, _ in manifest["deleted"]]).where(F.shiftright("file", 40).isin([number(n) for n, _ in manifest["data"]]))
            kept.write.parquet(f"{self.path}/deleted-{stamp}")
            left = self._read(VECTORS, f"deleted-{stamp}").count()
            manifest["deleted"] = [[f"deleted-{stamp}", left]] if left else []
        manifest["folders"] += 1
        if rows:
            manifest["data"].append([f"data-{stamp}", rows])
            manifest["index"].append([f"index-{stamp}", rows])
        self._commit(manifest)
        return self

    def vacuum(self) -> list[str]:
        """Delete folders and manifests that the newest version doesn't use; no reader may be at an older version."""
        manifest = self._manifest()
        used = {n for kind in ("data", "index", "deleted") for n, _ in manifest[kind]} | {"versions", manifest["resets"]}
        gone = [n for n in self.store.names() if n not in used]
        for name in gone:
            self.store.delete(name)
        for name in self.store.names("versions")[:-1]:
            self.store.delete(f"versions/{name}")
        return gone

    def rename(self, source: str, target: str, t: int, i: int, stream: str = "", batch_id: int | None = None) -> MorTable:
        """Move the documents of a collection to another one, whose own are dropped, at a position of the log."""
        manifest = self._manifest()
        if batch_id is not None:
            manifest["streams"][stream] = batch_id
        schema = "database string, collection string, ts_t bigint, ts_i bigint"
        moved = None
        if manifest["data"] and source != target:
            live = self._live_rows(manifest, [n for n, _ in manifest["data"]]).where((F.col("ns") == source) & F.col("alive"))
            place = [F.lit(1).alias("r_phase"), F.lit(t).cast("long").alias("r_t"), F.lit(i).cast("long").alias("r_i")]
            moved = live.select(F.lit(target).alias("ns"), "doc_key", "alive", "fields", *place, F.lit(None).cast("string").alias("ops"))
        names = [(*n.split(".", 1), t, i) for n in (source, target)] if source != target else []
        removals = self._drop(manifest, self.spark.createDataFrame(names, schema)) if names else None
        deltas = moved if moved is not None else self._read(IMAGE)
        return self._merge(manifest, deltas, removals)

    def namespaces(self) -> DataFrame:
        """(ns) of all images; only that column of the index is read."""
        return self._read(INDEX, *(n for n, _ in self._manifest()["index"])).select("ns").distinct()

    def clock(self) -> int:
        """The largest position of any image; what is written next by hand must lie above it."""
        manifest = self._manifest()
        if not manifest["data"]:
            return 0
        ops = F.coalesce(F.array_max(F.transform(F.from_json("ops", "array<string>"), lambda o: F.get_json_object(o, "$[1][0][1]").cast("bigint"))), F.lit(0).cast("bigint"))
        return self._read(IMAGE, *(n for n, _ in manifest["data"])).agg(F.max(F.greatest(F.coalesce("r_t", F.lit(0)), ops)).alias("m")).first()["m"] or 0

    def read(self) -> DataFrame:
        """(ns, doc_key, fields) of the documents alive now; fields maps dotted paths to JSON texts."""
        manifest = self._manifest()
        if not manifest["data"]:
            return self.spark.createDataFrame([], "ns string, doc_key string, fields map<string,string>")
        rows = self._live_rows(manifest, [n for n, _ in manifest["data"]]).where("alive")
        return rows.select("ns", "doc_key", F.from_json("fields", "map<string,string>").alias("fields"))


def _removals(keys: DataFrame) -> DataFrame:
    """Folded changes that remove (ns, doc_key) at (1, t, i)."""
    none = F.lit(None).cast("string")
    return keys.select("ns", "doc_key", F.lit(False).alias("alive"), none.alias("fields"), F.lit(1).alias("r_phase"), F.col("t").alias("r_t"), F.col("i").alias("r_i"), none.alias("ops"))


def scalar_fields(current: DataFrame) -> DataFrame:
    """(ns, doc_key, field_path, field_value): strings themselves, numbers as written, null as ``null``."""
    rows = current.select("ns", "doc_key", F.explode("fields").alias("field_path", "raw"))
    # one JSON array per field would unescape too; most strings have no escape, so they only lose their quotes
    plain = F.expr("substring(raw, 2, length(raw) - 2)")
    value = F.when(~F.col("raw").startswith('"'), F.col("raw")).when(F.instr("raw", "\\") == 0, plain).otherwise(F.get_json_object(F.concat(F.lit('{"v":'), F.col("raw"), F.lit("}")), "$.v"))
    return rows.where("raw not like '[%' and raw not like '{%'").select("ns", "doc_key", "field_path", value.alias("field_value"))
