"""Messages delivered more than once: exactly one copy of each is kept.

A message is known by identifiers (its token; shard, cluster time, namespace and key). A dictionary encodes each
identifier exactly as a dense integer, in the order of batches; no hash stands for an identifier. The codes of the
identifiers seen so far are bits in bitmaps of 32,768, sharded by block of codes. Of a batch, the identifiers are looked
up in the dictionary, new ones get the next codes, and the bits of known ones are read: a delivery with an identifier
whose bit is set, or linked in its batch with such a one, is a copy. Of the others, one arrival of each message is
admitted, the smallest; then bits, links and admitted deliveries of the batch become visible by one manifest. The
dictionary is put before, so a batch that breaks after it finds its codes again, with no bit set, and loses nothing.

A batch is joined with the dictionary, never regrouped with it: the dictionary is read in place while the batch is
small. Messages that were admitted apart and are linked by a later delivery are noted as links; :meth:`copies` settles
them, so that the copies of all batches together are those of one batch.

Defined cases: a delivery without any identifier is a message of its own; a token that holds no hex digits is none; a
document key counts as a JSON value (order of keys and spacing don't matter), as text if it is no JSON; repeated rows
with one delivery_id are one delivery; a null batch_no comes last; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.positions import token_hex
from tidemark.session import materialise
from tidemark.store import Store, Versions

#: So many segments of the dictionary or the bitmaps are kept before they are merged.
MOST_SEGMENTS = 8
_DICTIONARY = "kind string, id string, low bigint, part int, idx bigint"
_BITS = "block bigint, bits binary"
_PLACED = "delivery_id bigint, message bigint, admitted boolean, old bigint, other bigint"


def message_identifiers(changes: DataFrame, *keep: str) -> DataFrame:
    """(delivery_id, id_a, id_b) of a change stream: the token's digits, and the change's own identity; either may be null."""
    key = F.coalesce(F.expr("to_json(try_parse_json(document_key))"), F.col("document_key"))
    present = F.col("shard").isNotNull() & F.col("cluster_time.t").isNotNull() & F.col("cluster_time.i").isNotNull() & F.col("ns").isNotNull() & F.col("document_key").isNotNull()
    parts = F.to_json(F.struct(F.col("shard").alias("s"), F.col("cluster_time.t").alias("t"), F.col("cluster_time.i").alias("i"), F.col("ns").alias("n"), key.alias("k")))
    return changes.where("delivery_id is not null").select("delivery_id", token_hex(F.col("_id")).alias("id_a"), F.when(present, parts).alias("id_b"), *keep)


def _is_star(edges: DataFrame) -> bool:
    """Whether every v has one u, and no u is a v."""
    ends = edges.select(F.col("v").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("u").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    odd = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below > 0 and above > 0)")
    return not odd.limit(1).count()


def least_codes(edges: DataFrame) -> DataFrame:
    """(code, root) for the codes in ``edges`` (a, b): root is the least code connected with it.

    Star contraction: every node points its larger neighbours to its least one, until only stars are left. Rounds grow
    with the logarithm of the longest chain, and only codes that are linked to another one take part.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "links")
    while not _is_star(edges):
        # large star: v's larger neighbours go to the least of v's neighbourhood
        around = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = around.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = around.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        # small star: v and its smaller neighbours go to the least of those
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = materialise(small, "links")
    return edges.select(F.col("v").alias("code"), F.col("u").alias("root"))


class SeenMessages:
    """Dictionary and bitmaps of the messages seen so far, in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, self.path)
        self._versions = Versions(self.store)

    def _manifest(self) -> dict:
        """``dictionary`` entries are [folder, code of the first row of each of its parts, rows]."""
        return self._versions.newest() or {"version": 0, "codes": 0, "dictionary": [], "bits": [], "placed": [], "out": []}

    def _commit(self, manifest: dict) -> None:
        manifest["version"] += 1
        self._versions.commit(manifest["version"], manifest)

    def _read(self, schema: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _write(self, df: DataFrame, name: str) -> str:
        df.write.parquet(f"{self.path}/{name}")
        return name

    def dictionary(self, segments: list | None = None) -> DataFrame:
        """(kind, id, low, code): every identifier once; low is the smallest delivery that bore it in its first batch."""
        out = None
        for folder, firsts, _ in self._manifest()["dictionary"] if segments is None else segments:
            code = F.element_at(F.array(*(F.lit(n).cast("bigint") for n in firsts)), F.col("part") + 1) + F.col("idx")
            part = self._read(_DICTIONARY, [folder]).select("kind", "id", "low", code.alias("code"))
            out = part if out is None else out.unionByName(part)
        return out

    def _encode(self, names: DataFrame, manifest: dict, stamp: str) -> tuple[DataFrame, DataFrame | None]:
        """Code a batch's identifiers: (new ones with low, high, n, code), (known ones with low, high, n, code, seen, message).

        low and high are the smallest and the largest of the n deliveries of the batch that bear it. The new ones go to
        the dictionary, which is put at once.
        """
        numbered = lambda df: df.withColumn("_m", F.monotonically_increasing_id()).withColumn("part", F.shiftright("_m", 33).cast("int")).withColumn("idx", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m")
        counted = names.groupBy("kind", "id").agg(F.min("delivery_id").alias("low"), F.max("delivery_id").alias("high"), F.count("*").alias("n"))
        known = None
        if not manifest["dictionary"]:
            segment = self._write(numbered(counted), f"dictionary-{stamp}")
        else:
            batch = materialise(counted, "identifiers")
            hits = self.dictionary(manifest["dictionary"]).withColumnRenamed("low", "first").join(batch, ["kind", "id"])
            known = materialise(self._with_bits(hits, manifest), "known")
            segment = self._write(numbered(batch.join(known, ["kind", "id"], "left_anti")), f"dictionary-{stamp}")
        sizes = {r["part"]: r["n"] for r in self._read(_DICTIONARY, [segment]).groupBy("part").agg(F.max("idx").alias("n")).collect()}  # one row per task
        firsts, at = [], manifest["codes"]
        for part in range(max(sizes, default=-1) + 1):
            firsts.append(at)
            at += sizes[part] + 1 if part in sizes else 0
        if firsts:
            manifest["dictionary"].append([segment, firsts, at - manifest["codes"]])
        manifest["codes"] = at
        self._commit(manifest)
        fresh = self._read(_DICTIONARY + ", high bigint, n bigint", [segment])
        code = F.element_at(F.array(*(F.lit(n).cast("bigint") for n in firsts)), F.col("part") + 1) + F.col("idx") if firsts else F.lit(0).cast("bigint")
        return fresh.select("kind", "id", "low", "high", "n", code.alias("code")), known

    def _with_bits(self, hits: DataFrame, manifest: dict) -> DataFrame:
        """Add ``seen``, from the bitmaps, and ``message``, the delivery that was admitted for it."""
        if manifest["bits"]:
            bits = self._read(_BITS, manifest["bits"]).groupBy("block").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
            byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(code + 1) div 8 + 1 as int), 1)")), 16, 10).cast("int")
            hits = hits.join(bits, F.expr("bitmap_bucket_number(code + 1)") == F.col("block"), "left").withColumn("_byte", byte)
            hits = hits.withColumn("seen", F.coalesce(F.expr("getbit(_byte, cast(bitmap_bit_position(code + 1) % 8 as int))") == 1, F.lit(False))).drop("block", "bits", "_byte")
        else:
            hits = hits.withColumn("seen", F.lit(False))
        # the dictionary names the first delivery that bore it; where that was a copy, its message is another one's
        moved = self._read(_PLACED, manifest["placed"]).where("not admitted").select(F.col("delivery_id").alias("first"), "message")
        return hits.join(moved, "first", "left").select("kind", "id", "low", "high", "n", "code", "seen", F.coalesce("message", "first").alias("message"))

    def _linked(self, names: DataFrame, fresh: DataFrame, known: DataFrame | None) -> DataFrame:
        """(delivery_id, low, high, old, other) of the deliveries that share an identifier with another one, here or before.

        low and high are the least and the largest of the deliveries that come first for one of its identifiers, old and
        other of the messages seen before. An identifier with one or two deliveries names them itself; only for those
        with more, which are few, the deliveries are looked up.
        """
        ids = fresh.where("n > 1").select("kind", "id", "low", "high", "n", F.lit(None).cast("bigint").alias("message"))
        if known is not None:
            ids = ids.unionByName(known.where("n > 1 or seen").select("kind", "id", "low", "high", "n", F.when(F.col("seen"), F.col("message")).alias("message")))
        borne = ids.where("n <= 2").select(F.explode(F.array_distinct(F.array("low", "high"))).alias("delivery_id"), "low", "message")
        many = materialise(ids.where("n > 2").select("kind", "id", "low", "message"), "many")
        if many.count():
            borne = borne.unionByName(names.join(many, ["kind", "id"]).select("delivery_id", "low", "message"))
        return borne.groupBy("delivery_id").agg(F.min("low").alias("low"), F.max("low").alias("high"), F.min("message").alias("old"), F.max("message").alias("other"))

    def admit(self, deliveries: DataFrame) -> DataFrame:
        """Admit a batch of (delivery_id, id_a, id_b); returns (delivery_id, message, admitted) of every delivery in it.

        ``message`` is the delivery that was admitted for the same message. ``deliveries`` is read several times, so it
        should be a written table. Identifiers are shuffled once, to be counted; after that mostly integers move.
        """
        manifest, stamp = self._manifest(), uuid.uuid4().hex[:12]
        both = F.array(F.struct(F.lit("a").alias("kind"), F.col("id_a").alias("id")), F.struct(F.lit("b").alias("kind"), F.col("id_b").alias("id")))
        every = deliveries.where("delivery_id is not null")
        names = every.select("delivery_id", F.explode(both).alias("x")).select("delivery_id", "x.*").where("id is not null")
        fresh, known = self._encode(names, manifest, stamp)
        linked = materialise(self._linked(names, fresh, known), "linked")
        roots = least_codes(linked.where("low <> high").select(F.col("low").alias("a"), F.col("high").alias("b")))
        grouped = linked.join(roots, linked["low"] == roots["code"], "left").select("delivery_id", F.coalesce("root", "low").alias("root"), "old", "other")
        groups = grouped.groupBy("root").agg(F.min("delivery_id").alias("first"), F.min("old").alias("was"))
        placed = grouped.join(groups, "root").select("delivery_id", F.coalesce("was", "first").alias("message"), (F.col("was").isNull() & (F.col("delivery_id") == F.col("first"))).alias("admitted"), "old", "other")
        folder = self._write(placed, f"placed-{stamp}")
        held_back = self._read(_PLACED, [folder]).where("not admitted").select("delivery_id", "message")
        out = self._write(every.select("delivery_id").distinct().join(held_back.select("delivery_id"), "delivery_id", "left_anti"), f"out-{stamp}")
        codes = fresh.select("code") if known is None else fresh.select("code").unionByName(known.where("not seen").select("code"))
        bits = codes.groupBy(F.expr("bitmap_bucket_number(code + 1)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(code + 1))").alias("bits"))
        for kind, name in (("bits", self._write(bits, f"bits-{stamp}")), ("placed", folder), ("out", out)):
            manifest[kind].append(name)
        self._tidy(manifest)
        self._commit(manifest)
        done = held_back.withColumn("admitted", F.lit(False))
        return every.select("delivery_id").distinct().join(done, "delivery_id", "left").select("delivery_id", F.coalesce("message", "delivery_id").alias("message"), F.coalesce("admitted", F.lit(True)).alias("admitted"))

    def _tidy(self, manifest: dict) -> None:
        """Merge bitmaps, and dictionary segments from the newest back while they are no larger than what is merged already; codes stay."""
        stamp = uuid.uuid4().hex[:12]
        if len(manifest["bits"]) > MOST_SEGMENTS:
            merged = self._read(_BITS, manifest["bits"]).groupBy("block").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
            manifest["bits"] = [self._write(merged, f"bits-all-{stamp}")]
        if len(manifest["dictionary"]) > MOST_SEGMENTS:
            left, merged, size = list(manifest["dictionary"]), [], 0
            while left and (len(merged) < 2 or left[-1][2] <= 2 * size):
                merged.append(left.pop())
                size += merged[-1][2]
            rows = self.dictionary(merged).select("kind", "id", "low", F.lit(0).alias("part"), F.col("code").alias("idx"))
            manifest["dictionary"] = [*left, [self._write(rows, f"dictionary-all-{stamp}"), [0], size]]

    def admitted(self) -> DataFrame:
        """(delivery_id) of all deliveries admitted so far."""
        return self._read("delivery_id bigint", self._manifest()["out"])

    def copies(self) -> DataFrame:
        """(delivery_id) of all deliveries that are copies, with the links found late settled: all but the smallest of each message."""
        rows = self._read(_PLACED, self._manifest()["placed"])
        late = F.array(F.struct(F.col("old").alias("a"), F.col("message").alias("b")), F.struct(F.col("other").alias("a"), F.col("message").alias("b")))
        roots = least_codes(rows.where("old is not null").select(F.explode(late).alias("e")).select("e.*"))
        held = rows.where("not admitted").select("delivery_id", "message")
        every = held.unionByName(held.select(F.col("message").alias("delivery_id"), "message")).unionByName(roots.select(F.col("code").alias("delivery_id"), F.col("code").alias("message"))).unionByName(roots.select(F.col("root").alias("delivery_id"), F.col("root").alias("message")))
        named = every.distinct().join(roots, every["message"] == roots["code"], "left").select("delivery_id", F.coalesce("root", "message").alias("message"))
        named = materialise(named, "settled")
        least = named.groupBy("message").agg(F.min("delivery_id").alias("least"))
        return named.join(least, "message").where("delivery_id <> least").select("delivery_id").distinct()


def in_order(deliveries: DataFrame, runs: int) -> list[DataFrame]:
    """Deliveries with a batch_no as ``runs`` written tables of consecutive batches, as a reader that wakes up so often finds them."""
    cuts = deliveries.agg(F.percentile_approx("batch_no", F.array(*(F.lit(k / runs) for k in range(1, runs))))).first()[0] if runs > 1 else None
    run = F.when(F.col("batch_no").isNull(), runs - 1)
    for k, cut in enumerate(cuts or []):
        run = run.when(F.col("batch_no") <= cut, k)
    from tidemark.session import work_path

    path = work_path(deliveries.sparkSession, "deliveries")
    deliveries.withColumn("run", run.otherwise(runs - 1 if cuts else 0)).write.partitionBy("run").parquet(path)
    whole = deliveries.sparkSession.read.schema(", ".join(f"{n} {t}" for n, t in [*deliveries.dtypes, ("run", "int")])).parquet(path)
    return [whole.where(F.col("run") == k).drop("run") for k in range(runs)]


def keep_first_entries(oplog: DataFrame) -> DataFrame:
    """(entry_id) of the copies of an entry captured again: all but the smallest entry_id of each (shard, ts)."""
    rows = oplog.where("shard is not null and ts is not null").select("entry_id", "shard", F.col("ts.t").alias("t"), F.col("ts.i").alias("i"))
    first = rows.groupBy("shard", "t", "i").agg(F.min("entry_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, ["shard", "t", "i"]).where("entry_id <> first").select("entry_id")
