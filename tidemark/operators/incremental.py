"""Processing only new or changed records.

**Log with a commit sequence.** :class:`CommitLog` numbers the arrivals of a log: what a writer appends becomes visible
as commit n, by one manifest put where there is none, so whatever becomes visible later has a larger number, however old
its own times are. :class:`IncrementalRunner` keeps its high-watermark on that sequence. A run fixes its upper limit when
it begins, reads the commits between watermark and limit and no others, leaves out entries that have the position of an
entry of an earlier run (their narrow key files are read for the positions in question only), and puts one manifest that
holds output, keys and watermark together: all appear or none.

**Tables with a journal.** Where readers of a log have left a journal of runs, a committed run read everything that had
landed up to its ``read_at`` between its start and end positions. So the high-watermark is kept on the landing sequence
position by position: the largest ``read_at`` of the committed runs that span it, and a position is pending while it
landed after its watermark. Nothing is skipped (a late entry lies above the watermark of its position) and nothing
repeated (a broken run adds no watermark). :meth:`IncrementalRunner.take` fixes the limit, takes the pending positions
that landed up to it, and commits them with its own journal rows, which the next run reads beside the others.

Defined cases: rows with a null shard, position or landing time name no position; a committed run with a null or
unreadable end, or a null ``read_at``, covers nothing; a null start lies before everything; an unreadable start that
is not null covers nothing; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.positions import micros, offset_position, token_hex, token_position
from tidemark.operators.slices import cuts_below, find_cuts, ordinal, with_slice
from tidemark.session import materialise, ship
from tidemark.store import Store, Versions

KEYS = ["shard", "capture_mode"]
#: Positions that one slice of a shard should hold.
SLICE_ROWS = 200_000
_JOURNAL = "shard string, capture_mode string, lo_t bigint, lo_i bigint, hi_t bigint, hi_i bigint, read_to bigint"
_KEY_ROWS = "shard string, t bigint, i bigint"
#: So many segments of processed positions are kept before they are merged.
MOST_SEGMENTS = 8
_POSITIONS = "shard string, capture_mode string, pos_t bigint, pos_i bigint"

def landed_rows(oplog: DataFrame | None, changes: DataFrame | None) -> DataFrame:
    """(shard, capture_mode, pos_t, pos_i, landed) of every row that has a position, in microseconds."""
    parts = []
    if oplog is not None:
        parts.append(oplog.select("shard", F.lit("OPLOG").alias("capture_mode"), F.col("ts.t").alias("pos_t"), F.col("ts.i").alias("pos_i"), micros("landed_at").alias("landed")))
    if changes is not None:
        parts.append(changes.select("shard", F.lit("CHANGE_STREAM").alias("capture_mode"), F.col("cluster_time.t").alias("pos_t"), F.col("cluster_time.i").alias("pos_i"), micros("landed_at").alias("landed")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.where("shard is not null and pos_t is not null and pos_i is not null and landed is not null")


def landed_positions(rows: DataFrame) -> DataFrame:
    """Each distinct position once, with its earliest landing."""
    return rows.groupBy(*KEYS, "pos_t", "pos_i").agg(F.min("landed").alias("landed"))


def committed_runs(journal: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """The committed runs: (shard, capture_mode, lo_t, lo_i, hi_t, hi_i, read_to).

    A run's state is that of its last row by ``logged_at``. Tokens stand for the cluster time in their first bytes; a
    token not in that form is looked up in ``changes``.
    """
    row = F.struct("logged_at", "run_state", "start_offset", "end_offset", "read_at")
    last = (
        journal.where("shard is not null and capture_mode is not null and logged_at is not null")
        .groupBy(*KEYS, "run_id")
        .agg(F.max(row).alias("r"))
        .where("r.run_state = 'COMMITTED' and r.end_offset is not null and r.read_at is not null")
        .select(*KEYS, "run_id", "r.*")
    )
    for side in ("start", "end"):
        offset = F.col(f"{side}_offset")
        last = last.withColumn(f"{side}_token", F.when(F.col("capture_mode") == "CHANGE_STREAM", token_hex(offset)))
        last = last.withColumn(f"{side}_pos", F.when(F.col("capture_mode") == "CHANGE_STREAM", token_position(F.col(f"{side}_token"))).otherwise(offset_position(offset)))
    if changes is not None:
        last = _look_up_tokens(last, changes)
    ok = "end_pos.t is not null and end_pos.i is not null and (start_offset is null or (start_pos.t is not null and start_pos.i is not null))"
    low = F.lit(-1).cast("long")
    return last.where(ok).select(
        *KEYS,
        F.coalesce("start_pos.t", low).alias("lo_t"),
        F.coalesce("start_pos.i", low).alias("lo_i"),
        F.col("end_pos.t").alias("hi_t"),
        F.col("end_pos.i").alias("hi_i"),
        micros("read_at").alias("read_to"),
    )


def _look_up_tokens(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """Fill positions of tokens that don't carry one, from the messages that bear them; AQE drops this when there are none."""
    odd = None
    for side in ("start", "end"):
        part = runs.where(f"{side}_pos is null and {side}_token is not null").select(F.col(f"{side}_token").alias("token"))
        odd = part if odd is None else odd.unionByName(part)
    known = (
        changes.where("_id is not null and cluster_time is not null")
        .select(token_hex(F.col("_id")).alias("token"), "cluster_time")
        .join(odd.distinct(), "token", "left_semi")
        .groupBy("token")
        .agg(F.min("cluster_time").alias("at"))
    )
    for side in ("start", "end"):
        renamed = known.select(F.col("token").alias(f"{side}_token"), F.col("at").alias(f"{side}_at"))
        runs = runs.join(renamed, f"{side}_token", "left").withColumn(f"{side}_pos", F.coalesce(f"{side}_pos", f"{side}_at")).drop(f"{side}_at")
    return runs


def _uncovered(key, positions: pa.Table, runs: pa.Table) -> pa.Table:
    """Positions of one slice above their watermark. Runs are applied in order of read_to, so the largest stays."""
    t, i = positions["pos_t"].to_numpy(), positions["pos_i"].to_numpy()
    order = np.lexsort((i, t))
    t, i = t[order], i[order]
    landed = positions["landed"].to_numpy()[order]
    mark = np.full(len(t), np.iinfo(np.int64).min)
    if runs.num_rows and len(t):

        def place(tt, ii):
            # index of the first position after (tt, ii)
            lo, hi = np.searchsorted(t, tt, "left"), np.searchsorted(t, tt, "right")
            return np.array([a + np.searchsorted(i[a:b], x, "right") for a, b, x in zip(lo, hi, ii)], dtype=np.int64)

        read_to = runs["read_to"].to_numpy()
        first = place(runs["lo_t"].to_numpy(), runs["lo_i"].to_numpy())
        after = place(runs["hi_t"].to_numpy(), runs["hi_i"].to_numpy())
        for k in np.argsort(read_to, kind="stable"):
            mark[first[k] : after[k]] = read_to[k]
    keep = landed > mark
    n = int(keep.sum())
    return pa.table(
        {
            "shard": pa.array([key[0].as_py()] * n, pa.string()),
            "capture_mode": pa.array([key[1].as_py()] * n, pa.string()),
            "pos_t": pa.array(t[keep], pa.int64()),
            "pos_i": pa.array(i[keep], pa.int64()),
        }
    )


def pending_positions(positions: DataFrame, runs: DataFrame, rows_per_slice: int = SLICE_ROWS) -> DataFrame:
    """(shard, capture_mode, pos_t, pos_i) of the :func:`landed_positions` above their watermark.

    ``positions`` is read several times, so it should be a written table. A shard with more positions than a slice holds
    is cut at quantiles of its own positions, so neither an outlier nor a burst, even within one second, puts much of it
    into one slice. A run goes to each slice that it spans, never to each position.
    """
    ship(positions.sparkSession)
    placed = positions.withColumn("_at", ordinal("pos_t", "pos_i"))
    cuts = materialise(find_cuts(placed, KEYS, "_at", positions.count(), rows_per_slice), "cuts")
    cut_positions = with_slice(placed, cuts, KEYS, F.col("_at")).drop("_at")
    named = cuts.select(F.col("shard").alias("_shard"), F.col("capture_mode").alias("_mode"), "cuts")
    low, high = cuts_below(F.col("cuts"), ordinal("lo_t", "lo_i")), cuts_below(F.col("cuts"), ordinal("hi_t", "hi_i"))
    span = F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(low, F.greatest(low, high)))
    joined = runs.join(F.broadcast(named), (F.col("shard") == F.col("_shard")) & (F.col("capture_mode") == F.col("_mode")), "left")  # as many numbers as slices
    cut_runs = joined.withColumn("slice", F.explode(span)).select(*KEYS, "slice", "lo_t", "lo_i", "hi_t", "hi_i", "read_to")
    keys = [*KEYS, "slice"]
    return cut_positions.groupBy(*keys).cogroup(cut_runs.groupBy(*keys)).applyInArrow(_uncovered, _POSITIONS)


class CommitLog:
    """A log in numbered commits, in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, self.path)
        self._commits = Versions(self.store, "commits")

    def head(self) -> int:
        """The number of the last commit; 0 if there is none."""
        names = self.store.names("commits")
        return int(names[-1][1:]) if names else 0

    def append(self, rows: DataFrame) -> int:
        """Write rows, then make them visible as the next commit; returns its number. Of writers at the same time each gets one."""
        name = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        number = self.head() + 1
        while not self.store.put_new(f"commits/v{number:010d}", f'{{"rows": "{name}"}}'):
            number += 1
        return number

    def read(self, after: int, until: int) -> DataFrame | None:
        """The rows of commits after one number and up to another; no other file is opened. None if there are no such commits."""
        import json

        wanted = [n for n in self.store.names("commits") if after < int(n[1:]) <= until]
        folders = [json.loads(self.store.read(f"commits/{n}"))["rows"] for n in wanted]
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None


class IncrementalRunner:
    """Processes the new records of a log, each exactly once, across failures.

    What a run writes becomes part of the result by one manifest, which also moves the watermark. What a broken run
    leaves is never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, self.path)
        self._versions = Versions(self.store)

    def _last(self) -> dict:
        """The newest manifest: ``out`` names the output of every run, ``keys`` the segments [folder, rows] of their positions, ``journal`` their journal rows."""
        return self._versions.newest() or {"number": 0, "to": None, "out": [], "keys": [], "journal": []}

    def watermark(self) -> int | None:
        """The upper limit of the last committed run."""
        return self._last()["to"]

    def output(self) -> DataFrame | None:
        """What all committed runs have written."""
        folders = [f"{self.path}/{name}" for name in self._last()["out"]]
        return self.spark.read.parquet(*folders) if folders else None

    def _keys(self, segments: list) -> DataFrame:
        return self.spark.read.schema(_KEY_ROWS).parquet(*(f"{self.path}/{name}" for name, _ in segments))

    def _with_keys(self, keys: DataFrame, segments: list, stamp: str) -> list:
        """Write a run's positions as a segment, sorted so that a later run reads little of it; merge segments from the newest back when there are many."""
        keys.sortWithinPartitions("t", "i").write.parquet(f"{self.path}/keys-{stamp}")
        left = [*segments, [f"keys-{stamp}", self._keys([[f"keys-{stamp}", 0]]).count()]]
        if len(left) <= MOST_SEGMENTS:
            return left
        merged, rows = [], 0
        while left and (len(merged) < 2 or left[-1][1] <= 2 * rows):
            merged.append(left.pop())
            rows += merged[-1][1]
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._keys(merged).repartitionByRange(parts, "t", "i").sortWithinPartitions("t", "i").write.parquet(f"{self.path}/keys-all-{stamp}")
        return [*left, [f"keys-all-{stamp}", rows]]

    def _commit(self, run: dict, before_commit: Callable[[], None]) -> None:
        before_commit()
        self._versions.commit(run["number"], run)

    def run(self, log: CommitLog, transform: Callable[[DataFrame], DataFrame], before_commit: Callable[[], None] = lambda: None) -> int | None:
        """Process the commits after the watermark and up to the last one there is now; returns that number, or None if there is none.

        Entries with the (shard, ts) of an entry of an earlier run, or of another one of this run, are repeats.
        """
        last = self._last()
        mark, limit, stamp = last["to"] or 0, log.head(), uuid.uuid4().hex[:12]
        if limit <= mark:
            return None
        keys = [F.col("shard"), F.col("ts.t").alias("t"), F.col("ts.i").alias("i")]
        fresh = log.read(mark, limit).where("shard is not null and ts.t is not null and ts.i is not null").dropDuplicates(["shard", "ts"])
        fresh = materialise(fresh, "fresh")
        if last["keys"]:
            span = fresh.agg(F.min("ts.t").alias("a"), F.max("ts.t").alias("b")).first()
            known = self._keys(last["keys"]).where(F.col("t").between(span["a"], span["b"]))
            here = fresh.select(*keys)
            seen = known.join(here, ["shard", "t", "i"], "left_semi")
            fresh = fresh.join(seen.select(F.col("shard").alias("_s"), F.col("t").alias("_t"), F.col("i").alias("_i")), (F.col("shard") == F.col("_s")) & (F.col("ts.t") == F.col("_t")) & (F.col("ts.i") == F.col("_i")), "left_anti")
            fresh = materialise(fresh, "fresh")
        transform(fresh).write.parquet(f"{self.path}/out-{stamp}")
        segments = self._with_keys(fresh.select(*keys), last["keys"], stamp)
        self._commit({**last, "number": last["number"] + 1, "from": mark, "to": limit, "out": [*last["out"], f"out-{stamp}"], "keys": segments}, before_commit)
        return limit

    def take(self, oplog: DataFrame | None, changes: DataFrame | None, journal: DataFrame, before_commit: Callable[[], None] = lambda: None, rows_per_slice: int = SLICE_ROWS) -> int | None:
        """Take the pending positions of both logs that have landed by now, given the :func:`committed_runs` of others.

        The limit is the last landing there is when the run begins; what lands meanwhile is left to the next run. The
        positions taken become the output together with this run's own journal rows, one per shard and mode, by which
        later runs know them as processed. Everything that landed up to the limit of an earlier run of this runner is
        processed, so a later run groups only rows that landed after it, and looks up whether their positions are older.
        """
        last = self._last()
        mark, stamp = last["to"], uuid.uuid4().hex[:12]
        after = [None if t is None else _landed_after(t, mark) for t in (oplog, changes)]
        fresh = landed_rows(*after)
        limit = fresh.agg(F.max("landed").alias("m")).first()["m"]
        if limit is None:
            return None
        positions = materialise(landed_positions(fresh.where(F.col("landed") <= limit)), "positions")
        if mark is not None:
            old = landed_rows(oplog, changes).where(F.col("landed") <= mark).join(positions.drop("landed"), [*KEYS, "pos_t", "pos_i"], "left_semi")
            positions = materialise(positions.join(old.drop("landed").distinct(), [*KEYS, "pos_t", "pos_i"], "left_anti"), "positions")
        own = [f"{self.path}/{name}" for name in last["journal"]]
        runs = journal.unionByName(self.spark.read.schema(_JOURNAL).parquet(*own)) if own else journal
        pending_positions(positions, runs, rows_per_slice).write.parquet(f"{self.path}/out-{stamp}")
        ends = positions.groupBy(*KEYS).agg(F.max(F.struct("pos_t", "pos_i")).alias("hi"))
        low = F.lit(-1).cast("bigint")
        ends.select(*KEYS, low.alias("lo_t"), low.alias("lo_i"), F.col("hi.pos_t").alias("hi_t"), F.col("hi.pos_i").alias("hi_i"), F.lit(limit).alias("read_to")).write.parquet(f"{self.path}/journal-{stamp}")
        self._commit({**last, "number": last["number"] + 1, "from": mark, "to": limit, "out": [*last["out"], f"out-{stamp}"], "journal": [*last["journal"], f"journal-{stamp}"]}, before_commit)
        return limit


def _landed_after(table: DataFrame, mark: int | None) -> DataFrame:
    """Rows that landed after a time in microseconds; the filter reaches the scan."""
    if mark is None:
        return table
    return table.where(F.col("landed_at") > F.timestamp_micros(F.lit(mark)).cast(table.schema["landed_at"].dataType))
