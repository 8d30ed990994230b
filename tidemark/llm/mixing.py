"""Mixing sources to target weights, by a curriculum that varies over training.

Sizes are tokens. A source can give at most its tokens times its ``max_repeats``. The total is by default the largest at
which every source reaches its target within its cap; for a larger total, what a source can't give goes to the others in
proportion to their targets, until all is placed or all are at their caps (water filling).

The curriculum gives each source weights over equal steps of training. They are balanced so that every step takes the
same number of tokens in all and every source gives over all steps what the mix allots to it. The integral of a source's
weights is its cumulative token demand over training positions, which are token offsets in the whole mix; a copy of a
document takes a span of its source's tokens, in order of a hash, and the inverse of the demand gives the position at
which the span is due. The mix is range-sorted by position. Running sums are taken over hash ranges of a source, so a
large source is spread over many tasks.

Defined cases: null and empty texts have no tokens and are never chosen; documents of a null or unlisted source are
left out; a listed source without documents or repeats gets nothing, and its target goes to the others; a null or
negative target counts as 0, a null ``max_repeats`` as 1; of repeated targets of one source the largest counts; a copy
is chosen if at least half of it lies within its source's tokens; repeated rows of a document are documents of their
own; a source without a schedule has the same weight throughout; weights that leave a source or a step without a way to
be served are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.bpe import DEFAULT_RANKS, count_tokens

#: Documents that a hash range of one source should hold.
RANGE_ROWS = 200_000


def sized_documents(documents: DataFrame, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, source, tokens) of the documents that have tokens and a source."""
    rows = documents.where("source is not null and text is not null and text <> ''")
    return count_tokens(rows, ["doc_id", "source"], ranks_path).where("tokens > 0")


def allot(targets: dict[str, tuple[float, int]], available: dict[str, int], total: float) -> dict[str, float]:
    """Tokens of each source: as near to the targets as the caps allow."""
    left = {s: t for s, (t, _) in targets.items() if t > 0 and available.get(s, 0) > 0}
    cap = {s: available[s] * max(0, targets[s][1]) for s in left}
    out = dict.fromkeys(targets, 0.0)
    rest = float(total)
    while left and rest > 0:
        weight = sum(left.values())
        full = [s for s, t in left.items() if rest * t / weight >= cap[s]]
        if not full:
            for s, t in left.items():
                out[s] = rest * t / weight
            break
        for s in full:
            out[s] = float(cap[s])
        rest -= sum(cap[s] for s in full)
        for s in full:
            del left[s]
    return out


def _targets(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """The targets: a configuration table, one row per source."""
    rows = mix_targets.where("source_name is not null").select("source_name", "target_share", "max_repeats").collect()
    out: dict[str, tuple[float, int]] = {}
    for r in rows:
        new = (max(0.0, r["target_share"] or 0.0), 1 if r["max_repeats"] is None else r["max_repeats"])
        out[r["source_name"]] = max(out.get(r["source_name"], new), new)
    return out


def plan(sized: DataFrame, mix_targets: DataFrame, total: float | None = None) -> list[dict]:
    """One entry per listed source: target, cap, available and allotted tokens; by default for the reachable total."""
    targets = _targets(mix_targets)
    held = {r["source"]: (r["tokens"], r["rows"]) for r in sized.where(F.col("source").isin(list(targets))).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).collect()}
    available = {s: n for s, (n, _) in held.items()}
    tokens = allot(targets, available, reachable_total(targets, available) if total is None else total)
    return [{"source": s, "target_share": t, "max_repeats": m, "available": available.get(s, 0), "rows": held.get(s, (0, 0))[1], "allotted": tokens[s]} for s, (t, m) in sorted(targets.items())]


def reachable_total(targets: dict[str, tuple[float, int]], available: dict[str, int]) -> float:
    """The largest total at which every source that has documents and repeats reaches its target within its cap."""
    able = {s: (t, available[s] * m) for s, (t, m) in targets.items() if t > 0 and m > 0 and available.get(s, 0) > 0}
    weight = sum(t for t, _ in able.values())
    return min((cap * weight / t for t, cap in able.values()), default=0.0)


def curriculum(allotted: dict[str, float], schedules: dict[str, list[float]]) -> dict[str, list[float]]:
    """Tokens that each source gives in each step: in proportion to its weights as far as every step takes the same in all.

    Rows and columns are scaled in turn (iterative proportional fitting) until both sums hold to a millionth.
    """
    steps = max(map(len, schedules.values()), default=1)
    if any(len(w) != steps for w in schedules.values()):
        raise ValueError("all schedules must have the same number of steps")
    total = sum(allotted.values())
    out = {s: [float(w) for w in schedules.get(s, [1.0] * steps)] for s in allotted}
    for _ in range(10_000):
        for s, a in allotted.items():
            given = sum(out[s])
            if given <= 0:
                raise ValueError(f"the schedule of {s} gives it no tokens")
            out[s] = [x * a / given for x in out[s]]
        sums = [sum(row[k] for row in out.values()) for k in range(steps)]
        if any(x <= 0 for x in sums):
            raise ValueError("a step of the curriculum has no source")
        if all(abs(x * steps / total - 1) < 1e-6 for x in sums):
            return out
        for s in out:
            out[s] = [x * total / steps / sums[k] for k, x in enumerate(out[s])]
    raise ValueError("no mix over time follows these schedules")


def _due(done: Column, demand: list[float], step: float) -> Column:
    """Training position at which a source has given ``done`` tokens: the inverse of its cumulative demand."""
    starts, at = [], 0.0
    for k, tokens in enumerate(demand):
        if tokens > 0:
            starts.append((at, tokens, k))
        at += tokens
    out = F.lit(step * len(demand))
    for start, tokens, k in reversed(starts):
        out = F.when(done < start + tokens, F.lit(k * step) + (done - start) * (step / tokens)).otherwise(out)
    return out


def mix(sized: DataFrame, mix_targets: DataFrame, total: float | None = None, schedules: dict[str, list[float]] | None = None) -> DataFrame:
    """(source, doc_id, copy, tokens, position): every chosen copy, in training order; position is a token offset in the mix.

    ``sized`` is read several times, so it should be a written table.
    """
    entries = [e for e in plan(sized, mix_targets, total) if e["allotted"] > 0]
    spark = sized.sparkSession
    if not entries:
        return spark.createDataFrame([], "source string, doc_id bigint, copy int, tokens bigint, position double")
    allotted = {e["source"]: e["allotted"] for e in entries}
    demand = curriculum(allotted, {s: w for s, w in (schedules or {}).items() if s in allotted})
    ranges = max(1, -(-max(e["rows"] for e in entries) // RANGE_ROWS))
    wanted = spark.createDataFrame([(e["source"], float(e["allotted"]), int(e["available"]), int(e["max_repeats"])) for e in entries], "source string, allotted double, available bigint, max_repeats int")
    order = F.xxhash64("doc_id")
    rows = sized.join(F.broadcast(wanted), "source").withColumn("h", order).withColumn("part", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * ranges))  # one row per listed source
    sums = rows.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).drop("n")
    inside = F.sum("tokens").over(Window.partitionBy("source", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    # as many rows as hash ranges: sources times documents / RANGE_ROWS; joined by its size
    placed = rows.join(before, ["source", "part"]).withColumn("start", F.col("before") + F.coalesce(inside, F.lit(0)))
    # copy k of a document starts at k * available + start
    most = F.least(F.floor((F.col("allotted") - F.col("start") - F.col("tokens") / 2) / F.col("available")) + 1, F.col("max_repeats").cast("bigint"))
    copies = placed.where(most > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), most.cast("int"))))
    done = (F.col("copy") - 1) * F.col("available") + F.col("start") + F.col("tokens") / 2
    step, position = sum(allotted.values()) / len(next(iter(demand.values()))), F.lit(None).cast("double")
    for source, tokens in sorted(demand.items()):
        position = F.when(F.col("source") == source, _due(done, tokens, step)).otherwise(position)
    return copies.select("source", "doc_id", "copy", "tokens", position.alias("position")).orderBy("position", "source", "doc_id", "copy")


def shares(sized: DataFrame, chosen: DataFrame, mix_targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source_name, target_share, max_repeats, available_tokens, wanted_tokens, chosen_tokens, chosen_rows, reached_share)."""
    entries = plan(sized, mix_targets, total)
    spark = sized.sparkSession
    table = spark.createDataFrame([(e["source"], e["target_share"], e["max_repeats"], int(e["available"]), float(e["allotted"])) for e in entries], "source_name string, target_share double, max_repeats int, available_tokens bigint, wanted_tokens double")
    got = chosen.groupBy(F.col("source").alias("source_name")).agg(F.sum("tokens").alias("chosen_tokens"), F.count("*").alias("chosen_rows"))
    every = F.sum("chosen_tokens").over(Window.partitionBy())  # one row per listed source
    joined = table.join(got, "source_name", "left").fillna(0, ["chosen_tokens", "chosen_rows"])
    return joined.withColumn("reached_share", F.round(F.col("chosen_tokens") / every, 6))


def shares_over_time(sized: DataFrame, chosen: DataFrame, mix_targets: DataFrame, schedules: dict[str, list[float]], total: float | None = None) -> DataFrame:
    """(step, source_name, wanted_share, reached_share, chosen_tokens) of each step of the curriculum."""
    allotted = {e["source"]: e["allotted"] for e in plan(sized, mix_targets, total) if e["allotted"] > 0}
    demand = curriculum(allotted, {s: w for s, w in schedules.items() if s in allotted}) if allotted else {}
    steps, whole = len(next(iter(demand.values()), [1])), sum(allotted.values()) or 1.0
    table = sized.sparkSession.createDataFrame([(k, s, tokens * steps / whole) for s, row in demand.items() for k, tokens in enumerate(row)], "step int, source_name string, wanted_share double")
    step = F.least(F.floor(F.col("position") * steps / whole), F.lit(steps - 1)).cast("int")
    got = chosen.groupBy(step.alias("step"), F.col("source").alias("source_name")).agg(F.sum("tokens").alias("chosen_tokens"))
    joined = table.join(got, ["step", "source_name"], "left").fillna(0, ["chosen_tokens"])
    share = F.col("chosen_tokens") / F.sum("chosen_tokens").over(Window.partitionBy("step"))  # one row per listed source
    return joined.select("step", "source_name", F.round("wanted_share", 6).alias("wanted_share"), F.round(share, 6).alias("reached_share"), "chosen_tokens")
