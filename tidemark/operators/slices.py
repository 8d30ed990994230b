"""Cutting the rows of a large key into slices of its order.

Positions (t, i) become one number that keeps their order. A key that needs it is cut at positions of its own rows, found
from a sample of about SAMPLES rows per slice; the sample only places the cuts, every row falls into exactly one slice.
The cuts, as many as there are rows divided by the rows of a slice, go to the rows by a broadcast join on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Sampled rows per slice, and the most slices that are made (so the broadcast cuts stay within a few MB).
SAMPLES, MOST_SLICES = 16, 65_536


def ordinal(t: Column | str, i: Column | str) -> Column:
    """One number in the order of (t, i). Beyond 2^30 seconds or 2^32 steps, positions share a number and so a slice."""
    seconds = F.greatest(F.least(F.col(t) if isinstance(t, str) else t, F.lit((1 << 30) * 2 - 1)), F.lit(-(1 << 31))).cast("bigint")
    steps = F.greatest(F.least(F.col(i) if isinstance(i, str) else i, F.lit((1 << 32) - 1)), F.lit(0)).cast("bigint")
    return F.shiftleft(seconds, 32) + steps


def find_cuts(rows: DataFrame, key: list[str], at: str, count: int, rows_per_slice: int) -> DataFrame:
    """(key, cuts): the slices of each key with more than one; ``at`` is the order, ``count`` the number of rows.

    The window is over the sample of one key, SAMPLES / rows_per_slice of its rows.
    """
    rows_per_slice = max(rows_per_slice, -(-count // MOST_SLICES))
    fraction = min(1.0, SAMPLES / rows_per_slice)
    step = max(1, round(rows_per_slice * fraction))
    sampled = rows.select(*key, at).sample(fraction=fraction, seed=17) if fraction < 1 else rows.select(*key, at)
    numbered = sampled.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(at)))
    return numbered.where(F.col("_n") % step == 0).groupBy(*key).agg(F.sort_array(F.collect_set(at)).alias("cuts"))  # at most count / rows_per_slice numbers in all


def with_slice(rows: DataFrame, cuts: DataFrame, key: list[str], at: Column, name: str = "slice") -> DataFrame:
    """Add the slice of each row: the cuts of its key that lie below it; 0 for a key without cuts."""
    named = cuts.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("cuts").alias("_cuts"))
    same = [rows[k] == F.col(f"_{k}") for k in key]
    joined = rows.join(F.broadcast(named), same, "left")  # at most MOST_SLICES numbers in all
    return joined.withColumn(name, F.when(F.col("_cuts").isNull(), 0).otherwise(cuts_below(F.col("_cuts"), at))).drop("_cuts", *(f"_{k}" for k in key))


def cuts_below(cuts: Column, at: Column) -> Column:
    """How many of the sorted cuts lie below: first among the last ones of each block, then within one block."""
    block = F.ceil(F.sqrt(F.size(cuts).cast("double"))).cast("int")
    lasts = F.sequence(block, F.greatest(F.size(cuts), block), block)  # places of the blocks' last cuts, from 1
    full = F.size(F.filter(lasts, lambda p: (p <= F.size(cuts)) & (F.element_at(cuts, F.least(p, F.size(cuts))) < at)))
    inside = F.filter(F.slice(cuts, full * block + 1, block), lambda c: c < at)
    return full * block + F.size(inside)
