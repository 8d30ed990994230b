"""Verification of a target against its source: by count, by key, by content; for all namespaces at once.

Nothing is sorted across the whole copy and no document is looked up on its own: one full outer join by key carries a
digest of each document's canonical text, so that content mode shuffles keys and digests only.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.docs import canonical, parse


def canonical_text(doc: Column | str, ignored: tuple[str, ...] = ()) -> Column:
    """Text that equal documents share: sorted fields, plain numbers, the ignored top-level fields left out.

    Whole numbers beyond 2^53 and numbers with an exponent are compared as written; :func:`exact_digest` takes them as
    doubles. Text that is no JSON object stays as it is.
    """
    c = F.col(doc) if isinstance(doc, str) else doc
    fields = F.map_entries(F.try_parse_json(c).try_cast("map<string,variant>"))
    kept = F.filter(fields, lambda e: ~e["key"].isin(*ignored)) if ignored else fields
    texts = F.transform(kept, lambda e: F.to_json(F.struct(e["key"].alias("k"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("v"))))
    return F.coalesce(F.array_join(F.array_sort(texts), ","), c)


def exact_digest(doc: Column | str, ignored: tuple[str, ...] = ()) -> Column:
    """A 128-bit digest that equal documents share, with numbers as doubles however they are written (an Arrow function)."""
    skip = frozenset(ignored)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            value = parse(text)
            if isinstance(value, dict):
                value = {k: v for k, v in value.items() if k not in skip}
            whole = repr(canonical(value)) if value is not None else f"text:{text}"
            out.append(hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
        return pd.Series(out, dtype=object)

    return run(doc)


def digest(doc: Column | str) -> Column:
    """A 128-bit digest, of two 64-bit hashes with different seeds: a column's hash is the seed of the next one's."""
    return F.struct(F.xxhash64(doc).alias("a"), F.xxhash64(F.lit(1), doc).alias("b"))


def paired(source: DataFrame, target: DataFrame, key: list[str], content: Column | str | None = None, latest: str | None = None) -> DataFrame:
    """Keys of either side with ``in_source``, ``in_target`` and, with ``content``, ``differs``.

    A key's repeated rows count once: with ``latest`` the one with the largest value in that column, as a comparison by
    fields takes it; without, the one with the smallest digest.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        d = (digest(content) if content is not None else F.lit(0)).alias("d")
        if latest is not None and content is not None:
            return df.select(*key, F.col(latest).alias("_at"), d).groupBy(*key).agg(F.max(F.struct("_at", "d")).getField("d").alias(f"_{name}"))
        return df.select(*key, d).groupBy(*key).agg(F.min("d").alias(f"_{name}"))

    a = side(source, "s")
    b = side(target, "t").select(*(F.col(k).alias(f"_{k}") for k in key), "_t")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return a.join(b, on, "full_outer").select(
        *(F.coalesce(k, f"_{k}").alias(k) for k in key), F.col("_s").isNotNull().alias("in_source"), F.col("_t").isNotNull().alias("in_target"), F.coalesce(F.col("_s") != F.col("_t"), F.lit(False)).alias("differs")
    )


def counts(source: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """COUNT mode: rows of each side, and whether they are as many."""
    a = source.groupBy(*by).agg(F.count("*").alias("source_count"))
    b = target.groupBy(*by).agg(F.count("*").alias("target_count"))
    joined = a.join(b, by, "full_outer").fillna(0, ["source_count", "target_count"])
    return joined.withColumn("passed", F.col("source_count") == F.col("target_count"))


def report(pairs: DataFrame, by: list[str]) -> DataFrame:
    """ID and FULL modes: missing, extra, compared, mismatching keys, and the verdict."""
    both = F.col("in_source") & F.col("in_target")
    out = pairs.groupBy(*by).agg(
        F.count_if(F.col("in_source") & ~F.col("in_target")).alias("missing_on_target"),
        F.count_if(F.col("in_target") & ~F.col("in_source")).alias("missing_on_source"),
        F.count_if(both & F.col("differs")).alias("content_mismatch"),
        F.count_if(both).alias("compared"),
    )
    return out.withColumn("passed", passed())


def passed() -> Column:
    return (F.col("missing_on_target") == 0) & (F.col("missing_on_source") == 0) & (F.col("content_mismatch") == 0)


def missing(pairs: DataFrame, key: list[str]) -> DataFrame:
    return pairs.where(F.col("in_source") & ~F.col("in_target")).select(*key)


def extra(pairs: DataFrame, key: list[str]) -> DataFrame:
    return pairs.where(F.col("in_target") & ~F.col("in_source")).select(*key)


def samples(pairs: DataFrame, key: list[str], by: list[str], limit: int = 50) -> DataFrame:
    """The first ``limit`` findings of each namespace in order of key: a window group limit, applied before the shuffle too."""
    kind = F.when(~F.col("in_target"), "missingOnTarget").when(~F.col("in_source"), "missingOnSource").when(F.col("differs"), "contentMismatch")
    found = pairs.select(*key, kind.alias("kind")).where("kind is not null")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*key))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def exit_code(reports: DataFrame) -> DataFrame:
    """(namespaces, passed, exit_code) of a run over several namespaces: 0 if all passed, else 1; 2 if there was none."""
    total = reports.agg(F.count("*").alias("namespaces"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"))
    return total.withColumn("exit_code", F.when(F.col("namespaces") == 0, 2).when(F.col("passed"), 0).otherwise(1))
