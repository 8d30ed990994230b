"""The engine's own functions for use in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession, functions as F

from tidemark.session import ship


def register_functions(spark: SparkSession) -> list[str]:
    """Register tm_* functions: update payloads to operator form, transit documents, hash and bucket of a key, position of an offset."""
    from tidemark.functions.docs import parse
    from tidemark.functions.transit import to_transit
    from tidemark.operators.parse import normalise_update

    ship(spark)

    @F.pandas_udf("string")
    def update(texts: pd.Series) -> pd.Series:
        return texts.map(normalise_update, na_action="ignore").astype(object)

    @F.pandas_udf("string")
    def transit(texts: pd.Series) -> pd.Series:
        import json

        return pd.Series([None if (d := parse(t)) is None else json.dumps(to_transit(d), ensure_ascii=False) for t in texts], dtype=object)

    spark.udf.register("tm_normalise_update", update)
    spark.udf.register("tm_transit", transit)
    units = "sequence(1, cast(length(hex(encode(s, 'UTF-16BE'))) / 4 as int))"
    total = f"aggregate(transform({units}, i -> cast(conv(substr(hex(encode(s, 'UTF-16BE')), (i - 1) * 4 + 1, 4), 16, 10) as bigint)), 0L, (a, x) -> (a * 31 + x) % 4294967296)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tm_java_hash(s STRING) RETURNS BIGINT RETURN CASE WHEN s = '' THEN 0 ELSE {total} - CASE WHEN {total} >= 2147483648 THEN 4294967296 ELSE 0 END END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tm_bucket(s STRING, n BIGINT) RETURNS BIGINT RETURN coalesce(pmod(tm_java_hash(s), n), 0)")
    return ["tm_normalise_update", "tm_transit", "tm_java_hash", "tm_bucket"]
