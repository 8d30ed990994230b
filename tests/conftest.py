import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session, ship

    s = build_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def rows(small):
    import pyarrow.parquet as pq

    return lambda table: pq.read_table(f"{small}/{table}.parquet").to_pylist()


def blank_row(df, spark):
    """The table with a row of nulls."""
    return df.unionByName(spark.createDataFrame([tuple(None for _ in df.columns)], df.schema))


#: Column names that operators use inside.
CLASHES = ("slice", "side", "at", "rank", "code", "path", "type", "n", "previous", "landed", "a", "b", "u", "v", "m", "x", "_rn", "id_a", "count", "value", "key", "source_ns", "heavy_key", "file", "pos", "d", "r", "tokens", "h", "part", "areas")


def clashing(df):
    """The table with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(1).alias(c) for c in CLASHES if c not in df.columns))


@pytest.fixture(params=["plain", "null row", "clashing columns", "repeated rows", "empty"])
def shape(request, spark):
    """Ways in which a table may be unusual; changes a table accordingly."""
    return request.param, {
        "plain": lambda df: df,
        "null row": lambda df: blank_row(df, spark),
        "clashing columns": clashing,
        "repeated rows": lambda df: df.unionByName(df),
        "empty": lambda df: df.limit(0),
    }[request.param]
