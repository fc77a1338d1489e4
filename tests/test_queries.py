"""Every query against its SQL on the smallest tables, and the graph and id functions against plain Python."""

import os
import random

import duckdb
import pandas as pd
import pytest

from sylvan.functions import ids
from sylvan.operators import graph
from sylvan.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(None if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False)) if len(df.columns) == 1 else sorted((tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(DATA):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{table}'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_node_ids(spark):
    digits = ids.DIGITS

    def encode(n):
        return (encode(n // 64) if n >= 64 else "") + digits[n % 64]

    values = [0, 1, 63, 64, 5731700211660045983, (1 << 63) + 5, (1 << 64) - 1]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(str(v),) for v in values] + [("~plain",)], "v string")
    got = {x.v: (x.c, x.d) for x in df.select("v", ids.encode_node_id(F.col("v")).alias("c")).select("v", "c", ids.decode_node_id(F.col("c")).alias("d")).collect()}
    assert got == {str(v): (encode(v), str(v)) for v in values} | {"~plain": ("~plain", None)}
    assert got["5731700211660045983"][0] == "4Yb5JA31NUv"  # a fixed value: a known pair


def test_node_ids_beyond_the_largest_and_malformed(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(v,) for v in ("18446744073709551616", "99999999999999999999", "123456789012345678901234", "-5", "007", "", None)], "v string")
    assert [r.c for r in df.select(ids.encode_node_id(F.col("v")).alias("c")).collect()] == ["18446744073709551616", "99999999999999999999", "123456789012345678901234", "-5", "7", "", None]
    most, eleven = str((1 << 66) - 1), "Z" * 11
    df = spark.createDataFrame([(eleven,), ("000" + eleven,), ("1" + eleven,), ("a-b",), ("",), (None,), ("0",)], "v string")
    assert [r.d for r in df.select(ids.decode_node_id(F.col("v")).alias("d")).collect()] == [most, most, None, None, "", None, "0"]
    strict = lambda v: spark.createDataFrame([(v,)], "v string").select(ids.decode_node_id(F.col("v"), strict=True).alias("d")).collect()[0].d
    assert (strict(eleven), strict(None), strict("")) == (most, None, "")
    with pytest.raises(Exception, match="not a node id: a-b"):
        strict("a-b")
