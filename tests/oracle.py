"""Runs a registered query and its DuckDB SQL and compares rows as sorted text."""

import math
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return int(value) if value == int(value) else round(value, 7)
    return int(value) if isinstance(value, int) else str(value)


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted(str([plain(v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False, name=None))


def check(spark, name, sf_dir=SF):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        if file.endswith(".parquet"):
            con.execute(f"create view {file[:-8]} as select * from '{sf_dir}/{file}'")
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
