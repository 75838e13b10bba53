"""Run registered queries in Spark and their SQL in DuckDB, and compare rows.

Usage: python tests/compare.py SF_DIR [NAME ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from registry import ORACLE, QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, otherwise a description of the first difference."""
    got, want = normal(got), normal(want)
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} against {list(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for name in got.columns:
        if str(want[name].dtype) == "Int64" and str(got[name].dtype) in ("int64", "float64"):
            # Spark hands over a nullable integer column as floating point.
            got[name] = got[name].astype("Int64")
        if str(got[name].dtype) != str(want[name].dtype):
            return f"type of {name}: {got[name].dtype} against {want[name].dtype}"
        unequal = ~((got[name] == want[name]).fillna(False) | (got[name].isna() & want[name].isna()))
        if unequal.any():
            i = unequal.idxmax()
            return f"{unequal.sum()} values of {name}, first {got.loc[i].to_dict()} against {want.loc[i].to_dict()}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    spark, con, failed = session(), connect(sf_dir), 0
    for name in names or list(QUERIES):
        start, done = time.time(), None
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            done = time.time()
            problem, note = None, f"{len(got)} rows, no SQL"
            if name in ORACLE:
                problem = differences(got, con.execute(ORACLE[name]).df())
                note = f"{len(got)} rows, equal" if problem is None else f"DIFFERENT: {problem}"
        except Exception as error:  # noqa: BLE001
            problem, note = error, f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        end = time.time()
        done = done or end
        print(f"{name:32s} spark {done - start:6.1f}s  sql {end - done:6.1f}s  {note}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
