"""Runs registered queries against their SQL statements and reports differences."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def spark_session() -> SparkSession:
    return (SparkSession.builder.master("local[8]").appName("compare")
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        else:
            df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else (
                repr(float(v)) if isinstance(v, float) else str(v)))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when equal, else a short account of the first differences."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(set(left.columns) ^ set(right.columns))}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    a, b = canonical(left), canonical(right)
    for c in a.columns:
        bad = a[c] != b[c]
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} of {len(a)} rows differ in {c}: {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None


def main(pattern: str, sf_dir: str = "/root/testdata/sf0.01") -> int:
    import re

    import __spark_entry__ as entry
    spark, con = spark_session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, failures = entry.queries(), entry.oracle_sql(), 0
    for name, fn in queries.items():
        if not re.search(pattern, name):
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            t1 = time.time()
            if name in oracles:
                want = con.execute(oracles[name]).df()
                note = difference(got, want)
            else:
                note, want = None, got
            ok = "ok  " if note is None else "FAIL"
            failures += note is not None
            print(f"{ok} {name:44s} rows={len(got):6d} {t1 - t0:5.1f}s {time.time() - t1:5.1f}s"
                  f"{'' if name in oracles else ' (no oracle)'} {note or ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            failures += 1
            print(f"ERR  {name:44s} {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else ".", *sys.argv[2:3]) > 0)
