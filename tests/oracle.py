"""Compares registered queries with their SQL on DuckDB: python -m tests.oracle [sf_dir] [name ...]."""

from __future__ import annotations

import glob
import math
import os
import sys

import duckdb
from pyspark.sql import SparkSession


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return f"{float(v):.9g}"
    return str(v)


def compare(spark: SparkSession, sf_dir: str, name: str, run, sql: str) -> str:
    """An empty text, or what differs."""
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    want = con.execute(sql)
    names = [x[0] for x in want.description]
    if sorted(names) != cols:
        return f"{name}: columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted([tuple(_plain(r[i]) for i in at) for r in want.fetchall()], key=str)
    ours = sorted([tuple(_plain(r[c]) for c in cols) for r in df.collect()], key=str)
    if ours == theirs:
        return ""
    odd = next(((a, b) for a, b in zip(ours, theirs) if a != b), ("", ""))
    return f"{name}: {len(ours)} and {len(theirs)} rows; {odd[0]} but {odd[1]}"


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    spark, bad = session(), 0
    sql = entry.oracle_sql()
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        try:
            said = compare(spark, sf_dir, name, run, sql[name]) if name in sql else f"{name}: {run(spark, sf_dir).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"{name}: {type(e).__name__} {str(e)[:600]}"
        bad += bool(said) and "no SQL" not in said
        print(said or f"{name}: equal", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) and 1)
