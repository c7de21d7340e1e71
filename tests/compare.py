"""Runs queries beside their SQL: python -m tests.compare SF_DIR [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    conf = {"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        if (p := Path(sf_dir, f"{t}.parquet")).exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    done = con.execute(sql)
    columns = [d[0] for d in done.description]
    return sorted(columns), rows_of(columns, done.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


if __name__ == "__main__":
    import __spark_entry__ as e

    spark, (sf_dir, *names) = session(), sys.argv[1:]
    for name, sql in e.oracle_sql().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            got, want = spark_rows(e.queries()[name](spark, sf_dir)), sql_rows(sf_dir, sql)
            same = got == want
            print("same" if same else "DIFFERENT", name, len(got[1]), len(want[1]), f"{time.time() - began:.1f} s", flush=True)
            if not same:
                print("  ", got[0], want[0])
                print("  ", [r for r in got[1] if r not in want[1]][:2], "\n  ", [r for r in want[1] if r not in got[1]][:2])
        except Exception as ex:
            print("FAILED", name, str(ex)[:600], flush=True)
