"""Compare registered queries with their SQL.

Run as a script: ``python tests/compare.py [sf folder] [query ...]``.
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return as_rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(db, sql):
    cursor = db.execute(sql)
    return as_rows([d[0] for d in cursor.description], cursor.fetchall())


def main() -> int:
    from pyspark.sql import SparkSession

    from workload.oracles import ORACLES
    from workload.queries import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, bad = database(sf_dir), 0
    for name in wanted:
        start = time.time()
        try:
            got = spark_rows(QUERIES[name](spark, sf_dir))
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:1500]}")
            bad += 1
            continue
        spent = time.time() - start
        if name not in ORACLES:
            print(f"rows {name}: {len(got[1])} rows, {spent:.1f}s, no SQL")
            continue
        want = sql_rows(db, ORACLES[name])
        same = got == want
        bad += not same
        print(f"{'ok  ' if same else 'DIFF'} {name}: {len(got[1])} rows, {spent:.1f}s", flush=True)
        if not same:
            print("   spark", got[0], len(got[1]), [r for r in got[1] if r not in want[1][:5000]][:3])
            print("   sql  ", want[0], len(want[1]), [r for r in want[1] if r not in got[1][:5000]][:3])
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
