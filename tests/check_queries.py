"""Run registered queries beside their SQL: python -m tests.check_queries <sf_dir> [name ...]."""

import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

from emberlog.plans.oracles import ORACLES
from emberlog.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(r[i] for i in order) for r in rows), key=lambda r: tuple(map(repr, r))
    )


def compare(spark, con, sf_dir, name):
    """(spark rows, problem or None, spark seconds, sql seconds)."""
    t = time.time()
    frame = QUERIES[name](spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    spent = time.time() - t
    if name not in ORACLES:
        return len(got[1]), None, spent, 0.0
    t = time.time()
    relation = con.sql(ORACLES[name])
    want = rows_of(relation.columns, relation.fetchall())
    sql_spent = time.time() - t
    problem = None
    if got[0] != want[0]:
        problem = f"columns {got[0]} != {want[0]}"
    elif got[1] != want[1]:
        pairs = [(g, w) for g, w in zip(got[1], want[1]) if g != w][:1]
        problem = f"{len(got[1])} vs {len(want[1])} rows; {got[0]} first difference {pairs}"
    return len(got[1]), problem, spent, sql_spent


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="emberlog-check-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    bad = 0
    for name in names:
        try:
            n, problem, spent, sql_spent = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            n, problem, spent, sql_spent = -1, f"{type(e).__name__}: {str(e)[:1500]}", 0, 0
        bad += problem is not None
        print(f"{name:28} {n:7} {spent:6.2f}s sql {sql_spent:6.2f}s {problem or 'ok'}", flush=True)
    print("all equal" if not bad else f"{bad} differ")


if __name__ == "__main__":
    main()
