"""Run queries in Spark and their SQL in DuckDB; compare rows regardless of order.

    python -m verification.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import tempfile
import time
from collections import Counter
from datetime import date, datetime
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from bazaar.session import RECOMMENDED
from verification import oracle, queries


def session(cpus: str = "8", memory: str = "16g", shared: str | None = None) -> SparkSession:
    """A local session; ``shared`` is its folder for intermediates, a new one if not named."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bazaar")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", shared or tempfile.mkdtemp(prefix="bazaar-shared-"))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (datetime, date)):
        return value.isoformat()[:10]
    return value


def _bag(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between the two results, or nothing."""
    result = con.sql(sql)
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} != {sorted(result.columns)}"
    ours, theirs = _bag(df.columns, df.collect()), _bag(result.columns, result.fetchall())
    if ours == theirs:
        return None
    extra, missing = list((ours - theirs).items()), list((theirs - ours).items())
    return (
        f"{sum(ours.values())} rows != {sum(theirs.values())} rows, "
        f"{len(extra)} only here {sorted(extra, key=str)[:3]}, "
        f"{len(missing)} only there {sorted(missing, key=str)[:3]}"
    )


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args(argv)
    spark, con = session(), database(args.sf)
    known, sql = queries.build(), oracle.build()
    failed = 0
    for name in args.names or known:
        start = time.time()
        try:
            df = known[name](spark, args.sf)
            if name in sql:
                problem = difference(df, con, sql[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as e:  # one broken query should not hide the others
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        failed += problem is not None
        kind = "sql" if name in sql else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} ({kind}, {time.time() - start:.2f}s) {problem or ''}",
              flush=True)
    print(f"{len(args.names or known)} queries, {failed} failed; without a query: {sorted(set(sql) - set(known))}")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
