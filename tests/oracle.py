"""Compare registered queries with their DuckDB statements: rows, column names and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, query, sql, sf_dir) -> str:
    """Empty if both are equal."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want = rows([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}; only here {[r for r in got[1] if r not in want[1]][:2]}, only there {[r for r in want[1] if r not in got[1]][:2]}" if len(got[1]) < 5000 else f"{len(got[1])} rows against {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1], strict=True) if repr(g) != repr(w)]
    return f"{got[0]}: {len(bad)} of {len(got[1])} differ, as {bad[0]}" if bad else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from terravane.plans import registry

    sf = sys.argv[1]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name, (query, sql) in registry.ALL.items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        t = time.time()
        try:
            said = compare(spark, con, query, sql, sf) if sql else f"no SQL, {query(spark, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__} {str(e)[:600]}"
        print(f"{name} {time.time() - t:.1f}s {said or 'ok'}", flush=True)
