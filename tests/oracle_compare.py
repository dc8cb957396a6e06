"""Run registered queries next to their DuckDB texts and compare all rows."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def compare(spark, con, name, query, sql, sf_dir):
    """Return None when equal, else a short description of the difference."""
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if ours == theirs:
        return None
    extra, missing = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} rows vs {sum(theirs.values())}; {columns}\n"
        f"  only spark:  {list(extra)[:3]}\n  only duckdb: {list(missing)[:3]}"
    )


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from claimgrid.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = oracle_sql()
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        if name in sqls:
            verdict = compare(spark, con, name, query, sqls[name], sf_dir) or "ok"
        else:
            verdict = f"rows only: {query(spark, sf_dir).count()}"
        print(f"{name:28s} {time.time() - start:6.2f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
