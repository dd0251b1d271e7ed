"""Run registered queries beside their SQL and compare values: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark-check")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", "/tmp/tidemark-checkpoints")
    return spark


def database(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return f"{type(v).__name__}:{v}"


def compare(spark, con, query, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in names]) for r in df.collect())
    if sql is None:
        return True, f"{len(got)} rows (no SQL)"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(cols) != names:
        return False, f"columns {names} != {sorted(cols)}"
    order = [cols.index(c) for c in names]
    want = sorted(repr([_plain(r[i]) for i in order]) for r in want_rows)
    if got == want:
        return True, f"{len(got)} rows"
    only_got = sorted(set(got) - set(want))[:2]
    only_want = sorted(set(want) - set(got))[:2]
    return False, f"{len(got)} vs {len(want)} rows\n   {names}\n   spark {only_got}\n   sql   {only_want}"


def main() -> int:
    from tidemark.plans import catalog

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), database(sf_dir)
    queries, oracles = catalog.queries(), catalog.oracles()
    picked = sys.argv[2:] or list(queries)
    failed = 0
    for name in queries:
        if not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in picked):
            continue
        begun = time.time()
        try:
            good, note = compare(spark, con, queries[name], oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            good, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += not good
        print(f"CHK {'ok  ' if good else 'FAIL'} {name} {time.time() - begun:.1f}s {note}", flush=True)
    print("CHK failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
