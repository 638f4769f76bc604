"""Run registered queries against their SQL twins: python tests/oracle_check.py [sf_dir] [name ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else round(v, 6)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6) if v != int(v) else int(v)
    return v


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def compare(spark, con, name, query, sql, sf):
    t0 = time.time()
    df = query(spark, sf)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return f"rows-only {len(rows)}", took, bool(rows)
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    got = [dict(zip(names, r)) for r in cur.fetchall()]
    duck_s = time.time() - t1
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS differ {sorted(df.columns)} vs {sorted(names)}", took, False
    other = [tuple(plain(r[c]) for c in sorted(names)) for r in got]
    key = lambda r: tuple(str(x) for x in r)
    a, b = sorted(rows, key=key), sorted(other, key=key)
    if a == b:
        return f"ok {len(a)} (duck {duck_s:.1f}s)", took, bool(a)
    sa, sb = set(map(key, a)), set(map(key, b))
    only_a, only_b = sorted(sa - sb)[:2], sorted(sb - sa)[:2]
    cols = sorted(df.columns)
    return (
        f"DIFF {len(a)} vs {len(b)}; {len(sa - sb)} / {len(sb - sa)} differ\n   cols  {cols}\n"
        + "\n".join(f"   spark {r}" for r in only_a) + "\n" + "\n".join(f"   duck  {r}" for r in only_b)
    ), took, False


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not args or any(a in n for a in args)]
    bad = []
    for name in chosen:
        try:
            text, took, good = compare(spark, con, name, queries[name], oracles.get(name), sf)
        except Exception as e:  # noqa: BLE001
            text, took, good = f"ERROR {type(e).__name__}: {str(e)[:1500]}", 0.0, False
        if not good:
            bad.append(name)
        print(f"{name:34s} {took:6.1f}s  {text}", flush=True)
    print(f"{len(chosen) - len(bad)}/{len(chosen)} good; bad: {bad}")


if __name__ == "__main__":
    main()
