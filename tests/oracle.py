"""Compare registered queries with their SQL in DuckDB: columns, types, row count and values.

    python tests/oracle.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v + 0.0:.6f}" if abs(v) < 1e15 else f"{v:.9e}"
    return str(v)


def kind(name: str) -> str:
    n = name.lower()
    if any(x in n for x in ("bigint", "int", "long", "huge")) and "point" not in n:
        return "int"
    for k in ("double", "float", "decimal", "bool", "timestamp", "date"):
        if k in n:
            return "double" if k == "float" else k
    return "str"


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else a short reason."""
    from assetlens.plans.registry import QUERIES, run

    q = QUERIES[name]
    df = run(name, spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(norm(v) for v in r) for r in df.select(*cols).collect()]
    if q.sql is None:
        return None if got else "no rows"
    cur = con.execute(q.sql)
    have = {d[0]: str(d[1]) for d in cur.description}
    if sorted(have) != cols:
        return f"columns {cols} vs {sorted(have)}"
    types = dict(df.dtypes)
    bad = [c for c in cols if kind(types[c]) != kind(have[c])]
    if bad:
        return "types " + ", ".join(f"{c}: {types[c]} vs {have[c]}" for c in bad)
    names = [d[0] for d in cur.description]
    idx = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in idx) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    g, w = sorted(got), sorted(want)
    if g != w:
        diff = [(a, b) for a, b in zip(g, w) if a != b]
        return f"{len(diff)} differing of {len(g)}; {cols}: {diff[0]}"
    return None if got else "EMPTY but equal"


def main(argv):
    from pyspark.sql import SparkSession

    import assetlens.plans.catalog  # noqa: F401
    from assetlens.plans.registry import QUERIES

    sf_dir = argv[0]
    names = argv[1:] or list(QUERIES)
    if names and names[0].startswith("@"):
        names = [n for n in QUERIES if QUERIES[n].build.__module__.endswith(names[0][1:])]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for n in names:
        t = time.time()
        try:
            why = compare(spark, con, sf_dir, n)
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:420]}"
        bad += why is not None
        print(f"{'ok ' if why is None else 'BAD'} {n} {time.time() - t:.1f}s {why or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
