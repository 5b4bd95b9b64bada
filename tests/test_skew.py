"""The bucketed helpers give what a plain window or a brute-force loop gives, hot keys included."""

import random
import statistics

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from assetlens.functions.skew import exact_median, islands, lag_across, running_sum, with_halo
from assetlens.operators.graph import components


def series(spark, seed, n=600):
    """One key holds a third of the rows."""
    rng = random.Random(seed)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(20)}", rng.randrange(0, 5000), i, rng.randrange(100)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, i long, v long").repartition(7), rows


def test_lag_across_equals_window(spark):
    df, _ = series(spark, 1)
    w = Window.partitionBy("k").orderBy("t", "i")
    want = {(r.k, r.i): r.p for r in df.withColumn("p", F.lag("v").over(w)).collect()}
    for width in (10, 500, 10_000):
        got = {(r.k, r.i): r.p for r in lag_across(df, ["k"], ["t", "i"], "t", width, {"p": "v"}).collect()}
        assert got == want


def test_running_sum_equals_window(spark):
    df, _ = series(spark, 2)
    w = Window.partitionBy("k").orderBy("t", "i")
    want = {(r.k, r.i): r.s for r in df.withColumn("s", F.sum("v").over(w)).collect()}
    assert {(r.k, r.i): r.s for r in running_sum(df, ["k"], ["t", "i"], "t", 300, {"s": F.col("v")}).collect()} == want


def test_halo_frame_equals_window(spark):
    df, _ = series(spark, 3)
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-40, 25)
    want = {(r.k, r.i): r.n for r in df.withColumn("n", F.count("*").over(w)).collect()}
    h = with_halo(df, "t", 200, 40, 25)
    wb = Window.partitionBy("k", "_b").orderBy("t").rangeBetween(-40, 25)
    assert {(r.k, r.i): r.n for r in h.withColumn("n", F.count("*").over(wb)).where("_core").collect()} == want


def test_exact_median(spark):
    df, rows = series(spark, 4)
    by = {}
    for k, _, _, v in rows:
        by.setdefault(k, []).append(v)
    got = {r.k: r.m for r in exact_median(df, ["k"], "v", "m").collect()}
    assert got == {k: statistics.median(v) for k, v in by.items()}
    up = {r.k: r.m for r in exact_median(df, ["k"], "v", "m", upper=True).collect()}
    assert up == {k: float(sorted(v)[len(v) // 2]) for k, v in by.items()}


def test_islands_keep_close_rows_together(spark):
    df, rows = series(spark, 5, 200)
    got = {r.i: (r.k, r.island) for r in islands(df, ["k"], "t", 10).collect()}
    for k, t, i, _ in rows:
        for k2, t2, i2, _ in rows:
            if k == k2 and abs(t - t2) <= 10:
                assert got[i] == got[i2]


def test_components_with_a_hub_and_a_long_chain(spark):
    rng = random.Random(6)
    pairs = [("hub", f"x{i:03d}") for i in range(60)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)] + [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}


def test_spread_lookup_splits_a_hot_key(spark):
    """A key with most rows is split; every row finds its one match, and no share is much above the bound."""
    from pyspark.sql import functions as F

    from assetlens.functions.skew import spread_lookup

    rows = spark.range(6000).select(F.when(F.col("id") < 5000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", 2) for i in range(40)], "k string, v int")
    out = spread_lookup(rows, "k", table, "id", 250)
    assert out.groupBy("v").count().orderBy("v").collect() == [(1, 5000), (2, 800)]
    shares = out.where("k = 'hot'").groupBy(F.pmod(F.xxhash64("id"), F.lit(20))).count().collect()
    assert len(shares) == 20 and max(r["count"] for r in shares) < 500


def test_components_of_a_star_and_a_long_chain(spark):
    """One component with most nodes, split lookups, and more rounds than any fixed limit would allow by neighbours alone."""
    star = [("a0", f"s{i:04d}") for i in range(1500)]
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(star + chain, "a string, b string"), most=100).collect()}
    assert {v for k, v in got.items() if k[0] in "as"} == {"a0"} and {v for k, v in got.items() if k[0] == "c"} == {"c0000"} and len(got) == 1802


@pytest.mark.parametrize("upper", [True, False])
def test_global_median_narrows_to_few_rows(spark, upper):
    """Wide, dense and repeated values of one global key; ranges are narrowed until few values are left."""
    from assetlens.functions.skew import global_median

    rng = random.Random(7)
    for n in (1, 2, 501):
        values = [rng.choice([rng.random() * 1e-6 + 5, rng.uniform(-1e308, 1e308), float(rng.randrange(5))]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
        want = statistics.median_high(values) if upper else statistics.median(values)
        assert global_median(df, "x", upper, most=8, accuracy=50) == want
    assert global_median(spark.createDataFrame([(None,)], "x double"), "x") is None
