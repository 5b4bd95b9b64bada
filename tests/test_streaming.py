"""Streams over several files, in several micro-batches and with late rows, equal their batch twins."""

import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from assetlens.operators import folds, monitor, tables
from assetlens.sources.tables import Tables
from assetlens.streaming import jobs

DAY = 86_400_000


@pytest.fixture(scope="module")
def parts(spark):
    """Readings in three files; one in seven comes a file late. A last file's one reading lets the watermark pass all others."""
    v = Tables(spark, "/root/testdata/sf0.001").verdicts().withColumns({"volume24h": F.col("price") * 10, "state": F.when(F.col("seq") % 4 > 1, "open")})
    root = tempfile.mkdtemp(prefix="assetlens-parts-")
    cut = [r[0] for r in v.selectExpr("percentile_approx(observed_at, array(0.3, 0.6))").collect()][0]
    part = F.when(F.col("observed_at") < cut[0], 0).when(F.col("observed_at") < cut[1], 1).otherwise(2)
    dealt = v.withColumn("part", F.least(part + (F.col("seq") % 7 == 0).cast("int"), F.lit(2)))
    for i in range(3):
        dealt.where(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{root}/part{i}")
    tick = v.limit(1).withColumns({"asset": F.lit("tick"), "observed_at": F.col("observed_at") + 400 * DAY})
    tick.coalesce(1).write.parquet(f"{root}/part3")
    return v, root


def in_batches(spark, v, root, job):
    """Feed the parts one file per micro-batch; a late row may be a month late."""
    s = jobs.read_stream(spark, root, v.schema, files=1)
    return jobs.run_to_table(job(s, late="40 days"), f"t-{uuid.uuid4().hex[:6]}").where("asset <> 'tick'")


def rows(df, *cols):
    return sorted(tuple(str(x) for x in r) for r in df.select(*cols).collect())


def test_stability(spark, parts):
    got = in_batches(spark, *parts, jobs.stabilize)
    assert rows(got, "asset", "seq", "stable") == rows(folds.stabilize(parts[0]), "asset", "seq", "stable")


def test_thinning(spark, parts):
    got = in_batches(spark, *parts, jobs.thin)
    assert rows(got, "asset", "seq", "reason") == rows(folds.thin_snapshots(parts[0]), "asset", "seq", "reason")


def test_thinning_sees_changes_of_state_and_one_reading_an_instant(spark):
    rows_ = [("a", DAY + t, n, "WATCH", s, 1.0, 0.5, p, 1.0, 1.0) for t, n, s, p in [(0, 0, None, 1.0), (1000, 1, "open", 1.0), (1000, 2, None, 5.0), (2000, 3, "open", 1.01), (3000, 4, None, 1.0), (4000, 5, None, None)]]
    v = spark.createDataFrame([*rows_, ("tick", 10 * DAY, 9, "WATCH", None, 1.0, 0.5, 1.0, 1.0, 1.0)], "asset string, observed_at long, seq long, verdict string, state string, score double, coverage double, price double, liquidity double, volume24h double")
    root = tempfile.mkdtemp(prefix="assetlens-state-")
    v.where("asset = 'a'").orderBy(F.desc("seq")).coalesce(1).write.parquet(f"{root}/part0")
    v.where("asset = 'tick'").coalesce(1).write.parquet(f"{root}/part1")
    got = jobs.run_to_table(jobs.thin(jobs.read_stream(spark, root, v.schema, files=1), late="1 hour"), "state")
    assert rows(got.where("asset = 'a'"), "seq", "reason") == [("0", "first"), ("1", "transition"), ("4", "transition")]
    assert rows(folds.thin_snapshots(v.where("asset = 'a'")), "seq", "reason") == [("0", "first"), ("1", "transition"), ("4", "transition")]


def test_alerts(spark, parts):
    got = in_batches(spark, *parts, jobs.alerts)
    assert rows(got, "asset", "seq", "alert", "level", "code") == rows(monitor.alerts(parts[0].drop("state")), "asset", "seq", "alert", "level", "code")


def test_state_calls_follow_buckets_not_assets(spark, monkeypatch):
    """Forty assets in two buckets over three files take a call for each bucket and file, and one for each timer."""
    calls = tempfile.mkdtemp(prefix="assetlens-calls-")

    class Counted(jobs.InOrder):
        def handleInputRows(self, key, rows, timerValues):
            open(f"{calls}/in-{uuid.uuid4().hex}", "w").close()
            return super().handleInputRows(key, rows, timerValues)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            open(f"{calls}/timer-{uuid.uuid4().hex}", "w").close()
            yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    monkeypatch.setattr(jobs, "InOrder", Counted)
    monkeypatch.setattr(jobs.in_order, "__defaults__", ("24 hours", 2))
    v = spark.range(240).selectExpr("if(id % 41 = 40, null, concat('a', id % 41)) AS asset", f"{DAY} + id div 80 * {3 * DAY} + id AS observed_at", "id AS seq", "element_at(array('WATCH', 'REJECTED', 'QUALIFIED'), int(id * 7 % 3) + 1) AS verdict")
    root = tempfile.mkdtemp(prefix="assetlens-buckets-")
    for k in range(3):
        v.where(f"seq div 80 = {k}").coalesce(1).write.parquet(f"{root}/part{k}")
    v.limit(1).selectExpr("'tick' AS asset", f"{30 * DAY} AS observed_at", "seq", "verdict").coalesce(1).write.parquet(f"{root}/part3")
    got = jobs.run_to_table(jobs.stabilize(jobs.read_stream(spark, root, v.schema, files=1)), "buckets").where("asset IS NULL OR asset <> 'tick'")
    named = "asset IS NOT NULL"
    assert got.count() == 240 and rows(got.where(named), "asset", "seq", "stable") == rows(folds.stabilize(v).where(named), "asset", "seq", "stable")
    made = os.listdir(calls)
    assert sum(c.startswith("in-") for c in made) <= 7 and sum(c.startswith("timer-") for c in made) <= 7


def test_append_once_survives_a_replay(spark, parts):
    v, _ = parts
    path = tempfile.mkdtemp(prefix="assetlens-sink-") + "/table"
    write = jobs.append_once(path, ["asset", "seq"])
    half = v.where("seq % 2 = 0")
    write(half, 0)
    write(half, 0)
    write(v, 1)
    write(v, 1)
    assert spark.read.parquet(path).count() == v.count()


def test_append_reads_only_the_days_of_its_batch(spark, parts):
    """What a batch reads of the stored table does not grow with the days that lie there."""
    v, _ = parts
    path = tempfile.mkdtemp(prefix="assetlens-pruned-") + "/table"
    write = jobs.append_once(path, ["asset", "seq"], "observed_at", 4)
    for k in range(3):
        write(v.withColumn("observed_at", F.col("observed_at") + k * 100 * DAY), k)
    write(v, 3)
    assert spark.read.parquet(path).count() == 3 * v.count()
    day = int(v.agg(F.min(F.floor(F.col("observed_at") / DAY))).first()[0])
    stored = jobs.stored_in(spark.read.parquet(path), ["day", "bucket"], [(day, b) for b in range(4)])
    assert {f.split("day=")[1].split("/")[0] for f in stored.inputFiles()} and stored.select("day").distinct().collect() == [(day,)]
    scan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "PartitionFilters: []" not in scan


def test_registry_parts(spark):
    """Late rows repair the first sighting; a replayed batch counts once."""
    path = tempfile.mkdtemp(prefix="assetlens-registry-") + "/table"
    write = jobs.registry_parts(path, 4)
    v = spark.createDataFrame([(f"w{i % 7}", (i * 37) % 100) for i in range(60)], "wallet string, block_time long")
    write(v.where("block_time >= 50"), 0)
    write(v.where("block_time < 50"), 1)
    write(v.where("block_time < 50"), 1)
    got = jobs.registry(spark.read.parquet(path))
    want = tables.wallet_registry(v.withColumn("tx_id", F.lit("t"))).join(v.groupBy("wallet").agg(F.count("*").alias("sightings")), "wallet")
    cols = ["wallet", "first_observed_at", "last_observed_at", "sightings"]
    assert rows(got, *cols) == rows(want, *cols)
