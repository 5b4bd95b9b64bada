"""Nearest observations, outcome labels and escapes against loops, and plans that pair nothing."""

import random

import pytest

from assetlens.operators import calibrate as C

HOUR = 3_600_000


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    t = lambda: r.randrange(0, 6 * 24 * HOUR, 100_000)
    asset = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    points = [(asset(), t(), i, r.choice(["WATCH", "QUALIFIED", "REJECTED"])) for i in range(300)]
    points += points[:20] + [("hot", t(), None, "WATCH")]
    obs = [(asset(), t(), r.choice([None, 900.0, 1500.0, 9000.0]), r.choice([None, "P0", "P1"])) for _ in range(900)]
    events = [(asset(), t(), r.choice(["LIQUIDITY_DRAIN", "FREEZE_ABUSE"])) for _ in range(30)]
    return points, obs, events


@pytest.fixture(scope="module")
def frames(spark, rows):
    p, o, e = rows
    return (spark.createDataFrame(p, "asset string, observed_at long, seq long, verdict string"),
            spark.createDataFrame(o, "asset string, observed_at long, liquidity double, pool string"),
            spark.createDataFrame(e, "asset string, at long, type string"))


def near(p, obs, tol):
    if p[0] is None or p[2] is None:
        return None
    o = [x for x in obs if x[0] == p[0] and abs(x[1] - p[1]) <= tol]
    return min(o, key=lambda x: (abs(x[1] - p[1]), x[1], x[3] or "", x[2] is not None, x[2] or 0), default=None)


def expected(p, obs, events, h):
    n = near(p, obs, C.NEAR_MS)
    liq, pool = (n[2], n[3]) if n else (None, None)
    mine = p[0] if p[2] is not None else None
    inside = lambda t: p[1] < t <= p[1] + h
    ev = min(((t, k) for a, t, k in events if a is not None and a == mine and inside(t)), default=None)
    seen = [(x[2], x[1]) for x in obs if x[0] is not None and x[0] == mine and x[2] is not None and inside(x[1]) and (pool is None or x[3] == pool)]
    low, last = min((s[0] for s in seen), default=None), max((s[1] for s in seen), default=None)
    if ev:
        return "CONFIRMED_DRAIN" if ev[1] == "LIQUIDITY_DRAIN" else "CONFIRMED_ABUSE"
    if liq is None or liq < 1000 or last is None:
        return "NOT_OBSERVED"
    if low <= liq * 0.2:
        return "LIQUIDITY_COLLAPSE"
    if last - p[1] >= h * 0.9:
        return "SUSTAINED_LIQUIDITY" if low / liq >= 0.5 else "LIQUIDITY_DECLINED"
    return "SURVIVED_PART_OF_WINDOW" if last - p[1] >= h * 0.5 else "NOT_OBSERVED"


def test_outcomes_match_loops(rows, frames):
    points, obs, events = rows
    p, o, e = frames
    n = C.nearest_observation(p, o)
    got = sorted(map(repr, (tuple(r) for r in n.collect())))
    want = [(*x, *((y[1], y[2], y[3]) if (y := near(x, obs, C.NEAR_MS)) else (None, None, None))) for x in points]
    assert got == sorted(map(repr, want))
    for h in (6 * HOUR, 24 * HOUR):
        labelled = C.label_outcomes(n, o, e, h).select("asset", "observed_at", "seq", "label")
        assert sorted(map(repr, map(tuple, labelled.collect()))) == sorted(map(repr, ((*x[:3], expected(x, obs, events, h)) for x in points)))


def test_escapes_match_loop(rows, frames):
    points, obs, events = rows
    p, o, e = frames
    got = C.escapes(C.label_outcomes(C.nearest_observation(p, o), o, e, 24 * HOUR), p, width=24 * HOUR)
    want = []
    for x in points:
        label = expected(x, obs, events, 24 * HOUR)
        if x[3] != "REJECTED" and label in C.BAD:
            at = min((y[1] for y in points if y[0] == x[0] and y[3] == "REJECTED" and y[1] > x[1]), default=None)
            want.append((*x[:3], x[3], label, at, None if at is None else at - x[1]))
    assert want and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_points_are_neither_paired_nor_copied_to_slices(frames):
    p, o, e = frames
    near_plan = C.nearest_observation(p, o)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in near_plan
    points = p.selectExpr("*", "1.0D AS obs_liquidity", "'P0' AS obs_pool")
    plan = C.label_outcomes(points, o, e, 24 * HOUR)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_transactions_meet_their_watch_without_a_broadcast(spark):
    from assetlens.operators import trades as T

    tokens = "array<struct<account:string,owner:string,asset:string,decimals:int,pre:decimal(20,0),post:decimal(20,0)>>"
    norm = spark.createDataFrame([("t1", "SUCCESS", "W", 1, 1000, [], [])], f"tx_id string, status string, fee_payer string, slot long, block_time long, tokens {tokens}, native array<struct<address:string,delta:decimal(38,0)>>")
    watch = spark.createDataFrame([("t1", "A", "P")], "tx_id string, asset string, pool string")
    off = spark.createDataFrame([("P", False)], "address string, is_wallet boolean")
    d = T.pool_side(norm, watch, off)
    assert d.select("movers", "pool_side").first()[:] == (0, None)
    assert "SortMergeJoin [tx_id" in d._jdf.queryExecution().sparkPlan().toString()
