"""Filters, placement and selection: which assets, pools and wallets are worked on or shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.functions.scalar import HOUR_MS, half_up, known, ladder, lookup

# Windows, tiers, survivor order and analysis priorities.
LIVE_MS, FRESH_MS = 90 * 60_000, 30 * 60_000
VERDICT_TIER = {"HIGH_POTENTIAL": 0, "QUALIFIED": 1, "WATCH": 2, "INSUFFICIENT_DATA": 3, "HIGH_RISK": 4, "REJECTED": 5}
CANDIDATES = ["HIGH_POTENTIAL", "QUALIFIED", "WATCH"]
SURVIVOR_ORDER = {"HIGH_POTENTIAL": 0, "QUALIFIED": 1, "WATCH": 2, "HIGH_RISK": 3}
TIER_PRIORITY = {"HIGH_POTENTIAL": 40, "QUALIFIED": 30, "WATCH": 15, "HIGH_RISK": 12}


def tier(c: str | Column) -> Column:
    return lookup(c, VERDICT_TIER, 9)


def viable_candidates(df: DataFrame, k: int, floor: float = 3_000, max_age_h: float = 720) -> DataFrame:
    """Liquidity known and at least the floor, age within the limit or unknown; top k by liquidity."""
    ok = (F.col("liquidity") >= floor) & (F.col("age_hours").isNull() | (F.col("age_hours") <= max_age_h))
    return df.where(ok).orderBy(F.desc("liquidity"), "asset").limit(k)


def place(df: DataFrame, now: int, window_ms: int = LIVE_MS) -> DataFrame:
    """Add universe (LIVE / STALE / UNEVALUATED), freshness and age."""
    age = F.greatest(F.lit(0), F.lit(now) - F.col("at"))
    evaluated = F.col("verdict").isin(*VERDICT_TIER)
    universe = ladder("LIVE", (~known(evaluated), "UNEVALUATED"), (F.col("at").isNull() | (age > window_ms), "STALE"))
    return df.withColumns({"universe": universe, "age_ms": age}).withColumn(
        "freshness", F.when(F.col("universe") == "LIVE", F.when(F.col("age_ms") <= FRESH_MS, "FRESH").otherwise("AGING")))


def count_universe(placed: DataFrame) -> DataFrame:
    """One row: live, stale, unevaluated, total and live counts per verdict."""
    live = F.col("universe") == "LIVE"
    return placed.agg(
        F.count_if(live).alias("live"), F.count_if(F.col("universe") == "STALE").alias("stale"),
        F.count_if(F.col("universe") == "UNEVALUATED").alias("unevaluated"), F.count("*").alias("total"),
        *[F.count_if(live & (F.col("verdict") == v)).alias(v.lower()) for v in VERDICT_TIER])


def is_live() -> Column:
    return F.col("universe") == "LIVE"


def is_survivor() -> Column:
    return known(F.col("verdict").isin(*SURVIVOR_ORDER))


def is_candidate() -> Column:
    return known(F.col("verdict").isin(*CANDIDATES))


def best_pool(pairs: DataFrame) -> DataFrame:
    """Deepest pool per asset; unknown depth ranks lowest and the first listed wins ties."""
    order = F.struct(F.coalesce("liquidity", F.lit(-1.0)), -F.col("position"))
    return pairs.groupBy("asset").agg(F.max_by(F.struct("pool", "liquidity"), order).alias("b")).select("asset", "b.*")


def pool_refs(pairs: DataFrame) -> DataFrame:
    """All pools of an asset by 24 h volume, ranked from 1.

    Ranked by counts: steps of volume are counted for each asset, volumes inside a step, and pools of
    one volume are put in order by name, so an asset's pools are never one sort.
    """
    volume = F.coalesce("volume24h", F.lit(-1.0))
    p = pairs.withColumn("_v", volume)
    level = p.groupBy("asset", "_v").agg(F.count("*").alias("_n")).withColumn("_c", F.floor(F.log2(F.greatest("_v", F.lit(0.0)) + 1) * 8))
    coarse = level.groupBy("asset", "_c").agg(F.sum("_n").alias("_n"))
    above = Window.partitionBy("asset").orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select("asset", "_c", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("asset", "_c").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)
    level = level.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(coarse, ["asset", "_c"])
    level = level.select("asset", "_v", (F.col("_base") + F.col("_in")).alias("_before"))
    tie = F.row_number().over(Window.partitionBy("asset", "_v").orderBy("pool"))
    return p.withColumn("_t", tie).join(level, ["asset", "_v"]).withColumn("rank", F.col("_before") + F.col("_t")).drop("_v", "_t", "_before")


def select_pools(pairs: DataFrame, n: int, min_share: float = 0.2) -> DataFrame:
    """The primary pool first, then others with enough of the asset's volume, ``n`` at most."""
    total = pairs.groupBy("asset").agg(F.sum(F.coalesce("volume24h", F.lit(0.0))).alias("_t"))
    j = pairs.join(total, "asset")
    enough = F.col("is_primary") | ((F.col("_t") > 0) & (F.coalesce("volume24h", F.lit(0.0)) / F.col("_t") >= min_share))
    order = Window.partitionBy("asset").orderBy(F.desc("is_primary"), F.desc(F.coalesce("volume24h", F.lit(0.0))), "pool")
    return j.where(enough).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("_t")


def _skips(df: DataFrame, reason: Column, n: int) -> DataFrame:
    """Counts per skip reason; candidates beyond the budget count as over_budget."""
    c = df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    kept = F.col("reason") == "candidate"
    return c.select(F.when(kept, "over_budget").otherwise(F.col("reason")).alias("reason"),
                    F.when(kept, F.greatest(F.col("n") - n, F.lit(0))).otherwise(F.col("n")).alias("skipped"))


def collection_worklist(assets: DataFrame, cursors: DataFrame, now: int, n: int, window_ms: int = LIVE_MS) -> tuple[DataFrame, DataFrame]:
    """Live survivors with a pool by tier, least recently collected, depth, id; plus skip counts."""
    a = assets.withColumn("_why", ladder(
        "candidate", (~is_survivor(), "not_survivor"), (F.lit(now) - F.col("at") > window_ms, "not_live"), (F.col("pool").isNull(), "no_pool")))
    work = a.where("_why = 'candidate'").join(cursors.select("pool", "last_collected"), "pool", "left").withColumns({
        "_tier": lookup("verdict", SURVIVOR_ORDER), "_last": F.coalesce("last_collected", F.lit(-1)), "_liq": F.coalesce("liquidity", F.lit(0.0))})
    work = work.orderBy("_tier", "_last", F.desc("_liq"), "asset").limit(n).select("asset", "pool", "verdict")
    return work, _skips(a, F.col("_why"), n)


def analysis_priority(now: int) -> Column:
    """Points for analysing an asset now: tier, staleness, closeness to a better verdict, risk, depth."""
    hours = (F.lit(now) - F.col("last_analyzed")) / float(HOUR_MS)
    fresh = F.when(F.col("last_analyzed").isNull(), F.lit(30.0)).otherwise(F.least(F.lit(25.0), hours * 8))
    terms = [
        lookup("verdict", TIER_PRIORITY).cast("double"), fresh,
        F.when(known((F.col("verdict") == "QUALIFIED") & (F.col("opportunity") >= 55) & F.col("only_intel_blockers")), 15.0).otherwise(0.0),
        F.when(known(F.col("integrity_band") == "ELEVATED"), 12.0).otherwise(0.0), F.when(known(F.col("pending")), 10.0).otherwise(0.0),
        F.when(known(F.col("momentum").isin("UNSTABLE", "DECLINING")), 8.0).otherwise(0.0),
        F.when(F.coalesce("liquidity", F.lit(0.0)) < 10_000, -10.0).otherwise(0.0),
    ]
    return half_up(sum(terms[1:], terms[0]), 1)


def analysis_worklist(assets: DataFrame, last: DataFrame, now: int, n: int, refresh_ms: int = 30 * 60_000, window_ms: int = LIVE_MS):
    """Highest-priority live survivors not analysed recently; plus skip counts."""
    a = assets.join(last.select("asset", "last_analyzed"), "asset", "left").withColumn("_why", ladder(
        "candidate", (~is_survivor(), "not_survivor"), (F.lit(now) - F.col("at") > window_ms, "not_live"),
        (F.lit(now) - F.col("last_analyzed") < refresh_ms, "recently_analyzed")))
    work = a.where("_why = 'candidate'").withColumn("priority", analysis_priority(now)).orderBy(
        F.desc("priority"), lookup("verdict", SURVIVOR_ORDER), F.desc(F.coalesce("liquidity", F.lit(0.0))), "asset").limit(n)
    return work.select("asset", "verdict", "priority"), _skips(a, F.col("_why"), n)


def select_wallets(arrivals: DataFrame, bought: DataFrame, creators: DataFrame, n: int) -> DataFrame:
    """Wallets to analyse per asset: creators, early buyers for half the rest, largest, more early.

    Each set is cut to ``n`` per asset before the union (a partial per-group limit), so a hot
    asset never ranks more than a few rows in one place.
    """
    def top(df, order, role, base):
        r = F.row_number().over(Window.partitionBy("asset").orderBy(*order))
        return df.withColumn("_r", r).where(F.col("_r") <= n).select("asset", "wallet", F.lit(role).alias("role"), F.lit(base).alias("_g"), "_r")

    c = top(creators, ["wallet"], "creator", 0)
    n_creators = c.groupBy("asset").agg(F.count("*").alias("_c"))
    e = top(arrivals.where("buys > 0").join(c.select("asset", "wallet"), ["asset", "wallet"], "left_anti"), ["first_slot", "wallet"], "early", 1)
    e = e.join(n_creators, "asset", "left").withColumn("_q", F.ceil((F.lit(n) - F.coalesce("_c", F.lit(0))) / 2))
    e = e.withColumn("_g", F.when(F.col("_r") <= F.col("_q"), 1).otherwise(3)).drop("_c", "_q")
    l = top(bought.join(c.select("asset", "wallet"), ["asset", "wallet"], "left_anti"), [F.desc("bought"), "wallet"], "large", 2)
    u = c.unionByName(e).unionByName(l).groupBy("asset", "wallet").agg(F.min(F.struct("_g", "_r", "role")).alias("m"))
    r = F.row_number().over(Window.partitionBy("asset").orderBy("m._g", "m._r"))
    return u.withColumn("rank", r).where(F.col("rank") <= n).select("asset", "wallet", F.col("m.role").alias("role"), "rank")


def rank_key() -> Column:
    """Rank score, or the legacy score where there is none."""
    return F.coalesce(F.col("rank_score"), F.col("score"))


def current_age(now: int) -> Column:
    return F.when(F.col("launched_at").isNotNull(), F.greatest(F.lit(0.0), (F.lit(now) - F.col("launched_at")) / float(HOUR_MS)))


SEGMENTS = {"high-potential": "HIGH_POTENTIAL", "qualified": "QUALIFIED", "watch": "WATCH", "insufficient": "INSUFFICIENT_DATA",
            "high-risk": "HIGH_RISK", "rejected": "REJECTED"}


def _matches(q: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", "symbol", "name", "asset")), F.lit(q.lower())) if q else F.lit(True)


def board(assets: DataFrame, now: int, segment: str = "candidates", q: str = "", sort: str = "verdict", limit: int = 200) -> DataFrame:
    """Live rows of a segment matching a search, by verdict tier then the chosen key."""
    live = place(assets, now).where(is_live())
    if q and segment == "candidates":
        segment = "all"
    pick = F.lit(True) if segment == "all" else is_candidate() if segment == "candidates" else F.col("verdict") == SEGMENTS[segment]
    keys = {
        "verdict": [F.desc(F.coalesce("rank_score", F.lit(-1.0))), F.desc("score")],
        "score": [F.desc(F.coalesce("rank_score", F.lit(-1.0))), F.desc("score")],
        "liquidity": [F.desc(F.coalesce("liquidity", F.lit(-1.0)))], "momentum": [F.desc_nulls_last("change1h")],
        "newest": [F.asc_nulls_last("age_hours")], "seen": [F.desc("at")],
    }[sort]
    return live.where(pick & _matches(q)).orderBy(tier("verdict"), *keys, "asset").limit(limit)


def board_history(assets: DataFrame, now: int, q: str, n: int = 20) -> DataFrame:
    """Up to ``n`` assets outside the live window that match the search, newest first."""
    return place(assets, now).where(~is_live() & _matches(q)).orderBy(F.desc("at"), "asset").limit(n)


# The order in which roles fill a highlight list, then "top" until it is full.
HIGHLIGHT_ROLES = ["changed", "top", "newest", "top", "watch", "rejected", "changed", "top"]


def pick_highlights(live: DataFrame, changes: DataFrame, now: int, n: int = 8, change_ms: int = 24 * HOUR_MS) -> DataFrame:
    """A mixed selection of live assets, each once, filled role by role in a fixed order.

    ``changes(asset, prev_verdict, verdict, changed_at)``. A pick can only skip assets already
    picked, so ``2n`` per role is all any choice can look at: five small top-k lists.
    """
    recent = [F.desc("at"), "asset"]
    v = F.col("verdict")
    cur = live.select("asset", F.col("verdict").alias("_now"))
    ch = changes.join(cur, "asset")
    moved = ch.where((F.col("prev_verdict") != v) & (F.lit(now) - F.col("changed_at") <= change_ms) & (F.col("_now") == v))
    lists = {
        "changed": (moved.groupBy("asset").agg(F.max("changed_at").alias("t")), [F.desc("t"), "asset"]),
        "newest": (ch.where(F.col("prev_verdict").isNull()).groupBy("asset").agg(F.max("changed_at").alias("t")), [F.desc("t"), "asset"]),
        "top": (live.where(v.isin("HIGH_POTENTIAL", "QUALIFIED")), [tier("verdict"), F.desc(rank_key()), *recent]),
        "watch": (live.where(v == "WATCH"), recent), "rejected": (live.where(v == "REJECTED"), recent),
    }
    row = None
    for role, (df, order) in lists.items():
        top = df.orderBy(*order).limit(2 * n).select("asset", F.row_number().over(Window.orderBy(*order)).alias("_r"))
        one = top.agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "asset"))), lambda x: x["asset"]).alias("picks")).select(F.lit(role).alias("role"), "picks")
        row = one if row is None else row.unionByName(one)
    steps = F.array(*[F.lit(r) for r in HIGHLIGHT_ROLES + ["top"] * n])

    def fill(acc, role):
        free = F.get(F.array_except(F.element_at(F.col("by_role"), role), F.transform(acc, lambda x: x["asset"])), F.lit(0))
        return F.when((F.size(acc) < n) & free.isNotNull(), F.concat(acc, F.array(F.struct(free.alias("asset"), role.alias("role"))))).otherwise(acc)

    start = F.array().cast("array<struct<asset:string,role:string>>")
    row = row.agg(F.map_from_entries(F.collect_list(F.struct("role", "picks"))).alias("by_role")).withColumn("steps", steps).select(F.aggregate("steps", start, fill).alias("picked"))
    return row.select(F.posexplode("picked").alias("slot", "p")).select("slot", "p.*")
