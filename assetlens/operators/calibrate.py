"""Replay of stored history: how verdicts turned out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.functions.durable import cut
from assetlens.functions.scalar import DAY_MS, ladder
from assetlens.functions.skew import bucket_of, lag_across
from assetlens.operators.folds import stabilize

# Matching tolerance and outcome rules.
NEAR_MS = 10 * 60_000
COLLAPSE, SUSTAINED, THROUGH, PROXY, MIN_LIQUIDITY = 0.2, 0.5, 0.9, 0.5, 1_000
BAD = ["CONFIRMED_DRAIN", "CONFIRMED_ABUSE", "LIQUIDITY_COLLAPSE"]
# How blocker texts are grouped.
UNDER_MARKET, UNDER_INTEL = 0.7, 0.5  # least coverage of a high potential verdict
MASK_DIGITS, MASK_NEEDS = r"\d+(\.\d+)?%?", r"\(needs [^)]*\)"
ORDER = ["observed_at", "seq"]


def decision_points(verdicts: DataFrame, width: int = 30 * DAY_MS) -> DataFrame:
    """First verdict of an asset and every change after it."""
    v = lag_across(verdicts.where(F.col("verdict").isNotNull()), ["asset"], ORDER, "observed_at", width, {"prev_verdict": "verdict"})
    return v.where(F.col("prev_verdict").isNull() | (F.col("prev_verdict") != F.col("verdict")))


def _with_facts(points: DataFrame, at: Column, facts: DataFrame, width: int) -> DataFrame:
    """Points at ``at`` and facts at ``_t`` in one tape by asset and time block; ``_point`` marks the points.

    A fact names its own ``_b`` when it is copied to several blocks.
    """
    if "_b" not in facts.columns:
        facts = facts.withColumn("_b", bucket_of("_t", width))
    facts = facts.where("asset IS NOT NULL AND _t IS NOT NULL").withColumn("_point", F.lit(False))
    return points.withColumns({"_t": at, "_point": F.lit(True), "_b": bucket_of(at, width)}).unionByName(facts, allowMissingColumns=True)


def _so_far(keys: list[str], latest_first: bool = False):
    """Rows of a block up to this one: facts at or before a point, or those after it."""
    order = (F.desc("_t"), F.desc("_point")) if latest_first else (F.asc("_t"), F.asc("_point"))
    return Window.partitionBy("asset", "_b", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def nearest_observation(points: DataFrame, obs: DataFrame, tolerance: int = NEAR_MS, blocks: int = 144) -> DataFrame:
    """Nearest observation within the tolerance (the earlier wins ties, then the pool's name).

    Points and observations are sorted together inside (asset, block of ``blocks`` tolerances); an observation
    near an edge is copied to the next block. A point reads the last one before it and the first one after it,
    so nothing is paired however busy the asset is. Points without a ``seq`` get none.
    """
    width = tolerance * blocks
    t = F.col("_t")
    fact = F.struct("_t", F.coalesce("pool", F.lit("")).alias("name"), "liquidity", "pool")
    o = obs.select("asset", F.col("observed_at").alias("_t"), "liquidity", "pool").where("_t IS NOT NULL")
    o = o.select("asset", "_t", F.struct((-t).alias("back"), fact.alias("o")).alias("_before"), fact.alias("_after"),
                 F.explode(F.sequence(bucket_of(t - F.lit(tolerance), width), bucket_of(t + F.lit(tolerance), width))).alias("_b"))
    d = _with_facts(points, F.col("observed_at"), o, width).withColumns({
        "_before": F.min("_before").over(_so_far([]))["o"], "_after": F.min("_after").over(_so_far([], latest_first=True))}).where("_point")
    back, ahead = t - F.col("_before._t"), F.col("_after._t") - t
    n = F.when((back <= tolerance) & (ahead.isNull() | (back <= ahead)), F.col("_before")).when(ahead <= tolerance, F.col("_after"))
    d = d.withColumn("_n", F.when(F.col("seq").isNotNull(), n))
    return d.select(*points.columns, F.col("_n._t").alias("obs_at"), F.col("_n.liquidity").alias("obs_liquidity"), F.col("_n.pool").alias("obs_pool"))


def label_outcomes(points: DataFrame, obs: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """Outcome of each decision point within the horizon: measured, proxy or unknown.

    A window of one horizon is the rest of the point's block of that width and the beginning of the next
    block: two running folds over points, observations and events sorted together by (asset, block), so no
    point is paired with or copied to what it reads. Only the same pool counts once the point has one.
    Points without a ``seq`` read nothing.
    """
    t = F.col("_t")
    o = obs.where("liquidity IS NOT NULL").select("asset", F.col("observed_at").alias("_t"), F.col("liquidity").alias("_liq"), F.col("pool").alias("_pool"))
    e = events.select("asset", F.col("at").alias("_t"), F.struct(F.col("at").alias("t"), "type").alias("_event"))
    facts = o.unionByName(e, allowMissingColumns=True)
    kept = points.columns
    folds = {"_low": (F.min, F.col("_liq")), "_last": (F.max, F.when(F.col("_liq").isNotNull(), t)), "_first": (F.min, F.col("_event"))}

    def folded(p: DataFrame, at: Column, latest_first: bool) -> DataFrame:
        d = _with_facts(p.withColumn("_pool", F.col("obs_pool")), at, facts, horizon)
        everything, same = _so_far([], latest_first), _so_far(["_pool"], latest_first)
        read = {f"{n}_{i}": f(c).over(w) for n, (f, c) in folds.items() for i, w in (("any", everything), ("same", same)) if (n, i) != ("_first", "same")}
        d = d.withColumns(read).where("_point")
        either = lambda n: F.when(F.col("obs_pool").isNull(), F.col(f"{n}_any")).otherwise(F.col(f"{n}_same"))
        new = {"_low": either("_low"), "_last": either("_last"), "_first": F.col("_first_any")}
        return d.select(*[c for c in p.columns], *[v.alias(f"{n}_{'after' if latest_first else 'next'}") for n, v in new.items()])

    j = folded(folded(points, F.col("observed_at"), True), F.col("observed_at") + horizon, False)
    keyed = F.col("seq").isNotNull()
    j = j.select(*kept, F.when(keyed, F.least("_low_after", "_low_next")).alias("low"), F.when(keyed, F.greatest("_last_after", "_last_next")).alias("last"),
                 F.when(keyed, F.coalesce("_first_after", "_first_next")["type"]).alias("event"))
    liq, reached = F.col("obs_liquidity"), F.col("last") - F.col("observed_at")
    label = ladder(
        "NOT_OBSERVED", (F.col("event") == "LIQUIDITY_DRAIN", "CONFIRMED_DRAIN"), (F.col("event").isNotNull(), "CONFIRMED_ABUSE"),
        (liq.isNull() | (liq < MIN_LIQUIDITY) | F.col("last").isNull(), "NOT_OBSERVED"), (F.col("low") <= liq * COLLAPSE, "LIQUIDITY_COLLAPSE"),
        ((reached >= horizon * THROUGH) & (F.col("low") / liq >= SUSTAINED), "SUSTAINED_LIQUIDITY"), (reached >= horizon * THROUGH, "LIQUIDITY_DECLINED"),
        (reached >= horizon * PROXY, "SURVIVED_PART_OF_WINDOW"))
    j = j.withColumn("label", label)
    return j.withColumn("class", ladder("MEASURED", (F.col("label") == "NOT_OBSERVED", "UNKNOWN"), (F.col("label") == "SURVIVED_PART_OF_WINDOW", "PROXY"))).drop("event", "low", "last")


def outcome_tables(labelled: DataFrame) -> DataFrame:
    """Outcomes counted for each policy that decided and each verdict it gave."""
    return labelled.groupBy("policy", "verdict", "label", "class").agg(F.count("*").alias("n"))


def outcomes_by_veto(labelled: DataFrame) -> DataFrame:
    return labelled.select(F.explode("vetoes").alias("veto"), "label").groupBy("veto", "label").agg(F.count("*").alias("n"))


def escapes(labelled: DataFrame, verdicts: DataFrame, width: int = 30 * DAY_MS) -> DataFrame:
    """Neither rejected nor high risk, yet a bad outcome; with the first later rejection and the delay to it.

    Points and rejections are sorted together inside (asset, bucket) and read the next one there, else the
    first of the asset's later buckets, so an asset's rejections are never paired with its points.
    """
    key = ["asset", *ORDER]
    bad = cut(labelled.where(~F.col("verdict").isin("REJECTED", "HIGH_RISK") & F.col("label").isin(*BAD)).select(*key, "verdict", "label"))
    rej = verdicts.where("verdict = 'REJECTED'").select("asset", F.col("observed_at").alias("_t"), F.col("observed_at").alias("_rej"))
    d = _with_facts(bad, F.col("observed_at"), rej, width)
    later = Window.partitionBy("asset").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = d.groupBy("asset", "_b").agg(F.min("_rej").alias("_first")).withColumn("_later", F.min("_first").over(later)).select("asset", "_b", "_later")
    j = d.withColumn("_same", F.min("_rej").over(_so_far([], latest_first=True))).where("_point").join(firsts, ["asset", "_b"], "left")
    j = j.withColumn("rejected_at", F.coalesce("_same", "_later"))
    return j.select(*key, "verdict", "label", "rejected_at", (F.col("rejected_at") - F.col("observed_at")).alias("after_ms"))


def raw_reversals(verdicts: DataFrame, column: str = "verdict", width: int = 30 * DAY_MS) -> DataFrame:
    """Changes and A -> B -> A reversals per asset."""
    v = lag_across(verdicts.select("asset", *ORDER, column), ["asset"], ORDER, "observed_at", width, {"p1": column})
    v = lag_across(v, ["asset"], ORDER, "observed_at", width, {"p2": "p1"})
    changed = F.col(column) != F.col("p1")
    return v.groupBy("asset").agg(F.count_if(changed).alias("changes"), F.count_if(changed & (F.col(column) == F.col("p2"))).alias("reversals"))


def replay_stability(verdicts: DataFrame, k: int) -> DataFrame:
    """Raw against stabilised change and reversal counts with ``k`` confirmations."""
    s = cut(stabilize(verdicts, k, hold_ms=None))
    raw = raw_reversals(s).select("asset", F.col("changes").alias("raw"), "reversals")
    st = raw_reversals(s, "stable").select("asset", F.col("changes").alias("stable"), F.col("reversals").alias("stable_reversals"))
    return raw.join(st, "asset")


def current_audit(decisions: DataFrame) -> DataFrame:
    """(what, key, n) over the current decisions: verdicts, breached invariants, risk groups, blockers.

    ``decisions`` has verdict, market_coverage, intel_coverage, n_fails, analyzed_at, codes, families and
    blockers (arrays), disputed, corroborated, automation_alone, momentum. Blocker texts, of qualified
    assets only, are counted with their numbers masked. One pass: each row lists what it counts for.
    """
    v = F.col("verdict")
    entry = lambda what, key, when=F.lit(True): F.when(when, F.struct(F.lit(what).alias("what"), key.alias("key")))
    automated = F.array_contains("codes", "AUTOMATION")
    single = F.array(
        entry("verdict", v),
        entry("invariant", F.lit("high_potential_under_covered"), (v == "HIGH_POTENTIAL") & ((F.col("market_coverage") < UNDER_MARKET) | (F.col("intel_coverage") < UNDER_INTEL))),
        entry("invariant", F.lit("rejected_without_hard_fail"), (v == "REJECTED") & (F.col("n_fails") == 0)),
        entry("invariant", F.lit("qualified_unanalysed"), (v == "QUALIFIED") & F.col("analyzed_at").isNull()),
        entry("automation", v, automated), entry("automation_alone", v, automated & (v == "HIGH_RISK") & F.col("automation_alone")),
        entry("disputed", v, F.col("disputed")), entry("corroborated", v, F.col("disputed") & F.col("corroborated")), entry("momentum", F.col("momentum")),
    )
    each = lambda what, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: entry(what, x, x.isNotNull()))
    masked = F.transform("blockers", lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, MASK_DIGITS, "#"), MASK_NEEDS, "")))
    rows = F.concat(single, each("code", F.array_distinct("codes")), each("family", F.col("families")), each("blocker", F.when(v == "QUALIFIED", masked)))
    return decisions.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).groupBy("r.what", "r.key").agg(F.count("*").alias("n"))


def history_span(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.count("*").alias("rows"), F.countDistinct("asset").alias("assets"))
