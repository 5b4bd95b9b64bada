"""Evidence: provider claims resolved to one value per (asset, metric), with state and confidence.

Long form throughout: ``claims(asset, metric, provider, value, observed_at, invalid,
unavailable)``. Yes/no metrics carry 1.0 / 0.0. UNKNOWN, INVALID, STALE and UNAVAILABLE stay
different things; none of them is zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions.scalar import HOUR_MS, half_up, known, ladder, lookup

MIN = 60_000
# Freshness windows (fresh, aging) in ms; metrics not listed never go stale.
FRESHNESS = {
    "priceChange": (15 * MIN, 45 * MIN), "volume24h": (30 * MIN, 90 * MIN), "liquidityUsd": (30 * MIN, 90 * MIN),
    "buyPressure": (30 * MIN, 90 * MIN), "holders": (6 * HOUR_MS, 24 * HOUR_MS), "topHoldersPct": (6 * HOUR_MS, 24 * HOUR_MS),
    "rugcheckRisk": (6 * HOUR_MS, 24 * HOUR_MS), "organicScore": (6 * HOUR_MS, 24 * HOUR_MS),
    "mintAuthorityRevoked": (24 * HOUR_MS, 168 * HOUR_MS), "freezeAuthorityRevoked": (24 * HOUR_MS, 168 * HOUR_MS), "mintExtensions": (24 * HOUR_MS, 168 * HOUR_MS),
}
# Provider trust and listing order, confidence factors, coverage weights.
TRUST = {"helius": 1.0, "rugcheck": 0.95, "dexscreener": 0.9, "jupiter": 0.85}
DEFAULT_TRUST = 0.7
ORDER = {"dexscreener": 0, "rugcheck": 1, "jupiter": 2, "helius": 3}
AGING_FACTOR, CONFLICT_FACTOR, CONCENTRATION_PENALTY = 0.8, 0.6, 0.25
WEIGHTS = {
    "liquidityUsd": 0.18, "volume24h": 0.07, "priceChange": 0.12, "buyPressure": 0.09, "holders": 0.13, "ageHours": 0.08, "mintAuthorityRevoked": 0.078,
    "freezeAuthorityRevoked": 0.052, "topHoldersPct": 0.052, "rugcheckRisk": 0.052, "organicScore": 0.026, "tradable": 0.07, "mintExtensions": 0.052,
}
# How a winner is chosen when claims agree / conflict; what counts as agreement.
AUTHORITIES = ["mintAuthorityRevoked", "freezeAuthorityRevoked"]
AGREE_RULE = {"liquidityUsd": "LOWEST"}
CONFLICT_RULE = {"liquidityUsd": "LOWEST", "ageHours": "HIGHEST", "mintAuthorityRevoked": "LOWEST", "freezeAuthorityRevoked": "LOWEST"}
LIQUIDITY_RATIO, AGE_TOLERANCE = 3.0, 0.5


def freshness(metric: Column, observed_at: Column, now: int) -> Column:
    age = F.lit(now) - observed_at
    fresh = lookup(metric, {m: w[0] for m, w in FRESHNESS.items()}, F.lit(None).cast("long"))
    aging = lookup(metric, {m: w[1] for m, w in FRESHNESS.items()}, F.lit(None).cast("long"))
    return ladder("STALE", (observed_at.isNull(), "UNKNOWN"), (fresh.isNull(), "FRESH"), (age <= fresh, "FRESH"), (age <= aging, "AGING"))


def _equal(metric: Column, a: Column, b: Column) -> Column:
    lo, hi = F.least(a, b), F.greatest(a, b)
    ratio = F.when(hi == 0, F.lit(True)).when(lo == 0, F.lit(False)).otherwise(hi / lo <= LIQUIDITY_RATIO)
    return F.when(metric == "liquidityUsd", ratio).when(metric == "ageHours", F.abs(a - b) < AGE_TOLERANCE).otherwise(a == b)


def resolve_claims(claims: DataFrame, now: int) -> DataFrame:
    """One evidence row per (asset, metric) with the overridden claims listed.

    Only each provider's latest claim counts. That first step combines map-side, so the list
    gathered per (asset, metric) has one entry per provider and never grows with history.
    """
    one = claims.groupBy("asset", "metric", "provider").agg(
        F.max_by(F.struct("value", "observed_at", "invalid", "unavailable"), F.struct("observed_at", "claim_id")).alias("c")).select("asset", "metric", "provider", "c.*")
    one = one.withColumns({"ord": lookup("provider", ORDER, 9), "trust": lookup("provider", TRUST, DEFAULT_TRUST), "fresh": freshness(F.col("metric"), F.col("observed_at"), now)})
    g = one.groupBy("asset", "metric").agg(F.array_sort(F.collect_list(F.struct("ord", "provider", "value", "observed_at", "invalid", "unavailable", "trust", "fresh"))).alias("cs"))
    ok = lambda c: c["value"].isNotNull() & c["invalid"].isNull() & c["unavailable"].isNull()
    g = g.withColumns({
        "cur": F.filter("cs", lambda c: ok(c) & (c["fresh"] != "STALE")), "stale": F.filter("cs", lambda c: ok(c) & (c["fresh"] == "STALE")),
        "bad": F.filter("cs", lambda c: c["invalid"].isNotNull() & c["unavailable"].isNull()), "down": F.filter("cs", lambda c: c["unavailable"].isNotNull())})
    m = F.col("metric")
    first = F.get("cur", F.lit(0))["value"]
    g = g.withColumn("conflict", F.exists("cur", lambda c: ~_equal(m, c["value"], first)))
    rule = F.when(F.col("conflict"), lookup(m, CONFLICT_RULE, "FIRST")).otherwise(lookup(m, AGREE_RULE, "TRUST"))
    g = g.withColumn("rule", rule)
    lead = lambda c: F.when(m.isin(*AUTHORITIES) & (c["provider"] == "helius"), F.lit(0)).otherwise(F.lit(1))
    key = lambda c: F.when(F.col("rule") == "LOWEST", c["value"]).when(F.col("rule") == "HIGHEST", -c["value"]).when(F.col("rule") == "TRUST", -c["trust"]).otherwise(F.lit(0.0))
    win = F.array_min(F.transform("cur", lambda c: F.struct(lead(c).alias("lead"), key(c).alias("key"), c["ord"].alias("ord"), c["provider"].alias("provider"), c["value"].alias("value"),
                                                            c["observed_at"].alias("observed_at"), c["trust"].alias("trust"), c["fresh"].alias("fresh"))))
    newest = F.array_max(F.transform("stale", lambda c: F.struct(c["observed_at"].alias("observed_at"), (-c["ord"]).alias("o"), c["provider"].alias("provider"))))
    g = g.withColumns({"win": win, "newest": newest})
    state = ladder("UNKNOWN", (F.size("cur") > 0, F.when(F.col("conflict"), "CONFLICTED").otherwise("MEASURED")), (F.size("stale") > 0, "STALE"), (F.size("bad") > 0, "INVALID"), (F.size("down") > 0, "UNAVAILABLE"))
    g = g.withColumn("state", state)
    factor = F.when(F.col("conflict"), CONFLICT_FACTOR).otherwise(1.0) * F.when(F.col("win.fresh") == "AGING", AGING_FACTOR).otherwise(1.0)
    st = F.col("state")
    over = F.filter(F.concat("stale", "cur"), lambda c: (c["provider"] != F.col("win.provider")) & ~_equal(m, c["value"], F.col("win.value")))
    return g.select(
        "asset", "metric", "state", F.col("win.value").alias("value"),
        ladder(F.lit(None).cast("string"), (F.size("cur") > 0, F.col("win.provider")), (st == "STALE", F.col("newest.provider")), (st == "INVALID", F.get("bad", F.lit(0))["provider"]),
               (st == "UNAVAILABLE", F.get("down", F.lit(0))["provider"])).alias("source"),
        ladder(F.lit(None).cast("long"), (F.size("cur") > 0, F.col("win.observed_at")), (st == "STALE", F.col("newest.observed_at")), (st == "INVALID", F.get("bad", F.lit(0))["observed_at"])).alias("observed_at"),
        ladder("UNKNOWN", (F.size("cur") > 0, F.col("win.fresh")), (st == "STALE", "STALE")).alias("freshness"),
        F.when(F.size("cur") > 0, half_up(F.col("win.trust") * factor, 3)).otherwise(F.lit(0.0)).alias("confidence"),
        F.size("cs").alias("claims"), F.when(F.size("cur") > 0, F.transform(over, lambda c: F.struct(c["provider"].alias("provider"), c["value"].alias("value"))))
        .otherwise(F.array().cast("array<struct<provider:string,value:double>>")).alias("overridden"))


def usable() -> Column:
    return F.col("state").isin("MEASURED", "CONFLICTED") & F.col("value").isNotNull()


def scorability(evidence: DataFrame) -> DataFrame:
    """Whether a value may be scored, with the reason when not."""
    st = F.col("state")
    reason = ladder("scorable", (st.isin("INVALID", "STALE", "UNAVAILABLE", "UNKNOWN"), F.lower(st)), (F.col("value").isNull(), "unknown"),
                    (~F.col("freshness").isin("FRESH", "AGING"), "stale"))
    return evidence.withColumn("reason", reason).withColumn("scorable", F.col("reason") == "scorable")


# ---- claims from provider tables -------------------------------------------------------

def _claim(metric: str, provider: str, value: Column, invalid: Column | None = None, when: Column | None = None, observed: str = "observed_at") -> Column:
    inv = F.lit(None).cast("string") if invalid is None else invalid
    c = F.struct(F.lit(metric).alias("metric"), F.lit(provider).alias("provider"), F.when(inv.isNull(), value.cast("double")).alias("value"), F.col(observed).alias("observed_at"),
                 inv.alias("invalid"), F.lit(None).cast("string").alias("unavailable"), F.lit(0).cast("long").alias("claim_id"))
    return c if when is None else F.when(known(when), c)


def _claims(df: DataFrame, *claims: Column) -> DataFrame:
    """All claims of a provider row in one pass over the provider's table."""
    return df.select("asset", F.inline(F.filter(F.array(*claims), lambda c: c.isNotNull())))


def market_claims(pairs: DataFrame, now: int) -> DataFrame:
    """Venue claims per asset: summed liquidity and volume, deepest pool's frames, pressure, age.

    ``pairs(asset, pool, position, liquidity, volume24h, buys_h1, sells_h1, buys_h24, sells_h24,
    m5, h1, h6, h24, created_at, liquidity_issue, observed_at)``. Sums are null if every pool is.
    """
    deep = F.struct(F.coalesce("liquidity", F.lit(-1.0)), -F.col("position"))
    g = pairs.groupBy("asset").agg(
        F.sum("liquidity").alias("liquidity"), F.sum("volume24h").alias("volume"), F.bool_or("liquidity_issue").alias("issue"), F.max("observed_at").alias("observed_at"),
        F.min("created_at").alias("created"), F.max_by(F.struct("m5", "h1", "h6", "h24"), deep).alias("best"),
        *[F.sum(c).alias(c) for c in ("buys_h1", "sells_h1", "buys_h24", "sells_h24")])

    def pressure(b: str, s: str) -> Column:
        n = F.col(b) + F.col(s)
        return F.when(n >= 10, F.col(b) / n)

    whole = F.col("best.m5").isNotNull() & F.col("best.h1").isNotNull() & F.col("best.h6").isNotNull() & F.col("best.h24").isNotNull()
    bad_liq = F.when(F.col("liquidity").isNull() & F.col("issue"), "every pair liquidity figure failed validation")
    p = "dexscreener"
    return _claims(
        g, _claim("liquidityUsd", p, F.col("liquidity"), bad_liq), _claim("venueLiquidityUsd", p, F.col("liquidity"), bad_liq), _claim("volume24h", p, F.col("volume")),
        _claim("priceChange", p, 0.6 * F.col("best.h1") + 0.4 * F.col("best.h6"), F.when(~whole, "incomplete or rejected price-change frames")),
        _claim("buyPressure", p, F.coalesce(pressure("buys_h1", "sells_h1"), pressure("buys_h24", "sells_h24"))),
        _claim("ageHours", p, (F.lit(now) - F.col("created")) / float(HOUR_MS), when=F.col("created").isNotNull()))


def info_claims(info: DataFrame, now: int) -> DataFrame:
    """Asset-info claims; ``issues array<string>`` names rejected fields."""
    p = "jupiter"
    issue = lambda f: F.when(F.array_contains("issues", f), "failed validation")
    return _claims(
        info, _claim("liquidityUsd", p, F.col("liquidity"), issue("liquidity")), _claim("holders", p, F.col("holders"), issue("holderCount")), _claim("organicScore", p, F.col("organic"), issue("organicScore")),
        _claim("ageHours", p, (F.lit(now) - F.col("first_pool_at")) / float(HOUR_MS), when=F.col("first_pool_at").isNotNull()),
        _claim("mintAuthorityRevoked", p, F.col("mint_disabled").cast("double"), issue("audit.mintAuthorityDisabled")),
        _claim("freezeAuthorityRevoked", p, F.col("freeze_disabled").cast("double"), issue("audit.freezeAuthorityDisabled")))


def report_claims(report: DataFrame) -> DataFrame:
    """Risk score, and "authority live" when a danger or warn finding says so."""
    def asserts(needle: str) -> Column:
        return F.exists("risks", lambda r: r["level"].isin("danger", "warn") & F.contains(F.lower(r["name"]), F.lit(needle)))

    p = "rugcheck"
    return _claims(
        report, _claim("rugcheckRisk", p, F.col("score"), F.when(F.array_contains("issues", "score_normalised"), "failed validation")),
        _claim("mintAuthorityRevoked", p, F.lit(0.0), when=asserts("mint authority")), _claim("freezeAuthorityRevoked", p, F.lit(0.0), when=asserts("freeze authority")))


def chain_claims(mint: DataFrame) -> DataFrame:
    """Authorities stated on chain; extensions only when the list is complete."""
    p = "helius"
    return _claims(
        mint, _claim("mintAuthorityRevoked", p, F.col("mint_authority").isNull().cast("double"), when=F.col("mint_stated")),
        _claim("freezeAuthorityRevoked", p, F.col("freeze_authority").isNull().cast("double"), when=F.col("freeze_stated")),
        _claim("mintExtensions", p, F.col("extension_count"), when=F.col("extensions_complete")))


def concentration_claims(info: DataFrame, mint: DataFrame) -> DataFrame:
    """First available source of top-holder share: audit figure, else chain, else a rejected audit."""
    j = info.select("asset", "top_holders", "issues", F.col("observed_at").alias("io")).join(mint.select("asset", "top10_share", F.col("observed_at").alias("co")), "asset", "full_outer")
    bad = F.when(F.array_contains("issues", "audit.topHoldersPercentage"), "failed validation")
    audit, chain = F.col("top_holders").isNotNull(), F.col("top10_share").isNotNull()
    return _claims(
        j, _claim("topHoldersPct", "jupiter", F.col("top_holders"), when=audit, observed="io"), _claim("topHoldersPct", "helius", F.col("top10_share") * 100, when=~audit & chain, observed="co"),
        _claim("topHoldersPct", "jupiter", F.lit(None), bad, when=~audit & ~chain & F.col("io").isNotNull(), observed="io"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_unavailable(claims: DataFrame, failures: DataFrame) -> DataFrame:
    """Add a stub claim for metrics whose only provider failed and said nothing."""
    have = claims.select("asset", "metric").distinct()
    stub = failures.join(have, ["asset", "metric"], "left_anti").select(
        "asset", "metric", "provider", F.lit(None).cast("double").alias("value"), F.col("at").alias("observed_at"), F.lit(None).cast("string").alias("invalid"), F.col("kind").alias("unavailable"), F.lit(0).cast("long").alias("claim_id"))
    return claims.unionByName(stub)


def with_tradable(evidence: DataFrame) -> DataFrame:
    """Add a tradable row beside each liquidity row: any usable liquidity above zero.

    The same pass emits both rows, so resolution runs once. No usable reading stays unknown.
    """
    cols = [c for c in evidence.columns if c != "asset"]
    ok = F.col("state").isin("MEASURED", "CONFLICTED")
    none = F.array().cast("array<struct<provider:string,value:double>>")
    made = {
        "metric": F.lit("tradable"), "state": F.when(ok, F.col("state")).otherwise("UNKNOWN"), "value": F.when(ok, (F.coalesce("value", F.lit(0.0)) > 0).cast("double")), "source": F.when(ok, F.col("source")),
        "observed_at": F.when(ok, F.col("observed_at")), "freshness": F.when(ok, F.col("freshness")).otherwise("UNKNOWN"), "confidence": F.when(ok, F.col("confidence")).otherwise(0.0), "claims": F.lit(0), "overridden": none}
    own = F.struct(*cols)
    derived = F.when(F.col("metric") == "liquidityUsd", F.struct(*[made[c].alias(c) for c in cols]))
    return evidence.select("asset", F.inline(F.filter(F.array(own, derived), lambda r: r.isNotNull())))


def resolve_feeds(pairs: DataFrame, info: DataFrame, report: DataFrame, mint: DataFrame, now: int) -> DataFrame:
    """All metrics of all assets from the four provider tables."""
    c = _union([market_claims(pairs, now), info_claims(info, now), report_claims(report), chain_claims(mint), concentration_claims(info, mint)])
    return with_tradable(resolve_claims(c, now))


def historical_danger(evidence: DataFrame) -> DataFrame:
    """Assets where an overridden authority claim said the authority was live."""
    hit = F.col("metric").isin(*AUTHORITIES) & F.exists("overridden", lambda c: c["value"] == 0.0)
    return evidence.groupBy("asset").agg(F.bool_or(known(hit)).alias("historical_danger"))


# What a finding's name says about it; the first matching text decides.
FINDING_NATURE = {
    "creator history of rugged tokens": "HISTORICAL", "rugged": "HISTORICAL", "mint authority": "CURRENT_STATE", "freeze authority": "CURRENT_STATE", "lp unlocked": "CURRENT_STATE",
    "lp providers": "CURRENT_STATE", "low liquidity": "CURRENT_STATE", "mutable metadata": "CURRENT_STATE", "single holder ownership": "CURRENT_STATE", "high ownership": "CURRENT_STATE",
    "holder concentration": "CURRENT_STATE", "permanent control": "PERMANENT", "transfer fee": "CURRENT_STATE",
}


def finding_nature(name: Column) -> Column:
    low = F.lower(name)
    return ladder("UNKNOWN_NATURE", *[(F.contains(low, F.lit(m)), n) for m, n in FINDING_NATURE.items()])


def classify_findings(findings: DataFrame, evidence: DataFrame, now: int) -> DataFrame:
    """Nature of each finding, and why it is not scored if it is not.

    ``findings(asset, name, level, observed_at)``. Dropped from scoring: unknown nature, a stale
    current-state finding, one contradicted by an authority shown revoked.
    """
    auth = evidence.where(F.col("metric").isin(*AUTHORITIES)).groupBy("asset").agg(
        *[F.max(F.when((F.col("metric") == m) & usable(), F.col("value"))).alias(m) for m in AUTHORITIES])
    f = findings.join(auth, "asset", "left").withColumns({"nature": finding_nature(F.col("name")), "freshness": freshness(F.lit("rugcheckRisk"), F.col("observed_at"), now)})
    low = F.lower("name")
    revoked = F.when(F.contains(low, F.lit("mint authority")), F.col(AUTHORITIES[0])).when(F.contains(low, F.lit("freeze authority")), F.col(AUTHORITIES[1]))
    why = ladder(F.lit(None).cast("string"), (F.col("nature") == "UNKNOWN_NATURE", "unknown_nature"),
                 ((F.col("nature") == "CURRENT_STATE") & ~F.col("freshness").isin("FRESH", "AGING"), "stale"), (revoked == 1.0, "contradicted"))
    return f.withColumn("suppressed", why).withColumn("scorable", F.col("suppressed").isNull()).drop(*AUTHORITIES)


# ---- ledger and coverage ---------------------------------------------------------------


def evidence_ledger(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn("weight", lookup("metric", WEIGHTS, 0.0))


def coverage_report(ledger: DataFrame) -> DataFrame:
    """State counts, covered weight, confidence lowered by dependence on one provider."""
    l = ledger.where("weight > 0")
    u = usable()
    total = sum(WEIGHTS.values())
    exact = lambda c: F.col(c).cast("decimal(6,3)")  # noqa: E731  (three-digit inputs, so sums are order-free)
    per = l.groupBy("asset", "source").agg(
        F.sum(F.when(u, exact("weight")).otherwise(0)).alias("w"), F.sum(F.when(u, exact("weight") * exact("confidence")).otherwise(0)).alias("wc"),
        *[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("MEASURED", "CONFLICTED", "INVALID", "STALE", "UNAVAILABLE")])
    states = ["measured", "conflicted", "invalid", "stale", "unavailable"]
    g = per.groupBy("asset").agg(
        F.sum("w").cast("double").alias("w"), F.sum("wc").cast("double").alias("wc"), F.max(F.struct(F.col("w").cast("double").alias("w"), F.col("source"))).alias("top"), *[F.sum(s).alias(s) for s in states])
    share = F.when(F.col("w") > 0, F.col("top.w") / F.col("w")).otherwise(0.0)
    mean = F.when(F.col("w") > 0, F.col("wc") / F.col("w")).otherwise(0.0)
    conf = F.greatest(F.lit(0.0), mean * (1 - CONCENTRATION_PENALTY * F.greatest(F.lit(0.0), share - 0.5) * 2))
    counted = sum([F.col(s) for s in states[1:]], F.col(states[0]))
    return g.select("asset", *states, (F.lit(len(WEIGHTS)) - counted).alias("unknown"), half_up(F.col("w") / total, 3).alias("coverage"), half_up(conf, 3).alias("confidence"),
                    half_up(share, 3).alias("provider_concentration"), F.when(F.col("w") > 0, F.col("top.source")).alias("dominant_provider"))


def conflicts(evidence: DataFrame) -> DataFrame:
    return evidence.where("state = 'CONFLICTED'").select("asset", "metric")


def capability_state(providers: DataFrame, failures: DataFrame) -> DataFrame:
    """OFF when not configured, DEGRADED when the provider failed recently, else ON."""
    f = failures.select("provider").distinct().withColumn("_f", F.lit(True))
    return providers.join(f, "provider", "left").select("provider", ladder("ON", (~F.col("configured"), "OFF"), (F.col("_f"), "DEGRADED")).alias("state"))


# Failure texts per kind, and the kinds worth retrying.
NETWORK_TEXTS = ["econnrefused", "econnreset", "enotfound", "network"]
RETRYABLE = ["TIMEOUT", "RATE_LIMITED", "NETWORK_ERROR", "PROVIDER_UNAVAILABLE"]


def classify_failures(log: DataFrame) -> DataFrame:
    """Kind of each failure from ``status`` (HTTP, if any), ``name`` and ``message``; retryable."""
    msg = F.lower(F.coalesce("message", F.lit("")))
    has = lambda *t: F.greatest(*[F.contains(msg, F.lit(x)) for x in t]) if len(t) > 1 else F.contains(msg, F.lit(t[0]))
    st, name = F.col("status"), F.coalesce("name", F.lit(""))
    kind = ladder(
        "UNKNOWN", (st == 429, "RATE_LIMITED"), (st >= 500, "PROVIDER_UNAVAILABLE"), (st.isNotNull(), "INVALID_RESPONSE"), (name.isin("TimeoutError", "AbortError"), "TIMEOUT"),
        (has("timeout", "aborted"), "TIMEOUT"), ((name == "SyntaxError") | has("json"), "INVALID_RESPONSE"), ((name == "TypeError") & has("fetch failed"), "NETWORK_ERROR"), (has(*NETWORK_TEXTS), "NETWORK_ERROR"))
    return log.withColumn("kind", kind).withColumn("retryable", F.col("kind").isin(*RETRYABLE))


def evidence_rows(ledger: DataFrame, stored: DataFrame) -> DataFrame:
    """Ledger rows where an asset has any, else its last stored rows."""
    fallback = stored.join(ledger.select("asset").distinct(), "asset", "left_anti")
    return ledger.withColumn("origin", F.lit("ledger")).unionByName(fallback.withColumn("origin", F.lit("stored")))


def wide(evidence: DataFrame, metrics: list[str]) -> DataFrame:
    """One struct column per metric: value, state, source, freshness, confidence."""
    s = F.struct("value", "state", "source", "freshness", "confidence", "observed_at")
    return evidence.groupBy("asset").agg(*[F.max_by(s, F.when(F.col("metric") == m, F.lit(1))).alias(m) for m in metrics])
