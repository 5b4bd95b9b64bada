"""Intelligence domains, momentum, integrity, opportunity, hard fails and the verdict.

One wide row per asset carries the domains as flat columns ``<domain>_status / _coverage /
_confidence / _freshness`` next to their values; contributions and vetoes are long tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions.scalar import DAY_MS, HOUR_MS, clamp, clamp01, codes, half_up, known, ladder, log_band_hard, lookup
from assetlens.functions.skew import lag_across
from assetlens.operators.screen import settle_state

# Accepted rule versions per domain, and the version texts of this policy.
RULES = {
    "security": "security-events@1", "wash": "wash@2", "activity": "activity-quality@2", "classify": "buyer-class@1", "cluster": "cluster@1", "attribution": "attribution@1",
    "creator": "creator-history@1", "network": "serial-network@1",
}
BEHAVIOUR_WINDOW, HISTORY_WINDOW = (HOUR_MS, 6 * HOUR_MS), (24 * HOUR_MS, 168 * HOUR_MS)
DEEP = ["activity", "wash", "coordination", "attribution", "creator", "network", "security"]


def rule_status(domain: str | Column, version: Column) -> Column:
    """CURRENT / SUPERSEDED / UNVERSIONED for a stored reading's rule version."""
    want = F.lit(RULES[domain]) if isinstance(domain, str) else lookup(domain, RULES, F.lit(None).cast("string"))
    return ladder("SUPERSEDED", (version.isNull() | (version == ""), "UNVERSIONED"), (version == want, "CURRENT"))


def _fresh(at: Column, now: int, window: tuple[int, int]) -> Column:
    age = F.lit(now) - at
    return ladder("STALE", (at.isNull(), "UNKNOWN"), (age <= window[0], "FRESH"), (age <= window[1], "AGING"))


def usable(d: str) -> Column:
    return known(F.col(f"{d}_status").isin("AVAILABLE", "PARTIAL") & (F.col(f"{d}_freshness") != "STALE"))


def launch_counts(events: DataFrame, creators: DataFrame) -> DataFrame:
    """Per (asset, creator): other launches with a confirmed / only suspected active finding.

    ``events(asset, status)`` are active; ``creators(asset, creator)`` links launches. Findings
    collapse per launch and then per creator; an asset's own launch is subtracted, not excluded
    by a join of a creator's launches with themselves.
    """
    per = events.groupBy("asset").agg(F.bool_or(F.col("status") == "CONFIRMED").alias("c"), F.bool_or(F.col("status") == "STRONGLY_SUSPECTED").alias("s"), F.bool_or(F.col("status") == "SUSPICIOUS").alias("u"))
    own = creators.join(per, "asset", "left").na.fill(False, ["c", "s", "u"]).select(
        "asset", "creator", F.col("c").cast("long").alias("c"), (F.col("s") & ~F.col("c")).cast("long").alias("s"), F.col("u").cast("long").alias("u"))
    total = own.groupBy("creator").agg(F.count("*").alias("launches"), F.sum("c").alias("tc"), F.sum("s").alias("ts"), F.sum("u").alias("tu"))
    return own.join(total, "creator").select("asset", "creator", "launches", (F.col("tc") - F.col("c")).alias("confirmed"), (F.col("ts") - F.col("s")).alias("suspected"), (F.col("tu") - F.col("u")).alias("suspicious"))


def normalize_intel(snap: DataFrame, now: int) -> DataFrame:
    """Status, coverage, confidence and freshness of the seven deep domains.

    Input per asset: analyzed_at; versions map<domain, version>; activity_raw, trades_classified,
    representativeness, class_confidence; wash_raw, wash_cov, wash_conf; wallets, wallets_read,
    clusters, cluster_conf; attribution_raw, attribution_conf; launches, other_confirmed,
    other_suspected, other_suspicious; network_raw, best_path, best_confirmed, graph_cut;
    mint_history, active_events, worst_event, event_conf. Null analyzed_at means never analysed.
    """
    c = F.col
    seen = c("analyzed_at").isNotNull()
    beh, his = _fresh(c("analyzed_at"), now, BEHAVIOUR_WINDOW), _fresh(c("analyzed_at"), now, HISTORY_WINDOW)
    ok = lambda d: rule_status(d, F.try_element_at("versions", F.lit(d))) == "CURRENT"
    rep = F.coalesce("representativeness", F.lit(0.0))
    wcov = half_up(F.coalesce("wash_cov", F.lit(0.0)) * rep, 3)
    read = F.when(c("wallets") > 0, c("wallets_read") / c("wallets")).otherwise(0.0)

    def dom(name, present, rule, fresh, status, coverage, confidence, stale=True):
        st = ladder(status, (~seen | ~known(present), "UNAVAILABLE"), (~ok(rule), "SUPERSEDED"), *([(fresh == "STALE", "STALE")] if stale else []))
        have = seen & known(present)
        return {f"{name}_status": st, f"{name}_freshness": F.when(have, fresh).otherwise("UNKNOWN"),
                f"{name}_coverage": F.when(have, half_up(coverage, 3)).otherwise(0.0), f"{name}_confidence": F.when(have, half_up(confidence, 3)).otherwise(0.0)}

    out = {}
    out |= dom("activity", c("activity_raw").isNotNull(), "activity", beh, ladder("INSUFFICIENT_DATA", ((c("activity_raw") == "MEASURED") & (rep >= 0.5), "AVAILABLE"), (c("activity_raw").isin("MEASURED", "PARTIAL"), "PARTIAL")),
               F.coalesce("trades_classified", F.lit(0.0)) * rep, F.coalesce("class_confidence", F.lit(0.0)))
    out |= dom("wash", c("wash_raw").isNotNull(), "wash", beh, ladder("PARTIAL", (c("wash_raw") == "INSUFFICIENT_DATA", "INSUFFICIENT_DATA"), (F.coalesce("wash_cov", F.lit(0.0)) * rep >= 0.5, "AVAILABLE")), wcov, F.coalesce("wash_conf", F.lit(0.0)))
    out |= dom("coordination", c("network_raw").isNotNull(), "cluster", beh, ladder("PARTIAL", (F.coalesce("wallets", F.lit(0)) == 0, "INSUFFICIENT_DATA"), (read >= 0.7, "AVAILABLE")), read, F.when(F.coalesce("clusters", F.lit(0)) == 0, 0.5 * read).otherwise(c("cluster_conf")))
    att = c("attribution_raw")
    att_cov = ladder(0.0, (att == "ATTRIBUTED", 1.0), (att == "AMBIGUOUS", 0.5))
    out |= dom("attribution", att.isNotNull(), "attribution", his, ladder("INSUFFICIENT_DATA", (att == "ATTRIBUTED", "AVAILABLE"), (att == "AMBIGUOUS", "PARTIAL")), att_cov, F.coalesce("attribution_conf", F.lit(0.0)), stale=False)
    cr = ladder("INSUFFICIENT_HISTORY", (c("other_confirmed") > 0, "MALICIOUS_HISTORY"), (c("other_suspected") + c("other_suspicious") > 0, "SUSPICIOUS"), (c("launches") >= 2, "CLEAN"))
    out |= dom("creator", c("launches").isNotNull(), "creator", his, F.when(cr == "INSUFFICIENT_HISTORY", "INSUFFICIENT_DATA").otherwise("AVAILABLE"), ladder(0.0, (c("launches") >= 2, 1.0), (c("launches") == 1, 0.5)) * att_cov, F.coalesce("attribution_conf", F.lit(0.0)))
    level = ladder("NONE", (c("network_raw") == "INSUFFICIENT_DATA", "INSUFFICIENT_DATA"), ((c("best_confirmed") > 0) & (c("best_path") >= 0.5), "STRONG"), (c("best_path").isNotNull(), "MODERATE"), (c("network_raw") == "WEAK_ASSOCIATION", "WEAK_ASSOCIATION"))
    out |= dom("network", c("network_raw").isNotNull(), "network", his, F.when(level == "INSUFFICIENT_DATA", "INSUFFICIENT_DATA").otherwise("AVAILABLE"),
               ladder(1.0, (level == "INSUFFICIENT_DATA", 0.0), (c("graph_cut"), 0.6)), ladder(0.0, (c("best_path").isNotNull(), c("best_path")), (level == "NONE", 0.5)))
    out |= {"creator_level": cr, "network_level": level}
    hist, n = c("mint_history"), F.coalesce("active_events", F.lit(0))
    scov = ladder(0.2, (~seen | ~ok("security"), 0.0), (hist == "COMPLETE", 1.0), (hist == "PARTIAL", 0.6), (hist == "UNKNOWN", 0.5))
    out |= {
        "security_status": ladder("PARTIAL", (~seen & (n == 0), "UNAVAILABLE"), (~seen, "PARTIAL"), (~ok("security") & (n == 0), "SUPERSEDED"), (~ok("security"), "PARTIAL"), (scov >= 0.6, "AVAILABLE")),
        "security_coverage": scov, "security_freshness": his, "security_confidence": F.when(n > 0, c("event_conf")).otherwise(half_up(scov * 0.8, 3))}
    return snap.withColumns(out)


def intel_coverage() -> Column:
    """Mean coverage of the usable deep domains; security counts when partial."""
    part = lambda d: F.when(usable(d) | ((F.lit(d) == "security") & (F.col("security_status") == "PARTIAL")), F.col(f"{d}_coverage")).otherwise(0.0)
    return half_up(sum((part(d) for d in DEEP[1:]), part(DEEP[0])) / float(len(DEEP)), 3)


def holder_intel(df: DataFrame) -> DataFrame:
    """Role-aware wallet-only share when every large holder is resolved, else the provider's."""
    aware = known((F.col("roles_total") > 0) & (F.col("roles_resolved") == F.col("roles_total")) & F.col("wallet_top10").isNotNull())
    none = F.col("raw_top10").isNull() & F.col("provider_top").isNull()
    prov = F.col("provider_top").isNotNull()
    return df.withColumns({
        "role_aware": aware, "holders_status": ladder("PARTIAL", (none, "UNAVAILABLE"), (aware, "AVAILABLE")), "holders_coverage": ladder(0.35, (none, 0.0), (aware, 1.0), (prov, 0.7)),
        "holders_confidence": ladder(0.4, (none, 0.0), (aware, 0.9), (prov, 0.7)), "wallet_pct": half_up(F.col("wallet_top10") * 100, 1), "provider_pct": half_up("provider_top", 1)}).withColumn(
        "holder_pct", F.when(F.col("role_aware"), F.col("wallet_pct")).otherwise(F.when(F.col("holders_status") != "UNAVAILABLE", F.col("provider_pct"))))


# ---- momentum --------------------------------------------------------------------------

# Observation minimums, windows, step sizes and the score of each state.
MIN_POINTS, MIN_SPAN, SLACK = 3, 20 * 60_000, 0.25
FLAT, SPIKE_SHARE, SPIKE_MOVE, VOLATILE, RISING, FALLING = 0.005, 0.7, 0.1, 0.15, 0.03, -0.05
WINDOWS = {"w30m": 30 * 60_000, "w2h": 2 * HOUR_MS, "w6h": 6 * HOUR_MS}
MOMENTUM_SCORE = {"ACCELERATING": 0.85, "SUSTAINED": 0.75, "NEUTRAL": 0.45, "COOLING": 0.35, "UNSTABLE": 0.2, "DECLINING": 0.15}


def momentum(history: DataFrame, now: int, width: int = 6 * HOUR_MS) -> DataFrame:
    """State, score and confidence of each asset's price over the last 24 h.

    ``history(asset, t, price, liquidity, holders)``. Aggregates only: anchors are the newest
    point before a cut, steps come from a bucketed lag, nothing gathers an asset's series.
    """
    pts = history.where((F.col("price") > 0) & (F.col("t") <= now) & (F.lit(now) - F.col("t") <= DAY_MS))
    pts = pts.groupBy("asset", "t").agg(F.min_by(F.struct("price", "liquidity", "holders"), F.struct("price")).alias("v")).select("asset", "t", "v.*")
    base = pts.groupBy("asset").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("tl"), F.max_by("price", "t").alias("pl"), F.min_by("price", "t").alias("p0"))
    j = pts.join(base.select("asset", "tl"), "asset")
    cut = {k: (F.col("t") <= F.col("tl") - w + w * SLACK) & (F.col("t") < F.col("tl")) for k, w in WINDOWS.items()}
    anchors = j.groupBy("asset").agg(*[F.max(F.when(c, F.struct("t", "price"))).alias(k) for k, c in cut.items()])
    base = base.join(anchors, "asset").withColumn("from_t", F.coalesce("w6h.t", "w2h.t", "w30m.t", "t0"))
    steps = lag_across(pts, ["asset"], ["t"], "t", width, {"pt": "t", "pp": "price"}).join(base.select("asset", "from_t"), "asset")
    s = F.when(F.col("pt") >= F.col("from_t"), F.log(F.col("price") / F.col("pp")))
    inside = F.col("t") >= F.col("from_t")
    steps = steps.withColumn("s", s)
    key = lambda c: F.when(inside & F.col(c).isNotNull(), F.col("t"))
    g = steps.groupBy("asset").agg(
        F.count("s").alias("steps"), F.count_if(F.abs("s") >= FLAT).alias("moving"), F.count_if((F.abs("s") >= FLAT) & (F.col("s") > 0)).alias("up"), F.sum(F.abs("s")).alias("abs_sum"), F.max(F.abs("s")).alias("abs_max"),
        F.stddev_pop("s").alias("sd"), F.min_by("liquidity", key("liquidity")).alias("l0"), F.max_by("liquidity", key("liquidity")).alias("l1"), F.max(F.when(inside, F.col("liquidity"))).alias("peak"),
        F.min_by("holders", key("holders")).alias("h0"), F.max_by("holders", key("holders")).alias("h1"))
    m = base.join(g, "asset").withColumn("span", F.col("tl") - F.col("t0"))
    lr = {k: F.when(F.col(k).isNotNull(), F.log(F.col("pl") / F.col(f"{k}.price"))) for k in WINDOWS}
    rate = lambda k: F.col(f"r_{k}") / ((F.col("tl") - F.col(f"{k}.t")) / float(HOUR_MS))
    m = m.withColumns({f"r_{k}": v for k, v in lr.items()})
    m = m.withColumns({
        "pers": F.when(F.col("moving") > 0, F.col("up") / F.col("moving")), "spike": F.when((F.col("steps") >= 3) & (F.col("abs_sum") > 0), F.col("abs_max") / F.col("abs_sum")),
        "vol": F.when(F.col("steps") >= 3, F.col("sd")).otherwise(0.0), "lchg": F.when((F.col("l0") != 0) & (F.col("l1") != 0), half_up(F.col("l1") / F.col("l0") - 1, 3)),
        "ldraw": F.when((F.col("peak") > 0) & F.col("l1").isNotNull(), half_up(F.col("l1") / F.col("peak") - 1, 3)), "move": F.coalesce("r_w6h", "r_w2h", "r_w30m", F.log(F.col("pl") / F.col("p0")))})
    short, mid, long_, p = F.col("r_w30m"), F.col("r_w2h"), F.col("r_w6h"), F.col("pers")
    few = (F.col("n") < MIN_POINTS) | (F.col("span") < MIN_SPAN)
    state = ladder(
        "NEUTRAL", (few, "INSUFFICIENT_HISTORY"), ((F.col("spike") >= SPIKE_SHARE) & (F.abs("move") >= SPIKE_MOVE), "UNSTABLE"), ((F.col("lchg") <= -0.3) & (F.col("move") > 0.2), "UNSTABLE"),
        ((p > 0.35) & (p < 0.65) & (F.col("vol") >= VOLATILE), "UNSTABLE"), (mid.isNull(), F.when(F.coalesce(short, F.col("move")) <= FALLING, "DECLINING").otherwise("NEUTRAL")),
        ((mid > RISING) & (short > 0) & (rate("w30m") > rate("w2h") * 1.2) & (F.coalesce(p, F.lit(0.0)) >= 0.5), "ACCELERATING"), ((mid > RISING) & (F.coalesce(p, F.lit(0.0)) >= 0.55) & (long_.isNull() | (long_ > 0)), "SUSTAINED"),
        (known((mid > 0) & (short <= 0)) | known((long_ > 0) & (mid <= 0)), "COOLING"), ((mid <= FALLING) & (F.coalesce(p, F.lit(1.0)) <= 0.4), "DECLINING"))
    conf = half_up(F.least(F.lit(1.0), F.col("n") / 8.0) * F.least(F.lit(1.0), F.col("span") / float(2 * HOUR_MS)), 3)
    stated = ~few
    return m.withColumn("momentum", state).select(
        "asset", "momentum", lookup("momentum", MOMENTUM_SCORE, F.lit(None).cast("double")).alias("momentum_score"), F.when(stated, conf).otherwise(0.0).alias("momentum_confidence"),
        F.col("n").alias("observations"), F.col("span").alias("span_ms"), *[F.when(stated, half_up(c, 3)).alias(n) for c, n in (("pers", "persistence"), ("spike", "spikiness"))],
        F.when(stated, F.col("lchg")).alias("liquidity_change"), F.when(stated, F.col("ldraw")).alias("liquidity_drawdown"), F.when(stated, F.col("h1") - F.col("h0")).alias("holder_change"))


def decision_history(market: DataFrame, holders: DataFrame, pools: DataFrame, now: int) -> DataFrame:
    """Last 24 h of market rows with holder counts of the same instant; other pools' liquidity nulled."""
    m = market.where(F.lit(now) - F.col("t") <= DAY_MS).join(pools.select("asset", F.col("pool").alias("_own")), "asset", "left")
    liq = F.when(F.col("_own").isNull() | (F.col("pool") == F.col("_own")), F.col("liquidity"))
    return m.withColumn("liquidity", liq).drop("_own").join(holders.select("asset", "t", "holders"), ["asset", "t"], "left")


# ---- integrity -------------------------------------------------------------------------

# Domain weights, bands, actionability, share of secondary families.
DOMAINS = {"tokenSecurity": 0.2, "liquiditySafety": 0.15, "holderIntegrity": 0.15, "activityIntegrity": 0.15, "walletCoordination": 0.15, "creatorReputation": 0.1, "rugHistory": 0.1}
MIN_CONFIDENCE, MIN_COVERAGE, SECONDARY = 0.5, 0.4, 0.25
BAND_RANK = {"UNKNOWN": -1, "CLEAR": 0, "LOW": 1, "ELEVATED": 2, "HIGH": 3, "SEVERE": 4}


def band_of(risk: Column) -> Column:
    return ladder("SEVERE", (risk.isNull(), "UNKNOWN"), (risk < 0.15, "CLEAR"), (risk < 0.3, "LOW"), (risk < 0.5, "ELEVATED"), (risk < 0.7, "HIGH"))


def integrity_contributions(d: DataFrame) -> DataFrame:
    """Long risk contributions (asset, domain, code, family, risk, confidence, coverage).

    Reads the wide decision row: measured values with their confidence (liq, rug and *_conf),
    momentum, holder, activity, wash, coordination, creator and network columns, and per-type
    event counts ev_<type> with the worst status ev_<type>_status.
    """
    c = F.col
    rows = []

    def add(domain, code, family, when, risk, conf, cov=None):
        risk = risk if isinstance(risk, Column) else F.lit(float(risk))
        conf = conf if isinstance(conf, Column) else F.lit(float(conf))
        rows.append(F.when(known(when), F.struct(F.lit(domain).alias("domain"), F.lit(code).alias("code"), F.lit(family).alias("family"), risk.cast("double").alias("risk"),
                                                 conf.cast("double").alias("confidence"), (F.lit(None) if cov is None else cov).cast("double").alias("coverage"))))

    ev = lambda t: c(f"ev_{t}")
    add("tokenSecurity", "RUGCHECK_SCORE", "rugcheck-score", c("rug") > 50, clamp01((c("rug") - 50) / 100), c("rug_conf"))
    add("tokenSecurity", "EXTENSION_PENALTY", "extension", c("penalty_extensions") > 0, 0.3, 1.0)
    add("tokenSecurity", "RUGCHECK_FINDING", "rugcheck-finding", c("token_finding").isNotNull(), F.when(c("token_finding") == "high", 0.35).otherwise(0.15), 0.9)
    add("tokenSecurity", "AUTHORITY_REASSIGNED", "authority-moved", ev("authority").isNotNull(), 0.3, c("event_conf"))
    add("liquiditySafety", "THIN_DEPTH", "depth", c("liq") < 10_000, 0.35, c("liq_conf"))
    add("liquiditySafety", "SHALLOW_DEPTH", "depth", (c("liq") >= 10_000) & (c("liq") < 25_000), 0.2, c("liq_conf"))
    add("liquiditySafety", "LP_FINDING", "lp", c("lp_finding").isNotNull(), F.when(c("lp_finding") == "high", 0.35).otherwise(0.15), 0.9)
    add("liquiditySafety", "LIQUIDITY_DRAIN", "drain", ev("drain").isin("STRONGLY_SUSPECTED", "SUSPICIOUS"), F.when(ev("drain") == "STRONGLY_SUSPECTED", 0.6).otherwise(0.25), c("event_conf"))
    add("liquiditySafety", "LIQUIDITY_COLLAPSE", "drain", c("liquidity_drawdown") <= -0.8, 0.55, 0.8)
    add("liquiditySafety", "LIQUIDITY_LEAVING", "drain", ~known(c("liquidity_drawdown") <= -0.8) & (c("liquidity_change") <= -0.4), 0.3, 0.8)
    pct, other = c("holder_pct"), F.when(c("role_aware"), c("provider_pct"))
    disputed = known((F.greatest(pct, other) >= 3 * F.greatest(F.lit(1.0), F.least(pct, other))) & (F.abs(pct - other) >= 30) & other.isNotNull())
    add("holderIntegrity", "CONCENTRATION", "concentration", pct > 30, F.least(F.lit(0.8), (pct - 30) / 50 * 0.7),
        F.when(disputed & c("holder_finding").isNull(), F.least(c("holders_confidence"), F.lit(MIN_CONFIDENCE - 0.05))).otherwise(c("holders_confidence")))
    add("holderIntegrity", "HOLDER_FINDING", "concentration", c("holder_finding").isNotNull(), F.when(c("holder_finding") == "high", 0.3).otherwise(0.15), 0.9)
    add("holderIntegrity", "CREATOR_DUMP", "insider-selling", ev("dump").isNotNull(), F.when(ev("dump") == "STRONGLY_SUSPECTED", 0.5).otherwise(0.25), c("event_conf"))
    act, a = usable("activity"), c("activity_confidence")
    add("activityIntegrity", "AUTOMATION", "automation", act & (c("automated_share") > 0.4), F.least(F.lit(0.45), (c("automated_share") - 0.4) * 0.9), a)
    add("activityIntegrity", "SNIPERS", "snipers", act & (c("sniper_share") > 0.25), F.least(F.lit(0.6), (c("sniper_share") - 0.25) * 1.2), a)
    add("activityIntegrity", "NO_ORGANIC", "organic-absence", act & (c("trades_classified") >= 0.6) & (c("organic_share") < 0.1), 0.2, a)
    share = F.coalesce(F.when(act, c("coordinated_share")), c("coordinated_wallet_share"))
    add("walletCoordination", "COORDINATION", "coordination", usable("coordination") & (share > 0.1), F.least(F.lit(0.7), (share - 0.1) * 1.2), c("coordination_confidence"), F.when(act, F.least("coordination_coverage", "activity_coverage")).otherwise(c("coordination_coverage")))
    add("walletCoordination", "WASH_HIGH", "manipulation", usable("wash") & (c("wash_raw") == "HIGH"), F.when(c("wash_confidence") >= MIN_CONFIDENCE, 0.65).otherwise(0.4), c("wash_confidence"), c("wash_coverage"))
    add("walletCoordination", "WASH_ELEVATED", "manipulation", usable("wash") & (c("wash_raw") == "ELEVATED"), 0.35, c("wash_confidence"), c("wash_coverage"))
    add("creatorReputation", "CREATOR_MALICIOUS", "history", usable("creator") & (c("creator_level") == "MALICIOUS_HISTORY"), 0.6, c("creator_confidence"))
    add("creatorReputation", "CREATOR_SUSPICIOUS", "history", usable("creator") & (c("creator_level") == "SUSPICIOUS"), F.when(c("other_suspected") >= 2, 0.35).otherwise(0.25), c("creator_confidence"))
    sec = c("security_status").isin("AVAILABLE", "PARTIAL")
    for t, code in (("supply", "SUPPLY_EXPANSION"), ("freeze", "FREEZE_ABUSE")):
        add("rugHistory", code, "token-events", sec & ev(t).isin("STRONGLY_SUSPECTED", "SUSPICIOUS"), F.when(ev(t) == "STRONGLY_SUSPECTED", 0.55).otherwise(0.2), c("event_conf"))
    add("rugHistory", "NETWORK_STRONG", "network", usable("network") & (c("network_level") == "STRONG"), 0.55, c("network_confidence"))
    add("rugHistory", "NETWORK_MODERATE", "network", usable("network") & (c("network_level") == "MODERATE"), 0.35, c("network_confidence"))
    # not sifted inside the array: a higher-order function would keep the whole array out of generated code
    return d.select("asset", F.explode(F.array(*rows)).alias("x")).where("x IS NOT NULL").select("asset", "x.*").where("risk > 0")


def domain_bases(d: DataFrame) -> DataFrame:
    """(asset, domain, coverage, base_confidence) before any contribution."""
    c = F.col
    have = lambda n: c(n).isNotNull()
    tw = [("mint_conf", 0.3), ("freeze_conf", 0.2), ("ext_conf", 0.25), ("rug_conf", 0.25)]
    tcov = sum(F.when(have(n), w).otherwise(0.0) for n, w in tw)
    tconf = sum(F.when(have(n), w * c(n)).otherwise(0.0) for n, w in tw) / F.greatest(tcov, F.lit(1e-9))
    zero = lambda x, ok: F.when(ok, x).otherwise(0.0)
    base = {
        "tokenSecurity": (tcov, tconf), "liquiditySafety": (F.when(have("liq_conf"), 0.7).otherwise(0.0) + F.when(have("rug_conf"), 0.3).otherwise(0.0), F.coalesce("liq_conf", F.lit(0.0))),
        "holderIntegrity": (c("holders_coverage"), c("holders_confidence")), "activityIntegrity": (zero(c("activity_coverage"), usable("activity")), c("activity_confidence")),
        "walletCoordination": ((zero(c("coordination_coverage"), usable("coordination")) + zero(c("wash_coverage"), usable("wash"))) / 2, F.greatest("coordination_confidence", "wash_confidence")),
        "creatorReputation": (zero(c("creator_coverage"), usable("creator")), c("creator_confidence")),
        "rugHistory": ((zero(c("security_coverage"), c("security_status").isin("AVAILABLE", "PARTIAL")) + zero(c("network_coverage"), usable("network"))) / 2, F.greatest("security_confidence", "network_confidence"))}
    rows = [F.struct(F.lit(k).alias("domain"), v[0].cast("double").alias("coverage"), v[1].cast("double").alias("base_confidence")) for k, v in base.items()]
    return d.select("asset", F.explode(F.array(*rows)).alias("x")).select("asset", "x.*")


def build_domains(contributions: DataFrame, bases: DataFrame) -> DataFrame:
    """Risk, band and confidence per (asset, domain): the strongest family plus a quarter of the rest.

    Every step groups or joins by a key that begins with the asset, and the join is by the asset alone, so
    tables that already lie by asset are not shuffled again.
    """
    fam = contributions.groupBy("asset", "domain", "family").agg(F.max(F.struct("risk", "confidence", "coverage")).alias("c"))
    g = fam.groupBy("asset", "domain").agg(F.max(F.struct(F.col("c.risk").alias("risk"), F.col("c.confidence").alias("confidence"), F.col("c.coverage").alias("coverage"))).alias("top"), F.sum(F.col("c.risk").cast("decimal(12,9)")).cast("double").alias("total"))
    tops = g.where("asset IS NOT NULL AND domain IS NOT NULL").groupBy("asset").agg(F.map_from_entries(F.collect_list(F.struct("domain", F.struct("top", "total")))).alias("_tops"))
    j = bases.join(tops, "asset", "left").withColumn("_top", F.try_element_at("_tops", "domain")).select("asset", "domain", "coverage", "base_confidence", "_top.top", "_top.total")
    risk = F.when(F.col("top").isNotNull(), clamp01(F.col("top.risk") + (F.col("total") - F.col("top.risk")) * SECONDARY)).when(F.col("coverage") > 0, 0.0)
    j = j.withColumns({"risk0": risk, "conf0": F.coalesce("top.confidence", "base_confidence"), "ecov": F.least("coverage", F.coalesce("top.coverage", "coverage"))})
    b = band_of(F.col("risk0"))
    weak = (F.col("conf0") < MIN_CONFIDENCE) | (F.col("ecov") < MIN_COVERAGE)
    return j.select("asset", "domain", half_up("risk0", 3).alias("risk"), F.when(b.isin("HIGH", "SEVERE") & weak, "ELEVATED").otherwise(b).alias("band"), half_up("conf0", 3).alias("confidence"), half_up(clamp01("coverage"), 3).alias("coverage"), "ecov")


def integrity(domains: DataFrame) -> DataFrame:
    """Coverage-weighted score, risk and confidence with the driving domain; two elevated make HIGH."""
    d = domains.withColumns({"w": lookup("domain", DOMAINS), "rank": lookup("band", BAND_RANK), "r": F.coalesce("risk", F.lit(0.0))})
    # Weights, coverages and risks have at most three digits, so decimal sums are exact in any order.
    dec = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(5,3)")
    wc = dec("w") * dec("coverage")
    total = lambda x: F.sum(x).cast("double")
    order = F.struct("rank", "r", (-lookup("domain", {k: i for i, k in enumerate(DOMAINS)})).alias("o"))
    g = d.groupBy("asset").agg(
        total(dec("w")).alias("tw"), total(wc).alias("cw"), total(wc * (1 - dec("r"))).alias("earned"), total(wc * dec("r")).alias("risky"), total(wc * dec("confidence")).alias("confy"),
        F.max_by(F.struct("domain", "band"), order).alias("top"), F.count_if((F.col("band") == "ELEVATED") & (F.col("ecov") >= MIN_COVERAGE) & (F.col("confidence") >= MIN_CONFIDENCE)).alias("elevated"))
    cov = F.col("cw") / F.col("tw")
    band = ladder(F.when(F.col("top.band") == "UNKNOWN", "CLEAR").otherwise(F.col("top.band")), (cov < 0.25, "UNKNOWN"), (F.col("top.band").isin("SEVERE", "HIGH"), F.col("top.band")), (F.col("elevated") >= 2, "HIGH"))
    return g.withColumn("integrity_band", band).select(
        "asset", "integrity_band", F.when(cov > 0, half_up(F.col("earned") / F.col("tw") * 100, 1)).alias("integrity_score"), half_up(F.when(F.col("cw") > 0, F.col("risky") / F.col("cw")).otherwise(0.0), 3).alias("integrity_risk"),
        half_up(cov, 3).alias("integrity_coverage"), half_up(F.when(F.col("cw") > 0, F.col("confy") / F.col("cw")).otherwise(0.0), 3).alias("integrity_confidence"),
        F.when(~F.col("integrity_band").isin("CLEAR", "UNKNOWN"), F.col("top.domain")).alias("driver"))


# ---- opportunity -----------------------------------------------------------------------

# How independent each kind of trader counts, and the component weights.
INDEPENDENCE = {"organic": 1.0, "automated": 0.5, "sniper": 0.25}
OPPORTUNITY = {"participation": 0.22, "capital": 0.18, "liquidity": 0.18, "distribution": 0.12, "momentum": 0.2, "maturity": 0.1}


def effective_participants() -> Column:
    """Independent traders: organic 1, automated ½, sniper ¼, one per coordinated cluster; five wallets needed."""
    clusters = F.when(F.col("coordinated_n") > 0, F.greatest(F.lit(1), F.least("coordinated_n", F.coalesce("clusters", F.lit(1))))).otherwise(0)
    n = sum(F.col(f"{k}_n") * w for k, w in INDEPENDENCE.items()) + clusters
    return F.when(usable("activity") & known(F.col("trading_wallets") >= 5), n)


def opportunity(d: DataFrame) -> DataFrame:
    """Six null-aware components, score, coverage and band."""
    def combine(*parts):
        total = sum(w for w, _ in parts)
        have = sum(F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts)
        value = sum(F.when(v.isNotNull(), w * v).otherwise(0.0) for w, v in parts) / total
        return F.when(have > 0, value), have / total

    c = F.col
    d = d.withColumn("effective", effective_participants())
    quality = F.when(usable("activity") & c("organic_vol").isNotNull(), clamp01(sum(c(f"{k}_vol") * w for k, w in INDEPENDENCE.items())))
    pct = c("holder_pct")
    parts = {
        "participation": combine((0.6, log_band_hard("effective", 3, 60)), (0.4, log_band_hard("holders", 50, 5_000))), "capital": combine((0.6, quality), (0.4, c("c_activity"))),
        "liquidity": (c("c_liquidity"), F.when(c("c_liquidity").isNotNull(), 1.0).otherwise(0.0)), "distribution": (1 - clamp01((pct - 15) / 60), F.when(pct.isNull(), 0.0).when(c("role_aware"), 1.0).otherwise(0.7)),
        "momentum": (c("momentum_score"), F.when(c("momentum_score").isNotNull(), 1.0).otherwise(0.0)), "maturity": combine((0.7, c("c_age")), (0.3, clamp01(c("span_ms") / float(6 * HOUR_MS))))}
    d = d.withColumns({f"o_{k}": half_up(v, 3) for k, (v, _) in parts.items()} | {f"oc_{k}": half_up(cv, 3) for k, (_, cv) in parts.items()})
    score = sum(F.coalesce(f"o_{k}", F.lit(0.0)) * w for k, w in OPPORTUNITY.items()) * 100
    cov = sum(c(f"oc_{k}") * w for k, w in OPPORTUNITY.items())
    d = d.withColumns({"_s": score, "_c": cov})
    return d.withColumns({
        "opportunity": half_up("_s", 1), "opportunity_coverage": half_up("_c", 3), "opportunity_band": ladder("WEAK", (c("_c") < 0.4, "UNKNOWN"), (c("_s") >= 65, "STRONG"), (c("_s") >= 45, "MODERATE")),
        "effective": half_up("effective", 1)}).drop("_s", "_c")


# ---- hard fails and verdict ------------------------------------------------------------

# Families of screen vetoes, source confidence, serial and manipulation limits.
FAMILY = {
    "AUTHORITY_MINT_ACTIVE": "CRITICAL_TOKEN_AUTHORITY_RISK", "AUTHORITY_FREEZE_ACTIVE": "CRITICAL_TOKEN_AUTHORITY_RISK", "PERMANENT_DELEGATE_ACTIVE": "CRITICAL_TOKEN_AUTHORITY_RISK",
    "MINT_PAUSABLE": "CRITICAL_TOKEN_AUTHORITY_RISK", "TRANSFER_HOOK_ACTIVE": "CRITICAL_TRANSFER_RESTRICTION", "DEFAULT_ACCOUNT_STATE_FROZEN": "CRITICAL_TRANSFER_RESTRICTION",
    "NON_TRANSFERABLE": "CRITICAL_TRANSFER_RESTRICTION", "EXTREME_TRANSFER_FEE": "CRITICAL_TRANSFER_RESTRICTION", "UNTRADEABLE": "CRITICAL_LIQUIDITY_RISK", "LIQUIDITY_TOO_LOW": "CRITICAL_LIQUIDITY_RISK",
    "CATASTROPHIC_CONCENTRATION": "CRITICAL_HOLDER_CONCENTRATION", "MALFORMED_TOKEN": "DATA_INTEGRITY",
}
SOURCE_CONFIDENCE = {"helius": 1.0, "rugcheck": 0.95, "dexscreener": 0.9, "jupiter": 0.85, "derived": 0.9, "validation": 0.9}
SERIAL_LAUNCHES, SERIAL_PATH, SERIAL_ATTRIBUTION = 2, 0.6, 0.6
MANIP_CONF, MANIP_FAMILIES, MANIP_TRIPS, MANIP_TRADES, MANIP_COV = 0.6, 3, 0.4, 60, 0.6


def describe_vetoes(vetoes: DataFrame, now: int) -> DataFrame:
    """Family, confidence and freshness of screen vetoes (asset, code, nature, source, observed, at)."""
    rug = F.when(F.contains(F.lower("observed"), F.lit("creator history")), "STRONG_SERIAL_RUGGER").otherwise("CONFIRMED_CURRENT_RUG")
    age = F.lit(now) - F.col("at")
    return vetoes.withColumns({
        "family": F.when(F.col("code") == "CRITICAL_RUGCHECK", rug).otherwise(lookup("code", FAMILY, "DATA_INTEGRITY")), "confidence": lookup("source", SOURCE_CONFIDENCE, 0.8),
        "freshness": ladder("STALE", (F.col("nature") == "historical", "FRESH"), (age <= 30 * 60_000, "FRESH"), (age <= 90 * 60_000, "AGING"))})


def hard_fails(d: DataFrame) -> DataFrame:
    """Vetoes that intelligence adds: confirmed rug or malicious asset, serial rugger, extreme manipulation."""
    c = F.col
    trip = usable("wash") & (c("wash_raw") == "HIGH") & (c("wash_confidence") >= MANIP_CONF) & (F.size("wash_families") >= MANIP_FAMILIES) & F.array_contains("wash_families", "ROUND_TRIPS") & (c("round_trip_share") >= MANIP_TRIPS) & (c("wash_trades") >= MANIP_TRADES) & (c("wash_coverage") >= MANIP_COV)
    malicious = F.when(c("best_path") >= SERIAL_PATH, F.coalesce("best_confirmed", F.lit(0))).otherwise(0) + F.when(c("creator_status") == "AVAILABLE", F.coalesce("other_confirmed", F.lit(0))).otherwise(0)
    serial = (c("network_status") == "AVAILABLE") & (c("attribution_raw") == "ATTRIBUTED") & (c("attribution_conf") >= SERIAL_ATTRIBUTION) & (malicious >= SERIAL_LAUNCHES)
    found = codes((c("ev_drain") == "CONFIRMED", "CONFIRMED_CURRENT_RUG"), (known(c("ev_supply") == "CONFIRMED") | known(c("ev_freeze") == "CONFIRMED"), "CONFIRMED_MALICIOUS_TOKEN"),
                  (serial, "STRONG_SERIAL_RUGGER"), (trip, "EXTREME_MARKET_MANIPULATION"))
    return d.select("asset", F.explode(found).alias("code")).withColumn("family", F.col("code"))


# What a top verdict needs, and the rank penalties.
HP = {"market": 0.7, "intel": 0.5, "integrity": 0.6, "opportunity": 65, "opportunity_coverage": 0.7, "momentum": 0.5}
WATCH_COV, QUALIFY_COV = 0.35, 0.6
RISK_PENALTY, UNCERTAINTY_PENALTY = 40, 10


def verdict(d: DataFrame) -> DataFrame:
    """Verdict with blockers and rank. Needs n_fails, market_coverage, intel_coverage and the assessments."""
    c = F.col
    m = c("market_coverage")
    rising = c("momentum").isin("ACCELERATING", "SUSTAINED")
    block = codes(
        (m < HP["market"], "market_coverage"), (c("intel_coverage") < HP["intel"], "intelligence_coverage"), (c("integrity_coverage") < HP["integrity"], "integrity_coverage"), (~c("integrity_band").isin("CLEAR", "LOW"), "integrity_band"),
        (c("opportunity") < HP["opportunity"], "opportunity"), (c("opportunity_coverage") < HP["opportunity_coverage"], "opportunity_coverage"), (~known(rising), "momentum"), (rising & (c("momentum_confidence") < HP["momentum"]), "momentum_confidence"))
    d = d.withColumn("_b", block)
    v = ladder(F.when(F.size("_b") == 0, "HIGH_POTENTIAL").otherwise("QUALIFIED"), (c("n_fails") > 0, "REJECTED"), (m < WATCH_COV, "INSUFFICIENT_DATA"), (c("integrity_band").isin("HIGH", "SEVERE"), "HIGH_RISK"), (m < QUALIFY_COV, "WATCH"))
    d = d.withColumn("verdict", v)
    blockers = F.when(c("verdict") == "WATCH", F.array(F.lit("market_coverage"))).when(c("verdict") == "QUALIFIED", c("_b")).otherwise(F.array().cast("array<string>"))
    return d.withColumns({"blockers": blockers, "rank_score": rank_score()}).drop("_b")


def rank_score() -> Column:
    raw = F.col("opportunity") - RISK_PENALTY * F.col("integrity_risk") - UNCERTAINTY_PENALTY * (1 - F.col("integrity_coverage"))
    return F.when(F.col("verdict") != "REJECTED", half_up(clamp(raw, 0.0, 100.0), 1))


def reasons(decided: DataFrame, contributions: DataFrame, fails: DataFrame, per_kind: int = 5) -> DataFrame:
    """Reason rows per asset: hard fails, positives, the strongest risks, blockers, coverage."""
    top = contributions.groupBy("asset").agg(F.slice(F.reverse(F.array_sort(F.collect_set(F.struct("risk", "code")))), 1, per_kind).alias("r"))
    f = fails.groupBy("asset").agg(F.slice(F.array_sort(F.collect_set("code")), 1, 3).alias("f"))
    j = decided.join(top, "asset", "left").join(f, "asset", "left")
    none = F.array().cast("array<string>")
    c = F.col
    good = codes(((c("effective") >= 10) & (c("oc_participation") >= 0.9), "INDEPENDENT_BUYERS"), (c("o_liquidity") >= 0.6, "HEALTHY_LIQUIDITY"), (c("momentum").isin("SUSTAINED", "ACCELERATING"), F.concat(F.lit("MOMENTUM_"), c("momentum"))),
                 (usable("creator") & (c("creator_level") == "CLEAN"), "CREATOR_CLEAN"), (usable("wash") & (c("wash_raw") == "LOW") & (c("wash_coverage") >= 0.5), "WASH_LOW"))
    risks = F.concat(F.coalesce(F.transform("r", lambda x: x["code"]), none), codes((c("momentum").isin("UNSTABLE", "DECLINING"), F.concat(F.lit("MOMENTUM_"), c("momentum")))))
    kind = lambda k, a: F.transform(a, lambda x: F.struct(F.lit(k).alias("kind"), x.alias("code")))
    all_ = F.concat(kind("hard_fail", F.coalesce("f", none)), kind("positive", good), kind("risk", risks), kind("blocker", c("blockers")), kind("coverage", F.array(F.lit("COVERAGE"))))
    return j.select("asset", F.explode(all_).alias("x")).select("asset", "x.*")


def apply_decision(snapshots: DataFrame, decisions: DataFrame) -> DataFrame:
    """Snapshot with its decided verdict, settled state and the state before."""
    j = snapshots.join(decisions.select("asset", F.col("verdict").alias("decided"), "rank_score"), "asset", "left")
    return j.withColumns({"previous_state": F.col("state"), "state": F.when(F.col("decided").isNull(), F.col("state")).otherwise(settle_state(F.col("state"), F.col("decided"))), "verdict": F.coalesce("decided", "verdict")}).drop("decided")


def redecide(current: DataFrame, touched: DataFrame, linked: DataFrame, decisions: DataFrame) -> DataFrame:
    """Live decided assets whose findings changed: persist the touched, and linked ones that moved."""
    t = touched.select("asset").distinct().withColumn("primary", F.lit(True))
    l = linked.select("asset").distinct().join(t, "asset", "left_anti").withColumn("primary", F.lit(False))
    j = current.where("universe = 'LIVE' AND verdict IS NOT NULL").join(t.unionByName(l), "asset").join(decisions.select("asset", F.col("verdict").alias("next")), "asset")
    return j.select("asset", F.col("verdict").alias("from_verdict"), F.col("next").alias("to_verdict"), "primary", (F.col("verdict") != F.col("next")).alias("changed")).where("primary OR changed")
