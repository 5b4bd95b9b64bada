"""Wallet behaviour features, buyer classes, activity quality, market coverage, holder roles.

A feature is null when there is too little history to state it; null is never zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlens.functions.durable import cut
from assetlens.functions.scalar import (
    DAY_MS, HOUR_MS, codes, exact_ratio, half_up, known, ladder,
)
from assetlens.functions.skew import exact_median, lag_across, with_halo
from assetlens.operators.graph import first_buys

# Classification thresholds.
MIN_TX, MIN_TRADES = 8, 3
EARLY_SEC, SNIPER_SEC, FRESH_BUYS, EARLY_SHARE = 60, 10, 3, 0.5
SPECIALIST, SPECIALIST_SEC = 5, 300
HFT_RATE, HFT_TX, HFT_HOLD, HFT_TRIPS = 30, 30, 120, 3
REGULAR_CV, REPEATED_SIZE, FAILED_SHARE, BURST, DIVERSITY = 0.35, 0.6, 0.25, 5, 15
ORGANIC_CV, ORGANIC_SIZE, ORGANIC_RATE, ORGANIC_HOLD = 1.0, 0.2, 3, 3600
# Activity quality and market coverage limits.
QUALITY_MIN_COVERAGE, QUALITY_MIN_WALLETS = 0.3, 5
FULL_SAMPLE, FULL_SPAN_MS, NO_COUNTS_WEIGHT = 0.5, 30 * 60_000, 0.5

DAY_SLOTS = 1440  # slots are minutes in the tapes; a hot wallet's day is one unit of work


def wallet_age(tx: DataFrame, trades: DataFrame) -> DataFrame:
    """First sighting, and seconds from it to the first trade."""
    seen = tx.groupBy("wallet").agg(F.min("block_time").alias("first_seen_at"))
    first = trades.groupBy("wallet").agg(F.min_by("block_time", F.struct("slot", "tx_index")).alias("_t"))
    return seen.join(first, "wallet", "left").select(
        "wallet", "first_seen_at", F.col("_t").alias("first_trade_at"),
        F.when(F.col("_t").isNotNull(), F.greatest(F.lit(0.0), (F.col("_t") - F.col("first_seen_at")) / 1000.0))
        .alias("age_at_first_trade_sec"),
    )


def wallet_rates(tx: DataFrame) -> DataFrame:
    """Transactions, span, rate per hour and failed share (five transactions needed)."""
    g = tx.groupBy("wallet").agg(
        F.count("*").alias("transactions"), F.count("block_time").alias("timed"), F.min("block_time").alias("from_ms"),
        F.max("block_time").alias("to_ms"), F.count_if(F.col("status") == "FAILED").alias("failed"),
    )
    hours = F.greatest(F.lit(1.0 / 60), (F.col("to_ms") - F.col("from_ms")) / float(HOUR_MS))
    return g.withColumns({
        "tx_per_hour": F.when(F.col("timed") >= 5, F.col("timed") / hours),
        "failed_share": F.when(F.col("transactions") >= 5, F.col("failed") / F.col("transactions")),
    })


def trade_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy("wallet").agg(
        F.count("*").alias("trades"), F.count_if(F.col("side") == "BUY").alias("buys"),
        F.count_if(F.col("side") == "SELL").alias("sells"), F.countDistinct("asset").alias("token_diversity"),
    )


def entry_speed(trades: DataFrame, launches: DataFrame) -> DataFrame:
    """Delay from launch to a wallet's first buy, summarised over the known launches it entered."""
    d = first_buys(trades).join(launches.select("asset", "launch_time"), "asset").select(
        "wallet", F.greatest(F.lit(0.0), (F.col("block_time") - F.col("launch_time")) / 1000.0).alias("sec")
    ).where(F.col("sec").isNotNull())
    g = d.groupBy("wallet").agg(
        F.count("*").alias("launches_entered"), F.count_if(F.col("sec") <= EARLY_SEC).alias("fresh_launch_buys"),
        F.min("sec").alias("fastest_entry_sec"),
    )
    early = F.when(F.col("launches_entered") >= 3, F.col("fresh_launch_buys") / F.col("launches_entered"))
    return g.withColumn("early_entry_share", early).join(exact_median(d, ["wallet"], "sec", "median_entry_sec"), "wallet")


def cadence(tx: DataFrame, width: int = DAY_SLOTS) -> DataFrame:
    """Coefficient of variation (ten gaps needed) and median of the gaps between transactions."""
    t = tx.where(F.col("block_time").isNotNull()).select("wallet", "slot", "tx_index", "block_time")
    t = lag_across(t, ["wallet"], ["slot", "tx_index"], "slot", width, {"prev": "block_time"})
    gaps = t.where(F.col("prev").isNotNull()).select("wallet", ((F.col("block_time") - F.col("prev")) / 1000.0).alias("gap"))
    g = gaps.groupBy("wallet").agg(F.count("*").alias("gaps"), F.avg("gap").alias("_m"), F.stddev_pop("gap").alias("_s"))
    return g.join(exact_median(gaps, ["wallet"], "gap", "median_of_gaps"), "wallet").select(
        "wallet", "gaps", F.when((F.col("gaps") >= 10) & (F.col("_m") > 0), F.col("_s") / F.col("_m")).alias("cadence_cv"),
        F.when(F.col("gaps") >= 3, F.col("median_of_gaps")).alias("median_gap_sec"), "median_of_gaps",
    )


def burst(tx: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """Most transactions a wallet sent within any ten seconds."""
    t = with_halo(tx.where(F.col("block_time").isNotNull()).select("wallet", "block_time"), "block_time", width_ms, 10_000, 0)
    n = F.count("*").over(Window.partitionBy("wallet", "_b").orderBy("block_time").rangeBetween(-10_000, 0))
    return t.withColumn("n", n).where("_core").groupBy("wallet").agg(F.max("n").alias("burst10s"))


def size_twins(trades: DataFrame) -> DataFrame:
    """(wallet, x, n, twin): each buy size of a wallet, how often it occurs, and whether another buy lies within 1 %.

    Equal amounts collapse to one row; the nearest different amount is a neighbour in sorted
    order, looked for inside overlapping log-size ranges.
    """
    sized = trades.where("side = 'BUY' AND quote_amount > 0").groupBy("wallet", F.col("quote_amount").cast("double").alias("x")).agg(
        F.count("*").alias("n")
    )
    staged = with_halo(sized.withColumn("_ln", F.log("x") * 1000), "_ln", 500, 11, 11)
    w = Window.partitionBy("wallet", "_b").orderBy("x")
    near = lambda o: known(F.abs(o - F.col("x")) <= F.col("x") * 0.01)
    return staged.withColumn("twin", (F.col("n") >= 2) | near(F.lag("x").over(w)) | near(F.lead("x").over(w))).where("_core").select("wallet", "x", "n", "twin")


def repeated_sizes(trades: DataFrame) -> DataFrame:
    """Share of priced buys that have a twin within 1 % (five priced buys needed)."""
    g = size_twins(trades).groupBy("wallet").agg(
        F.sum("n").alias("priced_buys"), F.sum(F.when(F.col("twin"), F.col("n")).otherwise(0)).alias("_r")
    )
    return g.select("wallet", "priced_buys", F.when(F.col("priced_buys") >= 5, F.col("_r") / F.col("priced_buys")).alias("repeated_size_share"))


def round_trip_holds(trades: DataFrame, width: int = DAY_SLOTS) -> DataFrame:
    """One row per buy-then-sell of an asset by a wallet, with the hold in seconds.

    A sell closes when the previous trade was a buy; the hold starts at the first buy of that
    run. After keeping run starts and closes only, a close's predecessor is its opening buy.
    """
    keys, order = ["wallet", "asset"], ["slot", "tx_index"]
    t = lag_across(trades.select(*keys, *order, "side", "block_time"), keys, order, "slot", width, {"prev": "side"})
    opens = (F.col("side") == "BUY") & known(F.col("prev") == "SELL") | ((F.col("side") == "BUY") & F.col("prev").isNull())
    closes = (F.col("side") == "SELL") & (F.col("prev") == "BUY")
    t = t.where(opens | closes).drop("prev")
    t = lag_across(t, keys, order, "slot", width, {"opened": "block_time"})
    return t.where("side = 'SELL'").select("wallet", "asset", ((F.col("block_time") - F.col("opened")) / 1000.0).alias("hold"))


def round_trip_summary(trades: DataFrame) -> DataFrame:
    holds = round_trip_holds(trades)
    g = holds.groupBy("wallet").agg(F.count("*").alias("round_trips"), F.count("hold").alias("_h"))
    return g.join(exact_median(holds, ["wallet"], "hold", "_m"), "wallet", "left").select(
        "wallet", "round_trips", F.col("_h").alias("holds"), F.when(F.col("_h") >= 2, F.col("_m")).alias("median_hold_sec")
    )


TX_COLS = ["wallet", "tx_id", "slot", "tx_index", "block_time", "status"]
TRADE_COLS = ["wallet", "asset", "side", "tx_id", "slot", "tx_index", "block_time", "quote_amount"]


def wallet_features(tx: DataFrame, trades: DataFrame, launches: DataFrame) -> DataFrame:
    """All features, one wide row per wallet. Both tapes are read once and written with the columns they need."""
    return _features(cut(tx.select(TX_COLS)), cut(trades.select(TRADE_COLS)), launches)


def _features(tx: DataFrame, trades: DataFrame, launches: DataFrame) -> DataFrame:
    out = wallet_rates(tx)
    for part in (wallet_age(tx, trades), trade_counts(trades), entry_speed(trades, launches), cadence(tx), burst(tx),
                 repeated_sizes(trades), round_trip_summary(trades)):
        out = out.join(part, "wallet", "left")
    zero = ["trades", "buys", "sells", "token_diversity", "round_trips", "gaps", "priced_buys", "holds"]
    out = out.na.fill(0, zero).withColumn("burst_seen", F.coalesce("burst10s", F.lit(0)))
    return out.withColumn("burst10s", F.when(F.col("timed") >= 5, F.col("burst10s")))


# ---- how sure a feature is, and the transactions it rests on ---------------------------

EVIDENCE_IDS = 5


def feature_evidence(tx: DataFrame, trades: DataFrame, launches: DataFrame) -> DataFrame:
    """(wallet, feature, ids): the earliest five transactions behind each feature that names some.

    Every candidate is one narrow row; the rank limit cuts each task's candidates to five a wallet and
    feature before they are shuffled, so a busy wallet is never gathered.
    """
    at = ["slot", "tx_index", "tx_id"]
    candidate = lambda df, name, key=None: df.select("wallet", F.lit(name).alias("feature"), (F.lit(0.0) if key is None else F.col(key)).alias("key"), *at)
    order = F.struct("slot", "tx_index", "tx_id")
    first = trades.where("side = 'BUY'").groupBy("wallet", "asset").agg(F.min(F.struct(*at, "block_time")).alias("f")).select("wallet", "asset", "f.*")
    entries = first.join(launches.select("asset", "launch_time"), "asset").withColumn("sec", F.greatest(F.lit(0.0), (F.col("block_time") - F.col("launch_time")) / 1000.0)).where("sec IS NOT NULL")
    twins = size_twins(trades).where("twin").select("wallet", "x")
    repeated = trades.where("side = 'BUY' AND quote_amount > 0").withColumn("x", F.col("quote_amount").cast("double")).join(twins, ["wallet", "x"], "left_semi")
    seen = tx.where("block_time IS NOT NULL").groupBy("wallet").agg(F.min(order).alias("f")).select("wallet", "f.*")
    traded = trades.groupBy("wallet").agg(F.min(order).alias("f")).select("wallet", "f.*")
    parts = [
        candidate(seen, "first_seen_at"), candidate(traded, "age_at_first_trade_sec"), candidate(tx.where("status = 'FAILED'"), "failed_share"),
        candidate(entries.where(F.col("sec") <= EARLY_SEC), "fresh_launch_buys"), candidate(entries, "fastest_entry_sec", "sec"), candidate(repeated, "repeated_size_share"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("wallet", "feature").orderBy("key", *at))
    kept = rows.withColumn("n", rank).where(F.col("n") <= EVIDENCE_IDS)
    kept = kept.where((F.col("feature") != "fastest_entry_sec") | (F.col("n") == 1))
    return kept.groupBy("wallet", "feature").agg(F.array_sort(F.collect_list(F.struct("n", "tx_id"))).alias("_e")).select(
        "wallet", "feature", F.transform("_e", lambda x: x["tx_id"]).alias("ids"))


def measured_features(tx: DataFrame, trades: DataFrame, launches: DataFrame, history: DataFrame) -> DataFrame:
    """(wallet, feature, value, quality, evidence): every feature with how sure it is and what it rests on.

    ``history(wallet, complete, earliest_at, earliest_tx)`` says whether the transactions at hand are all of
    a wallet's, and names its first transaction where that is known. A feature is MEASURED on a complete
    history, PARTIAL on part of one, and INSUFFICIENT where there is too little to state it; counts are
    never INSUFFICIENT, only PARTIAL. A wallet that ``history`` does not name counts as incomplete.
    """
    tx, trades = cut(tx.select(TX_COLS)), cut(trades.select(TRADE_COLS))
    f = cut(_features(tx, trades, launches).join(history.select("wallet", "complete", "earliest_at", "earliest_tx"), "wallet", "left"))
    c = F.col
    complete = F.coalesce(c("complete"), F.lit(False))
    window = F.when(complete, "MEASURED").otherwise("PARTIAL")
    enough = lambda cond: F.when(cond, window).otherwise("INSUFFICIENT")
    count = F.when(c("trades") >= MIN_TRADES, window).otherwise("PARTIAL")
    entered = F.coalesce(c("launches_entered"), F.lit(0))
    entry = enough(entered >= 1)
    seen_at = F.when(c("earliest_at").isNotNull(), c("earliest_at")).when(complete, c("first_seen_at"))
    seen = F.when(seen_at.isNotNull(), "MEASURED").otherwise("INSUFFICIENT")
    first_trade = c("first_trade_at")
    age = F.when(seen_at.isNotNull() & first_trade.isNotNull(), F.greatest(F.lit(0.0), (first_trade - seen_at) / 1000.0))
    rules = {
        "first_seen_at": (seen_at, seen), "age_at_first_trade_sec": (age, F.when(age.isNotNull(), "MEASURED").otherwise("INSUFFICIENT")),
        "tx_per_hour": (F.when(c("timed") >= 5, c("tx_per_hour")), enough(c("timed") >= 5)), "failed_share": (c("failed_share"), enough(c("transactions") >= 5)),
        "trades": (c("trades"), count), "buys": (c("buys"), count), "sells": (c("sells"), count), "token_diversity": (c("token_diversity"), count),
        "fresh_launch_buys": (F.coalesce(c("fresh_launch_buys"), F.lit(0)), entry), "early_entry_share": (c("early_entry_share"), enough(entered >= 3)),
        "fastest_entry_sec": (c("fastest_entry_sec"), entry), "median_entry_sec": (c("median_entry_sec"), entry), "launches_entered": (entered, entry),
        "cadence_cv": (c("cadence_cv"), enough(c("cadence_cv").isNotNull())), "median_gap_sec": (c("median_of_gaps"), enough(c("gaps") >= 3)),
        "burst10s": (c("burst_seen"), enough(c("timed") >= 5)), "repeated_size_share": (c("repeated_size_share"), enough(c("priced_buys") >= 5)),
        "round_trips": (c("round_trips"), count), "median_hold_sec": (c("median_hold_sec"), enough(c("holds") >= 2)),
    }
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("value"), q.alias("quality")) for k, (v, q) in rules.items()]))
    rows = f.select("wallet", "earliest_at", "earliest_tx", long.alias("r")).select("wallet", "earliest_at", "earliest_tx", "r.*")
    named = feature_evidence(tx, trades, launches)
    ids = F.when((c("feature") == "first_seen_at") & c("earliest_at").isNotNull(), F.array("earliest_tx")).otherwise(c("ids"))
    # a value that could not be stated rests on nothing
    stated = c("value").isNotNull() & ((c("quality") != "INSUFFICIENT") | ~c("feature").isin("failed_share", "repeated_size_share"))
    return rows.join(named, ["wallet", "feature"], "left").select("wallet", "feature", "value", "quality", F.coalesce(F.when(stated, ids), F.array().cast("array<string>")).alias("evidence"))


def classify_wallets(f: DataFrame, complete: bool = True, entry_sec: str | None = None) -> DataFrame:
    """Buyer class with confidence, signals and counter-signals from the feature row."""
    c = F.col
    span_h = (c("to_ms") - c("from_ms")) / float(HOUR_MS)
    measurable = [
        "tx_per_hour", "failed_share", "cadence_cv", "burst10s", "repeated_size_share", "early_entry_share",
        "median_hold_sec", "first_seen_at",
    ]
    # Token diversity is always stated, if only partially.
    coverage = (sum(c(m).isNotNull().cast("int") for m in measurable) + F.lit(1)) / F.lit(float(len(measurable) + 1))
    this_entry = F.lit(False) if entry_sec is None else (c(entry_sec) <= SNIPER_SEC)
    sniper = codes(
        (this_entry, "EARLY_ENTRY_THIS_TOKEN"), (c("fresh_launch_buys") >= FRESH_BUYS, "REPEATED_EARLY_ENTRY"),
        (c("early_entry_share") >= EARLY_SHARE, "MOSTLY_EARLY"),
        ((c("launches_entered") >= SPECIALIST) & (c("median_entry_sec") <= SPECIALIST_SEC), "LAUNCH_SPECIALIST"),
    )
    ratio = c("sells") / F.nullif(c("buys"), F.lit(0))
    hft = codes(
        ((c("tx_per_hour") >= HFT_RATE) & (c("transactions") >= HFT_TX), "HIGH_RATE"),
        ((c("median_hold_sec") <= HFT_HOLD) & (c("round_trips") >= HFT_TRIPS), "SHORT_HOLDS"),
        ((c("trades") >= 20) & ratio.between(0.7, 1.5), "BALANCED_CHURN"),
    )
    auto = codes(
        (c("cadence_cv") <= REGULAR_CV, "REGULAR_CADENCE"), (c("repeated_size_share") >= REPEATED_SIZE, "REPEATED_SIZES"),
        ((c("failed_share") >= FAILED_SHARE) & (c("transactions") >= 10), "MANY_FAILURES"),
        (c("burst10s") >= BURST, "BURSTS"), ((span_h <= 24) & (c("token_diversity") >= DIVERSITY), "MANY_TOKENS"),
    )
    organic = codes(
        (c("cadence_cv") >= ORGANIC_CV, "IRREGULAR_CADENCE"), (c("repeated_size_share") <= ORGANIC_SIZE, "VARIED_SIZES"),
        (c("tx_per_hour") <= ORGANIC_RATE, "LOW_RATE"),
        (known(c("median_hold_sec") >= ORGANIC_HOLD) | ((c("buys") >= 3) & (c("sells") == 0)), "HOLDS"),
        (c("failed_share") <= 0.05, "FEW_FAILURES"),
    )
    f = f.withColumns({"coverage": coverage, "_sn": sniper, "_hf": hft, "_au": auto, "_or": organic})
    ns, nh, na, no = (F.size(x) for x in ("_sn", "_hf", "_au", "_or"))
    strong = F.array_contains("_sn", "EARLY_ENTRY_THIS_TOKEN") | F.array_contains("_sn", "REPEATED_EARLY_ENTRY")
    f = f.withColumn("classification", ladder(
        "UNKNOWN", ((c("transactions") < MIN_TX) | (c("trades") < MIN_TRADES), "INSUFFICIENT_DATA"),
        ((ns >= 2) & strong, "SNIPER"), (nh >= 2, "HIGH_FREQUENCY_TRADER"), (na + nh >= 2, "AUTOMATED_TRADER"),
        ((no >= 3) & (na + nh == 0) & (ns == 0), "LIKELY_ORGANIC"),
    ))
    cls = c("classification")
    support = ladder(0, (cls == "SNIPER", ns + na), (cls.isin("HIGH_FREQUENCY_TRADER", "AUTOMATED_TRADER"), nh + na),
                     (cls == "LIKELY_ORGANIC", no))
    counter = F.when(cls == "LIKELY_ORGANIC", F.lit(0)).otherwise(no)
    cap = ladder(0.95, (cls == "AUTOMATED_TRADER", 0.9), (cls == "LIKELY_ORGANIC", 0.7))
    base = F.when(support >= 4, 0.85).when(support == 3, 0.75).otherwise(0.6)
    raw = (base - 0.1 * counter) * F.lit(1.0 if complete else 0.85) * (0.5 + 0.5 * c("coverage"))
    conf = half_up(F.greatest(F.lit(0.05), F.least(cap, raw)), 2)
    stated = ~cls.isin("UNKNOWN", "INSUFFICIENT_DATA")
    return f.select(
        "wallet", "classification", F.when(stated, conf).otherwise(F.lit(0.0)).alias("confidence"), "coverage",
        F.when(cls == "LIKELY_ORGANIC", c("_or")).when(cls == "INSUFFICIENT_DATA", F.array().cast("array<string>"))
        .otherwise(F.concat("_sn", "_hf", "_au")).alias("signals"),
        F.when(cls == "INSUFFICIENT_DATA", F.array(F.lit("THIN_HISTORY")))
        .when(cls == "LIKELY_ORGANIC", F.array().cast("array<string>")).otherwise(c("_or")).alias("counter_signals"),
    )


CATEGORIES = ["coordinated", "sniper", "automated", "likely_organic", "unknown"]


def activity_quality(trades: DataFrame, classes: DataFrame, clustered: DataFrame) -> DataFrame:
    """Shares of each trader category by wallets, trades and volume, one row per (asset, measure)."""
    per = trades.groupBy("asset", "wallet").agg(
        F.count("*").cast("double").alias("trades"), F.sum("quote_amount").cast("double").alias("volume")
    ).withColumn("wallets", F.lit(1.0))
    hit = clustered.select("asset", "wallet").distinct().withColumn("_cl", F.lit(True))
    cls = F.col("classification")
    cat = ladder("unknown", (F.col("_cl"), "coordinated"), (cls == "SNIPER", "sniper"),
                 (cls.isin("AUTOMATED_TRADER", "HIGH_FREQUENCY_TRADER"), "automated"), (cls == "LIKELY_ORGANIC", "likely_organic"))
    per = per.join(classes.select("wallet", "classification"), "wallet", "left").join(hit, ["asset", "wallet"], "left").withColumn("cat", cat)
    long = per.select("asset", "cat", "wallets", F.explode(F.create_map(
        F.lit("wallets"), F.col("wallets"), F.lit("trades"), F.col("trades"), F.lit("volume"), F.coalesce("volume", F.lit(0.0))
    )).alias("measure", "weight"))
    g = long.groupBy("asset", "measure").agg(
        F.sum("wallets").alias("_w"), F.sum("weight").alias("total"),
        *[F.sum(F.when(F.col("cat") == k, F.col("weight")).otherwise(0.0)).alias(k) for k in CATEGORIES],
    )
    cov = F.when(F.col("total") == 0, F.lit(0.0)).otherwise((F.col("total") - F.col("unknown")) / F.col("total"))
    g = g.withColumn("_cov", cov)
    show = (F.col("_w") >= QUALITY_MIN_WALLETS) & (F.col("_cov") >= QUALITY_MIN_COVERAGE) & (F.col("total") > 0)
    return g.select(
        "asset", "measure", "total", half_up("_cov", 3).alias("coverage"), F.col("_w").alias("wallet_count"),
        *[F.when(show, half_up(F.col(k) / F.col("total"), 3)).alias(f"{k}_share") for k in CATEGORIES],
        *[F.col(k).alias(f"{k}_count") for k in CATEGORIES],
    )


def quality_status(quality: DataFrame) -> DataFrame:
    """MEASURED / PARTIAL / INSUFFICIENT_DATA per asset from its three measures."""
    g = quality.groupBy("asset").agg(
        F.max("wallet_count").alias("w"), F.min("coverage").alias("worst"), F.bool_or(F.col("unknown_share").isNotNull()).alias("any")
    )
    return g.select("asset", ladder("INSUFFICIENT_DATA", (F.col("w") < QUALITY_MIN_WALLETS, "INSUFFICIENT_DATA"),
                                    (F.col("worst") >= 0.7, "MEASURED"), (F.col("any"), "PARTIAL")).alias("status"), "worst")


def market_coverage(trades: DataFrame, pools: DataFrame, now: int) -> DataFrame:
    """How much of an asset's reported trading the collected trades represent."""
    recent = trades.where(F.col("block_time").isNotNull() & (F.lit(now) - F.col("block_time") <= DAY_MS))
    seen = recent.groupBy("asset", "pool").agg(
        F.count("*").alias("observed"), F.min("block_time").alias("lo"), F.max("block_time").alias("hi")
    )
    p = pools.select("asset", "pool", "volume24h", "txns_h1", "txns24h").join(seen, ["asset", "pool"], "full_outer")
    span = p.groupBy("asset").agg(
        F.sum("observed").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("volume24h").alias("tv")
    ).withColumn("window_ms", F.when(F.col("n") >= 1, F.greatest(F.lit(60_000), F.col("hi") - F.col("lo"))))
    j = p.drop("lo", "hi").join(span.select("asset", "window_ms", "tv"), "asset")
    rate = F.when((F.col("window_ms") <= HOUR_MS) & F.col("txns_h1").isNotNull(), F.col("txns_h1") / float(HOUR_MS)).when(
        F.col("txns24h").isNotNull(), F.col("txns24h") / float(DAY_MS))
    share = F.when(F.col("tv") > 0, half_up(F.coalesce("volume24h", F.lit(0.0)) / F.col("tv"), 3))
    g = j.withColumns({"_rate": rate, "_share": share}).groupBy("asset", "window_ms").agg(
        F.count("*").alias("known_pools"), F.count_if(F.col("observed") > 0).alias("observed_pools"),
        F.coalesce(F.sum("observed"), F.lit(0)).alias("observed_trades"),
        F.sum(F.col("_rate") * F.col("window_ms")).alias("_exp"),
        F.sum(F.when(F.col("observed") > 0, F.col("_share"))).alias("venue_share"),
    )
    expected = F.when(F.col("_exp").isNotNull(), F.greatest(F.lit(1.0), F.col("_exp")))
    g = g.withColumn("_e", expected).withColumn("_s", F.when(F.col("_e").isNotNull(), F.least(F.lit(1.0), F.col("observed_trades") / F.col("_e"))))
    span_factor = F.coalesce(F.least(F.lit(1.0), F.col("window_ms") / float(FULL_SPAN_MS)), F.lit(0.0))
    rep = F.when(F.col("_s").isNotNull(), F.least(F.lit(1.0), F.col("_s") / FULL_SAMPLE) * span_factor).otherwise(
        F.coalesce("venue_share", F.lit(0.0)) * NO_COUNTS_WEIGHT * span_factor)
    return g.select(
        "asset", "known_pools", "observed_pools", "observed_trades", "window_ms", half_up("venue_share", 3).alias("venue_share"),
        half_up("_e", 0).alias("expected_trades"), half_up("_s", 3).alias("sample_share"), half_up(rep, 3).alias("representativeness"),
    )


def holder_roles(holders: DataFrame, owners: DataFrame, address_dim: DataFrame, supply: DataFrame) -> DataFrame:
    """Role-aware concentration per asset.

    ``holders(asset, token_account, amount)``, ``owners(token_account, owner)``,
    ``address_dim(address, is_wallet, venue)`` with venue CURVE / POOL / null, ``supply(asset, supply)``.
    """
    h = (
        holders.join(owners, "token_account", "left")
        .join(address_dim.withColumnRenamed("address", "owner"), "owner", "left").join(supply, "asset", "left")
    )
    role = ladder("UNKNOWN", (F.col("owner").isNull(), "UNKNOWN"), (F.col("venue") == "CURVE", "BONDING_CURVE"),
                  (F.col("venue") == "POOL", "POOL"), (~F.col("is_wallet"), "PROGRAM_OWNED"), (F.col("is_wallet"), "WALLET"))
    h = h.withColumn("role", role)
    order = [F.desc("amount"), F.asc("token_account")]
    raw = F.row_number().over(Window.partitionBy("asset").orderBy(*order))
    top = h.withColumn("_r", raw).where("_r <= 10").groupBy("asset").agg(F.sum("amount").alias("raw10"))
    wal = h.where("role = 'WALLET'").withColumn("_r", raw).where("_r <= 10").groupBy("asset").agg(F.sum("amount").alias("wal10"))
    roles = ["BONDING_CURVE", "POOL", "PROGRAM_OWNED", "WALLET", "UNKNOWN"]
    g = h.groupBy("asset").agg(
        F.max("supply").alias("supply"), F.count("*").alias("total"), F.count("owner").alias("resolved"),
        F.count_if(F.col("role") == "UNKNOWN").alias("_unk"),
        *[F.sum(F.when(F.col("role") == r, exact_ratio("amount", "supply").cast("decimal(18,9)")).otherwise(0)).cast("double").alias(r.lower() + "_share") for r in roles],
    )
    return g.join(top, "asset", "left").join(wal, "asset", "left").select(
        "asset", "total", "resolved", exact_ratio("raw10", "supply").alias("raw_top10_share"),
        F.when(F.col("_unk") == 0, exact_ratio(F.coalesce("wal10", F.lit(0)), "supply")).alias("wallet_top10_share"),
        *[F.col(r.lower() + "_share") for r in roles],
    )
