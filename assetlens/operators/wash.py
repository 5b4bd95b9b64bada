"""Wash-trading signals per asset. Inputs are trade tapes (asset, wallet, side, amounts, slot)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlens.functions.durable import cut
from assetlens.functions.scalar import clamp, codes, half_up, ladder, sig3
from assetlens.functions.skew import bucket_of, with_halo
from assetlens.operators.graph import components, orient

# Sample minimums and signal thresholds.
MIN_TRADES, MIN_WALLETS, MIN_RESOLVED = 30, 5, 0.5
TOP3_VOLUME, TOP3_TRADES, TRADES_PER_WALLET = 0.6, 0.6, 6
TRIP_SHARE, TRIP_WINDOW_MS, TRIP_TOLERANCE = 0.2, 600_000, 0.05
REPEATED_SHARE, CLUSTER_SHARE, SYNC_SHARE = 0.4, 0.3, 0.1


def _div(num, den):
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def wash_sample(trades: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Trades, wallets, resolved share and whether the sample is large enough."""
    t = trades.groupBy("asset").agg(F.count("*").alias("trades"), F.countDistinct("wallet").alias("wallets"))
    both = t.join(unresolved, "asset", "full_outer").na.fill(0, ["trades", "wallets", "unresolved"])
    total = F.col("trades") + F.col("unresolved")
    both = both.withColumn("coverage", _div(F.col("trades"), total))
    enough = (F.col("trades") >= MIN_TRADES) & (F.col("wallets") >= MIN_WALLETS) & (F.col("coverage") >= MIN_RESOLVED)
    return both.withColumn("enough", enough)


def concentration(trades: DataFrame) -> DataFrame:
    """Share of volume and of trades made by the top three wallets; trades per wallet."""
    per = trades.groupBy("asset", "wallet").agg(
        F.sum(F.coalesce("quote_amount", F.lit(0))).alias("volume"), F.count("*").alias("n")
    )
    totals = per.groupBy("asset").agg(
        F.sum("volume").alias("total_volume"), F.sum("n").alias("trades"), F.count("*").alias("wallets")
    )

    def top3(by: str, out: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc(by), "wallet"))
        return per.withColumn("_r", rank).where("_r <= 3").groupBy("asset").agg(F.sum(by).alias(out))

    floor1 = F.greatest(F.col("total_volume").cast("double"), F.lit(1.0))
    return (
        totals.join(top3("volume", "v3"), "asset").join(top3("n", "n3"), "asset")
        .select(
            "asset", "trades", "wallets", F.col("total_volume").cast("double").alias("total_volume"),
            (F.col("v3").cast("double") / floor1).alias("top3_volume"),
            (F.col("n3") / F.col("trades")).alias("top3_trades"),
            (F.col("trades") / F.col("wallets")).alias("trades_per_wallet"),
        )
    )


def size_repetition(trades: DataFrame) -> DataFrame:
    """Share of trades whose three-digit size recurs at least three times in the asset."""
    sized = trades.select("asset", F.when(F.col("quote_amount") > 0, sig3("quote_amount")).alias("size"))
    per = sized.groupBy("asset", "size").agg(F.count("*").alias("n"))
    again = F.when(F.col("size").isNotNull() & (F.col("n") >= 3), F.col("n")).otherwise(0)
    return per.groupBy("asset").agg((F.sum(again) / F.sum("n")).alias("repeated_share"))


def cluster_volume(trades: DataFrame, clustered: DataFrame) -> DataFrame:
    """Share of volume traded by wallets that belong to a strong cluster for the asset."""
    per = trades.groupBy("asset", "wallet").agg(F.sum(F.coalesce("quote_amount", F.lit(0))).alias("v"))
    hit = clustered.select("asset", "wallet").distinct().withColumn("_in", F.lit(True))
    return (
        per.join(hit, ["asset", "wallet"], "left").groupBy("asset")
        .agg(F.sum(F.when(F.col("_in"), F.col("v")).otherwise(0)).alias("c"), F.sum("v").alias("t"))
        .select("asset", _div(F.col("c"), F.col("t")).alias("cluster_share"))
    )


def synchronized(trades: DataFrame, related: DataFrame) -> DataFrame:
    """Share of trades in slots where two related wallets both trade the asset.

    Goes presence -> related partner -> presence, from the less connected end of each pair, so
    neither a busy slot nor a hub wallet is ever multiplied out.
    """
    here = trades.groupBy("asset", "slot", "wallet").agg(F.count("*").alias("n"))
    partner = here.join(orient(related).withColumnRenamed("lo", "wallet"), "wallet").select(
        "asset", "slot", F.col("hi").alias("wallet")
    )
    hit = partner.join(here.select("asset", "slot", "wallet"), ["asset", "slot", "wallet"], "left_semi")
    hit = hit.select("asset", "slot").distinct().withColumn("_hit", F.lit(True))
    per = here.groupBy("asset", "slot").agg(F.sum("n").alias("n")).join(hit, ["asset", "slot"], "left")
    return per.groupBy("asset").agg(
        (F.sum(F.when(F.col("_hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("sync_share")
    )


TRIP_REACH = 0.0514  # beyond the distance of the logarithms of two amounts 5 % apart


def trip_candidates(trades: DataFrame, related: DataFrame) -> DataFrame:
    """(asset, buy, sell, same_wallet, volume): every sell that could close a buy.

    A sell comes after the buy, at most ten minutes and 5 % in size away, by the same wallet or a related
    one. Trades meet only inside (asset, wallet, ten-minute range, size range). For related wallets the
    trades of the less connected one are given the other's name, so a hub's trades are never multiplied.
    ``buy`` and ``sell`` are (slot, tx_index, tx_id). A trade without a time or amount takes no part.
    """
    t = trades.select("asset", "wallet", "side", "block_time", F.struct("slot", "tx_index", "tx_id").alias("trade"), F.col("token_amount").cast("double").alias("amount"),
                      F.coalesce("quote_amount", F.lit(0)).cast("double").alias("volume"))
    # no amount lies below 1 but 0, which only equals itself
    t = t.where("block_time IS NOT NULL AND amount IS NOT NULL").withColumn("_ln", F.log(F.greatest("amount", F.lit(0.5))))
    links = cut(orient(related))
    lent = t.join(links.select(F.col("lo").alias("wallet"), "hi"), "wallet").withColumn("wallet", F.col("hi")).drop("hi").withColumn("lent", F.lit(True))
    seen = t.withColumn("lent", F.lit(False))
    wide = seen.unionByName(lent)
    wide = with_halo(with_halo(wide, "block_time", 2 * TRIP_WINDOW_MS, TRIP_WINDOW_MS, TRIP_WINDOW_MS).withColumnRenamed("_b", "at").drop("_core"), "_ln", 2 * TRIP_REACH, TRIP_REACH, TRIP_REACH)
    core = seen.withColumn("at", bucket_of("block_time", 2 * TRIP_WINDOW_MS)).withColumn("_b", bucket_of("_ln", 2 * TRIP_REACH))
    key = ["asset", "wallet", "at", "_b"]
    side = lambda df, name: df.select(*key, *[F.col(c).alias(f"{name}_{c}") for c in ("side", "block_time", "trade", "amount", "volume", "lent")])
    # the wide side is copied into neighbouring ranges; the other side stays where it is, so a pair meets once
    met = side(wide, "x").join(side(core, "y"), key)
    buys = F.col("x_side") == "BUY"
    pick = lambda c: F.when(buys, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}"))
    other = lambda c: F.when(buys, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}"))
    # a wallet's own pairs are taken from the buy's side only
    met = met.where((F.col("x_side") != F.col("y_side")) & (F.col("x_lent") | buys))
    fits = (pick("trade") < other("trade")) & (other("block_time") - pick("block_time") <= TRIP_WINDOW_MS) & (
        F.abs(F.col("x_amount") - F.col("y_amount")) <= F.greatest("x_amount", "y_amount") * TRIP_TOLERANCE)
    return met.where(fits).select("asset", pick("trade").alias("buy"), other("trade").alias("sell"), (~F.col("x_lent")).alias("same_wallet"), (F.col("x_volume") + F.col("y_volume")).alias("volume"))


def round_trips(trades: DataFrame, related: DataFrame) -> DataFrame:
    """Matched buy -> sell pairs within ten minutes and 5 % size, same or related wallet.

    Buys in order each take the earliest sell still free. Buys prefer early sells and sells early buys, so
    walking the sells in order, each taking the earliest buy still free, gives the same pairs. Trades that
    cannot compete for each other do not matter to each other: the unit of work is a component of the
    candidate pairs, so a group of related wallets, however busy, falls apart by asset, time and size.
    Candidates of a component are folded as one array, sell by sell.
    """
    candidates = cut(trip_candidates(trades, related))
    node = lambda c: F.concat_ws("/", "asset", F.lit("b" if c == "buy" else "s"), F.col(f"{c}.tx_id"))
    found = components(candidates.select(node("buy").alias("a"), node("sell").alias("b")))
    grouped = candidates.withColumn("node", node("buy")).join(found, "node").groupBy("asset", "component").agg(
        F.array_sort(F.collect_list(F.struct("sell", "buy", "same_wallet", "volume"))).alias("c"))
    begin = F.slice("c", 1, 0)

    def step(taken, x):
        free = ~F.exists(taken, lambda y: (y["sell"] == x["sell"]) | (y["buy"] == x["buy"]))
        return F.when(free, F.concat(taken, F.array(x))).otherwise(taken)

    return grouped.select("asset", F.explode(F.aggregate("c", begin, step)).alias("t")).select(
        "asset", F.col("t.buy.tx_id").alias("buy_tx"), F.col("t.sell.tx_id").alias("sell_tx"), "t.same_wallet", "t.volume")


def wash_signals(trades: DataFrame, related: DataFrame, clustered: DataFrame) -> DataFrame:
    """One wide row of signal values per asset."""
    conc = concentration(trades)
    trips = round_trips(trades, related).groupBy("asset").agg(
        F.sum("volume").alias("trip_volume"), F.sum(F.col("same_wallet").cast("long")).alias("same_trips"),
        F.sum((~F.col("same_wallet")).cast("long")).alias("related_trips"),
    )
    return (
        conc.join(trips, "asset", "left").na.fill(0, ["trip_volume", "same_trips", "related_trips"])
        .join(size_repetition(trades), "asset").join(cluster_volume(trades, clustered), "asset")
        .join(synchronized(trades, related), "asset")
        .withColumn("trip_share", _div(F.col("trip_volume"), F.col("total_volume"))).drop("trip_volume")
    )


def wash_risk(signals: DataFrame, sample: DataFrame) -> DataFrame:
    """Risk level, confidence, triggered families and counter-signals."""
    s = sample.select("asset", "coverage", "enough", "unresolved").join(signals, "asset", "left")
    fam = codes(
        ((F.col("top3_volume") >= TOP3_VOLUME) | (F.col("top3_trades") >= TOP3_TRADES)
         | (F.col("trades_per_wallet") >= TRADES_PER_WALLET), "CONCENTRATION"),
        (F.col("trip_share") >= TRIP_SHARE, "ROUND_TRIPS"),
        (F.col("repeated_share") >= REPEATED_SHARE, "PATTERN"),
        ((F.col("cluster_share") >= CLUSTER_SHARE) | (F.col("sync_share") >= SYNC_SHARE), "RELATIONSHIP"),
    )
    s = s.withColumn("families", F.when(F.col("enough"), fam).otherwise(F.array().cast("array<string>")))
    has = lambda f: F.array_contains("families", f)
    n = F.size("families")
    depth = F.least(F.lit(1.0), F.col("trades") / F.lit(MIN_TRADES * 4))
    conf = half_up(clamp((0.4 + 0.1 * n + 0.3 * depth) * F.col("coverage"), 0.1, 0.9), 2)
    return s.select(
        "asset", "coverage", "trades", "wallets", "families",
        ladder("LOW", (~F.col("enough"), "INSUFFICIENT_DATA"),
               (has("ROUND_TRIPS") & (has("RELATIONSHIP") | has("CONCENTRATION")), "HIGH"), (n >= 2, "ELEVATED")
               ).alias("risk"),
        F.when(F.col("enough"), conf).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(F.col("enough"), codes(
            (F.col("wallets") / F.col("trades") >= 0.5, "MANY_WALLETS"), (~has("CONCENTRATION"), "NOT_CONCENTRATED"),
            (~has("PATTERN"), "SIZES_VARY"), (~has("ROUND_TRIPS"), "NO_ROUND_TRIPS"),
        )).otherwise(F.array().cast("array<string>")).alias("counter_signals"),
        *[half_up(c, 3).alias(c) for c in ("top3_volume", "top3_trades", "trades_per_wallet", "trip_share",
                                            "repeated_share", "cluster_share", "sync_share")],
    )


def wash_analysis(trades: DataFrame, unresolved: DataFrame, related: DataFrame, clustered: DataFrame) -> DataFrame:
    """The whole analysis; the related pairs are materialised once since four steps read them."""
    related = cut(related)
    return wash_risk(wash_signals(trades, related, clustered), wash_sample(trades, unresolved))
