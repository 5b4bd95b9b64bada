"""Trade derivation from balance deltas: pool side, kind, trader, price, wallet trades, funding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions.scalar import half_up, known, ladder
from assetlens.sources.tables import NATIVE, STABLE
from assetlens.sources.transactions import once

QUOTES = [NATIVE, STABLE]
DEC = "decimal(38,0)"
NATIVE_DECIMALS = 9  # fixed value


def with_moves(norm: DataFrame) -> DataFrame:
    """Normalised transactions with ``moves``: the net change per (owner, asset), token and native together, zeros dropped.

    Made inside the row; a transaction lists a few dozen balances at most.
    """
    move = lambda owner, asset, delta: F.struct(owner.alias("owner"), asset.alias("asset"), delta.cast(DEC).alias("delta"))
    token = F.transform(F.filter("tokens", lambda b: b["owner"].isNotNull()), lambda b: move(b["owner"], b["asset"], b["post"].cast(DEC) - b["pre"]))
    native = F.transform("native", lambda n: move(n["address"], F.lit(NATIVE), n["delta"]))
    d = once(norm.withColumn("_all", F.concat(token, native)))
    return once(d.withColumn("moves", netted(F.col("_all"))).drop("_all"))


def netted(moves: Column) -> Column:
    """(owner, asset, delta) entries summed by owner and asset, zeros dropped."""
    keys = F.array_distinct(F.transform(moves, lambda m: F.struct(m["owner"].alias("owner"), m["asset"].alias("asset"))))
    total = lambda k: F.aggregate(F.filter(moves, lambda m: (m["owner"] == k["owner"]) & (m["asset"] == k["asset"])), F.lit(0).cast(DEC), lambda s, m: (s + m["delta"]).cast(DEC))
    return F.filter(F.transform(keys, lambda k: F.struct(k["owner"].alias("owner"), k["asset"].alias("asset"), total(k).alias("delta"))), lambda m: m["delta"] != 0)


def owner_deltas(norm: DataFrame) -> DataFrame:
    """One row per (tx, owner, asset) with a net change."""
    return with_moves(norm).select("tx_id", F.explode("moves").alias("m")).select("tx_id", "m.*")


def pool_side(norm: DataFrame, watch: DataFrame, address_dim: DataFrame) -> DataFrame:
    """Watched transactions with the owner that is the pool of each (tx, asset, pool).

    The pool itself if it moved the asset; otherwise, of exactly two opposite movers, the only program-owned
    one (inferred). A transaction meets its watch once, with all it moved; only the two movers in question are
    looked up, and rows without a question carry keys of their own so that they do not meet in one task.
    The transactions are merged with their watch: the size of derived arrays is not estimated, and a
    broadcast of either side would pass it through the driver.
    """
    d = with_moves(norm).select("tx_id", "status", "fee_payer", "slot", "block_time", "tokens", "moves").hint("merge")
    d = once(watch.select("tx_id", "asset", "pool").join(d, "tx_id").withColumn("mine", F.filter("moves", lambda m: m["asset"] == F.col("asset"))))
    direct = F.exists("mine", lambda m: m["owner"] == F.col("pool"))
    first, second = F.get("mine", F.lit(0)), F.get("mine", F.lit(1))
    asks = ~direct & (F.size("mine") == 2) & ((first["delta"] > 0) != (second["delta"] > 0))
    own_key = F.concat(F.lit("#"), "tx_id", "asset")
    d = d.withColumns({"_direct": direct, "_one": F.when(asks, first["owner"]).otherwise(own_key), "_two": F.when(asks, second["owner"]).otherwise(own_key)})
    off = address_dim.where("NOT is_wallet").select("address").distinct()
    for end in ("_one", "_two"):
        d = d.join(off.select(F.col("address").alias(end), F.lit(True).alias(f"{end}_off")), end, "left")
    one, two = F.coalesce("_one_off", F.lit(False)), F.coalesce("_two_off", F.lit(False))
    side = F.when(F.col("_direct"), F.col("pool")).when(one & ~two, F.col("_one")).when(two & ~one, F.col("_two"))
    return d.select("tx_id", "asset", "pool", "status", "fee_payer", "slot", "block_time", "tokens", "moves", "mine", F.size("mine").alias("movers"), side.alias("pool_side"), (~F.col("_direct") & (one != two)).alias("inferred"))


def pool_activity(norm: DataFrame, watch: DataFrame, address_dim: DataFrame) -> DataFrame:
    """One row per watched (tx, asset, pool): kind, reason, direction, trader, amounts, price.

    Everything after the pool side follows from the transaction's own row: counter asset, other movers,
    reserve and decimals are read from its balances.
    """
    d = once(pool_side(norm, watch, address_dim))
    ours = lambda m: m["owner"] == F.col("pool_side")
    pool_token = F.get(F.filter("mine", ours), F.lit(0))["delta"]
    counters = F.when(F.col("pool_side").isNotNull(), F.filter("moves", lambda m: ours(m) & (m["asset"] != F.col("asset"))))
    held = F.filter("tokens", lambda b: (b["owner"] == F.col("pool_side")) & (b["asset"] == F.col("asset")))
    d = once(d.withColumns({
        "pool_token": pool_token, "_counters": counters, "pool_pre": F.when(F.size(held) > 0, F.aggregate(held, F.lit(0).cast(DEC), lambda s, b: (s + b["pre"]).cast(DEC))),
        "_others": F.when(pool_token.isNotNull(), F.filter("mine", lambda m: ~ours(m))),
    }))
    opposite = F.filter("_others", lambda m: (m["delta"] > 0) != (F.col("pool_token") > 0))
    mirror = F.filter("_others", lambda m: m["delta"] == -F.col("pool_token"))
    decimals = lambda asset: F.when(asset == NATIVE, NATIVE_DECIMALS).otherwise(F.array_max(F.transform(F.filter("tokens", lambda b: b["asset"] == asset), lambda b: b["decimals"])))
    d = once(d.withColumns({"counters": F.coalesce(F.size("_counters"), F.lit(0)), "q": F.get("_counters", F.lit(0)), "_opposite": opposite, "_mirror": mirror}))
    qd, quote_asset = F.col("q.delta"), F.col("q.asset")
    same_sign = (F.col("pool_token") > 0) == (qd > 0)
    kind = ladder(
        "SWAP", (F.col("status") == "FAILED", "FAILED"), (F.col("movers") == 0, "NO_POOL_ACTIVITY"),
        (F.col("pool_side").isNull(), "UNRESOLVED"), (F.col("counters") != 1, "UNRESOLVED"),
        (same_sign & (F.col("pool_token") > 0), "LIQUIDITY_ADDED"), (same_sign, "LIQUIDITY_REMOVED"),
    )
    n_opposite, n_mirror = F.coalesce(F.size("_opposite"), F.lit(0)), F.coalesce(F.size("_mirror"), F.lit(0))
    j = d.withColumns({"kind": kind, "opposite": n_opposite, "mirror": n_mirror, "mirror_owner": F.get("_mirror", F.lit(0))["owner"], "opposite_owner": F.get("_opposite", F.lit(0))["owner"],
                       "token_decimals": decimals(F.col("asset")), "quote_decimals": decimals(quote_asset)})
    swap, liq = F.col("kind") == "SWAP", F.col("kind").isin("LIQUIDITY_ADDED", "LIQUIDITY_REMOVED")
    reason = F.when(F.col("kind") == "UNRESOLVED", ladder(
        "pool_side_mixed_assets", (F.col("pool_side").isNull(), "pool_side_not_found"), (F.col("counters") == 0, "no_counter_asset")))
    res = F.when(swap, ladder("AMBIGUOUS", (F.col("mirror") == 1, "EXACT"), (F.col("opposite") == 1, "APPROXIMATE"), (F.col("opposite") == 0, "NET_ZERO")))
    j = j.withColumns({"reason": reason, "trader_resolution": res})
    amount, quote = F.abs("pool_token"), F.abs(qd)
    inf = known(F.col("inferred"))
    conf = ladder(
        1.0, (F.col("kind") == "UNRESOLVED", 0.0), (liq, F.when(inf, 0.6).otherwise(0.9)),
        (swap, half_up(F.when(inf, 0.7).otherwise(1.0) * ladder(0.6, (F.col("trader_resolution") == "EXACT", 1.0), (F.col("trader_resolution") == "APPROXIMATE", 0.8)), 2)))
    price = (quote.cast("double") / F.pow(F.lit(10.0), F.col("quote_decimals"))) / (amount.cast("double") / F.pow(F.lit(10.0), F.col("token_decimals")))
    return j.select(
        "tx_id", "asset", "pool", "slot", "block_time", "fee_payer", "kind", "reason", "pool_side", inf.alias("pool_side_inferred"),
        F.when(swap, F.when(F.col("pool_token") > 0, "SELL").otherwise("BUY")).alias("direction"),
        F.when(swap, ladder(F.lit(None).cast("string"), (F.col("mirror") == 1, F.col("mirror_owner")), (F.col("opposite") == 1, F.col("opposite_owner")))).alias("trader"),
        "trader_resolution", F.when(swap | liq, amount).alias("token_amount"), F.when(swap | liq, quote_asset).alias("quote_asset"),
        F.when(swap | liq, quote).alias("quote_amount"), F.when(swap & (price > 0), price).alias("price_in_quote"),
        F.when(liq & (F.col("opposite") == 1), F.col("opposite_owner")).alias("liquidity_actor"),
        F.when((swap | liq) & (F.col("pool_pre") > 0), reserve_fraction(amount, F.col("pool_pre"))).alias("reserve_fraction"), conf.alias("confidence"),
    )


def reserve_fraction(amount, pre):
    """Six-digit truncated share of the reserve, at most one."""
    scaled = amount.cast("decimal(26,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    whole = (scaled - F.pmod(scaled, pre.cast("decimal(26,0)"))) / pre.cast("decimal(26,0)")
    return F.least(F.lit(1.0), whole.cast("decimal(38,0)").cast("double") / 1e6)


def wallet_trades(norm: DataFrame, wallets: DataFrame, stables: tuple[str, ...] = ()) -> DataFrame:
    """Wallet-side trades: a token leg with an opposite quote leg; the fee is added back.

    Legs are paired inside the transaction's row, so the only exchange is the one that keeps the asked wallets.
    Ambiguous legs keep a null quote. ``stables`` are assets that count as the stable quote.
    """
    d = with_moves(norm).where("status = 'SUCCESS'")
    named = lambda a: F.when(a.isin(*stables), STABLE).otherwise(a) if stables else a
    legs = F.transform("moves", lambda m: F.struct(m["owner"].alias("owner"), named(m["asset"]).alias("asset"), m["delta"].alias("delta")))
    fee = F.struct(F.col("fee_payer").alias("owner"), F.lit(NATIVE).alias("asset"), F.col("fee").cast(DEC).alias("delta"))
    d = once(d.select("tx_id", "fee_payer", "slot", "block_time", F.concat(legs, F.when(F.col("fee").isNotNull(), F.array(fee)).otherwise(F.slice(legs, 1, 0))).alias("_legs")))
    d = once(d.withColumn("legs", netted(F.col("_legs"))).drop("_legs"))
    isq = lambda m: m["asset"].isin(*QUOTES)
    t = d.select("tx_id", "fee_payer", "slot", "block_time", "legs", F.explode(F.filter("legs", lambda m: ~isq(m))).alias("leg"))
    t = once(t.withColumn("mine", F.filter("legs", lambda m: m["owner"] == F.col("leg.owner"))).drop("legs"))
    up = F.col("leg.delta") > 0
    paid = F.filter("mine", lambda m: isq(m) & ((m["delta"] < 0) == up))
    single = (F.size(F.filter("mine", lambda m: ~isq(m))) == 1) & (F.size(paid) == 1)
    q = F.get(paid, F.lit(0))
    out = t.where(F.size(paid) >= 1).select(
        F.col("leg.owner").alias("wallet"), "tx_id", F.col("leg.asset").alias("asset"), F.when(up, "BUY").otherwise("SELL").alias("side"), F.abs("leg.delta").alias("token_amount"),
        F.when(single, q["asset"]).alias("quote_asset"), F.when(single, F.abs(q["delta"])).alias("quote_amount"), "slot", "block_time", (F.col("fee_payer") == F.col("leg.owner")).alias("wallet_paid_fee"))
    return out.join(wallets.select("wallet").distinct(), "wallet", "left_semi")


def initial_funding(inbound: DataFrame) -> DataFrame:
    """Oldest successful inbound native transfer (or account creation) of each wallet."""
    ok = inbound.where((F.col("status") == "SUCCESS") & (F.col("src") != F.col("dst")) & (F.col("amount") > 0))
    order = F.struct("slot", "tx_id", F.col("src").alias("funder"), "at")
    first = ok.groupBy(F.col("dst").alias("wallet")).agg(F.min(order).alias("f"), F.min_by("amount", order).alias("amount"))
    return first.select("wallet", "f.funder", "f.tx_id", "amount", "f.slot", "f.at")


def dominant_quote(trades: DataFrame) -> DataFrame:
    """The quote asset of most trades; the one seen first wins a tie."""
    g = trades.where(F.col("quote_asset").isNotNull()).groupBy("asset", "quote_asset").agg(F.count("*").alias("n"), F.min("slot").alias("s"))
    return g.groupBy("asset").agg(F.max_by("quote_asset", F.struct("n", -F.col("s"))).alias("quote_asset"), F.max("n").alias("trades"))
