"""Security events per asset from chain facts. ``circle`` tells who belongs to an asset's creator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlens.functions.durable import cut, passing
from assetlens.functions.scalar import DAY_MS, HOUR_MS, known, ladder, lookup
from assetlens.functions.skew import bucket_of, running_sum, with_halo
from assetlens.functions.text import canonical_id
from assetlens.operators.creators import Circle

# Thresholds and the confidence of each status.
SOLD_WITHIN_MS, DUMP_WINDOW_MS = DAY_MS, HOUR_MS
DRAIN_CONFIRMED, DRAIN_SUSPECTED, DUMP_SHARE, DUMP_STRONG = 0.8, 0.3, 0.1, 0.3
DIRECT_READING = 0.9
STATUS_CONFIDENCE = {"CONFIRMED": 0.95, "STRONGLY_SUSPECTED": 0.75, "SUSPICIOUS": 0.5, "UNKNOWN": 0.0}
KNOWN_STATUS = list(STATUS_CONFIDENCE)

EVENT_COLS = ["id", "asset", "type", "status", "actor", "creator_linked", "tx_id", "slot", "at", "amount", "confidence"]


def after_launch(facts: DataFrame, launches: DataFrame) -> DataFrame:
    """Facts that are not the launch itself and not before it; unknown launch keeps everything."""
    j = facts.join(launches.select("asset", "launch_tx", "launch_slot"), "asset", "left")
    own = known(F.col("tx_id") == F.col("launch_tx"))
    return j.where(~own & (F.col("launch_slot").isNull() | (F.col("slot") >= F.col("launch_slot")))).drop("launch_tx", "launch_slot")


def _event(df: DataFrame, kind: str, actor: str, amount) -> DataFrame:
    return df.where(F.col("status").isNotNull()).select(
        canonical_id("SECURITY", F.lit(kind), "asset", "tx_id").alias("id"), "asset", F.lit(kind).alias("type"), "status",
        F.col(actor).alias("actor"), "creator_linked", "tx_id", "slot", "at", amount.cast("double").alias("amount"),
        lookup("status", STATUS_CONFIDENCE).alias("confidence"),
    )


def linked_sales(sells: DataFrame, circle: Circle) -> DataFrame:
    return circle.flag(sells, "wallet", "_in").where("_in").drop("_in")


def sold_after(mints: DataFrame, sales: DataFrame, width: int = DAY_MS) -> DataFrame:
    """Add ``sold``: linked sales from each mint's slot on, within 24 h where both times are known.

    Timed rows use a forward time frame over day buckets, a sale lying in the bucket before its own too. Rows
    without a time fall back to slot order alone, as a split running sum from the newest slot down. Both sums
    follow from a mint's asset, slot and time: narrow rows find them, and the mint itself moves once, to look
    them up.
    """
    point = ["asset", "slot", "at"]
    none = F.lit(0).cast("decimal(38,0)")
    m = mints.select(*point, F.lit(1).alias("_mint"), none.alias("_amt"))
    s = sales.select(*point, F.lit(0).alias("_mint"), F.col("amount").cast("decimal(38,0)").alias("_amt"))
    timed = m.withColumns({"_b": bucket_of("at", width), "_core": F.lit(True)}).unionByName(with_halo(s, "at", width, 0, SOLD_WITHIN_MS))
    w = Window.partitionBy("asset", "_b").orderBy("at").rangeBetween(0, SOLD_WITHIN_MS)
    in_time = timed.where(F.col("at").isNotNull()).withColumn("_t", F.sum("_amt").over(w)).where("_mint = 1")
    neg = m.unionByName(s).withColumn("_neg", -F.col("slot"))
    untimed_amt = F.when(F.col("at").isNull(), F.col("_amt")).otherwise(none)
    by_slot = running_sum(neg, ["asset"], ["_neg", "_mint"], "_neg", 4096, {"_u": untimed_amt, "_a": F.col("_amt")}).where("_mint = 1")
    # joins find no null time: it stands as a number that is none
    when = F.coalesce("at", F.lit(-(2**63))).alias("_when")
    look_up = ["asset", "slot", "_when"]
    base = mints.withColumn("_when", when)
    for sums, values in ((in_time, ["_t"]), (by_slot, ["_u", "_a"])):
        base = base.join(sums.groupBy("asset", "slot", when).agg(*[F.max(v).alias(v) for v in values]), look_up, "left")
    # a mint that lacks one of these finds no sums; those that agree in all meet one another once for each sum
    whole = F.col("asset").isNotNull() & F.col("slot").isNotNull() & F.col("tx_id").isNotNull() & F.col("path").isNotNull()
    t, u, a = (F.when(whole, F.col(c)) for c in ("_t", "_u", "_a"))
    base = base.withColumns({
        "sold": F.when(F.col("at").isNull(), a).otherwise(F.coalesce(t, none) + F.coalesce(u, none)),
        "_same": F.count("*").over(Window.partitionBy(*look_up, "tx_id", "path")),
    })
    meet = F.when(whole & F.col("at").isNotNull(), F.col("_same") * F.col("_same")).when(whole, F.col("_same")).otherwise(F.lit(1))
    return base.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), meet.cast("int")))).drop("_t", "_u", "_a", "_when", "_same", "_copy")


def supply_expansion(mints: DataFrame, sells: DataFrame, circle: Circle, launches: DataFrame) -> DataFrame:
    """Mints after launch; confirmed when the circle received them and sold at least half."""
    # each step is written before the next begins, so the shuffles of one are on disk at a time
    with passing(mints.sparkSession) as keep:
        m = keep(circle.flag(after_launch(mints, launches), "recipient", "to_linked"))
        s = keep(linked_sales(sells, circle).select("asset", "slot", "at", "amount"))
        m = cut(sold_after(m, s).drop("path", "recipient"))
    half = F.col("to_linked") & (F.col("sold") * 2 >= F.col("amount"))
    m = circle.flag(m.withColumn("status", ladder("SUSPICIOUS", (half, "CONFIRMED"), (F.col("to_linked"), "STRONGLY_SUSPECTED"))),
              "authority", "creator_linked")
    return _event(m, "SUPPLY_EXPANSION", "authority", F.col("amount"))


def authority_reassigned(changes: DataFrame, circle: Circle, launches: DataFrame) -> DataFrame:
    """Authority moved to another holder, instead of revoked, after launch."""
    c = after_launch(changes, launches).where(F.col("new_authority").isNotNull()).withColumn("status", F.lit("SUSPICIOUS"))
    return _event(circle.flag(c, "previous_authority", "creator_linked"), "AUTHORITY_REASSIGNED", "previous_authority", F.lit(None))


def freeze_abuse(freezes: DataFrame, circle: Circle, address_dim: DataFrame) -> DataFrame:
    """Freezing holders outside the circle; three or more distinct holders confirm it."""
    f = freezes.where("kind = 'FREEZE'").join(
        address_dim.select(F.col("address").alias("owner"), "is_wallet"), "owner", "left"
    ).where(F.col("owner").isNull() | F.col("is_wallet"))
    f = circle.flag(f, "owner", "_l").where(~F.col("_l"))
    first = F.min_by(F.struct("tx_id", "slot", "at", "authority"), F.struct("slot", "tx_id")).alias("f")
    g = f.groupBy("asset").agg(F.countDistinct("owner").alias("holders"), first).select(
        "asset", "f.*", ladder("SUSPICIOUS", (F.col("holders") >= 3, "CONFIRMED"), (F.col("holders") >= 1, "STRONGLY_SUSPECTED")).alias("status"))
    return _event(circle.flag(g, "authority", "creator_linked"), "FREEZE_ABUSE", "authority", F.lit(None))


def liquidity_drain(removals: DataFrame, circle: Circle, address_dim: DataFrame) -> DataFrame:
    """Large removals of a pool's reserve by a wallet, direct readings only."""
    # a smaller removal is no event, whoever made it
    large = (F.col("confidence") >= DIRECT_READING) & (F.col("reserve_fraction") >= DRAIN_SUSPECTED)
    # the flag leaves the rows dealt by actor
    r = circle.flag(removals.where(large).drop("confidence"), "actor", "creator_linked").join(
        address_dim.where("is_wallet").select(F.col("address").alias("actor")), "actor", "left_semi")
    share = F.coalesce("reserve_fraction", F.lit(0.0))
    r = r.withColumn("status", ladder(
        F.lit(None).cast("string"), (F.col("creator_linked") & (share >= DRAIN_CONFIRMED), "CONFIRMED"),
        (F.col("creator_linked") & (share >= DRAIN_SUSPECTED), "STRONGLY_SUSPECTED"), (share >= DRAIN_CONFIRMED, "SUSPICIOUS")))
    return _event(r, "LIQUIDITY_DRAIN", "actor", F.col("amount"))


def creator_dump(sells: DataFrame, circle: Circle, supply: DataFrame, width: int = DAY_MS) -> DataFrame:
    """Best one-hour sum of the circle's sales as a share of initial supply."""
    s = with_halo(linked_sales(sells, circle), "at", width, 0, DUMP_WINDOW_MS)
    w = Window.partitionBy("asset", "_b").orderBy("at").rangeBetween(0, DUMP_WINDOW_MS)
    s = s.withColumn("_sum", F.sum("amount").over(w)).where("_core")
    best = s.groupBy("asset").agg(F.max_by(
        F.struct("tx_id", "slot", "at", "wallet", F.col("_sum").alias("amount")),
        F.struct("_sum", -F.col("slot"), -F.col("at")),
    ).alias("b")).select("asset", "b.*")
    j = best.join(supply, "asset").where("supply > 0")
    share = F.floor(F.col("amount").cast("decimal(38,0)") * 10_000 / F.col("supply")) / 10_000.0
    j = j.withColumn("status", ladder(F.lit(None).cast("string"), (share >= DUMP_STRONG, "STRONGLY_SUSPECTED"), (share >= DUMP_SHARE, "SUSPICIOUS")))
    return _event(j.withColumn("creator_linked", F.lit(True)), "CREATOR_DUMP", "wallet", F.col("amount"))


def active_events(events: DataFrame, version: str) -> DataFrame:
    """Findings under the current rule version, not superseded, with a known status."""
    return events.where(
        (F.col("rule_version") == version) & F.col("superseded_at").isNull() & F.col("status").isin(*KNOWN_STATUS))


def asset_sells(activity: DataFrame, wallet_trades: DataFrame) -> DataFrame:
    """Sales seen from either side, one per (asset, tx, wallet); the wallet side wins."""
    cols = ["asset", "tx_id", "wallet", "slot", "at", "amount"]
    p = activity.select(*cols, F.lit(0).alias("_p"))
    w = wallet_trades.select(*cols, F.lit(1).alias("_p"))
    return p.unionByName(w).groupBy("asset", "tx_id", "wallet").agg(
        F.max_by(F.struct("slot", "at", "amount"), "_p").alias("v")).select("asset", "tx_id", "wallet", "v.*")
