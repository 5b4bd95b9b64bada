"""Readers for the given Parquet tables and the tapes the operators consume.

Every tape is a projection of whole tables: no sampling, no row caps. The mapping only renames
and types columns, so filters and column pruning reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.functions.scalar import DAY_MS

# The six verdicts from best to worst.
VERDICTS = ["HIGH_POTENTIAL", "QUALIFIED", "WATCH", "INSUFFICIENT_DATA", "HIGH_RISK", "REJECTED"]

NATIVE, STABLE = "NATIVE", "STABLE"


def millis(c: str):
    """Epoch milliseconds of a timestamp column; sessions run in UTC."""
    return F.unix_millis(F.col(c).cast("timestamp"))


class Tables:
    """Lazy access to one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    # ---- tapes -------------------------------------------------------------------------

    def event_facts(self) -> DataFrame:
        """One row per event with the derived key ``k`` and times."""
        return self.read("events").select(
            "event_id", "user_id", "event_type", "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            millis("ts").alias("at"),
            F.round(F.col("value") * 100).cast("decimal(20,0)").alias("cents"),
        )

    def activity(self) -> DataFrame:
        """Trade tape: one row per (tx, pool, asset), failed transactions included."""
        e = self.event_facts()
        side = F.when(F.col("event_type").isin("purchase", "signup"), "BUY").when(
            F.col("event_type").isin("click", "view"), "SELL"
        )
        return e.select(
            F.col("event_id").cast("string").alias("tx_id"),
            F.concat(F.lit("W"), F.col("user_id").cast("string")).alias("wallet"),
            F.concat(F.lit("A"), (F.col("k") % 10).cast("string")).alias("asset"),
            F.concat(F.lit("P"), (F.col("k") % 3).cast("string")).alias("pool"),
            side.alias("side"),
            (F.col("cents") * (F.col("k") % 5 + 1)).cast("decimal(20,0)").alias("token_amount"),
            F.col("cents").alias("quote_amount"),
            F.when(F.col("k") % 7 == 0, STABLE).otherwise(NATIVE).alias("quote_asset"),
            F.floor(F.col("at") / 60_000).alias("slot"),
            F.col("event_id").alias("tx_index"),
            F.col("at").alias("block_time"),
            F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"),
            F.when(F.col("event_type") == "error", "FAILED").otherwise("SWAP").alias("kind"),
        )

    def trades(self) -> DataFrame:
        """Resolved swaps of the tape."""
        return self.activity().where(F.col("status") == "SUCCESS")

    def line_trades(self) -> DataFrame:
        """Second, denser tape from order lines."""
        l = self.read("lineitem")
        o = self.read("orders").select("o_orderkey", "o_custkey")
        return l.join(o, l.l_orderkey == o.o_orderkey).select(
            F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("tx_id"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("wallet"),
            F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("asset"),
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("pool"),
            F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
            F.col("l_quantity").cast("decimal(20,0)").alias("token_amount"),
            F.round(F.col("l_extendedprice") * 100).cast("decimal(20,0)").alias("quote_amount"),
            F.lit(NATIVE).alias("quote_asset"),
            F.floor(millis("l_shipdate") / DAY_MS).alias("slot"),
            millis("l_shipdate").alias("block_time"),
        )

    def line_assets(self) -> DataFrame:
        """Assets that occur on order lines."""
        return self.read("lineitem").select(F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("asset")).distinct()

    def launches(self) -> DataFrame:
        """One launch per order: asset, creator, time."""
        return self.read("orders").select(
            F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("asset"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("creator"),
            millis("o_orderdate").alias("launch_time"),
        )

    def supplier_transfers(self) -> DataFrame:
        """Money edges supplier -> customer, one per order line."""
        t = self.line_trades()
        return t.select(
            F.col("pool").alias("src"), F.col("wallet").alias("dst"), "tx_id", "asset",
            F.col("quote_amount").alias("amount"), "slot", F.col("block_time").alias("at"),
        )

    def claims(self) -> DataFrame:
        """Provider claims about a metric of an entity. Clicks are rejected, errors unreachable."""
        e = self.event_facts()
        metric = F.element_at(
            F.array(*[F.lit(m) for m in ("liquidityUsd", "holders", "priceChange", "organicScore", "ageHours")]),
            F.col("k") % 5 + 1,
        )
        provider = F.element_at(
            F.array(*[F.lit(p) for p in ("helius", "rugcheck", "dexscreener", "jupiter", "other")]),
            (F.col("event_id") % 5 + 1).cast("int"),
        )
        return e.select(
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("asset"),
            metric.alias("metric"), provider.alias("provider"),
            F.when(F.col("event_type").isin("click", "error"), None).otherwise(F.col("value")).alias("value"),
            F.col("at").alias("observed_at"),
            F.when(F.col("event_type") == "click", "failed validation").alias("invalid"),
            F.when(F.col("event_type") == "error", "TIMEOUT").alias("unavailable"),
            F.col("event_id").alias("claim_id"),
        )

    def market(self) -> DataFrame:
        """Market observations per part and day."""
        l = self.read("lineitem")
        return l.groupBy(
            F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("asset"),
            millis("l_shipdate").alias("observed_at"),
        ).agg(
            F.min(F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("pool"),
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("decimal(20,0)")).alias("_cents"),
            F.sum(F.col("l_quantity").cast("decimal(20,0)")).alias("_qty"),
            F.count("*").alias("holders"),
        ).select(
            "asset", "observed_at", "pool", "holders",
            (F.col("_cents").cast("double") / 100.0 / F.col("_qty").cast("double")).alias("price"),
            (F.col("_cents").cast("double") / 100.0).alias("liquidity"),
        )

    def verdicts(self) -> DataFrame:
        """Verdict readings: one per event, the event type standing for the verdict."""
        e = self.event_facts()
        verdict = (
            F.when(F.col("event_type") == "purchase", "HIGH_POTENTIAL")
            .when(F.col("event_type") == "signup", "QUALIFIED")
            .when(F.col("event_type") == "view", "WATCH")
            .when(F.col("event_type") == "click", "HIGH_RISK")
            .otherwise("REJECTED")
        )
        return e.select(
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("asset"),
            F.col("at").alias("observed_at"), verdict.alias("verdict"),
            (F.col("k") * 1.0).alias("score"), (F.col("k") / 100.0).alias("coverage"),
            F.col("value").alias("price"), (F.col("value") * 100).alias("liquidity"),
            F.col("event_id").alias("seq"),
        )

    def address_dim(self) -> DataFrame:
        """Whether an address is a wallet: customers are, suppliers are program-owned."""
        c = self.read("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("address"), F.lit(True).alias("is_wallet"))
        s = self.read("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("address"), F.lit(False).alias("is_wallet"))
        return c.unionByName(s)

    def assets(self) -> DataFrame:
        """Current asset rows from orders: verdict, score, liquidity, age and last-seen time."""
        k = F.col("o_orderkey")
        verdict = F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), F.least(k % 7 + 1, F.lit(6)).cast("int"))
        score = F.floor(F.col("o_totalprice") / 500 + 0.5) / 10.0
        return self.read("orders").select(
            F.concat(F.lit("T"), k.cast("string")).alias("asset"), F.col("o_orderpriority").alias("symbol"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("name"),
            F.when(k % 7 < 6, verdict).alias("verdict"),
            (F.lit(ASSET_NOW) - (F.col("o_custkey") % 180) * 60_000).alias("at"), score.alias("score"),
            F.when((k % 7 != 5) & (k % 5 != 0), score - 5).alias("rank_score"),
            F.when(k % 11 != 0, F.col("o_totalprice")).alias("liquidity"),
            F.when(k % 13 != 0, (k % 1000).cast("double")).alias("age_hours"),
            F.when(k % 17 != 0, (k % 200 - 100).cast("double")).alias("change1h"),
            F.when(k % 19 != 0, F.concat(F.lit("S"), (k % 50).cast("string"))).alias("pool"),
            millis("o_orderdate").alias("launched_at"), k.alias("seq"),
        )


ASSET_NOW = 1_000_000_000_000
