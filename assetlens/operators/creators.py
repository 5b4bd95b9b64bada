"""Launch attribution, creator history and the assets and wallets linked to a creator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlens.functions.durable import cut
from assetlens.functions.scalar import ladder


def attribute_launches(creations: DataFrame) -> DataFrame:
    """Who launched an asset, from the creating transaction.

    ``creations(asset, tx_id, status, fee_payer, signers, liquidity_creator)``. One signer that
    paid (and funded the pool, if known) gives 0.85; one signer otherwise 0.6; several signers
    are ambiguous.
    """
    d = creations.where("status = 'SUCCESS'").withColumn("deployers", F.array_remove("signers", F.col("asset")))
    n, one = F.size("deployers"), F.get("deployers", F.lit(0))
    paid = (one == F.col("fee_payer")) & (F.col("liquidity_creator").isNull() | (F.col("liquidity_creator") == one))
    return d.select(
        "asset", "tx_id", "fee_payer", "deployers", "liquidity_creator",
        ladder("UNKNOWN", (n == 1, "ATTRIBUTED"), (n > 1, "AMBIGUOUS")).alias("status"),
        F.when(n == 1, one).alias("creator"),
        ladder(0.0, ((n == 1) & paid, 0.85), (n == 1, 0.6)).alias("confidence"),
    )


def launches_of(attributions: DataFrame, launches: DataFrame) -> DataFrame:
    """(creator, asset, launch_time): attributed launches plus those an address paid for."""
    a = attributions.where(F.col("creator").isNotNull()).select("creator", "asset").join(
        launches.select("asset", "launch_time"), "asset", "left")
    p = launches.select(F.col("fee_payer").alias("creator"), "asset", "launch_time").where(F.col("creator").isNotNull())
    return a.select("creator", "asset", "launch_time").unionByName(p).groupBy("creator", "asset").agg(
        F.max("launch_time").alias("launch_time"))


def creator_profiles(launches: DataFrame, events: DataFrame) -> DataFrame:
    """Launch and finding counts per creator with a status. Findings collapse per asset first."""
    per = cut(events.groupBy("asset").agg(*[
        F.count_if(F.col("status") == s).alias(s.lower()) for s in ("CONFIRMED", "STRONGLY_SUSPECTED", "SUSPICIOUS")
    ]))
    g = launches.join(per, "asset", "left").groupBy("creator").agg(
        F.count("*").alias("launches"), F.min("launch_time").alias("first_launch_at"),
        F.max("launch_time").alias("last_launch_at"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("confirmed", "strongly_suspected", "suspicious")],
    )
    return g.withColumn("status", ladder(
        "INSUFFICIENT_HISTORY", (F.col("confirmed") > 0, "MALICIOUS_HISTORY"),
        (F.col("strongly_suspected") + F.col("suspicious") > 0, "SUSPICIOUS"), (F.col("launches") >= 2, "CLEAN"),
    ))


class Circle:
    """Who belongs to the creator of an asset, asked by comparison instead of being listed.

    A wallet is in the circle of an asset when it lies in the component of the asset's creator, or when
    it is named with the asset: the creator, deployers, paying wallets, wallets the creator funded.
    ``home(asset, component)`` has one row an asset, ``members(wallet, component)`` one a wallet, and
    ``named(asset, wallet)`` a few an asset, so nothing grows with launches times members.
    """

    def __init__(self, home: DataFrame, members: DataFrame, named: DataFrame):
        self.home, self.members, self.named = home, members, named

    def flag(self, facts: DataFrame, wallet: str, out: str) -> DataFrame:
        """Add ``out``: whether the fact's wallet is in its asset's circle.

        Facts are dealt by asset, unless they come so, and then by wallet: the few wallets named with an asset
        lie in one row beside its component.
        """
        nothing = F.lit(None).cast(self.home.schema["component"].dataType)
        rows = self.home.select("asset", "component", F.lit(None).cast("string").alias("wallet")).unionByName(
            self.named.select("asset", nothing.alias("component"), "wallet")).where(F.col("asset").isNotNull())
        # gathered after the shuffle: one row an asset before it would be wider than its few rows
        circle = rows.repartition("asset").groupBy("asset").agg(F.min("component").alias("_of_asset"), F.collect_set("wallet").alias("_wallets"))
        named = F.when(F.array_contains("_wallets", F.col(wallet)), F.lit(True))
        at = self.members.select(F.col("wallet").alias(wallet), F.col("component").alias("_of_wallet"))
        j = facts.join(circle, "asset", "left").withColumn("_named", named).drop("_wallets").join(at, wallet, "left")
        inside = F.coalesce("_named", F.col("_of_wallet") == F.col("_of_asset"), F.lit(False))
        return j.withColumn(out, inside).drop("_named", "_of_wallet", "_of_asset")

    def kept(self) -> Circle:
        """The same circles with their tables written once, for several flags."""
        return Circle(cut(self.home), self.members, cut(self.named))

    def sizes(self) -> DataFrame:
        """(asset, wallets, first_wallet) of every circle that is not empty."""
        size = self.members.groupBy("component").agg(F.count("*").alias("n"), F.min("wallet").alias("low"))
        whole = self.home.join(size, "component").select("asset", "n", "low")
        outside = Circle(self.home, self.members, self.named.where(F.lit(False))).flag(self.named.distinct(), "wallet", "_in").where(~F.col("_in"))
        more = outside.groupBy("asset").agg(F.count("*").alias("n"), F.min("wallet").alias("low"))
        return whole.unionByName(more).groupBy("asset").agg(F.sum("n").alias("wallets"), F.min("low").alias("first_wallet"))


def creator_circle(attributions: DataFrame, members: DataFrame, funding: DataFrame, payers: DataFrame) -> Circle:
    """The circles of the attributed assets.

    ``payers(asset, wallet)`` holds fee payers already known to be wallets and not hubs.
    """
    creator = attributions.where(F.col("creator").isNotNull()).select("asset", F.col("creator").alias("wallet"))
    deployers = attributions.select("asset", F.explode("deployers").alias("wallet"))
    funded = creator.join(
        funding.where("classification = 'DIRECT'").select(F.col("funder").alias("wallet"), F.col("wallet").alias("w")), "wallet",
    ).select("asset", F.col("w").alias("wallet"))
    named = creator.unionByName(deployers).unionByName(payers.select("asset", "wallet")).unionByName(funded)
    home = creator.join(members, "wallet").groupBy("asset").agg(F.min("component").alias("component"))
    return Circle(home, members, named)


def linked_assets(assets: DataFrame, attributions: DataFrame, events: DataFrame, launches: DataFrame, per_actor: int = 50) -> DataFrame:
    """Other launches, ``per_actor`` at most each, by the creators and event actors of the assets."""
    a = assets.select("asset").distinct()
    actors = (
        attributions.join(a, "asset", "left_semi").select("asset", F.col("creator").alias("actor"))
        .unionByName(events.join(a, "asset", "left_semi").select("asset", "actor")).where(F.col("actor").isNotNull()).distinct()
    )
    rank = F.row_number().over(Window.partitionBy("creator").orderBy("launch_time", "asset"))
    top = launches.withColumn("_r", rank).where(F.col("_r") <= per_actor).select(F.col("creator").alias("actor"), F.col("asset").alias("linked"))
    return actors.join(top, "actor").where(F.col("linked") != F.col("asset")).select(F.col("linked").alias("asset")).distinct()
