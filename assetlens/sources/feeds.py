"""Provider feeds as typed tables: explicit schemas, data-quality rules, issues kept beside values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlens.functions.scalar import exact_ratio, ladder
from assetlens.functions.text import redact
from assetlens.operators.dq import Rule, apply_rules

FRAMES = ["m5", "h1", "h6", "h24"]
# Severities a risk report may state.
LEVELS = ["danger", "warn", "info", "good"]

_SIDE = "struct<buys:string,sells:string>"
PAIR_SCHEMA = (
    "asset string, pairAddress string, dexId string, priceUsd string, liquidity struct<usd:string>, fdv string, pairCreatedAt string, "
    f"volume struct<m5:string,h1:string,h6:string,h24:string>, priceChange struct<m5:string,h1:string,h6:string,h24:string>, txns struct<m5:{_SIDE},h1:{_SIDE},h6:{_SIDE},h24:{_SIDE}>"
)
INFO_SCHEMA = (
    "asset string, symbol string, name string, holderCount string, organicScore string, liquidity string, usdPrice string, firstPool struct<createdAt:string>, "
    "audit struct<mintAuthorityDisabled:string,freezeAuthorityDisabled:string,topHoldersPercentage:string>, stats24h struct<numBuys:string,numSells:string,holderChange:string>"
)
REPORT_SCHEMA = "asset string, score string, score_normalised string, risks array<struct<name:string,level:string,description:string,score:string>>"


def read_feed(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(schema).json(path)


def normalize_pairs(raw: DataFrame, now: int) -> DataFrame:
    """Pair rows with per-frame volume, change, buys and sells, and the issues of each."""
    flat = raw.select(
        "asset", F.col("pairAddress").alias("pool"), F.col("dexId").alias("venue"), F.col("priceUsd").alias("price"), F.col("liquidity.usd").alias("liquidity"), "fdv", F.col("pairCreatedAt").alias("created_at"),
        *[F.col(f"volume.{f}").alias(f"volume_{f}") for f in FRAMES], *[F.col(f"priceChange.{f}").alias(f"change_{f}") for f in FRAMES],
        *[F.col(f"txns.{f}.{s}").alias(f"{s}_{f}") for f in FRAMES for s in ("buys", "sells")])
    rules = [Rule("price", "usd"), Rule("liquidity", "usd"), Rule("fdv", "usd"), Rule("created_at", "time")] + [Rule(f"volume_{f}", "usd") for f in FRAMES] + [Rule(f"change_{f}", "change") for f in FRAMES] + [
        Rule(f"{s}_{f}", "count") for f in FRAMES for s in ("buys", "sells")]
    return apply_rules(flat, rules, now)


def normalize_asset_info(raw: DataFrame, now: int) -> DataFrame:
    flat = raw.select(
        "asset", "symbol", "name", F.col("holderCount").alias("holders"), F.col("organicScore").alias("organic"), "liquidity", F.col("usdPrice").alias("price"), F.col("firstPool.createdAt").alias("first_pool_at"),
        F.col("audit.mintAuthorityDisabled").alias("mint_disabled"), F.col("audit.freezeAuthorityDisabled").alias("freeze_disabled"), F.col("audit.topHoldersPercentage").alias("top_holders"),
        F.col("stats24h.numBuys").alias("buys24h"), F.col("stats24h.numSells").alias("sells24h"), F.col("stats24h.holderChange").alias("holder_change"))
    return apply_rules(flat, [
        Rule("symbol", "text", max_length=40), Rule("name", "text", max_length=80), Rule("holders", "count"), Rule("organic", "percent"), Rule("liquidity", "usd"), Rule("price", "usd"), Rule("first_pool_at", "time"),
        Rule("mint_disabled", "boolean"), Rule("freeze_disabled", "boolean"), Rule("top_holders", "percent"), Rule("buys24h", "count"), Rule("sells24h", "count"), Rule("holder_change", "number")], now)


def normalize_risk_report(raw: DataFrame, now: int) -> DataFrame:
    """Scores and risks; nameless risks drop out, an unknown severity is an issue, not "info"."""
    named = F.filter("risks", lambda r: F.trim(F.coalesce(r["name"], F.lit(""))) != "")
    level = lambda r: F.lower(F.coalesce(F.nullif(F.trim(r["level"]), F.lit("")), F.lit("info")))
    d = apply_rules(raw.withColumn("_named", named), [Rule("score", "usd"), Rule("score_normalised", "percent")], now)
    odd = F.transform(F.filter("_named", lambda r: ~level(r).isin(*LEVELS)), lambda r: F.struct(F.lit("risks.level").alias("field"), F.lit("unrecognised severity").alias("reason"), F.substring(r["level"], 1, 40).alias("received")))
    good = F.transform(F.filter("_named", lambda r: level(r).isin(*LEVELS)), lambda r: F.struct(F.substring(r["name"], 1, 120).alias("name"), level(r).alias("level"), F.substring(F.coalesce(r["description"], F.lit("")), 1, 300).alias("description")))
    return d.select("asset", "score", "score_normalised", good.alias("risks"), F.concat("issues", odd).alias("issues"))


def mint_facts(accounts: DataFrame, holders: DataFrame) -> DataFrame:
    """Authorities, supply and exact concentration per asset.

    ``holders(asset, account, amount)`` with unreadable amounts null: one of those makes the
    whole concentration unknown; a share over one is rejected.
    """
    r = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc_nulls_last("amount"), "account"))
    top = holders.withColumn("_r", r).where("_r <= 10").groupBy("asset").agg(F.sum("amount").alias("raw_top10"), F.max("amount").alias("largest"))
    g = holders.groupBy("asset").agg(F.bool_or(F.col("amount").isNull()).alias("unreadable"), F.count("*").alias("accounts"))
    j = accounts.join(g, "asset", "left").join(top, "asset", "left")
    ok = ~F.coalesce("unreadable", F.lit(True)) & (F.col("supply") > 0)
    share = F.when(ok, exact_ratio("raw_top10", "supply"))
    j = j.withColumn("_s", share)
    return j.select(
        "asset", "mint_authority", "freeze_authority", "mint_stated", "freeze_stated", "decimals", "supply", F.when(ok, F.col("raw_top10")).alias("raw_top10"),
        F.when(F.col("_s") <= 1, F.col("_s")).alias("top10_share"), F.when(F.col("_s") <= 1, exact_ratio("largest", "supply")).alias("largest_share"), "accounts",
        ladder(F.lit(None).cast("string"), (F.col("unreadable"), "holder balance unreadable"), (F.col("_s") > 1, "balances exceed supply")).alias("issue"))


def merge_candidates(feeds: dict[str, DataFrame]) -> DataFrame:
    """One row per asset over all feeds: sources in feed order, first known symbol and name.

    Feeds are numbered, so "first" is by feed order and not by arrival; the source list holds at
    most one entry per feed.
    """
    u = None
    for i, (name, df) in enumerate(feeds.items()):
        f = df.where(F.coalesce("asset", F.lit("")) != "").select("asset", "symbol", "name", F.lit(i).alias("_f"), F.lit(name).alias("_n"))
        u = f if u is None else u.unionByName(f)
    return u.groupBy("asset").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("_f", "_n"))), lambda x: x["_n"]).alias("sources"),
        F.min_by("symbol", F.when(F.col("symbol").isNotNull(), F.struct("_f", "symbol"))).alias("symbol"), F.min_by("name", F.when(F.col("name").isNotNull(), F.struct("_f", "name"))).alias("name"))


# ---- backfill --------------------------------------------------------------------------

STATE_SCHEMA = "tokens map<string, struct<symbol:string,name:string,at:long,score:double,points:array<struct<t:long,price:double,score:double,liquidity:double>>>>"


def backfill_state(docs: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assets, points, skipped) of nested state documents.

    Assets without an id or time are skipped with the reason; points without a time, or with a
    score outside 0-100, are dropped. Text is redacted on the way in.
    """
    e = docs.select(F.explode(F.from_json(column, STATE_SCHEMA)["tokens"]).alias("asset", "v")).select("asset", "v.*")
    why = ladder(F.lit(None).cast("string"), (F.trim(F.coalesce("asset", F.lit(""))) == "", "no id"), (F.col("at").isNull() | (F.col("at") <= 0), "no timestamp"))
    e = e.withColumn("why", why)
    ok = e.where("why IS NULL")
    assets = ok.select("asset", redact("symbol").alias("symbol"), redact("name").alias("name"), "at", "score")
    points = ok.select("asset", F.explode("points").alias("p")).select("asset", "p.*").where("t IS NOT NULL AND t > 0 AND score BETWEEN 0 AND 100")
    return assets, points, e.where("why IS NOT NULL").select("asset", F.col("why").alias("reason"))
