"""Table maintenance as joins and aggregates: idempotent appends, registries, merges, retention.

Parquet has no MERGE, so an upsert is a union and an aggregate by key, written by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.functions.scalar import DAY_MS, known, ladder, lookup

# Order of finding statuses, and what a gap means.
STATUS_RANK = {"UNKNOWN": 0, "SUSPICIOUS": 1, "STRONGLY_SUSPECTED": 2, "CONFIRMED": 3}
PAGE = 1000


def append_idempotent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose natural key is not stored yet, each key once: of several its smallest row."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)) if rest else new.distinct()
    return once.select(*new.columns).join(existing.select(*keys), keys, "left_anti")


def known_keys(page: DataFrame, existing: DataFrame, key: str = "tx_id") -> DataFrame:
    return page.select(key).distinct().join(existing.select(key), key, "left_semi")


def discovery_provenance(sightings: DataFrame) -> DataFrame:
    """First seen, last seen and times seen per (asset, source)."""
    return sightings.groupBy("asset", "source").agg(
        F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"), F.count("*").alias("times_seen"))


def wallet_registry(sightings: DataFrame) -> DataFrame:
    """First and last observation per wallet, with the transaction of the earliest."""
    return sightings.groupBy("wallet").agg(
        F.min("block_time").alias("first_observed_at"), F.max("block_time").alias("last_observed_at"),
        F.min_by("tx_id", F.struct("block_time", "tx_id")).alias("first_tx"))


def wallet_asset_activity(activity: DataFrame) -> DataFrame:
    """Arrival and counts per (wallet, asset), from resolved swaps only."""
    ok = activity.where("status = 'SUCCESS' AND side IS NOT NULL AND wallet IS NOT NULL")
    return ok.groupBy("wallet", "asset").agg(
        F.min("slot").alias("first_slot"), F.min("block_time").alias("first_observed_at"),
        F.min_by("tx_id", F.struct("slot", "tx_id")).alias("first_tx"), F.max("block_time").alias("last_observed_at"),
        F.count_if(F.col("side") == "BUY").alias("buys"), F.count_if(F.col("side") == "SELL").alias("sells"))


def latest_assets(snapshots: DataFrame, sticky: list[str], payload: list[str], order: list[str]) -> DataFrame:
    """Current row per asset: newest payload, and the newest non-null of each sticky column."""
    at = F.struct(*order)
    return snapshots.groupBy("asset").agg(
        F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"),
        *[F.max_by(c, at).alias(c) for c in payload],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in sticky])


def fan_out_history(snapshots: DataFrame) -> dict[str, DataFrame]:
    """Verdict, market, holder, pool and failure history rows of analysed snapshots."""
    s = snapshots
    return {
        "verdicts": s.select("asset", "observed_at", "verdict", "score", "coverage", "is_transition"),
        "market": s.where("price IS NOT NULL OR liquidity IS NOT NULL").select("asset", "observed_at", "price", "liquidity", "volume24h"),
        "holders": s.where("holders IS NOT NULL").select("asset", "observed_at", "holders"),
        "pools": s.select("asset", "observed_at", F.explode("pools").alias("p")).select("asset", "observed_at", "p.*"),
        "failures": s.select("observed_at", F.explode("failures").alias("f")).select("observed_at", "f.*").distinct(),
    }


def write_history(frames: dict[str, DataFrame], root: str, mode: str = "append") -> None:
    """Append each history table under ``root``, partitioned by day and clustered by asset.

    Rows are dealt by day and asset, so a day is written by several tasks and an asset's rows of a day by one.
    """
    for name, df in frames.items():
        out = df.withColumn("dt", F.to_date(F.timestamp_millis("observed_at")))
        if "asset" in df.columns:
            out = out.repartition("dt", F.pmod(F.hash("asset"), F.lit(16))).sortWithinPartitions("dt", "asset")
        out.write.mode(mode).partitionBy("dt").parquet(f"{root}/{name}")


def merge_findings(stored: DataFrame, fresh: DataFrame, version: str, at: int) -> tuple[DataFrame, DataFrame]:
    """(current, revisions) after a detection run with ``version`` over the swept assets.

    Same version and still active keeps the higher status. Another version, or a superseded
    row, is archived and replaced. Older-version rows of swept assets not seen again are
    superseded and archived.
    """
    cols = ["id", "asset", "status", "confidence", "rule_version", "superseded_at", "detected_at"]
    swept = fresh.select("asset").distinct().withColumn("_swept", F.lit(True))
    s = stored.select(F.struct(*cols).alias("s"), "id")
    f = fresh.select(F.struct("id", "asset", "status", "confidence").alias("f"), "id")
    j = s.join(f, "id", "full_outer").withColumn("_asset", F.coalesce("s.asset", "f.asset"))
    j = j.join(swept.withColumnRenamed("asset", "_asset"), "_asset", "left")
    same = known(F.col("s.rule_version") == version) & F.col("s.superseded_at").isNull()
    higher = lookup("s.status", STATUS_RANK, 0) > lookup("f.status", STATUS_RANK, 0)
    stale = F.col("s.superseded_at").isNull() & ~known(F.col("s.rule_version") == version)
    action = ladder(
        "KEEP", (F.col("f").isNotNull() & F.col("s").isNull(), "NEW"), (F.col("f").isNotNull() & same & higher, "KEEP"),
        (F.col("f").isNotNull() & same, "UPDATE"), (F.col("f").isNotNull(), "REINTERPRETED"), (F.col("_swept") & stale, "SUPERSEDED"))
    j = j.withColumn("_a", action)
    put = F.col("_a").isin("NEW", "UPDATE", "REINTERPRETED")
    current = j.select(
        "id", F.col("_asset").alias("asset"),
        F.when(put, F.col("f.status")).otherwise(F.col("s.status")).alias("status"),
        F.when(put, F.col("f.confidence")).otherwise(F.col("s.confidence")).alias("confidence"),
        F.when(put, F.lit(version)).otherwise(F.col("s.rule_version")).alias("rule_version"),
        F.when(put, F.lit(None)).when(F.col("_a") == "SUPERSEDED", F.lit(at)).otherwise(F.col("s.superseded_at")).cast("long").alias("superseded_at"),
        F.when(put, F.lit(at)).otherwise(F.col("s.detected_at")).cast("long").alias("detected_at"))
    revisions = j.where(F.col("_a").isin("REINTERPRETED", "SUPERSEDED")).select(
        "id", F.col("s.asset").alias("asset"), F.col("s.status").alias("status"), F.col("s.rule_version").alias("rule_version"),
        F.lit(at).cast("long").alias("revised_at"), F.lit(version).alias("revised_by"), F.col("_a").alias("change"))
    return current, revisions


def gap_ledger(page: DataFrame, known_tx: DataFrame, budgets: DataFrame, missed: DataFrame | None = None) -> DataFrame:
    """Stretches of a page not collected, per key; ``missed(key, slot)`` are rows that could not be fetched.

    ``page(key, tx_id, slot, failed)``; ``budgets(key, budget, had_cursor)``. Only the newest
    ``budget`` unknown successful rows are chosen; how many fit is found from per-slot counts,
    so no key's page is ranked row by row in one task.
    """
    fresh = page.where(~F.col("failed")).join(known_tx.select("tx_id"), "tx_id", "left_anti")
    per = fresh.groupBy("key", "slot").agg(F.count("*").alias("n"))
    newer = Window.partitionBy("key").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    j = per.withColumn("_before", F.coalesce(F.sum("n").over(newer), F.lit(0))).join(budgets, "key")
    left = F.least(F.col("n"), F.greatest(F.lit(0), F.col("_before") + F.col("n") - F.col("budget")))
    over = j.withColumn("_left", left).where("_left > 0").groupBy("key", "had_cursor").agg(
        F.sum("_left").alias("skipped"), F.min("slot").alias("from_slot"), F.max("slot").alias("to_slot")).select(
        "key", F.when(F.col("had_cursor"), "over_budget").otherwise("before_collection_began").alias("reason"), "skipped", "from_slot", "to_slot")
    full = page.groupBy("key").agg(F.count("*").alias("n"), F.min("slot").alias("to_slot")).join(budgets, "key").where(
        F.col("had_cursor") & (F.col("n") >= PAGE)).select(
        "key", F.lit("page_limit").alias("reason"), F.lit(None).cast("long").alias("skipped"), F.lit(None).cast("long").alias("from_slot"), "to_slot")
    out = over.unionByName(full)
    if missed is None:
        return out
    return out.unionByName(missed.groupBy("key").agg(F.lit("fetch_failed").alias("reason"), F.count("*").alias("skipped"), F.min("slot").alias("from_slot"), F.max("slot").alias("to_slot")))


def newest(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


# Default ages in days, and how many alerts are kept.
RETENTION = {"history": 7, "evidence": 7, "chain": 7, "launch": 30, "token": 30, "diagnostics": 7, "max_events": 2000}


def apply_retention(tables: dict[str, DataFrame], now: int, policy: dict | None = None) -> dict[str, DataFrame]:
    """What each table keeps. Unknown table names are returned unchanged.

    Transition rows outlive the window with their evidence; launches stay while the asset is
    tracked; confirmed findings stay; expiring an asset removes its rows in the child tables.
    """
    p = {**RETENTION, **(policy or {})}
    since = {k: now - p[k] * DAY_MS for k in ("history", "evidence", "chain", "launch", "token", "diagnostics")}
    t, out = tables, dict(tables)

    def keep(name: str, cond) -> None:
        if name in t:
            out[name] = t[name].where(cond)

    keep("assets", F.col("last_seen_at") >= since["token"])
    keep("verdicts", (F.col("observed_at") >= since["history"]) | F.col("is_transition"))
    for name in ("market", "holders", "pools"):
        keep(name, F.col("observed_at") >= since["history"])
    keep("failures", F.col("at") >= since["diagnostics"])
    for name in ("activity", "transfers", "chain_events", "transactions", "wallet_trades"):
        keep(name, F.coalesce("block_time", "recorded_at") >= since["chain"])
    for name in ("wallet_assets", "wallets"):
        keep(name, F.col("last_observed_at") >= since["chain"])
    keep("discoveries", F.col("last_seen_at") >= since["chain"])
    keep("gaps", F.col("recorded_at") >= since["chain"])
    keep("findings", (F.col("detected_at") >= since["token"]) | (F.col("status") == "CONFIRMED"))
    keep("revisions", F.col("revised_at") >= since["token"])
    if "alerts" in t:
        out["alerts"] = t["alerts"].orderBy(F.desc("at"), "id").limit(p["max_events"])
    if "evidence" in t:
        e = t["evidence"]
        old = e.where(F.col("observed_at") < since["evidence"])
        moved = t["verdicts"].where("is_transition").select("snapshot_id")
        out["evidence"] = e.where(F.col("observed_at") >= since["evidence"]).unionByName(old.join(moved, "snapshot_id", "left_semi"))
    if "launches" in t:
        l, stamp = t["launches"], F.coalesce("block_time", "recorded_at")
        tracked = t["assets"].select("asset")
        out["launches"] = l.where(stamp >= since["launch"]).unionByName(l.where(stamp < since["launch"]).join(tracked, "asset", "left_semi"))
    if "assets" in t:
        alive = out["assets"].select("asset")
        for name in ("verdicts", "market", "holders", "pools", "evidence"):
            if name in t:
                out[name] = out[name].join(alive, "asset", "left_semi")
    return out
