"""History, ranking and reporting reads over the append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlens.functions.scalar import DAY_MS, codes, half_up, known, ladder
from assetlens.functions.durable import cut
from assetlens.functions.skew import global_median, lag_across
from assetlens.operators.place import tier


def history_points(verdicts: DataFrame, market: DataFrame, asset: str, n: int) -> DataFrame:
    """Newest ``n`` verdict rows of an asset with the market row of the same instant, oldest first."""
    v = verdicts.where(F.col("asset") == asset).orderBy(F.desc("observed_at"), F.desc("seq")).limit(n)
    m = market.where(F.col("asset") == asset).select("observed_at", "price", "liquidity")
    return v.select("asset", "observed_at", "seq", "score").join(m, "observed_at", "left").orderBy("observed_at", "seq")


def range_scan(series: DataFrame, asset: str, since: int, until: int, n: int) -> DataFrame:
    """A series of one asset in [since, until], oldest first; filters reach the partitioned scan."""
    hit = (F.col("asset") == asset) & F.col("observed_at").between(since, until)
    return series.where(hit).orderBy("observed_at").limit(n)


def recent_transitions(verdicts: DataFrame, assets: DataFrame, n: int) -> DataFrame:
    """Newest transitions with symbols. The top-n runs before the join."""
    t = verdicts.where("is_transition").orderBy(F.desc("observed_at"), "seq").limit(n)
    return t.join(assets.select("asset", "symbol"), "asset", "left")


def verdict_changes(verdicts: DataFrame, assets: DataFrame, market: DataFrame, since: int | None = None, n: int | None = None, width: int = 30 * DAY_MS) -> DataFrame:
    """Transitions with the previous transition's verdict; ``since`` filters after the lag."""
    t = verdicts.where(F.col("is_transition") & F.col("verdict").isNotNull())
    t = lag_across(t, ["asset"], ["observed_at", "seq"], "observed_at", width, {"prev_verdict": "verdict", "prev_at": "observed_at"})
    if since is not None:
        t = t.where(F.col("observed_at") >= since)
    if n is not None:
        t = t.orderBy(F.desc("observed_at"), F.desc("seq")).limit(n)
    t = t.join(assets.select("asset", "symbol"), "asset", "left")
    return t.join(market.select("asset", "observed_at", F.col("price").alias("price_at"), F.col("liquidity").alias("liquidity_at")), ["asset", "observed_at"], "left")


def latest_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence rows of each asset's newest snapshot."""
    last = evidence.groupBy("asset").agg(F.max("snapshot_id").alias("snapshot_id"))
    return evidence.join(last, ["asset", "snapshot_id"], "left_semi")


def provider_failure_summary(failures: DataFrame, since: int) -> DataFrame:
    """Count and last time since a moment; last kind and message overall."""
    key = F.struct("at", "seq")
    recent = F.col("at") >= since
    return failures.groupBy("provider").agg(
        F.count_if(recent).alias("n"), F.max(F.when(recent, F.col("at"))).alias("last_at"),
        F.max_by("kind", key).alias("last_kind"), F.max_by("message", key).alias("last_message")).where("n > 0")


def previous_snapshot(verdicts: DataFrame, market: DataFrame) -> DataFrame:
    """Latest verdict row per asset with its market row."""
    cols = ["observed_at", "seq", "verdict", "score", "coverage"]
    v = verdicts.groupBy("asset").agg(F.max_by(F.struct(*cols), F.struct("observed_at", "seq")).alias("v")).select("asset", "v.*")
    return v.join(market.select("asset", "observed_at", "price", "liquidity"), ["asset", "observed_at"], "left")


def backbone_stats(tx: DataFrame, now: int) -> DataFrame:
    """Totals, last hour, failures, kinds and newest time in one pass."""
    hour = F.col("block_time") >= now - 3_600_000
    return tx.agg(
        F.count("*").alias("transactions"), F.count_if(hour).alias("last_hour"), F.count_if(hour & (F.col("status") == "FAILED")).alias("failed_last_hour"),
        F.count_if(F.col("kind") == "SWAP").alias("swaps"), F.count_if(F.col("kind") == "FAILED").alias("failed"),
        F.max("block_time").alias("latest_block_time"))


def count_by(df: DataFrame, what: str, key: str) -> DataFrame:
    return df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "key", "n")


def intel_stats(groups: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Counts by class, type, level or status over the intelligence tables."""
    out = None
    for what, (df, key) in groups.items():
        c = count_by(df, what, key)
        out = c if out is None else out.unionByName(c)
    return out


def chain_lead(discoveries: DataFrame, launches: DataFrame, since: int) -> DataFrame:
    """Median lead of chain discovery over the first feed, and of the feed behind the launch."""
    chain = F.col("source").startswith("chain:")
    g = discoveries.groupBy("asset").agg(
        F.min(F.when(chain & (F.col("first_seen_at") >= since), F.col("first_seen_at"))).alias("chain_at"),
        F.min(F.when(~chain, F.col("first_seen_at"))).alias("feed_at")).where("chain_at IS NOT NULL AND feed_at IS NOT NULL")
    j = cut(g.join(launches.select("asset", "launch_time"), "asset", "left").select((F.col("feed_at") - F.col("chain_at")).alias("lead"), (F.col("feed_at") - F.col("launch_time")).alias("delay")))
    lead, delay = (global_median(j, c, upper=True) for c in ("lead", "delay"))
    rows = j.agg(F.count("*").alias("assets")).where("assets > 0")
    return rows.withColumns({"median_lead_ms": F.lit(lead).cast("double"), "median_feed_delay_ms": F.lit(delay).cast("double")})


def recent_intel(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` most recently analysed assets, latest row each."""
    return rows.groupBy("asset").agg(F.max("at").alias("at"), F.max_by("status", F.struct("at", "seq")).alias("status")).orderBy(F.desc("at"), "asset").limit(n)


def change_feed(changes: DataFrame) -> DataFrame:
    """Label each change: first assessment, better, worse or same."""
    up, down = tier("verdict") < tier("prev_verdict"), tier("verdict") > tier("prev_verdict")
    first = F.col("prev_verdict").isNull()
    return changes.withColumns({"kind": F.when(first, "first").otherwise("changed"),
                                "direction": ladder("same", (first, "new"), (up, "up"), (down, "down"))})


MEASURED = ["MEASURED", "CONFLICTED"]
# The steps of the coverage histogram.
COVERAGE_STEPS = [(float("-inf"), 0.35), (0.35, 0.6), (0.6, 0.8), (0.8, float("inf"))]


def signal_counts(ledger: DataFrame) -> DataFrame:
    """Measured out of eligible signals per asset; only weighted metrics are eligible."""
    m = F.col("state").isin(*MEASURED)
    return ledger.where("weight > 0").groupBy("asset").agg(F.count_if(m).alias("measured"), F.count("*").alias("signals"))


def unknown_signals(ledger: DataFrame) -> DataFrame:
    return ledger.where((F.col("weight") > 0) & ~F.col("state").isin(*MEASURED)).select("asset", "metric", "state")


def watchpoints(df: DataFrame, floor: float = 3_000, qualify: float = 0.6, watch: float = 0.35, concentration: float = 90) -> DataFrame:
    """Distance-to-threshold notes per asset, one row each.

    ``top_holders`` counts only where its state is measured or conflicted and the audit feed gave it
    (``top_state``, ``top_audited``).
    """
    v, c = F.col("verdict"), F.col("coverage")
    live = v != "REJECTED"
    notes = codes(
        (live & (F.col("liquidity") > 0) & (F.col("liquidity") < floor * 3), "LIQUIDITY_NEAR_FLOOR"),
        (v.isin("QUALIFIED", "HIGH_POTENTIAL") & (c < qualify + 0.1), "COVERAGE_NEAR_WATCH"), (v == "WATCH", "COVERAGE_TO_QUALIFY"),
        (v == "INSUFFICIENT_DATA", "COVERAGE_TO_WATCH"), (live & F.col("top_state").isin(*MEASURED) & F.col("top_audited") & (F.col("top_holders") >= concentration - 20), "CONCENTRATION_NEAR_VETO"),
        (~live & (F.col("clearable") > 0), "VETO_CAN_CLEAR"), (~live & (F.col("permanent") > 0), "VETO_PERMANENT"),
        ((v == "QUALIFIED") & (F.col("blockers") > 0), "HIGH_POTENTIAL_NEEDS"), ((v == "HIGH_RISK") & F.col("driver").isNotNull(), "RISK_DRIVER"))
    return df.select("asset", F.explode(notes).alias("note"))


def table_diagnostics(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and time span of each table."""
    out = None
    for name, df in tables.items():
        r = df.agg(F.lit(name).alias("tbl"), F.count("*").alias("n"), F.min("at").alias("oldest"), F.max("at").alias("newest"))
        out = r if out is None else out.unionByName(r)
    return out


def dossier(assets: DataFrame, evidence: DataFrame, market: DataFrame, findings: DataFrame) -> DataFrame:
    """One wide row per asset: placement columns, evidence summary, newest market row, findings."""
    e = evidence.groupBy("asset").agg(
        F.count_if(F.col("state").isin(*MEASURED)).alias("measured"), F.count("*").alias("metrics"), F.count_if(F.col("state") == "CONFLICTED").alias("conflicts"))
    m = market.groupBy("asset").agg(F.max_by(F.struct("price", "liquidity", F.col("observed_at").alias("market_at")), "observed_at").alias("m")).select("asset", "m.price", F.col("m.liquidity").alias("market_liquidity"), "m.market_at")
    f = findings.groupBy("asset").agg(F.count_if(F.col("status") == "CONFIRMED").alias("confirmed"), F.count_if(F.col("status") != "CONFIRMED").alias("suspected"))
    return assets.join(e, "asset", "left").join(m, "asset", "left").join(f, "asset", "left").na.fill(0, ["measured", "metrics", "conflicts", "confirmed", "suspected"])


def coverage_overview(live: DataFrame, ledger: DataFrame) -> DataFrame:
    """Mean coverage and confidence and the coverage histogram of live assets, and how many have a ledger.

    :func:`unknown_signals` of the same ledger gives the metrics that are not known.
    """
    c = F.col("coverage")
    kept = ledger.select("asset").distinct().withColumn("_ledger", F.lit(True))
    return live.join(kept, "asset", "left").agg(
        F.count("*").alias("assets"), half_up(F.avg(c), 3).alias("mean_coverage"), half_up(F.avg("confidence"), 3).alias("mean_confidence"),
        *(F.count_if((c >= lo) & (c < hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(COVERAGE_STEPS)), F.count("_ledger").alias("with_ledger"))


def veto_counts(vetoes: DataFrame) -> DataFrame:
    return vetoes.groupBy("code").agg(F.count("*").alias("n"))


def findings_view(events: DataFrame, version: str) -> DataFrame:
    """Per asset: active confirmed, active suspected and superseded counts."""
    active = (F.col("rule_version") == version) & F.col("superseded_at").isNull()
    return events.groupBy("asset").agg(
        F.count_if(active & (F.col("status") == "CONFIRMED")).alias("confirmed"),
        F.count_if(active & F.col("status").isin("STRONGLY_SUSPECTED", "SUSPICIOUS")).alias("suspected"), F.count_if(~active).alias("superseded"))


def revision_audit(revisions: DataFrame, n: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("revised_at"), "id"))
    return revisions.withColumn("rank", r).where(F.col("rank") <= n)


def recent_events(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("observed_at"), F.desc("seq"), "alert", "code").limit(n)


def scan_stats(scans: DataFrame) -> DataFrame:
    done = F.col("finished_at").isNotNull()
    return scans.agg(F.count_if(done).alias("finished"), F.max(F.when(done, F.col("started_at"))).alias("last_scan_at"),
                     F.sum(F.when(done, F.col("analyzed"))).alias("analyzed"), F.sum(F.when(done, F.col("fresh"))).alias("fresh"),
                     F.sum(F.when(done, F.col("finished_at") - F.col("started_at"))).alias("duration_ms"))


def newest_for(df: DataFrame, cond, n: int, *order) -> DataFrame:
    """Chain lookups: a pushed-down filter, newest first, limited."""
    return df.where(known(cond)).orderBy(*order).limit(n)
