"""Views of one asset or of the whole store: dossiers, findings, distances, transitions, lookups, reasons with text.

Lists inside a row are bounded by what they list: an asset's metrics, or a stated number of the newest rows,
ranked so that each task keeps only that many a key before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.functions.scalar import DAY_MS, HOUR_MS, codes, half_up, known, ladder
from assetlens.operators.decide import HP, usable
from assetlens.operators.history import MEASURED


def newest(df: DataFrame, n: int, name: str, fields: list[str], *order: Column) -> DataFrame:
    """(asset, name): the first ``n`` rows of each asset in ``order`` as an array of structs in that order."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy("asset").orderBy(*order))).where(F.col("_n") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_n", *fields)))
    return ranked.groupBy("asset").agg(listed.alias("_l")).select("asset", F.transform("_l", lambda x: x.dropFields("_n")).alias(name))


def latest(df: DataFrame, name: str, fields: list[str], order: list[str]) -> DataFrame:
    """(asset, name): the newest row of each asset as a struct."""
    return df.groupBy("asset").agg(F.max_by(F.struct(*fields), F.struct(*order)).alias(name))


def dossier_rows(assets: DataFrame, ledger: DataFrame, market: DataFrame, holders: DataFrame, decisions: DataFrame, intel: DataFrame, findings: DataFrame, shown: int = 5) -> DataFrame:
    """One row per asset with everything told about it, nested.

    ``evidence`` holds the newest state of each metric, ``market``, ``holders``, ``decision`` and ``intelligence``
    the newest row of each, ``findings`` and ``revisions`` the newest ``shown`` active and superseded ones.
    """
    metrics = ledger.groupBy("asset", "metric").agg(F.max_by(F.struct("state", "weight"), "id").alias("r")).groupBy("asset").agg(
        F.array_sort(F.collect_list(F.struct("metric", "r.state", "r.weight"))).alias("evidence"))
    active = F.col("superseded_at").isNull()
    parts = [
        metrics, latest(market, "market", ["price", "liquidity", "observed_at"], ["observed_at"]), latest(holders, "holders", ["holders", "observed_at"], ["observed_at"]),
        latest(decisions, "decision", ["verdict", "score", "coverage", "observed_at"], ["observed_at", "seq"]), latest(intel, "intelligence", ["status", "at"], ["at", "seq"]),
        newest(findings.where(active), shown, "findings", ["id", "status", "rule_version"], F.desc("revised_at"), F.col("id")),
        newest(findings.where(~active), shown, "revisions", ["id", "status", "superseded_at"], F.desc("superseded_at"), F.col("id")),
    ]
    out = assets
    for p in parts:
        out = out.join(p, "asset", "left")
    return out


def finding_rows(events: DataFrame, version: str) -> DataFrame:
    """Every finding with where it belongs: confirmed, suspected, or superseded by a later rule or sweep."""
    active = (F.col("rule_version") == version) & F.col("superseded_at").isNull()
    section = ladder("suspected", (~active, "superseded"), (F.col("status") == "CONFIRMED", "confirmed"))
    return events.select("asset", section.alias("section"), "id", "status", "rule_version", "revised_at")


def rug_summary(d: DataFrame) -> DataFrame:
    """Token status, mean coverage of the three sources, creator and network level, and what limits them, per asset."""
    c = F.col
    kinds = [c(f"ev_{k}") for k in ("authority", "drain", "dump", "supply", "freeze")]
    any_of = lambda test: F.greatest(*[test(k).cast("int") for k in kinds]) == 1
    status = ladder("NOT_ANALYSED", (any_of(lambda k: known(k == "CONFIRMED")), "CONFIRMED_EVENT"), (any_of(lambda k: k.isNotNull()), "SUSPECTED_EVENTS"), (c("security_status").isin("AVAILABLE", "PARTIAL"), "NONE_FOUND"))
    caveats = codes(
        (~known(c("mint_history") == "COMPLETE"), "PARTIAL_MINT_HISTORY"), (~known(c("creator_status") == "AVAILABLE") | known(c("creator_level") == "INSUFFICIENT_HISTORY"), "THIN_CREATOR_HISTORY"),
        (known(c("graph_cut")), "GRAPH_CUT"), (known(c("attribution_raw") == "AMBIGUOUS"), "SEVERAL_SIGNERS"))
    return d.select("asset", status.alias("token_status"), half_up((c("security_coverage") + c("creator_coverage") + c("network_coverage")) / 3, 3).alias("coverage"), "creator_level", "network_level", caveats.alias("caveats"))


def backbone_totals(tables: dict[str, DataFrame], now: int) -> DataFrame:
    """(what, total, last_hour, last_day, skipped_last_day, latest) of each table; rows carry ``at`` and may carry ``skipped``."""
    out = None
    for what, df in tables.items():
        at = F.col("at")
        skipped = F.sum(F.when(at >= now - DAY_MS, F.col("skipped"))) if "skipped" in df.columns else F.lit(None)
        r = df.agg(F.count("*").alias("total"), F.count_if(at >= now - HOUR_MS).alias("last_hour"), F.count_if(at >= now - DAY_MS).alias("last_day"), skipped.cast("long").alias("skipped_last_day"), F.max("at").alias("latest")).select(
            F.lit(what).alias("what"), "*")
        out = r if out is None else out.unionByName(r)
    return out


def watchpoint_distances(df: DataFrame, floor: float = 3_000, qualify: float = 0.6, watch: float = 0.35, concentration: float = 90) -> DataFrame:
    """The notes of :func:`history.watchpoints` with how far each is: value, threshold, distance, a second threshold, and detail.

    ``distance`` is the value minus the threshold. ``needs`` lists what keeps a qualified asset from the top
    verdict; the detail shows the first three.
    """
    c = F.col
    v, cov = c("verdict"), c("coverage")
    live = v != "REJECTED"
    none = F.lit(None)

    def note(when, name, value=none, threshold=none, other=none, detail=none):
        return F.when(known(when), F.struct(F.lit(name).alias("note"), value.cast("double").alias("value"), threshold.cast("double").alias("threshold"), other.cast("double").alias("other_threshold"), detail.cast("string").alias("detail")))

    notes = F.array(
        note(live & (c("liquidity") > 0) & (c("liquidity") < floor * 3), "LIQUIDITY_NEAR_FLOOR", c("liquidity"), F.lit(floor)),
        note(v.isin("QUALIFIED", "HIGH_POTENTIAL") & (cov < qualify + 0.1), "COVERAGE_NEAR_WATCH", cov, F.lit(qualify)),
        note(v == "WATCH", "COVERAGE_TO_QUALIFY", cov, F.lit(qualify), F.lit(watch)), note(v == "INSUFFICIENT_DATA", "COVERAGE_TO_WATCH", cov, F.lit(watch), F.lit(qualify)),
        note(live & c("top_state").isin(*MEASURED) & c("top_audited") & (c("top_holders") >= concentration - 20), "CONCENTRATION_NEAR_VETO", c("top_holders"), F.lit(concentration)),
        note(~live & (c("clearable") > 0), "VETO_CAN_CLEAR", c("clearable")), note(~live & (c("permanent") > 0), "VETO_PERMANENT", c("permanent")),
        note((v == "QUALIFIED") & (F.size("needs") > 0), "HIGH_POTENTIAL_NEEDS", F.size("needs"), detail=F.array_join(F.slice("needs", 1, 3), "; ")),
        note((v == "HIGH_RISK") & c("driver").isNotNull(), "RISK_DRIVER", detail=c("driver")))
    return df.select("asset", F.explode(F.filter(notes, lambda x: x.isNotNull())).alias("x")).select("asset", "x.*").withColumn("distance", c("value") - c("threshold"))


# ---- lookups ---------------------------------------------------------------------------


def verdict_transitions(transitions: DataFrame, n: int, asset: str | None = None) -> DataFrame:
    """Newest ``n`` stored transitions with their reasons, of one asset or of all."""
    t = transitions if asset is None else transitions.where(F.col("asset") == asset)
    return t.orderBy(F.desc("at"), F.desc("seq")).limit(n)


def discoveries_of(sightings: DataFrame, asset: str) -> DataFrame:
    """Sources of one asset, the first to see it first."""
    return sightings.where(F.col("asset") == asset).groupBy("source").agg(F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"), F.count("*").alias("times_seen")).orderBy("first_seen_at", "source")


def recent_launches(launches: DataFrame, since: int, n: int) -> DataFrame:
    return launches.where(F.col("launch_time") >= since).orderBy(F.desc("launch_time"), "asset").limit(n)


def activity_for(activity: DataFrame, asset: str, ids: DataFrame) -> DataFrame:
    """The readings of one asset that named transactions made, so that a finding can be held against its proof."""
    return activity.where(F.col("asset") == asset).join(ids.select("tx_id").distinct(), "tx_id", "left_semi")


def events_of(events: DataFrame, asset: str) -> DataFrame:
    return events.where(F.col("asset") == asset).orderBy("slot", "type")


# ---- reasons ---------------------------------------------------------------------------

# The condition behind each blocker.
NEEDS = {"market_coverage": HP["market"], "intelligence_coverage": HP["intel"], "integrity_coverage": HP["integrity"], "opportunity": HP["opportunity"], "opportunity_coverage": HP["opportunity_coverage"], "momentum_confidence": HP["momentum"]}
NEEDS_ONE_OF = {"integrity_band": "clear or low", "momentum": "sustained or accelerating"}
QUALIFY = 0.6


def percent(x: Column) -> Column:
    return F.concat(half_up(x * 100, 0).cast("int").cast("string"), F.lit("%"))


def reason_rows(decided: DataFrame, contributions: DataFrame, fails: DataFrame, per_kind: int = 5) -> DataFrame:
    """(asset, place, kind, code, domain, text): every reason of a verdict in the order it is shown.

    Up to three hard fails, what was measured and found good, the strongest risks, what keeps the verdict from
    being higher, and the coverage. ``decided`` also says whether mint and freeze authority are known to be
    revoked (``mint_revoked``, ``freeze_revoked``). The strongest contributions are ranked before the shuffle.
    """
    c = F.col
    strongest = newest(contributions.select("asset", "domain", "code", "risk").distinct(), per_kind, "r", ["code", "domain", "risk"], F.desc("risk"), F.col("code"), F.col("domain"))
    failed = newest(fails.select("asset", "code", "family").distinct(), 3, "f", ["code", "family"], F.col("code"), F.col("family"))
    j = decided.join(strongest, "asset", "left").join(failed, "asset", "left")
    one = lambda kind, code, domain, text: F.struct(F.lit(kind).alias("kind"), code.alias("code"), domain.cast("string").alias("domain"), text.alias("text"))
    empty = F.slice(F.array(one("", F.lit(""), F.lit(None), F.lit(""))), 1, 0)
    words = lambda code: F.lower(F.translate(code, "_", " "))
    hard = F.transform("f", lambda x: one("hard_fail", x["code"], x["family"], words(x["code"])))
    rising, falling = c("momentum").isin("SUSTAINED", "ACCELERATING"), c("momentum").isin("UNSTABLE", "DECLINING")
    moved = F.concat(F.lit("MOMENTUM_"), c("momentum"))
    good = lambda when, code, domain, text: F.when(known(when), one("positive", code if isinstance(code, Column) else F.lit(code), F.lit(domain), text if isinstance(text, Column) else F.lit(text)))
    positives = F.filter(F.array(
        good((c("effective") >= 10) & (c("oc_participation") >= 0.9), "INDEPENDENT_BUYERS", "participation", F.concat(half_up(c("effective"), 0).cast("long").cast("string"), F.lit(" independent participants"))),
        good(c("o_liquidity") >= 0.6, "HEALTHY_LIQUIDITY", "liquidity", "healthy liquidity"),
        good(c("mint_revoked") & c("freeze_revoked") & (c("n_fails") == 0), "NO_AUTHORITY_RISK", "tokenSecurity", "mint and freeze authority revoked"),
        good(rising, moved, "momentum", F.concat(F.lower("momentum"), F.lit(" momentum"))),
        good(usable("creator") & (c("creator_level") == "CLEAN"), "CREATOR_CLEAN", "creatorReputation", "launches without security events"),
        good(usable("wash") & (c("wash_raw") == "LOW") & (c("wash_coverage") >= 0.5), "WASH_LOW", "walletCoordination", "no material wash pattern in a representative sample")), lambda x: x.isNotNull())
    risks = F.transform("r", lambda x: one("risk", x["code"], x["domain"], F.concat(words(x["code"]), F.lit(", risk "), half_up(x["risk"] * 100, 0).cast("int").cast("string"), F.lit("%"))))
    price = F.when(falling, F.array(one("risk", moved, F.lit("momentum"), F.concat(F.lower("momentum"), F.lit(" price action")))))

    def need(b: Column) -> Column:
        limit = F.lit(None).cast("string")
        for k, v in NEEDS.items():
            limit = F.when(b == k, F.when(c("verdict") == "WATCH", str(QUALIFY)).otherwise(str(v))).otherwise(limit)
        for k, v in NEEDS_ONE_OF.items():
            limit = F.when(b == k, v).otherwise(limit)
        return one("blocker", F.lit("NOT_HIGHER"), F.lit(None), F.concat(F.translate(b, "_", " "), F.lit(" needs "), limit))

    blockers = F.transform("blockers", need)
    told = F.concat(F.lit("coverage "), percent(0.6 * c("market_coverage") + 0.4 * c("intel_coverage")), F.lit(" (market evidence "), percent(c("market_coverage")), F.lit(", deep intelligence "), percent(c("intel_coverage")), F.lit(")"))
    listed = F.concat(*[F.coalesce(x, empty) for x in (hard, positives, risks, price, blockers)], F.array(one("coverage", F.lit("COVERAGE"), F.lit(None), told)))
    return j.select("asset", F.posexplode(listed).alias("place", "x")).select("asset", (c("place") + 1).alias("place"), "x.*")
