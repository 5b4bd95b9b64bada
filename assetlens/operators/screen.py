"""The screen: hard gates, the seven-part score with its flags, eligibility and settled state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.functions.scalar import clamp01, codes, gauss_band, half_up, known, ladder, log_band, lookup
from assetlens.operators.place import VERDICT_TIER

# Extension rules. Alias, policy, when it counts as armed, the state fields read,
# whether it can clear, and the veto code.
EXTENSION_COLS = "id string, policy string, risk string, fields string, recheckable boolean, code string"
EXTENSION_RULES = [
    ("permanentdelegate", "HARD_VETO", "KEY_SET", "delegate,permanentDelegate", True, "PERMANENT_DELEGATE_ACTIVE"),
    ("nontransferable", "HARD_VETO", "ALWAYS", "", False, "NON_TRANSFERABLE"),
    ("pausableconfig", "HARD_VETO", "PAUSED", "authority,pauseAuthority", True, "MINT_PAUSABLE"),
    ("pausable", "HARD_VETO", "PAUSED", "authority,pauseAuthority", True, "MINT_PAUSABLE"),
    ("defaultaccountstate", "HARD_VETO", "FROZEN", "accountState,state", True, "DEFAULT_ACCOUNT_STATE_FROZEN"),
    ("transferhook", "HARD_VETO", "KEY_SET", "programId,hookProgramId", True, "TRANSFER_HOOK_ACTIVE"),
    ("transferfeeconfig", "CONDITIONAL_VETO", "FEE", "newerTransferFee,olderTransferFee", True, "EXTREME_TRANSFER_FEE"),
] + [(i, "INFORMATIONAL", "ALWAYS", "", r, None) for i, r in [
    ("confidentialtransfermint", False), ("confidentialtransfer", False), ("interestbearingconfig", False), ("interestbearingmint", False), ("scaleduiamountconfig", False),
    ("scaleduiamount", False), ("mintcloseauthority", True), ("permissionedburnconfig", True), ("permissionedburn", True), ("confidentialtransferfeeconfig", False),
    ("confidentialtransferfee", False), ("confidentialmintburn", False), ("metadatapointer", False), ("tokenmetadata", False), ("grouppointer", False), ("groupmemberpointer", False),
    ("tokengroup", False), ("tokengroupmember", False)]]
ZERO_ADDRESS = "11111111111111111111111111111111"
FEE_VETO_BPS = 5_000
# Gate limits, report texts that veto, fields whose rejection is structural.
MIN_LIQUIDITY, MAX_CONCENTRATION = 3_000, 90
CRITICAL_REPORTS = ["creator history of rugged tokens", "rugged"]
CRITICAL_FIELDS = ["liquidity.usd", "liquidity", "supply", "decimals", "top10Share", "mintAuthority", "freezeAuthority", "programId", "audit.mintAuthorityDisabled", "audit.freezeAuthorityDisabled"]
# Component and safety weights, penalties, grades, eligibility coverage.
WEIGHTS = {"safety": 0.26, "liquidity": 0.18, "activity": 0.14, "holders": 0.13, "momentum": 0.12, "pressure": 0.09, "age": 0.08}
SAFETY = {"mint": 0.3, "freeze": 0.2, "concentration": 0.2, "rugcheck": 0.2, "organic": 0.1}
PENALTIES = {"mint_authority": 0.55, "freeze_authority": 0.45, "concentration": 0.7, "thin_liquidity": 0.65, "wash_suspect": 0.8}
FINDING_PENALTY, PENALTY_FLOOR = 0.85, 0.1
MIN_WATCH, MIN_QUALIFY = 0.35, 0.6


def extension_rules(spark: SparkSession) -> DataFrame:
    """The rule dimension: two dozen rows, a fixed size."""
    return spark.createDataFrame(EXTENSION_RULES, EXTENSION_COLS)


def _key_set(*fields: str) -> Column:
    """Tri-state: a named field holds an address (true), null (false), or none is readable (null)."""
    state = F.col("state")
    out = None
    for f in fields:
        v = F.get_json_object(state, f"$.{f}")
        there = F.array_contains(F.json_object_keys(state), f)
        value = F.when(v.isNull(), F.lit(False)).otherwise((v != ZERO_ADDRESS) & (F.length(v) > 0))
        out = F.when(there, value) if out is None else out.when(there, value)
    return out


def flatten_extensions(accounts: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per extension: policy, tri-state ``active``, fee magnitude, whether it was readable.

    ``accounts(asset, extensions array<struct<extension string, state string(JSON)>>)``.
    """
    e = accounts.select("asset", F.posexplode("extensions").alias("position", "x")).select("asset", "position", F.lower("x.extension").alias("id"), F.col("x.state").alias("state"))
    e = e.join(F.broadcast(rules), "id", "left")
    bps = F.greatest(*[F.get_json_object("state", f"$.{f}.transferFeeBasisPoints").cast("double") for f in ("newerTransferFee", "olderTransferFee")])
    acct = F.lower(F.coalesce(F.get_json_object("state", "$.accountState"), F.get_json_object("state", "$.state")))
    r = F.col("risk")
    active = (
        F.when(r == "ALWAYS", F.lit(True)).when((r == "KEY_SET") & (F.col("id") == "permanentdelegate"), _key_set("delegate", "permanentDelegate"))
        .when(r == "KEY_SET", _key_set("programId", "hookProgramId")).when((r == "PAUSED") & (F.get_json_object("state", "$.paused") == "true"), F.lit(True))
        .when(r == "PAUSED", _key_set("authority", "pauseAuthority")).when(r == "FROZEN", acct == "frozen").when(r == "FEE", bps > 0))
    return e.select("asset", "position", "id", F.coalesce("policy", F.lit("UNKNOWN_POLICY")).alias("policy"), active.alias("active"), F.when(r == "FEE", bps).alias("magnitude"), "recheckable", "code",
                    (F.col("id") != "unparseableextension").alias("readable"))


def extensions_complete(extensions: DataFrame) -> DataFrame:
    """A list is complete when every entry was readable and known."""
    return extensions.groupBy("asset").agg(F.bool_and(F.col("readable") & (F.col("policy") != "UNKNOWN_POLICY")).alias("complete"), F.count("*").alias("extensions"))


VETO = ["asset", "code", "nature", "source", "recheckable"]


def _veto(df: DataFrame, code, nature: str, source, recheckable) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("asset", lit(code).alias("code"), F.lit(nature).alias("nature"), lit(source).alias("source"), lit(recheckable).alias("recheckable"))


def extension_gate(extensions: DataFrame, freshness: DataFrame | None = None) -> DataFrame:
    """Armed hard-veto extensions, and fees at or above half; only while the reading is current."""
    x = extensions
    if freshness is not None:
        x = x.join(freshness.where(F.col("freshness").isin("FRESH", "AGING")).select("asset"), "asset", "left_semi")
    hit = F.col("active") & F.col("code").isNotNull() & ((F.col("policy") == "HARD_VETO") | ((F.col("policy") == "CONDITIONAL_VETO") & (F.col("magnitude") >= FEE_VETO_BPS)))
    return _veto(x.where(hit), F.col("code"), "current-state", "helius", F.col("recheckable"))


def current(m: str) -> Column:
    """A metric column of the wide evidence row is usable and not stale."""
    c = F.col(m)
    return known(c["state"].isin("MEASURED", "CONFLICTED") & c["value"].isNotNull() & c["freshness"].isin("FRESH", "AGING"))


def measured(m: str) -> Column:
    c = F.col(m)
    return known(c["state"].isin("MEASURED", "CONFLICTED") & c["value"].isNotNull())


def val(m: str) -> Column:
    return F.col(m)["value"]


def base_gate(wide: DataFrame, min_liquidity: float = MIN_LIQUIDITY, max_concentration: float = MAX_CONCENTRATION) -> DataFrame:
    """Live authorities, nothing to trade against, depth under the floor, extreme concentration."""
    liq, top = val("liquidityUsd"), val("topHoldersPct")
    found = codes(
        (current("mintAuthorityRevoked") & (val("mintAuthorityRevoked") == 0), "AUTHORITY_MINT_ACTIVE"), (current("freezeAuthorityRevoked") & (val("freezeAuthorityRevoked") == 0), "AUTHORITY_FREEZE_ACTIVE"),
        (current("tradable") & (val("tradable") == 0), "UNTRADEABLE"), (current("liquidityUsd") & (liq > 0) & (liq < min_liquidity), "LIQUIDITY_TOO_LOW"),
        (current("topHoldersPct") & (F.col("topHoldersPct.source") == "jupiter") & (top >= max_concentration), "CATASTROPHIC_CONCENTRATION"))
    metric = {"AUTHORITY_MINT_ACTIVE": "mintAuthorityRevoked", "AUTHORITY_FREEZE_ACTIVE": "freezeAuthorityRevoked", "UNTRADEABLE": "tradable", "LIQUIDITY_TOO_LOW": "liquidityUsd", "CATASTROPHIC_CONCENTRATION": "topHoldersPct"}
    w = wide.select("*", F.explode(found).alias("code"))
    src = reduce(lambda a, kv: a.when(F.col("code") == kv[0], F.col(f"{kv[1]}.source")), metric.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    return _veto(w, F.col("code"), "current-state", src, True)


def report_gate(findings: DataFrame) -> DataFrame:
    """Danger-level report findings about what already happened."""
    low = F.lower("name")
    hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in CRITICAL_REPORTS])
    return _veto(findings.where((F.col("level") == "danger") & hit), "CRITICAL_RUGCHECK", "historical", "rugcheck", False)


def malformed_gate(issues: DataFrame) -> DataFrame:
    """One veto per asset with any structural field rejected. ``issues(asset, field)``."""
    return _veto(issues.where(F.col("field").isin(*CRITICAL_FIELDS)).select("asset").distinct(), "MALFORMED_TOKEN", "current-state", "validation", True)


def safety_component(wide: DataFrame) -> DataFrame:
    """Five weighted parts; an unknown part earns nothing and lowers coverage."""
    parts = {
        "mint": ("mintAuthorityRevoked", val("mintAuthorityRevoked")), "freeze": ("freezeAuthorityRevoked", val("freezeAuthorityRevoked")),
        "concentration": ("topHoldersPct", 1 - clamp01((val("topHoldersPct") - 10) / 60)), "rugcheck": ("rugcheckRisk", 1 - clamp01(val("rugcheckRisk") / 100)), "organic": ("organicScore", clamp01(val("organicScore") / 100))}
    earned = sum(F.when(measured(m), SAFETY[k] * clamp01(v)).otherwise(0.0) for k, (m, v) in parts.items())
    have = sum(F.when(measured(m), SAFETY[k]).otherwise(0.0) for k, (m, v) in parts.items())
    return wide.withColumns({"safety": F.when(have > 0, clamp01(earned)), "safety_coverage": have})


def score_components(wide: DataFrame) -> DataFrame:
    """The six other components in [0, 1], null when the evidence is not usable."""
    same = measured("volume24h") & measured("venueLiquidityUsd") & (F.col("volume24h.source") == F.col("venueLiquidityUsd.source"))
    depth = val("venueLiquidityUsd")
    turnover = F.when(depth > 0, val("volume24h") / depth).otherwise(0.0)
    return safety_component(wide).withColumns({
        "liquidity": F.when(measured("liquidityUsd"), log_band(val("liquidityUsd"), 5_000, 500_000)),
        "activity": F.when(same, F.when(turnover > 0, gauss_band(F.log10(turnover), F.log10(F.lit(3.0)), 0.65)).otherwise(0.0)), "turnover": F.when(same, turnover),
        "holders_score": F.when(measured("holders"), log_band(val("holders"), 50, 5_000)), "momentum": F.when(measured("priceChange"), clamp01(0.5 + F.tanh(val("priceChange") / 60) / 2)),
        "pressure": F.when(measured("buyPressure"), clamp01((val("buyPressure") - 0.35) / 0.3)), "age": F.when(measured("ageHours") & (val("ageHours") > 0), gauss_band(F.log10(val("ageHours")), F.log10(F.lit(12.0)), 0.75))})


PARTS = {"safety": "safety", "liquidity": "liquidity", "activity": "activity", "holders": "holders_score", "momentum": "momentum", "pressure": "pressure", "age": "age"}


def risk_flags(scored: DataFrame, min_liquidity: float = MIN_LIQUIDITY) -> DataFrame:
    """Add ``flags`` (codes) from evidence, conflicts, findings, rejected data and gaps.

    Needs columns has_socials, verified, impersonation (probability or null), issues (count),
    conflicts and danger/warn finding lists; missing inputs are null.
    """
    liq, top = val("liquidityUsd"), val("topHoldersPct")
    unknown = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(k)) for k, c in PARTS.items()]), lambda x: x.isNotNull())
    base = codes(
        (current("mintAuthorityRevoked") & (val("mintAuthorityRevoked") == 0), "mint_authority"), (current("freezeAuthorityRevoked") & (val("freezeAuthorityRevoked") == 0), "freeze_authority"),
        (current("topHoldersPct") & (top >= 60), "concentration"), (current("liquidityUsd") & (liq < min_liquidity), "thin_liquidity"),
        ((F.col("turnover") > 50) & (liq < 100_000) & (val("venueLiquidityUsd") > 0), "wash_suspect"), (F.col("issues") > 0, "provider_data_rejected"), (F.size(unknown) > 0, "incomplete_evidence"),
        (~known(F.col("has_socials")), "no_socials"), (F.col("impersonation") >= 0.7, "impersonation_suspected"), (F.col("verified"), "verified"))
    conf = F.transform(F.coalesce("conflicts", F.array().cast("array<string>")), lambda m: F.concat(F.lit("provider_conflict:"), m))
    find = F.transform(F.coalesce("findings", F.array().cast("array<string>")), lambda n: F.concat(F.lit("rugcheck:"), F.regexp_replace(F.lower(n), r"\s+", "_")))
    return scored.withColumns({"unknown": unknown, "flags": F.concat(base, conf, find)})


def score_total(flagged: DataFrame) -> DataFrame:
    """Total, grade, penalty, coverage and ceiling. ``danger_findings`` counts scorable dangers."""
    base = sum(F.coalesce(F.col(c), F.lit(0.0)) * WEIGHTS[k] for k, c in PARTS.items()) * 100
    cov = sum((F.col("safety_coverage") if k == "safety" else F.col(c).isNotNull().cast("double")) * WEIGHTS[k] for k, c in PARTS.items()) / sum(WEIGHTS.values())
    mult = F.aggregate("flags", F.lit(1.0), lambda acc, f: acc * lookup(f, PENALTIES, 1.0)) * F.pow(F.lit(FINDING_PENALTY), F.coalesce("danger_findings", F.lit(0)))
    mult = F.greatest(mult, F.lit(PENALTY_FLOOR))
    t = flagged.withColumns({"_base": base, "_mult": mult, "_cov": cov}).withColumn("_total", F.col("_base") * F.col("_mult"))
    g = F.col("_total")
    return t.withColumns({
        "total": half_up(g, 1), "base": half_up("_base", 1), "grade": ladder("F", (g >= 75, "A"), (g >= 60, "B"), (g >= 45, "C"), (g >= 30, "D")), "penalty": half_up((1 - F.col("_mult")) * 100, 1),
        "score_coverage": half_up("_cov", 3), "ceiling": half_up(F.col("_cov") * 100, 1)}).drop("_base", "_mult", "_cov", "_total")


def screen_eligibility(vetoes: Column, coverage: Column) -> Column:
    return ladder("QUALIFIED", (vetoes > 0, "REJECTED"), (coverage < MIN_WATCH, "INSUFFICIENT_DATA"), (coverage < MIN_QUALIFY, "WATCH"))


def settle_state(previous: Column, target: Column) -> Column:
    """Every resting state reaches any other through scanning; an unknown state stays put."""
    resting = [*VERDICT_TIER, "DISCOVERED", "SCANNING"]
    return ladder(previous, (previous.isNull(), target), (previous.isin(*resting) & target.isin(*VERDICT_TIER), target))
