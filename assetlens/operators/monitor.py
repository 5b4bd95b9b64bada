"""Change detection: what to alert on between an asset's consecutive readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions.scalar import DAY_MS, known, ladder
from assetlens.functions.skew import lag_across
from assetlens.operators.place import rank_key, tier

# Alert thresholds.
SCORE_STEP, DROP_FROM, DROP_TO, CRITICAL_DROP, PRICE_STEP = 8, 5_000, 0.6, 80, 30
MIN_SCORE, MIN_COVERAGE = 70, 0.6
BASE = ["asset", "observed_at", "seq"]
CARRIED = ["verdict", "score", "price", "liquidity", "seq", "flags"]


def with_previous(readings: DataFrame, width: int = DAY_MS) -> DataFrame:
    """Each reading beside the asset's previous one; ``first`` marks an unseen asset."""
    cols = {f"p_{c}": c for c in CARRIED if c in readings.columns}
    p = lag_across(readings, ["asset"], ["observed_at", "seq"], "observed_at", width, cols)
    return p.withColumn("first", F.col("p_seq").isNull())


def _alert(pred: Column, kind, level, code) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(known(pred), F.struct(lit(kind).alias("alert"), lit(level).alias("level"), lit(code).alias("code")))


def _emit(p: DataFrame, *alerts: Column) -> DataFrame:
    """All alerts of a reading in one pass over the readings."""
    return p.select(*BASE, F.explode(F.filter(F.array(*alerts), lambda a: a.isNotNull())).alias("a")).select(*BASE, "a.*")


def _first() -> Column:
    good = (F.col("score") >= MIN_SCORE) & (F.col("coverage") >= MIN_COVERAGE) & (F.col("verdict") == "QUALIFIED")
    code = ladder(F.lit(None).cast("string"), (F.col("verdict") == "REJECTED", "REJECTED"), (F.col("verdict") == "HIGH_POTENTIAL", "HIGH_POTENTIAL"), (good, "WELL_EVIDENCED"), (F.col("score") >= MIN_SCORE - 20, "TRACKING"))
    rejected = code == "REJECTED"
    return _alert(F.col("first") & code.isNotNull(), F.when(rejected, "risk_flag").otherwise("discovered"), F.when(rejected, "critical").when(code == "TRACKING", "info").otherwise("medium"), code)


def _score() -> Column:
    d = F.col("score") - F.col("p_score")
    up = d >= SCORE_STEP
    return _alert(up | (d <= -SCORE_STEP), F.when(up, "score_up").otherwise("score_down"), F.when(up, "info").otherwise("medium"), "SCORE")


def _liquidity() -> Column:
    pct = (1 - F.col("liquidity") / F.nullif(F.col("p_liquidity"), F.lit(0.0))) * 100
    fell = (F.col("p_liquidity") >= DROP_FROM) & (F.col("liquidity") < F.col("p_liquidity") * DROP_TO)
    return _alert(fell, "liquidity_drop", F.when(pct >= CRITICAL_DROP, "critical").otherwise("high"), "LIQUIDITY")


def _price() -> Column:
    move = F.when(F.col("p_price") > 0, (F.col("price") / F.col("p_price") - 1) * 100)
    return _alert(F.abs(move) >= PRICE_STEP, "price_spike", F.when(move > 0, "info").otherwise("medium"), "PRICE")


def _state() -> Column:
    v = F.col("verdict")
    up = tier("verdict") < tier("p_verdict")
    return _alert(v != F.col("p_verdict"), F.when(v.isin("REJECTED", "HIGH_RISK"), "risk_flag").when(up, "score_up").otherwise("score_down"),
                  ladder("info", (v == "REJECTED", "critical"), (v == "HIGH_RISK", "high"), (v == "HIGH_POTENTIAL", "medium")), "STATE")


def first_alerts(p: DataFrame) -> DataFrame:
    return _emit(p, _first())


def score_moves(p: DataFrame) -> DataFrame:
    return _emit(p, _score())


def liquidity_drops(p: DataFrame) -> DataFrame:
    return _emit(p, _liquidity())


def price_spikes(p: DataFrame) -> DataFrame:
    return _emit(p, _price())


def state_changes(p: DataFrame) -> DataFrame:
    return _emit(p, _state())


def new_flags(p: DataFrame) -> DataFrame:
    """High or critical flags the previous reading did not carry. ``flags array<struct<code,level>>``."""
    before = F.transform("p_flags", lambda x: x["code"])
    e = p.where(~F.col("first")).withColumn("_before", before).select(*BASE, "_before", F.explode("flags").alias("f"))
    new = F.col("f.level").isin("critical", "high") & ~F.array_contains("_before", F.col("f.code"))
    return e.where(known(new)).select(*BASE, F.lit("risk_flag").alias("alert"), F.col("f.level").alias("level"), F.col("f.code").alias("code"))


def all_alerts(p: DataFrame) -> DataFrame:
    """The alerts of readings that already carry their previous reading (batch or stream)."""
    return _emit(p, _first(), _score(), _liquidity(), _price(), _state())


def alerts(readings: DataFrame) -> DataFrame:
    """Every alert of a set of readings; flag alerts too when readings carry flags."""
    p = with_previous(readings)
    out = all_alerts(p)
    return out.unionByName(new_flags(p)) if "flags" in readings.columns else out


def top_of_batch(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(tier("verdict"), F.desc(rank_key()), "asset").limit(n)
