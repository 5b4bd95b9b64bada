"""Order-dependent folds over an asset's readings: history thinning and verdict stability.

Neither is a window function: thinning compares with the last row that was *stored*, stability
carries a pending upgrade. Both avoid walking one asset's whole history in one task.

* Stability has few states, so every day of an asset becomes a table "state in -> state out", an
  array folded over the day's readings. Days run in parallel; composing the tables per asset is one
  step per day; a second parallel pass replays each day from its true starting state.
* Thinning restarts at every change of verdict (always stored) and after a silence of a
  heartbeat (always stored). Those restarts are found in parallel; the pieces between them are
  independent and are streamed in order with one row of state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions.durable import cut
from assetlens.functions.scalar import DAY_MS, known, lookup
from assetlens.functions.skew import bucket_of, dealt, lag_across, running_sum
from assetlens.operators.place import VERDICT_TIER

# Confirmations needed, how long a hold may last, and the storing policy.
CONFIRMATIONS, HOLD_MS = 2, 60 * 60_000
SCORE_DELTA, COVERAGE_DELTA, RELATIVE_DELTA, HEARTBEAT_MS = 1.0, 0.05, 0.02, 30 * 60_000

NAMES = list(VERDICT_TIER)
TIERS = len(NAMES)


def _machine(k: int) -> np.ndarray:
    """Next-state table [repeated, state, reading]. State 0 is "nothing shown yet"; the others encode
    the shown tier and the pending upgrade (none, or its worst tier and its confirmations so far).
    A reading of the same instant as the one before it (repeated) may worsen a pending upgrade but
    does not confirm it."""
    pend = 1 + TIERS * (k - 1)
    table = np.zeros((2, 1 + TIERS * pend, TIERS), dtype=np.int16)
    settled = lambda v: 1 + v * pend
    for raw in range(TIERS):
        table[:, 0, raw] = settled(raw)
        for shown in range(TIERS):
            for p in range(pend):
                n, worst = (0, -1) if p == 0 else ((p - 1) // TIERS + 1, (p - 1) % TIERS)
                conservative = max(worst, raw)
                for repeated in (0, 1):
                    seen = n if repeated and n else n + 1
                    if raw >= shown:
                        nxt = settled(raw)
                    elif seen >= k:
                        nxt = settled(conservative)
                    else:
                        nxt = 1 + shown * pend + 1 + (seen - 1) * TIERS + conservative
                    table[repeated, 1 + shown * pend + p, raw] = nxt
    return table


def _shown(state: np.ndarray, k: int) -> np.ndarray:
    return (state - 1) // (1 + TIERS * (k - 1))


def stabilize(readings: DataFrame, k: int = CONFIRMATIONS, hold_ms: int | None = HOLD_MS, width: int = DAY_MS) -> DataFrame:
    """Add ``stable`` to ordered verdict readings (asset, observed_at, seq, verdict).

    A worse or equal verdict applies at once; a better one after ``k`` confirming readings, as
    the most conservative of them. A previous decision older than ``hold_ms`` does not hold
    (None: never expires, the calibration replay). A reading of the same instant as the last is no
    new confirmation.
    """
    machine = _machine(k)
    states = machine.shape[1]
    table = F.split(F.lit(",".join(map(str, machine.ravel()))), ",").cast("array<int>")
    names = F.array(*map(F.lit, NAMES))
    order = ["observed_at", "seq"]
    r = lag_across(readings.select("asset", *order, "verdict"), ["asset"], order, "observed_at", width, {"prev_at": "observed_at"})
    fresh = F.col("prev_at").isNull()
    if hold_ms is not None:
        fresh = fresh | (F.col("observed_at") - F.col("prev_at") > hold_ms)
    row = F.struct(*order, "verdict", lookup("verdict", VERDICT_TIER).cast("int").alias("tier"), fresh.alias("fresh"), known(F.col("prev_at") == F.col("observed_at")).cast("int").alias("repeated"))
    days = cut(r.groupBy("asset", bucket_of("observed_at", width).alias("day")).agg(F.array_sort(F.collect_list(row)).alias("rows")))

    def step(state: Column, x: Column) -> Column:
        return F.get(table, (x["repeated"] * states + F.when(x["fresh"], 0).otherwise(state)) * TIERS + x["tier"])

    # a day as a map of states: where each state at its beginning leads
    through = F.aggregate("rows", F.sequence(F.lit(0), F.lit(states - 1)), lambda m, x: F.transform(m, lambda c: step(c, x)))
    chained = days.select("asset", F.struct("day", through.alias("map")).alias("d")).groupBy("asset").agg(F.array_sort(F.collect_list("d")).alias("days"))
    begin = F.struct(F.lit(0).alias("state"), F.array().cast("array<int>").alias("starts"))
    walked = F.aggregate("days", begin, lambda s, d: F.struct(F.get(d["map"], s["state"]).alias("state"), F.concat(s["starts"], F.array(s["state"])).alias("starts")), lambda s: s["starts"])
    starts = chained.select("asset", F.explode(F.arrays_zip(F.col("days.day").alias("day"), walked.alias("start"))).alias("x")).select("asset", "x.day", "x.start")
    begin = F.struct(F.col("start").alias("state"), F.array().cast("array<int>").alias("seen"))

    def replay(s: Column, x: Column) -> Column:
        after = F.array(step(s["state"], x))
        return F.struct(F.get(after, F.lit(0)).alias("state"), F.concat(s["seen"], after).alias("seen"))

    seen = days.join(starts, ["asset", "day"]).select("asset", F.arrays_zip("rows", F.aggregate("rows", begin, replay, lambda s: s["seen"]).alias("seen")).alias("z"))
    shown = F.get(names, F.floor((F.col("x.seen") - 1) / (1 + TIERS * (k - 1))).cast("int"))
    return seen.select("asset", F.explode("z").alias("x")).select("asset", "x.rows.observed_at", "x.rows.seq", "x.rows.verdict", shown.alias("stable"))


def thin_snapshots(readings: DataFrame, width: int = DAY_MS) -> DataFrame:
    """Readings worth storing, with the reason: first, transition, material-change, heartbeat.

    Input (asset, observed_at, seq, verdict, score, coverage, price, liquidity, volume24h) and, where
    there is one, state: a change of state is a transition like one of verdict, also from or to none.
    Of several readings at one instant only the first is kept.
    """
    cols = ["verdict", "score", "coverage", "price", "liquidity", "volume24h"]
    readings = readings if "state" in readings.columns else readings.withColumn("state", F.lit(None).cast("string"))
    r = readings.groupBy("asset", "observed_at").agg(F.min_by(F.struct("seq", *cols, "state"), "seq").alias("v")).select("asset", "observed_at", "v.*")
    order = ["observed_at", "seq"]
    r = lag_across(r, ["asset"], order, "observed_at", width, {"_pv": "verdict", "_ps": "state", "_pt": "observed_at"})
    first = F.col("_pt").isNull()
    moved = ~first & ~(F.col("verdict").eqNullSafe(F.col("_pv")) & F.col("state").eqNullSafe(F.col("_ps")))
    silent = known(F.col("observed_at") - F.col("_pt") >= HEARTBEAT_MS)
    restart = first | moved | silent
    r = r.withColumns({"why": F.when(first, "first").when(moved, "transition"), "restart": restart}).drop("_pv", "_ps", "_pt", "state")
    r = running_sum(r, ["asset"], order, "observed_at", width, {"piece": F.col("restart").cast("long")})
    # A silent gap always stores, but whether it counts as a material change depends on the last
    # stored row, which may lie in the piece before. That row is each piece's hand-over.
    return _stream_pieces(r, cols)


def _move(a: float, b: float) -> float:
    if np.isnan(a) or np.isnan(b):
        return 0.0
    return (0.0 if a == 0 else 1.0) if b == 0 else abs(a - b) / abs(b)


def _material(row, last) -> bool:
    return (
        abs(row.score - last.score) >= SCORE_DELTA
        or (not np.isnan(row.coverage) and not np.isnan(last.coverage) and abs(row.coverage - last.coverage) >= COVERAGE_DELTA)
        or any(_move(getattr(row, c), getattr(last, c)) >= RELATIVE_DELTA for c in ("price", "liquidity", "volume24h"))
    )


def _stream_pieces(r: DataFrame, cols: list[str]) -> DataFrame:
    num = [c for c in cols if c != "verdict"]
    schema = "asset string, observed_at long, seq long, verdict string, " + ", ".join(f"{c} double" for c in num) + ", reason string, piece long"

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for pdf in frames:
            pdf[num] = pdf[num].astype(float)
            out = []
            for row in pdf.itertuples(index=False):
                if (row.asset, row.piece) != key:
                    key, last = (row.asset, row.piece), row
                    out.append(row.why or "restart")
                elif _material(row, last):
                    out.append("material-change")
                    last = row
                elif row.observed_at - last.observed_at >= HEARTBEAT_MS:
                    out.append("heartbeat")
                    last = row
                else:
                    out.append(None)
            pdf["reason"] = out
            yield pdf.loc[pdf["reason"].notna(), ["asset", "observed_at", "seq", "verdict", *num, "reason", "piece"]]

    p = dealt(r, "asset", "piece").sortWithinPartitions("asset", "piece", "observed_at", "seq")
    stored = p.mapInPandas(walk, schema)
    # Name the stored restarts that were neither first nor a transition: heartbeat unless material
    # against the last row stored in the piece before. One row per piece, so this join is small.
    tail = stored.groupBy("asset", "piece").agg(F.max_by(F.struct(*num), "observed_at").alias("l"))
    tail = tail.select("asset", (F.col("piece") + 1).alias("piece"), "l")
    j = stored.join(tail, ["asset", "piece"], "left")

    def far(c):
        a, b = F.col(c), F.col(f"l.{c}")
        ratio = F.when(b == 0, F.when(a == 0, 0.0).otherwise(1.0)).otherwise(F.abs(a - b) / F.abs(b))
        return known(a.isNotNull() & (ratio >= RELATIVE_DELTA))

    big = (
        known(F.abs(F.col("score") - F.col("l.score")) >= SCORE_DELTA) | known(F.abs(F.col("coverage") - F.col("l.coverage")) >= COVERAGE_DELTA)
        | far("price") | far("liquidity") | far("volume24h"))
    reason = F.when(F.col("reason") != "restart", F.col("reason")).when(big, "material-change").otherwise("heartbeat")
    return j.withColumn("reason", reason).withColumn("is_transition", F.col("reason").isin("first", "transition")).drop("l", "piece")
