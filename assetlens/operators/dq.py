"""Data quality as one table job: a rule table gives clean values and an issue per rejected one.

Absent means null without an issue; present but wrong means null with an issue.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions.scalar import ladder

# Time bounds in ms (2020-03-16, ten minutes ahead), address shape, u64, text caps.
GENESIS_MS, FUTURE_SKEW_MS = 1_584_316_800_000, 600_000
ADDRESS = "^[1-9A-HJ-NP-Za-km-z]{32,44}$"
U64_MAX = "18446744073709551615"
TEXT_CAP, RECEIVED_CAP = 200, 40


@dataclass(frozen=True)
class Rule:
    """``kind``: number, percent, usd, change, count, decimals, boolean, text, address, amount, time."""

    field: str
    kind: str
    min: float | None = None
    max: float | None = None
    integer: bool = False
    max_length: int = TEXT_CAP


_NUMERIC = {"number": (None, None, False), "percent": (0, 100, False), "usd": (0, None, False), "change": (-100, 1_000_000, False), "count": (0, None, True), "decimals": (0, 255, True)}


def _number(c: Column, lo, hi, integer: bool) -> tuple[Column, Column]:
    text = F.trim(c.cast("string"))
    v = text.try_cast("double")
    bad = [(v.isNull(), "not a finite number"), (F.isnan(v), "NaN"), (F.abs(v) == float("inf"), "Infinity")]
    if integer:
        bad.append((v != F.floor(v), "expected an integer"))
    if lo is not None:
        bad.append((v < lo, f"below minimum {lo}"))
    if hi is not None:
        bad.append((v > hi, f"above maximum {hi}"))
    return v, ladder(F.lit(None).cast("string"), *bad)


def check(rule: Rule, now: int) -> tuple[Column, Column]:
    """(clean value, reason or null) for one rule over a raw column."""
    c = F.col(rule.field)
    none = F.lit(None).cast("string")
    empty = c.isNull() | (F.trim(c.cast("string")) == "")
    if rule.kind in _NUMERIC:
        lo, hi, whole = _NUMERIC[rule.kind]
        value, why = _number(c, rule.min if rule.min is not None else lo, rule.max if rule.max is not None else hi, rule.integer or whole)
    elif rule.kind == "boolean":
        value = c.cast("string").try_cast("boolean")
        why = F.when(~F.lower(c.cast("string")).isin("true", "false"), "expected boolean")
    elif rule.kind == "text":
        value, why = F.substring(c.cast("string"), 1, rule.max_length), none
    elif rule.kind == "address":
        value, why = c.cast("string"), F.when(~c.cast("string").rlike(ADDRESS), "not an address")
    elif rule.kind == "amount":
        t = F.trim(c.cast("string"))
        digits = t.rlike(r"^\d+$")
        value = F.when(digits & (F.length(t) <= 20), t.try_cast("decimal(20,0)"))
        why = ladder(none, (~digits, "not a non-negative integer string"), (value.isNull() | (value > F.lit(U64_MAX).cast("decimal(20,0)")), "exceeds u64"))
    elif rule.kind == "time":
        t = F.trim(c.cast("string"))
        n = t.try_cast("double")
        value = F.when(n.isNotNull(), F.when(n > 1e12, n).otherwise(n * 1000)).otherwise(F.unix_millis(F.try_to_timestamp(t)).cast("double")).cast("long")
        why = ladder(none, (value.isNull(), "unparseable date string"), (value < GENESIS_MS, "before genesis"), (value > now + FUTURE_SKEW_MS, "in the future"))
    else:
        raise ValueError(f"unknown rule kind {rule.kind}")
    return value, F.when(~empty, why)


def apply_rules(df: DataFrame, rules: list[Rule], now: int) -> DataFrame:
    """Clean columns plus ``issues array<struct<field, reason, received>>``. One narrow projection."""
    clean, issues = {}, []
    for r in rules:
        value, why = check(r, now)
        empty = F.col(r.field).isNull() | (F.trim(F.col(r.field).cast("string")) == "")
        clean[r.field] = F.when(~empty & why.isNull(), value)
        issues.append(F.when(why.isNotNull(), F.struct(F.lit(r.field).alias("field"), why.alias("reason"), F.substring(F.col(r.field).cast("string"), 1, RECEIVED_CAP).alias("received"))))
    found = F.filter(F.array(*issues), lambda x: x.isNotNull())
    keep = [c for c in df.columns if c not in clean]
    return df.select(*keep, *[v.alias(k) for k, v in clean.items()], found.alias("issues"))


def issue_table(clean: DataFrame, key: str) -> DataFrame:
    return clean.select(key, F.explode("issues").alias("i")).select(key, "i.*")


def issue_report(clean: DataFrame, key: str) -> DataFrame:
    """Roll-up by field and reason, with the smallest rejected key as an example."""
    return issue_table(clean, key).groupBy("field", "reason").agg(F.count("*").alias("n"), F.min(key).alias("example"))
