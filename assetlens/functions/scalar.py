"""Column helpers: bands, rounding, exact ratios and size buckets. All JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; null stays null (``greatest`` alone would skip it)."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def clamp01(c) -> Column:
    return clamp(as_col(c).cast("double"), 0.0, 1.0)


def half_up(c, digits: int = 0) -> Column:
    """Round half towards +infinity; Spark's ``round`` goes away from zero instead."""
    scale = float(10**digits)
    return F.floor(as_col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def log_band(c, low: float, high: float) -> Column:
    """0 at ``low``, 1 at ``high``, linear in log10 between; non-positive earns 0."""
    c = as_col(c).cast("double")
    lo, hi = F.log10(F.lit(float(low))), F.log10(F.lit(float(high)))
    return F.when(c <= 0, F.lit(0.0)).otherwise(clamp01((F.log10(c) - lo) / (hi - lo)))


def log_band_hard(c, low: float, high: float) -> Column:
    """Natural-log band with hard ends."""
    c = as_col(c).cast("double")
    return (
        F.when(c.isNull(), F.lit(None).cast("double"))
        .when(c <= low, F.lit(0.0))
        .when(c >= high, F.lit(1.0))
        .otherwise(F.log(c / F.lit(float(low))) / F.log(F.lit(float(high)) / F.lit(float(low))))
    )


def gauss_band(c, ideal: Column | float, spread: float) -> Column:
    ideal = F.lit(ideal) if isinstance(ideal, (int, float)) else ideal
    z = (as_col(c) - ideal) / F.lit(float(spread))
    return clamp01(F.exp(F.lit(-0.5) * z * z))


def exact_ratio(num, den) -> Column:
    """num/den for u64-sized decimals, truncated (not rounded) to nine digits."""
    n = as_col(num).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    d = as_col(den).cast("decimal(20,0)")
    safe = F.when((d > 0) & (n >= 0), d)
    q = (n - F.pmod(n, safe)) / safe
    return q.cast("decimal(38,0)").cast("double") / F.lit(1e9)


def sig3(c) -> Column:
    """A whole amount rounded half-up to three significant digits."""
    x = as_col(c).cast("decimal(20,0)")
    digits = F.length(x.cast("string"))
    unit = F.pow(F.lit(10.0), F.greatest(digits - 3, F.lit(0))).cast("decimal(20,0)")
    half = F.when(unit > 1, (unit / 2).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
    shifted = x + half
    return (shifted - F.pmod(shifted, unit)).cast("decimal(21,0)")


def ladder(default, *steps) -> Column:
    """First matching (predicate, value) wins; an unknown predicate never matches."""
    out = None
    for pred, value in steps:
        pred = F.coalesce(pred, F.lit(False))
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(pred, value) if out is None else out.when(pred, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def known(pred: Column) -> Column:
    """Three-valued predicate as a plain boolean: unknown counts as not held."""
    return F.coalesce(pred, F.lit(False))


def codes(*pairs) -> Column:
    """Array of the codes whose predicate holds, in the given order."""
    return F.filter(
        F.array(*[F.when(known(p), c if isinstance(c, Column) else F.lit(c)) for p, c in pairs]),
        lambda x: x.isNotNull(),
    )


def lookup(key, table: dict, default=None) -> Column:
    """Constant map as a CASE expression; folds into the plan, nothing is broadcast."""
    key = as_col(key)
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def weighted_sum(parts: list[tuple[float, Column]]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(v, F.lit(0.0)) for w, v in parts])


def fmt_usd(c) -> Column:
    """Short dollar text: $1.23B / $4.56M / $7.8K / $9.10; unknown is a dash."""
    c = as_col(c).cast("double")
    a = F.abs(c)

    def num(x, d):
        return F.concat(F.lit("$"), F.format_string(f"%.{d}f", half_up(x, d)))

    return (
        F.when(c.isNull() | F.isnan(c), F.lit("-"))
        .when(a >= 1e9, F.concat(num(c / 1e9, 2), F.lit("B")))
        .when(a >= 1e6, F.concat(num(c / 1e6, 2), F.lit("M")))
        .when(a >= 1e3, F.concat(num(c / 1e3, 1), F.lit("K")))
        .when(a >= 1, num(c, 2))
        .when(a == 0, F.lit("$0"))
        .otherwise(num(c, 4))
    )


def fmt_age(hours) -> Column:
    h = as_col(hours).cast("double")
    return (
        F.when(h.isNull(), F.lit("-"))
        .when(h < 1, F.concat(F.floor(h * 60 + 0.5).cast("string"), F.lit("m")))
        .when(h < 48, F.concat(F.format_string("%.1f", half_up(h, 1)), F.lit("h")))
        .otherwise(F.concat(F.format_string("%.1f", half_up(h / 24, 1)), F.lit("d")))
    )
