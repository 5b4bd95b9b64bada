"""Ordered and range computations that never need one key's whole series in one task.

A plain ``Window.partitionBy(asset)`` puts an asset's complete history on one executor. These
helpers add a position bucket (time or slot) to the key, work inside the bucket, and carry
across buckets through a per-bucket summary that is already aggregated when it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.functions.durable import cut


def dealt(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt by key to as many partitions as the session shuffles to.

    A repartition without a number is coalesced by the size of its rows, which puts small rows that
    are costly to work on into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread_lookup(rows: DataFrame, key: str, table: DataFrame, spread_by: str, most: int = 100_000) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key; rows whose key it lacks go.

    A key with more than ``most`` rows is split into as many shares as it takes, by a hash of ``spread_by``,
    and its row of ``table`` is repeated for each share, so no share has many more than ``most`` rows. The
    broadcast lists those keys: at most the number of rows divided by ``most``.
    """
    heavy = F.broadcast(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_ways")))
    ways = F.coalesce("_ways", F.lit(1))
    left = rows.join(heavy, key, "left").withColumn("_share", F.pmod(F.xxhash64(spread_by), ways).cast("int")).drop("_ways")
    right = table.join(heavy, key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), ways - 1))).drop("_ways")
    return left.join(right, [key, "_share"]).drop("_share")


def bucket_of(pos: str | Column, width: int) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(width))


def lag_across(
    df: DataFrame, keys: list[str], order: list[str], pos: str, width: int, cols: dict[str, str]
) -> DataFrame:
    """Add ``{new: old}`` columns holding the previous row's values in key order.

    Rows sort inside (keys, bucket); a bucket's first row takes the last row of the nearest
    earlier bucket. ``order`` must start with ``pos``. No predecessor gives nulls.
    """
    staged = df.withColumn("_b", bucket_of(pos, width))
    value = F.struct(*[F.col(old).alias(new) for new, old in cols.items()])
    inner = staged.withColumn("_p", F.lag(value).over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    tails = (
        staged.groupBy(*keys, "_b")
        .agg(F.max_by(value, F.struct(*order)).alias("_last"))
        .select(*keys, "_b", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("_c"))
    )
    prev = F.coalesce(F.col("_p"), F.col("_c"))
    return (
        inner.join(tails, [*keys, "_b"], "left")
        .withColumn("_prev", prev)
        .withColumns({new: F.col(f"_prev.{new}") for new in cols})
        .drop("_b", "_p", "_c", "_prev")
    )


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], pos: str, width: int, values: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums ``{out: value}`` in key order, split by bucket like ``lag_across``."""
    staged = df.withColumn("_b", bucket_of(pos, width)).withColumns({f"_v_{n}": v for n, v in values.items()})
    within = Window.partitionBy(*keys, "_b").orderBy(*order)
    inner = staged.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(within) for n in values})
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = staged.groupBy(*keys, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values]).select(
        *keys, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    out = inner.join(base, [*keys, "_b"], "left").withColumns({n: F.col(f"_s_{n}") + F.col(f"_o_{n}") for n in values})
    return out.drop("_b", *[f"{p}{n}" for n in values for p in ("_v_", "_s_", "_o_")])


def with_halo(df: DataFrame, pos: str, width: int, before: int, after: int) -> DataFrame:
    """Copy each row into every bucket whose rows can see it through [-before, +after].

    Adds ``_b`` and ``_core``; compute the range frame over (keys, _b), then keep ``_core``.
    With ``width >= before + after`` a row is copied at most twice.
    """
    p = F.col(pos)
    return df.withColumn(
        "_b", F.explode(F.sequence(bucket_of(p - F.lit(after), width), bucket_of(p + F.lit(before), width)))
    ).withColumn("_core", F.col("_b") == bucket_of(p, width))


def exact_median(df: DataFrame, keys: list[str], value: str, out: str, upper: bool = False) -> DataFrame:
    """Exact median per key (midpoint, or the upper element) without gathering a key's values.

    Equal values collapse first; a log-scale histogram then finds the one or two buckets that
    hold the middle ranks, and only those buckets' distinct values are ranked.
    """
    v = F.col(value).cast("double")
    counted = (
        df.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_n"))
        .withColumn("_b", F.floor(F.signum("_v") * F.log1p(F.abs("_v")) * 32))
    )
    hist = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(w)
    hist = hist.select(
        *keys, "_b", "_n", total.alias("_total"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start")
    )
    hi = F.floor(F.col("_total") / 2) + 1
    lo = hi if upper else F.floor((F.col("_total") + 1) / 2)
    hist = hist.withColumns({"_lo": lo, "_hi": hi}).where(
        ((F.col("_lo") > F.col("_start")) & (F.col("_lo") <= F.col("_start") + F.col("_n")))
        | ((F.col("_hi") > F.col("_start")) & (F.col("_hi") <= F.col("_start") + F.col("_n")))
    )
    ranked = counted.join(hist.drop("_n", "_total"), [*keys, "_b"]).withColumn(
        "_end",
        F.col("_start")
        + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)),
    )
    first = F.col("_end") - F.col("_n")

    def holds(rank: str) -> Column:
        return (F.col(rank) > first) & (F.col(rank) <= F.col("_end"))

    return ranked.groupBy(*keys).agg(
        (
            (F.max(F.when(holds("_lo"), F.col("_v"))) + F.max(F.when(holds("_hi"), F.col("_v")))) / F.lit(2.0)
        ).alias(out)
    )


def global_median(df: DataFrame, value: str, upper: bool = False, most: int = 10_000, accuracy: int = 10_000) -> float | None:
    """Exact median of a whole column (midpoint, or the upper element), found by narrowing a range.

    Each level asks quantile sketches, which combine on the map side, for bounds just below and above the
    wanted rank, counts what lies under the range, and goes on inside it, until the range has at most ``most``
    distinct values; those are counted and ranked. A level leaves about four in ``accuracy`` of the rows, so a
    few levels do for any column, however its values lie. No task and not the driver sees more than a sketch
    or ``most`` rows. Nulls do not count; without values the median is None.
    """
    v = F.col(value).cast("double")
    rows = cut(df.where(v.isNotNull()).select(v.alias("v")))
    total, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not total:
        return None

    def ranked(rank: int) -> float:
        lo, hi, before, n = low, high, 0, total
        while lo < hi:
            inside = rows.where(F.col("v").between(lo, hi))
            values = inside.groupBy("v").agg(F.count("*").alias("n"))
            if values.limit(most + 1).count() <= most:
                for r in values.orderBy("v").collect():
                    before += r["n"]
                    if before >= rank:
                        return r["v"]
            share, slack = (rank - before) / n, 2 / accuracy
            a, b = inside.agg(F.percentile_approx("v", [max(0.0, share - slack), min(1.0, share + slack)], accuracy)).first()[0]
            under, within = inside.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v").between(a, b))).first()
            if not under < rank - before <= under + within or within == n:
                # the sketch was no help: halve the range
                left = F.col("v") <= lo / 2 + hi / 2
                lower, a, b = inside.agg(F.count_if(left), F.max(F.when(left, F.col("v"))), F.min(F.when(~left, F.col("v")))).first()
                a, b, under, within = (lo, a, 0, lower) if rank - before <= lower else (b, hi, lower, n - lower)
            lo, hi, before, n = a, b, before + under, within
        return lo

    top = total // 2 + 1
    return (ranked(top if upper else (total + 1) // 2) + ranked(top)) / 2


def islands(df: DataFrame, keys: list[str], pos: str, gap: int) -> DataFrame:
    """Add ``island``: rows of a key more than two empty-bucket gaps apart get different ids.

    Occupied (key, bucket) pairs are distinct-ed first, so the ordered step sees one row per
    occupied bucket. Rows at most ``gap`` apart always share an island.
    """
    staged = df.withColumn("_b", bucket_of(pos, gap))
    occupied = staged.groupBy(*keys, "_b").agg(F.lit(1).alias("_one"))
    w = Window.partitionBy(*keys).orderBy("_b")
    starts = occupied.withColumn(
        "_new", F.when(F.col("_b") - F.lag("_b").over(w) <= 1, F.lit(0)).otherwise(F.lit(1))
    )
    ids = starts.select(*keys, "_b", F.sum("_new").over(w).alias("island"))
    return staged.join(ids, [*keys, "_b"]).drop("_b")
