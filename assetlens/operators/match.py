"""Look-alike matching of names against a reference list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.functions.text import fold_ticker

# Edit budget for short names (up to four letters) and for longer ones.
SHORT, SHORT_BUDGET, LONG_BUDGET = 4, 1, 2


def _piece_lengths(n):
    """Lengths of the pieces a reference of ``n`` letters is cut into: all equal but the last ones."""
    budget = F.when(n <= SHORT, SHORT_BUDGET).otherwise(LONG_BUDGET)
    size = F.ceil(n / (budget + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), budget), lambda i: F.least(size, n - i * size))


def near_matches(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """Candidate names within the edit budget of another key's reference name.

    Both sides fold first and collapse to distinct folded texts, so repeated names are compared
    once. Two texts within distance d agree on one of d + 1 pieces of the reference up to a
    shift of d, so the join is an equi-join on (piece, position) instead of all pairs; edit
    distance then checks what is left. Nothing is broadcast, so either side may grow.
    """
    c = candidates.select("key", "name", fold_ticker("name").alias("folded")).where("folded <> ''")
    r = refs.select(F.col("key").alias("ref_key"), F.col("name").alias("ref_name"), fold_ticker("name").alias("ref")).where("ref <> ''")
    ct, rt = c.select("folded").distinct(), r.select("ref").distinct()
    budget = F.when(F.length("ref") <= SHORT, SHORT_BUDGET).otherwise(LONG_BUDGET)
    rt = rt.withColumns({"budget": budget, "len": F.length("ref")})
    size = F.ceil(F.col("len") / (F.col("budget") + 1))
    rp = rt.withColumn("size", size).withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.col("budget")), lambda i: i * F.col("size"))))
    rp = rp.withColumn("piece", F.substr("ref", F.col("p") + 1, F.col("size")))
    # A reference shorter than its pieces leaves an empty piece, which any text of about its length matches.
    solid = rp.where("length(piece) > 0")
    lens = rp.where("length(piece) = 0").select("ref", "budget", "len").distinct().withColumn("clen", F.explode(F.sequence(F.greatest(F.col("len") - F.col("budget"), F.lit(1)), F.col("len") + F.col("budget"))))
    shift = solid.withColumn("pos", F.explode(F.sequence(F.col("p") - F.col("budget"), F.col("p") + F.col("budget")))).where("pos >= 0")
    # Piece lengths a reference of about this length can have; two or three values per text.
    parts = F.flatten(F.transform(F.sequence(F.greatest(F.length("folded") - LONG_BUDGET, F.lit(1)), F.length("folded") + LONG_BUDGET), _piece_lengths))
    grams = ct.withColumn("w", F.explode(F.array_distinct(F.filter(parts, lambda w: w > 0)))).where(F.length("folded") >= F.col("w")).withColumn(
        "pos", F.explode(F.sequence(F.lit(0), F.length("folded") - F.col("w")))).withColumn("piece", F.substr("folded", F.col("pos") + 1, F.col("w")))
    pairs = grams.join(shift, ["piece", "pos"]).select("folded", "ref", "budget").unionByName(
        ct.withColumn("clen", F.length("folded")).join(lens, "clen").select("folded", "ref", "budget")).distinct()
    near = pairs.where((F.abs(F.length("folded") - F.length("ref")) <= F.col("budget")) & (F.levenshtein("folded", "ref") <= F.col("budget")))
    return c.join(near.select("folded", "ref"), "folded").join(r, "ref").where(F.col("key") != F.col("ref_key")).select("key", "name", "ref_key", "ref_name")
