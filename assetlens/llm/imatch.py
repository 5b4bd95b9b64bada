"""I-Match fingerprints in DataFrame operations only.

A lexicon holds the terms whose share of documents lies in a band: common terms say nothing about a
text, rare ones change with any edit. A text keeps its distinct lexicon terms, sorted; the lexicon is
dealt at random into parts that together hold all of it, and each part in which the text has a term
gives its number and one hash of those terms. There are two such divisions, into larger and into
smaller parts, so that long and short texts both have parts with a term or two. One more hash covers
all distinct terms, so texts without lexicon terms differ too. The likeness of two fingerprints is the
share of equal hashes among the parts in which either has a term, in the division where it is larger;
the hash of all terms counts as one part more, so only equal fingerprints have likeness 1.

The lexicon's size has a bound that does not grow with the table: a term counts only with
``min_share`` of the documents, and the terms of all documents are the mean number of distinct terms
times the documents, so there are at most mean / min_share of them.

Null texts are empty; an empty text's fingerprint has no hash at all. Equal texts have equal
fingerprints. Rows that repeat an id follow each other by their text's hash; a null id comes after all
ids. Only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlens.llm.staging import staged

NO_ID = -(2**63)
_PLACES = 4  # hex digits of a part's number


@dataclass(frozen=True)
class Band:
    min_share: float = 0.001
    max_share: float = 0.05
    large: int = 6  # the first division has 2 ** large parts
    small: int = 9
    broadcast_terms: int = 1_000_000


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text: runs of letters, digits and all beyond ASCII, in lower case."""
    found = F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(F.array_distinct(F.transform(found, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def lexicon(df: DataFrame, band: Band, text_col: str) -> DataFrame:
    """(term) of every term whose share of documents lies in the band."""
    rows = df.count()
    each = df.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").count()
    return each.where((F.col("count") >= band.min_share * rows) & (F.col("count") <= max(2.0, band.max_share * rows))).select("term")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprint(kept: Column, everything: Column, band: Band) -> Column:
    """Numbers and hashes of the parts in which a sorted term array has a term, for both divisions."""

    def division(terms: Column, width: int) -> Column:
        """Terms of a part have their first ``width`` bits in common, so they lie together."""
        slot = lambda t: F.shiftrightunsigned(t, 64 - width)

        def part(begin, end):
            digest = F.substring(F.lpad(F.hex(F.xxhash64(F.slice(terms, begin + 1, end - begin))), 16, "0"), 1, 8)
            return F.lower(F.concat(F.lpad(F.hex(slot(F.get(terms, begin))), _PLACES, "0"), digest))

        begins = F.filter(F.transform(terms, lambda t, i: F.when((i == 0) | (slot(t) != slot(F.get(terms, i - 1))), i)), lambda i: i.isNotNull())
        return F.array_join(bound(begins, lambda b: F.transform(b, lambda begin, k: part(begin, F.coalesce(F.get(b, k + 1), F.size(terms))))), ".")

    return bound(kept, lambda terms: F.concat_ws("-", everything, division(terms, band.large), division(terms, band.small)))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the share of equal hashes among the parts used by either fingerprint, and 1 only if they are equal."""

    def share(x: Column, y: Column) -> Column:
        used = F.size(F.array_union(*(F.transform(parts, lambda p: F.substring(p, 1, _PLACES)) for parts in (x, y))))
        # a few used parts say little: they count as four, the hash of all terms included
        return F.size(F.array_intersect(x, y)) / F.greatest(used + 1, F.lit(4))

    def parts(prints: Column, k: int) -> Column:
        return F.array_remove(F.split(F.get(prints, F.lit(k)), r"\."), "")

    def of(x: Column, y: Column, k: int) -> Column:
        return bound(parts(x, k), lambda p: bound(parts(y, k), lambda q: share(p, q)))

    unlike = bound(F.split(a, "-"), lambda x: bound(F.split(b, "-"), lambda y: F.greatest(of(x, y, 1), of(x, y, 2))))
    return F.when(a == b, F.lit(1.0)).otherwise(unlike)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the key, found in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(F.array(*map(F.lit, bounds[step - 1 :: step])), lambda b: b <= key)) if len(bounds) >= step else F.lit(0)
    fine = F.size(F.filter(F.slice(F.array(*map(F.lit, bounds)), coarse * step + 1, F.lit(step)), lambda b: b <= key))
    return (coarse * step + fine).cast("int")


def edited_fingerprints(df: DataFrame, band: Band = Band(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they and the next document's are.

    The edited text ends with the beginning of the next document, by falling id. Ids are dealt to buckets
    at their quantiles; each bucket also gets the document that follows its last one, so texts are
    shuffled once and no order spans all rows. All that follows stays in that partitioning.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    many = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx("key", [i / many for i in range(1, many)], 10 * many).alias("cuts")).first()["cuts"]
    bucket = _bucket(F.col("key"), sorted(set(cuts or [])))
    # one row for each bucket reaches the driver
    tops = sorted((r["bucket"], r["top"]) for r in docs.select("key", bucket.alias("bucket")).groupBy("bucket").agg(F.max("key").alias("top")).collect())
    follower = [(tops[i - 1][1], tops[i][0]) for i in range(len(tops))]
    to = spark.createDataFrame(follower, "key long, also int")
    words = staged(lexicon(df, band, text_col), "lexicon")
    small = words.count() <= band.broadcast_terms
    words = words.unionByName(spark.createDataFrame([(0,)], "term long"))  # every document has this one
    dealt = docs.withColumn("bucket", bucket).join(F.broadcast(to), "key", "left")
    own, copy = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("copy")), F.struct(F.col("also").alias("b"), F.lit(True).alias("copy"))
    dealt = dealt.select("id", "key", "text", F.explode(F.filter(F.array(own, copy), lambda t: t["b"].isNotNull())).alias("to")).select("id", "key", "text", "to.b", "to.copy")
    order = Window.partitionBy("b").orderBy("copy", F.desc("key"), F.xxhash64("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    lines = dealt.select("b", "copy", "id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    lines = lines.select("b", "place", "copy", "id", F.char_length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    lines = lines.select("b", "place", "copy", "id", "n_chars", F.sha2("edited", 256).alias("sha"), terms(F.col("text")).alias("mine"), terms(F.col("edited")).alias("other"))

    def everything(t):
        return F.when(F.size(t) > 0, F.substring(F.sha2(F.concat_ws(",", F.transform(F.array_sort(t), lambda x: x.cast("string"))), 256), 1, 16)).otherwise(F.lit(""))

    about = F.struct(F.col("copy"), F.col("id"), F.col("n_chars"), F.col("sha"), everything(F.col("mine")).alias("all_mine"), everything(F.col("other")).alias("all_other"))
    row = lambda kind, term, info: F.struct(F.lit(kind).alias("kind"), term.alias("term"), info.alias("about"))
    nothing = F.lit(False)
    kinds = F.concat(
        F.array(row(0, F.lit(0).cast("long"), about)),
        F.transform(F.array_intersect("mine", "other"), lambda t: row(3, t, F.when(nothing, about))),
        F.transform(F.array_except("mine", "other"), lambda t: row(1, t, F.when(nothing, about))),
        F.transform(F.array_except("other", "mine"), lambda t: row(2, t, F.when(nothing, about))),
    )
    spread = lines.select("b", "place", F.explode(kinds).alias("x")).select("b", "place", "x.kind", "x.term", "x.about")
    kept = spread.join(F.broadcast(words) if small else words, "term")
    gathered = kept.groupBy("b", "place").agg(
        F.max("about").alias("about"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isin(1, 3), F.col("term")))).alias("mine"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isin(2, 3), F.col("term")))).alias("other"),
    )
    prints = gathered.select("b", "place", "about.*", fingerprint(F.col("mine"), F.col("about.all_mine"), band).alias("fingerprint"), fingerprint(F.col("other"), F.col("about.all_other"), band).alias("edited_fingerprint"))
    following = prints.withColumn("next", F.lead("fingerprint").over(Window.partitionBy("b").orderBy("place"))).where(~F.col("copy"))
    return following.select(
        F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
