"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets, and union-find.

A text's set is its distinct five-word shingles as 64-bit rolling hashes. SuperMinHash gives every
element a permutation of the signature's slots and takes, in round j, the slot at place j with a value
in [j, j + 1). A text stops as soon as all its slots are below j + 1: no later round can lower them.
All elements of a block go through a round together.

Texts with equal sets form a class (by a 128-bit fingerprint of the set) and only its smallest id goes
on. Signatures are cut into bands. In a bucket (texts with one band in common) every member is held
against the bucket's smallest id, so a bucket of any size makes as many pairs as it has members; the
pairs are confirmed on the full sets and joined to components. Buckets whose members are then still in
several components are gone through again with the largest id. What is still apart after that is held
against every member of the bucket's other components: pair by pair in buckets of a few members, and in
larger ones block against block, where a product of 0/1 matrices gives the intersections of all sets of
two blocks at once and only links that join components leave the task.

Null and empty texts have no shingles and stay alone. Rows with equal texts are one class. An id with
several texts is linked through any of them. Classes whose rows all have a null id take part under a key
made from their set's fingerprint, above all ids (ids are below 2 ** 62); a component of such classes alone
has a null id, and the text of least hash in the class of least key is the one that stays. A very long text
is a block of its own. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.llm.blocks import flat_text, row_of, span_hashes, splitmix, text_blocks, words
from assetlens.llm.components import components
from assetlens.llm.staging import staged

_STEP = np.uint64(0xD1342543DE82EF95)
_LOW = np.uint64(0xFFFFFFFF)
NAMELESS = 1 << 62  # keys of classes without an id begin here


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 75  # least similarity, in hundredths
    bands: int = 32
    rows: int = 4
    few: int = 16  # members of a bucket whose pairs are listed one by one
    block: int = 256  # members in a block of a larger bucket
    block_bytes: int = 1 << 18  # text that is signed at once: each distinct shingle holds a byte for each slot
    wide_bytes: int = 1 << 23  # text in a block of a larger bucket

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text of a block, sorted within each text, and each text's first position."""
    _, _, first, h = words(data, offsets)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.r_[0, np.cumsum(count)]
    row = row_of(at)
    start = first[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    shingle = span_hashes(h, start, np.minimum(start + size, first[1:][row]))
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    fresh = np.ones(len(shingle), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1])
    return shingle[fresh], np.r_[0, np.cumsum(fresh)][at]


def super_minhash(elements: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """Signatures, a row for each set: slot values as round * 2**32 + fraction. An empty set has none below the maximum."""
    rows = len(first) - 1
    signature = np.full(rows * slots, np.iinfo(np.uint64).max, np.uint64)
    row, h = row_of(first), elements
    place_type = np.uint8 if slots <= 256 else np.uint16
    places = None
    for j in range(slots):
        if not len(h):
            break
        x = splitmix(h + np.uint64((j + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        k = j + (((x & _LOW) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if places is None:
            place = k
        else:
            each = np.arange(len(h))
            place = places[each, k].astype(np.int64)
            places[each, k] = places[:, j]
        np.minimum.at(signature, row * slots + place, (np.uint64(j) << np.uint64(32)) | (x >> np.uint64(32)))
        live = signature.reshape(rows, slots).max(1) >= np.uint64(j + 1) << np.uint64(32)
        keep = live[row]
        if places is None:
            row, h, k = row[keep], h[keep], k[keep]
            places = np.tile(np.arange(slots, dtype=place_type), (len(k), 1))
            places[np.arange(len(k)), k] = 0
        elif 2 * np.count_nonzero(keep) <= len(keep):
            # a finished text's elements change nothing any more, so they may wait until they are half of all
            row, h, places = row[keep], h[keep], places[keep]
    return signature.reshape(rows, slots)


def describe(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set size, both halves of the set's fingerprint, and the band keys of every text of a block."""
    elements, first = shingle_sets(data, offsets, s.words)
    n = np.diff(first)
    halves = []
    for seed in (1, 2):
        total = np.r_[np.uint64(0), np.cumsum(splitmix(elements + np.uint64(seed * int(_STEP) & 0xFFFFFFFFFFFFFFFF)), dtype=np.uint64)]
        halves.append(splitmix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)).view(np.int64))
    signature = super_minhash(elements, first, s.slots).reshape(len(n), s.bands, s.rows)
    band = np.broadcast_to(splitmix(np.arange(s.bands) + 1), (len(n), s.bands))
    for r in range(s.rows):
        band = splitmix(band * _STEP + signature[:, :, r])
    return n, *halves, band.view(np.int64)


def signatures(df: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, f1, f2, bands, text_hash) of every row; bands are null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, limit=s.block_bytes):
            n, f1, f2, band = describe(data, offsets, s)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * s.bands), pa.array(band.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), keys, rows.column(2)], ["id", "n_shingles", "f1", "f2", "bands", "text_hash"])

    read = df.select(F.col(id_col).cast("long").alias("id"), text_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    return read.mapInArrow(run, "id long, n_shingles long, f1 long, f2 long, bands array<long>, text_hash long")


def confirmed(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Those of the pairs (u, v) whose full sets are similar enough; ``texts`` has (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks([batch], text=2, limit=s.block_bytes):
                left, a = shingle_sets(data, offsets, s.words)
                keep = np.zeros(rows.num_rows, bool)
                done = 0
                for _, other, bounds in text_blocks([rows], text=3, limit=s.block_bytes):
                    right, b = shingle_sets(other, bounds, s.words)
                    for i in range(len(b) - 1):
                        x, y = left[a[done] : a[done + 1]], right[b[i] : b[i + 1]]
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep[done] = both > 0 and 100 * both >= s.percent * (len(x) + len(y) - both)
                        done += 1
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(mask), rows.column(1).filter(mask)], ["u", "v"])

    left = texts.select(F.col("id").alias("u"), F.col("text").alias("left"))
    right = texts.select(F.col("id").alias("v"), F.col("text").alias("right"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "left", "right").mapInArrow(run, "u long, v long")


def intersections(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, slab: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of one side with all of the other, by products of 0/1 matrices a slab of elements wide."""
    out = np.zeros((len(a) - 1, len(b) - 1), np.float32)
    common = np.intersect1d(left, right)
    sides = []
    for elements, first in ((left, a), (right, b)):
        at = np.minimum(np.searchsorted(common, elements), max(len(common) - 1, 0))
        hit = common[at] == elements if len(common) else np.zeros(len(elements), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], row_of(first)[hit][order], len(first) - 1))
    for lo in range(0, len(common), slab):
        x, y = (_indicator(at, row, n, lo, slab) for at, row, n in sides)
        out += x @ y.T
    return out.astype(np.int64)


def _indicator(at: np.ndarray, row: np.ndarray, rows: int, lo: int, slab: int) -> np.ndarray:
    m = np.zeros((rows, slab), np.float32)
    i, j = np.searchsorted(at, [lo, lo + slab])
    m[row[i:j], at[i:j] - lo] = 1
    return m


def _open_links(s: Settings):
    """Links between different components of two blocks of one bucket, no more than join them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (reps, comp, x, a), (other, comp2, y, b) = ((v.field("rep").to_numpy(), v.field("component").to_numpy(), *shingle_sets(*flat_text(v.field("text")), s.words)) for v in (batch.column(k)[i].values for k in (0, 1)))
                both = intersections(x, a, y, b)
                union = np.diff(a)[:, None] + np.diff(b)[None, :] - both
                p, q = np.nonzero((both > 0) & (100 * both >= s.percent * union) & (comp[:, None] != comp2[None, :]))
                _, one = np.unique(np.minimum(comp[p], comp2[q]).view(np.uint64) * _STEP ^ np.maximum(comp[p], comp2[q]).view(np.uint64), return_index=True)
                u, v = reps[p[one]], other[q[one]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return run


def _in_blocks(rows: DataFrame, name: str, s: Settings) -> DataFrame:
    """Members of each bucket in blocks of bounded size, dealt by hash."""
    size = rows.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / s.block, F.sum("n") / (s.block * 200), F.sum(F.octet_length("text")) / s.wide_bytes)).alias("blocks"))
    return rows.join(size, "band").groupBy("band", F.pmod(F.xxhash64("rep"), "blocks").alias(name + "_block")).agg(F.collect_list(F.struct("rep", "component", "text")).alias(name))


def near_duplicates(df: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", keep_text_hash: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``df``, and a hash of its text if asked for."""
    described = staged(signatures(df, s, id_col, text_col), "signatures")
    rows = described.count()
    key = F.coalesce(F.col("id"), F.lit(NAMELESS) + F.col("f1").bitwiseAND(F.lit(NAMELESS // 2 - 1)))
    keyed = described.where("n_shingles > 0").withColumn("key", key)
    classes = staged(keyed.groupBy("f1", "f2").agg(F.min("key").alias("rep"), F.min_by("bands", "key").alias("bands"), F.first("n_shingles").alias("n"), F.min("text_hash").alias("first_text")), "classes", rows)
    in_bands = classes.select("rep", "n", F.explode("bands").alias("band"))
    crowded = in_bands.groupBy("band").agg(F.count("*").alias("members"), F.min(F.struct("rep", "n")).alias("low"), F.max(F.struct("rep", "n")).alias("high")).where("members > 1")
    buckets = staged(in_bands.join(crowded, "band").select("band", "rep", "n", "members", "low", "high"), "buckets")
    wanted = buckets.select(F.col("rep").alias("id")).distinct()
    named = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    nameless = keyed.where("id is null").select(F.col("key").alias("id"), "text_hash").distinct().join(wanted, "id", "left_semi")
    unnamed = df.where(F.col(id_col).isNull()).select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text")).groupBy("text_hash").agg(F.first("text").alias("text"))
    texts = staged(named.unionByName(nameless.join(unnamed, "text_hash").select("id", "text")), "texts")

    def like(m, n):
        """Sets whose sizes differ more cannot be similar enough."""
        return (100 * F.least(m, n)) >= s.percent * F.greatest(m, n)

    def against(side: str, rows: DataFrame) -> DataFrame:
        """Every member of a bucket with the bucket's first or last member."""
        other = F.col(f"{side}.rep")
        return rows.where((F.col("rep") != other) & like(F.col("n"), F.col(f"{side}.n"))).select(F.least("rep", other).alias("u"), F.greatest("rep", other).alias("v")).distinct()

    def still_open(group: DataFrame) -> DataFrame:
        """Buckets whose members lie in several components."""
        named = buckets.join(group, buckets.rep == group.node, "left").select("band", "rep", "n", "members", "low", "high", F.coalesce("component", "rep").alias("component"))
        apart = named.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band")
        return named.join(apart, "band")

    tried = staged(against("low", buckets), "pairs", s.bands * rows)
    links = staged(confirmed(tried, texts, s), "links")
    group = staged(components(links), "groups", rows)
    pairs = staged(against("high", still_open(group)).join(tried, ["u", "v"], "left_anti"), "pairs")
    links = links.unionByName(staged(confirmed(pairs, texts, s), "links"))
    tried = tried.unionByName(pairs)
    group = staged(components(links), "groups", rows)

    rest = staged(still_open(group), "open")
    few = rest.where(F.col("members") <= s.few)
    other = few.select("band", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("component").alias("component2"))
    each = few.join(other, "band").where((F.col("rep") < F.col("rep2")) & (F.col("component") != F.col("component2")) & like(F.col("n"), F.col("n2")))
    pairs = each.select(F.col("rep").alias("u"), F.col("rep2").alias("v")).distinct().join(tried, ["u", "v"], "left_anti")
    more = confirmed(pairs, texts, s)
    # large buckets: all members of the smaller components against all members, block by block
    many = rest.where(F.col("members") > s.few)
    main = many.groupBy("band", "component").count().groupBy("band").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    full = many.join(main, "band").join(texts.withColumnRenamed("id", "rep"), "rep").select("band", "rep", "n", "component", "text", "main")
    left, right = _in_blocks(full.where("component <> main"), "left", s), _in_blocks(full, "right", s)
    blocks = left.join(right, "band").select("left", "right").mapInArrow(_open_links(s), "u long, v long")
    links = links.unionByName(staged(more.unionByName(blocks), "links"))
    group = staged(components(links), "groups", rows)

    label = F.coalesce("component", "rep")
    of_class = classes.join(group, classes.rep == group.node, "left").select("f1", "f2", F.when(label < NAMELESS, label).alias("component_id"), F.when(label == F.col("rep"), F.col("first_text")).alias("first_text"))
    out = described.select("id", "n_shingles", "f1", "f2", "text_hash").join(of_class, ["f1", "f2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    stays = F.col("id").eqNullSafe(component) & (F.col("id").isNotNull() | (F.col("n_shingles") == 0) | F.col("first_text").eqNullSafe(F.col("text_hash")))
    also = ["text_hash"] if keep_text_hash else []
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), *also, stays.alias("kept"))


def kept_rows(df: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, that stay: one of each group, rows that repeat an id and text once.

    Rows are found again by id and text together, so a null id or an id with several texts does no harm.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    stays = near_duplicates(df, s, id_col, text_col, keep_text_hash=True).where("kept").select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = df.withColumn("_key", key)
    return rows.join(stays, rows[id_col].eqNullSafe(stays["_id"]) & (rows["_key"] == stays["_hash"]), "left_semi").dropDuplicates([id_col, "_key"]).drop("_key")
