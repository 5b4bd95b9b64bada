"""Vector codes by product quantisation, the codebooks learned by Lloyd rounds over resident members.

A vector is cut into equal parts; each part position has a codebook of a few entries. The parts live in a
table bucketed by their owner, (position, entry, salt): an owner's members lie together on one place. A
round has two steps. Each owner sums its resident members, read bucket by bucket without a shuffle, and the
sums of the salts give the new entries. Then every owner holds its members against the new entries: members
that stay are written to the same bucket from where they lie, and only parts whose entry changed go through
a shuffle to their new owner. A round's table replaces the one before it, which is then removed.

The salt spreads an entry that owns a third of all parts over as many owners as there are partitions. What
reaches the driver are sums of at most positions x entries rows a round, and the vectors of the first
codebook; what every task gets are the codebooks, which are as small. The last assignment needs no members
together and is made row by row from the input, so repeated rows and rows without an id keep their place.

Rows whose vector is null or holds null or non-finite components are dropped. A vector has to be as long as
the first one, by id, whose length is a positive multiple of the number of parts; others teach nothing and
get no code and no error. Components are floored after scaling; beyond 2 ** 29 in magnitude they count as
2 ** 29, so that squared distances stay below 2 ** 63. The first codebook takes distinct ids, without null
ones; of an id's rows the smallest vector counts; if there are fewer ids than entries, the codebook is
smaller. Ties go to the lower entry. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm.staging import new_folder

LARGEST = 2**29
_BATCH = 4096  # vectors or parts that are compared with a codebook at once


@dataclass(frozen=True)
class Settings:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: float = 4096.0


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, place]; width is the length of a part."""

    entries: np.ndarray
    scale: float

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Vectors that are there and hold finite numbers only."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole_numbers(flat: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(flat.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64)


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row's own codebook and its squared distance; values[n, width], entries[n or 1, k, width]."""
    distance = ((values[:, None, :] - entries) ** 2).sum(2)
    best = distance.argmin(1)
    return best, distance[np.arange(len(values)), best]


def _dense(batch: pa.RecordBatch, k: int, width: int, scale: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their vectors of the right length as whole numbers, and which rows those are."""
    for at in range(0, batch.num_rows, _BATCH):
        rows = batch.slice(at, _BATCH)
        column = rows.column(k)
        bounds = column.offsets.to_numpy()
        right = np.diff(bounds) == width
        flat = column.values.to_numpy(zero_copy_only=False)
        index = (bounds[:-1][right][:, None] + np.arange(width)).ravel()
        yield rows, whole_numbers(flat[index], scale).reshape(-1, width), right


def first_codebooks(df: DataFrame, s: Settings, id_col: str, vector_col: str) -> Codebooks | None:
    """Parts of the vectors with the smallest ids; None without any."""
    length = F.size(vector_col)
    fit = df.where(F.col(id_col).isNotNull() & (length > 0) & (length % s.parts == 0)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    top = fit.orderBy("id").limit(1).select(F.size("v")).first()
    if top is None:
        return None
    rows = fit.where(F.size("v") == top[0]).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(s.entries).collect()
    whole = whole_numbers(np.array([r["v"] for r in rows], np.float64), s.scale)
    return Codebooks(np.ascontiguousarray(whole.reshape(len(rows), s.parts, -1).transpose(1, 0, 2)), s.scale)


def _parts_schema(width: int, *more: str) -> str:
    return ", ".join(["position int", "entry int", "salt int", *more, *(f"x{i} long" for i in range(width))])


def _dealt(df: DataFrame, books: Codebooks, salts: int, vector_col: str, id_col: str) -> DataFrame:
    """Every part of every vector with its first owner."""
    entries, width, scale = books.entries, books.width, books.scale
    count = len(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, whole, right in _dense(batch, 1, count * width, scale):
                salt = rows.column(0).to_numpy()[right]
                for p in range(count):
                    mine = whole[:, p * width : (p + 1) * width]
                    best, _ = nearest(mine, entries[p][None])
                    columns = [np.full(len(mine), p, np.int32), best.astype(np.int32), ((salt + p) % salts).astype(np.int32), *(mine[:, i] for i in range(width))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["position", "entry", "salt", *(f"x{i}" for i in range(width))])

    salt = F.pmod(F.xxhash64(id_col, vector_col), F.lit(salts)).cast("int")
    return df.select(salt.alias("salt"), F.col(vector_col).alias("v")).mapInArrow(run, _parts_schema(width))


def _compared(members: DataFrame, books: Codebooks) -> DataFrame:
    """Resident members with the entry they belong to now, as ``next``."""
    entries, width = books.entries, books.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                rows = batch.slice(at, _BATCH)
                position = rows.column(0).to_numpy()
                values = np.stack([rows.column(3 + i).to_numpy() for i in range(width)], axis=1)
                best, _ = nearest(values, entries[position])
                columns = [rows.column(0), rows.column(1), rows.column(2), pa.array(best.astype(np.int32)), *(rows.column(3 + i) for i in range(width))]
                yield pa.RecordBatch.from_arrays(columns, ["position", "entry", "salt", "next", *(f"x{i}" for i in range(width))])

    return members.mapInArrow(run, _parts_schema(width, "next int"))


OWNER = ("position", "entry", "salt")


class Residents:
    """The table of all parts, bucketed by owner."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.name, self.path = spark, buckets, None, None

    def members(self) -> DataFrame:
        return self.spark.table(self.name)

    def replace(self, parts: DataFrame) -> None:
        """Writes ``parts`` as the new table and removes the one before it."""
        before = self.name, self.path
        self.name, self.path = f"members_{uuid.uuid4().hex}", new_folder(self.spark, "members")
        parts.write.bucketBy(self.buckets, *OWNER).option("path", self.path).saveAsTable(self.name)
        self.drop(*before)

    def drop(self, name: str | None, path: str | None) -> None:
        if name:
            self.spark.sql(f"DROP TABLE {name}")
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def move(self, books: Codebooks) -> None:
        """Members whose entry changed go to their new owner; the others stay where they are."""
        now = _compared(self.members(), books)
        columns = [*OWNER, *(f"x{i}" for i in range(books.width))]
        stay = now.where(F.col("next") == F.col("entry")).select(columns)
        moved = now.where(F.col("next") != F.col("entry")).withColumn("entry", F.col("next")).select(columns)
        self.replace(stay.unionByName(moved.repartition(self.buckets, *OWNER)))

    def updated(self, books: Codebooks) -> Codebooks:
        """Means, floored, of each entry's members; unused entries stay."""
        sums = [F.sum(f"x{i}").alias(f"x{i}") for i in range(books.width)]
        by_owner = self.members().groupBy(*OWNER).agg(F.count("*").alias("n"), *sums)
        rows = by_owner.groupBy("position", "entry").agg(F.sum("n").alias("n"), *sums).collect()
        entries = books.entries.copy()
        for r in rows:
            entries[r["position"], r["entry"]] = [r[f"x{i}"] // r["n"] for i in range(books.width)]
        return Codebooks(entries, books.scale)


def learn(df: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks | None:
    """Codebooks after all rounds."""
    spark = df.sparkSession
    good = df.where(usable(F.col(vector_col)))
    books = first_codebooks(good, s, id_col, vector_col)
    if books is None:
        return None
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    residents = Residents(spark, owners)
    for k in range(s.rounds):
        if k:
            residents.move(books)
        else:
            residents.replace(_dealt(good, books, owners, vector_col, id_col).repartition(owners, *OWNER))
        books = residents.updated(books)
    residents.drop(residents.name, residents.path)
    return books


def encode(df: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error) of every usable row."""
    schema = f"id {df.schema[id_col].dataType.simpleString()}, label {df.schema[label_col].dataType.simpleString()}, code string, error long"
    good = df.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    if books is None:
        return good.select(F.col("id").alias(id_col), F.col("label").alias(label_col), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    entries, width, scale = books.entries, books.width, books.scale
    count = len(entries)
    digits = np.array([f"{i:02x}" for i in range(max(256, entries.shape[1]))], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, whole, right in _dense(batch, 2, count * width, scale):
                code, error = np.full(len(whole), "", object), np.zeros(len(whole), np.int64)
                for p in range(count):
                    best, distance = nearest(whole[:, p * width : (p + 1) * width], entries[p][None])
                    code, error = code + digits[best], error + distance
                codes, errors = np.full(len(right), None, object), np.zeros(len(right), np.int64)
                codes[right], errors[right] = code, error
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(codes, pa.string()), pa.array(errors, mask=~right)], ["id", "label", "code", "error"])

    coded = good.mapInArrow(run, schema)
    return coded.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error")


def with_label_errors(coded: DataFrame, id_col: str = "vec_id", label_col: str = "label", shards: int = 32) -> DataFrame:
    """Rows with their label's summed error. The sums are repeated for each shard, so a frequent label's rows are spread over as many keys."""
    key = F.struct(F.col(label_col).isNull(), F.coalesce(F.col(label_col).cast("string"), F.lit("")))
    sums = coded.groupBy(key.alias("_key")).agg(F.sum("error").alias("label_error")).select("_key", "label_error", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"))
    rows = coded.withColumn("_key", key).withColumn("_shard", F.pmod(F.xxhash64(id_col, "code"), F.lit(shards)).cast("int"))
    return rows.join(sums, ["_key", "_shard"]).drop("_key", "_shard")
