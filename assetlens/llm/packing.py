"""Best-fit packing of token sequences by linear grouping.

A document's ids end with an end id; one longer than a sequence is cut into full pieces, the shorter
remainder first. What the plan needs of a table of any size is how many pieces there are of each
length, at most one count for each length up to the sequence's: large lengths are cut into groups of
equal cardinality and rounded up to each group's largest, sequences are configured from these few
sizes (the largest that is left, then the subset that fills the rest best, as often as the counts
allow), the actual lengths take the places of the rounded ones, and small pieces go to the tightest
gap that holds them. Several numbers of groups are tried; the plan with the fewest sequences counts.

A plan is a list of runs: the pieces of one length ranked a to b go to consecutive sequences from s, all
at one offset. Ranks come from two levels (shards of a length, then rows of a shard), so no length is
numbered in one task, however many pieces have it.

Null and empty texts are a piece of the end id alone. Equal rows are separate pieces. An empty table
gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlens.llm.blocks import lists, ragged, text_blocks
from assetlens.llm.bytepieces import load
from assetlens.llm.staging import staged


@dataclass(frozen=True)
class Run:
    """Pieces of ``length`` with ranks from ``first`` to before ``last`` go to sequences from ``sequence`` on, at ``offset``."""

    length: int
    first: int
    last: int
    sequence: int
    offset: int


def cut_pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, piece number, start and length of every piece of documents of these sizes."""
    count = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    lead = sizes - (count - 1) * capacity  # the first piece takes the remainder
    start = np.where(piece == 0, 0, lead[row] + (piece - 1) * capacity)
    return row, piece, start, np.where(piece == 0, lead[row], capacity)


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece, and its ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer_path)
        for rows, data, offsets in text_blocks(batches):
            body, first = model.encode_block(data, offsets)
            ids = np.insert(body, first[1:], end_id).astype("<u4")
            first = first + np.arange(len(first))
            row, piece, start, length = cut_pieces(np.diff(first), capacity)
            at = first[row] + start
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist())]
            columns = [rows.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.array(crc, np.int64))]
            if keep_ids:
                columns.append(lists(ragged(ids, at, length).astype(np.int32), np.r_[0, np.cumsum(length)]))
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]
    return df.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def fill(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How often each size goes into ``room`` so that it is filled best, within what is left of each."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for i, s in enumerate(sizes):
        if s > room:
            continue
        for _ in range(min(left[i], room // s)):
            grown = (reach | (reach << s)) & mask
            if grown == reach:
                break
            steps.append((i, reach))
            reach = grown
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, take = reach.bit_length() - 1, [0] * len(sizes)
    for i, before in reversed(steps):
        if not before >> at & 1:
            take[i] += 1
            at -= sizes[i]
    return take


def configurations(sizes: list[int], left: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(group of each place, how many sequences) until nothing is left; ``sizes`` fall."""
    left, out = list(left), []
    for i, s in enumerate(sizes):
        while left[i]:
            left[i] -= 1
            take = fill(sizes, left, capacity - s)
            left[i] += 1
            take[i] += 1
            times = max(1, min(left[j] // t for j, t in enumerate(take) if t))
            for j, t in enumerate(take):
                left[j] -= t * times
            out.append(([j for j, t in enumerate(take) for _ in range(t)], times))
    return out


def plan_groups(counts: dict[int, int], capacity: int, groups: int, small: int) -> tuple[list[Run], int]:
    """Runs and the number of sequences for these counts of lengths below ``capacity``."""
    falling = sorted((n for n in counts if n >= small), reverse=True)
    amounts = np.array([counts[n] for n in falling], np.int64)
    ends = np.cumsum(amounts)
    total = int(ends[-1]) if len(ends) else 0
    per = -(-total // groups) if total else 1
    cuts = list(range(0, total, per))
    sizes = [falling[int(np.searchsorted(ends, c, side="right"))] for c in cuts]
    merged: dict[int, list[list[int]]] = {}  # groups of one rounded size are one
    for c, s in zip(cuts, sizes):
        merged.setdefault(s, []).append([c, min(c + per, total)])
    sizes = list(merged)
    place = [v[0][0] for v in merged.values()]  # where each group's next piece lies in the falling order
    runs: list[Run] = []
    gaps: dict[int, list[list[int]]] = {}
    sequence = 0
    for places, times in configurations(sizes, [v[-1][1] - v[0][0] for v in merged.values()], capacity):
        begins = []
        for g in places:
            begins.append(place[g])
            place[g] += times
        # split where any place goes over to another length
        marks = {0, times}
        for b in begins:
            lo, hi = np.searchsorted(ends, b, side="right"), np.searchsorted(ends, b + times, side="left")
            marks.update(int(e - b) for e in ends[lo:hi] if 0 < e - b < times)
        marks = sorted(marks)
        for lo, hi in zip(marks, marks[1:]):
            offset = 0
            for b in begins:
                k = int(np.searchsorted(ends, b + lo, side="right"))
                rank = b + lo - int(ends[k] - amounts[k])
                runs.append(Run(falling[k], rank, rank + hi - lo, sequence + lo, offset))
                offset += falling[k]
            if offset < capacity:
                gaps.setdefault(capacity - offset, []).append([sequence + lo, hi - lo])
        sequence += times
    for n in sorted((n for n in counts if n < small), reverse=True):
        rank, left = 0, counts[n]
        while left:
            room = min((g for g in gaps if g >= n), default=capacity)
            each = room // n
            if room in gaps:
                at, many = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room]
            else:
                at, many = sequence, -(-left // each)
                sequence += many
            each = min(each, left)
            used = min(many, left // each)
            for k in range(each):
                runs.append(Run(n, rank, rank + used, at, capacity - room + k * n))
                rank += used
            left -= used * each
            for gap, start, count in ((room - each * n, at, used), (room, at + used, many - used)):
                if gap and count:
                    gaps.setdefault(gap, []).append([start, count])
    return runs, sequence


def plan(counts: dict[int, int], capacity: int = 2048, groups: tuple[int, ...] = (16, 32, 64, 128, 256, 512, 1024), small_part: int = 8) -> tuple[list[Run], int]:
    """The best plan over the numbers of groups; full pieces are sequences of their own."""
    part = {n: c for n, c in counts.items() if n < capacity}
    runs, sequences = min((plan_groups(part, capacity, g, capacity // small_part) for g in groups), key=lambda p: p[1]) if part else ([], 0)
    full = counts.get(capacity, 0)
    if full:
        runs = [*runs, Run(capacity, 0, full, sequences, 0)]
    return runs, sequences + full


def ranked(cut: DataFrame, id_col: str) -> DataFrame:
    """``cut`` with the rank of each piece among those of its length, from 0."""
    shards = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    cut = cut.withColumn("shard", F.pmod(F.xxhash64(id_col, "piece"), F.lit(shards)))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("length", "shard").count().select("length", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "shard").orderBy(id_col, "piece", "ids_crc32", "start")
    return cut.withColumn("inside", F.row_number().over(inside)).join(base, ["length", "shard"]).withColumn("rank", F.col("base") + F.col("inside") - 1).drop("shard", "inside", "base")


def pack(cut: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """``cut`` (rows of :func:`pieces`) with sequence_id and offset."""
    spark = cut.sparkSession
    cut = staged(cut, "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most one row for each length
    runs, _ = plan(counts, capacity)
    table = pa.table({"length": [r.length for r in runs], "first": [r.first for r in runs], "last": [r.last for r in runs], "sequence": [r.sequence for r in runs], "offset": [r.offset for r in runs]}, schema=pa.schema([(c, pa.int64()) for c in ("length", "first", "last", "sequence", "offset")]))
    placed = spark.createDataFrame(table).withColumnRenamed("length", "of_length")
    if len(runs) <= 100_000:  # runs follow from the lengths and configurations, not from the number of rows
        placed = F.broadcast(placed)
    rows = ranked(cut, id_col)
    out = rows.join(placed, (rows["length"] == placed["of_length"]) & (rows["rank"] >= placed["first"]) & (rows["rank"] < placed["last"]))
    return out.select(*cut.columns, (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
