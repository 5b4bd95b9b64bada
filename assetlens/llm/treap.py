"""Ranked lexical search: the best documents for each item by a K2-treap over the grid of terms and documents.

Documents are cut into terms once; of each only the places of terms that some item asks for are kept, with
its number of terms. Corpus counts follow from these rows: documents, terms, and how many documents hold
each term. Then tasks take their documents in blocks. A block is a grid, a row for each asked term (rows in
order of weight) and a column for each document (in order of id), whose cells hold the term's share of a
score. The grid is stored as a compressed quadtree: a node has a four-bit mask of its quadrants that are not
empty, the number of its first child, and the largest cell below it.

An item walks down the quadtree along the paths of all its rows together. A document range has for each row
the node that covers both, and the sum of their largest cells, times how often the item repeats the term,
bounds every score in the range. Ranges with the highest bounds are halved first, a batch of them at a
time; a range of one document is a score. A range ends when its bound, or at an equal bound its first
document, comes after the worst of the best documents so far. Those go with the task from block to block,
so a task emits only its best documents for each item; the best over all tasks are ranked in one more step.

Items are the stated query set; they are taken in blocks of bounded text, so nothing broadcast grows with
their number, and documents are never paired with them. Terms are compared by 64-bit hashes.

Null and empty texts have no terms: such a document counts nowhere, such an item finds nothing. Rows of
items and documents that repeat are items and documents of their own; equal scores rank by id, null last.
A very long text is a block of its own when it is cut into terms, and one column of a grid; for items of many
terms grids get fewer columns. Empty tables give an empty result. Only id and text columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlens.llm.blocks import ALNUM, flat_text, lists, ragged, row_of, text_blocks, words
from assetlens.llm.staging import staged

NO_ID = 2**63 - 1  # where a null id stands in the order


@dataclass(frozen=True)
class Settings:
    best: int = 20
    columns: int = 1 << 15  # most documents in a grid
    cells: int = 1 << 20  # a grid is closed when it holds as many
    batch: int = 256  # ranges halved at once
    paths: int = 1 << 22  # most row paths of one item over a whole grid
    item_bytes: int = 1 << 22  # text of the items that are searched together


@dataclass(frozen=True)
class Items:
    """Asked terms in order of hash, and each item's rows with their repeats."""

    hashes: np.ndarray
    rows: list[np.ndarray]
    times: list[np.ndarray]


@dataclass(frozen=True)
class Corpus:
    documents: int  # with a term
    terms: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def share(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 25 + (25 * n * self.documents) // max(self.terms, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def read_items(texts: list[str | None]) -> Items:
    _, _, first, h = words(*flat_text(pa.array(texts, pa.string())), ALNUM)
    hashes, row = np.unique(h, return_inverse=True)
    own = [np.unique(row[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]
    return Items(hashes, [r for r, _ in own], [t.astype(np.int64) for _, t in own])


class Quadtree:
    """A grid of cells (row, column, value): nodes of all levels in one numbering, the last of them empty."""

    _BELOW = np.array([[bin(mask & ((1 << q) - 1)).count("1") for q in range(4)] for mask in range(16)])

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, side: int):
        self.height = side
        code = _morton(row, column, side)
        order = np.argsort(code)
        code, top = code[order], value[order]
        levels = [(np.zeros(len(code), np.uint8), np.zeros(len(code), np.int64), top)]
        for _ in range(side):
            up = code >> 2
            start = np.flatnonzero(np.r_[True, up[1:] != up[:-1]]) if len(up) else np.zeros(0, np.int64)
            mask = np.bitwise_or.reduceat(np.uint8(1) << (code & 3).astype(np.uint8), start) if len(up) else np.zeros(0, np.uint8)
            top = np.maximum.reduceat(top, start) if len(up) else top
            levels.append((mask, start, top))
            code = up[start]
        levels.reverse()
        sizes = np.cumsum([len(mask) for mask, _, _ in levels])
        self.empty = int(sizes[-1])
        self.mask = np.r_[tuple(mask for mask, _, _ in levels) + (np.zeros(1, np.uint8),)]
        self.first = np.r_[tuple(first + at for (_, first, _), at in zip(levels, sizes)) + (np.zeros(1, np.int64),)]
        self.top = np.r_[tuple(top for _, _, top in levels) + (np.zeros(1, np.int64),)]

    def child(self, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        mask = self.mask[node]
        there = (mask >> quadrant.astype(np.uint8)) & 1
        return np.where(there, self.first[node] + self._BELOW[mask, quadrant], self.empty)


def _morton(row: np.ndarray, column: np.ndarray, bits: int) -> np.ndarray:
    code = np.zeros(len(row), np.int64)
    for b in range(bits):
        code |= (((row >> b) & 1) << (2 * b + 1)) | (((column >> b) & 1) << (2 * b))
    return code


class Best:
    """The best (score, id) of one item so far."""

    def __init__(self, most: int):
        self.most, self.found = most, []  # a heap, the worst first; ids negated so that smaller ones are better

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        hope = self.open(scores, ids)
        for score, key in zip(scores[hope].tolist(), ids[hope].tolist()):
            if len(self.found) < self.most:
                heapq.heappush(self.found, (score, -key))
            elif (score, -key) > self.found[0]:
                heapq.heapreplace(self.found, (score, -key))

    def open(self, bound: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which ranges, by bound and smallest id, may still hold something better."""
        if len(self.found) < self.most:
            return bound > 0
        score, key = self.found[0]
        return (bound > score) | ((bound == score) & (ids < -key))


def search(tree: Quadtree, ids: np.ndarray, rows: np.ndarray, times: np.ndarray, best: Best, batch: int) -> None:
    """Joint descent of the paths of ``rows``; ``ids`` are the columns' document ids, rising."""
    height = tree.height
    level, start = np.zeros(1, np.int64), np.zeros(1, np.int64)
    node = np.zeros((1, len(rows)), np.int64)
    bound = tree.top[node] @ times
    batch = max(1, min(batch, (1 << 20) // max(len(rows), 1)))
    while len(bound):
        keep = best.open(bound, ids[start])
        if not keep.all():
            level, start, node, bound = level[keep], start[keep], node[keep], bound[keep]
            if not len(bound):
                break
        if len(bound) > batch:
            now = np.zeros(len(bound), bool)
            now[np.argpartition(-bound, batch)[:batch]] = True
        else:
            now = np.ones(len(bound), bool)
        bit = height - 1 - level[now]
        half = ((rows[None, :] >> bit[:, None]) & 1) * 2
        new = [(level[now] + 1, start[now] + (side << bit), tree.child(node[now], half + side)) for side in (0, 1)]
        level2, start2, node2 = (np.concatenate(x) for x in zip(*new))
        bound2 = tree.top[node2] @ times
        inside = (bound2 > 0) & (start2 < len(ids))
        done = inside & (level2 == height)
        best.add(bound2[done], ids[start2[done]])
        go = inside & ~done
        level, start = np.r_[level[~now], level2[go]], np.r_[start[~now], start2[go]]
        node, bound = np.concatenate([node[~now], node2[go]]), np.r_[bound[~now], bound2[go]]


def asked_terms(df: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """(id, n, rows, tf) of every document with terms: how many it has, and which asked ones how often."""
    hashes = items.hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches):
            _, _, first, h = words(data, offsets, ALNUM)
            n = np.diff(first)
            at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
            hit = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
            key, tf = np.unique(row_of(first)[hit] * max(len(hashes), 1) + at[hit], return_counts=True)
            document, term = np.divmod(key, max(len(hashes), 1))
            bounds = np.searchsorted(document, np.arange(len(n) + 1))
            keep = pa.array(n > 0)
            out = [rows.column(0), pa.array(n.astype(np.int64)), lists(term.astype(np.int32), bounds), lists(tf.astype(np.int32), bounds)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in out], ["id", "n", "rows", "tf"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, rows array<int>, tf array<int>")


def _grids(batches: Iterator[pa.RecordBatch], columns: int, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, n, cell counts, (rows, tf)) of documents in grids of bounded size."""
    held, count, size = [], 0, 0
    for batch in batches:
        bounds = batch.column(2).offsets.to_numpy()
        rows, tf = (batch.column(k).values.to_numpy() for k in (2, 3))
        ids = batch.column(0).fill_null(NO_ID).to_numpy()
        n, at = batch.column(1).to_numpy(), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + cells - size, side="right")) - 1)
            end = min(end, at + columns - count, batch.num_rows)
            lo, hi = bounds[at], bounds[end]
            held.append((ids[at:end], n[at:end], np.diff(bounds[at : end + 1]), rows[lo:hi], tf[lo:hi]))
            count, size, at = count + end - at, size + int(hi - lo), end
            if count >= columns or size >= cells:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, count, size = [], 0, 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def local_best(documents: DataFrame, items: Items, weights: np.ndarray, corpus: Corpus, s: Settings) -> DataFrame:
    """(item, id, score) of each task's best documents for each item."""
    rank = np.argsort(np.argsort(-weights, kind="stable"), kind="stable")  # row of each term, rows in order of weight
    asked = [(k, rank[rows], times) for k, (rows, times) in enumerate(zip(items.rows, items.times)) if len(rows)]
    most = max((len(rows) for _, rows, _ in asked), default=1)
    columns = max(1, min(s.columns, s.paths // most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {k: Best(s.best) for k, _, _ in asked}
        for ids, n, count, rows, tf in _grids(batches, columns, s.cells):
            order = np.argsort(ids, kind="stable")
            starts = (np.cumsum(count) - count)[order]
            count, ids = count[order], ids[order]
            rows, tf = ragged(rows, starts, count).astype(np.int64), ragged(tf, starts, count).astype(np.int64)
            column = np.repeat(np.arange(len(ids)), count)
            value = weights[rows] * corpus.share(tf, n[order][column])
            full = value > 0
            side = max(1, int(max(len(ids) - 1, len(weights) - 1)).bit_length())
            if not full.any():
                continue
            tree = Quadtree(rank[rows][full], column[full], value[full], side)
            for k, own, times in asked:
                search(tree, ids, own, times, best[k], s.batch)
        found = [(k, -key, score) for k, b in best.items() for score, key in b.found]
        if found:
            k, key, score = (np.array(x, np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(key), pa.array(score)], ["item", "id", "score"])

    return documents.mapInArrow(run, "item long, id long, score long")


def _search_block(documents: DataFrame, rows: list, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(item, rank, id, score) for the items of one block."""
    spark = documents.sparkSession
    items = read_items([r["text"] for r in rows])
    postings = staged(asked_terms(documents, items, id_col, text_col), "postings")
    total = postings.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    corpus = Corpus(total["documents"], total["terms"])
    # one row for each asked term reaches the driver
    held = {r["row"]: r["count"] for r in postings.select(F.explode("rows").alias("row")).groupBy("row").count().collect()}
    weights = np.array([corpus.weight(held.get(k, 0)) if corpus.documents else 0 for k in range(len(items.hashes))], np.int64)
    best = local_best(postings, items, weights, corpus, s)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.best)
    item = spark.createDataFrame([(k, r["id"]) for k, r in enumerate(rows)], "item long, item_id long")
    return ranked.join(F.broadcast(item), "item").select("item_id", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "score")


def ranked_search(documents: DataFrame, items: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's best documents."""
    asked = items.select(F.col(item_col).cast("long").alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("size")).first()["size"]
    blocks = max(1, -(-size // s.item_bytes))
    out = None
    for b in range(blocks):
        # a block of the stated query set, about item_bytes of text
        rows = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()
        part = _search_block(documents, rows, s, id_col, text_col)
        out = part if out is None else out.unionByName(part)
    return out
