"""An n-gram language model (two or three words) with interpolated modified Kneser-Ney smoothing.

Counting is Spark work: tasks combine what their blocks hold and hand on one packed piece of sorted keys
and counts for each hash range; one shuffle brings the pieces of a range together, and each range is
written as sorted arrays of hashes and counts to the shared folder. A pair's hash is a one-to-one mix of
its words' numbers (a word's number is its place in the sorted vocabulary) in no more bits than these have,
so pairs never collide: its range and its group in the range stand for its first bits, and 32 bits are
stored. Numbers of third words take the bytes that the vocabulary needs. Three
words lie in the range of their first two: there the first two are found by their hash, and the third by
the place of the first two and its own number. From its different triples each range also gives how many
different words precede each pair, which are the pair's counts in the middle order; from its different
pairs each range gives what it saw of every first word (total, pairs counted once, twice, more often) and
of every second word (how many different words precede it), the counts of the lowest order. Scoring
workers map the arrays into memory and look up each block's distinct words, pairs and triples in sorted
order. Nothing is pruned: the model grows with the text it learned from, and the number of ranges with
its tokens, so that no task holds more than about ``range_tokens`` of them.

The shared folder has to be mounted on every node, as arrays are mapped from it.

Null and empty texts are the end token alone; very long texts are taken whole. An unknown word has the
share of one unseen word. Equal rows get equal scores. With no training text every token has the same
probability; an empty table gives no rows. Only the id and the text column are read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlens.llm.blocks import text_blocks, words
from assetlens.llm.staging import new_folder

END = np.uint64(0x5DEECE66D1234567)  # the end token's hash
_WORD = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a block (each text's words, then the end), and each text's first one."""
    _, _, first, h = words(data, offsets)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of the values of equal keys, by rising key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *(np.add.reduceat(v[order], at) if len(keys) else v for v in values)


def _merged(parts: list[tuple[np.ndarray, ...]], counts: int = 1) -> list[np.ndarray]:
    """Parts (key columns, count columns) as one, sorted by key, counts of equal keys summed."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    keys, counted = columns[:-counts], columns[-counts:]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    return [*(k[first] for k in keys), *(np.add.reduceat(n[order], first) for n in counted)]


def _planes(values: np.ndarray) -> bytes:
    """All lowest bytes, then all next ones, and so on: high bytes are mostly zero and compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()


def _pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys as differences and how often each repeats, then further columns."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    often = np.diff(np.r_[first, len(keys)]).astype(np.uint32)
    distinct = np.diff(keys[first], prepend=np.uint64(0))
    return zstandard.compress(b"".join([np.array([len(first)], np.int64).tobytes(), *map(_planes, (distinct, often, *columns))]), 1)


def _unpack(piece: bytes, types: tuple) -> list[np.ndarray]:
    piece = zstandard.decompress(piece)
    at = 8

    def column(t, rows):
        nonlocal at
        size = np.dtype(t).itemsize
        flat = np.frombuffer(piece, np.uint8, rows * size, at).reshape(size, rows)
        at += rows * size
        return np.ascontiguousarray(flat.T).view(t).ravel()

    rows = int(np.frombuffer(piece, np.int64, 1)[0])
    distinct, often = column(np.uint64, rows), column(np.uint32, rows)
    keys = np.repeat(np.cumsum(distinct, dtype=np.uint64), often)
    return [keys, *(column(t, len(keys)) for t in types)]


COUNTS = (np.int64,)  # of words, or of pairs
TRIPLES = (np.uint32, np.int64)  # number of the third word, count
SUMS = (np.int64,) * 5  # of a word: total, once, twice, more, before
_PIECES = "shard int, piece binary"


class Combiner:
    """Counts of keys over several blocks, handed on as one packed piece for each hash range when there are many.

    Keys are words' hashes, or pairs of word numbers of ``half`` bits, which are mixed only to find their range.
    """

    def __init__(self, bits: int, half: int | None = None, most: int = 1_000_000):
        self.bits, self.half, self.most, self.held, self.size = bits, half, most, [], 0

    def add(self, *part: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(part)
        self.size += len(part[0])
        if self.size > self.most:
            self.held = [_merged(self.held)]
            self.size = len(self.held[0][0])
            if self.size > self.most // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            part = _merged(self.held)
            self.held, self.size = [], 0
            shard = _shard(part[0] if self.half is None else _mixed(part[0], self.half), self.bits)
            order = np.argsort(shard, kind="stable")
            part = [c[order] for c in part]
            edges = np.searchsorted(shard[order], np.arange((1 << self.bits) + 1))
            full = np.flatnonzero(np.diff(edges))
            for some in np.array_split(full, -(-len(full) // 64)):
                pieces = [_pack(*(c[edges[s] : edges[s + 1]] for c in part)) for s in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(pieces, pa.binary())], ["shard", "piece"])


def _shard(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _half(vocabulary: int) -> int:
    """Bits of a word's number, the number of the word before a text included."""
    return max(1, int(vocabulary).bit_length())


def _mixed(pairs: np.ndarray, half: int) -> np.ndarray:
    """One-to-one mix of pairs of numbers of ``half`` bits, in the highest 2 * half bits: no more bits than the numbers have."""
    by, mask = np.uint64(half), np.uint64((1 << 2 * half) - 1)
    x = ((pairs >> _WORD) << by) | (pairs & _LOW)
    for odd in _ODD:
        x = ((x ^ (x >> by)) * odd) & mask
    return (x ^ (x >> by)) << np.uint64(64 - 2 * half)


def _groups(wide: int, half: int) -> int:
    """Bits after the range's that choose a group of keys, so that 32 bits are left to tell a group's keys apart."""
    rest = max(2 * half - wide, 0)
    return max(rest - 32, min(rest, 8))


def _split(keys: np.ndarray, wide: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Group in its range, and what is left, of mixed pairs."""
    k, inner = _groups(wide, half), keys << np.uint64(wide)
    return (inner >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(keys), np.int64), ((inner << np.uint64(k)) >> _WORD).astype(np.uint32)


def _save_keys(root: str, kind: str, shard: int, keys: np.ndarray, wide: int, half: int) -> None:
    """Sorted mixed pairs of a range: where each group begins, and 32 bits of each key."""
    if len(keys):
        group, low = _split(keys, wide, half)
        _save(f"{root}/{kind}-from-{shard}.npy", np.searchsorted(group, np.arange((1 << _groups(wide, half)) + 1)).astype(np.uint32))
        _save(f"{root}/{kind}-{shard}.npy", low)


def _narrow(numbers: np.ndarray, half: int) -> np.ndarray:
    """Word numbers in as many bytes as the largest one needs."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : -(-half // 8)])


def _at(stored: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The numbers at the places, of an array or of narrow numbers."""
    found = stored[place]
    return found if found.ndim == 1 else sum(found[:, i].astype(np.uint32) << np.uint32(8 * i) for i in range(found.shape[1]))


def _search(begin: np.ndarray, stored: np.ndarray, group: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Place of each wanted number in its group's sorted run (-1: absent)."""
    lo, end = begin[group].astype(np.int64), begin[group + 1].astype(np.int64)
    hi = end.copy()
    while (open := lo < hi).any():  # all searches halve their ranges together
        mid = (lo + hi) // 2
        less = _at(stored, np.minimum(mid, len(stored) - 1)) < want
        lo, hi = np.where(open & less, mid + 1, lo), np.where(open & ~less, mid, hi)
    hit = (lo < end) & (_at(stored, np.minimum(lo, len(stored) - 1)) == want)
    return np.where(hit, lo, -1)


def _save(path: str, values: np.ndarray) -> None:
    """Whole or not at all, under a name of its own until then, so a task that runs again or twice does no harm.

    Empty arrays cannot be mapped and have no file.
    """
    if not len(values):
        return
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        np.save(f, values)
    os.replace(part, path)


def _save_counts(path: str, n: np.ndarray) -> None:
    """Counts in a byte each; 255 stands for those that are listed apart."""
    n = n.ravel()
    big = np.flatnonzero(n >= 255)
    _save(f"{path}.npy", np.minimum(n, 255).astype(np.uint8))
    if len(big):
        _save(f"{path}-at.npy", big)
        _save(f"{path}-big.npy", n[big])


def _ranges(batches: Iterator[pa.RecordBatch], types: tuple, counts: int = 1) -> Iterator[tuple]:
    """(range, key columns, counts) of pieces sorted by range; pieces of ranges below 0 are handed through as four numbers."""
    at, parts = None, []
    for batch in batches:
        for shard, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
            if shard < 0:
                yield shard, np.frombuffer(piece.as_py(), np.int64)
                continue
            if shard != at and parts:
                yield at, *_merged(parts, counts)
                parts = []
            at = shard
            parts.append(_unpack(piece.as_py(), types))
    if parts:
        yield at, *_merged(parts, counts)


@dataclass(frozen=True)
class Model:
    folder: str
    order: int  # words of the longest n-grams
    bits: int  # 2 ** bits hash ranges of words
    wide: int  # and of pairs and triples
    begins: tuple[int, ...]  # number of the first word of each range, and the vocabulary's size
    total: int  # tokens learned from
    discounts: tuple[tuple[float, float, float], ...]  # of pairs, and of triples
    per: int  # words in a file of sums
    lowest: tuple[float, float, float]  # discounts of words
    pairs: int  # different pairs
    unseen: float  # lower-order probability of an unknown word

    @property
    def vocabulary(self) -> int:
        return self.begins[-1]

    @property
    def half(self) -> int:
        return _half(self.vocabulary)


def _spans(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(range, first, end) of each run of a sorted array of ranges."""
    present, edges = np.unique(shard, return_index=True)
    return zip(present.tolist(), edges.tolist(), [*edges[1:].tolist(), len(shard)])


class Arrays:
    """The arrays of a model, each mapped when it is first needed."""

    def __init__(self, folder: str):
        self.folder = folder
        self.maps: dict[str, np.ndarray | None] = {}

    def get(self, name: str) -> np.ndarray | None:
        if name not in self.maps:
            path = f"{self.folder}/{name}.npy"
            self.maps[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.maps[name]

    def find(self, kind: str, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Place in their range of keys that are sorted by range and key (-1: absent)."""
        place = np.full(len(keys), -1)
        for s, lo, hi in _spans(shard):
            stored = self.get(f"{kind}-{s}")
            if stored is not None:
                at = np.minimum(np.searchsorted(stored, keys[lo:hi]), len(stored) - 1)
                place[lo:hi] = np.where(stored[at] == keys[lo:hi], at, -1)
        return place

    def values(self, kind: str, place: np.ndarray, shard: np.ndarray, width: int = 1) -> np.ndarray:
        """What is stored at the places found, ``width`` numbers each; zeros for what is absent."""
        out = np.zeros((len(place), width), np.int64)
        for s, lo, hi in _spans(shard):
            there = np.flatnonzero(place[lo:hi] >= 0) + lo
            if not len(there):
                continue
            at = place[there, None] * width + np.arange(width)
            stored = self.get(f"{kind}-{s}")
            if stored is None:
                continue
            found = stored[at].astype(np.int64)
            if (found == 255).any():
                big = found == 255
                found[big] = self.get(f"{kind}-{s}-big")[np.searchsorted(self.get(f"{kind}-{s}-at"), at[big])]
            out[there] = found
        return out[:, 0] if width == 1 else out

    def find_pairs(self, kind: str, keys: np.ndarray, shard: np.ndarray, wide: int, half: int) -> np.ndarray:
        """Place in their range of sorted mixed pairs (-1: absent)."""
        place = np.full(len(keys), -1)
        group, low = _split(keys, wide, half)
        for s, lo, hi in _spans(shard):
            stored = self.get(f"{kind}-{s}")
            if stored is not None:
                place[lo:hi] = _search(self.get(f"{kind}-from-{s}"), stored, group[lo:hi], low[lo:hi])
        return place

    def numbers(self, kind: str, place: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The narrow numbers at the places found; zeros for what is absent."""
        out = np.zeros(len(place), np.int64)
        for s, lo, hi in _spans(shard):
            there = np.flatnonzero(place[lo:hi] >= 0) + lo
            if len(there):
                out[there] = _at(self.get(f"{kind}-{s}"), place[there])
        return out

    def third(self, place: np.ndarray, w: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Place of the triple of the context at ``place`` with the word numbered ``w`` (-1: absent)."""
        out = np.full(len(place), -1)
        for s, first, last in _spans(shard):
            out[first:last] = _search(self.get(f"begin-{s}"), self.get(f"triple-{s}"), place[first:last], w[first:last])
        return out


@lru_cache(maxsize=1)
def _open(folder: str) -> Arrays:
    return Arrays(folder)


def _number(arrays: Arrays, begins: np.ndarray, bits: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers (-1: unknown) and counts of the distinct hashes of ``h``, and where each of ``h`` is among them."""
    distinct, which = np.unique(h, return_inverse=True)
    shard = _shard(distinct, bits)
    place = arrays.find("word", distinct, shard)
    return np.where(place >= 0, begins[shard] + place, -1), arrays.values("word-n", place, shard), which


def _joined(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (u.astype(np.uint64) << _WORD) | w.astype(np.uint64)


def _before(ids: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The word before each token; ``start`` before the first of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first[:-1]] = start
    return before


def _mounted(path: str) -> str:
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise RuntimeError("the model's arrays are mapped into memory: spark.checkpoint.dir has to be a mounted folder")
    return parts.path


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """What is taken from counts of one, two, and three or more, from how many have a count of one to four.

    The closed forms, kept a thousandth away from nothing and from the whole count, so that both orders have a share.
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * b / a if a else 0.5 * k for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
    return tuple(min(max(d, 0.001), k - 0.001) for k, d in enumerate(raw, 1))


def _taken(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


def train(df: DataFrame, text_col: str = "text", order: int = 3, range_tokens: int = 4_000_000) -> Model:
    """Learn n-grams of up to ``order`` (2 or 3) words from every text of ``df``."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = df.sparkSession
    root = _mounted(new_folder(spark, "kneser-ney"))
    os.makedirs(root, exist_ok=True)
    bits = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    texts = df.select(F.lit(0).alias("none"), text_col)

    def by_range(pieces: DataFrame, bits: int) -> DataFrame:
        return pieces.repartition(1 << bits, "shard").sortWithinPartitions("shard")

    def count_words(batches):
        held = Combiner(bits)
        for _, data, offsets in text_blocks(batches):
            yield from held.add(*np.unique(tokens(data, offsets)[0], return_counts=True))
        yield from held.rest()

    def write_words(batches):
        for shard, key, n in _ranges(batches, COUNTS):
            _save(f"{root}/word-{shard}.npy", key)
            _save_counts(f"{root}/word-n-{shard}", n)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(key)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["shard", "words", "tokens"])

    written = by_range(texts.mapInArrow(count_words, _PIECES), bits).mapInArrow(write_words, "shard int, words long, tokens long").collect()  # a row for each range
    sizes = np.zeros(1 << bits, np.int64)
    for r in written:
        sizes[r["shard"]] = r["words"]
    begins = np.r_[0, np.cumsum(sizes)]
    start = int(begins[-1])  # the number of the word before a text
    half = _half(start)
    tokens_seen = sum(r["tokens"] for r in written)
    wide = max(bits, (tokens_seen // range_tokens).bit_length())

    def count_grams(batches):
        arrays, held = _open(root), Combiner(wide, half)
        for _, data, offsets in text_blocks(batches):
            h, first = tokens(data, offsets)
            distinct, _, which = _number(arrays, begins, bits, h)
            w = distinct[which]
            v = _before(w, first, start)
            if order == 2:
                yield from held.add(*np.unique(_joined(v, w), return_counts=True))
                continue
            pair, place = np.unique(_joined(_before(v, first, start), v), return_inverse=True)
            both, n = np.unique(_joined(place, w), return_counts=True)
            yield from held.add(pair[(both >> _WORD).astype(np.int64)], both.astype(np.uint32), n)
        yield from held.rest()

    def write_triples(batches):
        """Writes the triples and hands on the pairs they end with, each as often as different words precede it."""
        held = Combiner(wide, half)
        for shard, *found in _ranges(batches, TRIPLES):
            pair, w, n = found
            yield from held.add(*np.unique(_joined(pair & _LOW, w), return_counts=True))
            pair = _mixed(pair, half)
            order = np.argsort(pair, kind="stable")  # third words stay sorted
            pair, w, n = pair[order], w[order], n[order]
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            size = np.diff(np.r_[first, len(pair)])
            alone = size == 1  # most contexts have one third word: nothing more to store
            for kind, keys in (("one", pair[first[alone]]), ("context", pair[first[~alone]])):
                _save_keys(root, kind, shard, keys, wide, half)
            for kind, values in (("one-w", _narrow(w[first[alone]], half)), ("begin", np.r_[0, np.cumsum(size[~alone])].astype(np.uint32)), ("triple", _narrow(w[np.repeat(~alone, size)], half))):
                _save(f"{root}/{kind}-{shard}.npy", values)
            about = np.stack([np.add.reduceat(x, first, dtype=np.int64) for x in (n, n == 1, n == 2, n > 2)], 1)
            for kind, counts in (("one-n", n[first[alone]]), ("context-n", about[~alone]), ("triple-n", n[np.repeat(~alone, size)])):
                _save_counts(f"{root}/{kind}-{shard}", counts)
            yield counted(-1, n)
        yield from held.rest()

    parts = 1 << bits
    per = -(-(start + 1) // parts)

    def counted(order, n):
        return pa.RecordBatch.from_arrays([pa.array([order], pa.int32()), pa.array([np.array([int((n == k).sum()) for k in (1, 2, 3, 4)], np.int64).tobytes()], pa.binary())], ["shard", "piece"])

    def write_pairs(batches):
        """Writes the pairs and hands on what they add to the sums of their words."""
        for shard, *found in _ranges(batches, COUNTS):
            if shard < 0:
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([found[0].tobytes()], pa.binary())], ["shard", "piece"])
                continue
            both, n = found
            key = _mixed(both, half)
            order = np.argsort(key)
            _save_keys(root, "pair", shard, key[order], wide, half)
            _save_counts(f"{root}/pair-n-{shard}", n[order])
            none, each = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
            rows = _sums(np.r_[both >> _WORD, both & _LOW], *(np.r_[x.astype(np.int64), none] for x in (n, n == 1, n == 2, n > 2)), np.r_[none, each])
            edges = np.searchsorted(rows[0], np.arange(parts + 1, dtype=np.uint64) * np.uint64(per))
            full = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_pack(*(c[edges[k] : edges[k + 1]] for c in rows)) for k in full], pa.binary())], ["shard", "piece"])
            yield counted(-2, n)

    def write_sums(batches):
        """Writes the sums of words; a row for each file, and one for the pairs and one for the triples, says how many have a count of one to four."""
        held = {}
        for part, *found in _ranges(batches, SUMS, len(SUMS)):
            if part < 0:
                held[part] = held.get(part, 0) + found[0]
                continue
            ids, *counts = found
            rows = np.zeros((per, len(SUMS)), np.int64)
            rows[ids.astype(np.int64) - part * per] = np.stack(counts, 1)
            _save_counts(f"{root}/sums-{part}", rows)
            before = counts[-1]
            yield out(part, *(int((before == k).sum()) for k in (1, 2, 3, 4)), int((before > 2).sum()), int(before.sum()))
        for order, seen in held.items():
            yield out(order, *seen.tolist(), 0, 0)

    columns = ["part", "n1", "n2", "n3", "n4", "more", "every"]

    def out(*row):
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], columns)

    pieces = texts.mapInArrow(count_grams, _PIECES)
    if order == 3:
        pieces = by_range(pieces, wide).mapInArrow(write_triples, _PIECES)
    pieces = by_range(pieces, wide).mapInArrow(write_pairs, _PIECES)
    seen = by_range(pieces, bits).mapInArrow(write_sums, ", ".join(f"{c} long" for c in columns)).collect()  # a row for each file
    by_order = {k: [sum(r[c] for r in seen if (r["part"] if r["part"] < 0 else 0) == k) for c in columns[1:]] for k in (0, -1, -2)}
    *low, more, every = by_order[0]
    e = discounts(*low)
    unseen = (e[0] * low[0] + e[1] * low[1] + e[2] * more) / every / (start + 1) if every else 1 / (start + 1)
    steps = tuple(discounts(*by_order[k][:4]) for k in (-2, -1)[: order - 1])
    return Model(root, order, bits, wide, tuple(begins.tolist()), tokens_seen, steps, per, e, max(every, 1), unseen)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row: counts and log10 probabilities of its whole text."""
    begins, start = np.array(model.begins), model.vocabulary
    floor = model.total + start + 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _open(model.folder)
        for rows, data, offsets in text_blocks(batches):
            h, first = tokens(data, offsets)
            number, count, which = _number(arrays, begins, model.bits, h)
            known = number >= 0
            # of each different word, and of the word before a text: its total, its weight of the lower order, its own lowest order
            word = np.where(known, number, 0)
            word = np.r_[np.maximum.accumulate(word), start]
            sums = arrays.values("sums", word % model.per, word // model.per, 5)
            sums[:-1][~known] = 0
            back = sums[:, 1:4] @ np.array(model.discounts[0]) / np.maximum(sums[:, 0], 1)
            lowest = np.maximum(sums[:, 4] - _taken(sums[:, 4], model.lowest), 0) / model.pairs + model.unseen
            ids = number[which]
            before = _before(ids, first, start)
            both = (ids >= 0) & (before >= 0)
            key, at = np.unique(_mixed(_joined(before[both], ids[both]), model.half), return_inverse=True)
            seen = np.zeros(len(ids), np.int64)
            shard = _shard(key, model.wide)
            seen[both] = arrays.values("pair-n", arrays.find_pairs("pair", key, shard, model.wide, model.half), shard)[at]
            context = _before(which, first, len(number))
            total = sums[context, 0]
            p = np.maximum(seen - _taken(seen, model.discounts[0]), 0) / np.maximum(total, 1) + np.where(total > 0, back[context], 1.0) * lowest[which]
            if model.order == 3:
                d = model.discounts[1]
                earlier = _before(before, first, start)
                both = np.flatnonzero((earlier >= 0) & (before >= 0))
                key, at = np.unique(_mixed(_joined(earlier[both], before[both]), model.half), return_inverse=True)
                shard = _shard(key, model.wide)
                one, many = (arrays.find_pairs(kind, key, shard, model.wide, model.half) for kind in ("one", "context"))
                about, only, third = arrays.values("context-n", many, shard, 4), arrays.values("one-n", one, shard), arrays.numbers("one-w", one, shard)
                about[one >= 0] = np.stack([only, only == 1, only == 2, only > 2], 1)[one >= 0]
                met = about[at, 0] > 0
                both, at = both[met], at[met]
                total, back = about[at, 0], about[at, 1:] @ np.array(d) / about[at, 0]
                seen = np.where((one[at] >= 0) & (third[at] == ids[both]), only[at], 0)
                some = (many[at] >= 0) & (ids[both] >= 0)
                triple, where = np.unique(_joined(at[some], ids[both][some]), return_inverse=True)  # by rising range
                of = (triple >> _WORD).astype(np.int64)
                seen[some] = arrays.values("triple-n", arrays.third(many[of], (triple & _LOW).astype(np.int64), shard[of]), shard[of])[where]
                p[both] = np.maximum(seen - _taken(seen, d), 0) / total + back * p[both]
            base = np.log10((count + 1) / floor)[which]
            n = np.diff(first)
            add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has a token
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(add((count > 0)[which].astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(p)))], [id_col, "n_tokens", "n_known", "base_score", "score"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return df.select(id_col, text_col).mapInArrow(run, schema)
