"""Toxicity by compression distance: which of two zstandard dictionaries makes a window of text shorter.

One dictionary is trained on ordinary text. The other is trained on toxic texts cut down to the words
that far more toxic texts hold than the ordinary ones' share predicts; the ordinary content follows
it, so what both classes share costs a window the same with either. Copies of a text count once there. A text's words are cut into short
overlapping windows, each compressed with both dictionaries; a window's distance is the bytes the
toxic dictionary saves. A window counts as toxic beyond a distance that few ordinary training windows reach. A text's
score is a logistic function of its largest distance, its mean distance and its toxic windows, fitted
on the training texts.

Null and empty texts have no windows and get the score of distance zero. Equal texts get equal scores.
Only the id and the text column are read. With one class of labels only, every score is that class's.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assetlens.llm.blocks import ALNUM, LOWER, flat_text, row_of, spans, text_blocks
from assetlens.llm.samples import class_share, labelled_texts

WINDOW, STEP = 8, 5  # words
LEVEL = 6


@dataclass(frozen=True)
class Distances:
    toxic: bytes
    ordinary: bytes
    limit: float  # the distance beyond which a window counts as toxic
    weights: tuple[float, ...]


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of a block parted by one space each: the bytes, starts, ends, each row's first word."""
    starts, ends, first = spans(ALNUM[data], offsets)
    inside = ALNUM[data]
    keep = inside.copy()
    keep[np.minimum(ends, len(data) - 1)[ends < len(data)]] = True  # the sign after a word becomes its space
    keep[starts[1:][starts[1:] == ends[:-1]]] = True
    text = np.where(inside, LOWER[data], 0x20)[keep] if len(data) else data
    place = np.r_[0, np.cumsum(keep)]
    return text.tobytes(), place[starts], place[ends], first


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word number of every window, and each row's first window: steps of STEP words, the last one cut short."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STEP)), 0)
    at = np.r_[0, np.cumsum(count)]
    row = row_of(at)
    begin = first[:-1][row] + (np.arange(at[-1]) - at[:-1][row]) * STEP
    return begin, np.minimum(begin + WINDOW, first[1:][row]) - 1, at


@lru_cache(maxsize=2)
def _compressors(toxic: bytes, ordinary: bytes):
    import zstandard

    out = []
    for content in (toxic, ordinary):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False).compress)
    return out


def window_distances(data: np.ndarray, offsets: np.ndarray, toxic: bytes, ordinary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all windows of a block, and each row's first window."""
    text, starts, ends, first = plain(data, offsets)
    begin, last, at = windows(first)
    by_toxic, by_ordinary = _compressors(toxic, ordinary)
    pieces = [b" " + text[a:b] + b" " for a, b in zip(starts[begin].tolist(), ends[last].tolist())]
    return np.array([len(by_ordinary(p)) - len(by_toxic(p)) for p in pieces], np.float64), at


def summary(distance: np.ndarray, at: np.ndarray, limit: float) -> np.ndarray:
    """What a score sees of each text."""
    n = np.diff(at)
    total = np.r_[0, np.cumsum(distance)]
    hits = np.r_[0, np.cumsum(distance > limit)]
    most = np.zeros(len(n))
    some = n > 0
    if some.any():
        most[some] = np.maximum.reduceat(distance, at[:-1][some])
    h = (hits[at[1:]] - hits[at[:-1]]).astype(float)
    size = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), most, (total[at[1:]] - total[at[:-1]]) / size, np.log1p(h), h / size, h / np.sqrt(size)], 1)


def score(x: np.ndarray, weights) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(weights), -30, 30)))


def _apart(texts: list[list[bytes]]) -> list[list[bytes]]:
    """One of each group of copies: texts that share their three words of smallest checksum are taken as such."""
    seen, out = set(), []
    for words in texts:
        key = tuple(heapq.nsmallest(3, {zlib.crc32(w) for w in words}))
        if key not in seen:
            seen.add(key)
            out.append(words)
    return out


def _contrast(texts: list[list[bytes]], other: list[list[bytes]], surprise: float) -> list[bytes]:
    """The texts with only the words that far more of them hold than the others' share predicts (in standard deviations)."""
    mine, theirs = Counter(), Counter()
    for counts, docs in ((mine, texts), (theirs, other)):
        for d in docs:
            counts.update(set(d))
    rate = len(texts) / max(len(other), 1)
    expected = {w: (theirs[w] + 0.5) * rate for w in mine}
    chosen = {w for w, c in mine.items() if c - expected[w] > surprise * (expected[w] + 1) ** 0.5}
    return [b for b in (b" " + b" ".join(w for w in d if w in chosen) + b" " for d in texts) if len(b) > 2]


def _train(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a trained dictionary, or the samples' own end where there are too few to train on."""
    import zstandard

    try:
        whole = zstandard.train_dictionary(size + 256, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    return whole[-size:] if len(whole) > size else whole


def _by_parts(texts: list[str], size: int = 200) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(texts), size):
        yield flat_text(pa.array(texts[at : at + size], pa.string()))


def _words(texts: list[str], of: np.ndarray) -> list[list[bytes]]:
    """Words of the chosen texts, equal words held once, copies left out."""
    held: dict[bytes, bytes] = {}
    out = []
    for data, offsets in _by_parts([t for t, chosen in zip(texts, of) if chosen]):
        text, starts, ends, first = plain(data, offsets)
        out += [[held.setdefault(w, w) for w in (text[a:b] for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist()))] for i, j in zip(first[:-1], first[1:])]
    return _apart(out)


def learn(texts: list[str], y: np.ndarray, share: float | None = None, size: int = 16_384, toxic_size: int = 768, quantile: float = 0.999, surprise: float = 5.0, segment: int = 32, sample_windows: int = 20_000) -> Distances:
    """Fit on a sample of texts; ``share`` is the share of label 1 among all training rows."""
    y = np.asarray(y)
    if not y.any() or y.all():
        return Distances(b" ", b" ", 0.0, (4.0 if y.any() else -4.0, 0, 0, 0, 0, 0))
    bad, good = _words(texts, y == 1), _words(texts, y == 0)
    ordinary = _train([b" " + b" ".join(w[i : i + 40]) + b" " for w in good for i in range(0, len(w), 40)][:sample_windows], size, 64)
    toxic = _train(_contrast(bad, good, surprise), toxic_size, segment) + ordinary  # the ordinary part stays as near to a window
    del bad, good
    parts = [window_distances(data, offsets, toxic, ordinary) for data, offsets in _by_parts(texts)]
    distance = np.concatenate([d for d, _ in parts])
    at = np.r_[0, np.cumsum(np.concatenate([np.diff(a) for _, a in parts]))]
    limit = float(np.quantile(distance[(y == 0)[row_of(at)]], quantile)) if (y == 0)[row_of(at)].any() else 0.0
    x = summary(distance, at, limit)
    scale = np.maximum(x.std(0), 1e-6)
    scale[0] = 1
    z, w = x / scale, np.zeros(x.shape[1])
    # each class weighs what it weighs among all training rows
    share = float(np.mean(y)) if share is None else min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, share / np.mean(y), (1 - share) / np.mean(1 - y))
    for _ in range(30):  # Newton steps with a small ridge
        p = score(z, w)
        hessian = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.eye(len(w)) * 0.5
        w = w + np.linalg.solve(hessian, z.T @ (weight * (y - p)) - 0.5 * w)
    return Distances(toxic, ordinary, limit, tuple(w / scale))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, per_class: int = 2_000) -> Distances:
    """Learn from at most ``per_class`` labelled texts of each class outside fold 0."""
    got = sorted((r["id"], r["y"], r["text"]) for r in labelled_texts(documents, labels, label, per_class, folds).collect())
    share = class_share(documents, labels, label, folds)
    return learn([t for _, _, t in got], np.array([y for _, y, _ in got], int), share)


def rate(df: DataFrame, model: Distances, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, windows, toxic_windows, largest_distance) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches):
            distance, at = window_distances(data, offsets, model.toxic, model.ordinary)
            x = summary(distance, at, model.limit)
            hits = np.r_[0, np.cumsum(distance > model.limit)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score(x, model.weights)), pa.array(np.diff(at).astype(np.int64)), pa.array((hits[at[1:]] - hits[at[:-1]]).astype(np.int64)), pa.array(x[:, 1])], [id_col, "score", "windows", "toxic_windows", "largest_distance"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("windows", T.LongType()), T.StructField("toxic_windows", T.LongType()), T.StructField("largest_distance", T.DoubleType())])
    return df.select(id_col, text_col).mapInArrow(run, schema)
