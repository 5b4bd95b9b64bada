"""Quality rules from repetition coverage: the share of a text's characters inside repeated n-grams and lines.

Rolling hashes of several n-gram lengths over a block's words, in numpy. A window found twice or more
in its own text (the first place included) covers its words; the characters of covered words, counted
once, over all word characters are the coverage of that length. Lines likewise.

Null and empty texts have no words: all counts 0, coverages 0, and they fail the word minimum. Equal
rows give equal rows. Only the id and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assetlens.llm.blocks import SMALL_BLOCK, NOT_SPACE, row_of, span_hashes, spans, splitmix, text_blocks, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; a text beyond any of them is rejected.

    Any word in a repeated window of four words or more is also in a repeated 3-word window, so a limit
    on long windows or lines says something of its own only well below ``max_repeat_percent``: the longer
    the passage that comes again, the less of a text it may fill.
    """

    min_words: int = 50
    max_repeat_percent: int = 50  # words in repeated 3-word windows, of all words
    coverage: tuple[tuple[int, float], ...] = ((2, 0.65), (4, 0.40), (6, 0.30), (10, 0.25))  # n-gram length, most coverage
    max_line_coverage: float = 0.30
    max_symbols_per_word: float = 0.5


def _repeated(hashes: np.ndarray) -> np.ndarray:
    _, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
    return count[which] > 1


def repeated_words(h: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Whether each word lies in an n-word window that its own text holds twice or more."""
    row = row_of(first)
    start = np.flatnonzero(np.arange(len(h)) + n <= first[1:][row]) if len(h) else np.zeros(0, np.int64)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(start):
        again = start[_repeated(span_hashes(h, start, start + n) ^ splitmix(row[start] + 1))]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + n, -1)
    return np.cumsum(covered)[:-1] > 0


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[first[1:]] - total[first[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts and coverages of every text of a block."""
    starts, ends, first, h = words(data, offsets, lower=False)
    begins = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    size = begins[ends] - begins[starts]
    out = {"n_words": np.diff(first), "word_chars": _per_row(size, first), "n_symbols": _per_row(SYMBOLS[data], offsets)}
    # lines with a word; a line is equal to another by all its bytes
    line_start, line_end, line_first = spans(data != 0x0A, offsets)
    inside = np.r_[0, np.cumsum(NOT_SPACE[data])]
    filled = inside[line_end] > inside[line_start]
    line_first = np.r_[0, np.cumsum(filled)][line_first]
    line_start, line_end = line_start[filled], line_end[filled]
    line_row = row_of(line_first)
    key = span_hashes(data, line_start, line_end) ^ splitmix(line_row + 1)
    _, one, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(key), bool)
    later[one] = False
    out["n_dup_lines"] = _per_row(later, line_first)
    chars = np.r_[0, np.cumsum(NOT_SPACE[data] & ((data & 0xC0) != 0x80))]
    line_chars = (chars[line_end] - chars[line_start]) * (count[which] > 1)
    total = np.maximum(out["word_chars"], 1)
    out["n_repeat_words"] = _per_row(repeated_words(h, first, 3), first)
    echo = np.zeros(len(h), bool)
    echo[1:] = h[1:] == h[:-1]
    echo[first[:-1][np.diff(first) > 0]] = False
    out["n_echo"] = _per_row(echo, first)  # words equal to the word before
    out["line_coverage"] = _per_row(line_chars, line_first) / total
    for n in lengths:
        out[f"coverage_{n}"] = _per_row(size * repeated_words(h, first, n), first) / total
    return out


def verdicts(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text fails the base rules, and whether it is kept."""
    failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])
    bad = failed | (m["line_coverage"] > rules.max_line_coverage) | (m["n_symbols"] > rules.max_symbols_per_word * m["n_words"])
    for n, most in rules.coverage:
        bad |= m[f"coverage_{n}"] > most
    return failed, ~bad


def kept_rows(df: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, that the rules keep."""
    lengths, at = tuple(n for n, _ in rules.coverage), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, at, SMALL_BLOCK):
            yield rows.filter(pa.array(verdicts(measure(data, offsets, lengths), rules)[1]))

    return df.mapInArrow(run, df.schema)


def quality_rules(df: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its counts, coverages, whether the base rules fail, and whether it is kept."""
    lengths = tuple(n for n, _ in rules.coverage)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["line_coverage", *(f"coverage_{n}" for n in lengths)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, limit=SMALL_BLOCK):
            m = measure(data, offsets, lengths)
            failed, kept = verdicts(m, rules)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(m[c].astype(np.int64)) for c in counts), pa.array(failed), pa.array(kept), *(pa.array(m[c].astype(np.float64)) for c in shares)],
                [id_col, *counts, "base_failed", "kept", *shares],
            )

    fields = [T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in counts)]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), *(T.StructField(c, T.DoubleType()) for c in shares)]
    return df.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
