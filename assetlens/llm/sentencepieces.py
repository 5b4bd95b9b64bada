"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A block of texts becomes one flat array of code points, cut into words (a run of word marks and what
follows it; no merge crosses that border). The distinct words of a block are encoded together: one
flat symbol array, the smallest pair rank of every word by a segmented minimum, all leftmost
occurrences of that pair merged at once, the array compacted, until no pair is left. Text order and
row borders come back by gathering each word's ids.

Empty and null texts have the begin and end ids only. Any id column is handed through; other columns
are not read, so names cannot clash. Equal rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assetlens.llm.blocks import lists, ragged, span_hashes, text_blocks

MARK = 0x2581  # the visible space
NEVER = np.int64(1 << 40)
_PAIR = np.int64(1 << 22)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


class PieceModel:
    """The vocabulary of a model file as arrays: characters, mergeable pairs, surfaces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        n = self.size = len(sp)
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        self.bytes_at = np.full(256, self.unk, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.bytes_at[int(pieces[i][3:5], 16)] = i
        self.char = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        # equal scores share a rank: the leftmost then goes first
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.searchsorted(np.unique(-scores), -scores)
        pairs: dict[int, tuple[int, int]] = {}
        better = np.full(n, NEVER)  # the best rank of a longer piece that begins or ends with this one
        joined = set()
        for p, i in ids.items():
            joined.update(zip(p, p[1:]))
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None:
                    better[a] = min(better[a], rank[i])
                if b is not None:
                    better[b] = min(better[b], rank[i])
                if a is not None and b is not None:
                    pairs[a * int(_PAIR) + b] = (int(rank[i]), i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        # merging one occurrence may open a better pair beside it: such pairs are merged one at a time
        self.alone = (better <= rank)[self.merged]
        self.joined = np.array(sorted(ord(a) * 0x110000 + ord(b) for a, b in joined), np.int64)
        table = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.surface = np.frombuffer(b"".join(table), np.uint8)
        self.surface_len = np.array([len(x) for x in table], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.is_control = np.array([sp.is_control(i) for i in range(n)])
        self.known: dict[int, int] = {}
        self.known_ids: list[np.ndarray] = []
        self.known_len: list[np.ndarray] = []

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the pair among the mergeable ones, or -1."""
        key = left * _PAIR + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), at, -1)

    def merge(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every word of a flat symbol array (first: where each word begins, and the end) to its last symbols."""
        words = len(first) - 1
        word = np.repeat(np.arange(words), np.diff(first))
        done_sym, done_word = [], []

        def numbers(at):
            """Pair numbers at positions whose right neighbour is of the same word."""
            return np.where(word[at] == word[at + 1], self.look(sym[at], sym[at + 1]), -1)

        pair = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            pair[:-1] = numbers(np.arange(len(sym) - 1))
        while len(sym):
            rank = np.where(pair >= 0, self.ranks[pair], NEVER)
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.r_[start, len(sym)])
            live = least < NEVER
            if not live.all():
                keep = np.repeat(live, size)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, pair, rank, least, size = sym[keep], word[keep], pair[keep], rank[keep], least[live], size[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # neighbouring hits overlap: of each run every second one, from the left
            run = np.r_[True, np.diff(hit) != 1]
            place = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            new_word = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            hit = hit[(place % 2 == 0) & (new_word | ~self.alone[pair[hit]])]
            sym[hit] = self.merged[pair[hit]]
            gone = np.zeros(len(sym), bool)
            gone[hit + 1] = True
            keep = ~gone
            at = np.cumsum(keep) - 1
            sym, word, pair = sym[keep], word[keep], pair[keep]
            changed = at[hit]
            changed = np.r_[changed, changed[changed > 0] - 1]
            last = changed == len(sym) - 1
            pair[changed[last]] = -1
            pair[changed[~last]] = numbers(changed[~last])
        sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(words + 1))

    def encode_words(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as flat code points, and how many each word has."""
        sym = self.char[codes]
        # characters outside the vocabulary never merge; they keep their code point, below zero
        sym = np.where(sym < 0, -1 - codes, sym)
        size = np.diff(first)
        cut = np.zeros(len(codes) + 1, bool)
        cut[first] = True
        if size.max(initial=0) > 64:  # long words are cut where no piece joins the two characters
            key = codes[:-1] * 0x110000 + codes[1:]
            found = self.joined[np.minimum(np.searchsorted(self.joined, key), len(self.joined) - 1)] == key
            cut[1:-1] |= ~found
        inner = np.flatnonzero(cut)
        sym, bounds = self.merge(sym, inner)
        counts = np.diff(bounds)
        rare = sym < 0
        if rare.any():
            cp = np.where(rare, -1 - sym, 0)
            width = np.where(rare, np.select([cp < 0x80, cp < 0x800, cp < 0x10000], [1, 2, 3], 4), 1)
            ids = np.repeat(sym, width)
            utf8 = "".join(map(chr, cp[rare].tolist())).encode()
            ids[np.repeat(rare, width)] = self.bytes_at[np.frombuffer(utf8, np.uint8)]
            counts = np.add.reduceat(np.r_[width, 0], bounds[:-1]) * (counts > 0)
            sym = ids
        ends = np.r_[0, np.cumsum(counts)][np.searchsorted(inner, first)]
        return sym, np.diff(ends)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode_block(model: PieceModel, data: np.ndarray, offsets: np.ndarray, bos: bool, eos: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every text of a block, flat, and each text's first position."""
    rows = len(offsets) - 1
    lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]  # offsets in code points
    codes = _codes(data.tobytes().decode())
    filled = np.diff(lead) > 0
    # a mark before every text that has characters
    shift = np.cumsum(filled)
    at = lead[:-1][filled] + shift[filled] - 1
    flat = np.empty(len(codes) + int(filled.sum()), np.int64)
    mark = np.zeros(len(flat), bool)
    mark[at] = True
    flat[mark] = MARK
    flat[~mark] = codes
    flat[flat == 0x20] = MARK
    space = flat == MARK
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin |= mark
    starts = np.flatnonzero(begin)
    ends = np.r_[starts[1:], len(flat)].astype(np.int64)
    if len(starts):
        h = span_hashes(flat, starts, ends)
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        size = (ends - starts)[one]
        ids, count = model.encode_words(ragged(flat, starts[one], size), np.r_[0, np.cumsum(size)])
        where = np.cumsum(count) - count
        per_word = count[which]
        body = ragged(ids, where[which], per_word)
        text_first = np.searchsorted(starts, np.r_[lead[:-1] + np.r_[0, shift[:-1]], len(flat)])
        sizes = np.diff(np.r_[0, np.cumsum(per_word)][text_first])
    else:
        body, sizes = np.zeros(0, np.int64), np.zeros(rows, np.int64)
    first = np.r_[0, np.cumsum(sizes + bos + eos)]
    out = np.empty(first[-1], np.int32)
    inner = np.ones(len(out), bool)
    if bos:
        inner[first[:-1]] = False
        out[first[:-1]] = model.bos
    if eos:
        inner[first[1:] - 1] = False
        out[first[1:] - 1] = model.eos
    out[inner] = body
    return out, first


def decode_row(model: PieceModel, ids: np.ndarray) -> str:
    """Text of one row of ids: surfaces joined, the mark before the text dropped, broken bytes replaced one by one."""
    ids = ids[~model.is_control[ids]]
    if not len(ids):
        return ""
    raw = ragged(model.surface, model.surface_at[ids], model.surface_len[ids]).tobytes()
    if not model.is_byte[ids[0]] and raw[:1] == b" " and ids[0] != model.unk:
        raw = raw[1:]
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode(errors="replace_bytes")


def _replace_bytes(error: UnicodeDecodeError):
    return "�", error.start + 1


def _id_field(df: DataFrame, id_col: str) -> T.StructField:
    return T.StructField(id_col, df.schema[id_col].dataType)


def encoder(model_path: str, id_col: str, bos: bool = True, eos: bool = True):
    """From batches (id, text) to batches (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for rows, data, offsets in text_blocks(batches):
            ids, first = encode_block(model, data, offsets, bos, eos)
            yield pa.RecordBatch.from_arrays([rows.column(0), lists(ids, first)], [id_col, "ids"])

    return run


def decoder(model_path: str, id_col: str, ids_col: str = "ids"):
    """From batches (id, ids) to batches (id, ids, decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import codecs

        codecs.register_error("replace_bytes", _replace_bytes)
        model = load(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                column = rows.column(1)
                bounds = column.offsets.to_numpy()
                values = column.values.to_numpy(zero_copy_only=False)
                text = [decode_row(model, values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([rows.column(0), column, pa.array(text, pa.string())], [id_col, ids_col, "decoded"])

    return run


def _ids_schema(df: DataFrame, id_col: str, ids_col: str = "ids", *more: T.StructField) -> T.StructType:
    return T.StructType([_id_field(df, id_col), T.StructField(ids_col, T.ArrayType(T.IntegerType())), *more])


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", bos: bool = True, eos: bool = True) -> DataFrame:
    """(id, ids array<int>) of every row: the ids of its whole text."""
    return df.select(id_col, text_col).mapInArrow(encoder(model_path, id_col, bos, eos), _ids_schema(df, id_col))


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded string) of every row of ids."""
    return df.select(id_col, ids_col).mapInArrow(decoder(model_path, id_col, ids_col), _ids_schema(df, id_col, ids_col, T.StructField("decoded", T.StringType())))


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded string) of every row, both ways in one worker, with begin and end ids."""
    there, back = encoder(model_path, id_col), decoder(model_path, id_col)
    return df.select(id_col, text_col).mapInArrow(lambda batches: back(there(batches)), _ids_schema(df, id_col, "ids", T.StructField("decoded", T.StringType())))
