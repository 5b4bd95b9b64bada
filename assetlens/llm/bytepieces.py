"""Token ids of a byte-level BPE tokenizer file, with every distinct piece of text encoded once.

The tokenizer first splits a text into pieces (a run of letters, digits or signs with the space before
it, contractions, white space) and merges within pieces only. Those pieces are found for a whole block
at once from the classes of its characters; each distinct piece is encoded by the tokenizer the first
time a worker meets it and gathered from then on. A text with a character beyond U+024F goes to the
tokenizer whole, so its ids never depend on the classes kept here.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from assetlens.llm.blocks import ragged, row_of, span_hashes

LIMIT = 0x250
OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
CACHE = 1_000_000  # pieces kept by a worker


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    import regex

    kind = np.zeros(LIMIT, np.int8)
    for c in range(LIMIT):
        s = chr(c)
        kind[c] = LETTER if regex.match(r"\p{L}", s) else DIGIT if regex.match(r"\p{N}", s) else SPACE if regex.match(r"\s", s) and not 0x1C <= c <= 0x1F else OTHER
    return kind


def piece_starts(codes: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each character; ``border`` marks the first character of each text (and has one more entry)."""
    kind = classes()[codes]
    space = kind == SPACE
    n = len(codes)
    before = np.r_[np.int8(-1), kind[:-1]]
    after_blank = np.r_[False, codes[:-1] == 0x20]
    start = np.where(space, before != SPACE, (kind != before) & ~after_blank)
    # the last white space before something else parts from the run; a blank joins what follows
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~border[1:]
    start |= last
    start |= border[:n]
    mark = np.flatnonzero(start & (codes == 0x27))
    if len(mark):
        padded = np.r_[codes, 0, 0]
        ends = np.r_[np.flatnonzero(border), n]
        room = ends[np.searchsorted(ends, mark, side="right")] - mark - 1
        a, b = padded[mark + 1], padded[mark + 2]
        one = (room >= 1) & np.isin(a, [ord(c) for c in "stmd"])
        two = (room >= 2) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        size = np.where(one, 1, np.where(two, 2, 0))
        # a contraction takes its letters; what follows starts anew
        hit, size = mark[size > 0], size[size > 0]
        start[hit + 1] = False
        long = hit[size == 2]
        start[long + 2] = False
        nxt = hit + size + 1
        nxt = nxt[nxt < n]
        start[nxt] = True
    return start


class ByteModel:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.clear()

    def clear(self):
        self.number: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1, np.int64)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, flat, and how many each has.

        Pieces other than white space are encoded as the lines of one text: a line break is a piece of
        its own between them, and no such piece has its id.
        """
        lines = [t for t in texts if not t.isspace()]
        ids = np.array(self.tokenizer.encode("\n".join(lines), add_special_tokens=False).ids, np.int32)
        cut = np.flatnonzero(ids == self.line_break)
        if len(cut) != len(lines) - 1 or len(lines) != len(texts):
            single = self.library(texts)
            return np.array([x for own in single for x in own], np.int32), np.array([len(own) for own in single], np.int64)
        return np.delete(ids, cut), np.diff(np.r_[-1, cut, len(ids)]) - 1

    def learn(self, hashes: list[int], texts: list[str]):
        blank = np.array([t.isspace() for t in texts], bool)
        for chosen in (np.flatnonzero(~blank), np.flatnonzero(blank)):
            if not len(chosen):
                continue
            ids, size = self.piece_ids([texts[i] for i in chosen])
            end = self.at[-1]
            if end + len(ids) > len(self.flat):
                self.flat = np.r_[self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)]
            self.flat[end : end + len(ids)] = ids
            first = len(self.at) - 1
            self.number.update(zip((hashes[i] for i in chosen), range(first, first + len(chosen))))
            self.at = np.r_[self.at, end + np.cumsum(size)]

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every text of a block, flat, and each text's first position."""
        rows = len(offsets) - 1
        text = data.tobytes().decode()
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
        wide = np.r_[0, np.cumsum(codes >= LIMIT)]
        # a special token's text must reach the tokenizer in one piece
        whole = (wide[lead[1:]] > wide[lead[:-1]]) | (np.array(["<|" in text[a:b] for a, b in zip(lead[:-1].tolist(), lead[1:].tolist())], bool) if "<|" in text else False)
        codes = np.where(codes < LIMIT, codes, 0)
        border = np.zeros(len(codes) + 1, bool)
        border[lead] = True
        starts = np.flatnonzero(piece_starts(codes, border)) if len(codes) else np.zeros(0, np.int64)
        keep = ~whole[np.searchsorted(lead, starts, side="right") - 1] if len(starts) else np.zeros(0, bool)
        ends = np.r_[starts[1:], len(codes)].astype(np.int64)
        starts, ends = starts[keep], ends[keep]
        first = np.searchsorted(starts, lead)
        if len(self.number) > CACHE:
            self.clear()
        h, one, which = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        keys = h.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.number]
        if new:
            self.learn([keys[i] for i in new], [text[starts[one[i]] : ends[one[i]]] for i in new])
        piece = np.array([self.number[k] for k in keys], np.int64)[which] if len(keys) else np.zeros(0, np.int64)
        size = self.at[piece + 1] - self.at[piece]
        ids = ragged(self.flat, self.at[piece], size)
        counts = np.diff(np.r_[0, np.cumsum(size)][first])
        if whole.any():
            numbers = np.flatnonzero(whole)
            own = self.library([text[lead[i] : lead[i + 1]] for i in numbers])
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in zip(numbers, own):
                parts[i] = np.array(x, np.int32)
            counts = np.array([len(x) for x in parts], np.int64)
            ids = np.concatenate(parts)
        return ids, np.r_[0, np.cumsum(counts)]


@lru_cache(maxsize=2)
def load(path: str) -> ByteModel:
    return ByteModel(path)
