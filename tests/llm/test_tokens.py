"""Encoding, decoding and packing against the libraries themselves and against direct checks."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assetlens.llm import bytepieces, packing, queries, sentencepieces
from assetlens.llm.blocks import flat_text
from fixtures import SF, odd_documents, texts_of

SIGNS = ["a", "b", "the", "ing", " ", "  ", "▁", "\n", "\t", "é", "中", "國", "𝒳", "\x00", "aaa", "====", "'", "'s", "'re", "1", "²", "!", "|", "�", "<|endoftext|>", "\x85", "\xa0"]
mixed = st.lists(st.sampled_from(SIGNS), max_size=40).map("".join)


def flat(texts):
    return flat_text(pa.array(texts, pa.string()))


@settings(max_examples=60, deadline=None)
@given(st.lists(mixed, min_size=1, max_size=8))
def test_pieces_are_the_library_s(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    model = sentencepieces.load(queries.PIECE_MODEL)
    ids, first = sentencepieces.encode_block(model, *flat(texts), True, True)
    import codecs

    codecs.register_error("replace_bytes", sentencepieces._replace_bytes)
    for i, text in enumerate(texts):
        own = ids[first[i] : first[i + 1]]
        assert own.tolist() == sp.encode(text, add_bos=True, add_eos=True)
        assert sentencepieces.decode_row(model, own) == sp.decode(own.tolist())


def test_long_words_and_every_piece():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    model = sentencepieces.load(queries.PIECE_MODEL)
    r = random.Random(3)
    vocabulary = [sp.id_to_piece(i).replace("▁", " ") for i in range(259, len(sp))]
    texts = ["a" * 3000, "=" * 5000, " " * 3000, "中国人民" * 2000] + ["".join(r.choice(vocabulary) for _ in range(40)) for _ in range(2000)]
    ids, first = sentencepieces.encode_block(model, *flat(texts), False, False)
    for i, expected in enumerate(sp.encode(texts)):
        assert ids[first[i] : first[i + 1]].tolist() == expected


def test_op1_digests(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    rows = {r["doc_id"]: r for r in queries.op1_sentencepiece(spark, SF).collect()}
    texts = texts_of(spark)
    assert set(rows) == set(texts)
    for i, text in texts.items():
        ids = sp.encode(text, add_bos=True, add_eos=True)
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_op1_odd_rows(spark):
    out = sentencepieces.encode(odd_documents(spark), queries.PIECE_MODEL).collect()
    assert len(out) == odd_documents(spark).count()
    assert sorted(len(r["ids"]) for r in out if r["doc_id"] in (2, 3)) == [2, 2]
    assert sentencepieces.encode(odd_documents(spark).limit(0), queries.PIECE_MODEL).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(mixed, min_size=1, max_size=8))
def test_byte_pieces_are_the_library_s(texts):
    model = bytepieces.load(queries.BYTE_MODEL)
    ids, first = model.encode_block(*flat(texts))
    for i, expected in enumerate(model.library(texts)):
        assert ids[first[i] : first[i + 1]].tolist() == expected


def _check_plan(counts, runs, sequences, capacity):
    seen, places = set(), {}
    for r in runs:
        for k in range(r.last - r.first):
            assert (r.length, r.first + k) not in seen
            seen.add((r.length, r.first + k))
            places.setdefault(r.sequence + k, []).append((r.offset, r.length))
    assert len(seen) == sum(counts.values()) and len(places) == sequences
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=40))
def test_plans_place_every_piece_once(counts):
    runs, sequences = packing.plan(counts, 64)
    _check_plan(counts, runs, sequences, 64)
    assert sequences >= -(-sum(n * c for n, c in counts.items()) // 64)


def test_op8_rows(spark):
    rows = queries.op8_best_fit_packing(spark, SF).collect()
    model, texts = bytepieces.load(queries.BYTE_MODEL), texts_of(spark)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in texts.items():
        ids = np.array(model.library([text])[0] + [0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == 2048 or k == 0)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    total = 0
    for parts in by_sequence.values():
        end = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 2048
        total += end
    assert len(by_sequence) <= 1.03 * -(-total // 2048) + 1


def test_op8_odd_rows(spark):
    docs = odd_documents(spark)
    rows = packing.pack(packing.pieces(docs, queries.BYTE_MODEL, capacity=16), capacity=16).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sum(r["length"] == 1 for r in rows if r["doc_id"] in (2, 3)) == 2
    assert packing.pack(packing.pieces(docs.limit(0), queries.BYTE_MODEL)).count() == 0


@pytest.mark.parametrize("room,expected", [(10, 10), (11, 11), (3, 0)])
def test_fill_is_the_best_subset(room, expected):
    sizes, left = [7, 5, 4], [1, 2, 1]
    take = packing.fill(sizes, left, room)
    assert all(t <= n for t, n in zip(take, left)) and sum(t * s for t, s in zip(take, sizes)) == expected
