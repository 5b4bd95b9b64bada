"""License scan, language model, near duplicates and fingerprints against brute force."""

import hashlib
import math
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlens.llm import components, imatch, kneserney, licenses, neardup, queries
from fixtures import SF, odd_documents, texts_of

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_base(text):
    words = ALNUM.findall(text.translate(LOW))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def _license_row(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_op3_base(spark):
    rows = {r["doc_id"]: r for r in queries.op3_license_scan(spark, SF).collect()}
    texts = texts_of(spark)
    assert set(rows) == set(texts)
    for i, text in texts.items():
        assert _license_row(rows[i]) == license_base(text)
        assert set(rows[i]["base_labels"].split(",")) <= set(rows[i]["labels"].split(",")) | {""}


def test_op3_notices_and_overlaps(spark):
    notice = licenses.NOTICES["mit"][0].split()
    edited = " ".join(notice[:20] + ["really"] + notice[20:33] + notice[34:])
    texts = [
        "cc by nc cc by nc cc by-nc", "Under the MIT License under the mit license", edited, "x " * 500 + edited.upper(),
        "GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3.", "licensed under the gnu", " ".join(notice[:15]),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, text in enumerate(texts):
        assert _license_row(rows[i]) == license_base(text)
    assert [rows[i]["labels"] for i in range(8)] == ["cc-by-nc", "mit", "mit", "mit", "", "gpl-3", "", ""]


def test_op3_odd_rows(spark):
    docs = odd_documents(spark)
    got = sorted((r["doc_id"] or -1, r["n_words"]) for r in licenses.scan(docs).collect())
    assert got == sorted((r["doc_id"] or -1, license_base(r["text"] or "")[0]) for r in docs.collect())
    assert licenses.scan(docs.limit(0)).count() == 0


def steps(counts):
    """What modified Kneser-Ney takes from counts of one, two, and three or more."""
    n = Counter(counts)
    y = n[1] / (n[1] + 2 * n[2])
    return (0, *(k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)))


def textbook(sentences, order):
    """p(word, words before) of the interpolated model, by plain dictionaries."""
    pad = ["<s>"] * (order - 1)
    grams = {order: Counter(tuple([*pad, *s][i : i + order]) for s in sentences for i in range(len(s)))}
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    take = {k: steps(grams[k].values()) for k in grams}
    total, left = Counter(), Counter()
    for k, counts in grams.items():
        for g, c in counts.items():
            total[k, g[:-1]] += c
            left[k, g[:-1]] += take[k][min(c, 3)]
    size = len(grams[1])

    def p(w, before):
        k = len(before) + 1
        lower = p(w, before[1:]) if before else 1 / (size + 1)
        if not total[k, before]:
            return lower
        c = grams[k].get((*before, w), 0)
        return (c - take[k][min(c, 3)] + left[k, before] * lower) / total[k, before]

    return p


@pytest.mark.parametrize("order", [2, 3])
def test_op4_is_the_textbook_model(spark, order):
    texts = {i: WORD.findall(t.translate(LOW)) + ["</s>"] for i, t in texts_of(spark).items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i in texts if not out[i] for w in texts[i])
    total, size = sum(c.values()), len(c)
    p = textbook([texts[i] for i in texts if not out[i]], order)
    pad = ["<s>"] * (order - 1)
    for u in (tuple(pad), (*pad[1:], "the"), (*pad[1:], next(iter(c)))):
        assert sum(p(w, u) for w in c) + p("never seen", u) == pytest.approx(1)
    if order == 3:
        rows = queries.op4_kneser_ney(spark, SF).collect()
    else:
        documents = spark.read.parquet(f"{SF}/documents.parquet")
        held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
        # small ranges, so that there are more of them than shuffle partitions
        model = kneserney.train(documents.where(~held_out), order=2, range_tokens=500)
        rows = kneserney.score(documents, model).select("*", held_out.alias("held_out"), F.lit(model.total).alias("train_tokens")).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        words = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(words), sum(w in c for w in words), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (total + size + 1)) for w in words))
        line = [*pad, *words]
        assert r["score"] == pytest.approx(sum(math.log10(p(line[k + order - 1], tuple(line[k : k + order - 1]))) for k in range(len(words))))


def test_op4_odd_rows(spark):
    docs = odd_documents(spark)
    rows = kneserney.score(docs, kneserney.train(docs)).collect()
    assert len(rows) == docs.count() and all(np.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    empty = kneserney.train(docs.limit(0))
    assert empty.total == 0 and all(np.isfinite(r["score"]) for r in kneserney.score(docs, empty).collect())
    assert kneserney.score(docs.limit(0), empty).count() == 0


def test_op4_counts_beyond_a_byte(spark):
    """A hot word, pair and triple, and contexts with hundreds of third words."""
    texts = list(texts_of(spark).values())[:60] + ["a b c " * 300] + [f"a b x{k} a b y" for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = [WORD.findall(t.translate(LOW)) + ["</s>"] for t in texts]
    p = textbook(lines, 3)
    for r in kneserney.score(docs, kneserney.train(docs, range_tokens=2_000)).collect():
        line = ["<s>", "<s>", *lines[r["doc_id"]]]
        assert r["score"] == pytest.approx(sum(math.log10(p(line[k + 2], tuple(line[k : k + 2]))) for k in range(len(line) - 2)))


def test_op4_pairs_are_stored_in_the_bits_they_need(spark):
    """Mixed pairs differ, fill no more bits than two numbers, and come back from 32 bits and a group; files hold no hash of 64 bits."""
    for half, wide in ((1, 5), (3, 1), (5, 7), (20, 5), (23, 6), (32, 9)):
        ends = np.unique(np.r_[np.arange(40), (1 << half) - 1 - np.arange(40)].clip(0, (1 << half) - 1)).astype(np.uint64)
        mixed = kneserney._mixed((np.repeat(ends, len(ends)) << np.uint64(32)) | np.tile(ends, len(ends)), half)
        shard = kneserney._shard(mixed, wide)
        group, low = kneserney._split(mixed, wide, half)
        assert len({*zip(shard.tolist(), group.tolist(), low.tolist())}) == len(np.unique(mixed)) == len(ends) ** 2
        assert group.max() < 1 << kneserney._groups(wide, half) and not (mixed & np.uint64((1 << 64 - 2 * half) - 1)).any()
    model = kneserney.train(spark.createDataFrame([(f"a{k} b{k % 7} c{k % 3}",) for k in range(300)], "text string"))
    size = lambda kind: sum(len(np.load(f)) for f in pathlib.Path(model.folder).glob(f"{kind}-[0-9]*.npy") if f.stem.count("-") == kind.count("-") + 1)
    width = {kind: {np.load(f).dtype.itemsize * int(np.prod(np.load(f).shape[1:])) for f in pathlib.Path(model.folder).glob(f"{kind}-[0-9]*.npy")} for kind in ("pair", "one", "context", "one-w", "triple")}
    assert width == {"pair": {4}, "one": {4}, "context": {4}, "one-w": {2}, "triple": {2}}
    # pairs: start-a, a-b, b-c, c-end; triples' contexts: start-start, start-a, a-b, b-c
    assert size("pair") == 300 + 300 + 21 + 3 and size("one") + size("context") == 1 + 300 + 300 + 21


def test_op4_pieces_come_back():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64).repeat(3))
    third, n = np.arange(150, dtype=np.uint32), np.arange(150, dtype=np.int64) * 1000
    got = kneserney._unpack(kneserney._pack(keys, third, n), kneserney.TRIPLES)
    assert all((x == y).all() for x, y in zip(got, (keys, third, n)))


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def edited_group(seed, size, words, edits):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("settings", [neardup.Settings(), neardup.Settings(few=1, block=4)])
def test_op9_against_all_pairs(spark, settings):
    texts = edited_group(1, 60, 100, 9) + edited_group(2, 30, 40, 5) + edited_group(3, 40, 200, 16) + ["a b c"] * 3 + ["A B c", "a b d", "", " "] + ["q"] * 2
    random.Random(4).shuffle(texts)
    texts = dict(enumerate(texts))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected, sizes = brute_components(texts)
    rows = {r["doc_id"]: r for r in neardup.near_duplicates(docs, settings).collect()}
    assert {i: r["component_id"] for i, r in rows.items()} == expected
    assert {i: r["n_shingles"] for i, r in rows.items()} == sizes
    assert all(r["kept"] == (r["component_id"] == i) for i, r in rows.items())
    kept = neardup.kept_rows(docs, settings)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


def test_op9_tables(spark):
    expected, _ = brute_components(texts_of(spark))
    assert {r["doc_id"]: r["component_id"] for r in queries.op9_superminhash(spark, SF).collect()} == expected


def test_op9_odd_rows(spark):
    docs = odd_documents(spark)
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r["component_id"] for r in rows if r["doc_id"] == 6} == {1}
    assert {(r["component_id"], r["kept"]) for r in rows if r["doc_id"] in (2, 3)} == {(2, True), (3, True)}
    kept = neardup.kept_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 5, 7, 8, 9]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("settings", [neardup.Settings(), neardup.Settings(few=2, block=2, wide_bytes=40, block_bytes=64)])
def test_op9_null_ids(spark, settings):
    """Near copies among rows without an id are linked; one of them stays, or the row with an id."""
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:k], "new", *words[k + 1 :]]) for k in (0, 58, 59)] + [" ".join(words)]
    other = [" ".join(["z", *near[3].split()[:40], f"y{k}"]) for k in range(3)]
    docs = spark.createDataFrame([(None, t) for t in near[:3]] + [(5, near[3]), (None, near[1])] + [(None, t) for t in other] + [(None, other[0]), (None, None)], "doc_id long, text string")
    rows = neardup.near_duplicates(docs, settings, keep_text_hash=True).collect()
    assert sorted((r["component_id"] or 0, r["kept"]) for r in rows if r["component_id"]) == [(5, False)] * 4 + [(5, True)]
    assert sorted(r["kept"] for r in rows if r["doc_id"] is None and r["component_id"] is None and r["n_shingles"]) in ([False] * 3 + [True], [False] * 2 + [True] * 2)
    kept = [(r["doc_id"], r["text"]) for r in neardup.kept_rows(docs, settings).collect()]
    assert len(kept) == 3 and (5, near[3]) in kept and (None, None) in kept and sum(t in other for _, t in kept) == 1


def test_signatures_estimate_similarity():
    r = np.random.default_rng(2)
    for share in (0.3, 0.75):
        both = int(2000 * share)
        a = r.integers(0, 1 << 62, 2000).astype(np.uint64)
        b = np.r_[a[:both], r.integers(0, 1 << 62, 2000 - both).astype(np.uint64)]
        sig = neardup.super_minhash(np.r_[a, b], np.array([0, 2000, 4000]), 128)
        assert abs((sig[0] == sig[1]).mean() - both / (4000 - both)) < 0.15
    small = neardup.super_minhash(np.arange(3, dtype=np.uint64), np.array([0, 3, 3]), 128)
    assert (small[0] < np.iinfo(np.uint64).max).all() and (small[1] == np.iinfo(np.uint64).max).all()


def test_intersections_are_exact():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 500, r.integers(0, 200))).astype(np.uint64) for _ in range(12)]
    first = np.r_[0, np.cumsum([len(x) for x in sets])]
    flat = np.concatenate(sets)
    got = neardup.intersections(flat, first, flat, first, slab=64)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 400), (400, 300), (300, 500)]
    random.Random(1).shuffle(edges)
    rows = components.components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()
    label = {r["node"]: r["component"] for r in rows}
    assert all(label[i] == 0 for i in range(1, 61)) and all(label[100 + i] == 100 for i in range(1, 30)) and label[400] == label[500] == 300
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def edited_texts(texts):
    ids = sorted(texts, reverse=True)
    out = {}
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        half = len(texts[i]) // 2
        out[i] = (texts[i][: len(texts[i]) - half] + texts[nxt][:half], nxt)
    return out


def test_op10_edits_and_likeness(spark):
    texts = texts_of(spark)
    rows = {r["doc_id"]: r for r in queries.op10_imatch(spark, SF).collect()}
    assert set(rows) == set(texts)
    by_text = {}
    for i, (edited, nxt) in edited_texts(texts).items():
        r = rows[i]
        assert r["n_chars"] == len(texts[i]) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by_text.setdefault(texts[i], r["fingerprint"]) == r["fingerprint"]
        assert (r["near_next"] == 1) == (r["fingerprint"] == rows[nxt]["fingerprint"])
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.15 > 0.05 > np.mean([r["near_next"] for r in rows.values()])


def test_op10_lexicon_is_the_band(spark):
    texts = texts_of(spark)
    df = Counter(w for t in texts.values() for w in {w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w})
    band = imatch.Band(min_share=0.03)
    want = sum(band.min_share * len(texts) <= k <= band.max_share * len(texts) for k in df.values())
    assert imatch.lexicon(spark.read.parquet(f"{SF}/documents.parquet"), band, "text").count() == want


def test_op10_parts_cover_the_lexicon(spark):
    """A change of any one term shows in the likeness, and near copies of short texts are alike."""
    r = random.Random(5)
    terms = sorted(r.randrange(-(2**63), 2**63) for _ in range(200))
    pairs = [(terms, terms[:k] + terms[k + 1 :]) for k in range(200)]
    pairs += [(x, x) for x in (sorted(r.sample(terms, 3 + 2 * (k % 2))) for k in range(100))]
    rows = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "k int, x array<long>, y array<long>").coalesce(1)
    band = imatch.Band()
    prints = rows.select("k", *(imatch.fingerprint(F.col(c), F.lit(w), band).alias(c) for c, w in (("x", "all of one"), ("y", "all of another"))))
    near = [r["near"] for r in prints.select("k", imatch.likeness(F.col("x"), F.col("y")).alias("near")).orderBy("k").collect()]
    assert all(0.9 < x < 1 for x in near[:200])
    assert all(0.4 < x < 1 for x in near[200:]) and np.mean(near[200:]) > 0.7


def test_op10_odd_rows(spark):
    docs = odd_documents(spark)
    rows = imatch.edited_fingerprints(docs).collect()
    assert len(rows) == docs.count()
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    alone = imatch.edited_fingerprints(docs.where("doc_id = 1")).collect()
    text = docs.where("doc_id = 1").first()["text"]
    assert alone[0]["edited_sha256"] == hashlib.sha256((text[: len(text) - len(text) // 2] + text[: len(text) // 2]).encode()).hexdigest()
    assert imatch.edited_fingerprints(docs.limit(0)).count() == 0
