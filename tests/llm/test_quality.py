"""Rules against a direct count; classifiers by held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from assetlens.llm import queries, ranking, repetition, toxicity
from fixtures import SF, odd_documents, texts_of

BIG = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def direct(text):
    """The base columns and the coverages, by plain loops."""
    words = WORD.findall(text)
    covered = {}
    for n in (2, 3, 4, 6, 10):
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        covered[n] = {i + k for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for k in range(n)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = Counter(lines)
    chars = sum(map(len, words))
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(count), "n_repeat_words": len(covered[3])}
    out["line_coverage"] = sum(len(w) for x in lines if count[x] > 1 for w in WORD.findall(x)) / max(chars, 1)
    out |= {f"coverage_{n}": sum(len(words[i]) for i in covered[n]) / max(chars, 1) for n in (2, 4, 6, 10)}
    out["base_failed"] = len(words) < 50 or 100 * len(covered[3]) > 50 * len(words)
    limits = {"coverage_2": 0.65, "coverage_4": 0.40, "coverage_6": 0.30, "coverage_10": 0.25, "line_coverage": 0.30}
    out["kept"] = not out["base_failed"] and out["n_symbols"] <= 0.5 * len(words) and all(out[k] <= v for k, v in limits.items())
    return out


def test_op5_counts(spark):
    texts = texts_of(spark)
    rows = {r["doc_id"]: r for r in queries.op5_quality_rules(spark, SF).collect()}
    assert set(rows) == set(texts)
    for i, text in texts.items():
        for key, value in direct(text).items():
            assert rows[i][key] == pytest.approx(value), (i, key)


def test_op5_odd_rows(spark):
    docs = odd_documents(spark)
    got = sorted(((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["kept"]) for r in repetition.quality_rules(docs).collect()))
    want = sorted((r["doc_id"] or -1, *(direct(r["text"] or "")[k] for k in ("n_words", "word_chars", "kept"))) for r in docs.collect())
    assert got == want
    kept = repetition.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == sum(w[3] for w in want)
    assert repetition.quality_rules(docs.limit(0)).count() == 0


def test_op5_rejects_pasted_passages(spark):
    """Passages pasted again, 30 to 45 % of a text, pass the base rules and fail the method's."""
    fresh = lambda n, at: [f"w{at + i:05d}" for i in range(n)]
    texts = []
    for percent in (0, 10, 30, 35, 40, 45):
        block = fresh(5 * percent, 0)
        texts.append(" ".join(block + fresh(500, 5000) + block + fresh(500 - 10 * percent, 7000)))
    line = " ".join(fresh(40, 0))
    texts.append("\n".join(x for i in range(8) for x in (line, " ".join(fresh(80, 1000 * i + 1000)))))
    rows = sorted(repetition.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert not any(r["base_failed"] for r in rows)
    assert [r["kept"] for r in rows] == [True, True, False, False, False, False, False]


def _judged(rows, labels, label):
    pairs = [(r, labels[r["doc_id"]][label]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return np.array([r["score"] for r, _ in pairs]), np.array([r["predicted"] for r, _ in pairs]), np.array([y for _, y in pairs])


def _auc(score, y):
    order = np.argsort(np.argsort(score))
    return (order[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


@pytest.mark.parametrize("name,label,auc,accuracy", [("op6_quality_ranking", "quality", 0.99, 0.98), ("op2_toxicity", "toxic", 0.88, 0.94)])
def test_held_out(spark, name, label, auc, accuracy):
    rows = queries.QUERIES[name](spark, BIG).collect()
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    score, predicted, y = _judged(rows, labels, label)
    assert _auc(score, y) > auc and (predicted == y).mean() > accuracy


def test_classifiers_take_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 0, 1), (5, 1, 0), (6, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    for used in (labels, labels.where("quality = 1"), labels.limit(0)):
        model = ranking.fit(docs, used, "quality", folds=5)
        assert ranking.rank(docs, model).where("score between 0 and 1").count() == docs.count()
        assert ranking.kept_rows(docs, model).columns == docs.columns
        rated = toxicity.rate(docs, toxicity.fit(docs, used)).collect()
        assert len(rated) == docs.count() and all(0 <= r["score"] <= 1 for r in rated)
        assert len({r["score"] for r in rated if r["doc_id"] == 7}) == 1
    assert ranking.rank(docs.limit(0), model).count() == 0


def test_held_out_labels_change_nothing(spark):
    """Held-out labels, repeated label rows and labels of unknown ids leave every score as it is."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    unknown = 1 + max(r["doc_id"] for r in docs.select("doc_id").collect())
    more = [(i, 1 - q, 1 - t) if out(i) else (i, q, t) for i, q, t in rows]
    more += [r for r in rows if not out(r[0]) and r[1] == 0] * 3 + [(unknown + k, 0, 1) for k in range(100)]
    first, second = (spark.createDataFrame(x, "doc_id long, quality int, toxic int") for x in (rows, more))
    assert any(map(out, (i for i, _, _ in rows)))
    for fit, rate in ((lambda x: ranking.fit(docs, x, "quality", folds=5), ranking.rank), (lambda x: toxicity.fit(docs, x), toxicity.rate)):
        a, b = ({r["doc_id"]: r["score"] for r in rate(docs, fit(x)).collect()} for x in (first, second))
        assert a == b


def test_windows_cover_every_word():
    for n in range(40):
        begin, last, at = toxicity.windows(np.array([0, n, n + 3]))
        mine = range(at[0], at[1])
        assert {k for i in mine for k in range(begin[i], last[i] + 1)} == set(range(n))
