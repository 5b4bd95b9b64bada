"""Vector codes, ranked search and chat formatting against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from assetlens.llm import chat, codes, queries, treap
from fixtures import SF, odd_documents
from pyspark.sql import functions as F

# ---- vector codes ----------------------------------------------------------------------


def lloyd(vectors, ids, s):
    """Codebooks and (code, error) of every vector, by plain loops over whole numbers."""
    whole = [[math.floor(s.scale * x) for x in v] for v in vectors]
    width = len(whole[0]) // s.parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = {}
    for k in sorted(range(len(ids)), key=lambda k: (ids[k], vectors[k])):
        first.setdefault(ids[k], whole[k])
    start = [first[i] for i in sorted(first)][: s.entries]
    books = [[cut(v, p) for v in start] for p in range(s.parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(s.rounds):
        for p, book in enumerate(books):
            members = [[] for _ in book]
            for v in whole:
                members[near(cut(v, p), book)[0]].append(cut(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for e, m in zip(book, members)]
    out = []
    for v in whole:
        found = [near(cut(v, p), books[p]) for p in range(s.parts)]
        out.append(("".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    return books, out


def test_op11_equals_loops(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    books, want = lloyd([r["embedding"] for r in rows], [r["vec_id"] for r in rows], codes.Settings())
    by_label = Counter()
    for r, (_, error) in zip(rows, want):
        by_label[r["label"]] += error
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    got = {r["vec_id"]: r for r in queries.op11_member_lloyd(spark, SF).collect()}
    assert len(got) == len(rows)
    for r, (code, error) in zip(rows, want):
        g = got[r["vec_id"]]
        assert (g["code"], g["error"], g["label_error"], g["codebooks_sha256"]) == (code, error, by_label[r["label"]], digest)


def test_op11_odd_rows(spark):
    """Nulls, other lengths, repeated rows, a hot group of copies, null ids and labels, extra columns."""
    nan, inf = float("nan"), float("inf")
    rows = [(i, [i * 0.25 + j * 0.5 for j in range(8)], i % 3 if i % 4 else None) for i in range(40)]
    hot = [(1000 + i, [7.5] * 8, 1) for i in range(60)]
    dropped = [(50, None, 1), (51, [1.0] * 7 + [None], 1), (52, [nan] + [0.0] * 7, 1), (53, [0.0] * 7 + [-inf], None)]
    same = [rows[3], rows[3], (None, [3.25] * 8, None)]
    other = [(60, [1.0] * 16, 2), (61, [], 2)]
    s = codes.Settings(parts=4, entries=5, rounds=3)
    schema = "vec_id long, embedding array<float>, label int, position int, code string, entry string"
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows + hot + dropped + same + other], schema)
    books = codes.learn(df, s)
    learned = rows + hot + same
    want_books, want = lloyd([r[1] for r in learned], [r[0] if r[0] is not None else 10**9 for r in learned], s)
    assert books.entries.tolist() == want_books
    coded = codes.with_label_errors(codes.encode(df, books))
    sums = Counter()
    for r, (_, e) in zip(learned, want):
        sums[r[2]] += e
    key = lambda x: tuple((v is not None, v) for v in x)
    expect = [(r[0], r[2], c, e, sums[r[2]]) for r, (c, e) in zip(learned, want)] + [(r[0], r[2], None, None, sums[2]) for r in other]
    got = [(r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in coded.collect()]
    assert sorted(got, key=key) == sorted(expect, key=key)
    empty = df.limit(0)
    assert codes.learn(empty, s) is None and codes.with_label_errors(codes.encode(empty, None)).count() == 0
    few = codes.learn(df.where("vec_id < 2"), s)  # fewer ids than entries
    assert few.entries.shape == (4, 2, 2)


def test_op11_moves_only_what_changed(spark):
    """A member that keeps its entry never reaches the shuffle of a round."""
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5)], 0) for i in range(200)], "vec_id long, embedding array<float>, label int")
    s = codes.Settings(parts=2, entries=4, rounds=1)
    books = codes.first_codebooks(df, s, "vec_id", "embedding")
    home = codes.Residents(spark, 4)
    home.replace(codes._dealt(df, books, 4, "embedding", "vec_id").repartition(4, *codes.OWNER))
    plan = home.members().groupBy(*codes.OWNER).count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    before = Counter(tuple(r) for r in home.members().select("position", "x0").collect())
    home.move(books)  # the same books: nothing moves
    assert Counter(tuple(r) for r in home.members().select("position", "x0").collect()) == before
    home.drop(home.name, home.path)


def test_op11_extremes(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38], 0), (2, [0.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    s = codes.Settings(parts=1, entries=2, rounds=2)
    got = {r["vec_id"]: r["error"] for r in codes.encode(df, codes.learn(df, s)).collect()}
    assert got == {1: 0, 2: 0}


# ---- ranked search ---------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(documents, items, best=20):
    cut = lambda t: Counter(TERM.findall((t or "").translate(LOWER)))
    docs = [(i, c) for i, t in documents if (c := cut(t))]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 75 + (25 * sum(c.values()) * n) // total
            score = sum(k * w[t] * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in cut(text).items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scores)[:best], 1)]
    return out


def rows_of(df):
    return [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def test_op12_equals_loops(spark):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert order(rows_of(queries.op12_k2_treap(spark, SF))) == order(ranked(documents, items))


@pytest.mark.parametrize("s", [treap.Settings(best=3, columns=7, cells=11, batch=2), treap.Settings(best=2, paths=4), treap.Settings(best=5, item_bytes=80)])
def test_op12_small_grids_and_ties(spark, s):
    """Grids of a few columns, ties among copies, hot words, several blocks of items."""
    r = random.Random(1)
    texts = [" ".join(r.choice("a b c D e f g hot hot hot".split()) for _ in range(r.randrange(12))) for _ in range(60)]
    documents = list(enumerate(texts + ["a b hot"] * 20 + [None, "", "..."])) + [(7, "a b hot"), (None, "a b hot")]
    items = [(0, "a b"), (1, "HOT"), (2, None), (3, ""), (4, "absent"), (5, "a a a g G c"), (5, "e"), (6, " ".join("abcdefg" * 9))]
    r.shuffle(documents)
    docs = spark.createDataFrame([(*d, "x", 1) for d in documents], "doc_id long, text string, id string, score int").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, rank string")
    assert order(rows_of(treap.ranked_search(docs, asked, s))) == order(ranked(documents, items, s.best))


def test_op12_odd_and_empty(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "word7 one TWO same"), (2, "éàü 中文")], "item_id long, text string")
    want = ranked([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert order(rows_of(treap.ranked_search(docs, items))) == order(want)
    assert treap.ranked_search(docs.limit(0), items).count() == 0 and treap.ranked_search(docs, items.limit(0)).count() == 0


def test_op12_quadtree_holds_the_cells():
    r = np.random.default_rng(0)
    row, column = np.divmod(r.choice(32 * 32, 200, replace=False), 32)
    value = r.integers(1, 1000, 200)
    tree = treap.Quadtree(row, column, value, 5)
    cells = {(a, b): v for a, b, v in zip(row.tolist(), column.tolist(), value.tolist())}
    assert tree.top[0] == value.max()
    for a in range(32):
        for b in range(32):
            node = np.array([0])
            for bit in range(4, -1, -1):
                node = tree.child(node, np.array([((a >> bit) & 1) * 2 + ((b >> bit) & 1)]))
            assert tree.top[node[0]] == cells.get((a, b), 0)


# ---- chat formatting -------------------------------------------------------------------

SIGNS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[TURN]", "[/TURN]", "\\", "[", "<", "]", ">", "/", " ", "\n", "INST", "s", "é", "𝒳", "a", "$1", "3:", "ok"]
said = st.one_of(st.none(), st.lists(st.sampled_from(SIGNS), max_size=12).map("".join))
roles = st.one_of(st.sampled_from(["user", "assistant", "system", None, "", "tool", "User"]), said)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(roles, said), min_size=1, max_size=5), min_size=1, max_size=30))
def test_op13_round_trip(spark, conversations):
    rows = [(c, t, role, text, "x") for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    for r in chat.format_conversations(df).collect():
        source = [(role or "", text or "") for role, text in conversations[r["conv_id"]]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == source
        assert "".join(t["opening"] + t["body"] + t["closing"] for t in r["turns"]) == r["formatted"]
        # no control string is left inside a body
        assert not any(x in t["body"] for t in r["turns"] for x in SIGNS[:8])
        assert r["escaped_turns"] == sum(bool(re.search(r"\[(\\|/?(INST|TURN)\])|<(\\|/?s>|</?SYS>>)", text) or (role not in ("user", "assistant", "system") and re.search(r"\[(\\|/?(INST|TURN)\])|<(\\|/?s>|</?SYS>>)", role))) for role, text in source)


def test_op13_odd_rows(spark):
    long = "word [INST] </s> " * 30_000
    rows = [(1, 0, "user", None), (1, 1, None, None), (2, 5, "assistant", long), (2, 5, "assistant", long), (2, None, "user", "first"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "assistant", "<"), (3, 1, "user", "/s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got[1]["turns_sha256"] == digest("user\n\n\n\n") and got[1]["loss_chars"] == 0 and got[1]["n_turns"] == 2
    assert got[2]["turns_sha256"] == digest("user\nfirst\n" + f"assistant\n{long}\n" * 2) and got[2]["loss_sha256"] == digest(long * 2)
    assert got[None]["turns_sha256"] == digest("user\nx\nassistant\ny\n") and got[None]["loss_sha256"] == digest("y")
    assert got[3]["turns_sha256"] == digest("assistant\n<\nuser\n/s>\n") and got[3]["escaped_turns"] == 0
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_op13_last_way_and_breaches(spark):
    """Every way reads back; a text that breaks the grammar gives null turns."""
    one = spark.createDataFrame([("a [INST] \\ [\\ <\\ </s> [TURN]",)], "t string")
    for way in (1, 2):
        turns = one.select(chat.parsed(chat.rendered(F.lit("x]["), F.col("t"), way)).alias("p")).select(chat.said(F.col("p")[0]).alias("s"), F.size("p").alias("n")).first()
        assert (turns["s"], turns["n"]) == ("3:x][a [INST] \\ [\\ <\\ </s> [TURN]", 1)
    for bad in ("[INST] a", "[INST] a </s>", "[TURN] 9:x a [/TURN]", "[TURN] x:x a [/TURN]", "a", "", "[INST] a[/INST]"):
        assert spark.range(1).select(F.get(chat.parsed(F.lit(bad)), F.lit(0)).alias("p")).first()["p"] is None


def test_op13_plan_is_native(spark):
    plan = queries.op13_chat_grammar(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|ExistingRDD", plan)
