"""What a step shuffles: plans of the steps that grew faster than their input, with their results beside a plain loop."""

import os
import random
import time
from itertools import combinations

from assetlens.functions.durable import cut, passing
from assetlens.functions.skew import dealt
from assetlens.operators import creators, decide, graph, security, trades


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_same_launches_look_up_only_the_hottest_launches(spark):
    rnd = random.Random(5)
    held = {f"w{i:02d}": {f"L{min(rnd.randrange(14), rnd.randrange(14))}" for _ in range(rnd.randrange(1, 7))} for i in range(40)}
    rows = [(w, a, "BUY", 1, 1_000, f"{w}{a}") for w, launches in held.items() for a in launches] * 2
    trades = spark.createDataFrame(rows, "wallet string, asset string, side string, slot long, block_time long, tx_id string")
    launches = spark.createDataFrame([(f"L{i}", 0) for i in range(14)], "asset string, launch_time long")
    got = graph.same_launches(trades, launches)
    assert exchanges(got) <= 4
    want = {(a, b, ",".join(sorted(held[a] & held[b])[:3]), str(len(held[a] & held[b]))) for a, b in combinations(sorted(held), 2) if len(held[a] & held[b]) >= 2}
    assert {(r.a, r.b, r.evidence, r.detail) for r in got.collect()} == want and want


def test_smallest_shuffles_once(spark):
    rows = [("k", v) for v in "dcbaab"] + [("k", None), (None, "z"), (None, "z"), ("m", None)]
    df = spark.createDataFrame(rows, "k string, v string")
    got = graph.smallest(df, ["k"], "v", 3)
    assert exchanges(got) == 1
    assert {(r.k, tuple(r.v)) for r in got.collect()} == {("k", ("a", "b", "c")), (None, ("z",))}


def test_domains_of_rows_dealt_by_asset_are_not_shuffled_again(spark):
    con = spark.createDataFrame(
        [("x", "rugHistory", "A", "f", 0.2, 0.9, None), ("x", "rugHistory", "B", "g", 0.5, 0.6, 0.7), ("x", "rugHistory", "C", "g", 0.4, 0.9, 0.7), (None, "rugHistory", "A", "f", 0.9, 0.9, None)],
        "asset string, domain string, code string, family string, risk double, confidence double, coverage double")
    bases = spark.createDataFrame([(a, d, 0.8, 0.7) for a in ("x", "x", "y", None) for d in ("rugHistory", "tokenSecurity")], "asset string, domain string, coverage double, base_confidence double")
    got = decide.build_domains(dealt(con, "asset"), dealt(bases, "asset"))
    assert exchanges(got) == 2
    assert sorted(tuple(str(v) for v in r) for r in got.where("risk > 0").collect()) == [("x", "rugHistory", "0.55", "HIGH", "0.6", "0.8", "0.7")] * 2
    assert got.count() == 8


def test_contributions_are_sifted_outside_the_array(spark):
    from assetlens.plans import q_decide
    from assetlens.sources.tables import Tables

    con = q_decide.contributions(Tables(spark, "/root/testdata/sf0.001"))
    assert "explode(filter(" not in con._jdf.queryExecution().optimizedPlan().toString()


def facts(spark):
    home = spark.createDataFrame([("x", 1), ("y", 2)], "asset string, component long")
    members = spark.createDataFrame([("w1", 1), ("w2", 2), ("w3", 2)], "wallet string, component long")
    named = spark.createDataFrame([("x", "w9"), ("x", "w9"), ("y", "w1")], "asset string, wallet string")
    rows = [(a, p, q) for a in ("x", "y", "z", None) for p in ("w1", "w2", "w9", None) for q in ("w3", "w1")]
    return creators.Circle(home, members, named), spark.createDataFrame(rows, "asset string, p string, q string")


def test_small_removals_are_left_out_before_the_circle_is_asked(spark):
    circle, _ = facts(spark)
    rows = [("x", f"t{i}", 1, 2, "w1", f, 0.95, 5) for i, f in enumerate((0.1, 0.3, 0.8, None))]
    removals = spark.createDataFrame(rows, "asset string, tx_id string, slot long, at long, actor string, reserve_fraction double, confidence double, amount long")
    dim = spark.createDataFrame([("w1", True)], "address string, is_wallet boolean")
    got = security.liquidity_drain(removals, circle, dim)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in x and "confidence" in x and "reserve_fraction" in x for x in plan.splitlines())
    assert {(r.tx_id, r.status) for r in got.collect()} == {("t1", "STRONGLY_SUSPECTED"), ("t2", "CONFIRMED")}


def shuffle_files(spark) -> set[str]:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name for d in dirs for _, _, names in os.walk(d.getPath()) for name in names if name.startswith("shuffle")}


def test_a_cut_frees_the_shuffles_behind_it(spark):
    before = shuffle_files(spark)
    got = cut(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert got.count() == 7


def test_edges_are_folded_in_one_shuffle(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["FUNDED", "TOKEN_TRANSFER"]), rnd.choice("ab"), rnd.choice("xyz"), True, rnd.randrange(9) / 10, rnd.randrange(50), rnd.choice([None, *"stuvwpqr"]), rnd.choice([None, "DIRECT", "LIKELY"])) for _ in range(90)]
    rows += [("TOKEN_TRANSFER", "a", "alone", True, 0.5, None, None, None)]
    got = graph.fold_edges(spark.createDataFrame(rows, "type string, a string, b string, directed boolean, confidence double, at long, evidence string, detail string"))
    assert exchanges(got) == 1
    want = {}
    for kind, a, b in {r[:3] for r in rows}:
        of = [r for r in rows if r[:3] == (kind, a, b)]
        times, details = [r[5] for r in of if r[5] is not None], [r[7] for r in of if r[7]]
        want[kind, a, b] = (max(r[4] for r in of), len(of), min(times, default=None), max(times, default=None), max(details, default=None),
                            kind == "FUNDED" and "DIRECT" in details, sorted({r[6] for r in of if r[6]})[:5] or None)
    assert {(r.type, r.a, r.b): (r.confidence, r["count"], r.first_at, r.last_at, r.detail, r.direct_funding, r.evidence) for r in got.collect()} == want


def test_creator_edges_work_the_folded_edges_out_once(spark):
    raw = spark.createDataFrame([("FUNDED", "a", "b", True, 0.95, 5, e, "DIRECT") for e in "zyx"] + [("SHARED_FUNDER", "a", "b", False, 0.7, 5, "e", "f"), ("TOKEN_TRANSFER", "b", "c", True, 0.9, 7, None, "p")],
                                "type string, a string, b string, directed boolean, confidence double, at long, evidence string, detail string")
    made = spark.createDataFrame([("a", "T1"), ("b", "T4"), ("b", "T2"), ("b", "T3"), ("b", "T5")], "creator string, asset string")
    got = graph.creator_edges(graph.fold_edges(raw), made)
    assert exchanges(got) <= 4
    assert {(r.a, r.b, r.confidence, r["at"], r.evidence, r.detail) for r in got.collect()} == {
        ("a", "b", 0.9, 5, "x", "FUNDED|a|T1"), ("a", "b", 0.9, 5, "x", "FUNDED|b|T2,T3,T4"), ("b", "c", 0.9, 7, None, "TOKEN_TRANSFER|b|T2,T3,T4")}


def test_initial_funding_carries_no_amount_that_is_not_read(spark):
    rows = [("s2", "w", "t1", 5, 1, 20), ("s1", "w", "t1", 6, 1, 30), ("s1", "w", "t1", 7, 1, 10), ("s1", "w", "t0", 0, 1, 1), ("w", "w", "t0", 3, 1, 1), ("s3", "v", "t9", 2, None, None)]
    inbound = spark.createDataFrame([(*r, "SUCCESS") for r in rows], "src string, dst string, tx_id string, amount long, slot long, at long, status string")
    got = trades.initial_funding(inbound)
    assert {tuple(r) for r in got.collect()} == {("w", "s1", "t1", 7, 1, 10), ("v", "s3", "t9", 2, None, None)}
    plan = got.select("wallet", "funder")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "amount" in x]


def test_facts_are_flagged_in_two_moves(spark):
    circle, df = facts(spark)
    got = circle.flag(df, "p", "flag")
    assert exchanges(got) == 4  # facts by asset and by wallet, the circles, the members
    assert {(r.asset, r.p) for r in got.where("flag").collect()} == {("x", "w1"), ("x", "w9"), ("y", "w2"), ("y", "w1")}
    assert got.count() == df.count()
    assert exchanges(circle.flag(dealt(df, "asset"), "p", "flag")) == 4


def test_a_mint_moves_once_to_look_up_what_was_sold(spark):
    rnd, day = random.Random(3), 86_400_000
    moment = lambda: (lambda t: (t // day, rnd.choice([t, t, t, None])))(rnd.randrange(6 * day))
    mints = [(a, f"m{i}", *moment(), f"p{i}") for i, a in enumerate(rnd.choices(["x", "y", "z", None], k=60))] + [("x", "m", None, 5 * day, "p"), ("x", None, 1, day, "p")]
    sales = [(rnd.choice(["x", "y", None]), *moment(), rnd.randrange(1, 9)) for _ in range(80)]
    got = security.sold_after(spark.createDataFrame(mints, "asset string, tx_id string, slot long, at long, path string"), spark.createDataFrame(sales, "asset string, slot long, at long, amount long"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "path" in x]

    def sold(asset, tx, slot, at):
        if None in (asset, tx, slot):
            return None if at is None else 0
        near = lambda s: s[1] >= slot if at is None or s[2] is None else 0 <= s[2] - at <= day
        return sum(s[3] for s in sales if s[0] == asset and s[1] is not None and near(s))

    assert sorted(((r.tx_id or "", r["at"] or 0, None if r.sold is None else int(r.sold)) for r in got.collect()), key=str) == sorted(((m[1] or "", m[3] or 0, sold(*m[:4])) for m in mints), key=str)


def test_tables_in_passing_go_when_the_block_ends(spark):
    with passing(spark) as keep:
        at = os.path.dirname(keep(spark.range(3)).inputFiles()[0].removeprefix("file://"))
        assert os.path.isdir(at)
        kept = cut(spark.range(3))
    assert not os.path.exists(at) and kept.count() == 3
