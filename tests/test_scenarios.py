"""Operators on small made frames: sequential brute force, state matrices, idempotence."""

import random

import pytest
from pyspark.sql import functions as F

from assetlens.operators import decide, dq, evidence, folds, graph, match, place, screen, security, tables, wash
from assetlens.operators.place import VERDICT_TIER

NAMES = list(VERDICT_TIER)


# ---- folds -----------------------------------------------------------------------------


def readings(seed, n=300, step=20 * 60_000):
    rng = random.Random(seed)
    out, t = [], {}
    for i in range(n):
        a = "hot" if i % 3 else f"a{rng.randrange(4)}"
        t[a] = t.get(a, 0) + rng.choice([step, step, 2 * step, 5 * step])
        out.append((a, t[a], i, rng.choice(NAMES)))
    return out


def loop_stable(rows, k, hold):
    state, out = {}, {}
    for a, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        cur, pend, n, last = state.get(a, (None, None, 0, None))
        tier = VERDICT_TIER[v]
        if cur is None or (hold is not None and t - last > hold) or tier >= cur:
            cur, pend, n = tier, None, 0
        else:
            n, pend = n + 1, tier if pend is None else max(pend, tier)
            if n >= k:
                cur, pend, n = pend, None, 0
        state[a] = (cur, pend, n, t)
        out[i] = NAMES[cur]
    return out


@pytest.mark.parametrize("k,hold", [(2, 3_600_000), (2, None), (3, 3_600_000), (4, None)])
def test_stability_equals_the_sequential_fold(spark, k, hold):
    rows = readings(11 * k)
    df = spark.createDataFrame(rows, "asset string, observed_at long, seq long, verdict string").repartition(5)
    got = {r.seq: r.stable for r in folds.stabilize(df, k, hold, width=4 * 3_600_000).collect()}
    assert got == loop_stable(rows, k, hold)


def test_better_verdict_needs_confirmation_and_worse_applies_at_once(spark):
    seq = ["WATCH", "QUALIFIED", "WATCH", "QUALIFIED", "QUALIFIED", "REJECTED"]
    df = spark.createDataFrame([("a", i * 60_000, i, v) for i, v in enumerate(seq)], "asset string, observed_at long, seq long, verdict string")
    got = [r.stable for r in folds.stabilize(df).orderBy("seq").collect()]
    assert got == ["WATCH", "WATCH", "WATCH", "WATCH", "QUALIFIED", "REJECTED"]


def test_the_same_instant_again_is_no_confirmation(spark):
    rows = [("a", 0, 0, "WATCH"), ("a", 60_000, 1, "QUALIFIED"), ("a", 60_000, 2, "QUALIFIED"), ("a", 120_000, 3, "QUALIFIED"),
            ("b", 0, 0, "WATCH"), ("b", 60_000, 1, "HIGH_POTENTIAL"), ("b", 60_000, 2, "QUALIFIED"), ("b", 120_000, 3, "HIGH_POTENTIAL")]
    df = spark.createDataFrame(rows, "asset string, observed_at long, seq long, verdict string")
    got = [(r.asset, r.stable) for r in folds.stabilize(df).orderBy("asset", "seq").collect()]
    assert got == [("a", x) for x in ("WATCH", "WATCH", "WATCH", "QUALIFIED")] + [("b", x) for x in ("WATCH", "WATCH", "WATCH", "QUALIFIED")]


def test_thinning_equals_the_sequential_fold(spark):
    rng = random.Random(5)
    rows, t = [], 0
    for i in range(300):
        t += rng.choice([60_000, 120_000, 2_400_000])
        rows.append(("hot", t, i, rng.choice(NAMES[:2]), 50.0 + rng.choice([0, 0.2, 3]), rng.choice([0.5, 0.52, None]), 100.0 + rng.choice([0, 0.5]), rng.choice([None, 0.0, 10.0]), rng.choice([None, 5.0, 5.05, 6.0])))
    last, want = None, {}
    for a, t, i, v, s, c, p, liq, vol in rows:
        def move(x, y):
            return 0 if x is None or y is None else (0 if x == 0 else 1) if y == 0 else abs(x - y) / abs(y)
        if last is None:
            why = "first"
        elif v != last[3]:
            why = "transition"
        elif abs(s - last[4]) >= 1 or (c is not None and last[5] is not None and abs(c - last[5]) >= 0.05) or move(p, last[6]) >= 0.02 or move(liq, last[7]) >= 0.02 or move(vol, last[8]) >= 0.02:
            why = "material-change"
        else:
            why = "heartbeat" if t - last[1] >= 1_800_000 else None
        if why:
            want[i], last = why, (a, t, i, v, s, c, p, liq, vol)
    df = spark.createDataFrame(rows, "asset string, observed_at long, seq long, verdict string, score double, coverage double, price double, liquidity double, volume24h double").repartition(4)
    assert {r.seq: r.reason for r in folds.thin_snapshots(df, width=3_600_000).collect()} == want


# ---- wash ------------------------------------------------------------------------------


WINDOW_MS = 600_000


def may_match(b, s, related):
    """Whether a buy and a sell are a round trip by the stated rule, whatever else was matched."""
    near = abs(b["token_amount"] - s["token_amount"]) <= max(b["token_amount"], s["token_amount"]) * 0.05
    own = b["wallet"] == s["wallet"] or tuple(sorted((b["wallet"], s["wallet"]))) in related
    later = (s["slot"], s["tx_index"]) > (b["slot"], b["tx_index"])
    return (b["side"], s["side"], b["asset"]) == ("BUY", "SELL", s["asset"]) and later and near and own and s["block_time"] - b["block_time"] <= WINDOW_MS


def trips_of(spark, rows, related):
    df = spark.createDataFrame(rows, "asset string, wallet string, tx_id string, side string, slot long, tx_index long, block_time long, token_amount long, quote_amount long").repartition(5)
    return [(r.buy_tx, r.sell_tx) for r in wash.round_trips(df, spark.createDataFrame(sorted(related), "a string, b string")).collect()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_round_trips_hold_the_rule_and_leave_nothing_better(spark, seed):
    rng = random.Random(seed)
    related = {("w0", "w1"), ("w1", "w2"), ("w4", "w5")}
    rows, t = [], 0
    for i in range(240):
        t += rng.choice([0, 20_000, 90_000, 700_000 if i % 40 == 0 else 10_000])
        rows.append(dict(asset="hot", wallet=f"w{rng.randrange(6)}", tx_id=f"t{i}", side=rng.choice(["BUY", "SELL"]), slot=t // 60_000, tx_index=i, block_time=t, token_amount=rng.choice([100, 103, 104, 108, 200]), quote_amount=10))
    trade = {r["tx_id"]: r for r in rows}
    trips = trips_of(spark, rows, related)
    used = [x for p in trips for x in p]
    assert trips and len(used) == len(set(used))
    assert all(may_match(trade[b], trade[s], related) for b, s in trips)
    when = lambda x: (trade[x]["slot"], trade[x]["tx_index"])
    sell_of, buy_of = dict(trips), {s: b for b, s in trips}
    for b in trade:
        for s in trade:
            if may_match(trade[b], trade[s], related) and sell_of.get(b) != s:
                # each possible pair that was passed over lost to an earlier buy's claim or an earlier sell
                assert (s in buy_of and when(buy_of[s]) < when(b)) or (b in sell_of and when(sell_of[b]) < when(s))


def test_round_trips_by_hand(spark):
    def trade(i, wallet, side, minute, amount):
        return dict(asset="A", wallet=wallet, tx_id=f"t{i}", side=side, slot=minute, tx_index=i, block_time=minute * 60_000, token_amount=amount, quote_amount=1)

    rows = [trade(1, "x", "BUY", 0, 100), trade(2, "y", "SELL", 1, 100), trade(3, "x", "SELL", 2, 90), trade(4, "z", "SELL", 3, 105), trade(5, "x", "SELL", 9, 96),
            trade(6, "x", "BUY", 20, 100), trade(7, "x", "SELL", 31, 100), trade(8, "y", "SELL", 40, 50), trade(9, "y", "BUY", 41, 50)]
    assert trips_of(spark, rows, {("p", "q")}) == [("t1", "t5")]
    assert trips_of(spark, rows, {("x", "z")}) == [("t1", "t4")]


# ---- graph -----------------------------------------------------------------------------


def test_crowds_are_not_paired(spark):
    rows = [(f"w{i}", "A", 100, 0, f"x{i}") for i in range(9)] + [("p", "A", 500, 0, "y1"), ("q", "A", 502, 0, "y2"), ("r", "A", 505, 0, "y3")]
    df = spark.createDataFrame(rows, "wallet string, asset string, slot long, block_time long, tx_id string").withColumn("side", F.lit("BUY"))
    assert [(r.a, r.b) for r in graph.coordinated_entry(df).collect()] == [("p", "q")]


def test_shared_launches_found_with_and_without_given_pairs(spark):
    rng = random.Random(3)
    rows = [(f"w{w}", f"L{x}", 0, 0, f"{w}-{x}") for w in range(30) for x in {0, *[rng.randrange(8) for _ in range(3)]}]
    t = spark.createDataFrame(rows, "wallet string, asset string, slot long, block_time long, tx_id string").withColumn("side", F.lit("BUY"))
    launches = spark.createDataFrame([(f"L{i}", 0) for i in range(8)], "asset string, launch_time long")
    have = {}
    for w, a, *_ in rows:
        have.setdefault(w, set()).add(a)
    want = {(a, b) for a in have for b in have if a < b and len(have[a] & have[b]) >= 2}
    got = {(r.a, r.b) for r in graph.same_launches(t, launches).collect()}
    assert got == want
    pairs = spark.createDataFrame(sorted(want)[:5] + [("w0", "nobody")], "a string, b string")
    assert {(r.a, r.b) for r in graph.same_launches(t, launches, pairs).collect()} == set(sorted(want)[:5])


def test_unchecked_funder_stays_likely_and_program_is_infrastructure(spark):
    obs = spark.createDataFrame([("a", "f1", True, True), ("b", "f2", True, True), ("c", "f3", True, True), ("d", "f4", True, True)], "wallet string, funder string, first_inbound boolean, history_from_start boolean")
    st = spark.createDataFrame([("f1", True, 10, 100, 3), ("f2", False, 10, 100, 3), ("f3", True, 5000, 1000, 3)], "funder string, is_wallet boolean, recent_tx long, recent_window_ms long, fan_out long")
    got = {r.wallet: r.classification for r in graph.classify_funding(obs, st).collect()}
    assert got == {"a": "DIRECT", "b": "INFRASTRUCTURE", "c": "INFRASTRUCTURE", "d": "LIKELY"}


# ---- evidence --------------------------------------------------------------------------

NOW, MIN = 1_800_000_000_000, 60_000


def claims(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "asset string, metric string, provider string, value double, observed_at long, invalid string, unavailable string, claim_id long")


def test_resolution_states(spark):
    rows = [
        ("agree", "liquidityUsd", "dexscreener", 100.0, NOW, None, None), ("agree", "liquidityUsd", "jupiter", 250.0, NOW, None, None),
        ("clash", "liquidityUsd", "dexscreener", 100.0, NOW, None, None), ("clash", "liquidityUsd", "jupiter", 301.0, NOW, None, None),
        ("old", "liquidityUsd", "dexscreener", 100.0, NOW - 91 * MIN, None, None), ("bad", "holders", "jupiter", None, NOW, "below minimum 0", None), ("down", "holders", "jupiter", None, NOW, None, "TIMEOUT"),
        ("none", "holders", "jupiter", None, NOW, None, None), ("aging", "liquidityUsd", "dexscreener", 5.0, NOW - 40 * MIN, None, None),
        ("auth", "mintAuthorityRevoked", "rugcheck", 0.0, NOW, None, None), ("auth", "mintAuthorityRevoked", "helius", 1.0, NOW, None, None),
        ("danger", "mintAuthorityRevoked", "rugcheck", 0.0, NOW, None, None), ("danger", "mintAuthorityRevoked", "jupiter", 1.0, NOW, None, None)]
    got = {r.asset: (r.state, r.value, r.source, r.confidence) for r in evidence.resolve_claims(claims(spark, rows), NOW).collect()}
    assert got == {
        "agree": ("MEASURED", 100.0, "dexscreener", 0.9), "clash": ("CONFLICTED", 100.0, "dexscreener", 0.54), "old": ("STALE", None, "dexscreener", 0.0), "bad": ("INVALID", None, "jupiter", 0.0),
        "down": ("UNAVAILABLE", None, "jupiter", 0.0), "none": ("UNKNOWN", None, None, 0.0), "aging": ("MEASURED", 5.0, "dexscreener", 0.72), "auth": ("CONFLICTED", 1.0, "helius", 0.6), "danger": ("CONFLICTED", 0.0, "rugcheck", 0.57)}


def test_overridden_live_authority_is_historical_danger(spark):
    rows = [("a", "mintAuthorityRevoked", "rugcheck", 0.0, NOW, None, None), ("a", "mintAuthorityRevoked", "helius", 1.0, NOW, None, None), ("b", "mintAuthorityRevoked", "helius", 1.0, NOW, None, None)]
    got = {r.asset: r.historical_danger for r in evidence.historical_danger(evidence.resolve_claims(claims(spark, rows), NOW)).collect()}
    assert got == {"a": True, "b": False}


# ---- validation, matching, tables ------------------------------------------------------


def test_absent_is_null_without_issue(spark):
    df = spark.createDataFrame([(1, None, "18446744073709551615"), (2, "", "18446744073709551616"), (3, "1e3", "-1"), (4, "x", "7")], "id long, usd string, amt string")
    out = {r.id: r for r in dq.apply_rules(df, [dq.Rule("usd", "usd"), dq.Rule("amt", "amount")], NOW).collect()}
    assert out[1].usd is None and not out[1].issues and int(out[1].amt) == 2**64 - 1
    assert [i.reason for i in out[2].issues] == ["exceeds u64"]
    assert out[3].usd == 1000.0 and [i.field for i in out[3].issues] == ["amt"]
    assert [i.field for i in out[4].issues] == ["usd"]


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


def test_near_matches_equal_all_pairs(spark):
    rng = random.Random(9)
    refs = ["sol", "us", "bonk", "jupiter", "wrapped", "a", "pythnet"]
    names = set(refs)
    for r in refs:
        for _ in range(25):
            s = list(r)
            for _ in range(rng.randrange(1, 4)):
                op, p = rng.randrange(3), rng.randrange(len(s) + 1)
                if op == 0:
                    s.insert(p, rng.choice("abosju"))
                elif s and p < len(s):
                    s[p:p + 1] = [] if op == 1 else [rng.choice("abosju")]
            names.add("".join(s) or "z")
    names = sorted(names)
    c = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "key long, name string")
    r = spark.createDataFrame([(1000 + i, n) for i, n in enumerate(refs)], "key long, name string")
    want = {(n, x) for n in names for x in refs if abs(len(n) - len(x)) <= (1 if len(x) <= 4 else 2) and lev(n, x) <= (1 if len(x) <= 4 else 2)}
    assert {(x.name, x.ref_name) for x in match.near_matches(c, r).collect()} == want


def test_appending_twice_changes_nothing(spark):
    a = spark.createDataFrame([(i, i % 5) for i in range(20)], "tx_id long, v long")
    empty = a.where("false")
    once = tables.append_idempotent(a.unionByName(a), empty, ["tx_id"])
    assert once.count() == 20 and tables.append_idempotent(a, once, ["tx_id"]).count() == 0


def test_finding_merge_keeps_archives_and_supersedes(spark):
    s = spark.createDataFrame([("keep", "A", "CONFIRMED", 0.9, "v1", None, 1), ("re", "A", "CONFIRMED", 0.9, "v0", None, 1), ("gone", "A", "SUSPICIOUS", 0.5, "v0", None, 1), ("other", "B", "SUSPICIOUS", 0.5, "v0", None, 1)],
                              "id string, asset string, status string, confidence double, rule_version string, superseded_at long, detected_at long")
    f = spark.createDataFrame([("keep", "A", "SUSPICIOUS", 0.5), ("re", "A", "SUSPICIOUS", 0.5), ("new", "A", "SUSPICIOUS", 0.5)], "id string, asset string, status string, confidence double")
    cur, rev = tables.merge_findings(s, f, "v1", 9)
    got = {r.id: (r.status, r.rule_version, r.superseded_at) for r in cur.collect()}
    assert got == {"keep": ("CONFIRMED", "v1", None), "re": ("SUSPICIOUS", "v1", None), "gone": ("SUSPICIOUS", "v0", 9), "other": ("SUSPICIOUS", "v0", None), "new": ("SUSPICIOUS", "v1", None)}
    assert {r.id: r.change for r in rev.collect()} == {"re": "REINTERPRETED", "gone": "SUPERSEDED"}


def test_sold_after_handles_missing_times(spark):
    m = spark.createDataFrame([("A", "m1", 10, 1_000, "0"), ("A", "m2", 20, None, "0")], "asset string, tx_id string, slot long, at long, path string")
    s = spark.createDataFrame([("A", 9, 900, 1), ("A", 10, 1_000, 2), ("A", 30, 50_000, 4), ("A", 40, 90_000_000, 8), ("A", 50, None, 16)], "asset string, slot long, at long, amount long")
    got = {r.tx_id: int(r.sold) for r in security.sold_after(m, s).collect()}
    assert got == {"m1": 2 + 4 + 16, "m2": 4 + 8 + 16}


# ---- placement and verdict -------------------------------------------------------------


def loop_highlights(live, changes, now, n=8):
    rows = {r["asset"]: r for r in live}
    rec = lambda a: (-rows[a]["at"], a)
    of = lambda v: [a for a in rows if rows[a]["verdict"] == v]
    top = sorted(of("HIGH_POTENTIAL") + of("QUALIFIED"), key=lambda a: (VERDICT_TIER[rows[a]["verdict"]], -(rows[a]["rank_score"] if rows[a]["rank_score"] is not None else rows[a]["score"]), *rec(a)))
    lists = {"top": top, "watch": sorted(of("WATCH"), key=rec), "rejected": sorted(of("REJECTED"), key=rec)}
    ch = [c for c in changes if c["asset"] in rows]
    moved = sorted([c for c in ch if c["prev_verdict"] and c["prev_verdict"] != c["verdict"] and rows[c["asset"]]["verdict"] == c["verdict"]], key=lambda c: (-c["changed_at"], c["asset"]))
    new = sorted([c for c in ch if not c["prev_verdict"]], key=lambda c: (-c["changed_at"], c["asset"]))
    lists |= {"changed": [c["asset"] for c in moved], "newest": [c["asset"] for c in new]}
    out = []
    for role in place.HIGHLIGHT_ROLES + ["top"] * n:
        free = [a for a in lists[role] if a not in [x for x, _ in out]]
        if free and len(out) < n:
            out.append((free[0], role))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_highlights_equal_the_sequential_pick(spark, seed):
    rng = random.Random(seed)
    live = [dict(asset=f"a{i:02d}", verdict=rng.choice(NAMES), rank_score=rng.choice([None, float(rng.randrange(90))]), score=float(rng.randrange(90)), at=NOW - rng.randrange(50), age_hours=1.0) for i in range(40)]
    changes = [dict(asset=r["asset"], prev_verdict=rng.choice([None, "WATCH"]), verdict=r["verdict"], changed_at=NOW - rng.randrange(10**6)) for r in rng.sample(live, 12)]
    df = spark.createDataFrame(live, "asset string, verdict string, rank_score double, score double, at long, age_hours double")
    ch = spark.createDataFrame(changes, "asset string, prev_verdict string, verdict string, changed_at long")
    got = [(r.asset, r.role) for r in place.pick_highlights(df, ch, NOW).orderBy("slot").collect()]
    assert got == loop_highlights(live, changes, NOW)


def test_verdict_ladder(spark):
    cols = "asset string, n_fails int, market_coverage double, intel_coverage double, integrity_coverage double, integrity_band string, integrity_risk double, opportunity double, opportunity_coverage double, momentum string, momentum_confidence double"
    good = dict(n_fails=0, market_coverage=0.8, intel_coverage=0.6, integrity_coverage=0.7, integrity_band="LOW", integrity_risk=0.1, opportunity=70.0, opportunity_coverage=0.8, momentum="SUSTAINED", momentum_confidence=0.6)
    cases = {"top": {}, "fail": {"n_fails": 1}, "thin": {"market_coverage": 0.3}, "risky": {"integrity_band": "SEVERE"}, "watch": {"market_coverage": 0.5}, "flat": {"momentum": "NEUTRAL"}, "thin_and_risky": {"market_coverage": 0.3, "integrity_band": "HIGH"}}
    df = spark.createDataFrame([{"asset": k, **good, **v} for k, v in cases.items()], cols)
    got = {r.asset: (r.verdict, list(r.blockers), r.rank_score) for r in decide.verdict(df).collect()}
    assert got["top"] == ("HIGH_POTENTIAL", [], 63.0) and got["fail"] == ("REJECTED", [], None)
    assert {k: got[k][0] for k in ("thin", "risky", "watch", "thin_and_risky")} == {"thin": "INSUFFICIENT_DATA", "risky": "HIGH_RISK", "watch": "WATCH", "thin_and_risky": "INSUFFICIENT_DATA"}
    assert got["flat"][:2] == ("QUALIFIED", ["momentum"])


def test_extension_rules_are_tri_state(spark):
    rows = [("set", [("permanentDelegate", '{"delegate":"Abc"}')]), ("renounced", [("permanentDelegate", '{"delegate":null}')]), ("unreadable", [("permanentDelegate", "{}")]), ("fee", [("transferFeeConfig", '{"newerTransferFee":{"transferFeeBasisPoints":6000}}')])]
    df = spark.createDataFrame(rows, "asset string, extensions array<struct<extension:string,state:string>>")
    x = screen.flatten_extensions(df, screen.extension_rules(spark))
    assert {r.asset: r.active for r in x.collect()} == {"set": True, "renounced": False, "unreadable": None, "fee": True}
    assert {r.asset: r.code for r in screen.extension_gate(x).collect()} == {"set": "PERMANENT_DELEGATE_ACTIVE", "fee": "EXTREME_TRANSFER_FEE"}


def test_reasons_list_each_kind(spark):
    cols = "asset string, effective double, oc_participation double, o_liquidity double, momentum string, creator_status string, creator_freshness string, creator_level string, wash_status string, wash_freshness string, wash_raw string, wash_coverage double, blockers array<string>"
    d = spark.createDataFrame([("a", 12.0, 0.95, 0.7, "DECLINING", "AVAILABLE", "FRESH", "CLEAN", "AVAILABLE", "FRESH", "LOW", 0.6, ["opportunity"])], cols)
    con = spark.createDataFrame([("a", "x", float(i) / 10) for i in range(1, 8)], "asset string, domain string, risk double").withColumn("code", F.concat(F.lit("R"), (F.col("risk") * 10).cast("int")))
    fails = spark.createDataFrame([("a", "CONFIRMED_CURRENT_RUG")], "asset string, code string")
    got = {}
    for r in decide.reasons(d, con, fails).collect():
        got.setdefault(r.kind, []).append(r.code)
    assert got["hard_fail"] == ["CONFIRMED_CURRENT_RUG"] and got["blocker"] == ["opportunity"] and got["coverage"] == ["COVERAGE"]
    assert got["positive"] == ["INDEPENDENT_BUYERS", "HEALTHY_LIQUIDITY", "CREATOR_CLEAN", "WASH_LOW"]
    assert got["risk"] == ["R7", "R6", "R5", "R4", "R3", "MOMENTUM_DECLINING"]


def test_network_paths_by_hand(spark):
    """Best path wins over fewer hops only by confidence; weak rows leave out what strong edges reach; loops do not lead back."""
    edges = spark.createDataFrame([
        ("FUNDED", "s", "m", 0.9, "t1"), ("FUNDED", "s", "m", 0.8, "t0"), ("FUNDED", "m", "x", 0.9, "t2"), ("SHARED_FUNDER", "s", "x", 0.7, "t3"),
        ("BEHAVIOURAL", "s", "y", 0.4, "t4"), ("BEHAVIOURAL", "s", "x", 1.0, "t5"), ("FUNDED", "y", "z", 0.9, "t6"), ("FUNDED", "z", "far", 0.9, "t7"),
        ("FUNDED", "s", "k1", 0.5, "t8"), ("FUNDED", "s", "k2", 0.5, "t9"), ("FUNDED", "k2", "q", 0.6, "ta"), ("FUNDED", "k1", "q", 0.6, "tb"),
    ], "type string, a string, b string, confidence double, evidence string")
    profiles = spark.createDataFrame([("s", 0, 1), ("x", 2, 0), ("y", 0, 1), ("z", 1, 0), ("far", 1, 0), ("q", 0, 3), ("m", 0, 0)], "address string, confirmed int, strongly_suspected int")
    events = spark.createDataFrame([("x", f"T{i}", "DUMP", s, f"e{i}", 100 - i) for i, s in enumerate(["CONFIRMED"] * 4 + ["SUSPICIOUS"] + ["STRONGLY_SUSPECTED"] * 4)],
                                   "address string, asset string, type string, status string, tx_id string, at long")
    rows = {(r["target"], r["kind"]): r for r in graph.network_findings(spark.createDataFrame([("s",)], "address string"), edges, profiles, events).collect()}
    assert {k: (r["hops"], r["path_confidence"]) for k, r in rows.items()} == {
        ("s", "STRONG"): (0, 1.0), ("x", "STRONG"): (2, 0.81), ("q", "STRONG"): (2, 0.3), ("y", "WEAK_ASSOCIATION"): (1, 0.4), ("z", "WEAK_ASSOCIATION"): (2, 0.36)}
    assert [(e["from"], e["to"], e["evidence"]) for e in rows["x", "STRONG"]["path"]] == [("s", "m", "t1"), ("m", "x", "t2")]
    assert [e["evidence"] for e in rows["q", "STRONG"]["path"]] == ["t8", "tb"] and rows["s", "STRONG"]["path"] == []
    assert [e["tx_id"] for e in rows["x", "STRONG"]["events"]] == ["e8", "e7", "e6", "e5", "e3"] and rows["y", "WEAK_ASSOCIATION"]["events"] is None
    assert rows["x", "STRONG"]["by_confirmed"] == 1 and rows["x", "STRONG"]["by_path"] == 2


def test_related_group_with_most_trades_splits(spark):
    """One group of related wallets holds nearly all trades of one asset; its units of work stay small."""
    rng = random.Random(3)
    rows = [("hot", f"w{rng.randrange(40)}", f"t{i}", rng.choice(["BUY", "SELL"]), i, i, i * 20_000, rng.choice([100, 200, 400, 800, 1600, 3200, 6400])) for i in range(1500)]
    trades = spark.createDataFrame([(*r, 1) for r in rows], "asset string, wallet string, tx_id string, side string, slot long, tx_index long, block_time long, token_amount long, quote_amount long")
    related = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(39)], "a string, b string")
    candidates = wash.trip_candidates(trades, related)
    pairs = candidates.select(F.col("buy.tx_id").alias("a"), F.col("sell.tx_id").alias("b"))
    largest = graph.components(pairs).groupBy("component").count().agg(F.max("count")).first()[0]
    assert 2 < largest < 300
    used = [x for r in wash.round_trips(trades, related).collect() for x in (r["buy_tx"], r["sell_tx"])]
    assert len(used) == len(set(used)) > 0


def test_feature_quality_states(spark):
    """Complete, partial and unknown histories; counts are never insufficient; evidence is bounded and ordered."""
    from assetlens.operators import behaviour

    tx = [(w, f"{w}-{i}", i, i, i * 1000, "FAILED" if i % 2 else "SUCCESS") for w in ("full", "part", "none") for i in range(20)] + [("few", "few-0", 0, 0, 7000, "FAILED"), ("few", "few-1", 1, 1, None, "SUCCESS")]
    trades = [(w, f"A{i % 4}", "BUY" if i % 4 < 2 else "SELL", f"{w}-{i}", i, i, i * 1000, 1000) for w in ("full", "part", "none") for i in range(0, 20, 2)]
    txs = spark.createDataFrame(tx, "wallet string, tx_id string, slot long, tx_index long, block_time long, status string")
    tr = spark.createDataFrame(trades, "wallet string, asset string, side string, tx_id string, slot long, tx_index long, block_time long, quote_amount long")
    launches = spark.createDataFrame([("A0", 0), ("A1", 0), ("A2", 0)], "asset string, launch_time long")
    history = spark.createDataFrame([("full", True, None, None), ("part", False, -5000, "born"), ("few", True, None, None)], "wallet string, complete boolean, earliest_at long, earliest_tx string")
    rows = {(r["wallet"], r["feature"]): r for r in behaviour.measured_features(txs, tr, launches, history).collect()}
    assert len(rows) == 4 * 19
    state = lambda w, f: (rows[w, f]["value"], rows[w, f]["quality"], rows[w, f]["evidence"])
    assert state("full", "failed_share") == (0.5, "MEASURED", [f"full-{i}" for i in (1, 3, 5, 7, 9)])
    assert state("part", "failed_share")[1] == "PARTIAL" and state("few", "failed_share") == (None, "INSUFFICIENT", [])
    assert state("full", "first_seen_at") == (0.0, "MEASURED", ["full-0"]) and state("part", "first_seen_at") == (-5000.0, "MEASURED", ["born"])
    assert state("none", "first_seen_at") == (None, "INSUFFICIENT", []) and state("none", "age_at_first_trade_sec") == (None, "INSUFFICIENT", [])
    assert state("part", "age_at_first_trade_sec") == (5.0, "MEASURED", ["part-0"])
    assert state("few", "trades") == (0.0, "PARTIAL", []) and state("few", "launches_entered") == (0.0, "INSUFFICIENT", [])
    assert state("full", "repeated_size_share") == (1.0, "MEASURED", ["full-0", "full-4", "full-8", "full-12", "full-16"])
    assert state("full", "fastest_entry_sec") == (0.0, "MEASURED", ["full-0"]) and state("none", "round_trips")[1] == "PARTIAL"
