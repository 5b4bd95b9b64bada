"""History, monitoring and calibration queries over the verdict tape."""

from pyspark.sql import functions as F

from assetlens.operators import calibrate as C
from assetlens.operators import folds as FO
from assetlens.operators import history as H
from assetlens.operators import monitor as M
from assetlens.operators import place as P
from assetlens.plans.q_tables import findings_sql
from assetlens.plans.registry import query
from assetlens.plans.sqltext import ACT, AS, EV, PLACE, TR, VD, half_up as hu, tier
from assetlens.sources.tables import ASSET_NOW

LAST = 1_706_659_200_000
DAY = 86_400_000


def points(t):
    """The verdict tape with transitions marked on every third reading and market rows on even ones."""
    v = t.verdicts().withColumn("is_transition", F.col("seq") % 3 == 0)
    m = t.verdicts().where("seq % 2 = 0").select("asset", "observed_at", "price", "liquidity")
    a = t.event_facts().groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("asset")).agg(F.min("event_type").alias("symbol"))
    return v, m, a


SYM = "sy AS (SELECT 'U'||user_id AS asset, min(event_type) AS symbol FROM events GROUP BY 1)"


@query("H01", f"""WITH {VD}, x AS (SELECT * FROM vd WHERE asset='U7' ORDER BY observed_at DESC, seq DESC LIMIT 50)
 SELECT x.observed_at, x.asset, x.seq, x.score, m.price, m.liquidity FROM x LEFT JOIN (SELECT * FROM vd WHERE seq%2=0) m ON m.asset=x.asset AND m.observed_at=x.observed_at""")
def history_points(t):
    v, m, _ = points(t)
    return H.history_points(v, m, "U7", 50)


@query("H02", f"WITH {VD} SELECT asset, observed_at, price, liquidity FROM vd WHERE asset='U7' AND observed_at BETWEEN {LAST - 20 * DAY} AND {LAST - 5 * DAY} AND seq%2=0 ORDER BY observed_at LIMIT 40")
def market_range(t):
    return H.range_scan(points(t)[1], "U7", LAST - 20 * DAY, LAST - 5 * DAY, 40)


@query("H02", f"WITH {VD} SELECT asset, observed_at, verdict, score FROM vd WHERE asset='U9' AND observed_at BETWEEN {LAST - 20 * DAY} AND {LAST} ORDER BY observed_at LIMIT 40")
def verdict_range(t):
    return H.range_scan(points(t)[0], "U9", LAST - 20 * DAY, LAST, 40).select("asset", "observed_at", "verdict", "score")


@query("H03", f"WITH {VD}, {SYM}, x AS (SELECT * FROM vd WHERE seq%3=0 ORDER BY observed_at DESC, seq LIMIT 50) SELECT x.asset, observed_at, verdict, symbol FROM x LEFT JOIN sy ON x.asset=sy.asset")
def recent_transitions(t):
    v, _, a = points(t)
    return H.recent_transitions(v, a, 50).select("asset", "observed_at", "verdict", "symbol")


CH = f"""{VD}, {SYM}, ch AS (SELECT asset, observed_at, seq, verdict, lag(verdict) OVER w AS prev_verdict, lag(observed_at) OVER w AS prev_at FROM vd WHERE seq%3=0 WINDOW w AS (PARTITION BY asset ORDER BY observed_at, seq))"""



@query("H04", f"""WITH {CH} SELECT ch.*, symbol, m.price AS price_at, m.liquidity AS liquidity_at FROM ch LEFT JOIN sy ON ch.asset=sy.asset LEFT JOIN (SELECT * FROM vd WHERE seq%2=0) m ON m.asset=ch.asset AND m.observed_at=ch.observed_at WHERE ch.observed_at>={LAST - 15 * DAY}""")
def verdict_changes(t):
    v, m, a = points(t)
    return H.verdict_changes(v, a, m, since=LAST - 15 * DAY).select("asset", "observed_at", "seq", "verdict", "prev_verdict", "prev_at", "symbol", "price_at", "liquidity_at")


@query("H14", f"""WITH {CH} SELECT asset, seq, CASE WHEN prev_verdict IS NULL THEN 'first' ELSE 'changed' END AS kind, CASE WHEN prev_verdict IS NULL THEN 'new' WHEN {tier('verdict')}<{tier('prev_verdict')} THEN 'up' WHEN {tier('verdict')}>{tier('prev_verdict')} THEN 'down' ELSE 'same' END AS direction FROM ch""")
def change_feed(t):
    v, m, a = points(t)
    return H.change_feed(H.verdict_changes(v, a, m)).select("asset", "seq", "kind", "direction")


@query("H05", f"""WITH {EV}, e AS (SELECT 'U'||user_id AS asset, event_id//50 AS snapshot_id, event_type AS metric, event_id AS id FROM ev) SELECT asset, snapshot_id, metric, id FROM e WHERE (asset, snapshot_id) IN (SELECT (asset, max(snapshot_id)) FROM e GROUP BY asset)""")
def latest_evidence(t):
    e = t.event_facts().select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("asset"), F.floor(F.col("event_id") / 50).alias("snapshot_id"),
                               F.col("event_type").alias("metric"), F.col("event_id").alias("id"))
    return H.latest_evidence(e)


@query("H06", f"""WITH {EV}, f AS (SELECT CASE k%4 WHEN 0 THEN 'helius' WHEN 1 THEN 'rugcheck' WHEN 2 THEN 'jupiter' ELSE 'dexscreener' END AS provider, event_type AS kind, 'm'||k AS message, at_ms, event_id AS seq FROM ev)
 SELECT provider, count(*) FILTER (at_ms>={LAST - 3 * DAY}) AS n, max(at_ms) FILTER (at_ms>={LAST - 3 * DAY}) AS last_at, arg_max(kind,(at_ms,seq)) AS last_kind, arg_max(message,(at_ms,seq)) AS last_message FROM f GROUP BY 1 HAVING count(*) FILTER (at_ms>={LAST - 3 * DAY})>0""")
def provider_failure_summary(t):
    k = F.col("k")
    prov = F.when(k % 4 == 0, "helius").when(k % 4 == 1, "rugcheck").when(k % 4 == 2, "jupiter").otherwise("dexscreener")
    f = t.event_facts().select(prov.alias("provider"), F.col("event_type").alias("kind"), F.concat(F.lit("m"), k.cast("string")).alias("message"), "at", F.col("event_id").alias("seq"))
    return H.provider_failure_summary(f, LAST - 3 * DAY)


@query("H07", f"""WITH {VD}, l AS (SELECT asset, max((observed_at, seq)) AS m FROM vd GROUP BY 1) SELECT vd.asset, vd.observed_at, vd.seq, vd.verdict, vd.score, vd.coverage, CASE WHEN vd.seq%2=0 THEN vd.price END AS price, CASE WHEN vd.seq%2=0 THEN vd.liquidity END AS liquidity
 FROM vd JOIN l ON vd.asset=l.asset AND (vd.observed_at, vd.seq)=l.m""")
def previous_snapshot(t):
    v, m, _ = points(t)
    return H.previous_snapshot(v, m)


@query("H08", f"""WITH {ACT} SELECT count(*) AS transactions, count(*) FILTER (block_time>={LAST}-3600000) AS last_hour, count(*) FILTER (block_time>={LAST}-3600000 AND status='FAILED') AS failed_last_hour,
 count(*) FILTER (kind='SWAP') AS swaps, count(*) FILTER (kind='FAILED') AS failed, max(block_time) AS latest_block_time FROM act""")
def backbone_stats(t):
    return H.backbone_stats(t.activity(), LAST)


@query("H09", f"""WITH {TR} SELECT 'side' AS what, side AS key, count(*) AS n FROM tr GROUP BY 2 UNION ALL SELECT 'quote', quote_asset, count(*) FROM tr GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM act GROUP BY 2""")
def intel_stats(t):
    return H.intel_stats({"side": (t.trades(), "side"), "quote": (t.trades(), "quote_asset"), "kind": (t.activity(), "kind")})


@query("H10", f"""WITH {EV}, d AS (SELECT 'U'||user_id AS asset, CASE WHEN event_type='error' THEN 'chain:x' ELSE event_type END AS source, min(at_ms) AS f FROM ev GROUP BY 1,2),
 g AS (SELECT asset, min(f) FILTER (source LIKE 'chain:%' AND f>={LAST - 29 * DAY}) AS c, min(f) FILTER (source NOT LIKE 'chain:%') AS fd FROM d GROUP BY 1 HAVING c IS NOT NULL AND fd IS NOT NULL),
 l AS (SELECT 'U'||c_custkey AS asset, {LAST - 31 * DAY}+c_custkey*1000 AS lt FROM customer WHERE true), j AS (SELECT fd-c AS lead, fd-lt AS delay FROM g LEFT JOIN l ON g.asset=l.asset)
 SELECT count(*) AS assets, list_sort(list(lead))[count(*)//2+1]::DOUBLE AS median_lead_ms, (list_sort(list(delay) FILTER (delay IS NOT NULL))[count(delay)//2+1])::DOUBLE AS median_feed_delay_ms FROM j""")
def chain_lead(t):
    e = t.event_facts()
    d = e.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("asset"), F.when(F.col("event_type") == "error", "chain:x").otherwise(F.col("event_type")).alias("source")).agg(F.min("at").alias("first_seen_at"))
    l = t.customer.select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("asset"), (F.lit(LAST - 31 * DAY) + F.col("c_custkey") * 1000).alias("launch_time"))
    return H.chain_lead(d, l, LAST - 29 * DAY)


@query("H11", f"WITH {EV} SELECT 'U'||user_id AS asset, max(at_ms) AS at_ms, arg_max(event_type,(at_ms,event_id)) AS status FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def recent_intel(t):
    r = t.event_facts().select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("asset"), "at", F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return H.recent_intel(r, 20).withColumnRenamed("at", "at_ms")


LEDGER = f"""{EV}, lg AS (SELECT 'U'||user_id AS asset, 'm'||(k%14) AS metric, CASE event_type WHEN 'purchase' THEN 'MEASURED' WHEN 'signup' THEN 'CONFLICTED' WHEN 'view' THEN 'STALE' WHEN 'click' THEN 'UNKNOWN' ELSE 'INVALID' END AS state,
  CASE WHEN k%14=13 THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END AS weight, event_id AS id FROM ev)"""


def ledger(t):
    s = F.col("event_type")
    state = F.when(s == "purchase", "MEASURED").when(s == "signup", "CONFLICTED").when(s == "view", "STALE").when(s == "click", "UNKNOWN").otherwise("INVALID")
    return t.event_facts().select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("asset"), F.concat(F.lit("m"), (F.col("k") % 14).cast("string")).alias("metric"),
                                  state.alias("state"), F.when(F.col("k") % 14 == 13, 0.0).otherwise(0.05).alias("weight"), F.col("event_id").alias("id"))


@query("H15", f"WITH {LEDGER} SELECT asset, count(*) FILTER (state IN ('MEASURED','CONFLICTED')) AS measured, count(*) AS signals FROM lg WHERE weight>0 GROUP BY 1")
def signal_counts(t):
    return H.signal_counts(ledger(t))


@query("H15", f"WITH {LEDGER} SELECT asset, metric, state FROM lg WHERE weight>0 AND state NOT IN ('MEASURED','CONFLICTED')")
def unknown_signals(t):
    return H.unknown_signals(ledger(t))


@query("H16", f"""WITH {AS}, w AS (SELECT asset, verdict, liquidity, (seq%100)/100.0::DOUBLE AS coverage, (seq%95)::DOUBLE AS top_holders, CASE seq%3 WHEN 0 THEN 'MEASURED' WHEN 1 THEN 'CONFLICTED' ELSE 'STALE' END AS top_state, seq%5<>0 AS top_audited, seq%3 AS clearable, seq%4 AS permanent, seq%5 AS blockers, CASE WHEN seq%2=0 THEN 'rugHistory' END AS driver FROM ast WHERE verdict IS NOT NULL)
 SELECT asset, unnest(list_filter([CASE WHEN verdict<>'REJECTED' AND liquidity>0 AND liquidity<9000 THEN 'LIQUIDITY_NEAR_FLOOR' END, CASE WHEN verdict IN ('QUALIFIED','HIGH_POTENTIAL') AND coverage<0.6::DOUBLE+0.1::DOUBLE THEN 'COVERAGE_NEAR_WATCH' END, CASE WHEN verdict='WATCH' THEN 'COVERAGE_TO_QUALIFY' END,
  CASE WHEN verdict='INSUFFICIENT_DATA' THEN 'COVERAGE_TO_WATCH' END, CASE WHEN verdict<>'REJECTED' AND top_state IN ('MEASURED','CONFLICTED') AND top_audited AND top_holders>=70 THEN 'CONCENTRATION_NEAR_VETO' END, CASE WHEN verdict='REJECTED' AND clearable>0 THEN 'VETO_CAN_CLEAR' END, CASE WHEN verdict='REJECTED' AND permanent>0 THEN 'VETO_PERMANENT' END,
  CASE WHEN verdict='QUALIFIED' AND blockers>0 THEN 'HIGH_POTENTIAL_NEEDS' END, CASE WHEN verdict='HIGH_RISK' AND driver IS NOT NULL THEN 'RISK_DRIVER' END], lambda x: x IS NOT NULL)) AS note FROM w""")
def watchpoints(t):
    s = F.col("seq")
    a = t.assets().where("verdict IS NOT NULL").withColumns({"coverage": (s % 100) / 100.0, "top_holders": (s % 95).cast("double"),
                                                             "top_state": F.when(s % 3 == 0, "MEASURED").when(s % 3 == 1, "CONFLICTED").otherwise("STALE"), "top_audited": s % 5 != 0, "clearable": s % 3, "permanent": s % 4,
                                                             "blockers": s % 5, "driver": F.when(s % 2 == 0, "rugHistory")})
    return H.watchpoints(a)


@query("H17", f"WITH {ACT}, {VD.replace(EV + ', ', '')} SELECT 'activity' AS tbl, count(*) AS n, min(block_time) AS oldest, max(block_time) AS newest FROM act UNION ALL SELECT 'verdicts', count(*), min(observed_at), max(observed_at) FROM vd")
def table_diagnostics(t):
    return H.table_diagnostics({"activity": t.activity().withColumn("at", F.col("block_time")), "verdicts": t.verdicts().withColumn("at", F.col("observed_at"))})


@query("H18", f"""WITH {LEDGER}, {VD.replace(EV + ', ', '')}, {findings_sql("'U'||user_id")}, a AS (SELECT asset, arg_max(verdict,(observed_at,seq)) AS verdict FROM vd GROUP BY 1), e AS (SELECT asset, count(*) FILTER (state IN ('MEASURED','CONFLICTED')) AS measured, count(*) AS metrics, count(*) FILTER (state='CONFLICTED') AS conflicts FROM lg GROUP BY 1),
 m AS (SELECT asset, arg_max(price, observed_at) AS price, max(observed_at) AS market_at FROM vd WHERE seq%2=0 GROUP BY 1), f AS (SELECT asset, count(*) FILTER (status='CONFIRMED') AS confirmed, count(*) FILTER (status<>'CONFIRMED') AS suspected FROM fnd GROUP BY 1)
 SELECT a.asset, verdict, coalesce(measured,0) AS measured, coalesce(metrics,0) AS metrics, coalesce(conflicts,0) AS conflicts, price, market_at, coalesce(confirmed,0) AS confirmed, coalesce(suspected,0) AS suspected FROM a LEFT JOIN e ON a.asset=e.asset LEFT JOIN m ON a.asset=m.asset LEFT JOIN f ON a.asset=f.asset""")
def dossier(t):
    v, m, _ = points(t)
    a = v.groupBy("asset").agg(F.max_by("verdict", F.struct("observed_at", "seq")).alias("verdict"))
    return H.dossier(a, ledger(t), m, findings(t)).drop("market_liquidity")


def findings(t):
    s = F.col("event_type")
    status = F.when(s == "purchase", "CONFIRMED").when(s == "signup", "STRONGLY_SUSPECTED").otherwise("SUSPICIOUS")
    k = F.col("k")
    return t.event_facts().select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("asset"), F.col("event_id").alias("id"), status.alias("status"),
                                  F.when(k % 4 == 0, "v0").otherwise("v1").alias("rule_version"), F.when(k % 9 == 0, F.col("at")).alias("superseded_at"), F.col("at").alias("revised_at"))


# Live assets with a coverage of their own and the states of four metrics, one without weight.
COVERED = f"""{AS}, {PLACE}, cv AS (SELECT asset, (seq%100)/100.0::DOUBLE AS coverage, score/100 AS confidence, seq FROM pl WHERE universe='LIVE'),
 ml AS (SELECT asset, metric, CASE WHEN metric='audit' THEN 0 ELSE 1 END AS weight, CASE (seq+length(metric))%4 WHEN 0 THEN 'MEASURED' WHEN 1 THEN 'CONFLICTED' WHEN 2 THEN 'UNKNOWN' ELSE 'FAILED' END AS state
  FROM cv, (SELECT unnest(['liquidity','holders','mint','audit']) AS metric) WHERE seq%3<>0)"""


def covered(t):
    return P.place(t.assets(), ASSET_NOW).where(P.is_live()).select("asset", ((F.col("seq") % 100) / 100.0).alias("coverage"), (F.col("score") / 100).alias("confidence"), "seq")


def metric_ledger(t):
    m = covered(t).where("seq % 3 <> 0").select("asset", "seq", F.explode(F.array(*map(F.lit, ("liquidity", "holders", "mint", "audit")))).alias("metric"))
    state = F.element_at(F.array(*map(F.lit, ("MEASURED", "CONFLICTED", "UNKNOWN", "FAILED"))), ((F.col("seq") + F.length("metric")) % 4 + 1).cast("int"))
    return m.select("asset", "metric", F.when(F.col("metric") == "audit", 0).otherwise(1).alias("weight"), state.alias("state"))


@query("H19", f"""WITH {COVERED} SELECT count(*) AS assets, {hu('avg(coverage)', 3)} AS mean_coverage, {hu('avg(confidence)', 3)} AS mean_confidence, count(*) FILTER (coverage<0.35) AS b0,
 count(*) FILTER (coverage>=0.35 AND coverage<0.6) AS b1, count(*) FILTER (coverage>=0.6 AND coverage<0.8) AS b2, count(*) FILTER (coverage>=0.8) AS b3, (SELECT count(DISTINCT asset) FROM ml) AS with_ledger FROM cv""")
def coverage_overview(t):
    return H.coverage_overview(covered(t), metric_ledger(t))


@query("H19", f"WITH {COVERED} SELECT metric, count(*) AS n FROM ml WHERE weight>0 AND state NOT IN ('MEASURED','CONFLICTED') GROUP BY 1")
def unknown_signal_counts(t):
    return H.unknown_signals(metric_ledger(t)).groupBy("metric").agg(F.count("*").alias("n"))


@query("H20", f"""WITH {EV}, {findings_sql("'U'||user_id")} SELECT asset, count(*) FILTER (rv='v1' AND sup IS NULL AND status='CONFIRMED') AS confirmed, count(*) FILTER (rv='v1' AND sup IS NULL AND status<>'CONFIRMED') AS suspected, count(*) FILTER (NOT (rv='v1' AND sup IS NULL)) AS superseded FROM fnd GROUP BY 1""")
def findings_view(t):
    return H.findings_view(findings(t), "v1")


@query("H20", f"""WITH {EV}, {findings_sql("'U'||user_id")}, r AS (SELECT asset, id, row_number() OVER (PARTITION BY asset ORDER BY at_ms DESC, id) AS rank FROM fnd WHERE sup IS NOT NULL) SELECT * FROM r WHERE rank<=5""")
def revision_audit(t):
    return H.revision_audit(findings(t).where("superseded_at IS NOT NULL"), 5).select("asset", "id", F.col("rank").cast("long").alias("rank"))


@query("H22", f"WITH {ACT} SELECT tx_id, wallet, slot, kind FROM act WHERE asset='A3' ORDER BY slot DESC, tx_index DESC LIMIT 200")
def activity_of_asset(t):
    return H.newest_for(t.activity(), F.col("asset") == "A3", 200, F.desc("slot"), F.desc("tx_index")).select("tx_id", "wallet", "slot", "kind")


@query("H22", "SELECT 'T'||o_orderkey AS asset, 'C'||o_custkey AS creator FROM orders WHERE o_custkey=7 ORDER BY o_orderdate DESC, 1 LIMIT 50")
def launches_by_payer(t):
    return H.newest_for(t.launches(), F.col("creator") == "C7", 50, F.desc("launch_time"), F.asc("asset")).select("asset", "creator")


@query("H23", f"""WITH {EV}, s AS (SELECT event_id, at_ms AS st, CASE WHEN event_type<>'error' THEN at_ms+k*1000 END AS fi, k AS an, k%7 AS fr FROM ev)
 SELECT count(fi) AS finished, max(st) FILTER (fi IS NOT NULL) AS last_scan_at, sum(an) FILTER (fi IS NOT NULL)::BIGINT AS analyzed, sum(fr) FILTER (fi IS NOT NULL)::BIGINT AS fresh, sum(fi-st)::BIGINT AS duration_ms FROM s""")
def scan_stats(t):
    e = t.event_facts()
    return H.scan_stats(e.select(F.col("at").alias("started_at"), F.when(F.col("event_type") != "error", F.col("at") + F.col("k") * 1000).alias("finished_at"),
                                 F.col("k").alias("analyzed"), (F.col("k") % 7).alias("fresh")))


# ---- monitoring ------------------------------------------------------------------------

PV = f"""{VD}, pv AS (SELECT *, lag(verdict) OVER w AS pverdict, lag(score) OVER w AS pscore, lag(price) OVER w AS pprice, lag(liquidity) OVER w AS pliq, lag(seq) OVER w AS pseq FROM vd WINDOW w AS (PARTITION BY asset ORDER BY observed_at, seq))"""
M01 = """SELECT asset, observed_at, seq, CASE WHEN c='REJECTED' THEN 'risk_flag' ELSE 'discovered' END AS alert, CASE c WHEN 'REJECTED' THEN 'critical' WHEN 'TRACKING' THEN 'info' ELSE 'medium' END AS level, c AS code FROM (
 SELECT *, CASE WHEN verdict='REJECTED' THEN 'REJECTED' WHEN verdict='HIGH_POTENTIAL' THEN 'HIGH_POTENTIAL' WHEN score>=70 AND coverage>=0.6 AND verdict='QUALIFIED' THEN 'WELL_EVIDENCED' WHEN score>=50 THEN 'TRACKING' END AS c FROM pv WHERE pseq IS NULL) WHERE c IS NOT NULL"""
M02 = "SELECT asset, observed_at, seq, CASE WHEN score-pscore>=8 THEN 'score_up' ELSE 'score_down' END AS alert, CASE WHEN score-pscore>=8 THEN 'info' ELSE 'medium' END AS level, 'SCORE' AS code FROM pv WHERE abs(score-pscore)>=8"
M03 = "SELECT asset, observed_at, seq, 'liquidity_drop' AS alert, CASE WHEN (1-liquidity/pliq)*100>=80 THEN 'critical' ELSE 'high' END AS level, 'LIQUIDITY' AS code FROM pv WHERE pliq>=5000 AND liquidity<pliq*0.6::DOUBLE"
M04 = "SELECT asset, observed_at, seq, 'price_spike' AS alert, CASE WHEN price>pprice THEN 'info' ELSE 'medium' END AS level, 'PRICE' AS code FROM pv WHERE pprice>0 AND abs((price/pprice-1)*100)>=30"
M05 = f"""SELECT asset, observed_at, seq, CASE WHEN verdict IN ('REJECTED','HIGH_RISK') THEN 'risk_flag' WHEN {tier('verdict')}<{tier('pverdict')} THEN 'score_up' ELSE 'score_down' END AS alert,
 CASE verdict WHEN 'REJECTED' THEN 'critical' WHEN 'HIGH_RISK' THEN 'high' WHEN 'HIGH_POTENTIAL' THEN 'medium' ELSE 'info' END AS level, 'STATE' AS code FROM pv WHERE verdict<>pverdict"""


def prev(t):
    return M.with_previous(t.verdicts())


@query("M01", f"WITH {PV} {M01}")
def first_sight_alerts(t):
    return M.first_alerts(prev(t))


@query("M02", f"WITH {PV} {M02}")
def score_move_alerts(t):
    return M.score_moves(prev(t))


@query("M03", f"WITH {PV} {M03}")
def liquidity_drop_alerts(t):
    return M.liquidity_drops(prev(t))


@query("M04", f"WITH {PV} {M04}")
def price_spike_alerts(t):
    return M.price_spikes(prev(t))


@query("M05", f"WITH {PV} {M05}")
def state_change_alerts(t):
    return M.state_changes(prev(t))


@query("M01 M02 M03 M04 M05", f"WITH {PV} {M01} UNION ALL {M02} UNION ALL {M03} UNION ALL {M04} UNION ALL {M05}")
def all_alerts(t):
    return M.alerts(t.verdicts())


@query("H21", f"WITH {PV}, u AS ({M01} UNION ALL {M02} UNION ALL {M03} UNION ALL {M04} UNION ALL {M05}) SELECT * FROM u ORDER BY observed_at DESC, seq DESC, alert, code LIMIT 100")
def newest_alerts(t):
    return H.recent_events(M.alerts(t.verdicts()), 100)


@query("M06", f"""WITH {VD}, f AS (SELECT asset, observed_at, seq, 'flag'||(seq%5) AS c1, 'flag'||(seq%3) AS c2 FROM vd), p AS (SELECT *, lag(c1) OVER w AS p1, lag(c2) OVER w AS p2 FROM f WINDOW w AS (PARTITION BY asset ORDER BY observed_at, seq))
 SELECT asset, observed_at, seq, 'risk_flag' AS alert, 'high' AS level, c1 AS code FROM p WHERE p1 IS NOT NULL AND c1<>p1 AND c1<>p2 UNION ALL SELECT asset, observed_at, seq, 'risk_flag', 'critical', c2 FROM p WHERE seq%2=0 AND p1 IS NOT NULL AND c2<>p1 AND c2<>p2""")
def new_flag_alerts(t):
    s = F.col("seq")
    fl = F.array(F.struct(F.concat(F.lit("flag"), (s % 5).cast("string")).alias("code"), F.lit("high").alias("level")),
                 F.struct(F.concat(F.lit("flag"), (s % 3).cast("string")).alias("code"), F.when(s % 2 == 0, "critical").otherwise("low").alias("level")))
    return M.new_flags(M.with_previous(t.verdicts().withColumn("flags", fl)))


# ---- folds and calibration -------------------------------------------------------------


def stable_sql(hold: str) -> str:
    """The confirmation fold, one reading of every asset per recursion step; defines ``sv``."""
    fresh = f"o.observed_at-r.observed_at>{hold}" if hold else "false"
    keep = f"({fresh}) OR o.tier>=r.cur"
    count = "CASE WHEN r.n>0 AND o.observed_at=r.observed_at THEN r.n ELSE r.n+1 END"  # the same instant again is no confirmation
    done = f"{count}>=2"
    return f"""{VD}, so AS (SELECT *, {tier('verdict')} AS tier, row_number() OVER (PARTITION BY asset ORDER BY observed_at, seq) AS rn FROM vd),
 rc AS (SELECT asset, rn, observed_at, seq, verdict, tier AS cur, -1 AS pend, 0 AS n FROM so WHERE rn=1 UNION ALL SELECT o.asset, o.rn, o.observed_at, o.seq, o.verdict, CASE WHEN {keep} THEN o.tier WHEN {done} THEN greatest(r.pend,o.tier) ELSE r.cur END,
  CASE WHEN {keep} OR {done} THEN -1 ELSE greatest(r.pend,o.tier) END, CASE WHEN {keep} OR {done} THEN 0 ELSE {count} END FROM rc r JOIN so o ON o.asset=r.asset AND o.rn=r.rn+1),
 sv AS (SELECT asset, observed_at, seq, verdict, CASE cur WHEN 0 THEN 'HIGH_POTENTIAL' WHEN 1 THEN 'QUALIFIED' WHEN 2 THEN 'WATCH' WHEN 3 THEN 'INSUFFICIENT_DATA' WHEN 4 THEN 'HIGH_RISK' ELSE 'REJECTED' END AS stable FROM rc)"""


STABLE_SQL = f"WITH RECURSIVE {stable_sql('3600000')} SELECT * FROM sv"


def rel(a: str, b: str) -> str:
    return f"coalesce(CASE WHEN {a} IS NULL THEN NULL WHEN {b}=0 THEN CASE WHEN {a}=0 THEN 0 ELSE 1 END ELSE abs({a}-{b})/abs({b}) END>=0.02, false)"


BIG = f"abs(o.score-r.ls)>=1 OR coalesce(abs(o.coverage-r.lc)>=0.05,false) OR {rel('o.price', 'r.lp')} OR {rel('o.liquidity', 'r.ll')} OR {rel('o.price*10', 'r.lv')}"
WHY = f"CASE WHEN o.verdict<>r.lvd THEN 'transition' WHEN {BIG} THEN 'material-change' WHEN o.observed_at-r.lt>=1800000 THEN 'heartbeat' END"
THIN_SQL = f"""WITH RECURSIVE {VD}, to_ AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY observed_at, seq) AS rn FROM vd),
 rt AS (SELECT asset, rn, observed_at, seq, verdict, 'first' AS reason, observed_at AS lt, verdict AS lvd, score AS ls, coverage AS lc, price AS lp, liquidity AS ll, price*10 AS lv FROM to_ WHERE rn=1
  UNION ALL SELECT o.asset, o.rn, o.observed_at, o.seq, o.verdict, {WHY}, {', '.join(f"CASE WHEN {WHY} IS NOT NULL THEN {n} ELSE r.{k} END" for n, k in (('o.observed_at', 'lt'), ('o.verdict', 'lvd'), ('o.score', 'ls'), ('o.coverage', 'lc'), ('o.price', 'lp'), ('o.liquidity', 'll'), ('o.price*10', 'lv')))}
  FROM rt r JOIN to_ o ON o.asset=r.asset AND o.rn=r.rn+1) SELECT asset, observed_at, seq, verdict, reason FROM rt WHERE reason IS NOT NULL"""


@query("S23", THIN_SQL)
def thinned_history(t):
    return FO.thin_snapshots(t.verdicts().withColumn("volume24h", F.col("price") * 10)).select("asset", "observed_at", "seq", "verdict", "reason")


STATE = "CASE seq%11 WHEN 0 THEN 'SETTLED' WHEN 5 THEN 'OPEN' WHEN 7 THEN NULL ELSE 'OPEN' END"
STATE_THIN_SQL = THIN_SQL.replace("to_ AS (SELECT *,", f"to_ AS (SELECT *, {STATE} AS state,").replace("price*10 AS lv FROM to_", "price*10 AS lv, state AS lst FROM to_").replace("o.verdict<>r.lvd", "o.verdict<>r.lvd OR o.state IS DISTINCT FROM r.lst").replace(
    "\n  FROM rt r JOIN", f", CASE WHEN {WHY.replace('o.verdict<>r.lvd', 'o.verdict<>r.lvd OR o.state IS DISTINCT FROM r.lst')} IS NOT NULL THEN o.state ELSE r.lst END\n  FROM rt r JOIN")


@query("S23", STATE_THIN_SQL)
def thinned_with_state(t):
    s = F.col("seq") % 11
    v = t.verdicts().withColumns({"volume24h": F.col("price") * 10, "state": F.when(s == 0, "SETTLED").when(s != 7, "OPEN")})
    return FO.thin_snapshots(v).select("asset", "observed_at", "seq", "verdict", "reason")


@query("D17", STABLE_SQL)
def stable_verdicts(t):
    return FO.stabilize(t.verdicts())


@query("C07", f"""WITH RECURSIVE {stable_sql('')}, l AS (SELECT asset, verdict, stable, lag(verdict) OVER w AS v1, lag(verdict,2) OVER w AS v2, lag(stable) OVER w AS s1, lag(stable,2) OVER w AS s2 FROM sv WINDOW w AS (PARTITION BY asset ORDER BY observed_at, seq))
 SELECT asset, count(*) FILTER (verdict<>v1) AS raw, count(*) FILTER (verdict<>v1 AND verdict=v2) AS reversals, count(*) FILTER (stable<>s1) AS stable, count(*) FILTER (stable<>s1 AND stable=s2) AS stable_reversals FROM l GROUP BY 1""")
def stability_replay(t):
    return C.replay_stability(t.verdicts(), 2)


DP = f"""{VD}, dp0 AS (SELECT *, lag(verdict) OVER (PARTITION BY asset ORDER BY observed_at, seq) AS pvd FROM vd), dp AS (SELECT * FROM dp0 WHERE pvd IS NULL OR pvd<>verdict)"""


@query("C01", f"WITH {DP} SELECT asset, observed_at, seq, verdict, pvd AS prev_verdict FROM dp")
def decision_points(t):
    return C.decision_points(t.verdicts()).select("asset", "observed_at", "seq", "verdict", "prev_verdict")


OBS = f"""{DP}, ob AS (SELECT asset, observed_at+(seq%7-3)*100000 AS t, CASE WHEN seq%11<>0 THEN liquidity END AS liquidity, CASE WHEN seq%13<>0 THEN 'P'||(seq%2) END AS pool FROM vd),
 nr AS (SELECT dp.asset, dp.observed_at, dp.seq, dp.verdict, arg_min(struct_pack(t:=t, l:=ob.liquidity, p:=ob.pool), (abs(t-dp.observed_at), t, coalesce(ob.pool,''))) AS n FROM dp JOIN ob ON ob.asset=dp.asset AND abs(t-dp.observed_at)<=600000 GROUP BY 1,2,3,4),
 no AS (SELECT dp.asset, dp.observed_at, dp.seq, dp.verdict, n.t AS obs_at, n.l AS obs_liquidity, n.p AS obs_pool FROM dp LEFT JOIN nr ON nr.asset=dp.asset AND nr.seq=dp.seq)"""


def observations(t):
    s = F.col("seq")
    return t.verdicts().select("asset", (F.col("observed_at") + (s % 7 - 3) * 100_000).alias("observed_at"), F.when(s % 11 != 0, F.col("liquidity")).alias("liquidity"),
                               F.when(s % 13 != 0, F.concat(F.lit("P"), (s % 2).cast("string"))).alias("pool"))


def near(t):
    return C.nearest_observation(C.decision_points(t.verdicts()), observations(t))


@query("C02", f"WITH {OBS} SELECT asset, observed_at, seq, obs_at, obs_liquidity, obs_pool FROM no")
def nearest_observation(t):
    return near(t).select("asset", "observed_at", "seq", "obs_at", "obs_liquidity", "obs_pool")


def outcome_sql(h: int) -> str:
    return f"""{OBS}, ce AS (SELECT asset, observed_at AS t, CASE seq%3 WHEN 0 THEN 'LIQUIDITY_DRAIN' WHEN 1 THEN 'SUPPLY_EXPANSION' ELSE 'FREEZE_ABUSE' END AS type FROM vd WHERE seq%97=0),
 e1 AS (SELECT no.asset, no.seq, arg_min(type, (t, type)) AS ev FROM no JOIN ce ON ce.asset=no.asset AND t>no.observed_at AND t<=no.observed_at+{h} GROUP BY 1,2),
 o1 AS (SELECT no.asset, no.seq, min(ob.liquidity) AS low, max(ob.t) AS last FROM no JOIN ob ON ob.asset=no.asset AND ob.liquidity IS NOT NULL AND ob.t>no.observed_at AND ob.t<=no.observed_at+{h} AND (no.obs_pool IS NULL OR ob.pool=no.obs_pool) GROUP BY 1,2),
 lb AS (SELECT no.*, CASE WHEN ev='LIQUIDITY_DRAIN' THEN 'CONFIRMED_DRAIN' WHEN ev IS NOT NULL THEN 'CONFIRMED_ABUSE' WHEN obs_liquidity IS NULL OR obs_liquidity<1000 OR last IS NULL THEN 'NOT_OBSERVED' WHEN low<=obs_liquidity*0.2::DOUBLE THEN 'LIQUIDITY_COLLAPSE'
  WHEN last-no.observed_at>={h}*0.9::DOUBLE AND low/obs_liquidity>=0.5 THEN 'SUSTAINED_LIQUIDITY' WHEN last-no.observed_at>={h}*0.9::DOUBLE THEN 'LIQUIDITY_DECLINED' WHEN last-no.observed_at>={h}*0.5::DOUBLE THEN 'SURVIVED_PART_OF_WINDOW' ELSE 'NOT_OBSERVED' END AS label
  FROM no LEFT JOIN e1 ON e1.asset=no.asset AND e1.seq=no.seq LEFT JOIN o1 ON o1.asset=no.asset AND o1.seq=no.seq),
 lc AS (SELECT *, CASE label WHEN 'NOT_OBSERVED' THEN 'UNKNOWN' WHEN 'SURVIVED_PART_OF_WINDOW' THEN 'PROXY' ELSE 'MEASURED' END AS class FROM lb)"""


def labelled(t, h):
    s = F.col("seq")
    ev = t.verdicts().where("seq % 97 = 0").select("asset", F.col("observed_at").alias("at"), F.when(s % 3 == 0, "LIQUIDITY_DRAIN").when(s % 3 == 1, "SUPPLY_EXPANSION").otherwise("FREEZE_ABUSE").alias("type"))
    return C.label_outcomes(near(t), observations(t), ev, h)


@query("C03", f"WITH {outcome_sql(DAY)} SELECT asset, observed_at, seq, label, class FROM lc")
def outcomes_24h(t):
    return labelled(t, DAY).select("asset", "observed_at", "seq", "label", "class")


@query("C03", f"WITH {outcome_sql(DAY // 4)} SELECT asset, observed_at, seq, label, class FROM lc")
def outcomes_6h(t):
    return labelled(t, DAY // 4).select("asset", "observed_at", "seq", "label", "class")


@query("C04", f"WITH {outcome_sql(DAY)} SELECT CASE WHEN seq%6=0 THEN 'phase-1' ELSE 'decision@1' END AS policy, verdict, label, class, count(*) AS n FROM lc GROUP BY 1,2,3,4")
def outcome_tables(t):
    return C.outcome_tables(labelled(t, DAY).withColumn("policy", F.when(F.col("seq") % 6 == 0, "phase-1").otherwise("decision@1")))


@query("C04", f"WITH {outcome_sql(DAY)}, v AS (SELECT label, unnest(CASE WHEN seq%3=0 THEN ['UNTRADEABLE','LIQUIDITY_TOO_LOW'] ELSE ['(none recorded)'] END) AS veto FROM lc WHERE verdict='REJECTED') SELECT veto, label, count(*) AS n FROM v GROUP BY 1,2")
def outcomes_by_veto(t):
    x = labelled(t, DAY).where("verdict = 'REJECTED'").withColumn("vetoes", F.when(F.col("seq") % 3 == 0, F.array(F.lit("UNTRADEABLE"), F.lit("LIQUIDITY_TOO_LOW"))).otherwise(F.array(F.lit("(none recorded)"))))
    return C.outcomes_by_veto(x)


@query("C05", f"""WITH {outcome_sql(DAY)} SELECT asset, observed_at, seq, verdict, label, (SELECT min(v.observed_at) FROM vd v WHERE v.asset=lc.asset AND v.verdict='REJECTED' AND v.observed_at>lc.observed_at) AS rejected_at,
 (SELECT min(v.observed_at) FROM vd v WHERE v.asset=lc.asset AND v.verdict='REJECTED' AND v.observed_at>lc.observed_at)-observed_at AS after_ms FROM lc WHERE verdict NOT IN ('REJECTED','HIGH_RISK') AND label IN ('CONFIRMED_DRAIN','CONFIRMED_ABUSE','LIQUIDITY_COLLAPSE')""")
def escapes(t):
    return C.escapes(labelled(t, DAY), t.verdicts(), width=3 * DAY)


@query("C06", f"WITH {VD}, l AS (SELECT asset, verdict, lag(verdict) OVER w AS p1, lag(verdict,2) OVER w AS p2 FROM vd WINDOW w AS (PARTITION BY asset ORDER BY observed_at, seq)) SELECT asset, count(*) FILTER (verdict<>p1) AS changes, count(*) FILTER (verdict<>p1 AND verdict=p2) AS reversals FROM l GROUP BY 1")
def verdict_reversals(t):
    return C.raw_reversals(t.verdicts())


CODES = ["AUTOMATION", "WASH_ELEVATED", "WASH_HIGH", "CREATOR_SUSPICIOUS", "CREATOR_MALICIOUS", "NETWORK_MODERATE", "NETWORK_STRONG"]
FAMILIES = ["EXTREME_MARKET_MANIPULATION", "STRONG_SERIAL_RUGGER", "CONFIRMED_CURRENT_RUG"]
AUDITED = f"""{AS}, d AS (SELECT verdict, seq, (seq%10)/10.0::DOUBLE AS market_coverage, (seq%9)/10.0::DOUBLE AS intel_coverage, seq%3 AS n_fails, CASE WHEN seq%4<>0 THEN at_ms END AS analyzed_at,
  CASE WHEN seq%4=0 THEN 'opportunity '||(seq%90)||' (needs 65)' END AS blocker, {CODES!r}[1+seq%7] AS code, seq%5=0 AS disputed, seq%10=0 AS corroborated, {FAMILIES!r}[1+seq%3] AS family,
  seq%21=0 AS automation_alone, CASE seq%3 WHEN 0 THEN 'RISING' WHEN 1 THEN 'FLAT' ELSE 'INSUFFICIENT_HISTORY' END AS momentum FROM ast WHERE verdict IS NOT NULL)"""


@query("C08", f"""WITH {AUDITED}, r AS (SELECT 'verdict' AS what, verdict AS key FROM d UNION ALL SELECT 'invariant', 'high_potential_under_covered' FROM d WHERE verdict='HIGH_POTENTIAL' AND (market_coverage<0.7 OR intel_coverage<0.5)
 UNION ALL SELECT 'invariant', 'rejected_without_hard_fail' FROM d WHERE verdict='REJECTED' AND n_fails=0 UNION ALL SELECT 'invariant', 'qualified_unanalysed' FROM d WHERE verdict='QUALIFIED' AND analyzed_at IS NULL
 UNION ALL SELECT 'code', code FROM d UNION ALL SELECT 'automation', verdict FROM d WHERE code='AUTOMATION' UNION ALL SELECT 'automation_alone', 'HIGH_RISK' FROM d WHERE code='AUTOMATION' AND verdict='HIGH_RISK' AND automation_alone
 UNION ALL SELECT 'disputed', verdict FROM d WHERE disputed UNION ALL SELECT 'corroborated', verdict FROM d WHERE disputed AND corroborated UNION ALL SELECT 'family', family FROM d WHERE n_fails>0
 UNION ALL SELECT 'momentum', momentum FROM d UNION ALL SELECT 'blocker', 'opportunity #' FROM d WHERE verdict='QUALIFIED' AND blocker IS NOT NULL)
 SELECT what, key, count(*) AS n FROM r GROUP BY 1,2""")
def current_audit(t):
    s = F.col("seq")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (s % k + 1).cast("int"))
    d = t.assets().where("verdict IS NOT NULL").select(
        "verdict", ((s % 10) / 10.0).alias("market_coverage"), ((s % 9) / 10.0).alias("intel_coverage"), (s % 3).alias("n_fails"), F.when(s % 4 != 0, F.col("at")).alias("analyzed_at"),
        F.array(F.when(s % 4 == 0, F.concat(F.lit("opportunity "), (s % 90).cast("string"), F.lit(" (needs 65)")))).alias("blockers"), F.array(pick(CODES, 7)).alias("codes"),
        (s % 5 == 0).alias("disputed"), (s % 10 == 0).alias("corroborated"), F.when(s % 3 > 0, F.array(pick(FAMILIES, 3))).alias("families"), (s % 21 == 0).alias("automation_alone"),
        pick(("RISING", "FLAT", "INSUFFICIENT_HISTORY"), 3).alias("momentum"))
    return C.current_audit(d)


@query("C09", f"WITH {VD} SELECT min(observed_at) AS first_at, max(observed_at) AS last_at, count(*) AS rows, count(DISTINCT asset) AS assets FROM vd")
def history_span(t):
    return C.history_span(t.verdicts())
