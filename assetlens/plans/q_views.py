"""Queries of the reporting views, whole rows rather than counts."""

from pyspark.sql import functions as F

from assetlens.operators import views as V
from assetlens.operators.history import range_scan
from assetlens.plans.q_decide import INTEL, VERDICT, decided, intel
from assetlens.plans.q_history import LAST, LEDGER, findings, ledger
from assetlens.plans.q_tables import findings_sql
from assetlens.plans.registry import query
from assetlens.plans.sqltext import ACT, AS, EV, LA, MK, VD, half_up as hu

DAY, HOUR = 86_400_000, 3_600_000
FROM, TO = 788_918_400_000, 883_612_800_000  # 1995 to 1998


@query("H02", f"WITH {MK} SELECT asset, observed_at, holders FROM mk WHERE asset='T7' AND observed_at BETWEEN {FROM} AND {TO} ORDER BY observed_at LIMIT 40")
def holder_range(t):
    return range_scan(t.market().select("asset", "observed_at", "holders"), "T7", FROM, TO, 40)


def _total(what: str, src: str, skipped: str = "NULL::BIGINT") -> str:
    skip = f"sum({skipped}) FILTER (at_ms>={LAST - DAY})" if skipped != "NULL::BIGINT" else skipped
    return f"SELECT '{what}' AS what, count(*) AS total, count(*) FILTER (at_ms>={LAST - HOUR}) AS last_hour, count(*) FILTER (at_ms>={LAST - DAY}) AS last_day, {skip}::BIGINT AS skipped_last_day, max(at_ms) AS latest FROM ({src})"


@query("H08", f"""WITH {ACT}, {LA} {_total('launches', 'SELECT launch_time AS at_ms FROM la')} UNION ALL {_total('wallets', 'SELECT min(block_time) AS at_ms FROM act GROUP BY wallet')}
 UNION ALL {_total('edges', 'SELECT epoch_us(l_shipdate)//1000 AS at_ms FROM lineitem')} UNION ALL {_total('chain_events', 'SELECT at_ms FROM ev')} UNION ALL {_total('discoveries', 'SELECT min(at_ms) AS at_ms FROM ev GROUP BY user_id, event_type')}
 UNION ALL {_total('gaps', "SELECT at_ms, k FROM ev WHERE event_type='error'", 'k')}""")
def backbone_totals(t):
    e = t.event_facts()
    return V.backbone_totals({
        "launches": t.launches().select(F.col("launch_time").alias("at")), "wallets": t.activity().groupBy("wallet").agg(F.min("block_time").alias("at")), "edges": t.supplier_transfers().select("at"),
        "chain_events": e.select("at"), "discoveries": e.groupBy("user_id", "event_type").agg(F.min("at").alias("at")), "gaps": e.where("event_type = 'error'").select("at", F.col("k").alias("skipped"))}, LAST)


_N = "SELECT asset, {n} AS note, ({v})::DOUBLE AS value, ({t})::DOUBLE AS threshold, ({o})::DOUBLE AS other_threshold, {d} AS detail FROM w WHERE {c}"


def _note(name: str, cond: str, value: str = "NULL", threshold: str = "NULL", other: str = "NULL", detail: str = "NULL::VARCHAR") -> str:
    return _N.format(n=f"'{name}'", c=cond, v=value, t=threshold, o=other, d=detail)


@query("H16", f"""WITH {AS}, w AS (SELECT asset, verdict, liquidity, (seq%100)/100.0::DOUBLE AS coverage, (seq%95)::DOUBLE AS top_holders, CASE seq%3 WHEN 0 THEN 'MEASURED' WHEN 1 THEN 'CONFLICTED' ELSE 'STALE' END AS top_state, seq%5<>0 AS audited, seq%3 AS clearable, seq%4 AS permanent,
  list_filter([CASE WHEN seq%2=0 THEN 'opportunity' END, CASE WHEN seq%3=0 THEN 'momentum' END, CASE WHEN seq%5=0 THEN 'coverage' END, CASE WHEN seq%6=0 THEN 'integrity' END], lambda x: x IS NOT NULL) AS needs, CASE WHEN seq%2=0 THEN 'rugHistory' END AS driver FROM ast WHERE verdict IS NOT NULL),
 n AS ({_note('LIQUIDITY_NEAR_FLOOR', "verdict<>'REJECTED' AND liquidity>0 AND liquidity<9000", 'liquidity', '3000')} UNION ALL {_note('COVERAGE_NEAR_WATCH', "verdict IN ('QUALIFIED','HIGH_POTENTIAL') AND coverage<0.6::DOUBLE+0.1::DOUBLE", 'coverage', '0.6')}
  UNION ALL {_note('COVERAGE_TO_QUALIFY', "verdict='WATCH'", 'coverage', '0.6', '0.35')} UNION ALL {_note('COVERAGE_TO_WATCH', "verdict='INSUFFICIENT_DATA'", 'coverage', '0.35', '0.6')}
  UNION ALL {_note('CONCENTRATION_NEAR_VETO', "verdict<>'REJECTED' AND top_state IN ('MEASURED','CONFLICTED') AND audited AND top_holders>=70", 'top_holders', '90')}
  UNION ALL {_note('VETO_CAN_CLEAR', "verdict='REJECTED' AND clearable>0", 'clearable')} UNION ALL {_note('VETO_PERMANENT', "verdict='REJECTED' AND permanent>0", 'permanent')}
  UNION ALL {_note('HIGH_POTENTIAL_NEEDS', "verdict='QUALIFIED' AND len(needs)>0", 'len(needs)', detail="array_to_string(needs[1:3], '; ')")} UNION ALL {_note('RISK_DRIVER', "verdict='HIGH_RISK' AND driver IS NOT NULL", detail='driver')})
 SELECT *, value-threshold AS distance FROM n""")
def watchpoint_distances(t):
    s = F.col("seq")
    needs = F.array_compact(F.array(F.when(s % 2 == 0, "opportunity"), F.when(s % 3 == 0, "momentum"), F.when(s % 5 == 0, "coverage"), F.when(s % 6 == 0, "integrity")))
    a = t.assets().where("verdict IS NOT NULL").withColumns({
        "coverage": (s % 100) / 100.0, "top_holders": (s % 95).cast("double"), "top_state": F.when(s % 3 == 0, "MEASURED").when(s % 3 == 1, "CONFLICTED").otherwise("STALE"), "top_audited": s % 5 != 0,
        "clearable": s % 3, "permanent": s % 4, "needs": needs, "driver": F.when(s % 2 == 0, "rugHistory")})
    return V.watchpoint_distances(a)


@query("H18", f"""WITH {LEDGER}, {VD.replace(EV + ', ', '')}, {findings_sql("'U'||user_id")}, a AS (SELECT DISTINCT asset FROM vd),
 e1 AS (SELECT asset, metric, arg_max(state, id) AS state FROM lg GROUP BY 1,2), e AS (SELECT asset, string_agg(metric||'='||state, ',' ORDER BY metric) AS evidence FROM e1 GROUP BY 1),
 m AS (SELECT asset, arg_max(price, observed_at) AS price, max(observed_at) AS market_at FROM vd WHERE seq%2=0 GROUP BY 1), h AS (SELECT asset, arg_max(seq%1000, observed_at) AS holders FROM vd WHERE seq%3=0 GROUP BY 1),
 d AS (SELECT asset, arg_max(verdict, (observed_at, seq)) AS verdict, arg_max(score, (observed_at, seq)) AS score FROM vd GROUP BY 1), i AS (SELECT asset, arg_max(verdict, (observed_at, seq)) AS intelligence FROM vd WHERE seq%5=0 GROUP BY 1),
 f AS (SELECT asset, string_agg(id||':'||status||':'||rv, ',' ORDER BY n) AS findings FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY at_ms DESC, id) AS n FROM fnd WHERE sup IS NULL) WHERE n<=5 GROUP BY 1),
 r AS (SELECT asset, string_agg(id||':'||status, ',' ORDER BY n) AS revisions FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY sup DESC, id) AS n FROM fnd WHERE sup IS NOT NULL) WHERE n<=5 GROUP BY 1)
 SELECT a.asset, evidence, price, market_at, holders, verdict, score, intelligence, findings, revisions FROM a LEFT JOIN e ON e.asset=a.asset LEFT JOIN m ON m.asset=a.asset LEFT JOIN h ON h.asset=a.asset LEFT JOIN d ON d.asset=a.asset LEFT JOIN i ON i.asset=a.asset LEFT JOIN f ON f.asset=a.asset LEFT JOIN r ON r.asset=a.asset""")
def dossier_rows(t):
    v = t.verdicts()
    d = V.dossier_rows(v.select("asset").distinct(), ledger(t), v.where("seq % 2 = 0"), v.where("seq % 3 = 0").withColumn("holders", F.col("seq") % 1000), v,
                       v.where("seq % 5 = 0").select("asset", F.col("verdict").alias("status"), F.col("observed_at").alias("at"), "seq"), findings(t))
    join = lambda c, f: F.array_join(F.transform(c, f), ",")
    return d.select(
        "asset", join("evidence", lambda x: F.concat(x["metric"], F.lit("="), x["state"])).alias("evidence"), "market.price", F.col("market.observed_at").alias("market_at"), "holders.holders", "decision.verdict", "decision.score",
        F.col("intelligence.status").alias("intelligence"), join("findings", lambda x: F.concat_ws(":", x["id"].cast("string"), x["status"], x["rule_version"])).alias("findings"), join("revisions", lambda x: F.concat_ws(":", x["id"].cast("string"), x["status"])).alias("revisions"))


@query("H20", f"""WITH {EV}, {findings_sql("'U'||user_id")} SELECT asset, CASE WHEN rv<>'v1' OR sup IS NOT NULL THEN 'superseded' WHEN status='CONFIRMED' THEN 'confirmed' ELSE 'suspected' END AS section, id, status, rv AS rule_version, at_ms AS revised_at FROM fnd""")
def finding_rows(t):
    return V.finding_rows(findings(t), "v1")


@query("H20", f"""WITH {INTEL} SELECT asset, CASE WHEN coalesce(ev_authority='CONFIRMED',false) OR coalesce(ev_drain='CONFIRMED',false) OR coalesce(ev_dump='CONFIRMED',false) OR coalesce(ev_supply='CONFIRMED',false) OR coalesce(ev_freeze='CONFIRMED',false) THEN 'CONFIRMED_EVENT'
  WHEN coalesce(ev_authority, ev_drain, ev_dump, ev_supply, ev_freeze) IS NOT NULL THEN 'SUSPECTED_EVENTS' WHEN security_status IN ('AVAILABLE','PARTIAL') THEN 'NONE_FOUND' ELSE 'NOT_ANALYSED' END AS token_status, {hu('(security_coverage+creator_coverage+network_coverage)/3', 3)} AS coverage, creator_level, network_level,
  array_to_string(list_filter([CASE WHEN mint_history IS DISTINCT FROM 'COMPLETE' THEN 'PARTIAL_MINT_HISTORY' END, CASE WHEN creator_status IS DISTINCT FROM 'AVAILABLE' OR creator_level='INSUFFICIENT_HISTORY' THEN 'THIN_CREATOR_HISTORY' END, CASE WHEN graph_cut THEN 'GRAPH_CUT' END, CASE WHEN attribution_raw='AMBIGUOUS' THEN 'SEVERAL_SIGNERS' END], lambda x: x IS NOT NULL), ',') AS caveats FROM ic""")
def rug_summary(t):
    return V.rug_summary(intel(t)).withColumn("caveats", F.array_join("caveats", ","))


TRANSITIONS = f"""{VD}, lv AS (SELECT *, lag(verdict) OVER (PARTITION BY asset ORDER BY observed_at, seq) AS before FROM vd), ts AS (SELECT asset, observed_at, seq, before AS from_verdict, verdict AS to_verdict,
  array_to_string(list_filter([CASE WHEN verdict='REJECTED' THEN 'HARD_FAIL' END, CASE WHEN score<50 THEN 'LOW_SCORE' END, CASE WHEN coverage<0.6::DOUBLE THEN 'LOW_COVERAGE' END], lambda x: x IS NOT NULL), ',') AS reasons FROM lv WHERE before IS DISTINCT FROM verdict)"""


def transitions(t):
    from assetlens.functions.skew import lag_across

    c = F.col
    v = lag_across(t.verdicts(), ["asset"], ["observed_at", "seq"], "observed_at", DAY, {"before": "verdict"}).where(~c("before").eqNullSafe(c("verdict")))
    reasons = F.array_compact(F.array(F.when(c("verdict") == "REJECTED", "HARD_FAIL"), F.when(c("score") < 50, "LOW_SCORE"), F.when(c("coverage") < 0.6, "LOW_COVERAGE")))
    return v.select("asset", c("observed_at").alias("at"), "seq", c("before").alias("from_verdict"), c("verdict").alias("to_verdict"), reasons.alias("reasons"))


def _shown(df):
    return df.withColumnRenamed("at", "observed_at").withColumn("reasons", F.array_join("reasons", ","))


@query("H21", f"WITH {TRANSITIONS} SELECT * FROM ts ORDER BY observed_at DESC, seq DESC LIMIT 100")
def stored_transitions(t):
    return _shown(V.verdict_transitions(transitions(t), 100))


@query("H21", f"WITH {TRANSITIONS} SELECT * FROM ts WHERE asset='U7' ORDER BY observed_at DESC, seq DESC LIMIT 25")
def transitions_of_asset(t):
    return _shown(V.verdict_transitions(transitions(t), 25, "U7"))


@query("H22", f"WITH {EV} SELECT event_type AS source, min(at_ms) AS first_seen_at, max(at_ms) AS last_seen_at, count(*) AS times_seen FROM ev WHERE user_id=7 GROUP BY 1")
def discoveries_of(t):
    e = t.event_facts()
    return V.discoveries_of(e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("asset"), F.col("event_type").alias("source"), "at"), "U7")


@query("H22", f"WITH {LA} SELECT * FROM la WHERE launch_time>={FROM} ORDER BY launch_time DESC, asset LIMIT 60")
def recent_launches(t):
    return V.recent_launches(t.launches(), FROM, 60)


@query("H22", f"WITH {ACT} SELECT tx_id, wallet, slot, kind FROM act WHERE asset='A3' AND tx_index%7=0")
def activity_for_ids(t):
    a = t.activity()
    return V.activity_for(a, "A3", a.where("tx_index % 7 = 0")).select("tx_id", "wallet", "slot", "kind")


@query("H22", f"WITH {EV} SELECT event_type AS type, at_ms//60000 AS slot, at_ms AS block_time, 'W'||k AS actor FROM ev WHERE user_id=7")
def events_of_asset(t):
    e = t.event_facts().select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("asset"), F.col("event_type").alias("type"), F.floor(F.col("at") / 60_000).alias("slot"), F.col("at").alias("block_time"), F.concat(F.lit("W"), F.col("k").cast("string")).alias("actor"))
    return V.events_of(e, "U7").drop("asset")


def _pct(x: str) -> str:
    return f"floor(({x})*100.0::DOUBLE+0.5)::INTEGER||'%'"


_LIMITS = " ".join(f"WHEN '{k}' THEN CASE WHEN verdict='WATCH' THEN '{V.QUALIFY}' ELSE '{v}' END" for k, v in V.NEEDS.items()) + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.NEEDS_ONE_OF.items())


@query("D18", f"""WITH {VERDICT}, v0 AS (SELECT vf.* EXCLUDE (bl), vh.verdict, vh.blockers AS bk, s%6<>1 AND mint_conf IS NOT NULL AS mr, s%5<>2 AND freeze_conf IS NOT NULL AS fr FROM vf JOIN vh ON vf.asset=vh.asset),
 x AS (SELECT asset, 1 AS g, r AS o, 'hard_fail' AS kind, code, code AS domain, lower(replace(code,'_',' ')) AS text FROM (SELECT asset, code, row_number() OVER (PARTITION BY asset ORDER BY code) AS r FROM (SELECT DISTINCT asset, code FROM hf)) WHERE r<=3
  UNION ALL SELECT asset, 2, 1, 'positive', 'INDEPENDENT_BUYERS', 'participation', floor(effective+0.5)::BIGINT||' independent participants' FROM v0 WHERE effective>=10 AND oc_participation>=0.9
  UNION ALL SELECT asset, 2, 2, 'positive', 'HEALTHY_LIQUIDITY', 'liquidity', 'healthy liquidity' FROM v0 WHERE o_liquidity>=0.6 UNION ALL SELECT asset, 2, 3, 'positive', 'NO_AUTHORITY_RISK', 'tokenSecurity', 'mint and freeze authority revoked' FROM v0 WHERE mr AND fr AND nf=0
  UNION ALL SELECT asset, 2, 4, 'positive', 'MOMENTUM_'||momentum, 'momentum', lower(momentum)||' momentum' FROM v0 WHERE momentum IN ('SUSTAINED','ACCELERATING') UNION ALL SELECT asset, 2, 5, 'positive', 'CREATOR_CLEAN', 'creatorReputation', 'launches without security events' FROM v0 WHERE creator_u AND creator_level='CLEAN'
  UNION ALL SELECT asset, 2, 6, 'positive', 'WASH_LOW', 'walletCoordination', 'no material wash pattern in a representative sample' FROM v0 WHERE wash_u AND wash_raw='LOW' AND wash_coverage>=0.5
  UNION ALL SELECT asset, 3, r, 'risk', code, domain, lower(replace(code,'_',' '))||', risk '||{_pct('risk')} FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY risk DESC, code, domain) AS r FROM (SELECT DISTINCT asset, domain, code, risk FROM co)) WHERE r<=5
  UNION ALL SELECT asset, 4, 1, 'risk', 'MOMENTUM_'||momentum, 'momentum', lower(momentum)||' price action' FROM v0 WHERE momentum IN ('UNSTABLE','DECLINING')
  UNION ALL SELECT asset, 5, i, 'blocker', 'NOT_HIGHER', NULL, replace(b,'_',' ')||' needs '||CASE b {_LIMITS} END FROM (SELECT asset, verdict, unnest(string_split(bk, ',')) AS b, unnest(range(len(string_split(bk, ',')))) AS i FROM v0 WHERE bk<>'')
  UNION ALL SELECT asset, 6, 1, 'coverage', 'COVERAGE', NULL, 'coverage '||{_pct('0.6::DOUBLE*market_coverage+0.4::DOUBLE*intel_coverage')}||' (market evidence '||{_pct('market_coverage')}||', deep intelligence '||{_pct('intel_coverage')}||')' FROM v0)
 SELECT asset, (row_number() OVER (PARTITION BY asset ORDER BY g, o))::INTEGER AS place, kind, code, domain, text FROM x""")
def reason_rows(t):
    v, contributions, fails = decided(t)
    s = F.col("s")
    return V.reason_rows(v.withColumns({"mint_revoked": (s % 6 != 1) & F.col("mint_conf").isNotNull(), "freeze_revoked": (s % 5 != 2) & F.col("freeze_conf").isNotNull()}), contributions, fails)
