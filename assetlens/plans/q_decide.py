"""Decision queries. The wide input row is derived from every order, by plain SQL expressions
that Spark and the checking engine both read."""

from pyspark.sql import functions as F

from assetlens.functions.durable import cut
from assetlens.functions.skew import dealt
from assetlens.operators import decide as D
from assetlens.operators import place as P
from assetlens.plans.registry import query
from assetlens.plans.sqltext import AS, EV, PLACE, half_up as hu
from assetlens.sources.tables import ASSET_NOW as NOW

H = 3_600_000


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def pick(m: str, *values) -> str:
    """CASE over ``m`` with one value per remainder; None is null."""
    def lit(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else d(v) if isinstance(v, float) else str(v)
    return f"CASE {m} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


ROW = {
    "analyzed_at": f"CASE WHEN s%10=9 THEN NULL WHEN s%50=0 THEN {NOW}-{200 * H} ELSE {NOW}-(s%12)*{H} END", "activity_raw": pick("s%5", "MEASURED", "MEASURED", "PARTIAL", "INSUFFICIENT_DATA", None),
    "trades_classified": d("(s%10)/10"), "representativeness": d("(s%9)/8"), "class_confidence": d("(s%7)/8"), "wash_raw": pick("s%6", "HIGH", "ELEVATED", "LOW", "LOW", "INSUFFICIENT_DATA", None),
    "wash_cov": d("(s%8)/8"), "wash_conf": d("(s%10)/10"), "wallets": "s%13", "wallets_read": "least(s%13, s%7)", "clusters": "s%4", "cluster_conf": d("(7+s%3)/10"),
    "attribution_raw": pick("s%4", "ATTRIBUTED", "ATTRIBUTED", "AMBIGUOUS", "UNKNOWN"), "attribution_conf": pick("s%4", 0.85, 0.6, 0.0, 0.0), "launches": "CASE WHEN s%4<2 THEN s%5 END",
    "other_confirmed": "CASE s%11 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END", "other_suspected": "CASE WHEN s%7=3 THEN 3 ELSE 0 END", "other_suspicious": "CASE WHEN s%8=5 THEN 1 ELSE 0 END",
    "network_raw": pick("s%6", "STRONG", "MODERATE", "NONE", "NONE", "WEAK_ASSOCIATION", "INSUFFICIENT_DATA"), "best_path": pick("s%6", 0.9, 0.55), "best_confirmed": "CASE s%6 WHEN 0 THEN 1+s%4 WHEN 1 THEN 0 END", "graph_cut": "s%9=4",
    "mint_history": pick("s%4", "COMPLETE", "PARTIAL", "UNKNOWN", "NONE"), "active_events": "CASE WHEN s%5=2 THEN 1 ELSE 0 END", "event_conf": d(0.75),
    "ev_authority": "CASE WHEN s%23=1 THEN 'SUSPICIOUS' END", "ev_drain": "CASE s%19 WHEN 2 THEN 'CONFIRMED' WHEN 3 THEN 'STRONGLY_SUSPECTED' WHEN 4 THEN 'SUSPICIOUS' END", "ev_dump": "CASE s%29 WHEN 4 THEN 'STRONGLY_SUSPECTED' WHEN 5 THEN 'SUSPICIOUS' END",
    "ev_supply": "CASE s%31 WHEN 5 THEN 'CONFIRMED' WHEN 6 THEN 'SUSPICIOUS' END", "ev_freeze": "CASE s%37 WHEN 7 THEN 'STRONGLY_SUSPECTED' END",
    "liq": "CASE WHEN s%11<>0 THEN liquidity/20 END", "liq_conf": f"CASE WHEN s%11<>0 THEN {d(0.9)} END", "rug": f"CASE WHEN s%9<>8 THEN {d('s%101')} END", "rug_conf": f"CASE WHEN s%9<>8 THEN {d(0.95)} END",
    "mint_conf": f"CASE WHEN s%8<>7 THEN {d(1.0)} END", "freeze_conf": f"CASE WHEN s%7<>6 THEN {d(0.95)} END", "ext_conf": f"CASE WHEN s%4<>3 THEN {d(1.0)} END", "penalty_extensions": "CASE WHEN s%40=0 THEN 1 ELSE 0 END",
    "token_finding": "CASE s%12 WHEN 1 THEN 'high' WHEN 2 THEN 'medium' END", "lp_finding": "CASE s%14 WHEN 3 THEN 'high' END", "holder_finding": "CASE s%13 WHEN 4 THEN 'medium' END",
    "liquidity_drawdown": f"CASE WHEN s%6<>0 THEN {d('-(s%100)')}/100 END", "liquidity_change": d("-(s%70)") + "/100", "roles_total": "s%6", "roles_resolved": "s%6-CASE WHEN s%4=0 THEN 1 ELSE 0 END",
    "wallet_top10": d("(s%90)") + "/100", "raw_top10": d("(s%80)") + "/100", "provider_top": f"CASE WHEN s%10<>3 THEN {d('s%95')} END", "automated_share": d("(s%10)") + "/10", "sniper_share": d("(s%8)") + "/10", "organic_share": d("(s%6)") + "/10",
    "coordinated_share": f"CASE WHEN s%5<>3 THEN {d('(s%7)')}/20 END", "coordinated_wallet_share": d("(s%9)") + "/30", "organic_n": "s%50", "automated_n": "s%20", "sniper_n": "s%10", "coordinated_n": "s%5", "trading_wallets": "s%50+s%20+s%10+s%5",
    "organic_vol": f"CASE WHEN s%5<>3 THEN {d('(s%6)')}/10 END", "automated_vol": d("(s%3)") + "/10", "sniper_vol": d("(s%2)") + "/10", "c_activity": f"CASE WHEN s%11<>10 THEN {d('(s%11)')}/10 END", "c_liquidity": d("(s%21)") + "/20", "c_age": d("(s%17)") + "/16",
    "holders": d("s%6000"), "momentum": pick("s%7", "ACCELERATING", "SUSTAINED", "NEUTRAL", "COOLING", "UNSTABLE", "DECLINING", "INSUFFICIENT_HISTORY"), "momentum_score": pick("s%7", 0.85, 0.75, 0.45, 0.35, 0.2, 0.15, None),
    "momentum_confidence": d("(s%11)") + "/10", "span_ms": f"(s%8)*{H}", "market_coverage": d("(s%100)") + "/100", "round_trip_share": d("(s%10)") + "/10", "wash_trades": "s%150",
}
VERS = {dm: f"CASE WHEN s%{15 + i}=1 THEN 'old@0' WHEN s%{27 + i}=2 THEN NULL ELSE '{v}' END" for i, (dm, v) in enumerate(D.RULES.items())}
CH = f"{AS}, dr0 AS (SELECT asset, liquidity, seq AS s FROM ast), dr AS (SELECT asset, s, " + ", ".join(f"{e} AS {n}" for n, e in ROW.items()) + ", " + ", ".join(f"{e} AS v_{n}" for n, e in VERS.items()) + " FROM dr0)"


def row(t):
    a = dealt(t.assets().select("asset", "liquidity", F.col("seq").alias("s")), "asset")
    fam = F.filter(F.array(F.lit("ROUND_TRIPS"), F.when(F.col("s") % 2 == 0, "PATTERN"), F.when(F.col("s") % 3 == 0, "CONCENTRATION")), lambda x: x.isNotNull())
    cols = {n: F.expr(e) for n, e in ROW.items()}
    versions = F.create_map(*[x for n, e in VERS.items() for x in (F.lit(n), F.expr(e))])
    return a.select("asset", "s", *[c.alias(n) for n, c in cols.items()], versions.alias("versions"), fam.alias("wash_families"))


def intel(t):
    r = D.normalize_intel(row(t), NOW)
    return D.holder_intel(r).withColumn("intel_coverage", D.intel_coverage())


@query("D01", f"""WITH {EV}, v AS (SELECT event_id, CASE k%3 WHEN 0 THEN 'wash' WHEN 1 THEN 'activity' ELSE 'security' END AS dm, CASE k%5 WHEN 0 THEN 'wash@2' WHEN 1 THEN 'activity-quality@2' WHEN 2 THEN 'security-events@1' WHEN 3 THEN '' END AS ver FROM ev)
 SELECT event_id, CASE WHEN ver IS NULL OR ver='' THEN 'UNVERSIONED' WHEN (dm='wash' AND ver='wash@2') OR (dm='activity' AND ver='activity-quality@2') OR (dm='security' AND ver='security-events@1') THEN 'CURRENT' ELSE 'SUPERSEDED' END AS status FROM v""")
def rule_version_status(t):
    k = F.col("k")
    dm = F.when(k % 3 == 0, "wash").when(k % 3 == 1, "activity").otherwise("security")
    ver = F.when(k % 5 == 0, "wash@2").when(k % 5 == 1, "activity-quality@2").when(k % 5 == 2, "security-events@1").when(k % 5 == 3, "")
    return t.event_facts().select("event_id", D.rule_status(dm, ver).alias("status"))


BEH = f"CASE WHEN analyzed_at IS NULL THEN 'UNKNOWN' WHEN {NOW}-analyzed_at<={H} THEN 'FRESH' WHEN {NOW}-analyzed_at<={6 * H} THEN 'AGING' ELSE 'STALE' END"
HIS = f"CASE WHEN analyzed_at IS NULL THEN 'UNKNOWN' WHEN {NOW}-analyzed_at<={24 * H} THEN 'FRESH' WHEN {NOW}-analyzed_at<={168 * H} THEN 'AGING' ELSE 'STALE' END"


def ok(dm: str) -> str:
    return f"coalesce(v_{dm}='{D.RULES[dm]}', false)"


def dom(n: str, present: str, rule: str, fresh: str, status: str, cov: str, conf: str, stale: bool = True) -> str:
    have = f"analyzed_at IS NOT NULL AND ({present})"
    st = f"WHEN {fresh}='STALE' THEN 'STALE'" if stale else ""
    return (f"CASE WHEN NOT ({have}) THEN 'UNAVAILABLE' WHEN NOT {ok(rule)} THEN 'SUPERSEDED' {st} ELSE {status} END AS {n}_status, CASE WHEN {have} THEN {fresh} ELSE 'UNKNOWN' END AS {n}_freshness, "
            f"CASE WHEN {have} THEN {hu(cov, 3)} ELSE 0.0::DOUBLE END AS {n}_coverage, CASE WHEN {have} THEN {hu(conf, 3)} ELSE 0.0::DOUBLE END AS {n}_confidence")


READ = "CASE WHEN wallets>0 THEN wallets_read/wallets ELSE 0.0 END"
ATTC = "CASE attribution_raw WHEN 'ATTRIBUTED' THEN 1.0::DOUBLE WHEN 'AMBIGUOUS' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
CRL = "CASE WHEN other_confirmed>0 THEN 'MALICIOUS_HISTORY' WHEN other_suspected+other_suspicious>0 THEN 'SUSPICIOUS' WHEN launches>=2 THEN 'CLEAN' ELSE 'INSUFFICIENT_HISTORY' END"
NWL = "CASE WHEN network_raw='INSUFFICIENT_DATA' THEN 'INSUFFICIENT_DATA' WHEN best_confirmed>0 AND best_path>=0.5 THEN 'STRONG' WHEN best_path IS NOT NULL THEN 'MODERATE' WHEN network_raw='WEAK_ASSOCIATION' THEN 'WEAK_ASSOCIATION' ELSE 'NONE' END"
INTEL = f"""{CH}, n1 AS (SELECT *, {dom('activity', 'activity_raw IS NOT NULL', 'activity', BEH, "CASE WHEN activity_raw='MEASURED' AND representativeness>=0.5 THEN 'AVAILABLE' WHEN activity_raw IN ('MEASURED','PARTIAL') THEN 'PARTIAL' ELSE 'INSUFFICIENT_DATA' END", 'trades_classified*representativeness', 'class_confidence')},
  {dom('wash', 'wash_raw IS NOT NULL', 'wash', BEH, "CASE WHEN wash_raw='INSUFFICIENT_DATA' THEN 'INSUFFICIENT_DATA' WHEN wash_cov*representativeness>=0.5 THEN 'AVAILABLE' ELSE 'PARTIAL' END", hu('wash_cov*representativeness', 3), 'wash_conf')},
  {dom('coordination', 'network_raw IS NOT NULL', 'cluster', BEH, f"CASE WHEN wallets=0 THEN 'INSUFFICIENT_DATA' WHEN {READ}>=0.7 THEN 'AVAILABLE' ELSE 'PARTIAL' END", READ, f"CASE WHEN clusters=0 THEN 0.5::DOUBLE*{READ} ELSE cluster_conf END")},
  {dom('attribution', 'attribution_raw IS NOT NULL', 'attribution', HIS, "CASE attribution_raw WHEN 'ATTRIBUTED' THEN 'AVAILABLE' WHEN 'AMBIGUOUS' THEN 'PARTIAL' ELSE 'INSUFFICIENT_DATA' END", ATTC, 'attribution_conf', False)},
  {dom('creator', 'launches IS NOT NULL', 'creator', HIS, f"CASE WHEN {CRL}='INSUFFICIENT_HISTORY' THEN 'INSUFFICIENT_DATA' ELSE 'AVAILABLE' END", f"(CASE WHEN launches>=2 THEN 1.0::DOUBLE WHEN launches=1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)*{ATTC}", 'attribution_conf')},
  {dom('network', 'network_raw IS NOT NULL', 'network', HIS, f"CASE WHEN {NWL}='INSUFFICIENT_DATA' THEN 'INSUFFICIENT_DATA' ELSE 'AVAILABLE' END", f"CASE WHEN {NWL}='INSUFFICIENT_DATA' THEN 0.0::DOUBLE WHEN graph_cut THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END", f"CASE WHEN best_path IS NOT NULL THEN best_path WHEN {NWL}='NONE' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END")},
  {CRL} AS creator_level, {NWL} AS network_level, CASE WHEN analyzed_at IS NULL OR NOT {ok('security')} THEN 0.0::DOUBLE WHEN mint_history='COMPLETE' THEN 1.0::DOUBLE WHEN mint_history='PARTIAL' THEN 0.6::DOUBLE WHEN mint_history='UNKNOWN' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS security_coverage, {HIS} AS security_freshness FROM dr),
 n2 AS (SELECT *, CASE WHEN analyzed_at IS NULL AND active_events=0 THEN 'UNAVAILABLE' WHEN analyzed_at IS NULL THEN 'PARTIAL' WHEN NOT {ok('security')} AND active_events=0 THEN 'SUPERSEDED' WHEN NOT {ok('security')} THEN 'PARTIAL' WHEN security_coverage>=0.6 THEN 'AVAILABLE' ELSE 'PARTIAL' END AS security_status,
  CASE WHEN active_events>0 THEN event_conf ELSE {hu('security_coverage*0.8::DOUBLE', 3)} END AS security_confidence, coalesce(roles_total>0 AND roles_resolved=roles_total AND wallet_top10 IS NOT NULL, false) AS role_aware, raw_top10 IS NULL AND provider_top IS NULL AS nohold FROM n1),
 it AS (SELECT *, CASE WHEN nohold THEN 'UNAVAILABLE' WHEN role_aware THEN 'AVAILABLE' ELSE 'PARTIAL' END AS holders_status, CASE WHEN nohold THEN 0.0::DOUBLE WHEN role_aware THEN 1.0::DOUBLE WHEN provider_top IS NOT NULL THEN 0.7::DOUBLE ELSE 0.35::DOUBLE END AS holders_coverage,
  CASE WHEN nohold THEN 0.0::DOUBLE WHEN role_aware THEN 0.9::DOUBLE WHEN provider_top IS NOT NULL THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS holders_confidence, {hu('provider_top', 1)} AS provider_pct, CASE WHEN role_aware THEN {hu('wallet_top10*100', 1)} ELSE {hu('provider_top', 1)} END AS holder_pct,
  {", ".join(f"{x}_status IN ('AVAILABLE','PARTIAL') AND {x}_freshness<>'STALE' AS {x}_u" for x in D.DEEP)} FROM n2),
 ic AS (SELECT *, {hu('(' + '+'.join(f"CASE WHEN {x}_u{' OR security_status=' + chr(39) + 'PARTIAL' + chr(39) if x == 'security' else ''} THEN {x}_coverage ELSE 0.0::DOUBLE END" for x in D.DEEP) + ')/7.0', 3)} AS intel_coverage FROM it)"""
DCOLS = [f"{x}_{f}" for x in D.DEEP for f in ("status", "coverage", "confidence", "freshness")]


@query("D02", f"WITH {INTEL} SELECT asset, {', '.join(DCOLS)}, creator_level, network_level FROM ic")
def intelligence_domains(t):
    return intel(t).select("asset", *DCOLS, "creator_level", "network_level")


@query("D03", f"WITH {INTEL} SELECT asset, role_aware, holders_status, holders_coverage, holders_confidence, holder_pct FROM ic")
def holder_domain(t):
    return intel(t).select("asset", "role_aware", "holders_status", "holders_coverage", "holders_confidence", "holder_pct")


@query("D04", """WITH e AS (SELECT 'T'||o_orderkey AS asset, 'C'||o_custkey AS creator, (o_orderkey%9=0)::INT AS c, (o_orderkey%9=1)::INT AS s, (o_orderkey%9=2)::INT AS u FROM orders)
 SELECT asset, creator, count(*) OVER w AS launches, (sum(c) OVER w-c)::BIGINT AS confirmed, (sum(s) OVER w-s)::BIGINT AS suspected, (sum(u) OVER w-u)::BIGINT AS suspicious FROM e WINDOW w AS (PARTITION BY creator)""")
def launch_counts(t):
    k = F.col("o_orderkey")
    ev = t.orders.where(k % 9 < 3).select(F.concat(F.lit("T"), k.cast("string")).alias("asset"), F.when(k % 9 == 0, "CONFIRMED").when(k % 9 == 1, "STRONGLY_SUSPECTED").otherwise("SUSPICIOUS").alias("status"))
    return D.launch_counts(ev, t.launches())


@query("D05", f"WITH {INTEL} SELECT asset, intel_coverage FROM ic")
def intelligence_coverage(t):
    return intel(t).select("asset", "intel_coverage")


# ---- momentum --------------------------------------------------------------------------

MNOW = 1_706_659_200_000


def series(t):
    e = t.event_facts()
    return e.select(F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("asset"), F.col("at").alias("t"), F.when(F.col("event_id") % 9 != 0, 100 + F.col("value") * F.col("k") / 1000).alias("price"),
                    F.when(F.col("k") % 6 != 0, F.col("k") * 100.0).alias("liquidity"), F.when(F.col("k") % 4 != 0, F.col("k").cast("double")).alias("holders"))


def anchor(w: int) -> str:
    return f"(SELECT max((x.t, x.price)) FROM p x WHERE x.asset=b.asset AND x.t<=b.tl-{w}+{w}*0.25 AND x.t<b.tl)"


MOM = f"""{EV}, p AS (SELECT 'G'||user_id AS asset, at_ms AS t, 100+value*k/1000 AS price, CASE WHEN k%6<>0 THEN k*100.0::DOUBLE END AS liq, CASE WHEN k%4<>0 THEN k::DOUBLE END AS hol FROM ev WHERE event_id%9<>0 AND at_ms<={MNOW} AND {MNOW}-at_ms<=86400000),
 b0 AS (SELECT asset, count(*) AS n, min(t) AS t0, max(t) AS tl, arg_max(price,t) AS pl, arg_min(price,t) AS p0 FROM p GROUP BY 1), b1 AS (SELECT b.*, {anchor(30 * 60_000)} AS a3, {anchor(2 * H)} AS a2, {anchor(6 * H)} AS a6 FROM b0 b),
 b2 AS (SELECT *, coalesce(a6[1],a2[1],a3[1],t0) AS ft FROM b1), sx AS (SELECT asset, t, price, liq, hol, lag(t) OVER w AS pt, lag(price) OVER w AS pp FROM p WINDOW w AS (PARTITION BY asset ORDER BY t)),
 sy AS (SELECT sx.*, ft, CASE WHEN pt>=ft THEN ln(price/pp) END AS s FROM sx JOIN b2 USING (asset)),
 g AS (SELECT asset, count(s) AS steps, count(*) FILTER (abs(s)>=0.005) AS mv, count(*) FILTER (abs(s)>=0.005 AND s>0) AS up, sum(abs(s)) AS asum, max(abs(s)) AS amax, stddev_pop(s) AS sd, arg_min(liq,t) FILTER (t>=ft AND liq IS NOT NULL) AS l0, arg_max(liq,t) FILTER (t>=ft AND liq IS NOT NULL) AS l1, max(liq) FILTER (t>=ft) AS pk,
  arg_min(hol,t) FILTER (t>=ft AND hol IS NOT NULL) AS h0, arg_max(hol,t) FILTER (t>=ft AND hol IS NOT NULL) AS h1 FROM sy GROUP BY 1),
 m1 AS (SELECT b2.*, g.* EXCLUDE (asset), tl-t0 AS span, ln(pl/a3[2]) AS r3, ln(pl/a2[2]) AS r2, ln(pl/a6[2]) AS r6, CASE WHEN mv>0 THEN up/mv END AS pers, CASE WHEN steps>=3 AND asum>0 THEN amax/asum END AS spk, CASE WHEN steps>=3 THEN sd ELSE 0 END AS vol,
  CASE WHEN l0<>0 AND l1<>0 THEN {hu('l1/l0-1', 3)} END AS lchg, CASE WHEN pk>0 AND l1 IS NOT NULL THEN {hu('l1/pk-1', 3)} END AS ldr FROM b2 JOIN g USING (asset)),
 m2 AS (SELECT *, coalesce(r6,r2,r3,ln(pl/p0)) AS mvt FROM m1),
 m3 AS (SELECT *, CASE WHEN n<3 OR span<1200000 THEN 'INSUFFICIENT_HISTORY' WHEN spk>=0.7 AND abs(mvt)>=0.1 THEN 'UNSTABLE' WHEN lchg<=-0.3 AND mvt>0.2 THEN 'UNSTABLE' WHEN pers>0.35 AND pers<0.65 AND vol>=0.15 THEN 'UNSTABLE' WHEN r2 IS NULL THEN CASE WHEN coalesce(r3,mvt)<=-0.05 THEN 'DECLINING' ELSE 'NEUTRAL' END
  WHEN r2>0.03 AND r3>0 AND r3/((tl-a3[1])/3600000.0)>r2/((tl-a2[1])/3600000.0)*1.2 AND coalesce(pers,0)>=0.5 THEN 'ACCELERATING' WHEN r2>0.03 AND coalesce(pers,0)>=0.55 AND (r6 IS NULL OR r6>0) THEN 'SUSTAINED' WHEN coalesce(r2>0 AND r3<=0,false) OR coalesce(r6>0 AND r2<=0,false) THEN 'COOLING' WHEN r2<=-0.05 AND coalesce(pers,1)<=0.4 THEN 'DECLINING' ELSE 'NEUTRAL' END AS momentum FROM m2)"""


@query("D06", f"""WITH {MOM} SELECT asset, momentum, CASE momentum WHEN 'ACCELERATING' THEN 0.85::DOUBLE WHEN 'SUSTAINED' THEN 0.75::DOUBLE WHEN 'NEUTRAL' THEN 0.45::DOUBLE WHEN 'COOLING' THEN 0.35::DOUBLE WHEN 'UNSTABLE' THEN 0.2::DOUBLE WHEN 'DECLINING' THEN 0.15::DOUBLE END AS momentum_score,
 CASE WHEN momentum='INSUFFICIENT_HISTORY' THEN 0.0::DOUBLE ELSE {hu('least(1.0::DOUBLE,n/8.0)*least(1.0::DOUBLE,span/7200000.0)', 3)} END AS momentum_confidence, n AS observations, span AS span_ms, CASE WHEN momentum<>'INSUFFICIENT_HISTORY' THEN {hu('pers', 3)} END AS persistence, CASE WHEN momentum<>'INSUFFICIENT_HISTORY' THEN {hu('spk', 3)} END AS spikiness,
 CASE WHEN momentum<>'INSUFFICIENT_HISTORY' THEN lchg END AS liquidity_change, CASE WHEN momentum<>'INSUFFICIENT_HISTORY' THEN ldr END AS liquidity_drawdown, CASE WHEN momentum<>'INSUFFICIENT_HISTORY' THEN h1-h0 END AS holder_change FROM m3""")
def momentum(t):
    return D.momentum(series(t), MNOW)


@query("D20", f"""WITH {EV}, m AS (SELECT 'G'||user_id AS asset, at_ms AS t, 'P'||(k%3) AS pool, k*100.0::DOUBLE AS liquidity, event_id FROM ev WHERE {MNOW}-at_ms<=86400000)
 SELECT asset, m.t AS t_ms, CASE WHEN asset='G7' OR pool='P1' THEN liquidity END AS liquidity, CASE WHEN event_id%3=0 THEN event_id END AS holders FROM m""")
def decision_history(t):
    e = t.event_facts()
    a = F.concat(F.lit("G"), F.col("user_id").cast("string"))
    m = e.select(a.alias("asset"), F.col("at").alias("t"), F.concat(F.lit("P"), (F.col("k") % 3).cast("string")).alias("pool"), (F.col("k") * 100.0).alias("liquidity"))
    h = e.where("event_id % 3 = 0").select(a.alias("asset"), F.col("at").alias("t"), F.col("event_id").alias("holders"))
    own = m.select("asset").distinct().where("asset <> 'G7'").withColumn("pool", F.lit("P1"))
    return D.decision_history(m, h, own, MNOW).select("asset", F.col("t").alias("t_ms"), "liquidity", "holders")


# ---- integrity -------------------------------------------------------------------------


def contrib_sql() -> str:
    z = lambda lo, x: f"least({lo}::DOUBLE, {x})"
    other = "CASE WHEN role_aware THEN provider_pct END"
    share = "coalesce(CASE WHEN activity_u THEN coordinated_share END, coordinated_wallet_share)"
    disputed = f"coalesce(greatest(holder_pct,{other})>=3*greatest(1.0::DOUBLE,least(holder_pct,{other})) AND abs(holder_pct-({other}))>=30 AND ({other}) IS NOT NULL,false)"
    rows = [
        ("tokenSecurity", "RUGCHECK_SCORE", "rugcheck-score", "rug>50", "least(1.0::DOUBLE,(rug-50)/100)", "rug_conf", None), ("tokenSecurity", "EXTENSION_PENALTY", "extension", "penalty_extensions>0", "0.3", "1.0", None),
        ("tokenSecurity", "RUGCHECK_FINDING", "rugcheck-finding", "token_finding IS NOT NULL", "CASE token_finding WHEN 'high' THEN 0.35 ELSE 0.15 END", "0.9", None), ("tokenSecurity", "AUTHORITY_REASSIGNED", "authority-moved", "ev_authority IS NOT NULL", "0.3", "event_conf", None),
        ("liquiditySafety", "THIN_DEPTH", "depth", "liq<10000", "0.35", "liq_conf", None), ("liquiditySafety", "SHALLOW_DEPTH", "depth", "liq>=10000 AND liq<25000", "0.2", "liq_conf", None), ("liquiditySafety", "LP_FINDING", "lp", "lp_finding IS NOT NULL", "0.35", "0.9", None),
        ("liquiditySafety", "LIQUIDITY_DRAIN", "drain", "ev_drain IN ('STRONGLY_SUSPECTED','SUSPICIOUS')", "CASE ev_drain WHEN 'STRONGLY_SUSPECTED' THEN 0.6 ELSE 0.25 END", "event_conf", None), ("liquiditySafety", "LIQUIDITY_COLLAPSE", "drain", "liquidity_drawdown<=-0.8", "0.55", "0.8", None),
        ("liquiditySafety", "LIQUIDITY_LEAVING", "drain", "NOT coalesce(liquidity_drawdown<=-0.8,false) AND liquidity_change<=-0.4", "0.3", "0.8", None),
        ("holderIntegrity", "CONCENTRATION", "concentration", "holder_pct>30", z(0.8, "(holder_pct-30)/50*0.7"), f"CASE WHEN {disputed} AND holder_finding IS NULL THEN least(holders_confidence,0.45::DOUBLE) ELSE holders_confidence END", None),
        ("holderIntegrity", "HOLDER_FINDING", "concentration", "holder_finding IS NOT NULL", "0.15", "0.9", None), ("holderIntegrity", "CREATOR_DUMP", "insider-selling", "ev_dump IS NOT NULL", "CASE ev_dump WHEN 'STRONGLY_SUSPECTED' THEN 0.5 ELSE 0.25 END", "event_conf", None),
        ("activityIntegrity", "AUTOMATION", "automation", "activity_u AND automated_share>0.4", z(0.45, "(automated_share-0.4)*0.9"), "activity_confidence", None), ("activityIntegrity", "SNIPERS", "snipers", "activity_u AND sniper_share>0.25", z(0.6, "(sniper_share-0.25)*1.2"), "activity_confidence", None),
        ("activityIntegrity", "NO_ORGANIC", "organic-absence", "activity_u AND trades_classified>=0.6 AND organic_share<0.1", "0.2", "activity_confidence", None),
        ("walletCoordination", "COORDINATION", "coordination", f"coordination_u AND {share}>0.1", z(0.7, f"({share}-0.1)*1.2"), "coordination_confidence", "CASE WHEN activity_u THEN least(coordination_coverage,activity_coverage) ELSE coordination_coverage END"),
        ("walletCoordination", "WASH_HIGH", "manipulation", "wash_u AND wash_raw='HIGH'", "CASE WHEN wash_confidence>=0.5 THEN 0.65 ELSE 0.4 END", "wash_confidence", "wash_coverage"), ("walletCoordination", "WASH_ELEVATED", "manipulation", "wash_u AND wash_raw='ELEVATED'", "0.35", "wash_confidence", "wash_coverage"),
        ("creatorReputation", "CREATOR_MALICIOUS", "history", "creator_u AND creator_level='MALICIOUS_HISTORY'", "0.6", "creator_confidence", None), ("creatorReputation", "CREATOR_SUSPICIOUS", "history", "creator_u AND creator_level='SUSPICIOUS'", "CASE WHEN other_suspected>=2 THEN 0.35 ELSE 0.25 END", "creator_confidence", None),
        ("rugHistory", "SUPPLY_EXPANSION", "token-events", "security_status IN ('AVAILABLE','PARTIAL') AND ev_supply IN ('STRONGLY_SUSPECTED','SUSPICIOUS')", "CASE ev_supply WHEN 'STRONGLY_SUSPECTED' THEN 0.55 ELSE 0.2 END", "event_conf", None),
        ("rugHistory", "FREEZE_ABUSE", "token-events", "security_status IN ('AVAILABLE','PARTIAL') AND ev_freeze IN ('STRONGLY_SUSPECTED','SUSPICIOUS')", "CASE ev_freeze WHEN 'STRONGLY_SUSPECTED' THEN 0.55 ELSE 0.2 END", "event_conf", None),
        ("rugHistory", "NETWORK_STRONG", "network", "network_u AND network_level='STRONG'", "0.55", "network_confidence", None), ("rugHistory", "NETWORK_MODERATE", "network", "network_u AND network_level='MODERATE'", "0.35", "network_confidence", None)]
    return "co AS (" + " UNION ALL ".join(f"SELECT asset, '{a}' AS domain, '{b}' AS code, '{c}' AS family, ({r})::DOUBLE AS risk, ({cf})::DOUBLE AS confidence, ({cv or 'NULL'})::DOUBLE AS coverage FROM ic WHERE {w} AND ({r})>0" for a, b, c, w, r, cf, cv in rows) + ")"


CONTRIB = f"{INTEL}, {contrib_sql()}"
TC = "CASE WHEN mint_conf IS NOT NULL THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END+CASE WHEN freeze_conf IS NOT NULL THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END+CASE WHEN ext_conf IS NOT NULL THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END+CASE WHEN rug_conf IS NOT NULL THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END"
TF = "(CASE WHEN mint_conf IS NOT NULL THEN 0.3::DOUBLE*mint_conf ELSE 0.0::DOUBLE END+CASE WHEN freeze_conf IS NOT NULL THEN 0.2::DOUBLE*freeze_conf ELSE 0.0::DOUBLE END+CASE WHEN ext_conf IS NOT NULL THEN 0.25::DOUBLE*ext_conf ELSE 0.0::DOUBLE END+CASE WHEN rug_conf IS NOT NULL THEN 0.25::DOUBLE*rug_conf ELSE 0.0::DOUBLE END)"
uz = lambda x: f"CASE WHEN {x}_u THEN {x}_coverage ELSE 0.0::DOUBLE END"
DOMS = f"""{CONTRIB}, ba AS (SELECT asset, 'tokenSecurity' AS domain, {TC} AS coverage, {TF}/greatest({TC},1e-9) AS bc FROM ic UNION ALL SELECT asset, 'liquiditySafety', CASE WHEN liq_conf IS NOT NULL THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END+CASE WHEN rug_conf IS NOT NULL THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END, coalesce(liq_conf,0) FROM ic
  UNION ALL SELECT asset, 'holderIntegrity', holders_coverage, holders_confidence FROM ic UNION ALL SELECT asset, 'activityIntegrity', {uz('activity')}, activity_confidence FROM ic UNION ALL SELECT asset, 'walletCoordination', ({uz('coordination')}+{uz('wash')})/2, greatest(coordination_confidence,wash_confidence) FROM ic
  UNION ALL SELECT asset, 'creatorReputation', {uz('creator')}, creator_confidence FROM ic UNION ALL SELECT asset, 'rugHistory', (CASE WHEN security_status IN ('AVAILABLE','PARTIAL') THEN security_coverage ELSE 0.0::DOUBLE END+{uz('network')})/2, greatest(security_confidence,network_confidence) FROM ic),
 fm AS (SELECT asset, domain, family, max((risk, confidence, coalesce(coverage,-1))) AS c FROM co GROUP BY 1,2,3), tp AS (SELECT asset, domain, max(c) AS top, sum(CAST(c[1] AS DECIMAL(12,9)))::DOUBLE AS total FROM fm GROUP BY 1,2),
 dj AS (SELECT ba.*, top, CASE WHEN top IS NOT NULL THEN least(1.0::DOUBLE, top[1]+(total-top[1])*0.25::DOUBLE) WHEN coverage>0 THEN 0.0::DOUBLE END AS r0, coalesce(top[2], bc) AS c0, least(coverage, CASE WHEN top IS NULL OR top[3]<0 THEN coverage ELSE top[3] END) AS ecov FROM ba LEFT JOIN tp ON ba.asset=tp.asset AND ba.domain=tp.domain),
 db AS (SELECT *, CASE WHEN r0 IS NULL THEN 'UNKNOWN' WHEN r0<0.15 THEN 'CLEAR' WHEN r0<0.3 THEN 'LOW' WHEN r0<0.5 THEN 'ELEVATED' WHEN r0<0.7 THEN 'HIGH' ELSE 'SEVERE' END AS b0 FROM dj),
 dm AS (SELECT asset, domain, {hu('r0', 3)} AS risk, CASE WHEN b0 IN ('HIGH','SEVERE') AND (c0<0.5 OR ecov<0.4) THEN 'ELEVATED' ELSE b0 END AS band, {hu('c0', 3)} AS confidence, {hu('least(1.0::DOUBLE,greatest(0.0::DOUBLE,coverage))', 3)} AS coverage, ecov FROM db)"""


def contributions(t):
    return D.integrity_contributions(intel(t))


def domains(t):
    i = dealt(cut(intel(t)), "asset")
    return D.build_domains(D.integrity_contributions(i), D.domain_bases(i))


@query("D08 D09", f"WITH {CONTRIB} SELECT asset, domain, code, family, risk, confidence FROM co")
def risk_contributions(t):
    return contributions(t).drop("coverage")


@query("D07", f"WITH {DOMS} SELECT asset, domain, risk, band, confidence, coverage FROM dm")
def risk_domains(t):
    return domains(t).drop("ecov")


INTEG = f"""{DOMS}, dw AS (SELECT *, CASE domain WHEN 'tokenSecurity' THEN 0.2::DOUBLE WHEN 'creatorReputation' THEN 0.1::DOUBLE WHEN 'rugHistory' THEN 0.1::DOUBLE ELSE 0.15::DOUBLE END AS w, CASE band WHEN 'UNKNOWN' THEN -1 WHEN 'CLEAR' THEN 0 WHEN 'LOW' THEN 1 WHEN 'ELEVATED' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END AS rk,
  CASE domain WHEN 'tokenSecurity' THEN 0 WHEN 'liquiditySafety' THEN -1 WHEN 'holderIntegrity' THEN -2 WHEN 'activityIntegrity' THEN -3 WHEN 'walletCoordination' THEN -4 WHEN 'creatorReputation' THEN -5 ELSE -6 END AS o FROM dm),
 ig AS (SELECT asset, sum(CAST(w AS DECIMAL(5,3)))::DOUBLE AS tw, sum(CAST(w AS DECIMAL(5,3))*CAST(coverage AS DECIMAL(5,3)))::DOUBLE AS cw, sum(CAST(w AS DECIMAL(5,3))*CAST(coverage AS DECIMAL(5,3))*(1-CAST(coalesce(risk,0) AS DECIMAL(5,3))))::DOUBLE AS er, sum(CAST(w AS DECIMAL(5,3))*CAST(coverage AS DECIMAL(5,3))*CAST(coalesce(risk,0) AS DECIMAL(5,3)))::DOUBLE AS ri, sum(CAST(w AS DECIMAL(5,3))*CAST(coverage AS DECIMAL(5,3))*CAST(confidence AS DECIMAL(5,3)))::DOUBLE AS cf, arg_max(domain,(rk,coalesce(risk,0),o)) AS td, arg_max(band,(rk,coalesce(risk,0),o)) AS tb, count(*) FILTER (band='ELEVATED' AND ecov>=0.4 AND confidence>=0.5) AS el FROM dw GROUP BY 1),
 ii AS (SELECT *, CASE WHEN cw/tw<0.25 THEN 'UNKNOWN' WHEN tb IN ('SEVERE','HIGH') THEN tb WHEN el>=2 THEN 'HIGH' WHEN tb='UNKNOWN' THEN 'CLEAR' ELSE tb END AS integrity_band FROM ig),
 inte AS (SELECT asset, integrity_band, {hu('er/tw*100', 1)} AS integrity_score, {hu('CASE WHEN cw>0 THEN ri/cw ELSE 0 END', 3)} AS integrity_risk, {hu('cw/tw', 3)} AS integrity_coverage, {hu('CASE WHEN cw>0 THEN cf/cw ELSE 0 END', 3)} AS integrity_confidence, CASE WHEN integrity_band NOT IN ('CLEAR','UNKNOWN') THEN td END AS driver FROM ii)"""


@query("D10", f"WITH {INTEG} SELECT * FROM inte")
def integrity_assessment(t):
    return D.integrity(domains(t))


def lbh(x: str, lo: int, hi: int) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x}<={lo} THEN 0.0::DOUBLE WHEN {x}>={hi} THEN 1.0::DOUBLE ELSE ln({x}/{lo}.0)/ln({hi}.0/{lo}.0) END"


def comb(*parts) -> tuple[str, str]:
    tot = "+".join(f"{w}::DOUBLE" for w, _ in parts)
    have = "+".join(f"CASE WHEN ({v}) IS NOT NULL THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for w, v in parts)
    val = "+".join(f"CASE WHEN ({v}) IS NOT NULL THEN {w}::DOUBLE*({v}) ELSE 0.0::DOUBLE END" for w, v in parts)
    return f"CASE WHEN ({have})>0 THEN ({val})/({tot}) END", f"({have})/({tot})"


EFF = "CASE WHEN activity_u AND trading_wallets>=5 THEN organic_n*1.0::DOUBLE+automated_n*0.5::DOUBLE+sniper_n*0.25::DOUBLE+CASE WHEN coordinated_n>0 THEN greatest(1,least(coordinated_n,clusters)) ELSE 0 END END"
OP = {"participation": comb((0.6, lbh("eff", 3, 60)), (0.4, lbh("holders", 50, 5000))), "capital": comb((0.6, "CASE WHEN activity_u AND organic_vol IS NOT NULL THEN least(1.0::DOUBLE,organic_vol*1.0::DOUBLE+automated_vol*0.5::DOUBLE+sniper_vol*0.25::DOUBLE) END"), (0.4, "c_activity")),
      "liquidity": ("c_liquidity", "CASE WHEN c_liquidity IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"), "distribution": ("1-least(1.0::DOUBLE,greatest(0.0::DOUBLE,(holder_pct-15)/60))*CASE WHEN holder_pct IS NULL THEN NULL ELSE 1 END", "CASE WHEN holder_pct IS NULL THEN 0.0::DOUBLE WHEN role_aware THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END"),
      "momentum": ("momentum_score", "CASE WHEN momentum_score IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"), "maturity": comb((0.7, "c_age"), (0.3, "least(1.0::DOUBLE,span_ms/21600000.0::DOUBLE)"))}
OPP = f"""op1 AS (SELECT *, {EFF} AS eff FROM ic), op2 AS (SELECT *, {', '.join(f'{hu(v, 3)} AS o_{k}, {hu(c, 3)} AS oc_{k}' for k, (v, c) in OP.items())} FROM op1),
 op3 AS (SELECT *, ({'+'.join(f'coalesce(o_{k},0.0::DOUBLE)*{w}::DOUBLE' for k, w in D.OPPORTUNITY.items())})*100 AS os, {'+'.join(f'oc_{k}*{w}::DOUBLE' for k, w in D.OPPORTUNITY.items())} AS ocv FROM op2),
 opp AS (SELECT *, {hu('os', 1)} AS opportunity, {hu('ocv', 3)} AS opportunity_coverage, CASE WHEN ocv<0.4 THEN 'UNKNOWN' WHEN os>=65 THEN 'STRONG' WHEN os>=45 THEN 'MODERATE' ELSE 'WEAK' END AS opportunity_band, {hu('eff', 1)} AS effective FROM op3)"""


@query("D11", f"WITH {INTEL} SELECT asset, {EFF} AS effective FROM ic")
def effective_participants(t):
    return intel(t).select("asset", D.effective_participants().alias("effective"))


@query("D12", f"WITH {INTEL}, {OPP} SELECT asset, opportunity, opportunity_coverage, opportunity_band, effective, {', '.join(f'o_{k}' for k in OP)} FROM opp")
def opportunity(t):
    return D.opportunity(intel(t)).select("asset", "opportunity", "opportunity_coverage", "opportunity_band", "effective", *[f"o_{k}" for k in OP])


@query("D13", f"""WITH {EV}, v AS (SELECT event_id, CASE k%6 WHEN 0 THEN 'AUTHORITY_MINT_ACTIVE' WHEN 1 THEN 'UNTRADEABLE' WHEN 2 THEN 'CRITICAL_RUGCHECK' WHEN 3 THEN 'CATASTROPHIC_CONCENTRATION' WHEN 4 THEN 'MALFORMED_TOKEN' ELSE 'TRANSFER_HOOK_ACTIVE' END AS code, CASE k%4 WHEN 0 THEN 'helius' WHEN 1 THEN 'jupiter' WHEN 2 THEN 'derived' ELSE 'elsewhere' END AS source, k%12=2 AS cr, k%6=2 AS hist, at_ms FROM ev)
 SELECT event_id, CASE code WHEN 'AUTHORITY_MINT_ACTIVE' THEN 'CRITICAL_TOKEN_AUTHORITY_RISK' WHEN 'UNTRADEABLE' THEN 'CRITICAL_LIQUIDITY_RISK' WHEN 'CRITICAL_RUGCHECK' THEN CASE WHEN cr THEN 'STRONG_SERIAL_RUGGER' ELSE 'CONFIRMED_CURRENT_RUG' END WHEN 'CATASTROPHIC_CONCENTRATION' THEN 'CRITICAL_HOLDER_CONCENTRATION' WHEN 'MALFORMED_TOKEN' THEN 'DATA_INTEGRITY' ELSE 'CRITICAL_TRANSFER_RESTRICTION' END AS family,
 CASE source WHEN 'helius' THEN 1.0::DOUBLE WHEN 'jupiter' THEN 0.85::DOUBLE WHEN 'derived' THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence, CASE WHEN hist THEN 'FRESH' WHEN {MNOW}-at_ms<=1800000 THEN 'FRESH' WHEN {MNOW}-at_ms<=5400000 THEN 'AGING' ELSE 'STALE' END AS freshness FROM v""")
def veto_descriptions(t):
    k = F.col("k")
    code = F.when(k % 6 == 0, "AUTHORITY_MINT_ACTIVE").when(k % 6 == 1, "UNTRADEABLE").when(k % 6 == 2, "CRITICAL_RUGCHECK").when(k % 6 == 3, "CATASTROPHIC_CONCENTRATION").when(k % 6 == 4, "MALFORMED_TOKEN").otherwise("TRANSFER_HOOK_ACTIVE")
    v = t.event_facts().select("event_id", code.alias("code"), F.when(k % 4 == 0, "helius").when(k % 4 == 1, "jupiter").when(k % 4 == 2, "derived").otherwise("elsewhere").alias("source"),
                               F.when(k % 12 == 2, "Creator history of rugged tokens (danger)").otherwise("rugged (danger)").alias("observed"), F.when(k % 6 == 2, "historical").otherwise("current-state").alias("nature"), "at")
    return D.describe_vetoes(v, MNOW).select("event_id", "family", "confidence", "freshness")


HF = """hf AS (SELECT asset, 'CONFIRMED_CURRENT_RUG' AS code FROM ic WHERE ev_drain='CONFIRMED' UNION ALL SELECT asset, 'CONFIRMED_MALICIOUS_TOKEN' FROM ic WHERE ev_supply='CONFIRMED' OR ev_freeze='CONFIRMED'
 UNION ALL SELECT asset, 'STRONG_SERIAL_RUGGER' FROM ic WHERE network_status='AVAILABLE' AND attribution_raw='ATTRIBUTED' AND attribution_conf>=0.6 AND CASE WHEN best_path>=0.6 THEN coalesce(best_confirmed,0) ELSE 0 END+CASE WHEN creator_status='AVAILABLE' THEN other_confirmed ELSE 0 END>=2
 UNION ALL SELECT asset, 'EXTREME_MARKET_MANIPULATION' FROM ic WHERE wash_u AND wash_raw='HIGH' AND wash_confidence>=0.6 AND s%6=0 AND round_trip_share>=0.4 AND wash_trades>=60 AND wash_coverage>=0.6)"""


@query("D14", f"WITH {INTEL}, {HF} SELECT * FROM hf")
def hard_fails(t):
    return D.hard_fails(intel(t)).select("asset", "code")


def decided(t):
    # dealt by asset, which all later steps group and join by: nothing is shuffled again
    i = dealt(cut(intel(t)), "asset")
    con = D.integrity_contributions(i)
    fails = D.hard_fails(i)
    n = fails.groupBy("asset").agg(F.count("*").alias("n_fails"))
    j = D.opportunity(i).join(D.integrity(D.build_domains(con, D.domain_bases(i))), "asset").join(n, "asset", "left").na.fill(0, ["n_fails"])
    return D.verdict(j), con, fails


RISING = "momentum IN ('ACCELERATING','SUSTAINED')"
BLOCK = f"""list_filter([CASE WHEN market_coverage<0.7 THEN 'market_coverage' END, CASE WHEN intel_coverage<0.5 THEN 'intelligence_coverage' END, CASE WHEN integrity_coverage<0.6 THEN 'integrity_coverage' END, CASE WHEN integrity_band NOT IN ('CLEAR','LOW') THEN 'integrity_band' END, CASE WHEN opportunity<65 THEN 'opportunity' END, CASE WHEN opportunity_coverage<0.7 THEN 'opportunity_coverage' END,
  CASE WHEN NOT {RISING} THEN 'momentum' END, CASE WHEN {RISING} AND momentum_confidence<0.5 THEN 'momentum_confidence' END], lambda x: x IS NOT NULL)"""


VERDICT = f"""{INTEG}, {OPP}, {HF}, hn AS (SELECT asset, count(*) AS nf FROM hf GROUP BY 1), ve AS (SELECT opp.*, inte.* EXCLUDE (asset), coalesce(nf,0) AS nf FROM opp JOIN inte ON opp.asset=inte.asset LEFT JOIN hn ON hn.asset=opp.asset), vf AS (SELECT *, {BLOCK} AS bl FROM ve),
 vg AS (SELECT *, CASE WHEN nf>0 THEN 'REJECTED' WHEN market_coverage<0.35 THEN 'INSUFFICIENT_DATA' WHEN integrity_band IN ('HIGH','SEVERE') THEN 'HIGH_RISK' WHEN market_coverage<0.6 THEN 'WATCH' WHEN len(bl)=0 THEN 'HIGH_POTENTIAL' ELSE 'QUALIFIED' END AS verdict FROM vf),
 vh AS (SELECT asset, verdict, CASE verdict WHEN 'WATCH' THEN 'market_coverage' WHEN 'QUALIFIED' THEN array_to_string(bl,',') ELSE '' END AS blockers, CASE WHEN verdict<>'REJECTED' THEN {hu('least(100.0::DOUBLE,greatest(0.0::DOUBLE,opportunity-40*integrity_risk-10*(1-integrity_coverage)))', 1)} END AS rank_score FROM vg)"""


@query("D15 D16", f"WITH {VERDICT} SELECT * FROM vh")
def verdicts(t):
    v, _, _ = decided(t)
    return v.select("asset", "verdict", F.array_join("blockers", ",").alias("blockers"), "rank_score")


@query("D18", f"""WITH {VERDICT}, vr AS (SELECT vf.*, vh.blockers AS bk FROM vf JOIN vh ON vf.asset=vh.asset),
 good AS (SELECT asset, unnest(list_filter([CASE WHEN effective>=10 AND oc_participation>=0.9 THEN 'INDEPENDENT_BUYERS' END, CASE WHEN o_liquidity>=0.6 THEN 'HEALTHY_LIQUIDITY' END, CASE WHEN momentum IN ('SUSTAINED','ACCELERATING') THEN 'MOMENTUM_'||momentum END,
  CASE WHEN creator_status='AVAILABLE' AND creator_level='CLEAN' THEN 'CREATOR_CLEAN' END, CASE WHEN wash_u AND wash_raw='LOW' AND wash_coverage>=0.5 THEN 'WASH_LOW' END], lambda x: x IS NOT NULL)) AS code FROM vr)
 SELECT vr.asset, 'hard_fail' AS kind, f.code FROM vr JOIN (SELECT asset, code, row_number() OVER (PARTITION BY asset ORDER BY code) AS r FROM (SELECT DISTINCT asset, code FROM hf)) f ON f.asset=vr.asset AND r<=3
 UNION ALL SELECT asset, 'positive', code FROM good UNION ALL SELECT vr.asset, 'risk', c.code FROM vr JOIN (SELECT asset, code, row_number() OVER (PARTITION BY asset ORDER BY risk DESC, code DESC) AS r FROM (SELECT DISTINCT asset, risk, code FROM co)) c ON c.asset=vr.asset AND r<=5
 UNION ALL SELECT asset, 'risk', 'MOMENTUM_'||momentum FROM vr WHERE momentum IN ('UNSTABLE','DECLINING') UNION ALL SELECT asset, 'blocker', unnest(string_split(bk, ',')) FROM vr WHERE bk<>'' UNION ALL SELECT asset, 'coverage', 'COVERAGE' FROM vr""")
def verdict_reasons(t):
    return D.reasons(*decided(t))


@query("D21", f"WITH {VERDICT} SELECT ast.asset, vh.verdict, vh.verdict AS state, ast.verdict AS previous_state, vh.rank_score FROM ast JOIN vh ON vh.asset=ast.asset")
def applied_decisions(t):
    v, _, _ = decided(t)
    snap = t.assets().withColumn("state", F.col("verdict")).drop("rank_score")
    return D.apply_decision(snap, v).select("asset", "verdict", "state", "previous_state", "rank_score")


@query("D19", f"""WITH {VERDICT}, {PLACE}, x AS (SELECT pl.asset, pl.verdict AS from_verdict, vh.verdict AS to_verdict, seq%10=0 AS "primary", pl.verdict<>vh.verdict AS changed FROM pl JOIN vh ON vh.asset=pl.asset WHERE universe='LIVE' AND seq%10<2) SELECT * FROM x WHERE "primary" OR changed""")
def redecided(t):
    v, _, _ = decided(t)
    a = t.assets()
    return D.redecide(P.place(a, NOW), a.where("seq % 10 = 0"), a.where("seq % 10 = 1"), v)
