"""Evidence and screen queries: provider claims on events, provider feeds on parts and lines."""

from pyspark.sql import functions as F

from assetlens.functions.durable import cut
from assetlens.functions.scalar import HOUR_MS, fmt_age, fmt_usd
from assetlens.operators import evidence as E
from assetlens.operators import screen as G
from assetlens.plans.registry import query
from assetlens.plans.sqltext import AS, ASSET_NOW, CL, EV, half_up as hu
from assetlens.sources.tables import ASSET_NOW as NOW
from assetlens.sources.tables import millis

LAST = 1_706_659_200_000 - 27 * 86_400_000  # early in the tape, so that claims of every age occur

FRESH = "CASE {m} " + " ".join(f"WHEN '{m}' THEN {a}" for m, (a, b) in E.FRESHNESS.items()) + " END"
AGING = "CASE {m} " + " ".join(f"WHEN '{m}' THEN {b}" for m, (a, b) in E.FRESHNESS.items()) + " END"


def fresh_sql(m: str, at: str, now: int) -> str:
    f, a = FRESH.format(m=m), AGING.format(m=m)
    return f"CASE WHEN {at} IS NULL THEN 'UNKNOWN' WHEN {f} IS NULL THEN 'FRESH' WHEN {now}-{at}<={f} THEN 'FRESH' WHEN {now}-{at}<={a} THEN 'AGING' ELSE 'STALE' END"


def eq_sql(a: str, b: str) -> str:
    return (f"CASE WHEN metric='liquidityUsd' THEN CASE WHEN greatest({a},{b})=0 THEN true WHEN least({a},{b})=0 THEN false ELSE greatest({a},{b})/least({a},{b})<=3 END "
            f"WHEN metric='ageHours' THEN abs({a}-{b})<0.5 ELSE {a}={b} END")


def resolve_sql(src: str, now: int) -> str:
    """Resolution of a claims table by windows; defines ``res``."""
    auth = "metric IN ('mintAuthorityRevoked','freezeAuthorityRevoked')"
    return f"""r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset, metric, provider ORDER BY observed_at DESC, claim_id DESC) AS rn FROM {src}) WHERE rn=1),
 r2 AS (SELECT *, CASE provider WHEN 'dexscreener' THEN 0 WHEN 'rugcheck' THEN 1 WHEN 'jupiter' THEN 2 WHEN 'helius' THEN 3 ELSE 9 END AS ord,
  CASE provider WHEN 'helius' THEN 1.0::DOUBLE WHEN 'rugcheck' THEN 0.95::DOUBLE WHEN 'dexscreener' THEN 0.9::DOUBLE WHEN 'jupiter' THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS trust,
  {fresh_sql('metric', 'observed_at', now)} AS fr, value IS NOT NULL AND invalid IS NULL AND unavailable IS NULL AS ok FROM r1),
 r3 AS (SELECT *, ok AND fr<>'STALE' AS cur, CASE WHEN ok AND fr<>'STALE' THEN first_value(value) OVER (PARTITION BY asset, metric, ok AND fr<>'STALE' ORDER BY ord) END AS fv FROM r2),
 r4 AS (SELECT *, bool_or(cur AND NOT ({eq_sql('value', 'fv')})) OVER (PARTITION BY asset, metric) AS conflict FROM r3),
 r5 AS (SELECT *, CASE WHEN {auth} AND provider='helius' THEN 0 ELSE 1 END AS lead_, CASE WHEN metric='liquidityUsd' THEN value WHEN coalesce(conflict,false) AND metric='ageHours' THEN -value WHEN coalesce(conflict,false) AND {auth} THEN value WHEN coalesce(conflict,false) THEN 0 ELSE -trust END AS key_ FROM r4),
 r6 AS (SELECT *, row_number() OVER (PARTITION BY asset, metric, cur ORDER BY lead_, key_, ord) AS w FROM r5),
 win AS (SELECT * FROM r6 WHERE cur AND w=1),
 st1 AS (SELECT asset, metric, arg_max(provider, (observed_at, -ord)) AS provider, max(observed_at) AS oa FROM r6 WHERE ok AND NOT cur GROUP BY 1,2),
 bd AS (SELECT asset, metric, arg_min(provider, ord) AS provider, arg_min(observed_at, ord) AS oa FROM r6 WHERE invalid IS NOT NULL AND unavailable IS NULL GROUP BY 1,2),
 dn AS (SELECT asset, metric, arg_min(provider, ord) AS provider FROM r6 WHERE unavailable IS NOT NULL GROUP BY 1,2),
 ks AS (SELECT asset, metric, count(*) AS claims FROM r6 GROUP BY 1,2),
 ov AS (SELECT r6.asset, r6.metric, count(*) AS n, bool_or(r6.value=0) AS anyzero FROM r6 JOIN win USING (asset, metric) WHERE r6.ok AND r6.provider<>win.provider AND NOT ({eq_sql('r6.value', 'win.value')}) GROUP BY 1,2),
 res AS (SELECT ks.asset, ks.metric, CASE WHEN win.provider IS NOT NULL THEN CASE WHEN coalesce(win.conflict,false) THEN 'CONFLICTED' ELSE 'MEASURED' END WHEN st1.provider IS NOT NULL THEN 'STALE' WHEN bd.provider IS NOT NULL THEN 'INVALID' WHEN dn.provider IS NOT NULL THEN 'UNAVAILABLE' ELSE 'UNKNOWN' END AS state,
  win.value AS value, coalesce(win.provider, st1.provider, bd.provider, dn.provider) AS source, CASE WHEN win.provider IS NOT NULL THEN win.observed_at WHEN st1.provider IS NOT NULL THEN st1.oa ELSE bd.oa END AS observed_at,
  CASE WHEN win.provider IS NOT NULL THEN win.fr WHEN st1.provider IS NOT NULL THEN 'STALE' ELSE 'UNKNOWN' END AS freshness,
  CASE WHEN win.provider IS NOT NULL THEN floor(win.trust*(CASE WHEN coalesce(win.conflict,false) THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END*CASE WHEN win.fr='AGING' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END)*1000+0.5)/1000 ELSE 0.0::DOUBLE END AS confidence,
  claims, coalesce(ov.n,0) AS n_over, coalesce(ov.anyzero,false) AS over_zero
  FROM ks LEFT JOIN win USING (asset, metric) LEFT JOIN st1 USING (asset, metric) LEFT JOIN bd USING (asset, metric) LEFT JOIN dn USING (asset, metric) LEFT JOIN ov USING (asset, metric))"""


def show(e):
    return e.select("asset", "metric", "state", "value", "source", "observed_at", "freshness", "confidence", F.col("claims").cast("long").alias("claims"), F.size("overridden").cast("long").alias("n_over"))


R_COLS = "asset, metric, state, value, source, observed_at, freshness, confidence, claims, n_over"


@query("E01", f"WITH {CL} SELECT claim_id, {fresh_sql('metric', 'observed_at', LAST)} AS freshness FROM cl")
def claim_freshness(t):
    return t.claims().select("claim_id", E.freshness(F.col("metric"), F.col("observed_at"), LAST).alias("freshness"))


@query("E02", f"WITH {CL}, {resolve_sql('cl', LAST)} SELECT {R_COLS} FROM res")
def resolved_claims(t):
    return show(E.resolve_claims(t.claims(), LAST))


@query("E03", f"""WITH {CL}, {resolve_sql('cl', LAST)} SELECT asset, metric, CASE WHEN state IN ('INVALID','STALE','UNAVAILABLE','UNKNOWN') THEN lower(state) WHEN value IS NULL THEN 'unknown' WHEN freshness NOT IN ('FRESH','AGING') THEN 'stale' ELSE 'scorable' END AS reason FROM res""")
def claim_scorability(t):
    return E.scorability(E.resolve_claims(t.claims(), LAST)).select("asset", "metric", "reason")


# ---- feeds -----------------------------------------------------------------------------


def pairs(t):
    k, p = F.col("l_suppkey"), F.col("l_partkey")
    g = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("_c"), F.sum(F.col("l_quantity").cast("long")).alias("_q"),
        F.count_if(F.col("l_linestatus") == "O").alias("buys_h1"), F.count_if(F.col("l_linestatus") == "F").alias("sells_h1"), F.min(millis("l_shipdate")).alias("created_at"))
    return g.select(
        F.concat(F.lit("T"), p.cast("string")).alias("asset"), F.concat(F.lit("S"), k.cast("string")).alias("pool"), k.alias("position"), F.when(k % 7 != 0, F.col("_c") / 100.0).alias("liquidity"),
        F.when(k % 5 != 0, F.col("_q") * 3000.0).alias("volume24h"), "buys_h1", "sells_h1", (F.col("buys_h1") * 2).alias("buys_h24"), (F.col("sells_h1") * 2).alias("sells_h24"), F.lit(0.0).alias("m5"),
        (k % 50 - 25).cast("double").alias("h1"), F.when(k % 11 != 0, (k % 80 - 40).cast("double")).alias("h6"), F.lit(1.0).alias("h24"), "created_at", (k % 7 == 0).alias("liquidity_issue"), (F.lit(NOW) - (p % 120) * 60_000).alias("observed_at"))


def _part(t):
    return t.part.select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("asset"), F.col("p_partkey").alias("k"), F.col("p_size").alias("z"), "p_retailprice")


def info(t):
    k, z = F.col("k"), F.col("z")
    return _part(t).select(
        "asset", F.when(k % 9 != 0, z * 100.0).alias("holders"), (z * 2.0).alias("organic"), (F.col("p_retailprice") * (z % 7) * 40).alias("liquidity"), F.when(k % 10 != 0, k % 3 != 0).alias("mint_disabled"), (k % 4 != 0).alias("freeze_disabled"),
        F.when(k % 6 != 0, z * 2.0).alias("top_holders"), F.when(k % 5 != 0, F.lit(NOW) - z * HOUR_MS).alias("first_pool_at"),
        F.filter(F.array(F.when(k % 13 == 0, "liquidity"), F.when(k % 14 == 0, "holderCount"), F.when(k % 12 == 0, "audit.topHoldersPercentage")), lambda x: x.isNotNull()).alias("issues"), (F.lit(NOW) - (k % 100) * 1_000_000).alias("observed_at"))


def report(t):
    k = F.col("k")
    r = lambda n, lv: F.struct(F.lit(n).alias("name"), F.lit(lv).alias("level"))
    risks = (F.when(k % 5 == 0, F.array(r("Mint Authority still enabled", "danger"))).when(k % 5 == 1, F.array(r("Freeze Authority enabled", "warn"))).when(k % 5 == 2, F.array(r("Creator history of rugged tokens", "danger")))
             .when(k % 5 == 3, F.array(r("Low Liquidity", "warn"), r("Odd thing", "danger"))).otherwise(F.array().cast("array<struct<name:string,level:string>>")))
    return _part(t).select("asset", (k % 101).cast("double").alias("score"), F.when(k % 17 == 0, F.array(F.lit("score_normalised"))).otherwise(F.array().cast("array<string>")).alias("issues"), risks.alias("risks"), (F.lit(NOW) - (k % 40) * HOUR_MS).alias("observed_at"))


def mint(t):
    k = F.col("k")
    return _part(t).select("asset", (k % 2 == 0).alias("mint_stated"), F.when(k % 8 == 0, "AUTH").alias("mint_authority"), (k % 3 == 0).alias("freeze_stated"), F.when(k % 12 == 0, "AUTH").alias("freeze_authority"), (k % 4 == 1).alias("extensions_complete"),
                           (k % 3).alias("extension_count"), ((k % 80) / 100.0).alias("top10_share"), (F.lit(NOW) - (k % 30) * 6 * HOUR_MS).alias("observed_at"))


def feeds(t):
    return E.resolve_feeds(pairs(t), info(t), report(t), mint(t), NOW)


def _sel(metric: str, provider: str, value: str, inv: str = "NULL", cond: str = "true", src: str = "pt", at: str = "oa") -> str:
    return f"SELECT asset, '{metric}' AS metric, '{provider}' AS provider, CASE WHEN ({inv}) IS NULL THEN ({value})::DOUBLE END AS value, {at} AS observed_at, ({inv})::VARCHAR AS invalid, NULL::VARCHAR AS unavailable, 0 AS claim_id FROM {src} WHERE {cond}"


FEED = f"""px AS (SELECT 'T'||l_partkey AS asset, l_suppkey AS k, CASE WHEN l_suppkey%7<>0 THEN sum(CAST(round(l_extendedprice*100) AS BIGINT))/100.0::DOUBLE END AS liq, CASE WHEN l_suppkey%5<>0 THEN sum(CAST(l_quantity AS BIGINT))*3000.0::DOUBLE END AS vol,
  count(*) FILTER (l_linestatus='O') AS b, count(*) FILTER (l_linestatus='F') AS s, min(epoch_us(l_shipdate)//1000) AS cr, {ASSET_NOW}-(l_partkey%120)*60000 AS oa FROM lineitem GROUP BY l_partkey, l_suppkey),
 pg AS (SELECT asset, sum(liq) AS liq, sum(vol) AS vol, bool_or(k%7=0) AS iss, max(oa) AS oa, min(cr) AS cr, arg_max(k, (coalesce(liq,-1),-k)) AS bk, sum(b)::DOUBLE AS b, sum(s)::DOUBLE AS s FROM px GROUP BY 1),
 pt AS (SELECT 'T'||p_partkey AS asset, p_partkey AS k, p_size AS z, p_retailprice, {ASSET_NOW}-(p_partkey%100)*1000000 AS oi, {ASSET_NOW}-(p_partkey%40)*3600000 AS orp, {ASSET_NOW}-(p_partkey%30)*21600000 AS om FROM part),
 cx AS ({_sel('liquidityUsd', 'dexscreener', 'liq', "CASE WHEN liq IS NULL AND iss THEN 'x' END", src='pg')} UNION ALL {_sel('venueLiquidityUsd', 'dexscreener', 'liq', "CASE WHEN liq IS NULL AND iss THEN 'x' END", src='pg')} UNION ALL {_sel('volume24h', 'dexscreener', 'vol', src='pg')}
  UNION ALL {_sel('priceChange', 'dexscreener', '0.6::DOUBLE*(bk%50-25)+0.4::DOUBLE*(bk%80-40)', "CASE WHEN bk%11=0 THEN 'x' END", src='pg')} UNION ALL {_sel('buyPressure', 'dexscreener', 'CASE WHEN b+s>=10 THEN b/(b+s) WHEN 2*b+2*s>=10 THEN 2*b/(2*b+2*s) END', src='pg')} UNION ALL {_sel('ageHours', 'dexscreener', f'({ASSET_NOW}-cr)/3600000.0::DOUBLE', src='pg')}
  UNION ALL {_sel('liquidityUsd', 'jupiter', 'p_retailprice*(z%7)*40', "CASE WHEN k%13=0 THEN 'x' END", at='oi')} UNION ALL {_sel('holders', 'jupiter', 'CASE WHEN k%9<>0 THEN z*100.0 END', "CASE WHEN k%14=0 THEN 'x' END", at='oi')} UNION ALL {_sel('organicScore', 'jupiter', 'z*2.0', at='oi')}
  UNION ALL {_sel('ageHours', 'jupiter', 'z*3600000/3600000.0::DOUBLE', cond='k%5<>0', at='oi')} UNION ALL {_sel('mintAuthorityRevoked', 'jupiter', 'CASE WHEN k%10<>0 THEN CASE WHEN k%3<>0 THEN 1.0 ELSE 0.0 END END', at='oi')} UNION ALL {_sel('freezeAuthorityRevoked', 'jupiter', 'CASE WHEN k%4<>0 THEN 1.0 ELSE 0.0 END', at='oi')}
  UNION ALL {_sel('rugcheckRisk', 'rugcheck', 'k%101', "CASE WHEN k%17=0 THEN 'x' END", at='orp')} UNION ALL {_sel('mintAuthorityRevoked', 'rugcheck', '0.0', cond='k%5=0', at='orp')} UNION ALL {_sel('freezeAuthorityRevoked', 'rugcheck', '0.0', cond='k%5=1', at='orp')}
  UNION ALL {_sel('mintAuthorityRevoked', 'helius', 'CASE WHEN k%8=0 THEN 0.0 ELSE 1.0 END', cond='k%2=0', at='om')} UNION ALL {_sel('freezeAuthorityRevoked', 'helius', 'CASE WHEN k%12=0 THEN 0.0 ELSE 1.0 END', cond='k%3=0', at='om')} UNION ALL {_sel('mintExtensions', 'helius', 'k%3', cond='k%4=1', at='om')}
  UNION ALL {_sel('topHoldersPct', 'jupiter', 'z*2.0', cond='k%6<>0', at='oi')} UNION ALL {_sel('topHoldersPct', 'helius', '(k%80)/100.0::DOUBLE*100', cond='k%6=0', at='om')}),
 {resolve_sql('cx', ASSET_NOW)}, rz AS (SELECT * FROM res UNION ALL SELECT asset, 'tradable', CASE WHEN state IN ('MEASURED','CONFLICTED') THEN state ELSE 'UNKNOWN' END, CASE WHEN state IN ('MEASURED','CONFLICTED') THEN CASE WHEN coalesce(value,0)>0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END,
  CASE WHEN state IN ('MEASURED','CONFLICTED') THEN source END, CASE WHEN state IN ('MEASURED','CONFLICTED') THEN observed_at END, CASE WHEN state IN ('MEASURED','CONFLICTED') THEN freshness ELSE 'UNKNOWN' END, CASE WHEN state IN ('MEASURED','CONFLICTED') THEN confidence ELSE 0.0::DOUBLE END, 0, 0, false FROM res WHERE metric='liquidityUsd')"""


@query("E04 E05 E06 E07 E08 E09 E10 E11", f"WITH {FEED} SELECT {R_COLS} FROM rz")
def resolved_feeds(t):
    return show(feeds(t))


@query("E12", f"WITH {FEED} SELECT asset, bool_or(metric IN ('mintAuthorityRevoked','freezeAuthorityRevoked') AND over_zero) AS historical_danger FROM rz GROUP BY 1")
def historical_danger(t):
    return E.historical_danger(feeds(t))


FIND = f"""fz AS (SELECT asset, k, unnest(CASE k%5 WHEN 0 THEN ['Mint Authority still enabled|danger'] WHEN 1 THEN ['Freeze Authority enabled|warn'] WHEN 2 THEN ['Creator history of rugged tokens|danger'] WHEN 3 THEN ['Low Liquidity|warn','Odd thing|danger'] ELSE []::VARCHAR[] END) AS nl, orp FROM pt),
 fy AS (SELECT asset, split_part(nl,'|',1) AS name, split_part(nl,'|',2) AS level, orp AS observed_at, {fresh_sql("'rugcheckRisk'", 'orp', ASSET_NOW)} AS freshness FROM fz),
 fa AS (SELECT asset, max(CASE WHEN metric='mintAuthorityRevoked' AND state IN ('MEASURED','CONFLICTED') THEN value END) AS ma, max(CASE WHEN metric='freezeAuthorityRevoked' AND state IN ('MEASURED','CONFLICTED') THEN value END) AS fa FROM rz GROUP BY 1),
 fc AS (SELECT fy.*, CASE WHEN name LIKE 'Creator%' THEN 'HISTORICAL' WHEN name='Odd thing' THEN 'UNKNOWN_NATURE' ELSE 'CURRENT_STATE' END AS nature, ma, fa FROM fy LEFT JOIN fa ON fy.asset=fa.asset),
 fd AS (SELECT *, CASE WHEN nature='UNKNOWN_NATURE' THEN 'unknown_nature' WHEN nature='CURRENT_STATE' AND freshness NOT IN ('FRESH','AGING') THEN 'stale' WHEN (name LIKE 'Mint A%' AND ma=1) OR (name LIKE 'Freeze A%' AND fa=1) THEN 'contradicted' END AS suppressed FROM fc)"""


def findings(t, e=None):
    f = report(t).select("asset", "observed_at", F.explode("risks").alias("r")).select("asset", "observed_at", "r.*")
    return E.classify_findings(f, feeds(t) if e is None else e, NOW)


@query("E13", f"WITH {FEED}, {FIND} SELECT asset, name, level, nature, freshness, suppressed, suppressed IS NULL AS scorable FROM fd")
def risk_findings(t):
    return findings(t).select("asset", "name", "level", "nature", "freshness", "suppressed", "scorable")


WEIGHT = "CASE metric " + " ".join(f"WHEN '{m}' THEN {w}::DOUBLE" for m, w in E.WEIGHTS.items()) + " ELSE 0.0::DOUBLE END"


@query("E14", f"WITH {FEED} SELECT asset, metric, state, {WEIGHT} AS weight FROM rz")
def evidence_ledger(t):
    return E.evidence_ledger(feeds(t)).select("asset", "metric", "state", "weight")


COVER = f"""lz AS (SELECT *, {WEIGHT} AS weight, state IN ('MEASURED','CONFLICTED') AND value IS NOT NULL AS u FROM rz), ly AS (SELECT * FROM lz WHERE weight>0),
 lp AS (SELECT asset, source, sum(CASE WHEN u THEN CAST(weight AS DECIMAL(6,3)) ELSE 0 END) AS w, sum(CASE WHEN u THEN CAST(weight AS DECIMAL(6,3))*CAST(confidence AS DECIMAL(6,3)) ELSE 0 END) AS wc FROM ly GROUP BY 1,2),
 lc AS (SELECT asset, count(*) FILTER (state='MEASURED') AS measured, count(*) FILTER (state='CONFLICTED') AS conflicted, count(*) FILTER (state='INVALID') AS invalid, count(*) FILTER (state='STALE') AS stale, count(*) FILTER (state='UNAVAILABLE') AS unavailable, count(*) FILTER (state<>'UNKNOWN') AS k FROM ly GROUP BY 1),
 lt2 AS (SELECT asset, sum(w)::DOUBLE AS w, sum(wc)::DOUBLE AS wc, max((w::DOUBLE, coalesce(source,''))) AS top FROM lp GROUP BY 1),
 lv AS (SELECT *, CASE WHEN w>0 THEN top[1]/w ELSE 0.0 END AS sh, CASE WHEN w>0 THEN wc/w ELSE 0.0 END AS mn FROM lt2),
 cov AS (SELECT lc.asset, measured, conflicted, invalid, stale, unavailable, 13-k AS unknown, {hu('w/1.052', 3)} AS coverage, {hu('greatest(0.0, mn*(1-0.25::DOUBLE*greatest(0.0,sh-0.5)*2))', 3)} AS confidence, {hu('sh', 3)} AS provider_concentration, CASE WHEN w>0 THEN top[2] END AS dominant_provider FROM lc JOIN lv ON lc.asset=lv.asset)"""


@query("E15", f"WITH {FEED}, {COVER} SELECT * FROM cov")
def coverage_report(t):
    return E.coverage_report(E.evidence_ledger(feeds(t)))


@query("E16", f"WITH {FEED} SELECT asset, metric FROM rz WHERE state='CONFLICTED' AND metric<>'tradable'")
def conflicted_metrics(t):
    return E.conflicts(feeds(t)).where("metric <> 'tradable'")


@query("E17", f"""WITH {EV}, p AS (SELECT 'S'||s_suppkey AS provider, s_acctbal>0 AS configured FROM supplier), f AS (SELECT DISTINCT 'S'||user_id AS provider FROM ev WHERE event_type='error' AND k<30) SELECT p.provider, CASE WHEN NOT configured THEN 'OFF' WHEN f.provider IS NOT NULL THEN 'DEGRADED' ELSE 'ON' END AS state FROM p LEFT JOIN f ON p.provider=f.provider""")
def capability_state(t):
    p = t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("provider"), (F.col("s_acctbal") > 0).alias("configured"))
    return E.capability_state(p, t.event_facts().where("event_type = 'error' AND k < 30").select(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("provider")))


@query("E18", f"""WITH {EV}, l AS (SELECT 'p'||(k%4) AS provider, CASE k%10 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 END AS status, CASE k%10 WHEN 3 THEN 'TimeoutError' WHEN 4 THEN 'SyntaxError' WHEN 5 THEN 'TypeError' ELSE 'Error' END AS name,
  CASE k%10 WHEN 5 THEN 'fetch failed' WHEN 6 THEN 'ECONNRESET by peer' WHEN 7 THEN 'Request aborted' WHEN 8 THEN 'Unexpected token in JSON' ELSE 'odd' END AS message, event_id FROM ev),
 c AS (SELECT *, CASE WHEN status=429 THEN 'RATE_LIMITED' WHEN status>=500 THEN 'PROVIDER_UNAVAILABLE' WHEN status IS NOT NULL THEN 'INVALID_RESPONSE' WHEN name='TimeoutError' OR message LIKE '%aborted%' THEN 'TIMEOUT' WHEN name='SyntaxError' OR message LIKE '%JSON%' THEN 'INVALID_RESPONSE' WHEN name='TypeError' OR message LIKE 'ECONN%' THEN 'NETWORK_ERROR' ELSE 'UNKNOWN' END AS kind FROM l)
 SELECT provider, kind, kind IN ('TIMEOUT','RATE_LIMITED','NETWORK_ERROR','PROVIDER_UNAVAILABLE') AS retryable, count(*) AS n FROM c GROUP BY 1,2,3""")
def failure_kinds(t):
    k = F.col("k") % 10
    log = t.event_facts().select(F.concat(F.lit("p"), (F.col("k") % 4).cast("string")).alias("provider"), F.when(k == 0, 429).when(k == 1, 503).when(k == 2, 404).alias("status"),
                                 F.when(k == 3, "TimeoutError").when(k == 4, "SyntaxError").when(k == 5, "TypeError").otherwise("Error").alias("name"),
                                 F.when(k == 5, "fetch failed").when(k == 6, "ECONNRESET by peer").when(k == 7, "Request aborted").when(k == 8, "Unexpected token in JSON").otherwise("odd").alias("message"))
    return E.classify_failures(log).groupBy("provider", "kind", "retryable").agg(F.count("*").alias("n"))


@query("E19", f"""WITH {CL}, {resolve_sql('cl', LAST)}, x AS (SELECT asset, metric FROM res), l AS (SELECT * FROM x WHERE CAST(substr(asset,2) AS INT)%3<>0) SELECT asset, metric, 'ledger' AS origin FROM l UNION ALL SELECT asset, metric, 'stored' FROM x WHERE asset NOT IN (SELECT asset FROM l)""")
def evidence_rows(t):
    e = E.resolve_claims(t.claims(), LAST).select("asset", "metric")
    return E.evidence_rows(e.where(F.expr("cast(substring(asset, 2) as int) % 3 <> 0")), e)


# ---- screen ----------------------------------------------------------------------------

METRICS = ["liquidityUsd", "venueLiquidityUsd", "volume24h", "priceChange", "buyPressure", "holders", "ageHours", "mintAuthorityRevoked", "freezeAuthorityRevoked", "topHoldersPct", "rugcheckRisk", "organicScore", "tradable"]


def accounts(t):
    k = F.col("k")
    x = lambda n, s: F.struct(F.lit(n).alias("extension"), (F.lit(s) if isinstance(s, str) or s is None else s).cast("string").alias("state"))
    fee = F.concat(F.lit('{"newerTransferFee":{"transferFeeBasisPoints":'), (k % 100 * 100).cast("string"), F.lit('},"olderTransferFee":{"transferFeeBasisPoints":10}}'))
    ext = F.filter(F.array(
        F.when(k % 6 == 0, x("permanentDelegate", '{"delegate":"Abc"}')), F.when(k % 6 == 1, x("permanentDelegate", '{"delegate":null}')), F.when(k % 7 == 0, x("pausableConfig", '{"paused":true}')),
        F.when(k % 8 == 0, x("defaultAccountState", '{"accountState":"Frozen"}')), F.when(k % 9 == 0, x("transferHook", "{}")), F.when(k % 5 == 0, x("transferFeeConfig", fee)), F.when(k % 4 == 0, x("metadataPointer", None)),
        F.when(k % 10 == 3, x("unparseableExtension", None)), F.when(k % 11 == 0, x("somethingNew", None))), lambda e: e.isNotNull())
    return _part(t).select("asset", ext.alias("extensions"))


EXT = """ex0 AS (SELECT 'T'||p_partkey AS asset, p_partkey AS k FROM part), ext AS (
 SELECT asset, 'permanentdelegate' AS id, 'HARD_VETO' AS policy, k%6=0 AS active, NULL::DOUBLE AS magnitude, 'PERMANENT_DELEGATE_ACTIVE' AS code FROM ex0 WHERE k%6<2 UNION ALL SELECT asset, 'pausableconfig', 'HARD_VETO', true, NULL, 'MINT_PAUSABLE' FROM ex0 WHERE k%7=0
 UNION ALL SELECT asset, 'defaultaccountstate', 'HARD_VETO', true, NULL, 'DEFAULT_ACCOUNT_STATE_FROZEN' FROM ex0 WHERE k%8=0 UNION ALL SELECT asset, 'transferhook', 'HARD_VETO', NULL, NULL, 'TRANSFER_HOOK_ACTIVE' FROM ex0 WHERE k%9=0
 UNION ALL SELECT asset, 'transferfeeconfig', 'CONDITIONAL_VETO', true, greatest(k%100*100,10)::DOUBLE, 'EXTREME_TRANSFER_FEE' FROM ex0 WHERE k%5=0 UNION ALL SELECT asset, 'metadatapointer', 'INFORMATIONAL', true, NULL, NULL FROM ex0 WHERE k%4=0
 UNION ALL SELECT asset, 'unparseableextension', 'UNKNOWN_POLICY', NULL, NULL, NULL FROM ex0 WHERE k%10=3 UNION ALL SELECT asset, 'somethingnew', 'UNKNOWN_POLICY', NULL, NULL, NULL FROM ex0 WHERE k%11=0)"""


def extensions(t):
    return G.flatten_extensions(accounts(t), G.extension_rules(t.spark))


@query("S15 G01", f"WITH {EXT} SELECT * FROM ext")
def extension_list(t):
    return extensions(t).select("asset", "id", "policy", "active", "magnitude", "code")


@query("S15", f"WITH {EXT} SELECT asset, bool_and(policy<>'UNKNOWN_POLICY') AS complete, count(*) AS extensions FROM ext GROUP BY 1")
def extension_completeness(t):
    return G.extensions_complete(extensions(t))


EXG = "exg AS (SELECT asset, code FROM ext WHERE active AND code IS NOT NULL AND (policy='HARD_VETO' OR (policy='CONDITIONAL_VETO' AND magnitude>=5000)))"


@query("G02", f"WITH {EXT}, {EXG} SELECT * FROM exg")
def extension_gate(t):
    return G.extension_gate(extensions(t)).select("asset", "code")


WIDE = "wd AS (SELECT asset, " + ", ".join(
    f"max(CASE WHEN metric='{m}' AND state IN ('MEASURED','CONFLICTED') THEN value END) AS {m}, coalesce(bool_or(metric='{m}' AND state IN ('MEASURED','CONFLICTED') AND value IS NOT NULL AND freshness IN ('FRESH','AGING')),false) AS {m}_c, max(CASE WHEN metric='{m}' THEN source END) AS {m}_s" for m in METRICS) + " FROM rz GROUP BY 1)"
BASEG = """bg AS (SELECT asset, unnest(list_filter([CASE WHEN mintAuthorityRevoked_c AND mintAuthorityRevoked=0 THEN 'AUTHORITY_MINT_ACTIVE' END, CASE WHEN freezeAuthorityRevoked_c AND freezeAuthorityRevoked=0 THEN 'AUTHORITY_FREEZE_ACTIVE' END, CASE WHEN tradable_c AND tradable=0 THEN 'UNTRADEABLE' END,
  CASE WHEN liquidityUsd_c AND liquidityUsd>0 AND liquidityUsd<20000 THEN 'LIQUIDITY_TOO_LOW' END, CASE WHEN topHoldersPct_c AND topHoldersPct_s='jupiter' AND topHoldersPct>=90 THEN 'CATASTROPHIC_CONCENTRATION' END], lambda x: x IS NOT NULL)) AS code FROM wd)"""
FLOOR = 20_000


def wide(t, e=None):
    return E.wide(feeds(t) if e is None else e, METRICS)


@query("G03", f"WITH {FEED}, {WIDE}, {BASEG} SELECT * FROM bg")
def base_gate(t):
    return G.base_gate(wide(t), FLOOR).select("asset", "code")


@query("G04", f"WITH {FEED}, {FIND} SELECT asset, 'CRITICAL_RUGCHECK' AS code FROM fy WHERE level='danger' AND lower(name) LIKE '%rugged%'")
def report_gate(t):
    f = report(t).select("asset", F.explode("risks").alias("r")).select("asset", "r.*")
    return G.report_gate(f).select("asset", "code")


@query("G05", "SELECT 'T'||p_partkey AS asset, 'MALFORMED_TOKEN' AS code FROM part WHERE p_partkey%13=0")
def malformed_gate(t):
    return G.malformed_gate(info(t).select("asset", F.explode("issues").alias("field"))).select("asset", "code")


def sc(x: str) -> str:
    return f"least(1.0::DOUBLE,greatest(0.0::DOUBLE,{x}))"


def logb(x: str, lo: int, hi: int) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x}<=0 THEN 0.0::DOUBLE ELSE {sc(f'(log10({x})-log10({lo}.0))/(log10({hi}.0)-log10({lo}.0))')} END"


SP = [("mintAuthorityRevoked", 0.3, "mintAuthorityRevoked"), ("freezeAuthorityRevoked", 0.2, "freezeAuthorityRevoked"), ("topHoldersPct", 0.2, f"(1-{sc('(topHoldersPct-10)/60')})"), ("rugcheckRisk", 0.2, f"(1-{sc('rugcheckRisk/100')})"), ("organicScore", 0.1, sc("organicScore/100"))]
SCORE = f"""sc1 AS (SELECT *, {'+'.join(f'CASE WHEN {m} IS NOT NULL THEN {w}::DOUBLE*{v} ELSE 0.0::DOUBLE END' for m, w, v in SP)} AS earned, {'+'.join(f'CASE WHEN {m} IS NOT NULL THEN {w}::DOUBLE ELSE 0.0::DOUBLE END' for m, w, v in SP)} AS scov,
  volume24h IS NOT NULL AND venueLiquidityUsd IS NOT NULL AND volume24h_s=venueLiquidityUsd_s AS same FROM wd),
 sc2 AS (SELECT *, CASE WHEN scov>0 THEN {sc('earned')} END AS safety, {logb('liquidityUsd', 5000, 500000)} AS liquidity, CASE WHEN same THEN CASE WHEN venueLiquidityUsd>0 THEN volume24h/venueLiquidityUsd ELSE 0 END END AS turnover, {logb('holders', 50, 5000)} AS holders_score,
  {sc('0.5+(1-2/(exp(2*(priceChange/60))+1))/2')} AS mom0, {sc('(buyPressure-0.35)/0.3')} AS pr0 FROM sc1),
 sc3 AS (SELECT *, CASE WHEN turnover IS NULL THEN NULL WHEN turnover>0 THEN {sc('exp(-0.5*pow((log10(turnover)-log10(3.0))/0.65,2))')} ELSE 0.0 END AS activity, CASE WHEN priceChange IS NOT NULL THEN mom0 END AS momentum, CASE WHEN buyPressure IS NOT NULL THEN pr0 END AS pressure, CASE WHEN ageHours>0 THEN {sc('exp(-0.5*pow((log10(ageHours)-log10(12.0))/0.75,2))')} END AS age FROM sc2)"""


def scored(t, e=None):
    return G.score_components(wide(t, e))


@query("G06", f"WITH {FEED}, {WIDE}, {SCORE} SELECT asset, safety, scov AS safety_coverage FROM sc3")
def safety_component(t):
    return G.safety_component(wide(t)).select("asset", "safety", "safety_coverage")


@query("G07", f"WITH {FEED}, {WIDE}, {SCORE} SELECT asset, safety, liquidity, activity, holders_score, momentum, pressure, age FROM sc3")
def score_components(t):
    return scored(t).select("asset", "safety", "liquidity", "activity", "holders_score", "momentum", "pressure", "age")


def flagged(t):
    e = cut(feeds(t))  # the resolved evidence is a stored table; four steps below read it
    k = F.col("k")
    extra = _part(t).select("asset", (k % 3 != 0).alias("has_socials"), (k % 21 == 0).alias("verified"), F.when(k % 25 == 0, 0.9).alias("impersonation"))
    issues = info(t).select("asset", F.size("issues").alias("issues"))
    conf = E.conflicts(e).where("metric <> 'tradable'").groupBy("asset").agg(F.array_sort(F.collect_set("metric")).alias("conflicts"))
    fs = findings(t, e).where("level IN ('danger', 'warn')").groupBy("asset").agg(F.array_sort(F.collect_set("name")).alias("findings"), F.count_if(F.col("scorable") & (F.col("level") == "danger")).alias("danger_findings"))
    j = scored(t, e).join(extra, "asset", "left").join(issues, "asset", "left").join(conf, "asset", "left").join(fs, "asset", "left")
    return G.risk_flags(j, FLOOR)


FLAGS = f"""fl0 AS (SELECT sc3.*, pt.k, (pt.k%13=0)::INT+(pt.k%14=0)::INT+(pt.k%12=0)::INT AS iss, (SELECT list_sort(list(metric)) FROM rz WHERE rz.asset=sc3.asset AND state='CONFLICTED' AND metric<>'tradable') AS cfl, (SELECT list_sort(list(DISTINCT name)) FROM fd WHERE fd.asset=sc3.asset) AS fnm,
  (SELECT count(*) FROM fd WHERE fd.asset=sc3.asset AND suppressed IS NULL AND level='danger') AS dng FROM sc3 LEFT JOIN pt ON pt.asset=sc3.asset),
 fl1 AS (SELECT *, (safety IS NULL OR liquidity IS NULL OR activity IS NULL OR holders_score IS NULL OR momentum IS NULL OR pressure IS NULL OR age IS NULL) AS inc FROM fl0),
 fl2 AS (SELECT *, list_filter([CASE WHEN mintAuthorityRevoked_c AND mintAuthorityRevoked=0 THEN 'mint_authority' END, CASE WHEN freezeAuthorityRevoked_c AND freezeAuthorityRevoked=0 THEN 'freeze_authority' END, CASE WHEN topHoldersPct_c AND topHoldersPct>=60 THEN 'concentration' END, CASE WHEN liquidityUsd_c AND liquidityUsd<20000 THEN 'thin_liquidity' END,
  CASE WHEN turnover>50 AND liquidityUsd<100000 AND venueLiquidityUsd>0 THEN 'wash_suspect' END, CASE WHEN iss>0 THEN 'provider_data_rejected' END, CASE WHEN inc THEN 'incomplete_evidence' END, CASE WHEN NOT coalesce(k%3<>0,false) THEN 'no_socials' END, CASE WHEN k%25=0 THEN 'impersonation_suspected' END, CASE WHEN k%21=0 THEN 'verified' END], lambda x: x IS NOT NULL)
  || list_transform(coalesce(cfl,[]), lambda x: 'provider_conflict:'||x) || list_transform(coalesce(fnm,[]), lambda x: 'rugcheck:'||replace(lower(x),' ','_')) AS flags FROM fl1)"""


@query("G08", f"WITH {FEED}, {FIND}, {WIDE}, {SCORE}, {FLAGS} SELECT asset, array_to_string(flags, ',') AS flags FROM fl2")
def risk_flags(t):
    return flagged(t).select("asset", F.array_join("flags", ",").alias("flags"))


TOTAL = f"""tt0 AS (SELECT *, (coalesce(safety,0)*0.26::DOUBLE+coalesce(liquidity,0)*0.18::DOUBLE+coalesce(activity,0)*0.14::DOUBLE+coalesce(holders_score,0)*0.13::DOUBLE+coalesce(momentum,0)*0.12::DOUBLE+coalesce(pressure,0)*0.09::DOUBLE+coalesce(age,0)*0.08::DOUBLE)*100 AS b0,
  scov*0.26::DOUBLE+(liquidity IS NOT NULL)::INT*0.18::DOUBLE+(activity IS NOT NULL)::INT*0.14::DOUBLE+(holders_score IS NOT NULL)::INT*0.13::DOUBLE+(momentum IS NOT NULL)::INT*0.12::DOUBLE+(pressure IS NOT NULL)::INT*0.09::DOUBLE+(age IS NOT NULL)::INT*0.08::DOUBLE AS c0,
  greatest(0.1::DOUBLE,(CASE WHEN list_contains(flags,'mint_authority') THEN 0.55::DOUBLE ELSE 1.0 END)*(CASE WHEN list_contains(flags,'freeze_authority') THEN 0.45::DOUBLE ELSE 1.0 END)*(CASE WHEN list_contains(flags,'concentration') THEN 0.7::DOUBLE ELSE 1.0 END)*(CASE WHEN list_contains(flags,'thin_liquidity') THEN 0.65::DOUBLE ELSE 1.0 END)*(CASE WHEN list_contains(flags,'wash_suspect') THEN 0.8::DOUBLE ELSE 1.0 END)*pow(0.85::DOUBLE,dng)) AS m0 FROM fl2),
 tt AS (SELECT asset, {hu('b0*m0', 1)} AS total, {hu('b0', 1)} AS base, CASE WHEN b0*m0>=75 THEN 'A' WHEN b0*m0>=60 THEN 'B' WHEN b0*m0>=45 THEN 'C' WHEN b0*m0>=30 THEN 'D' ELSE 'F' END AS grade, {hu('(1-m0)*100', 1)} AS penalty, {hu('c0', 3)} AS score_coverage, {hu('c0*100', 1)} AS ceiling FROM tt0)"""


@query("G09", f"WITH {FEED}, {FIND}, {WIDE}, {SCORE}, {FLAGS}, {TOTAL} SELECT * FROM tt")
def score_totals(t):
    return G.score_total(flagged(t)).select("asset", "total", "base", "grade", "penalty", "score_coverage", "ceiling")


def vetoes(t):
    f = report(t).select("asset", F.explode("risks").alias("r")).select("asset", "r.*")
    return G.base_gate(wide(t), FLOOR).unionByName(G.extension_gate(extensions(t))).unionByName(G.report_gate(f)).unionByName(G.malformed_gate(info(t).select("asset", F.explode("issues").alias("field"))))


@query("G10", f"""WITH {FEED}, {WIDE}, {BASEG}, {COVER}, v AS (SELECT asset, count(*) AS n FROM bg GROUP BY 1) SELECT cov.asset, CASE WHEN n>0 THEN 'REJECTED' WHEN coverage<0.35 THEN 'INSUFFICIENT_DATA' WHEN coverage<0.6 THEN 'WATCH' ELSE 'QUALIFIED' END AS eligibility FROM cov LEFT JOIN v ON cov.asset=v.asset""")
def screen_eligibility(t):
    e = cut(feeds(t))
    v = G.base_gate(wide(t, e), FLOOR).groupBy("asset").agg(F.count("*").alias("n"))
    c = E.coverage_report(E.evidence_ledger(e)).join(v, "asset", "left")
    return c.select("asset", G.screen_eligibility(F.coalesce("n", F.lit(0)), F.col("coverage")).alias("eligibility"))


@query("G11", f"WITH {AS} SELECT asset, coalesce(verdict, CASE WHEN seq%2=0 THEN 'DISCOVERED' END) AS state FROM ast WHERE verdict IS NOT NULL OR seq%2=0")
def settled_state(t):
    s = F.col("seq")
    a = t.assets().where((F.col("verdict").isNotNull()) | (s % 2 == 0))
    prev = F.when(s % 2 == 0, "DISCOVERED").when(s % 3 == 0, "WATCH")
    return a.select("asset", G.settle_state(prev, F.col("verdict")).alias("state"))


@query("H19", f"WITH {FEED}, {WIDE}, {BASEG} SELECT code, count(*) AS n FROM bg GROUP BY 1")
def veto_counts(t):
    from assetlens.operators.history import veto_counts as vc

    return vc(G.base_gate(wide(t), FLOOR))


@query("H16 text", f"""WITH {AS} SELECT asset, CASE WHEN liquidity IS NULL THEN '-' WHEN liquidity>=1e6 THEN '$'||printf('%.2f', floor(liquidity/1e6*100+0.5)/100)||'M' WHEN liquidity>=1e3 THEN '$'||printf('%.1f', floor(liquidity/1e3*10+0.5)/10)||'K' ELSE '$'||printf('%.2f', floor(liquidity*100+0.5)/100) END AS usd,
 CASE WHEN age_hours IS NULL THEN '-' WHEN age_hours<1 THEN CAST(CAST(floor(age_hours*60+0.5) AS BIGINT) AS VARCHAR)||'m' WHEN age_hours<48 THEN printf('%.1f', floor(age_hours*10+0.5)/10)||'h' ELSE printf('%.1f', floor(age_hours/24*10+0.5)/10)||'d' END AS age FROM ast""")
def display_text(t):
    return t.assets().select("asset", fmt_usd("liquidity").alias("usd"), fmt_age("age_hours").alias("age"))
