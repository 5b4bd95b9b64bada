"""Shared common table expressions for the check SQL: the same tapes, stated in ANSI SQL."""

EV = """ev AS (SELECT event_id, user_id, event_type, value, CAST(props->>'k' AS INTEGER) AS k,
  (epoch_us(ts)//1000) AS at_ms, CAST(round(value*100) AS BIGINT) AS cents FROM events)"""

ACT = EV + """, act AS (SELECT CAST(event_id AS VARCHAR) AS tx_id, 'W'||user_id AS wallet, 'A'||(k%10) AS asset,
  'P'||(k%3) AS pool,
  CASE WHEN event_type IN ('purchase','signup') THEN 'BUY' WHEN event_type IN ('click','view') THEN 'SELL' END AS side,
  cents*(k%5+1) AS token_amount, cents AS quote_amount,
  CASE WHEN k%7=0 THEN 'STABLE' ELSE 'NATIVE' END AS quote_asset,
  at_ms//60000 AS slot, event_id AS tx_index, at_ms AS block_time,
  CASE WHEN event_type='error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CASE WHEN event_type='error' THEN 'FAILED' ELSE 'SWAP' END AS kind FROM ev)"""

TR = ACT + ", tr AS (SELECT * FROM act WHERE status='SUCCESS')"

LT = """lt AS (SELECT l_orderkey||'-'||l_linenumber AS tx_id, 'C'||o_custkey AS wallet, 'T'||l_partkey AS asset,
  'S'||l_suppkey AS pool, CASE WHEN l_linestatus='O' THEN 'BUY' ELSE 'SELL' END AS side,
  CAST(l_quantity AS BIGINT) AS token_amount, CAST(round(l_extendedprice*100) AS BIGINT) AS quote_amount,
  (epoch_us(l_shipdate)//1000)//86400000 AS slot, (epoch_us(l_shipdate)//1000) AS block_time
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"""

LA = """la AS (SELECT 'T'||o_orderkey AS asset, 'C'||o_custkey AS creator, (epoch_us(o_orderdate)//1000) AS launch_time FROM orders)"""

CL = EV + """, cl AS (SELECT 'U'||user_id AS asset,
  CASE k%5 WHEN 0 THEN 'liquidityUsd' WHEN 1 THEN 'holders' WHEN 2 THEN 'priceChange' WHEN 3 THEN 'organicScore' ELSE 'ageHours' END AS metric,
  CASE event_id%5 WHEN 0 THEN 'helius' WHEN 1 THEN 'rugcheck' WHEN 2 THEN 'dexscreener' WHEN 3 THEN 'jupiter' ELSE 'other' END AS provider,
  CASE WHEN event_type IN ('click','error') THEN NULL ELSE value END AS value, at_ms AS observed_at,
  CASE WHEN event_type='click' THEN 'failed validation' END AS invalid,
  CASE WHEN event_type='error' THEN 'TIMEOUT' END AS unavailable, event_id AS claim_id FROM ev)"""

MK = """mk AS (SELECT asset, observed_at, pool, holders, CAST(c AS DOUBLE)/100.0/CAST(q AS DOUBLE) AS price, CAST(c AS DOUBLE)/100.0 AS liquidity FROM (
  SELECT 'T'||l_partkey AS asset, (epoch_us(l_shipdate)//1000) AS observed_at, min('S'||l_suppkey) AS pool, count(*) AS holders,
  sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS c, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1,2))"""

VD = EV + """, vd AS (SELECT 'U'||user_id AS asset, at_ms AS observed_at,
  CASE event_type WHEN 'purchase' THEN 'HIGH_POTENTIAL' WHEN 'signup' THEN 'QUALIFIED' WHEN 'view' THEN 'WATCH' WHEN 'click' THEN 'HIGH_RISK' ELSE 'REJECTED' END AS verdict,
  k*1.0::DOUBLE AS score, k/100.0::DOUBLE AS coverage, value AS price, value*100 AS liquidity, event_id AS seq FROM ev)"""

TIER = "CASE {v} WHEN 'HIGH_POTENTIAL' THEN 0 WHEN 'QUALIFIED' THEN 1 WHEN 'WATCH' THEN 2 WHEN 'INSUFFICIENT_DATA' THEN 3 WHEN 'HIGH_RISK' THEN 4 WHEN 'REJECTED' THEN 5 END"


def tier(v: str) -> str:
    return TIER.format(v=v)


def half_up(x: str, digits: int) -> str:
    s = 10**digits
    return f"(floor(({x})*{s}.0::DOUBLE+0.5)/{s}.0::DOUBLE)"


def sig3(x: str) -> str:
    unit = f"CAST(pow(10, greatest(length(CAST({x} AS VARCHAR))-3,0)) AS BIGINT)"
    return f"((({x}) + {unit}//2)//{unit}*{unit})"

ASSET_NOW = 1_000_000_000_000
AS = f"""ast AS (SELECT 'T'||o_orderkey AS asset, o_orderpriority AS symbol, 'C'||o_custkey AS name,
  CASE o_orderkey%7 WHEN 0 THEN 'HIGH_POTENTIAL' WHEN 1 THEN 'QUALIFIED' WHEN 2 THEN 'WATCH' WHEN 3 THEN 'INSUFFICIENT_DATA' WHEN 4 THEN 'HIGH_RISK' WHEN 5 THEN 'REJECTED' END AS verdict,
  {ASSET_NOW}-(o_custkey%180)*60000 AS at_ms, floor(o_totalprice/500+0.5)/10 AS score,
  CASE WHEN o_orderkey%7<>5 AND o_orderkey%5<>0 THEN floor(o_totalprice/500+0.5)/10-5 END AS rank_score,
  CASE WHEN o_orderkey%11<>0 THEN o_totalprice END AS liquidity, CASE WHEN o_orderkey%13<>0 THEN (o_orderkey%1000)::DOUBLE END AS age_hours,
  CASE WHEN o_orderkey%17<>0 THEN (o_orderkey%200-100)::DOUBLE END AS change1h, CASE WHEN o_orderkey%19<>0 THEN 'S'||(o_orderkey%50) END AS pool,
  epoch_us(o_orderdate)//1000 AS launched_at, o_orderkey AS seq FROM orders)"""
PLACE = f"""pl AS (SELECT *, CASE WHEN verdict IS NULL THEN 'UNEVALUATED' WHEN greatest(0,{ASSET_NOW}-at_ms)>5400000 THEN 'STALE' ELSE 'LIVE' END AS universe,
  CASE WHEN verdict IS NULL OR greatest(0,{ASSET_NOW}-at_ms)>5400000 THEN NULL WHEN greatest(0,{ASSET_NOW}-at_ms)<=1800000 THEN 'FRESH' ELSE 'AGING' END AS freshness FROM ast)"""
