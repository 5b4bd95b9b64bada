"""Wash-trading and wallet-behaviour queries over the event tape."""

from pyspark.sql import functions as F

from assetlens.functions.durable import cut
from assetlens.functions.scalar import half_up
from assetlens.operators import behaviour as B
from assetlens.operators import graph as N
from assetlens.operators import wash as W
from assetlens.plans.registry import query
from assetlens.plans.sqltext import ACT, LA, LT, TR, half_up as hu, sig3

SIZES = f"""use AS (SELECT quote_asset||':'||{sig3('quote_amount')} AS size, wallet, min(block_time) AS at_ms FROM tr
  WHERE side='BUY' AND quote_amount>0 GROUP BY 1,2),
 oks AS (SELECT size FROM use GROUP BY size HAVING count(*) BETWEEN 2 AND 8),
 rel AS (SELECT x.wallet AS a, y.wallet AS b, count(*) AS shared, min(x.size) AS size, min(x.at_ms) AS at_ms FROM use x JOIN use y ON x.size=y.size AND x.wallet<y.wallet
  WHERE x.size IN (SELECT size FROM oks) GROUP BY 1,2 HAVING count(*)>=2)"""


def related(t):
    return N.shared_sizes(t.trades()).select("a", "b")


def unresolved(t):
    return t.activity().where("status = 'FAILED'").groupBy("asset").agg(F.count("*").alias("unresolved"))


@query("W01", f"""WITH {ACT}, t AS (SELECT asset, count(*) AS trades, count(DISTINCT wallet) AS wallets FROM act WHERE status='SUCCESS' GROUP BY 1),
 u AS (SELECT asset, count(*) AS unresolved FROM act WHERE status='FAILED' GROUP BY 1)
 SELECT coalesce(t.asset,u.asset) AS asset, coalesce(trades,0) AS trades, coalesce(wallets,0) AS wallets, coalesce(unresolved,0) AS unresolved,
  coalesce(trades,0)/(coalesce(trades,0)+coalesce(unresolved,0)) AS coverage,
  coalesce(trades,0)>=30 AND coalesce(wallets,0)>=5 AND coalesce(trades,0)/(coalesce(trades,0)+coalesce(unresolved,0))>=0.5 AS enough
 FROM t FULL JOIN u ON t.asset=u.asset""")
def wash_sample(t):
    return W.wash_sample(t.trades(), unresolved(t))


def conc_sql(tape: str, src: str) -> str:
    return f"""WITH {tape}, p AS (SELECT asset, wallet, sum(quote_amount) AS v, count(*) AS n FROM {src} GROUP BY 1,2),
 r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY v DESC, wallet) AS rv, row_number() OVER (PARTITION BY asset ORDER BY n DESC, wallet) AS rn FROM p)
 SELECT asset, CAST(sum(n) AS BIGINT) AS trades, count(*) AS wallets, CAST(sum(v) AS DOUBLE) AS total_volume,
  CAST(sum(CASE WHEN rv<=3 THEN v ELSE 0 END) AS DOUBLE)/greatest(CAST(sum(v) AS DOUBLE),1.0) AS top3_volume,
  CAST(sum(CASE WHEN rn<=3 THEN n ELSE 0 END) AS DOUBLE)/CAST(sum(n) AS DOUBLE) AS top3_trades, CAST(sum(n) AS DOUBLE)/count(*) AS trades_per_wallet
 FROM r GROUP BY asset"""


@query("W02", conc_sql(TR, "tr"))
def wash_concentration(t):
    return W.concentration(t.trades())


@query("W02", conc_sql(LT, "lt"))
def wash_concentration_lines(t):
    return W.concentration(t.line_trades())


# All wallets and assets of the event tape; thirty days pass in two hours and amounts go by steps of a fifth, so round trips occur.
DENSE_FROM, DENSE_BY = 1_704_067_200_000, 360
DT = ACT + f""", tr AS (SELECT tx_id, wallet, asset, pool, side, floor(ln(quote_amount+1)/ln(1.2))::BIGINT AS token_amount, quote_amount, quote_asset, ({DENSE_FROM}+(block_time-{DENSE_FROM})//{DENSE_BY})//60000 AS slot, tx_index,
 {DENSE_FROM}+(block_time-{DENSE_FROM})//{DENSE_BY} AS block_time, status FROM act WHERE status='SUCCESS')"""


def dense(t):
    at = F.lit(DENSE_FROM) + F.floor((F.col("block_time") - DENSE_FROM) / DENSE_BY)
    size = F.floor(F.log(F.col("quote_amount").cast("double") + 1) / F.log(F.lit(1.2)))
    return t.trades().withColumns({"block_time": at, "slot": F.floor(at / 60_000), "token_amount": size.cast("decimal(20,0)")})


TRIPS = """tn AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY slot, tx_index) AS rn FROM tr),
 cd AS (SELECT b.asset, b.rn AS brn, list(s.rn ORDER BY s.rn) AS cands FROM tn b JOIN tn s ON s.asset=b.asset AND b.side='BUY' AND s.side='SELL' AND s.rn>b.rn AND s.block_time-b.block_time<=600000 AND abs(b.token_amount-s.token_amount)<=greatest(b.token_amount,s.token_amount)*0.05
  AND (s.wallet=b.wallet OR EXISTS (SELECT 1 FROM rel WHERE rel.a=least(s.wallet,b.wallet) AND rel.b=greatest(s.wallet,b.wallet))) GROUP BY 1,2),
 ci AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY brn) AS bn FROM cd),
 walk AS (SELECT asset, bn, brn, cands[1] AS pick, [cands[1]] AS used FROM ci WHERE bn=1 UNION ALL SELECT c.asset, c.bn, c.brn, list_filter(c.cands, lambda x: NOT list_contains(w.used, x))[1],
  CASE WHEN list_filter(c.cands, lambda x: NOT list_contains(w.used, x))[1] IS NULL THEN w.used ELSE list_append(w.used, list_filter(c.cands, lambda x: NOT list_contains(w.used, x))[1]) END FROM walk w JOIN ci c ON c.asset=w.asset AND c.bn=w.bn+1),
 trip AS (SELECT b.asset, b.tx_id AS buy_tx, s.tx_id AS sell_tx, b.wallet=s.wallet AS same_wallet, (b.quote_amount+s.quote_amount)::DOUBLE AS volume FROM walk JOIN tn b ON b.asset=walk.asset AND b.rn=brn JOIN tn s ON s.asset=walk.asset AND s.rn=pick)"""


@query("W03", f"WITH RECURSIVE {DT}, {SIZES}, {TRIPS} SELECT * FROM trip")
def wash_round_trips(t):
    d = dense(t)
    return W.round_trips(d, N.shared_sizes(d).select("a", "b"))


@query("W04", f"""WITH {TR}, p AS (SELECT asset, CASE WHEN quote_amount>0 THEN {sig3('quote_amount')} END AS size, count(*) AS n FROM tr GROUP BY 1,2)
 SELECT asset, CAST(sum(CASE WHEN size IS NOT NULL AND n>=3 THEN n ELSE 0 END) AS DOUBLE)/CAST(sum(n) AS DOUBLE) AS repeated_share FROM p GROUP BY 1""")
def wash_size_repetition(t):
    return W.size_repetition(t.trades())


CLU = f"""{SIZES}, clw AS (SELECT DISTINCT asset, wallet FROM tr WHERE wallet IN (SELECT a FROM rel UNION SELECT b FROM rel))"""


@query("W05", f"""WITH {TR}, {CLU} SELECT tr.asset, CAST(sum(CASE WHEN clw.wallet IS NOT NULL THEN quote_amount ELSE 0 END) AS DOUBLE)/CAST(sum(quote_amount) AS DOUBLE) AS cluster_share
 FROM tr LEFT JOIN clw ON tr.asset=clw.asset AND tr.wallet=clw.wallet GROUP BY 1""")
def wash_cluster_volume(t):
    r = related(t)
    linked = r.select(F.col("a").alias("wallet")).union(r.select(F.col("b").alias("wallet"))).distinct()
    clustered = t.trades().select("asset", "wallet").distinct().join(linked, "wallet", "left_semi")
    return W.cluster_volume(t.trades(), clustered)


@query("W06", f"""WITH {TR}, {SIZES}, h AS (SELECT DISTINCT x.asset, x.slot FROM tr x JOIN rel ON x.wallet=rel.a JOIN tr y ON y.asset=x.asset AND y.slot=x.slot AND y.wallet=rel.b)
 SELECT tr.asset, CAST(sum(CASE WHEN h.slot IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE)/count(*) AS sync_share
 FROM tr LEFT JOIN h ON tr.asset=h.asset AND tr.slot=h.slot GROUP BY 1""")
def wash_synchronized(t):
    return W.synchronized(t.trades(), related(t))


LINKED = "clw AS (SELECT DISTINCT asset, wallet FROM tr WHERE wallet IN (SELECT a FROM rel UNION SELECT b FROM rel))"
RISK = f"""WITH RECURSIVE {DT}, {SIZES}, {TRIPS}, {LINKED}, p AS (SELECT asset, wallet, sum(quote_amount) AS v, count(*) AS n FROM tr GROUP BY 1,2),
 r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY v DESC, wallet) AS rv, row_number() OVER (PARTITION BY asset ORDER BY n DESC, wallet) AS rn FROM p),
 cn AS (SELECT asset, sum(n) AS trades, count(*) AS wallets, sum(v)::DOUBLE AS tv, sum(CASE WHEN rv<=3 THEN v ELSE 0 END)::DOUBLE/greatest(sum(v)::DOUBLE,1.0) AS t3v, sum(CASE WHEN rn<=3 THEN n ELSE 0 END)::DOUBLE/sum(n)::DOUBLE AS t3n, sum(n)::DOUBLE/count(*) AS tpw FROM r GROUP BY 1),
 tp AS (SELECT asset, sum(volume) AS v FROM trip GROUP BY 1), sz AS (SELECT asset, sum(CASE WHEN n>=3 THEN n ELSE 0 END)::DOUBLE/sum(n)::DOUBLE AS rs FROM (SELECT asset, {sig3('quote_amount')} AS size, count(*) AS n FROM tr GROUP BY 1,2) GROUP BY 1),
 cl AS (SELECT tr.asset, sum(CASE WHEN clw.wallet IS NOT NULL THEN quote_amount ELSE 0 END)::DOUBLE/sum(quote_amount)::DOUBLE AS cs FROM tr LEFT JOIN clw ON tr.asset=clw.asset AND tr.wallet=clw.wallet GROUP BY 1),
 hs AS (SELECT DISTINCT x.asset, x.slot FROM tr x JOIN rel ON x.wallet=rel.a JOIN tr y ON y.asset=x.asset AND y.slot=x.slot AND y.wallet=rel.b), sy AS (SELECT tr.asset, sum(CASE WHEN hs.slot IS NOT NULL THEN 1 ELSE 0 END)::DOUBLE/count(*) AS ss FROM tr LEFT JOIN hs ON tr.asset=hs.asset AND tr.slot=hs.slot GROUP BY 1),
 u AS (SELECT asset, count(*) AS un FROM act WHERE status='FAILED' GROUP BY 1),
 s1 AS (SELECT cn.*, coalesce(tp.v,0)/tv AS ts, rs, cs, ss, trades/(trades+coalesce(un,0)) AS cov FROM cn LEFT JOIN tp USING (asset) JOIN sz USING (asset) JOIN cl USING (asset) JOIN sy USING (asset) LEFT JOIN u USING (asset)),
 s2 AS (SELECT *, trades>=30 AND wallets>=5 AND cov>=0.5 AS enough, t3v>=0.6 OR t3n>=0.6 OR tpw>=6 AS fc, ts>=0.2 AS ft, rs>=0.4 AS fp, cs>=0.3 OR ss>=0.1 AS fr FROM s1),
 s3 AS (SELECT *, CASE WHEN enough THEN fc::INT+ft::INT+fp::INT+fr::INT ELSE 0 END AS nf FROM s2)
 SELECT asset, cov AS coverage, trades::BIGINT AS trades, wallets, CASE WHEN enough THEN array_to_string(list_filter([CASE WHEN fc THEN 'CONCENTRATION' END, CASE WHEN ft THEN 'ROUND_TRIPS' END, CASE WHEN fp THEN 'PATTERN' END, CASE WHEN fr THEN 'RELATIONSHIP' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS families,
  CASE WHEN NOT enough THEN 'INSUFFICIENT_DATA' WHEN ft AND (fr OR fc) THEN 'HIGH' WHEN nf>=2 THEN 'ELEVATED' ELSE 'LOW' END AS risk, CASE WHEN enough THEN {hu('least(0.9::DOUBLE,greatest(0.1::DOUBLE,(0.4::DOUBLE+0.1::DOUBLE*nf+0.3::DOUBLE*least(1.0::DOUBLE,trades/120.0::DOUBLE))*cov))', 2)} ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN enough THEN array_to_string(list_filter([CASE WHEN wallets/trades>=0.5 THEN 'MANY_WALLETS' END, CASE WHEN NOT fc THEN 'NOT_CONCENTRATED' END, CASE WHEN NOT fp THEN 'SIZES_VARY' END, CASE WHEN NOT ft THEN 'NO_ROUND_TRIPS' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS counter_signals,
  {hu('t3v', 3)} AS top3_volume, {hu('t3n', 3)} AS top3_trades, {hu('tpw', 3)} AS trades_per_wallet, {hu('ts', 3)} AS trip_share, {hu('rs', 3)} AS repeated_share, {hu('cs', 3)} AS cluster_share, {hu('ss', 3)} AS sync_share FROM s3"""


@query("W03 W07", RISK)
def wash_risk(t):
    d = dense(t)
    pairs = cut(N.shared_sizes(d).select("a", "b"))
    linked = pairs.select(F.col("a").alias("wallet")).union(pairs.select(F.col("b").alias("wallet"))).distinct()
    out = W.wash_analysis(d, unresolved(t), pairs, d.select("asset", "wallet").distinct().join(linked, "wallet", "left_semi"))
    return out.withColumns({"families": F.array_join("families", ","), "counter_signals": F.array_join("counter_signals", ",")})


# ---- behaviour -------------------------------------------------------------------------


@query("B01", f"""WITH {ACT}, s AS (SELECT wallet, min(block_time) AS f FROM act GROUP BY 1),
 t AS (SELECT wallet, arg_min(block_time, tx_index) AS b FROM act WHERE status='SUCCESS' GROUP BY 1)
 SELECT s.wallet, f AS first_seen_at, CASE WHEN b IS NOT NULL THEN greatest(0.0::DOUBLE,(b-f)/1000.0::DOUBLE) END AS age_at_first_trade_sec FROM s LEFT JOIN t ON s.wallet=t.wallet""")
def wallet_age(t):
    return B.wallet_age(t.activity(), t.trades()).drop("first_trade_at")


@query("B02", f"""WITH {ACT} SELECT wallet, count(*) AS transactions, count(block_time) AS timed, min(block_time) AS from_ms, max(block_time) AS to_ms,
  count(*) FILTER (status='FAILED') AS failed,
  CASE WHEN count(*)>=5 THEN count(*)/greatest(1.0::DOUBLE/60,(max(block_time)-min(block_time))/3600000.0::DOUBLE) END AS tx_per_hour,
  CASE WHEN count(*)>=5 THEN count(*) FILTER (status='FAILED')/count(*) END AS failed_share FROM act GROUP BY 1""")
def wallet_rates(t):
    return B.wallet_rates(t.activity())


@query("B03", f"""WITH {TR} SELECT wallet, count(*) AS trades, count(*) FILTER (side='BUY') AS buys, count(*) FILTER (side='SELL') AS sells, count(DISTINCT asset) AS token_diversity FROM tr GROUP BY 1""")
def wallet_trade_counts(t):
    return B.trade_counts(t.trades())


ENTRY = f"""{LT}, {LA}, fb AS (SELECT wallet, asset, min(slot) AS slot, min(block_time) AS t FROM lt WHERE side='BUY' GROUP BY 1,2),
 d AS (SELECT wallet, greatest(0.0::DOUBLE,(t-launch_time)/1000.0::DOUBLE) AS sec FROM fb JOIN la ON fb.asset=la.asset)"""


@query("B04", f"""WITH {ENTRY} SELECT wallet, count(*) AS launches_entered, count(*) FILTER (sec<=60) AS fresh_launch_buys, min(sec) AS fastest_entry_sec,
 CASE WHEN count(*)>=3 THEN count(*) FILTER (sec<=60)/count(*) END AS early_entry_share, median(sec) AS median_entry_sec FROM d GROUP BY 1""")
def wallet_entry_speed(t):
    return B.entry_speed(t.line_trades(), t.launches())


GAPS = f"""{ACT}, g AS (SELECT wallet, (block_time - lag(block_time) OVER (PARTITION BY wallet ORDER BY slot, tx_index))/1000.0::DOUBLE AS gap FROM act)"""


@query("B05", f"""WITH {GAPS} SELECT wallet, count(gap) AS gaps, CASE WHEN count(gap)>=10 AND avg(gap)>0 THEN stddev_pop(gap)/avg(gap) END AS cadence_cv,
 CASE WHEN count(gap)>=3 THEN median(gap) END AS median_gap_sec FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def wallet_cadence(t):
    return B.cadence(t.activity()).drop("median_of_gaps")


BURST = """SELECT wallet, max(n) AS burst10s FROM (SELECT wallet, count(*) OVER (PARTITION BY wallet ORDER BY block_time RANGE BETWEEN 10000 PRECEDING AND CURRENT ROW) AS n FROM act) GROUP BY 1"""


@query("B06", f"WITH {ACT} {BURST}")
def wallet_burst(t):
    return B.burst(t.activity())


SIZE_TWIN = """s AS (SELECT wallet, tx_id, quote_amount AS x FROM tr WHERE side='BUY' AND quote_amount>0),
 tw AS (SELECT s.wallet, s.tx_id, bool_or(o.tx_id IS NOT NULL) AS twin FROM s LEFT JOIN s o ON o.wallet=s.wallet AND o.tx_id<>s.tx_id AND abs(o.x-s.x)<=s.x*0.01::DOUBLE GROUP BY 1,2)"""
SIZE_SEL = """SELECT wallet, count(*) AS priced_buys, CASE WHEN count(*)>=5 THEN count(*) FILTER (twin)/count(*) END AS repeated_size_share FROM tw GROUP BY 1"""


@query("B07", f"WITH {TR}, {SIZE_TWIN} {SIZE_SEL}")
def wallet_repeated_sizes(t):
    out = B.repeated_sizes(t.trades())
    return out.withColumn("priced_buys", F.col("priced_buys").cast("long"))


HOLDS = """w1 AS (SELECT *, lag(side) OVER (PARTITION BY wallet, asset ORDER BY slot, tx_index) AS prev FROM tr),
 w2 AS (SELECT *, lag(block_time) OVER (PARTITION BY wallet, asset ORDER BY slot, tx_index) AS opened FROM w1
  WHERE (side='BUY' AND coalesce(prev,'SELL')='SELL') OR (side='SELL' AND prev='BUY')),
 hd AS (SELECT wallet, asset, (block_time-opened)/1000.0::DOUBLE AS hold FROM w2 WHERE side='SELL')"""
HOLD_SEL = "SELECT wallet, count(*) AS round_trips, CASE WHEN count(*)>=2 THEN median(hold) END AS median_hold_sec FROM hd GROUP BY 1"


@query("B08", f"WITH {TR}, {HOLDS} {HOLD_SEL}")
def wallet_round_trips(t):
    return B.round_trip_summary(t.trades()).drop("holds")


def event_launches(t):
    """An asset of the event tape launches at its first transaction."""
    return t.activity().groupBy("asset").agg(F.min("block_time").alias("launch_time"))


def features(t):
    return B.wallet_features(t.activity(), t.trades(), event_launches(t))


FEATURES = f"""{TR}, fl AS (SELECT asset, min(block_time) AS launch_time FROM act GROUP BY 1),
 fe AS (SELECT wallet, asset, arg_min(block_time, tx_index) AS t FROM tr WHERE side='BUY' GROUP BY 1,2),
 fd AS (SELECT wallet, greatest(0.0::DOUBLE,(t-launch_time)/1000.0::DOUBLE) AS sec FROM fe JOIN fl ON fe.asset=fl.asset),
 e AS (SELECT wallet, count(*) AS le, count(*) FILTER (sec<=60) AS fr, median(sec) AS me, CASE WHEN count(*)>=3 THEN count(*) FILTER (sec<=60)/count(*) END AS es FROM fd GROUP BY 1),
 {GAPS.split(', g AS')[0].replace(ACT, '')} g AS{GAPS.split(', g AS')[1]},
 ca AS (SELECT wallet, CASE WHEN count(gap)>=10 AND avg(gap)>0 THEN stddev_pop(gap)/avg(gap) END AS cv FROM g WHERE gap IS NOT NULL GROUP BY 1),
 bu AS ({BURST}), {SIZE_TWIN}, sz AS ({SIZE_SEL}), {HOLDS}, rt AS ({HOLD_SEL}),
 tc AS (SELECT wallet, count(*) AS trades, count(*) FILTER (side='BUY') AS buys, count(*) FILTER (side='SELL') AS sells, count(DISTINCT asset) AS div FROM tr GROUP BY 1),
 ra AS (SELECT wallet, count(*) AS tx, (max(block_time)-min(block_time))/3600000.0::DOUBLE AS span,
  CASE WHEN count(*)>=5 THEN count(*)/greatest(1.0::DOUBLE/60,(max(block_time)-min(block_time))/3600000.0::DOUBLE) END AS rate,
  CASE WHEN count(*)>=5 THEN count(*) FILTER (status='FAILED')/count(*) END AS fs FROM act GROUP BY 1),
 f AS (SELECT ra.wallet, tx, span, rate, fs, coalesce(trades,0) AS trades, coalesce(buys,0) AS buys, coalesce(sells,0) AS sells, coalesce(div,0) AS div,
  le, fr, me, es, cv, CASE WHEN tx>=5 THEN burst10s END AS bst, repeated_size_share AS rs, coalesce(round_trips,0) AS trips, median_hold_sec AS hold
  FROM ra LEFT JOIN tc ON ra.wallet=tc.wallet LEFT JOIN e ON ra.wallet=e.wallet LEFT JOIN ca ON ra.wallet=ca.wallet LEFT JOIN bu ON ra.wallet=bu.wallet
  LEFT JOIN sz ON ra.wallet=sz.wallet LEFT JOIN rt ON ra.wallet=rt.wallet),
 n AS (SELECT *, ((rate IS NOT NULL)::INT+(fs IS NOT NULL)::INT+(cv IS NOT NULL)::INT+(bst IS NOT NULL)::INT+(rs IS NOT NULL)::INT+(es IS NOT NULL)::INT+(hold IS NOT NULL)::INT+2)/9.0::DOUBLE AS coverage,
  coalesce(fr>=3,false)::INT+coalesce(es>=0.5,false)::INT+coalesce(le>=5 AND me<=300,false)::INT AS ns, coalesce(fr>=3,false) AS strong,
  coalesce(rate>=30 AND tx>=30,false)::INT+coalesce(hold<=120 AND trips>=3,false)::INT+coalesce(trades>=20 AND buys>0 AND sells/nullif(buys,0) BETWEEN 0.7::DOUBLE AND 1.5::DOUBLE,false)::INT AS nh,
  coalesce(cv<=0.35,false)::INT+coalesce(rs>=0.6,false)::INT+coalesce(fs>=0.25 AND tx>=10,false)::INT+coalesce(bst>=5,false)::INT+coalesce(span<=24 AND div>=15,false)::INT AS na,
  coalesce(cv>=1,false)::INT+coalesce(rs<=0.2,false)::INT+coalesce(rate<=3,false)::INT+(coalesce(hold>=3600,false) OR (buys>=3 AND sells=0))::INT+coalesce(fs<=0.05,false)::INT AS no FROM f),
 cls AS (SELECT *, CASE WHEN tx<8 OR trades<3 THEN 'INSUFFICIENT_DATA' WHEN ns>=2 AND strong THEN 'SNIPER' WHEN nh>=2 THEN 'HIGH_FREQUENCY_TRADER' WHEN na+nh>=2 THEN 'AUTOMATED_TRADER'
  WHEN no>=3 AND na+nh=0 AND ns=0 THEN 'LIKELY_ORGANIC' ELSE 'UNKNOWN' END AS classification FROM n),
 cc AS (SELECT *, CASE classification WHEN 'SNIPER' THEN ns+na WHEN 'LIKELY_ORGANIC' THEN no ELSE na+nh END AS sup, CASE classification WHEN 'LIKELY_ORGANIC' THEN 0 ELSE no END AS cnt,
  CASE classification WHEN 'AUTOMATED_TRADER' THEN 0.9::DOUBLE WHEN 'LIKELY_ORGANIC' THEN 0.7::DOUBLE ELSE 0.95::DOUBLE END AS cap FROM cls)"""


@query("B09", f"""WITH {FEATURES} SELECT wallet, classification, coverage,
 CASE WHEN classification IN ('UNKNOWN','INSUFFICIENT_DATA') THEN 0.0::DOUBLE ELSE {hu("greatest(0.05::DOUBLE, least(cap, ((CASE WHEN sup>=4 THEN 0.85::DOUBLE WHEN sup=3 THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END)-0.1::DOUBLE*cnt)*1.0::DOUBLE*(0.5::DOUBLE+0.5::DOUBLE*coverage)))", 2)} END AS confidence FROM cc""")
def wallet_classes(t):
    return B.classify_wallets(features(t)).drop("signals", "counter_signals")


def history(t):
    """Two wallets in three are read to their end; of one in four the first transaction is known."""
    n = F.expr("cast(substring(wallet, 2) as int)")
    first = t.activity().groupBy("wallet").agg(F.min("block_time").alias("at"), F.min_by("tx_id", F.struct("slot", "tx_index")).alias("tx"))
    return first.select("wallet", (n % 3 != 0).alias("complete"), F.when(n % 4 == 1, F.col("at") - 5000).alias("earliest_at"), F.when(n % 4 == 1, F.concat(F.lit("first-"), "tx")).alias("earliest_tx"))


def ids_sql(src: str, cond: str = "true", order: str = "slot, tx_index, tx_id", most: int = 5) -> str:
    return f"(SELECT wallet, string_agg(tx_id, ',' ORDER BY n) AS ids FROM (SELECT wallet, tx_id, row_number() OVER (PARTITION BY wallet ORDER BY {order}) AS n FROM {src} WHERE {cond}) WHERE n<={most} GROUP BY 1)"


_IDS = {"first_seen_at": ids_sql("act", most=1), "age_at_first_trade_sec": ids_sql("tr", most=1), "failed_share": ids_sql("act", "status='FAILED'"), "fresh_launch_buys": ids_sql("en", "sec<=60"),
        "fastest_entry_sec": ids_sql("en", order="sec, slot, tx_index, tx_id", most=1), "repeated_size_share": ids_sql("tr", "tx_id IN (SELECT tx_id FROM tw WHERE twin)")}
_W, _C = "CASE WHEN complete THEN 'MEASURED' ELSE 'PARTIAL' END", "CASE WHEN trades>=3 AND complete THEN 'MEASURED' ELSE 'PARTIAL' END"
_E = lambda cond: f"CASE WHEN {cond} THEN {_W} ELSE 'INSUFFICIENT' END"
_S = "coalesce(earliest_at, CASE WHEN complete THEN lo END)"
_LONG = {"first_seen_at": (_S, f"CASE WHEN {_S} IS NULL THEN 'INSUFFICIENT' ELSE 'MEASURED' END"),
         "age_at_first_trade_sec": (f"CASE WHEN {_S} IS NOT NULL AND ft IS NOT NULL THEN greatest(0.0::DOUBLE,(ft-{_S})/1000.0::DOUBLE) END", f"CASE WHEN {_S} IS NULL OR ft IS NULL THEN 'INSUFFICIENT' ELSE 'MEASURED' END"),
         "tx_per_hour": ("rate", _E("tx>=5")), "failed_share": ("fs", _E("tx>=5")), "trades": ("trades", _C), "buys": ("buys", _C), "sells": ("sells", _C), "token_diversity": ("div", _C),
         "fresh_launch_buys": ("coalesce(fr,0)", _E("le>=1")), "early_entry_share": ("es", _E("le>=3")), "fastest_entry_sec": ("fastest", _E("le>=1")), "median_entry_sec": ("me", _E("le>=1")), "launches_entered": ("coalesce(le,0)", _E("le>=1")),
         "cadence_cv": ("cv", _E("cv IS NOT NULL")), "median_gap_sec": ("mg", _E("gaps>=3")), "burst10s": ("coalesce(braw,0)", _E("tx>=5")), "repeated_size_share": ("rs", _E("pb>=5")), "round_trips": ("trips", _C), "median_hold_sec": ("hold", _E("trips>=2"))}


@query("B01 B02 B03 B04 B05 B06 B07 B08", f"""WITH {FEATURES}, en AS (SELECT * FROM (SELECT tr.wallet, tr.slot, tr.tx_index, tr.tx_id, greatest(0.0::DOUBLE,(block_time-launch_time)/1000.0::DOUBLE) AS sec, row_number() OVER (PARTITION BY wallet, tr.asset ORDER BY slot, tx_index) AS n
  FROM tr JOIN fl ON fl.asset=tr.asset WHERE side='BUY') WHERE n=1),
 h AS (SELECT wallet, min(block_time) AS lo, CAST(substr(wallet,2) AS INT)%3<>0 AS complete, CASE WHEN CAST(substr(wallet,2) AS INT)%4=1 THEN min(block_time)-5000 END AS earliest_at, 'first-'||arg_min(tx_id, (slot, tx_index)) AS earliest_tx FROM act GROUP BY 1),
 x AS (SELECT f.*, h.*, ft, fastest, mg, gaps, braw, pb FROM f JOIN h USING (wallet) LEFT JOIN (SELECT wallet, arg_min(block_time, (slot, tx_index)) AS ft FROM tr GROUP BY 1) USING (wallet) LEFT JOIN (SELECT wallet, min(sec) AS fastest FROM en GROUP BY 1) USING (wallet)
  LEFT JOIN (SELECT wallet, median(gap) AS mg, count(gap) AS gaps FROM g WHERE gap IS NOT NULL GROUP BY 1) USING (wallet) LEFT JOIN (SELECT wallet, burst10s AS braw FROM bu) USING (wallet) LEFT JOIN (SELECT wallet, priced_buys AS pb FROM sz) USING (wallet)),
 l AS ({" UNION ALL ".join(f"SELECT wallet, '{k}' AS feature, ({v})::DOUBLE AS value, {q} AS quality, earliest_at, earliest_tx FROM x" for k, (v, q) in _LONG.items())}),
 i AS ({" UNION ALL ".join(f"SELECT *, '{k}' AS feature FROM {v}" for k, v in _IDS.items())})
 SELECT l.wallet, l.feature, value, quality, CASE WHEN value IS NULL THEN '' WHEN l.feature='first_seen_at' AND earliest_at IS NOT NULL THEN earliest_tx ELSE coalesce(ids, '') END AS evidence FROM l LEFT JOIN i ON i.wallet=l.wallet AND i.feature=l.feature""")
def wallet_feature_quality(t):
    out = B.measured_features(t.activity(), t.trades(), event_launches(t), history(t))
    return out.withColumn("evidence", F.array_join("evidence", ","))


Q_CNT = ", ".join(f"sum(CASE WHEN cat='{k}' THEN w ELSE 0.0::DOUBLE END) AS {k}_count" for k in B.CATEGORIES)
Q_SHARE = ", ".join(
    f"CASE WHEN wc>=5 AND cv>=0.3 AND total>0 THEN {hu(f'{k}_count/total', 3)} END AS {k}_share" for k in B.CATEGORIES)


@query("B10", f"""WITH {FEATURES}, {CLU.replace(SIZES, SIZES)}, per AS (SELECT asset, wallet, count(*)::DOUBLE AS trades, sum(quote_amount)::DOUBLE AS volume FROM tr GROUP BY 1,2),
 ct AS (SELECT per.*, CASE WHEN clw.wallet IS NOT NULL THEN 'coordinated' WHEN classification='SNIPER' THEN 'sniper' WHEN classification IN ('AUTOMATED_TRADER','HIGH_FREQUENCY_TRADER') THEN 'automated'
  WHEN classification='LIKELY_ORGANIC' THEN 'likely_organic' ELSE 'unknown' END AS cat FROM per LEFT JOIN cc ON per.wallet=cc.wallet LEFT JOIN clw ON per.asset=clw.asset AND per.wallet=clw.wallet),
 lg AS (SELECT asset, cat, 'wallets' AS measure, 1.0::DOUBLE AS w FROM ct UNION ALL SELECT asset, cat, 'trades', trades FROM ct UNION ALL SELECT asset, cat, 'volume', volume FROM ct),
 ag AS (SELECT asset, measure, count(*)::DOUBLE AS wc, sum(w) AS total, {Q_CNT} FROM lg GROUP BY 1,2),
 av AS (SELECT *, CASE WHEN total=0 THEN 0.0::DOUBLE ELSE (total-unknown_count)/total END AS cv FROM ag)
 SELECT asset, measure, total, {hu('cv', 3)} AS coverage, wc AS wallet_count, {', '.join(f'{k}_count' for k in B.CATEGORIES)}, {Q_SHARE} FROM av""")
def activity_quality(t):
    r = related(t)
    linked = r.select(F.col("a").alias("wallet")).union(r.select(F.col("b").alias("wallet"))).distinct()
    cl = t.trades().select("asset", "wallet").distinct().join(linked, "wallet", "left_semi")
    return B.activity_quality(t.trades(), B.classify_wallets(features(t)), cl)


NOW = 1_706_659_200_000  # 2024-01-31T00:00Z, just after the last event


@query("B11", f"""WITH {TR}, rc AS (SELECT asset, pool, count(*) AS observed, min(block_time) AS lo, max(block_time) AS hi FROM tr WHERE {NOW}-block_time<=86400000 GROUP BY 1,2),
 po AS (SELECT asset, pool, sum(quote_amount)::DOUBLE AS volume24h, count(*) FILTER (side='BUY') AS txns24h FROM tr GROUP BY 1,2),
 p AS (SELECT coalesce(po.asset,rc.asset) AS asset, volume24h, txns24h, observed, lo, hi FROM po FULL JOIN rc ON po.asset=rc.asset AND po.pool=rc.pool),
 s AS (SELECT asset, CASE WHEN sum(observed)>=1 THEN greatest(60000, max(hi)-min(lo)) END AS window_ms, sum(volume24h) AS tv FROM p GROUP BY 1),
 g AS (SELECT p.asset, window_ms, count(*) AS known_pools, count(*) FILTER (observed>0) AS observed_pools, coalesce(sum(observed),0)::BIGINT AS observed_trades,
  sum(txns24h/86400000.0::DOUBLE*window_ms) AS ex, sum(CASE WHEN observed>0 AND tv>0 THEN {hu('coalesce(volume24h,0)/tv', 3)} END) AS vs FROM p JOIN s ON p.asset=s.asset GROUP BY 1,2),
 h AS (SELECT *, greatest(1.0::DOUBLE, ex) AS e FROM g), k AS (SELECT *, CASE WHEN ex IS NULL THEN NULL ELSE least(1.0::DOUBLE, observed_trades/e) END AS ss FROM h)
 SELECT asset, known_pools, observed_pools, observed_trades, window_ms, {hu('vs', 3)} AS venue_share, CASE WHEN ex IS NOT NULL THEN {hu('e', 0)} END AS expected_trades, {hu('ss', 3)} AS sample_share,
  {hu("CASE WHEN ss IS NOT NULL THEN least(1.0::DOUBLE, ss/0.5::DOUBLE)*coalesce(least(1.0::DOUBLE, window_ms/1800000.0::DOUBLE),0.0::DOUBLE) ELSE coalesce(vs,0)*0.5::DOUBLE*coalesce(least(1.0::DOUBLE, window_ms/1800000.0::DOUBLE),0.0::DOUBLE) END", 3)} AS representativeness FROM k""")
def market_coverage(t):
    pools = t.trades().groupBy("asset", "pool").agg(
        F.sum("quote_amount").cast("double").alias("volume24h"), F.lit(None).cast("long").alias("txns_h1"),
        F.count_if(F.col("side") == "BUY").alias("txns24h"),
    )
    return B.market_coverage(t.trades(), pools, NOW)


HOLDERS = """hold AS (SELECT 'S'||l_suppkey AS asset, 'C'||o_custkey AS token_account, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS amount FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2),
 sup AS (SELECT asset, CAST(sum(amount) AS BIGINT) AS supply FROM hold GROUP BY 1),
 rl AS (SELECT hold.*, supply, CASE WHEN c_custkey IS NULL OR c_acctbal<0 THEN 'UNKNOWN' WHEN c_mktsegment='MACHINERY' AND hold.asset='S1' THEN 'BONDING_CURVE' WHEN c_mktsegment='BUILDING' THEN 'POOL' WHEN c_nationkey<3 THEN 'PROGRAM_OWNED' ELSE 'WALLET' END AS role
  FROM hold JOIN sup ON hold.asset=sup.asset LEFT JOIN customer ON token_account='C'||c_custkey)"""


@query("B12", f"""WITH {HOLDERS.replace("c_mktsegment='MACHINERY' AND hold.asset='S1'", "c_mktsegment='MACHINERY'")}, r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY amount DESC, token_account) AS rn,
  row_number() OVER (PARTITION BY asset, role ORDER BY amount DESC, token_account) AS rr FROM rl)
 SELECT asset, count(*) AS total, count(*) FILTER (role<>'UNKNOWN') AS resolved,
  ((sum(CASE WHEN rn<=10 THEN amount ELSE 0 END)*1000000000)//max(supply))::DOUBLE/1e9 AS raw_top10_share,
  CASE WHEN count(*) FILTER (role='UNKNOWN')=0 THEN ((sum(CASE WHEN rr<=10 AND role='WALLET' THEN amount ELSE 0 END)*1000000000)//max(supply))::DOUBLE/1e9 END AS wallet_top10_share,
  {", ".join(f"sum(CASE WHEN role='{r}' THEN (amount::HUGEINT*1000000000)//supply ELSE 0 END)::DOUBLE/1e9 AS {r.lower()}_share" for r in ["BONDING_CURVE", "POOL", "PROGRAM_OWNED", "WALLET", "UNKNOWN"])}
 FROM r GROUP BY asset""")
def holder_roles(t):
    lt = t.line_trades()
    holders = lt.groupBy(F.col("pool").alias("asset"), F.col("wallet").alias("token_account")).agg(
        F.sum("token_amount").cast("decimal(20,0)").alias("amount"))
    supply = lt.groupBy(F.col("pool").alias("asset")).agg(F.sum("token_amount").cast("decimal(20,0)").alias("supply"))
    c = t.customer.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("address"), "c_nationkey", "c_acctbal", "c_mktsegment")
    owners = c.select(F.col("address").alias("token_account"), F.when(F.col("c_acctbal") >= 0, F.col("address")).alias("owner"))
    dim = c.select("address", (F.col("c_nationkey") >= 3).alias("is_wallet"),
                   F.when(F.col("c_mktsegment") == "MACHINERY", "CURVE").when(F.col("c_mktsegment") == "BUILDING", "POOL").alias("venue"))
    return B.holder_roles(holders, owners, dim, supply)
