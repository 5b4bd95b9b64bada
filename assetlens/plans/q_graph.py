"""Wallet-graph queries: funding on order lines, behaviour on the event tape."""

from pyspark.sql import functions as F

from assetlens.functions.durable import cut
from assetlens.operators import graph as N
from assetlens.operators import trades as T
from assetlens.plans.registry import query
from assetlens.plans.sqltext import EV, LA, LT, TR
from assetlens.plans.q_wash import SIZES

# ---- funding ---------------------------------------------------------------------------

IF = f"""{LT}, fi AS (SELECT dst AS wallet, arg_min(src, (at_ms, tx_id, src)) AS funder, arg_min(tx_id, (at_ms, tx_id, src)) AS tx_id, min(at_ms) AS at_ms FROM
  (SELECT pool AS src, wallet AS dst, tx_id, block_time AS at_ms FROM lt) GROUP BY 1)"""
FS = """st AS (SELECT 'S'||s_suppkey AS funder, s_acctbal>=-500 AS is_wallet, CASE WHEN s_nationkey>=5 THEN n END AS recent_tx, CASE WHEN s_nationkey>=5 THEN w END AS recent_window_ms FROM supplier
  LEFT JOIN (SELECT l_suppkey, count(*) AS n, epoch_us(max(l_shipdate))//1000-epoch_us(min(l_shipdate))//1000 AS w FROM lineitem GROUP BY 1) ON s_suppkey=l_suppkey),
 fo AS (SELECT funder, count(DISTINCT wallet) AS fan_out FROM fi GROUP BY 1),
 fc AS (SELECT fi.*, is_wallet, recent_tx, fan_out, c_acctbal>0 AS hs, CASE WHEN NOT is_wallet THEN 'INFRASTRUCTURE' WHEN recent_tx>=1000 AND recent_window_ms<=86400000 THEN 'INFRASTRUCTURE' WHEN fan_out>=25 THEN 'INFRASTRUCTURE'
   WHEN c_acctbal>0 AND recent_tx IS NOT NULL THEN 'DIRECT' ELSE 'LIKELY' END AS classification,
   CASE WHEN NOT is_wallet THEN 0.85::DOUBLE WHEN recent_tx>=1000 AND recent_window_ms<=86400000 THEN 0.8::DOUBLE WHEN fan_out>=25 THEN 0.75::DOUBLE WHEN c_acctbal>0 AND recent_tx IS NOT NULL THEN 0.9::DOUBLE ELSE 0.55::DOUBLE END AS confidence
  FROM fi LEFT JOIN st ON fi.funder=st.funder LEFT JOIN fo ON fi.funder=fo.funder JOIN customer ON fi.wallet='C'||c_custkey)"""


def initial(t):
    return T.initial_funding(t.supplier_transfers().select("src", "dst", "tx_id", "amount", "slot", "at", F.lit("SUCCESS").alias("status")))


def funding(t):
    obs = cut(initial(t).select("wallet", "funder", "tx_id", "at"))  # read again for the fan-out
    hist = t.customer.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("wallet"), (F.col("c_acctbal") > 0).alias("history_from_start"))
    obs = obs.join(hist, "wallet").withColumn("first_inbound", F.lit(True))
    from assetlens.sources.tables import millis

    use = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), (F.max(millis("l_shipdate")) - F.min(millis("l_shipdate"))).alias("w"))
    s = t.supplier.join(use, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    seen = F.col("s_nationkey") >= 5
    stats = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("funder"), (F.col("s_acctbal") >= -500).alias("is_wallet"),
                     F.when(seen, F.col("n")).alias("recent_tx"), F.when(seen, F.col("w")).alias("recent_window_ms")).join(N.fan_out(obs), "funder", "left")
    return N.classify_funding(obs, stats)


@query("T08", f"WITH {IF} SELECT * FROM fi")
def initial_funding(t):
    return initial(t).select("wallet", "funder", "tx_id", F.col("at").alias("at_ms"))


@query("N01", f"WITH {LT} SELECT pool AS funder, count(DISTINCT wallet) AS fan_out FROM lt GROUP BY 1")
def funder_fan_out(t):
    return N.fan_out(t.supplier_transfers().select(F.col("src").alias("funder"), F.col("dst").alias("wallet")))


@query("N02", f"WITH {IF}, {FS} SELECT wallet, funder, classification, confidence FROM fc")
def funding_class(t):
    return funding(t).select("wallet", "funder", "classification", "confidence")


FE = """fe AS (SELECT 'FUNDED' AS type, funder AS a, wallet AS b, true AS directed, confidence, at_ms, tx_id AS evidence, classification AS detail FROM fc WHERE classification IN ('DIRECT','LIKELY')
 UNION ALL SELECT 'SHARED_FUNDER', x.wallet, y.wallet, false, 0.7::DOUBLE, x.at_ms, x.tx_id, x.funder FROM fc x JOIN fc y ON x.funder=y.funder AND x.wallet<y.wallet AND x.classification='DIRECT' AND y.classification='DIRECT'
  WHERE x.funder IN (SELECT funder FROM fc WHERE classification='DIRECT' GROUP BY 1 HAVING count(*) BETWEEN 2 AND 24))"""


@query("N03", f"WITH {IF}, {FS}, {FE} SELECT * FROM fe")
def funding_edges(t):
    return N.funding_edges(funding(t)).withColumnRenamed("at", "at_ms")


TX = f"""{LT}, tx AS (SELECT 'TOKEN_TRANSFER' AS type, wallet AS a, 'C'||substr(asset,2) AS b, true AS directed, 0.9::DOUBLE AS confidence, block_time AS at_ms, tx_id AS evidence, pool AS detail FROM lt
  WHERE wallet<>'C'||substr(asset,2) AND 'C'||substr(asset,2) IN (SELECT 'C'||c_custkey FROM customer))"""


def wallet_transfers(t):
    x = t.line_trades().select(F.col("wallet").alias("src"), F.concat(F.lit("C"), F.expr("substring(asset, 2)")).alias("dst"), "tx_id",
                               F.col("block_time").alias("at"), F.col("pool").alias("asset"))
    return N.transfer_wallet_edges(x, t.address_dim())


@query("N04", f"WITH {TX} SELECT * FROM tx")
def transfer_wallet_edges(t):
    return wallet_transfers(t).withColumnRenamed("at", "at_ms")


CO = """fb AS (SELECT wallet, asset, min(slot) AS slot, arg_min(block_time, (slot, block_time, tx_id)) AS bt, arg_min(tx_id, (slot, block_time, tx_id)) AS tx FROM tr WHERE side='BUY' GROUP BY 1,2),
 cr AS (SELECT a.wallet, a.asset, count(*) AS n FROM fb a JOIN fb b ON a.asset=b.asset AND b.slot BETWEEN a.slot-2 AND a.slot+2 GROUP BY 1,2),
 co AS (SELECT 'COORDINATED_ENTRY' AS type, least(x.wallet,y.wallet) AS a, greatest(x.wallet,y.wallet) AS b, false AS directed, 0.4::DOUBLE AS confidence, x.bt AS at_ms, x.tx||'|'||y.tx AS evidence, x.asset AS detail
  FROM fb x JOIN cr ON cr.wallet=x.wallet AND cr.asset=x.asset AND cr.n<=8 JOIN fb y ON x.asset=y.asset AND y.slot BETWEEN x.slot AND x.slot+2 AND (y.slot>x.slot OR x.wallet<y.wallet) AND x.wallet<>y.wallet)"""


@query("N05", f"WITH {TR}, {CO} SELECT * FROM co")
def coordinated_entry(t):
    return N.coordinated_entry(t.trades()).withColumnRenamed("at", "at_ms")


@query("N06", f"WITH {TR}, {SIZES} SELECT 'REPEATED_ORDER_SIZE' AS type, a, b, false AS directed, 0.5::DOUBLE AS confidence, at_ms, size AS evidence, CAST(shared AS VARCHAR) AS detail FROM rel")
def shared_order_sizes(t):
    return N.shared_sizes(t.trades()).withColumnRenamed("at", "at_ms")


SL = f"""{LT}, {LA}, el AS (SELECT DISTINCT wallet, asset FROM (SELECT wallet, lt.asset, min(block_time) AS bt FROM lt WHERE side='BUY' GROUP BY 1,2) f JOIN la USING (asset) WHERE (bt-launch_time)/1000.0<=60),
 sl AS (SELECT x.wallet AS a, y.wallet AS b, count(*) AS n, array_to_string(list_sort(list(x.asset))[1:3], ',') AS asset FROM el x JOIN el y ON x.asset=y.asset AND x.wallet<y.wallet GROUP BY 1,2 HAVING count(*)>=2)"""


@query("N07", f"WITH {SL} SELECT 'SAME_LAUNCH_PARTICIPATION' AS type, a, b, false AS directed, 0.3::DOUBLE AS confidence, NULL::BIGINT AS at_ms, asset AS evidence, CAST(n AS VARCHAR) AS detail FROM sl")
def same_launch_participation(t):
    return N.same_launches(t.line_trades(), t.launches()).withColumnRenamed("at", "at_ms")


@query("N08", f"""WITH {IF}, {FS}, {FE}, {TX.replace(LT + ', ', '')}, h AS (SELECT type, a, b, max(confidence) AS confidence, min(at_ms) AS at_ms, min(evidence) AS evidence FROM (SELECT * FROM fe WHERE type='FUNDED' UNION ALL SELECT * FROM tx) GROUP BY 1,2,3),
 cr AS (SELECT 'C'||o_custkey AS c, array_to_string(list_sort(list('T'||o_orderkey))[1:3], ',') AS mints FROM orders WHERE o_orderpriority='1-URGENT' GROUP BY 1)
 SELECT 'CREATOR_ASSOCIATION' AS type, a, b, true AS directed, least(0.9::DOUBLE, confidence) AS confidence, at_ms, evidence, type||'|'||c||'|'||mints AS detail FROM h JOIN cr ON a=c OR b=c""")
def creator_edges(t):
    e = N.fold_edges(N.funding_edges(funding(t)).unionByName(wallet_transfers(t)))
    c = t.orders.where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("creator"), F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("asset"))
    return N.creator_edges(e, c).withColumnRenamed("at", "at_ms")


RAW = f"""{CO}, {SIZES}, raw AS (SELECT * FROM co UNION ALL SELECT 'REPEATED_ORDER_SIZE', a, b, false, 0.5::DOUBLE, at_ms, size, CAST(shared AS VARCHAR) FROM rel),
 fold AS (SELECT type, a, b, directed, max(confidence) AS confidence, count(*) AS count, min(at_ms) AS first_at, max(at_ms) AS last_at, array_to_string(list_sort(list_distinct(list(evidence)))[1:5], ',') AS evidence, max(detail) AS detail,
  substr(sha256('WALLET_EDGE|'||type||'|'||a||'|'||b),1,32) AS id FROM raw GROUP BY 1,2,3,4)"""


def folded(t):
    tr = t.trades()
    return N.fold_edges(N.coordinated_entry(tr).unionByName(N.shared_sizes(tr)))


@query("N09", f"WITH {TR}, {RAW} SELECT * FROM fold")
def folded_edges(t):
    return folded(t).drop("direct_funding").withColumn("evidence", F.array_join("evidence", ","))


PAIRS = """pr0 AS (SELECT a, b, bool_or(type='COORDINATED_ENTRY') AS c, bool_or(type='REPEATED_ORDER_SIZE') AS r FROM fold GROUP BY 1,2),
 pr AS (SELECT a, b, CASE WHEN c AND r THEN 'STRONG_CANDIDATE' ELSE 'WEAK_CANDIDATE' END AS level, CASE WHEN c AND r THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS confidence,
  CASE WHEN c AND r THEN 'COORDINATED_ENTRY,REPEATED_ORDER_SIZE' WHEN c THEN 'COORDINATED_ENTRY' ELSE 'REPEATED_ORDER_SIZE' END AS kinds FROM pr0)"""


def pair_levels(t):
    return N.assess_pairs(folded(t))


@query("N10", f"WITH {TR}, {RAW}, {PAIRS} SELECT * FROM pr")
def pair_assessment(t):
    return pair_levels(t).withColumn("kinds", F.array_join("kinds", ","))


COMP = """sg AS (SELECT a, b FROM pr WHERE level='STRONG_CANDIDATE'), bi AS (SELECT a, b FROM sg UNION SELECT b, a FROM sg),
 rc(node, reach) AS (SELECT a, a FROM bi UNION SELECT rc.node, bi.b FROM rc JOIN bi ON rc.reach=bi.a), cm AS (SELECT node, min(reach) AS component FROM rc GROUP BY 1)"""


@query("N11", f"""WITH RECURSIVE {TR}, {RAW}, {PAIRS}, {COMP}, sz AS (SELECT component, count(*) AS members FROM cm GROUP BY 1)
 SELECT sz.component, members, floor(avg(confidence)*100+0.5)/100 AS confidence, count(*) AS pairs, 0::BIGINT AS funded, 0::BIGINT AS token_transfer, 0::BIGINT AS shared_funder,
  count(*) FILTER (kinds LIKE '%COORD%') AS coordinated_entry, count(*) FILTER (kinds LIKE '%REPEAT%') AS repeated_order_size, 0::BIGINT AS same_launch_participation, 'STRONG_CANDIDATE' AS level
 FROM pr JOIN cm ON pr.a=cm.node JOIN sz ON sz.component=cm.component WHERE level='STRONG_CANDIDATE' GROUP BY 1,2""")
def wallet_clusters(t):
    return N.clusters(pair_levels(t))


@query("N13", f"""WITH RECURSIVE {TR}, {RAW}, {PAIRS}, {COMP}, x AS (SELECT DISTINCT tr.asset, cm.component, tr.wallet FROM tr JOIN cm ON tr.wallet=cm.node),
 y AS (SELECT *, count(*) OVER (PARTITION BY asset, component) AS traders FROM x) SELECT * FROM y WHERE traders>=2""")
def clustered_traders(t):
    return N.clustered_traders(N.cluster_members(pair_levels(t)), t.trades())


@query("N12", f"""WITH {TR}, {RAW}, n AS (SELECT wallet, count(*) AS c FROM act GROUP BY 1), ok AS (SELECT wallet FROM n WHERE c>=40 AND c<75)
 SELECT type, a, b, count FROM fold WHERE a IN (SELECT wallet FROM ok) AND b IN (SELECT wallet FROM ok)""")
def trusted_edges(t):
    n = t.activity().groupBy(F.col("wallet").alias("address")).agg(F.count("*").alias("c"))
    return N.trusted_edges(folded(t), n.where("c >= 40"), n.where("c >= 75")).select("type", "a", "b", "count")


MEM = "mb AS (SELECT c_nationkey||'/'||c_mktsegment AS component, 'C'||c_custkey AS wallet FROM customer)"


@query("S26", f"""WITH {MEM}, w AS (SELECT wallet FROM mb JOIN customer ON wallet='C'||c_custkey WHERE c_acctbal<-800), hit AS (SELECT DISTINCT component FROM mb WHERE wallet IN (SELECT wallet FROM w))
 SELECT component, wallet FROM mb WHERE component NOT IN (SELECT component FROM hit) UNION ALL SELECT 'fresh/'||substr(wallet,2,1), wallet FROM w""")
def replace_clusters(t):
    from assetlens.plans.q_security import members

    low = t.customer.where("c_acctbal < -800").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("wallet"))
    fresh = low.select(F.concat(F.lit("fresh/"), F.substring("wallet", 2, 1)).alias("component"), "wallet")
    return N.replace_clusters(members(t), fresh, low)


# ---- network ---------------------------------------------------------------------------


@query("N14", f"""WITH {IF}, {FS}, {FE}, bo AS (SELECT a, b, type, confidence FROM fe UNION ALL SELECT b, a, type, confidence FROM fe),
 s0 AS (SELECT 'C'||c_custkey AS a FROM customer WHERE c_acctbal<-900), h1 AS (SELECT *, 1 AS hop FROM bo WHERE a IN (SELECT a FROM s0)),
 s1 AS (SELECT DISTINCT b AS a FROM h1 WHERE b NOT IN (SELECT a FROM s0)), h2 AS (SELECT *, 2 AS hop FROM bo WHERE a IN (SELECT a FROM s1))
 SELECT least(a,b) AS a, greatest(a,b) AS b, type, max(confidence) AS confidence, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1,2,3""")
def network_edges(t):
    s = t.customer.where("c_acctbal < -900").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("address"))
    return N.network_edges(s, N.funding_edges(funding(t)), 2)


BAD = """bad AS (SELECT 'C'||c_custkey AS address, CASE WHEN c_acctbal<-900 THEN 1 ELSE 0 END AS confirmed, 1 AS strongly FROM customer WHERE c_acctbal<-800)"""


# Users of the event tape meet the ten customers that share their number's tens, so weak edges reach every customer.
WEAK = "wk AS (SELECT 'C'||user_id AS a, 'C'||(user_id*10+k%10) AS b, 0.4::DOUBLE AS confidence, min(event_id)::VARCHAR AS evidence FROM ev WHERE user_id<>user_id*10+k%10 GROUP BY 1,2)"


def weak_edges(t):
    name = lambda c: F.concat(F.lit("C"), c.cast("string"))
    met = t.event_facts().select(name(F.col("user_id")).alias("a"), name(F.col("user_id") * 10 + F.col("k") % 10).alias("b"), "event_id").where("a <> b")
    return met.groupBy("a", "b").agg(F.min("event_id").cast("string").alias("evidence")).select(F.lit("BEHAVIOURAL").alias("type"), "a", "b", F.lit(0.4).alias("confidence"), "evidence")


def bad_creators(t):
    c = t.customer.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("address"), "c_acctbal")
    return c, c.where("c_acctbal < -800").select("address", (F.col("c_acctbal") < -900).cast("int").alias("confirmed"), F.lit(1).alias("strongly_suspected"))


def creator_events(t):
    """Security events of creators: one for each order, its number deciding how sure it is."""
    from assetlens.sources.tables import millis

    sure = F.element_at(F.array(*map(F.lit, ("CONFIRMED", "STRONGLY_SUSPECTED", "SUSPICIOUS"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return t.orders.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("address"), F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("asset"),
                           F.col("o_orderpriority").alias("type"), sure.alias("status"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("tx_id"), millis("o_orderdate").alias("at"))


def net_sql(tag: str, cond: str) -> str:
    return f"""b{tag} AS (SELECT a, b, max(confidence) AS c FROM (SELECT a, b, confidence FROM ne WHERE {cond} UNION ALL SELECT b, a, confidence FROM ne WHERE {cond}) GROUP BY 1,2),
 z{tag} AS (SELECT address, 1.0::DOUBLE AS conf, 0 AS nh, confirmed, address AS target FROM bad UNION ALL SELECT b{tag}.a, c, -1, confirmed, b FROM b{tag} JOIN bad ON b{tag}.b=bad.address
  UNION ALL SELECT x.a, x.c*y.c, -2, confirmed, y.b FROM b{tag} x JOIN b{tag} y ON x.b=y.a JOIN bad ON y.b=bad.address),
 t{tag} AS (SELECT address, max((conf, nh, confirmed, target)) AS m FROM z{tag} GROUP BY 1), r{tag} AS (SELECT address, m[1] AS conf, m[2] AS nh, m[3] AS confirmed, m[4] AS target FROM t{tag})"""


@query("N15", f"""WITH {IF}, {FS}, {FE}, {TR}, {WEAK}, {BAD}, ne AS (SELECT type, a, b, confidence FROM fe UNION ALL SELECT 'BEHAVIOURAL', a, b, confidence FROM wk),
 {net_sql('s', "type IN ('FUNDED','TOKEN_TRANSFER','SHARED_FUNDER','CLUSTER')")}, {net_sql('w', 'true')}
 SELECT 'C'||c_custkey AS address, CASE WHEN rs.confirmed>0 AND floor(rs.conf*100+0.5)/100>=0.5 THEN 'STRONG' WHEN rs.address IS NOT NULL THEN 'MODERATE' WHEN rw.address IS NOT NULL THEN 'WEAK_ASSOCIATION' ELSE 'NONE' END AS level,
  rs.target AS target, CAST(-rs.nh AS INTEGER) AS hops, floor(rs.conf*100+0.5)/100 AS path_confidence,
  CASE WHEN rs.address IS NULL THEN 0.0::DOUBLE ELSE floor(floor(rs.conf*100+0.5)/100*(CASE WHEN rs.confirmed>0 THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END)*100+0.5)/100 END AS confidence
 FROM customer LEFT JOIN rs ON rs.address='C'||c_custkey LEFT JOIN rw ON rw.address='C'||c_custkey""")
def network_level(t):
    c, bad = bad_creators(t)
    e = N.funding_edges(funding(t)).select("type", "a", "b", "confidence")
    return N.network_level(c, e.unionByName(weak_edges(t).drop("evidence")), bad)


def path_sql(tag: str, cond: str) -> str:
    """Best edge of each pair and direction under ``cond``, and the best path of each subject and target."""
    return f"""s{tag} AS (SELECT a, b, arg_min(type, (-confidence, type, evidence)) AS type, max(confidence) AS c, arg_min(evidence, (-confidence, type, evidence)) AS evidence FROM ne2 WHERE {cond} GROUP BY 1,2),
 l{tag} AS (SELECT s.*, a||'>'||b||':'||type||':'||(c*100)::INTEGER||':'||evidence AS step FROM s{tag} s),
 p{tag} AS (SELECT address, address AS target, 1.0::DOUBLE AS conf, 0 AS hops, '' AS middle, '' AS path FROM bad UNION ALL SELECT a, b, c, 1, '', step FROM l{tag} JOIN bad ON b=bad.address
  UNION ALL SELECT x.a, y.b, x.c*y.c, 2, x.b, x.step||' '||y.step FROM l{tag} x JOIN l{tag} y ON x.b=y.a JOIN bad ON y.b=bad.address WHERE x.a<>y.b),
 q{tag} AS (SELECT * FROM p{tag} JOIN sj USING (address) QUALIFY row_number() OVER (PARTITION BY address, target ORDER BY conf DESC, hops, middle)=1)"""


@query("N15", f"""WITH {IF}, {FS}, {FE}, {EV}, {WEAK}, {BAD}, sj AS (SELECT 'C'||c_custkey AS address FROM customer),
 ne AS (SELECT type, a, b, confidence, evidence FROM fe UNION ALL SELECT 'BEHAVIOURAL', a, b, confidence, evidence FROM wk), ne2 AS (SELECT * FROM ne UNION ALL SELECT type, b, a, confidence, evidence FROM ne),
 {path_sql('s', "type<>'BEHAVIOURAL'")}, {path_sql('w', 'true')},
 r AS (SELECT *, 'STRONG' AS kind FROM qs UNION ALL SELECT *, 'WEAK_ASSOCIATION' FROM qw WHERE NOT EXISTS (SELECT 1 FROM qs WHERE qs.address=qw.address AND qs.target=qw.target)),
 ev5 AS (SELECT 'C'||o_custkey AS target, 'T'||o_orderkey||':'||o_orderpriority||':'||CASE o_orderkey%3 WHEN 0 THEN 'CONFIRMED' ELSE 'STRONGLY_SUSPECTED' END||':O'||o_orderkey AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, 'O'||o_orderkey) AS n
  FROM orders WHERE o_orderkey%3<2), et AS (SELECT target, string_agg(e, ' ' ORDER BY n) AS events FROM ev5 WHERE n<=5 GROUP BY 1),
 f AS (SELECT r.address, r.target, kind, bad.confirmed, strongly AS strongly_suspected, hops, floor(conf*100+0.5)/100 AS path_confidence, path, coalesce(events, '') AS events FROM r JOIN bad ON bad.address=r.target LEFT JOIN et ON et.target=r.target)
 SELECT *, row_number() OVER (PARTITION BY address, kind ORDER BY path_confidence DESC, hops, target) AS by_path, row_number() OVER (PARTITION BY address, kind ORDER BY confirmed DESC, path_confidence DESC, hops, target) AS by_confirmed FROM f""")
def network_findings(t):
    c, bad = bad_creators(t)
    e = N.funding_edges(funding(t)).select("type", "a", "b", "confidence", "evidence")
    out = N.network_findings(c, e.unionByName(weak_edges(t).select("type", "a", "b", "confidence", "evidence")), bad, creator_events(t))
    steps = F.transform("path", lambda x: F.concat(x["from"], F.lit(">"), x["to"], F.lit(":"), x["type"], F.lit(":"), F.round(x["confidence"] * 100).cast("int").cast("string"), F.lit(":"), x["evidence"]))
    told = F.transform("events", lambda x: F.concat_ws(":", x["asset"], x["type"], x["status"], x["tx_id"]))
    return out.withColumns({"path": F.array_join(steps, " "), "events": F.coalesce(F.array_join(told, " "), F.lit("")), **{k: F.col(k).cast("long") for k in ("by_path", "by_confirmed")}})


@query("N20", f"""WITH {TR}, {RAW} SELECT id, type, a, b, last_at FROM fold WHERE a IN ('W1','W7','W42') OR b IN ('W1','W7','W42') ORDER BY last_at DESC NULLS LAST, id LIMIT 25""")
def edges_touching(t):
    who = t.activity().where(F.col("wallet").isin("W1", "W7", "W42")).select(F.col("wallet").alias("address")).distinct()
    return N.edges_of(folded(t), who, 25).select("id", "type", "a", "b", "last_at")


@query("N20", f"""WITH {IF}, {FS}, wa AS (SELECT wallet, asset, min(slot) AS first_slot, count(*) FILTER (side='BUY') AS buys FROM lt GROUP BY 1,2)
 SELECT wa.wallet, asset, first_slot, buys, funder, classification FROM wa LEFT JOIN fc ON wa.wallet=fc.wallet""")
def buyer_arrivals(t):
    from assetlens.operators import tables as S

    return N.buyer_arrivals(S.wallet_asset_activity(t.line_trades().withColumn("status", F.lit("SUCCESS"))).select("wallet", "asset", "first_slot", "buys"), funding(t))


@query("N20", f"WITH {IF}, {FS} SELECT wallet, funder, classification FROM fc WHERE funder IN (SELECT 'S'||s_suppkey FROM supplier WHERE s_acctbal<0)")
def wallets_funded_by(t):
    low = t.supplier.where("s_acctbal < 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("funder"))
    return N.funded_by(funding(t), low).select("wallet", "funder", "classification")


@query("N21", f"""WITH {TR}, w AS (SELECT asset, wallet, count(*) AS n FROM act GROUP BY 1,2), wc AS (SELECT asset, avg(CASE WHEN n>=8 THEN 1.0::DOUBLE WHEN n>=6 THEN 0.75::DOUBLE WHEN n>=4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS wv FROM w GROUP BY 1),
 o AS (SELECT asset, count(*) FILTER (status='SUCCESS')/count(*) AS cl, CASE WHEN asset IN ('A0','A1','A2') THEN 1.0::DOUBLE WHEN asset IN ('A3','A4') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS att, max(k2) AS mh FROM (SELECT *, CASE WHEN pool='P0' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS k2 FROM act) GROUP BY 1)
 SELECT wc.asset, floor((wv+att+cl+mh)/4.0*1000+0.5)/1000 AS coverage FROM wc JOIN o ON wc.asset=o.asset""")
def analysis_coverage(t):
    a = t.activity()
    w = a.groupBy("asset", "wallet").agg(F.count("*").alias("n"))
    hist = w.select("asset", F.when(F.col("n") >= 8, "COMPLETE").when(F.col("n") >= 6, "TRUNCATED").when(F.col("n") >= 4, "REUSED").otherwise("NOT_READ").alias("state"))
    cl = a.groupBy("asset").agg((F.count_if(F.col("status") == "SUCCESS") / F.count("*")).alias("classified"),
                                F.max(F.when(F.col("pool") == "P0", 1.0).otherwise(0.5)).alias("mint_history"))
    att = a.select("asset").distinct().withColumn("attributed", F.when(F.col("asset").isin("A0", "A1", "A2"), 1.0).when(F.col("asset").isin("A3", "A4"), 0.5).otherwise(0.0))
    return N.analysis_coverage(hist, cl, att)
