"""Security-event queries: chain facts stand on order lines, creators on orders."""

from pyspark.sql import functions as F

from assetlens.operators import creators as C
from assetlens.operators import security as X
from assetlens.plans.registry import query
from assetlens.plans.sqltext import EV, LA, LT, TR
from assetlens.sources.tables import millis

# Facts per order line: R lines mint, A lines change an authority, N/F lines freeze, all remove liquidity.
LX = """lx AS (SELECT l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey AS tx_id, 'C'||o_custkey AS wallet, 'T'||l_partkey AS asset, 'S'||l_suppkey AS pool,
  CAST(l_quantity AS BIGINT) AS amount, (epoch_us(l_shipdate)//86400000000) AS slot, (epoch_us(l_shipdate)//1000) AS at_ms,
  l_returnflag AS rf, l_linestatus AS ls, l_discount*10 AS frac, 1-l_tax AS conf, l_linenumber AS ln, l_discount, l_tax, l_extendedprice AS px FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"""
LKS = """lk AS (SELECT DISTINCT 'T'||o_orderkey AS asset, 'C'||m.c_custkey AS wallet FROM orders JOIN customer c ON c.c_custkey=o_custkey
  JOIN customer m ON m.c_nationkey=c.c_nationkey AND m.c_mktsegment=c.c_mktsegment
  UNION SELECT 'T'||o_orderkey, 'C'||(o_orderkey%100+1) FROM orders WHERE o_orderkey%4=0 UNION SELECT 'T'||o_orderkey, 'C'||(o_orderkey%70+1) FROM orders WHERE o_orderkey%9=0
  UNION SELECT 'T'||o_orderkey, 'C'||(o_custkey+1) FROM orders WHERE o_custkey%5=0)"""
LAU = "lau AS (SELECT 'T'||o_orderkey AS asset, (epoch_us(o_orderdate)//86400000000) AS launch_slot FROM orders)"
COLS = "type, asset, tx_id, status, actor, creator_linked, slot, amount, confidence"


def lines(t):
    o = t.orders.select("o_orderkey", "o_custkey")
    l = t.lineitem
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("tx_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("wallet"),
        F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("asset"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("pool"),
        F.col("l_quantity").cast("decimal(20,0)").alias("amount"),
        F.floor(millis("l_shipdate") / 86_400_000).alias("slot"), millis("l_shipdate").alias("at"),
        F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"),
        (F.col("l_discount") * 10).alias("frac"), (1 - F.col("l_tax")).alias("conf"), F.col("l_linenumber").alias("ln"),
        F.concat_ws("/", "l_discount", "l_tax", "l_extendedprice").alias("path"),
    )


def launches(t):
    return t.launches().select("asset", F.lit(None).cast("string").alias("launch_tx"),
                               F.floor(F.col("launch_time") / 86_400_000).alias("launch_slot"))


def members(t):
    return t.customer.select(F.concat_ws("/", F.col("c_nationkey"), "c_mktsegment").alias("component"),
                             F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("wallet"))


def attributions(t):
    k = F.expr("cast(substring(asset, 2) as bigint)")
    deployer = F.concat(F.lit("C"), (k % 100 + 1).cast("string"))
    return t.launches().select("asset", "creator", F.when(k % 4 == 0, F.array(deployer)).otherwise(F.array().cast("array<string>")).alias("deployers"))


def linked(t):
    """The circles of all launched assets: a second signer for some, a paying wallet, wallets that some creators funded."""
    o = t.orders.select("o_orderkey", "o_custkey")
    c = lambda x: F.concat(F.lit("C"), x.cast("string"))
    creators = o.select("o_custkey").distinct()
    funding = creators.select(c(F.col("o_custkey")).alias("funder"), c(F.col("o_custkey") + 1).alias("wallet"), F.when(F.col("o_custkey") % 5 == 0, "DIRECT").otherwise("LIKELY").alias("classification"))
    payers = o.where("o_orderkey % 9 = 0").select(F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("asset"), c(F.col("o_orderkey") % 70 + 1).alias("wallet"))
    return C.creator_circle(attributions(t), members(t), funding, payers)


def sells(t):
    return lines(t).where("ls = 'F'").select("asset", "wallet", "tx_id", "slot", "at", "amount")


def shown(df):
    return df.select("type", "asset", "tx_id", "status", "actor", "creator_linked", "slot", "amount", "confidence")


STAT = "CASE status WHEN 'CONFIRMED' THEN 0.95::DOUBLE WHEN 'STRONGLY_SUSPECTED' THEN 0.75::DOUBLE WHEN 'SUSPICIOUS' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence"
SALES = "sa AS (SELECT lx.asset, lx.slot, lx.at_ms, lx.amount, lx.wallet, lx.tx_id FROM lx JOIN lk ON lx.asset=lk.asset AND lx.wallet=lk.wallet WHERE ls='F')"

EXPANSION = f"""mt AS (SELECT lx.* FROM lx JOIN lau ON lx.asset=lau.asset WHERE rf='R' AND lx.slot>=launch_slot),
 mx AS (SELECT m.*, EXISTS (SELECT 1 FROM lk WHERE lk.asset=m.asset AND lk.wallet=m.wallet) AS tol,
  coalesce((SELECT sum(s.amount) FROM sa s WHERE s.asset=m.asset AND s.slot>=m.slot AND s.at_ms-m.at_ms<=86400000),0) AS sold FROM mt m),
 exp_ev AS (SELECT 'SUPPLY_EXPANSION' AS type, asset, tx_id, CASE WHEN tol AND sold*2>=amount THEN 'CONFIRMED' WHEN tol THEN 'STRONGLY_SUSPECTED' ELSE 'SUSPICIOUS' END AS status,
  pool AS actor, false AS creator_linked, slot, amount::DOUBLE AS amount FROM mx)"""


@query("X01 X06", f"WITH {LX}, {LKS}, {LAU}, {SALES}, {EXPANSION} SELECT *, {STAT} FROM exp_ev")
def supply_expansion(t):
    m = lines(t).where("rf = 'R'").select("asset", "tx_id", "slot", "at", "amount", "path", F.col("wallet").alias("recipient"), F.col("pool").alias("authority"))
    return shown(X.supply_expansion(m, sells(t), linked(t).kept(), launches(t)))


AUTH = """au_ev AS (SELECT 'AUTHORITY_REASSIGNED' AS type, lx.asset, tx_id, 'SUSPICIOUS' AS status, wallet AS actor,
  EXISTS (SELECT 1 FROM lk WHERE lk.asset=lx.asset AND lk.wallet=lx.wallet) AS creator_linked, slot, NULL::DOUBLE AS amount
  FROM lx JOIN lau ON lx.asset=lau.asset WHERE rf='A' AND ln%2=1 AND slot>=launch_slot)"""


@query("X02", f"WITH {LX}, {LKS}, {LAU}, {AUTH} SELECT *, {STAT} FROM au_ev")
def authority_reassigned(t):
    c = lines(t).where("rf = 'A'").select("asset", "tx_id", "slot", "at", F.col("wallet").alias("previous_authority"),
                                         F.when(F.col("ln") % 2 == 1, F.col("pool")).alias("new_authority"))
    return shown(X.authority_reassigned(c, linked(t), launches(t)))


FREEZE = """fz AS (SELECT lx.* FROM lx WHERE rf='N' AND ls='F' AND ln<>3 AND NOT EXISTS (SELECT 1 FROM lk WHERE lk.asset=lx.asset AND lk.wallet=lx.wallet)),
 fr_ev AS (SELECT 'FREEZE_ABUSE' AS type, asset, arg_min(tx_id, (slot, tx_id)) AS tx_id, CASE WHEN count(DISTINCT wallet)>=3 THEN 'CONFIRMED' WHEN count(DISTINCT wallet)>=1 THEN 'STRONGLY_SUSPECTED' ELSE 'SUSPICIOUS' END AS status,
  arg_min(pool, (slot, tx_id)) AS actor, false AS creator_linked, min(slot) AS slot, NULL::DOUBLE AS amount FROM fz GROUP BY asset)"""


@query("X03", f"WITH {LX}, {LKS}, {FREEZE} SELECT *, {STAT} FROM fr_ev")
def freeze_abuse(t):
    f = lines(t).where("rf = 'N' AND ls = 'F'").select(
        "asset", "tx_id", "slot", "at", F.when(F.col("ln") == 3, "THAW").otherwise("FREEZE").alias("kind"),
        F.col("wallet").alias("owner"), F.col("pool").alias("authority"))
    return shown(X.freeze_abuse(f, linked(t), t.address_dim()))


DRAIN = """dr0 AS (SELECT lx.*, EXISTS (SELECT 1 FROM lk WHERE lk.asset=lx.asset AND lk.wallet=lx.wallet) AS ol FROM lx WHERE conf>=0.9),
 dr_ev AS (SELECT 'LIQUIDITY_DRAIN' AS type, asset, tx_id, CASE WHEN ol AND frac>=0.8 THEN 'CONFIRMED' WHEN ol AND frac>=0.3 THEN 'STRONGLY_SUSPECTED' ELSE 'SUSPICIOUS' END AS status, wallet AS actor, ol AS creator_linked, slot, amount::DOUBLE AS amount
  FROM dr0 WHERE (ol AND frac>=0.3) OR frac>=0.8)"""


@query("X04", f"WITH {LX}, {LKS}, {DRAIN} SELECT *, {STAT} FROM dr_ev")
def liquidity_drain(t):
    r = lines(t).select("asset", "tx_id", "slot", "at", F.col("wallet").alias("actor"), F.col("frac").alias("reserve_fraction"),
                        F.col("conf").alias("confidence"), "amount")
    return shown(X.liquidity_drain(r, linked(t), t.address_dim()))


DUMP = """sw AS (SELECT s.asset, s.slot, s.at_ms, (SELECT sum(o.amount) FROM sa o WHERE o.asset=s.asset AND o.at_ms BETWEEN s.at_ms AND s.at_ms+3600000) AS tot FROM sa s),
 sb AS (SELECT asset, max(tot) AS best FROM sw GROUP BY 1), ss AS (SELECT sw.asset, min(sw.slot) AS slot, max(best) AS best FROM sw JOIN sb ON sw.asset=sb.asset AND tot=best GROUP BY 1),
 sp AS (SELECT asset, sum(amount) AS supply FROM lx WHERE rf='R' GROUP BY 1),
 du_ev AS (SELECT 'CREATOR_DUMP' AS type, ss.asset, CASE WHEN floor(best*10000/supply)/10000>=0.3 THEN 'STRONGLY_SUSPECTED' ELSE 'SUSPICIOUS' END AS status, true AS creator_linked, slot, best::DOUBLE AS amount
  FROM ss JOIN sp ON ss.asset=sp.asset WHERE floor(best*10000/supply)/10000>=0.1)"""


@query("X05", f"WITH {LX}, {LKS}, {SALES}, {DUMP} SELECT *, {STAT} FROM du_ev")
def creator_dump(t):
    supply = lines(t).where("rf = 'R'").groupBy("asset").agg(F.sum("amount").alias("supply"))
    return shown(X.creator_dump(sells(t), linked(t), supply)).drop("tx_id", "actor")


@query("X07", f"""WITH {EV} SELECT 'A'||(k%10) AS asset, CASE event_type WHEN 'purchase' THEN 'CONFIRMED' WHEN 'signup' THEN 'STRONGLY_SUSPECTED' ELSE 'SUSPICIOUS' END AS status, count(*) AS n
 FROM ev WHERE k%4<>0 AND k%9<>0 AND event_type<>'error' GROUP BY 1,2""")
def active_events(t):
    e = findings(t)
    return X.active_events(e, "rules@1").groupBy("asset", "status").agg(F.count("*").alias("n"))


def findings(t):
    """Stored findings over the event tape: rule version and supersession by key."""
    st = F.col("event_type")
    status = F.when(st == "purchase", "CONFIRMED").when(st == "signup", "STRONGLY_SUSPECTED").when(st == "error", "RETRACTED").otherwise("SUSPICIOUS")
    return t.event_facts().select(
        F.col("event_id").alias("id"), F.concat(F.lit("A"), (F.col("k") % 10).cast("string")).alias("asset"), status.alias("status"),
        F.when(F.col("k") % 4 == 0, "rules@0").otherwise("rules@1").alias("rule_version"),
        F.when(F.col("k") % 9 == 0, F.col("at")).alias("superseded_at"), "at")


@query("X08", f"""WITH {TR}, p AS (SELECT asset, tx_id, wallet, slot, block_time AS at_ms, token_amount AS amount FROM tr WHERE side='SELL' AND tx_index%3<>0),
 w AS (SELECT asset, tx_id, wallet, slot, block_time AS at_ms, quote_amount AS amount FROM tr WHERE side='SELL' AND tx_index%3<>1)
 SELECT coalesce(w.asset,p.asset) AS asset, coalesce(w.tx_id,p.tx_id) AS tx_id, coalesce(w.wallet,p.wallet) AS wallet, coalesce(w.slot,p.slot) AS slot, coalesce(w.amount,p.amount)::DOUBLE AS amount
 FROM p FULL JOIN w ON p.asset=w.asset AND p.tx_id=w.tx_id AND p.wallet=w.wallet""")
def asset_sells(t):
    s = t.trades().where("side = 'SELL'").withColumn("at", F.col("block_time"))
    p = s.where("tx_index % 3 <> 0").withColumn("amount", F.col("token_amount"))
    w = s.where("tx_index % 3 <> 1").withColumn("amount", F.col("quote_amount"))
    return X.asset_sells(p, w).select("asset", "tx_id", "wallet", "slot", F.col("amount").cast("double").alias("amount"))


# ---- creators --------------------------------------------------------------------------

EVS = f"evs AS (SELECT asset, status FROM exp_ev UNION ALL SELECT asset, status FROM dr_ev)"


def some_events(t):
    m = lines(t).where("rf = 'R'").select("asset", "tx_id", "slot", "at", "amount", "path", F.col("wallet").alias("recipient"), F.col("pool").alias("authority"))
    r = lines(t).select("asset", "tx_id", "slot", "at", F.col("wallet").alias("actor"), F.col("frac").alias("reserve_fraction"), F.col("conf").alias("confidence"), "amount")
    lk = linked(t).kept()
    return X.supply_expansion(m, sells(t), lk, launches(t)).unionByName(X.liquidity_drain(r, lk, t.address_dim()))


def profiles(t):
    return C.creator_profiles(t.launches(), some_events(t))


@query("N17", f"""WITH {LX}, {LKS}, {LAU}, {SALES}, {EXPANSION}, {DRAIN}, {EVS}, {LA},
 pa AS (SELECT asset, count(*) FILTER (status='CONFIRMED') AS c, count(*) FILTER (status='STRONGLY_SUSPECTED') AS s, count(*) FILTER (status='SUSPICIOUS') AS u FROM evs GROUP BY 1),
 g AS (SELECT creator, count(*) AS launches, min(launch_time) AS first_launch_at, max(launch_time) AS last_launch_at, coalesce(sum(c),0)::BIGINT AS confirmed, coalesce(sum(s),0)::BIGINT AS strongly_suspected, coalesce(sum(u),0)::BIGINT AS suspicious
  FROM la LEFT JOIN pa ON la.asset=pa.asset GROUP BY 1)
 SELECT *, CASE WHEN confirmed>0 THEN 'MALICIOUS_HISTORY' WHEN strongly_suspected+suspicious>0 THEN 'SUSPICIOUS' WHEN launches>=2 THEN 'CLEAN' ELSE 'INSUFFICIENT_HISTORY' END AS status FROM g""")
def creator_profiles(t):
    return profiles(t)


@query("N18", f"""WITH {LKS} SELECT asset, count(*) AS wallets, min(wallet) AS first_wallet FROM lk GROUP BY 1""")
def creator_linked(t):
    return linked(t).sizes()


@query("N16", """WITH c AS (SELECT 'T'||o_orderkey AS asset, 'C'||o_custkey AS fee_payer, o_orderkey%7 AS r, 'C'||(o_orderkey%100) AS other FROM orders WHERE o_orderstatus<>'P')
 SELECT asset, fee_payer, CASE WHEN r=0 THEN 'UNKNOWN' WHEN r IN (1,2) AND other<>fee_payer THEN 'AMBIGUOUS' ELSE 'ATTRIBUTED' END AS status,
  CASE WHEN r=0 THEN NULL WHEN r IN (1,2) AND other<>fee_payer THEN NULL WHEN r=3 THEN other ELSE fee_payer END AS creator,
  CASE WHEN r=0 THEN 0.0::DOUBLE WHEN r IN (1,2) AND other<>fee_payer THEN 0.0::DOUBLE WHEN r=3 AND other<>fee_payer THEN 0.6::DOUBLE WHEN r=4 AND other<>fee_payer THEN 0.6::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM c""")
def attribute_launches(t):
    o = t.orders.select(
        F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("asset"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("fee_payer"),
        (F.col("o_orderkey") % 7).alias("r"), F.concat(F.lit("C"), (F.col("o_orderkey") % 100).cast("string")).alias("other"), "o_orderstatus")
    signers = (F.when(F.col("r") == 0, F.array("asset")).when(F.col("r").isin(1, 2), F.array_distinct(F.array("asset", "fee_payer", "other")))
               .when(F.col("r") == 3, F.array("other")).otherwise(F.array("fee_payer", "asset")))
    c = o.select("asset", F.col("asset").alias("tx_id"), "fee_payer", signers.alias("signers"),
                 F.when(F.col("o_orderstatus") == "P", "FAILED").otherwise("SUCCESS").alias("status"),
                 F.when(F.col("r") == 4, F.col("other")).alias("liquidity_creator"))
    return C.attribute_launches(c).select("asset", "fee_payer", "status", "creator", "confidence")


@query("S27", """WITH a AS (SELECT 'T'||o_orderkey AS asset, 'C'||o_custkey AS creator FROM orders),
 l AS (SELECT 'T'||o_orderkey AS asset, CASE WHEN o_orderkey%5<>0 THEN epoch_us(o_orderdate)//1000 END AS launch_time, 'C'||(o_orderkey%200) AS fee_payer FROM orders),
 u AS (SELECT a.creator, a.asset, launch_time FROM a LEFT JOIN l ON a.asset=l.asset UNION SELECT fee_payer, asset, launch_time FROM l)
 SELECT creator, asset, max(launch_time) AS launch_time FROM u GROUP BY 1,2""")
def creator_launches(t):
    o = t.orders.select("o_orderkey", F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("asset"),
                        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("creator"), millis("o_orderdate").alias("ms"))
    launch = o.select("asset", F.when(F.col("o_orderkey") % 5 != 0, F.col("ms")).alias("launch_time"),
                                                  F.concat(F.lit("C"), (F.col("o_orderkey") % 200).cast("string")).alias("fee_payer"))
    return C.launches_of(o.select("asset", "creator"), launch)


@query("N19", f"""WITH {LX}, {LA}, a AS (SELECT DISTINCT asset FROM lx WHERE frac>=0.9 AND rf='R'),
 ac AS (SELECT a.asset, creator AS actor FROM a JOIN la ON a.asset=la.asset UNION SELECT lx.asset, wallet FROM lx JOIN a ON lx.asset=a.asset WHERE rf='A'),
 tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY launch_time, asset) AS r FROM la) WHERE r<=50)
 SELECT DISTINCT tp.asset AS asset FROM ac JOIN tp ON ac.actor=tp.creator WHERE tp.asset<>ac.asset""")
def linked_assets(t):
    ln = lines(t)
    assets = ln.where("frac >= 0.9 AND rf = 'R'").select("asset")
    ev = ln.where("rf = 'A'").select("asset", F.col("wallet").alias("actor"))
    return C.linked_assets(assets, t.launches(), ev, t.launches())
