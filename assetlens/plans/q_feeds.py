"""Feed, data-quality and text queries."""

from pyspark.sql import functions as F

from assetlens.functions.text import fold_ticker, redact, sanitize
from assetlens.operators import dq
from assetlens.operators.match import near_matches
from assetlens.plans.registry import query
from assetlens.plans.sqltext import ASSET_NOW, EV
from assetlens.sources import feeds as X
from assetlens.sources.tables import millis

VNOW = 1_706_659_200_000


def raw(t):
    """Messy text columns from events: some absent, some malformed."""
    k = F.col("k")
    s = lambda c: c.cast("string")
    return t.event_facts().select(
        "event_id", F.when(k % 10 == 0, "abc").when(k % 10 == 1, "").when(k % 10 == 2, "NaN").when(k % 10 == 3, "Infinity").when(k % 10 == 4, s(-k)).otherwise(s(F.col("value"))).alias("usd"),
        F.when(k % 7 == 0, None).when(k % 7 == 1, s(k + 0.5)).otherwise(s(k)).alias("cnt"), F.when(k % 6 == 0, "150").otherwise(s(k)).alias("pct"), F.when(k % 5 == 0, "true").when(k % 5 == 1, "yes").otherwise("false").alias("flag"),
        F.when(k % 8 == 0, "0Bad").when(k % 8 == 1, None).otherwise(F.rpad(F.translate(s(k), "0", "z"), 34, "A")).alias("addr"), F.when(k % 9 == 0, "18446744073709551616").when(k % 9 == 1, "-5").when(k % 9 == 2, "18446744073709551615").otherwise(s(F.col("cents"))).alias("amt"),
        F.when(k % 11 == 0, "1500000000").when(k % 11 == 1, "2024-01-15T00:00:00Z").when(k % 11 == 2, "soon").when(k % 11 == 3, "1900000000").otherwise(s(F.col("at"))).alias("ts"))


RULES = [dq.Rule("usd", "usd"), dq.Rule("cnt", "count"), dq.Rule("pct", "percent"), dq.Rule("flag", "boolean"), dq.Rule("addr", "address"), dq.Rule("amt", "amount"), dq.Rule("ts", "time")]
VAL = f"""{EV}, iss AS (SELECT event_id, 'usd' AS field, CASE WHEN k%10=0 THEN 'not a finite number' WHEN k%10=2 THEN 'NaN' WHEN k%10=3 THEN 'Infinity' WHEN k%10=4 AND k>0 THEN 'below minimum 0' END AS reason FROM ev UNION ALL SELECT event_id, 'cnt', CASE WHEN k%7=1 THEN 'expected an integer' END FROM ev
 UNION ALL SELECT event_id, 'pct', CASE WHEN k%6=0 THEN 'above maximum 100' END FROM ev UNION ALL SELECT event_id, 'flag', CASE WHEN k%5=1 THEN 'expected boolean' END FROM ev UNION ALL SELECT event_id, 'addr', CASE WHEN k%8=0 THEN 'not an address' END FROM ev
 UNION ALL SELECT event_id, 'amt', CASE WHEN k%9=0 THEN 'exceeds u64' WHEN k%9=1 THEN 'not a non-negative integer string' END FROM ev UNION ALL SELECT event_id, 'ts', CASE WHEN k%11=0 THEN 'before genesis' WHEN k%11=2 THEN 'unparseable date string' WHEN k%11=3 THEN 'in the future' END FROM ev)"""


@query("V01 V03 V04 V05", f"""WITH {EV} SELECT event_id, CASE WHEN k%10>4 THEN value WHEN k%10=4 AND k=0 THEN 0.0 END AS usd, CASE WHEN k%7>1 THEN k::DOUBLE END AS cnt, CASE WHEN k%6<>0 THEN k::DOUBLE END AS pct, CASE WHEN k%5=0 THEN true WHEN k%5>1 THEN false END AS flag,
 CASE WHEN k%8>1 THEN rpad(replace(CAST(k AS VARCHAR),'0','z'),34,'A') END AS addr, CASE WHEN k%9=2 THEN 18446744073709551615::DOUBLE WHEN k%9>2 THEN cents::DOUBLE END AS amt, CASE WHEN k%11=1 THEN 1705276800000 WHEN k%11>3 THEN at_ms END AS ts FROM ev""")
def validated_rows(t):
    return dq.apply_rules(raw(t), RULES, VNOW).drop("issues").withColumn("amt", F.col("amt").cast("double"))


@query("V02", f"WITH {VAL} SELECT field, reason, count(*) AS n, min(event_id) AS example FROM iss WHERE reason IS NOT NULL GROUP BY 1,2")
def issue_report(t):
    return dq.issue_report(dq.apply_rules(raw(t), RULES, VNOW), "event_id")


# ---- feeds -----------------------------------------------------------------------------


def documents(t, what: str):
    """Provider documents written from parts as JSON and read back with the feed's schema."""
    k = F.col("p_partkey")
    s = lambda c: (F.lit(c) if isinstance(c, (int, float, str)) else c).cast("string")
    a = F.concat(F.lit("T"), k.cast("string"))
    if what == "pairs":
        fr = lambda c: F.struct(*[s(c + i).alias(f) for i, f in enumerate(X.FRAMES)])
        tx = F.struct(*[F.struct(s(k + i).alias("buys"), F.when(k % 9 == 0, "1.5").otherwise(s(k)).alias("sells")).alias(f) for i, f in enumerate(X.FRAMES)])
        doc = F.struct(a.alias("asset"), F.concat(F.lit("S"), (k % 100).cast("string")).alias("pairAddress"), F.lit("dex").alias("dexId"), s(F.col("p_retailprice")).alias("priceUsd"),
                       F.struct(F.when(k % 7 == 0, "-1").otherwise(s(k * 10)).alias("usd")).alias("liquidity"), s(k).alias("fdv"), s(F.lit(1_600_000_000) + k).alias("pairCreatedAt"), fr(k % 100).alias("volume"), F.struct(*[F.when(k % 5 == 0, "-200").otherwise(s(k % 50)).alias(f) for f in X.FRAMES]).alias("priceChange"), tx.alias("txns"))
        schema = X.PAIR_SCHEMA
    elif what == "info":
        doc = F.struct(a.alias("asset"), F.col("p_brand").alias("symbol"), F.col("p_name").alias("name"), F.when(k % 8 == 0, "-3").otherwise(s(k)).alias("holderCount"), F.when(k % 9 == 0, "101").otherwise(s(k % 100)).alias("organicScore"), s(F.col("p_retailprice")).alias("liquidity"),
                       F.lit("1").alias("usdPrice"), F.struct(F.when(k % 6 == 0, "never").otherwise("2021-01-01T00:00:00Z").alias("createdAt")).alias("firstPool"),
                       F.struct(F.when(k % 4 == 0, "maybe").otherwise("true").alias("mintAuthorityDisabled"), F.lit("false").alias("freezeAuthorityDisabled"), s(k % 90).alias("topHoldersPercentage")).alias("audit"), F.struct(s(k).alias("numBuys"), s(k).alias("numSells"), s(-k).alias("holderChange")).alias("stats24h"))
        schema = X.INFO_SCHEMA
    else:
        r = lambda n, lv: F.struct(n.alias("name"), lv.alias("level"), F.lit("d").alias("description"), F.lit("1").alias("score"))
        risks = F.array(r(F.when(k % 3 != 0, F.col("p_name")), F.lit("Danger")), r(F.lit("Low Liquidity"), F.when(k % 4 == 0, "catastrophic").when(k % 4 == 1, "").otherwise("warn")))
        doc = F.struct(a.alias("asset"), s(k).alias("score"), F.when(k % 10 == 0, "250").otherwise(s(k % 100)).alias("score_normalised"), risks.alias("risks"))
        schema = X.REPORT_SCHEMA
    return t.part.select(F.to_json(doc).alias("json")).select(F.from_json("json", schema).alias("d")).select("d.*")


@query("S11", """SELECT 'T'||p_partkey AS asset, CASE WHEN p_partkey%7<>0 THEN (p_partkey*10)::DOUBLE END AS liquidity, (1600000000+p_partkey)*1000 AS created_at, (p_partkey%100+3)::DOUBLE AS volume_h24, CASE WHEN p_partkey%5<>0 THEN (p_partkey%50)::DOUBLE END AS change_h1, (p_partkey+1)::DOUBLE AS buys_h1,
 CASE WHEN p_partkey%9<>0 THEN p_partkey::DOUBLE END AS sells_h1, (p_partkey%7=0)::INT+4*(p_partkey%5=0)::INT+4*(p_partkey%9=0)::INT AS issues FROM part""")
def pair_feed(t):
    return X.normalize_pairs(documents(t, "pairs"), ASSET_NOW * 2).select("asset", "liquidity", "created_at", "volume_h24", "change_h1", "buys_h1", "sells_h1", F.size("issues").alias("issues"))


@query("S12", """SELECT 'T'||p_partkey AS asset, CASE WHEN p_partkey%8<>0 THEN p_partkey::DOUBLE END AS holders, CASE WHEN p_partkey%9<>0 THEN (p_partkey%100)::DOUBLE END AS organic, CASE WHEN p_partkey%6<>0 THEN 1609459200000 END AS first_pool_at, CASE WHEN p_partkey%4<>0 THEN true END AS mint_disabled, (p_partkey%90)::DOUBLE AS top_holders, (-p_partkey)::DOUBLE AS holder_change,
 (p_partkey%8=0)::INT+(p_partkey%9=0)::INT+(p_partkey%6=0)::INT+(p_partkey%4=0)::INT AS issues FROM part""")
def asset_info_feed(t):
    return X.normalize_asset_info(documents(t, "info"), ASSET_NOW * 2).select("asset", "holders", "organic", "first_pool_at", "mint_disabled", "top_holders", "holder_change", F.size("issues").alias("issues"))


@query("S13", """SELECT 'T'||p_partkey AS asset, p_partkey::DOUBLE AS score, CASE WHEN p_partkey%10<>0 THEN (p_partkey%100)::DOUBLE END AS score_normalised, array_to_string(list_filter([CASE WHEN p_partkey%3<>0 THEN p_name||'/danger' END, CASE WHEN p_partkey%4<>0 THEN 'Low Liquidity/'||CASE WHEN p_partkey%4=1 THEN 'info' ELSE 'warn' END END], lambda x: x IS NOT NULL),',') AS risks,
 (p_partkey%10=0)::INT+(p_partkey%4=0)::INT AS issues FROM part""")
def risk_report_feed(t):
    r = X.normalize_risk_report(documents(t, "report"), ASSET_NOW * 2)
    return r.select("asset", "score", "score_normalised", F.array_join(F.transform("risks", lambda x: F.concat(x["name"], F.lit("/"), x["level"])), ",").alias("risks"), F.size("issues").alias("issues"))


@query("S14", """WITH h AS (SELECT 'S'||l_suppkey AS asset, 'C'||o_custkey AS account, CASE WHEN l_suppkey%10=0 AND o_custkey%500=1 THEN NULL ELSE sum(CAST(l_quantity AS BIGINT)) END AS amount FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY l_suppkey, o_custkey),
 r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY amount DESC NULLS LAST, account) AS rn FROM h), g AS (SELECT asset, bool_or(amount IS NULL) AS bad, count(*) AS accounts, sum(CASE WHEN rn<=10 THEN amount END) AS t, max(amount) AS l, sum(amount) AS tot FROM r GROUP BY 1),
 s AS (SELECT *, CASE WHEN asset LIKE '%7' THEN 10 ELSE tot END AS supply FROM g)
 SELECT asset, accounts, CASE WHEN bad THEN NULL WHEN t>supply THEN NULL ELSE ((t::HUGEINT*1000000000)//supply)::DOUBLE/1e9 END AS top10_share, CASE WHEN bad OR t>supply THEN NULL ELSE ((l::HUGEINT*1000000000)//supply)::DOUBLE/1e9 END AS largest_share, CASE WHEN bad THEN 'holder balance unreadable' WHEN t>supply THEN 'balances exceed supply' END AS issue FROM s""")
def mint_account_facts(t):
    lt = t.line_trades()
    h = lt.groupBy(F.col("pool").alias("asset"), F.col("wallet").alias("account")).agg(F.sum("token_amount").cast("decimal(20,0)").alias("q"))
    bad = (F.substring("asset", 2, 20).cast("int") % 10 == 0) & (F.substring("account", 2, 20).cast("int") % 500 == 1)
    h = h.select("asset", "account", F.when(~bad, F.col("q")).alias("amount"))
    acc = h.groupBy("asset").agg(F.sum("amount").alias("tot")).select(
        "asset", F.lit(None).cast("string").alias("mint_authority"), F.lit(None).cast("string").alias("freeze_authority"), F.lit(True).alias("mint_stated"), F.lit(True).alias("freeze_stated"), F.lit(6).alias("decimals"),
        F.when(F.col("asset").endswith("7"), F.lit(10)).otherwise(F.col("tot")).cast("decimal(20,0)").alias("supply"))
    return X.mint_facts(acc, h).select("asset", "accounts", "top10_share", "largest_share", "issue")


@query("S10", """WITH f AS (SELECT 'T'||l_partkey AS asset, 0 AS f, 'lines' AS n, NULL AS symbol, NULL AS name FROM lineitem UNION SELECT 'T'||p_partkey, 1, 'parts', p_brand, CASE WHEN p_partkey%2=0 THEN p_name END FROM part UNION SELECT 'T'||o_orderkey, 2, 'orders', o_orderpriority, 'C'||o_custkey FROM orders)
 SELECT asset, array_to_string(list_transform(list_sort(list(DISTINCT (f,n))), lambda x: x[2]),',') AS sources, arg_min(symbol, f) FILTER (symbol IS NOT NULL) AS symbol, arg_min(name, f) FILTER (name IS NOT NULL) AS name FROM f GROUP BY 1""")
def merged_candidates(t):
    T = lambda c: F.concat(F.lit("T"), F.col(c).cast("string")).alias("asset")
    none = F.lit(None).cast("string")
    feeds = {"lines": t.lineitem.select(T("l_partkey"), none.alias("symbol"), none.alias("name")), "parts": t.part.select(T("p_partkey"), F.col("p_brand").alias("symbol"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("name")),
             "orders": t.orders.select(T("o_orderkey"), F.col("o_orderpriority").alias("symbol"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("name"))}
    return X.merge_candidates(feeds).withColumn("sources", F.array_join("sources", ","))


def state_docs(t):
    """One nested state document per customer: its orders are the assets, each with two points."""
    o = t.orders.select("o_custkey", F.struct(
        F.when(F.col("o_orderkey") % 50 == 0, " ").otherwise(F.concat(F.lit("T"), F.col("o_orderkey").cast("string"))).alias("k"),
        F.struct(F.col("o_orderpriority").alias("symbol"), F.lit("n?token=abc").alias("name"), F.when(F.col("o_orderkey") % 40 != 0, millis("o_orderdate")).alias("at"), (F.col("o_orderkey") % 100).cast("double").alias("score"),
                 F.array(F.struct(millis("o_orderdate").alias("t"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 120).cast("double").alias("score"), F.lit(1.0).alias("liquidity")),
                         F.struct(F.when(F.col("o_orderkey") % 3 != 0, millis("o_orderdate") + 1).alias("t"), F.lit(2.0).alias("price"), F.lit(5.0).alias("score"), F.lit(None).cast("double").alias("liquidity"))).alias("points")).alias("v")).alias("e"))
    g = o.groupBy("o_custkey", F.col("e.k").alias("k")).agg(F.max("e.v").alias("v")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("tokens"))
    return g.select(F.to_json(F.struct("tokens")).alias("json"))


@query("S30", """SELECT 'T'||o_orderkey AS asset, o_orderpriority AS symbol, 'n?token=***' AS name, epoch_us(o_orderdate)//1000 AS at_ms FROM orders WHERE o_orderkey%50<>0 AND o_orderkey%40<>0""")
def backfilled_assets(t):
    return X.backfill_state(state_docs(t))[0].select("asset", "symbol", "name", F.col("at").alias("at_ms"))


@query("S30", """SELECT 'T'||o_orderkey AS asset, epoch_us(o_orderdate)//1000 AS t_ms, o_totalprice AS price FROM orders WHERE o_orderkey%50<>0 AND o_orderkey%40<>0 AND o_orderkey%120<=100
 UNION ALL SELECT 'T'||o_orderkey, epoch_us(o_orderdate)//1000+1, 2.0 FROM orders WHERE o_orderkey%50<>0 AND o_orderkey%40<>0 AND o_orderkey%3<>0""")
def backfilled_points(t):
    return X.backfill_state(state_docs(t))[1].select("asset", F.col("t").alias("t_ms"), "price")


# ---- text ------------------------------------------------------------------------------


@query("S32", """SELECT doc_id, md5(regexp_replace(text||' see https://x.io/a?api_key='||doc_id||'&q=1&token=zz', '([?&](?:api[-_]?key|key|token|secret|password|access[-_]?token)=)([^&\\s]+)', '\\1***', 'gi')) AS digest FROM documents""")
def redacted_text(t):
    c = F.concat(F.col("text"), F.lit(" see https://x.io/a?api_key="), F.col("doc_id").cast("string"), F.lit("&q=1&token=zz"))
    return t.documents.select("doc_id", F.md5(redact(c)).alias("digest"))


@query("S33", r"""SELECT doc_id, nullif(substr(trim(regexp_replace(regexp_replace(text, '[\x{00}-\x{1F}\x{7F}-\x{9F}]', ' ', 'g'), '\s+', ' ', 'g')), 1, 64), '') AS clean FROM documents""")
def sanitized_text(t):
    return t.documents.select("doc_id", sanitize("text", 64).alias("clean"))




@query("L01", "SELECT c_custkey, regexp_replace(translate(lower(c_name||'$5o7'),'01|35$47','ollessat'), '[^a-z]', '', 'g') AS folded FROM customer")
def folded_names(t):
    return t.customer.select("c_custkey", fold_ticker(F.concat("c_name", F.lit("$5o7"))).alias("folded"))


@query("L02", """WITH c AS (SELECT p_partkey AS key, p_name AS name, regexp_replace(translate(lower(p_name),'01|35$47','ollessat'), '[^a-z]', '', 'g') AS f FROM part), rf AS (SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 1000+p_partkey, p_name FROM part WHERE p_partkey<40 AND p_partkey%4=0),
 r AS (SELECT key, name, regexp_replace(translate(lower(name),'01|35$47','ollessat'), '[^a-z]', '', 'g') AS f FROM rf) SELECT c.key, c.name, r.key AS ref_key, r.name AS ref_name FROM c JOIN r ON c.key<>r.key AND length(c.f)>0 AND length(r.f)>0 AND abs(length(c.f)-length(r.f))<=CASE WHEN length(r.f)<=4 THEN 1 ELSE 2 END AND levenshtein(c.f,r.f)<=CASE WHEN length(r.f)<=4 THEN 1 ELSE 2 END""")
def look_alikes(t):
    c = t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    r = t.nation.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")).unionByName(c.where("key < 40 AND key % 4 = 0").withColumn("key", F.col("key") + 1000))
    return near_matches(c, r)
