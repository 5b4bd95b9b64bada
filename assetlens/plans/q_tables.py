"""Selection and table-maintenance queries."""

from pyspark.sql import functions as F

from assetlens.operators import place as P
from assetlens.operators import tables as S
from assetlens.plans.registry import query
from assetlens.plans.sqltext import ACT, AS, ASSET_NOW, EV, LT, PLACE, TR, VD, tier
from assetlens.sources.tables import ASSET_NOW as NOW
from assetlens.sources.tables import millis

SURV = "verdict IN ('HIGH_POTENTIAL','QUALIFIED','WATCH','HIGH_RISK')"
SORD = "CASE verdict WHEN 'HIGH_POTENTIAL' THEN 0 WHEN 'QUALIFIED' THEN 1 WHEN 'WATCH' THEN 2 ELSE 3 END"


@query("F01", f"WITH {AS} SELECT asset, liquidity, age_hours FROM ast WHERE liquidity>=3000 AND (age_hours IS NULL OR age_hours<=720) ORDER BY liquidity DESC, asset LIMIT 60")
def viable_candidates(t):
    return P.viable_candidates(t.assets(), 60).select("asset", "liquidity", "age_hours")


@query("F02", f"WITH {AS}, {PLACE} SELECT asset, universe, freshness, verdict FROM pl")
def placement(t):
    return P.place(t.assets(), NOW).select("asset", "universe", "freshness", "verdict")


@query("F03", f"""WITH {AS}, {PLACE} SELECT count(*) FILTER (universe='LIVE') AS live, count(*) FILTER (universe='STALE') AS stale, count(*) FILTER (universe='UNEVALUATED') AS unevaluated, count(*) AS total,
 {", ".join(f"count(*) FILTER (universe='LIVE' AND verdict='{v}') AS {v.lower()}" for v in P.VERDICT_TIER)} FROM pl""")
def universe_counts(t):
    return P.count_universe(P.place(t.assets(), NOW))


@query("F04", f"WITH {AS}, {PLACE} SELECT asset, universe='LIVE' AS live, coalesce({SURV},false) AS survivor, coalesce(verdict IN ('HIGH_POTENTIAL','QUALIFIED','WATCH'),false) AS candidate FROM pl")
def universe_predicates(t):
    p = P.place(t.assets(), NOW)
    return p.select("asset", P.is_live().alias("live"), P.is_survivor().alias("survivor"), P.is_candidate().alias("candidate"))


PAIRS = """pp AS (SELECT 'T'||l_partkey AS asset, 'S'||l_suppkey AS pool, CASE WHEN l_suppkey%7<>0 THEN sum(CAST(round(l_extendedprice*100) AS BIGINT))/100.0::DOUBLE END AS liquidity,
  CASE WHEN l_suppkey%5<>0 THEN sum(CAST(l_quantity AS BIGINT))::DOUBLE END AS volume24h, l_suppkey AS position FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def pairs(t):
    k = F.col("l_suppkey")
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("_c"), F.sum(F.col("l_quantity").cast("long")).alias("_q")).select(
        F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("asset"), F.concat(F.lit("S"), k.cast("string")).alias("pool"),
        F.when(k % 7 != 0, F.col("_c") / 100.0).alias("liquidity"), F.when(k % 5 != 0, F.col("_q").cast("double")).alias("volume24h"), k.alias("position"))


@query("F05", f"WITH {PAIRS} SELECT asset, arg_max(pool, (coalesce(liquidity,-1.0),-position)) AS pool, max(coalesce(liquidity,-1.0)) AS depth FROM pp GROUP BY 1")
def best_pool(t):
    return P.best_pool(pairs(t)).select("asset", "pool", F.coalesce("liquidity", F.lit(-1.0)).alias("depth"))


@query("F05", f"WITH {PAIRS}, r AS (SELECT asset, pool, volume24h, row_number() OVER (PARTITION BY asset ORDER BY coalesce(volume24h,-1.0) DESC, pool) AS rank FROM pp) SELECT * FROM r")
def pool_list(t):
    return P.pool_refs(pairs(t)).select("asset", "pool", "volume24h", F.col("rank").cast("long").alias("rank"))


@query("F06", f"""WITH {PAIRS}, b AS (SELECT asset, arg_max(pool, (coalesce(liquidity,-1.0),-position)) AS best, sum(coalesce(volume24h,0)) AS tv FROM pp GROUP BY 1),
 x AS (SELECT pp.asset, pool, volume24h, pool=best AS is_primary FROM pp JOIN b ON pp.asset=b.asset WHERE pool=best OR (tv>0 AND coalesce(volume24h,0)/tv>=0.1)),
 r AS (SELECT asset, pool, row_number() OVER (PARTITION BY asset ORDER BY is_primary DESC, coalesce(volume24h,0) DESC, pool) AS rank FROM x) SELECT * FROM r WHERE rank<=3""")
def selected_pools(t):
    p = pairs(t)
    best = P.best_pool(p).select("asset", F.col("pool").alias("best"))
    p = p.join(best, "asset").withColumn("is_primary", F.col("pool") == F.col("best"))
    return P.select_pools(p, 3, 0.1).select("asset", "pool", F.col("rank").cast("long").alias("rank"))


CURS = "cu AS (SELECT 'S'||s_suppkey AS pool, CAST(floor(s_acctbal*100) AS BIGINT) AS last_collected FROM supplier WHERE s_suppkey%3<>0)"


def cursors(t):
    return t.supplier.where("s_suppkey % 3 <> 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("pool"), F.floor(F.col("s_acctbal") * 100).alias("last_collected"))


@query("F07", f"""WITH {AS}, {CURS} SELECT ast.asset, ast.pool, verdict FROM ast LEFT JOIN cu ON ast.pool=cu.pool WHERE {SURV} AND {ASSET_NOW}-at_ms<=5400000 AND ast.pool IS NOT NULL
 ORDER BY {SORD}, coalesce(last_collected,-1), coalesce(liquidity,0) DESC, ast.asset LIMIT 40""")
def collection_worklist(t):
    return P.collection_worklist(t.assets(), cursors(t), NOW, 40)[0]


@query("F07", f"""WITH {AS}, w AS (SELECT CASE WHEN NOT coalesce({SURV},false) THEN 'not_survivor' WHEN {ASSET_NOW}-at_ms>5400000 THEN 'not_live' WHEN pool IS NULL THEN 'no_pool' ELSE 'over_budget' END AS reason, count(*) AS n FROM ast GROUP BY 1)
 SELECT reason, CASE WHEN reason='over_budget' THEN greatest(n-40,0) ELSE n END AS skipped FROM w""")
def collection_skips(t):
    return P.collection_worklist(t.assets(), cursors(t), NOW, 40)[1]


INTEL = f"""{AS}, la2 AS (SELECT 'T'||o_orderkey AS asset, {ASSET_NOW}-(o_orderkey%300)*60000 AS last_analyzed FROM orders WHERE o_orderkey%4<>0),
 ai AS (SELECT ast.*, last_analyzed, score AS opportunity, seq%3=0 AS oib, CASE WHEN seq%10=1 THEN 'ELEVATED' ELSE 'CLEAR' END AS ib, seq%12=2 AS pend, CASE seq%9 WHEN 0 THEN 'UNSTABLE' WHEN 1 THEN 'DECLINING' ELSE 'NEUTRAL' END AS mom
  FROM ast LEFT JOIN la2 ON ast.asset=la2.asset)"""


def intel_assets(t):
    s = F.col("seq")
    a = t.assets().withColumns({
        "opportunity": F.col("score"), "only_intel_blockers": s % 3 == 0, "integrity_band": F.when(s % 10 == 1, "ELEVATED").otherwise("CLEAR"),
        "pending": s % 12 == 2, "momentum": F.when(s % 9 == 0, "UNSTABLE").when(s % 9 == 1, "DECLINING").otherwise("NEUTRAL")})
    last = t.orders.where("o_orderkey % 4 <> 0").select(F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("asset"),
                                                      (F.lit(NOW) - (F.col("o_orderkey") % 300) * 60_000).alias("last_analyzed"))
    return a, last


@query("F08", f"""WITH {INTEL}, p AS (SELECT asset, verdict, liquidity, floor((CASE verdict WHEN 'HIGH_POTENTIAL' THEN 40 WHEN 'QUALIFIED' THEN 30 WHEN 'WATCH' THEN 15 ELSE 12 END + CASE WHEN last_analyzed IS NULL THEN 30.0::DOUBLE ELSE least(25.0::DOUBLE,({ASSET_NOW}-last_analyzed)/3600000.0::DOUBLE*8) END
  + CASE WHEN verdict='QUALIFIED' AND opportunity>=55 AND oib THEN 15 ELSE 0 END + CASE WHEN ib='ELEVATED' THEN 12 ELSE 0 END + CASE WHEN pend THEN 10 ELSE 0 END + CASE WHEN mom IN ('UNSTABLE','DECLINING') THEN 8 ELSE 0 END
  - CASE WHEN coalesce(liquidity,0)<10000 THEN 10 ELSE 0 END)*10.0::DOUBLE+0.5)/10 AS priority FROM ai WHERE {SURV} AND {ASSET_NOW}-at_ms<=5400000 AND (last_analyzed IS NULL OR {ASSET_NOW}-last_analyzed>=1800000))
 SELECT asset, verdict, priority FROM p ORDER BY priority DESC, {SORD}, coalesce(liquidity,0) DESC, asset LIMIT 50""")
def analysis_worklist(t):
    return P.analysis_worklist(*intel_assets(t), NOW, 50)[0]


WSEL = f"""{LT}, wa AS (SELECT wallet, asset, min(slot) AS first_slot, count(*) FILTER (side='BUY') AS buys, sum(CASE WHEN side='BUY' THEN quote_amount ELSE 0 END) AS bought FROM lt GROUP BY 1,2),
 cre AS (SELECT 'T'||o_orderkey AS asset, 'C'||o_custkey AS wallet FROM orders),
 e AS (SELECT asset, wallet, row_number() OVER (PARTITION BY asset ORDER BY first_slot, wallet) AS r FROM wa WHERE buys>0 AND (asset, wallet) NOT IN (SELECT (asset, wallet) FROM cre)),
 l AS (SELECT asset, wallet, row_number() OVER (PARTITION BY asset ORDER BY bought DESC, wallet) AS r FROM wa WHERE buys>0 AND (asset, wallet) NOT IN (SELECT (asset, wallet) FROM cre)),
 cn AS (SELECT asset, count(*) AS c FROM cre GROUP BY 1),
 u AS (SELECT asset, wallet, 0 AS g, 1 AS r FROM cre UNION ALL SELECT e.asset, wallet, CASE WHEN r<=ceil((6-coalesce(c,0))/2) THEN 1 ELSE 3 END, r FROM e LEFT JOIN cn ON e.asset=cn.asset WHERE r<=6 UNION ALL SELECT asset, wallet, 2, r FROM l WHERE r<=6),
 m AS (SELECT asset, wallet, min((g,r)) AS o FROM u GROUP BY 1,2), k AS (SELECT asset, wallet, row_number() OVER (PARTITION BY asset ORDER BY o) AS rank FROM m)"""


@query("F09", f"WITH {WSEL} SELECT asset, wallet, rank FROM k WHERE rank<=6")
def selected_wallets(t):
    lt = t.line_trades()
    arr = S.wallet_asset_activity(lt.withColumn("status", F.lit("SUCCESS")))
    bought = lt.where("side = 'BUY'").groupBy("asset", "wallet").agg(F.sum("quote_amount").alias("bought"))
    creators = t.launches().select("asset", F.col("creator").alias("wallet"))
    return P.select_wallets(arr, bought, creators, 6).select("asset", "wallet", F.col("rank").cast("long").alias("rank"))


ROLES = [*P.HIGHLIGHT_ROLES, *["top"] * 8]
PICKS = f"""{AS}, {PLACE}, live AS (SELECT * FROM pl WHERE universe='LIVE'),
 ch AS (SELECT ast.asset, ast.verdict, CASE WHEN ast.seq%2=0 THEN 'WATCH' END AS prev, CAST({NOW}-ast.score*60000 AS BIGINT) AS t, live.verdict AS now_ FROM ast JOIN live USING (asset) WHERE ast.verdict IS NOT NULL),
 li AS (SELECT 'changed' AS role, list(asset ORDER BY t DESC, asset) AS l FROM (SELECT asset, max(t) AS t FROM ch WHERE prev<>verdict AND {NOW}-t<=86400000 AND now_=verdict GROUP BY 1)
  UNION ALL SELECT 'newest', list(asset ORDER BY t DESC, asset) FROM (SELECT asset, max(t) AS t FROM ch WHERE prev IS NULL GROUP BY 1)
  UNION ALL SELECT 'top', list(asset ORDER BY {tier('verdict')}, coalesce(rank_score,score) DESC, at_ms DESC, asset) FROM live WHERE verdict IN ('HIGH_POTENTIAL','QUALIFIED')
  UNION ALL SELECT 'watch', list(asset ORDER BY at_ms DESC, asset) FROM live WHERE verdict='WATCH' UNION ALL SELECT 'rejected', list(asset ORDER BY at_ms DESC, asset) FROM live WHERE verdict='REJECTED'),
 st AS (SELECT unnest({ROLES!r}) AS role, unnest(range(1,{len(ROLES) + 1})) AS i),
 go AS (SELECT 0 AS i, []::VARCHAR[] AS picked, []::VARCHAR[] AS roles UNION ALL SELECT st.i, CASE WHEN len(picked)<8 AND f IS NOT NULL THEN list_append(picked, f) ELSE picked END, CASE WHEN len(picked)<8 AND f IS NOT NULL THEN list_append(roles, st.role) ELSE roles END
  FROM (SELECT go.*, s2.i AS ni, (SELECT list_filter(l, lambda x: NOT list_contains(go.picked, x))[1] FROM li WHERE li.role=s2.role) AS f FROM go JOIN st s2 ON s2.i=go.i+1) x JOIN st ON st.i=x.ni)"""


@query("F10", f"WITH RECURSIVE {PICKS} SELECT CAST(unnest(range(len(picked))) AS INTEGER) AS slot, unnest(picked) AS asset, unnest(roles) AS role FROM go WHERE i={len(ROLES)}")
def highlights(t):
    live = P.place(t.assets(), NOW).where(P.is_live())
    s = F.col("seq")
    ch = t.assets().where("verdict IS NOT NULL").select(
        "asset", "verdict", F.when(s % 2 == 0, "WATCH").alias("prev_verdict"), (F.lit(NOW) - F.col("score") * 60_000).cast("long").alias("changed_at"))
    return P.pick_highlights(live, ch, NOW)


def board_sql(cond: str, keys: str, n: int) -> str:
    return f"WITH {AS}, {PLACE} SELECT asset, verdict, score, freshness FROM pl WHERE universe='LIVE' AND {cond} ORDER BY {tier('verdict')}, {keys}, asset LIMIT {n}"


CAND = "verdict IN ('HIGH_POTENTIAL','QUALIFIED','WATCH')"
COLS = ["asset", "verdict", "score", "freshness"]


@query("H12", board_sql(CAND, "coalesce(rank_score,-1) DESC, score DESC", 200))
def board_candidates(t):
    return P.board(t.assets(), NOW).select(*COLS)


@query("H12", board_sql("lower(symbol||' '||name||' '||asset) LIKE '%high%'", "change1h DESC NULLS LAST", 150))
def board_search_momentum(t):
    return P.board(t.assets(), NOW, q="HIGH", sort="momentum", limit=150).select(*COLS)


@query("H12", board_sql("verdict='WATCH'", "age_hours NULLS LAST", 100))
def board_watch_newest(t):
    return P.board(t.assets(), NOW, segment="watch", sort="newest", limit=100).select(*COLS)


@query("H12", f"WITH {AS}, {PLACE} SELECT asset, universe, verdict FROM pl WHERE universe<>'LIVE' AND lower(symbol||' '||name||' '||asset) LIKE '%urgent%' ORDER BY at_ms DESC, asset LIMIT 20")
def board_history(t):
    return P.board_history(t.assets(), NOW, "urgent").select("asset", "universe", "verdict")


@query("H13", f"WITH {AS} SELECT asset, coalesce(rank_score, score) AS rank_key, greatest(0.0::DOUBLE,({ASSET_NOW}-launched_at)/3600000.0::DOUBLE) AS age FROM ast")
def rank_and_age(t):
    return t.assets().select("asset", P.rank_key().alias("rank_key"), P.current_age(NOW).alias("age"))


@query("M07", f"WITH {AS} SELECT asset, verdict FROM ast ORDER BY coalesce({tier('verdict')},9), coalesce(rank_score,score) DESC, asset LIMIT 10")
def top_of_batch(t):
    from assetlens.operators.monitor import top_of_batch as top

    return top(t.assets()).select("asset", "verdict")


# ---- table maintenance -----------------------------------------------------------------


@query("S16", f"WITH {ACT} SELECT tx_id, asset, pool FROM act WHERE tx_index%3<>0")
def idempotent_append(t):
    a = t.activity()
    new = a.unionByName(a.where("tx_index % 5 = 0"))
    return S.append_idempotent(new, a.where("tx_index % 3 = 0"), ["tx_id", "pool", "asset"]).select("tx_id", "asset", "pool")


@query("S17", f"WITH {ACT} SELECT tx_id FROM act WHERE tx_index%2=0 AND tx_index%3=0")
def known_page_keys(t):
    a = t.activity()
    return S.known_keys(a.where("tx_index % 2 = 0"), a.where("tx_index % 3 = 0"))


@query("S18", f"WITH {EV} SELECT 'A'||(k%10) AS asset, event_type AS source, min(at_ms) AS first_seen_at, max(at_ms) AS last_seen_at, count(*) AS times_seen FROM ev GROUP BY 1,2")
def discovery_provenance(t):
    e = t.event_facts()
    return S.discovery_provenance(e.select(F.concat(F.lit("A"), (F.col("k") % 10).cast("string")).alias("asset"), F.col("event_type").alias("source"), "at"))


@query("S19", f"WITH {ACT} SELECT wallet, min(block_time) AS first_observed_at, max(block_time) AS last_observed_at, arg_min(tx_id, (block_time, tx_id)) AS first_tx FROM act GROUP BY 1")
def wallet_registry(t):
    return S.wallet_registry(t.activity())


@query("S20", f"""WITH {TR} SELECT wallet, asset, min(slot) AS first_slot, min(block_time) AS first_observed_at, arg_min(tx_id, (slot, tx_id)) AS first_tx, max(block_time) AS last_observed_at,
 count(*) FILTER (side='BUY') AS buys, count(*) FILTER (side='SELL') AS sells FROM tr GROUP BY 1,2""")
def wallet_asset_activity(t):
    return S.wallet_asset_activity(t.activity())


@query("S21", f"""WITH {VD} SELECT asset, min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at, arg_max(verdict, seq) AS verdict, arg_max(score, seq) AS score,
 arg_max(price, seq) FILTER (seq%3=0) AS price, arg_max(liquidity, seq) FILTER (seq%4=1) AS liquidity FROM vd GROUP BY 1""")
def latest_assets(t):
    s = t.verdicts().withColumns({"price": F.when(F.col("seq") % 3 == 0, F.col("price")), "liquidity": F.when(F.col("seq") % 4 == 1, F.col("liquidity"))})
    return S.latest_assets(s, ["price", "liquidity"], ["verdict", "score"], ["observed_at", "seq"])


def snapshots(t):
    s = F.col("seq")
    return t.verdicts().withColumns({
        "is_transition": s % 6 == 0, "volume24h": F.col("score") * 10, "price": F.when(s % 4 != 0, F.col("price")),
        "liquidity": F.when(s % 4 != 0, F.col("liquidity")), "holders": F.when(s % 3 == 0, s),
        "pools": F.when(s % 2 == 0, F.array(F.struct(F.lit("P0").alias("pool"), s.alias("depth")), F.struct(F.lit("P1").alias("pool"), (s + 1).alias("depth")))),
        "failures": F.when(s % 10 == 0, F.array(F.struct(F.lit("jupiter").alias("provider"), F.lit("TIMEOUT").alias("kind"))))})


@query("S22", f"""WITH {VD} SELECT 'verdicts' AS tbl, count(*) AS n, count(DISTINCT asset) AS assets FROM vd UNION ALL SELECT 'market', count(*), count(DISTINCT asset) FROM vd WHERE seq%4<>0
 UNION ALL SELECT 'holders', count(*), count(DISTINCT asset) FROM vd WHERE seq%3=0 UNION ALL SELECT 'pools', count(*)*2, count(DISTINCT asset) FROM vd WHERE seq%2=0""")
def history_fan_out(t):
    out = S.fan_out_history(snapshots(t))
    rows = [out[n].agg(F.lit(n).alias("tbl"), F.count("*").alias("n"), F.countDistinct("asset").alias("assets")) for n in ("verdicts", "market", "holders", "pools")]
    u = rows[0]
    for r in rows[1:]:
        u = u.unionByName(r)
    return u


@query("S22", f"WITH {VD} SELECT DISTINCT observed_at, 'jupiter' AS provider, 'TIMEOUT' AS kind FROM vd WHERE seq%10=0")
def failure_history(t):
    return S.fan_out_history(snapshots(t))["failures"]


@query("S24", """WITH e AS (SELECT l_partkey||'/'||l_suppkey AS id, l_partkey, l_suppkey, count(*) AS c, min(epoch_us(l_shipdate)//1000) AS f, max(epoch_us(l_shipdate)//1000) AS l, l_linestatus AS st FROM lineitem GROUP BY l_partkey, l_suppkey, l_linestatus)
 SELECT id, 'FUNDED' AS type, 'S'||l_suppkey AS a, 'T'||l_partkey AS b, coalesce(max(CASE WHEN st='O' THEN 0.9::DOUBLE END), 0.55::DOUBLE) AS confidence, CASE WHEN bool_or(st='O') THEN 'O' ELSE 'F' END AS detail, max(c) AS count, min(f) AS first_at, max(l) AS last_at FROM e GROUP BY 1,3,4""")
def merged_edges(t):
    from assetlens.operators import graph as N

    l = t.lineitem

    def side(st, conf):
        return l.where(F.col("l_linestatus") == st).groupBy("l_partkey", "l_suppkey").agg(
            F.count("*").alias("count"), F.min(millis("l_shipdate")).alias("first_at"), F.max(millis("l_shipdate")).alias("last_at")).select(
            F.concat_ws("/", "l_partkey", "l_suppkey").alias("id"), F.lit("FUNDED").alias("type"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("a"),
            F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("b"), F.lit(conf).alias("confidence"), F.lit(st).alias("detail"), "count", "first_at", "last_at")

    return N.merge_edges(side("F", 0.55), side("O", 0.9))


MF = f"""{EV}, st AS (SELECT event_id AS id, 'A'||(event_id%10) AS asset, CASE event_id%3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'SUSPICIOUS' ELSE 'UNKNOWN' END AS status, 0.5::DOUBLE AS confidence,
  CASE WHEN event_id%4=0 THEN 'v0' ELSE 'v1' END AS rv, CASE WHEN event_id%9=0 THEN 5 END AS sup FROM ev WHERE event_id%5<>0),
 fr AS (SELECT event_id AS id, 'A'||(event_id%10) AS asset, CASE event_id%2 WHEN 0 THEN 'STRONGLY_SUSPECTED' ELSE 'SUSPICIOUS' END AS status, 0.75::DOUBLE AS confidence FROM ev WHERE event_id%3<>0 AND event_id%10<8),
 j AS (SELECT coalesce(st.id,fr.id) AS id, coalesce(st.asset,fr.asset) AS asset, st.status AS ss, fr.status AS fs, st.confidence AS sc, fr.confidence AS fcf, rv, sup, st.id AS sid, fr.id AS fid FROM st FULL JOIN fr ON st.id=fr.id),
 a AS (SELECT *, CASE WHEN fid IS NOT NULL AND sid IS NULL THEN 'NEW' WHEN fid IS NOT NULL AND rv='v1' AND sup IS NULL AND ss='CONFIRMED' THEN 'KEEP' WHEN fid IS NOT NULL AND rv='v1' AND sup IS NULL THEN 'UPDATE'
  WHEN fid IS NOT NULL THEN 'REINTERPRETED' WHEN asset IN (SELECT asset FROM fr) AND sup IS NULL AND rv<>'v1' THEN 'SUPERSEDED' ELSE 'KEEP' END AS act FROM j)"""


def merge_inputs(t):
    e = t.event_facts().select(F.col("event_id").alias("id"))
    i = F.col("id")
    st = e.where("id % 5 <> 0").select(
        "id", F.concat(F.lit("A"), (i % 10).cast("string")).alias("asset"), F.when(i % 3 == 0, "CONFIRMED").when(i % 3 == 1, "SUSPICIOUS").otherwise("UNKNOWN").alias("status"),
        F.lit(0.5).alias("confidence"), F.when(i % 4 == 0, "v0").otherwise("v1").alias("rule_version"), F.when(i % 9 == 0, F.lit(5)).cast("long").alias("superseded_at"), F.lit(1).cast("long").alias("detected_at"))
    fr = e.where("id % 3 <> 0 AND id % 10 < 8").select("id", F.concat(F.lit("A"), (i % 10).cast("string")).alias("asset"),
                                                     F.when(i % 2 == 0, "STRONGLY_SUSPECTED").otherwise("SUSPICIOUS").alias("status"), F.lit(0.75).alias("confidence"))
    return st, fr


@query("S25", f"""WITH {MF} SELECT id, asset, CASE WHEN act IN ('NEW','UPDATE','REINTERPRETED') THEN fs ELSE ss END AS status, CASE WHEN act IN ('NEW','UPDATE','REINTERPRETED') THEN fcf ELSE sc END AS confidence,
 CASE WHEN act IN ('NEW','UPDATE','REINTERPRETED') THEN 'v1' ELSE rv END AS rule_version, CASE WHEN act IN ('NEW','UPDATE','REINTERPRETED') THEN NULL WHEN act='SUPERSEDED' THEN 99::BIGINT ELSE sup::BIGINT END AS superseded_at,
 CASE WHEN act IN ('NEW','UPDATE','REINTERPRETED') THEN 99::BIGINT ELSE 1::BIGINT END AS detected_at FROM a""")
def merged_findings(t):
    return S.merge_findings(*merge_inputs(t), "v1", 99)[0]


@query("S25", f"WITH {MF} SELECT id, asset, ss AS status, rv AS rule_version, 99::BIGINT AS revised_at, 'v1' AS revised_by, act AS change FROM a WHERE act IN ('REINTERPRETED','SUPERSEDED')")
def finding_revisions(t):
    return S.merge_findings(*merge_inputs(t), "v1", 99)[1]


GAPQ = f"""{ACT}, b AS (SELECT asset AS key, CASE WHEN asset<'A5' THEN 200 ELSE 100000 END AS budget, asset<>'A0' AS hc FROM (SELECT DISTINCT asset FROM act)),
 fr AS (SELECT asset AS key, slot, count(*) AS n FROM act WHERE status='SUCCESS' AND tx_index%3<>0 GROUP BY 1,2),
 w AS (SELECT fr.*, budget, hc, coalesce(sum(n) OVER (PARTITION BY fr.key ORDER BY slot DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS bf FROM fr JOIN b ON fr.key=b.key),
 l AS (SELECT *, least(n, greatest(0, bf+n-budget)) AS lf FROM w)"""


@query("S28", f"""WITH {GAPQ} SELECT key, CASE WHEN hc THEN 'over_budget' ELSE 'before_collection_began' END AS reason, CAST(sum(lf) AS BIGINT) AS skipped, min(slot) AS from_slot, max(slot) AS to_slot FROM l WHERE lf>0 GROUP BY key, hc
 UNION ALL SELECT b.key, 'page_limit', NULL, NULL, min(slot) FROM act JOIN b ON act.asset=b.key WHERE hc GROUP BY b.key HAVING count(*)>=1000
 UNION ALL SELECT asset, 'fetch_failed', count(*), min(slot), max(slot) FROM act WHERE status='SUCCESS' AND tx_index%3<>0 AND slot%7=3 GROUP BY 1""")
def gap_ledger(t):
    a = t.activity()
    b = a.select(F.col("asset").alias("key")).distinct().select(
        "key", F.when(F.col("key") < "A5", 200).otherwise(100_000).alias("budget"), (F.col("key") != "A0").alias("had_cursor"))
    page = a.select(F.col("asset").alias("key"), "tx_id", "slot", (F.col("status") == "FAILED").alias("failed"))
    missed = a.where("status = 'SUCCESS' AND tx_index % 3 <> 0 AND slot % 7 = 3").select(F.col("asset").alias("key"), "slot")
    return S.gap_ledger(page, a.where("tx_index % 3 = 0"), b, missed)


RET_NOW = 1_706_659_200_000
RCUT = RET_NOW - 7 * 86_400_000
RTOK = RET_NOW - 2 * 86_400_000
RETQ = f"""{VD}, ae AS (SELECT asset, max(observed_at) AS last_seen_at FROM vd GROUP BY 1), al AS (SELECT asset FROM ae WHERE last_seen_at>={RTOK})"""


@query("S29", f"""WITH {RETQ} SELECT 'assets' AS tbl, count(*) AS n FROM al UNION ALL SELECT 'verdicts', count(*) FROM vd WHERE (observed_at>={RCUT} OR seq%6=0) AND asset IN (SELECT asset FROM al)
 UNION ALL SELECT 'market', count(*) FROM vd WHERE observed_at>={RCUT} AND asset IN (SELECT asset FROM al)
 UNION ALL SELECT 'evidence', count(*) FROM vd WHERE (observed_at>={RCUT} OR seq%6=0) AND asset IN (SELECT asset FROM al)
 UNION ALL SELECT 'findings', count(*) FROM vd WHERE observed_at>={RTOK} OR verdict='REJECTED' UNION ALL SELECT 'alerts', least(500, count(*)) FROM vd
 UNION ALL SELECT 'launches', count(*) FROM vd WHERE observed_at>={RTOK} OR asset IN (SELECT asset FROM ae WHERE asset<>'U1')""")
def retention(t):
    v = t.verdicts()
    assets = v.groupBy("asset").agg(F.max("observed_at").alias("last_seen_at"))
    rows = v.withColumns({"is_transition": F.col("seq") % 6 == 0, "snapshot_id": F.col("seq")})
    frames = {
        "assets": assets, "verdicts": rows, "market": v, "evidence": rows.select("asset", "observed_at", "snapshot_id"),
        "findings": v.select(F.col("observed_at").alias("detected_at"), F.when(F.col("verdict") == "REJECTED", "CONFIRMED").otherwise("SUSPICIOUS").alias("status")),
        "alerts": v.select(F.col("observed_at").alias("at"), F.col("seq").alias("id")),
    }
    out = S.apply_retention(frames, RET_NOW, {"token": 2, "max_events": 500})
    launches = {"assets": assets.where("asset <> 'U1'"), "launches": v.select("asset", F.col("observed_at").alias("block_time"), F.col("observed_at").alias("recorded_at"))}
    out["launches"] = S.apply_retention(launches, RET_NOW, {"launch": 2, "token": 2})["launches"]
    u = None
    for name in ("assets", "verdicts", "market", "evidence", "findings", "alerts", "launches"):
        r = out[name].agg(F.lit(name).alias("tbl"), F.count("*").alias("n"))
        u = r if u is None else u.unionByName(r)
    return u


def findings_sql(asset: str) -> str:
    """Stored findings over the event tape, stated in SQL."""
    return f"""fnd AS (SELECT {asset} AS asset, event_id AS id, CASE event_type WHEN 'purchase' THEN 'CONFIRMED' WHEN 'signup' THEN 'STRONGLY_SUSPECTED' ELSE 'SUSPICIOUS' END AS status,
  CASE WHEN k%4=0 THEN 'v0' ELSE 'v1' END AS rv, CASE WHEN k%9=0 THEN at_ms END AS sup, at_ms FROM ev)"""
