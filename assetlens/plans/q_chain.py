"""Raw-transaction and trade-derivation queries.

The documents are written from the event table as JSON inside the plan and read back with the
explicit schema, so parsing and derivation do the full work for every event.
"""

from pyspark.sql import functions as F

from assetlens.functions.durable import cut, new_folder
from assetlens.functions.skew import dealt
from assetlens.operators import trades as T
from assetlens.plans.registry import query
from assetlens.plans.sqltext import EV, TR
from assetlens.sources import transactions as X

DEX, PAD = "DexDexDexDexDexDexDexDexDexDexDex", "PadPadPadPadPadPadPadPadPadPadPad"
AUTH, STABLE_MINT = "AuthAuthAuthAuthAuthAuthAuthAuth", "StabStabStabStabStabStabStabStab"
BASE, FEE = 1_000_000_000_000, 5_000


def addr(prefix, c):
    """A valid 32-character address from a number: zeros are not in the alphabet."""
    return F.translate(F.concat(F.lit(prefix), F.lpad(c.cast("string"), 31, "1")), "0", "z")


def asql(p: str, c: str) -> str:
    return f"replace('{p}'||lpad(CAST({c} AS VARCHAR),31,'1'),'0','z')"


def documents(t):
    e = dealt(t.event_facts(), "event_id")
    i, k, c = F.col("event_id"), F.col("k"), F.col("cents").cast("long")
    kind = F.col("event_type")
    tok = c * (k % 5 + 1)
    liq = (kind == "view") & (k % 10 == 9)
    buy, err = kind.isin("purchase", "signup"), kind == "error"
    native_q, launch = k % 7 != 0, kind == "signup"
    tsign = F.when(err, 0).when(buy, 1).otherwise(-1)  # wallet token sign
    qsign = F.when(err, 0).when(buy | liq, -1).otherwise(1)  # wallet quote sign
    nq = F.when(native_q, qsign * c).otherwise(0)
    W, P, M, WA, PA, WS, PS = addr("W", F.col("user_id")), addr("P", k % 3), addr("M", k % 10), addr("a", i), addr("b", i), addr("c", i), addr("d", i)
    N = addr("N", i)
    key = lambda a, s=False: F.struct(a.alias("pubkey"), F.lit(s).alias("signer"))
    fresh = buy & (k % 4 == 0)
    wpre = F.when(fresh, 0).otherwise(BASE).cast("long")

    def tb(idx, mint, owner, amount):
        return F.struct(F.lit(idx).alias("accountIndex"), mint.alias("mint"), owner.alias("owner"),
                        F.struct(amount.cast("string").alias("amount"), F.lit(6).alias("decimals")).alias("uiTokenAmount"))

    def ix(prog, typ=None, info=None):
        parsed = F.when(F.lit(typ is not None), F.struct(F.lit(typ).cast("string").alias("type"), (info if info is not None else F.lit(None).cast("string")).alias("info")))
        return F.struct(F.lit(prog).alias("programId") if isinstance(prog, str) else prog.alias("programId"), F.lit(None).cast("string").alias("program"), parsed.alias("parsed"))

    j = lambda **kw: F.to_json(F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(n) for n, v in kw.items()]))
    tp = X.TOKEN_PROGRAMS[0]
    src, dst = F.when(buy, PA).otherwise(WA), F.when(buy, WA).otherwise(PA)
    move = ix(tp, "transferChecked", j(source=src, destination=dst, mint=M, tokenAmount=F.struct(tok.cast("string").alias("amount"))))
    pay = ix(X.SYSTEM_PROGRAM, "transfer", j(source=F.when(buy | liq, W).otherwise(P), destination=F.when(buy | liq, P).otherwise(W), lamports=c))
    extra = F.array(
        ix(tp, "initializeMint2", j(mint=N, decimals=F.lit(6), mintAuthority=AUTH)), ix(tp, "mintTo", j(mint=N, account=PA, amount=(tok * 10).cast("string"), mintAuthority=AUTH)),
        ix(tp, "setAuthority", j(mint=N, authorityType="mintTokens", authority=AUTH, newAuthority=F.when(k % 2 == 1, W))),
        ix(X.SYSTEM_PROGRAM, "createAccount", j(source=W, newAccount=P, owner=F.when(k % 3 != 0, PAD).otherwise(DEX), lamports=F.lit(100))),
        ix(tp, "freezeAccount", j(account=WA, mint=M, freezeAuthority=AUTH)), ix(tp, "initializeAccount3", j(account=WA, mint=M, owner=W)))
    outer = ix(F.when(launch, PAD).otherwise(DEX))
    inner = F.when(err, F.array(move)).when(native_q, F.array(move, pay)).otherwise(F.array(move))
    stable = ~native_q
    doc = F.struct(
        F.floor(F.col("at") / 60_000).alias("slot"), F.floor(F.col("at") / 1000).alias("blockTime"), F.lit("0").alias("version"),
        F.struct(F.array(i.cast("string")).alias("signatures"), F.struct(
            F.when(stable, F.array(key(W, True), key(P), key(WA), key(PA), key(WS), key(PS))).otherwise(F.array(key(W, True), key(P), key(WA), key(PA))).alias("accountKeys"),
            F.when(launch, F.concat(F.array(outer), extra)).otherwise(F.array(outer)).alias("instructions")).alias("message")).alias("transaction"),
        F.struct(
            F.when(err, F.lit('{"InstructionError":0}')).alias("err"), F.lit(FEE).alias("fee"), F.array(F.lit(BASE), F.lit(BASE)).alias("preBalances"),
            F.array(BASE + nq - FEE, BASE - nq).alias("postBalances"),
            F.filter(F.array(F.when(~fresh, tb(2, M, W, wpre)), tb(3, M, P, F.lit(BASE)), F.when(stable, tb(4, F.lit(STABLE_MINT), W, F.lit(BASE))), F.when(stable, tb(5, F.lit(STABLE_MINT), P, F.lit(BASE)))), lambda x: x.isNotNull()).alias("preTokenBalances"),
            F.filter(F.array(tb(2, M, W, wpre + tsign * tok), tb(3, M, P, BASE - tsign * tok), F.when(stable, tb(4, F.lit(STABLE_MINT), W, BASE + qsign * c)), F.when(stable, tb(5, F.lit(STABLE_MINT), P, BASE - qsign * c))), lambda x: x.isNotNull()).alias("postTokenBalances"),
            F.array(F.struct(F.lit(0).alias("index"), inner.alias("instructions"))).alias("innerInstructions")).alias("meta"))
    return e.select(F.to_json(doc).alias("json"))


LANDED: dict[tuple[str, str], str] = {}


def landed(t):
    """The documents as a landing zone holds them, written once a session and directory."""
    spark = t.spark
    place = spark.sparkContext.applicationId, t.dir
    if place not in LANDED:
        LANDED[place] = new_folder(spark, "landed")
        documents(t).write.parquet(LANDED[place])
    return spark.read.schema("json string").parquet(LANDED[place])


def norm(t, *parts):
    """Normalised transactions with the named parts; none named means all."""
    parts = parts or tuple(X.PARTS)
    return X.normalize(X.parse_transactions(landed(t), parts=parts), parts)


CH = f"""{EV}, c AS (SELECT *, CAST(event_id AS VARCHAR) AS tx_id, at_ms//60000 AS slot, cents*(k%5+1) AS tok, event_type='error' AS err, event_type IN ('purchase','signup') AS buy, event_type='view' AND k%10=9 AS liq, event_type='signup' AS lau,
  k%7<>0 AS nq, {asql('W', 'user_id')} AS W, {asql('P', 'k%3')} AS P, {asql('M', 'k%10')} AS M, {asql('N', 'event_id')} AS N, {asql('a', 'event_id')} AS WA, {asql('b', 'event_id')} AS PA FROM ev),
 d AS (SELECT *, CASE WHEN err THEN 0 WHEN buy THEN 1 ELSE -1 END AS ts, CASE WHEN err THEN 0 WHEN buy OR liq THEN -1 ELSE 1 END AS qs FROM c)"""


@query("S01", f"""WITH {CH} SELECT tx_id, slot, at_ms//1000*1000 AS block_time, CASE WHEN err THEN 'FAILED' ELSE 'SUCCESS' END AS status, W AS fee_payer, 5000.0::DOUBLE AS fee, W AS signers,
 CASE WHEN lau THEN '{PAD}' ELSE '{DEX}' END||',{X.TOKEN_PROGRAMS[0]}'||CASE WHEN lau OR (nq AND NOT err) THEN ',{X.SYSTEM_PROGRAM}' ELSE '' END AS program_ids FROM d""")
def transaction_headers(t):
    return X.flatten_transactions(norm(t, "ixs")).drop("error").withColumns({
        "fee": F.col("fee").cast("double"), "signers": F.array_join("signers", ","), "program_ids": F.array_join("program_ids", ",")})


@query("S02", f"""WITH {CH} SELECT tx_id, '0' AS path, CASE WHEN lau THEN '{PAD}' ELSE '{DEX}' END AS program_id, NULL::VARCHAR AS type FROM d UNION ALL SELECT tx_id, '0.0', '{X.TOKEN_PROGRAMS[0]}', 'transferChecked' FROM d
 UNION ALL SELECT tx_id, '0.1', '{X.SYSTEM_PROGRAM}', 'transfer' FROM d WHERE nq AND NOT err UNION ALL SELECT tx_id, u.p, CASE WHEN u.p='4' THEN '{X.SYSTEM_PROGRAM}' ELSE '{X.TOKEN_PROGRAMS[0]}' END, u.t FROM d,
 (VALUES ('1','initializeMint2'),('2','mintTo'),('3','setAuthority'),('4','createAccount'),('5','freezeAccount'),('6','initializeAccount3')) u(p,t) WHERE lau""")
def transaction_instructions(t):
    return X.flatten_instructions(norm(t, "ixs")).select("tx_id", "path", "program_id", "type")


@query("S03", f"""WITH {CH}, x AS (SELECT tx_id, W AS address, CASE WHEN nq THEN qs*cents ELSE 0 END-5000 AS delta FROM d UNION ALL SELECT tx_id, P, CASE WHEN nq THEN -qs*cents ELSE 0 END FROM d) SELECT tx_id, address, delta::DOUBLE AS delta FROM x WHERE delta<>0""")
def native_balance_deltas(t):
    return X.native_deltas(norm(t, "native")).withColumn("delta", F.col("delta").cast("double"))


@query("S04", f"""WITH {CH} SELECT tx_id, WA AS account, W AS owner, M AS asset, (ts*tok)::DOUBLE AS delta FROM d UNION ALL SELECT tx_id, PA, P, M, (-ts*tok)::DOUBLE FROM d
 UNION ALL SELECT tx_id, {asql('c', 'event_id')}, W, '{STABLE_MINT}', (qs*cents)::DOUBLE FROM d WHERE NOT nq UNION ALL SELECT tx_id, {asql('d', 'event_id')}, P, '{STABLE_MINT}', (-qs*cents)::DOUBLE FROM d WHERE NOT nq""")
def token_balance_deltas(t):
    return X.token_deltas(norm(t, "tokens")).select("tx_id", "account", "owner", "asset", F.col("delta").cast("double").alias("delta"))


@query("S05", f"""WITH {CH} SELECT 'token_transfers' AS kind, count(*) AS n, sum(tok)::DOUBLE AS amount FROM d UNION ALL SELECT 'native_transfers', count(*), sum(cents)::DOUBLE FROM d WHERE nq AND NOT err UNION ALL SELECT 'account_creations', count(*), (count(*)*100)::DOUBLE FROM d WHERE lau
 UNION ALL SELECT 'mint_inits', count(*), NULL FROM d WHERE lau UNION ALL SELECT 'mint_tos', count(*), sum(tok*10)::DOUBLE FROM d WHERE lau UNION ALL SELECT 'authority_changes', count(*), NULL FROM d WHERE lau UNION ALL SELECT 'freezes', count(*), NULL FROM d WHERE lau
 UNION ALL SELECT 'token_account_inits', count(*), NULL FROM d WHERE lau""")
def instruction_fact_counts(t):
    f = cut(X.facts(norm(t, "tokens", "ixs")))
    out = None
    for kind in X.FACT_KINDS:
        x = X.fact_table(f, kind)
        amt = F.sum("amount").cast("double") if "amount" in x.columns else F.lit(None).cast("double")
        r = x.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), amt.alias("amount"))
        out = r if out is None else out.unionByName(r)
    return out


@query("S05", f"""WITH {CH} SELECT tx_id, '0.0' AS path, M AS asset, CASE WHEN buy THEN P ELSE W END AS src_owner, CASE WHEN buy THEN W ELSE P END AS dst_owner, tok::DOUBLE AS amount FROM d""")
def token_transfer_facts(t):
    return X.fact_table(X.facts(norm(t, "tokens", "ixs"), ["token_transfers"]), "token_transfers").select("tx_id", "path", "asset", "src_owner", "dst_owner", F.col("amount").cast("double").alias("amount"))


def launches(t):
    return X.extract_launches(X.facts(norm(t, "tokens", "ixs"), X.LAUNCH_KINDS), PAD, AUTH)


LAUNCH = f"""lx AS (SELECT tx_id, slot, CASE WHEN err THEN 'failed' WHEN NOT lau THEN 'not_launchpad' END AS rejection, CASE WHEN lau THEN N END AS asset, CASE WHEN lau THEN (tok*10)::DOUBLE END AS initial_supply, CASE WHEN lau THEN P END AS pool,
  lau AND k%3<>0 AS pool_confirmed, lau AND k%2=0 AS mint_authority_revoked, W AS fee_payer FROM d)"""


@query("S06", f"WITH {CH}, {LAUNCH} SELECT * FROM lx")
def launch_extraction(t):
    return launches(t).select("tx_id", "slot", "rejection", "asset", F.col("initial_supply").cast("double").alias("initial_supply"), "pool", "pool_confirmed", "mint_authority_revoked", "fee_payer")


@query("S07", f"WITH {CH}, {LAUNCH} SELECT substr(sha256('POOL_CREATED|'||tx_id||'|'||asset||'|'||pool),1,32) AS id, asset, tx_id, pool, fee_payer AS actor, CASE WHEN pool_confirmed THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM lx WHERE rejection IS NULL AND pool IS NOT NULL")
def pool_created_events(t):
    return X.pool_created_events(launches(t)).select("id", "asset", "tx_id", "pool", "actor", "confidence")


@query("S08", f"""WITH {CH} SELECT substr(sha256('TOKEN_MINT|'||tx_id||'|2'),1,32) AS id, 'TOKEN_MINT' AS type, N AS asset, tx_id, '{AUTH}' AS actor, (tok*10)::DOUBLE AS amount, NULL::BOOLEAN AS revoked FROM d WHERE lau
 UNION ALL SELECT substr(sha256('AUTHORITY_CHANGE|'||tx_id||'|3'),1,32), 'AUTHORITY_CHANGE', N, tx_id, '{AUTH}', NULL, k%2=0 FROM d WHERE lau""")
def supply_and_authority_events(t):
    return X.mint_events(X.facts(norm(t, "tokens", "ixs"), ["mint_tos", "authority_changes"])).drop("slot").withColumn("amount", F.col("amount").cast("double"))


def dims(t):
    e = t.event_facts()
    w = e.select(addr("W", F.col("user_id")).alias("address")).distinct().withColumn("is_wallet", F.lit(True))
    p = e.select(addr("P", F.col("k") % 3).alias("address")).distinct().withColumn("is_wallet", F.lit(False))
    return w, p


@query("S09", f"""WITH {CH} SELECT substr(sha256('TOKEN_TRANSFER|'||tx_id||'|0.0'),1,32) AS id, 'TOKEN_TRANSFER' AS kind, M AS asset, CASE WHEN buy THEN P ELSE W END AS src, CASE WHEN buy THEN W ELSE P END AS dst, tok::DOUBLE AS amount FROM d WHERE NOT err AND k%3<>0""")
def transfer_edges(t):
    w, p = dims(t)
    return X.transfer_edges(X.facts(norm(t, "tokens", "ixs"), ["token_transfers", "native_transfers"]), p.where(F.col("address").startswith("P") & F.col("address").endswith("z")), w).select(
        "id", "kind", "asset", "src", "dst", F.col("amount").cast("double").alias("amount"))


@query("S31", f"WITH {CH} SELECT tx_id, substr(sha256('TX|'||tx_id||'|'||coalesce(CASE WHEN k%2=0 THEN event_type END,'')||'|'||slot),1,32) AS id FROM d")
def canonical_ids(t):
    from assetlens.functions.text import canonical_id

    e = t.event_facts()
    return e.select(F.col("event_id").cast("string").alias("tx_id"), canonical_id("TX", "event_id", F.when(F.col("k") % 2 == 0, F.col("event_type")), F.floor(F.col("at") / 60_000)).alias("id"))


# ---- trade derivation ------------------------------------------------------------------


def balances(t):
    return norm(t, "native", "tokens")


@query("T01", f"""WITH {CH}, x AS (SELECT tx_id, W AS owner, M AS asset, ts*tok AS delta FROM d UNION ALL SELECT tx_id, P, M, -ts*tok FROM d UNION ALL SELECT tx_id, W, 'NATIVE', CASE WHEN nq THEN qs*cents ELSE 0 END-5000 FROM d
 UNION ALL SELECT tx_id, P, 'NATIVE', CASE WHEN nq THEN -qs*cents ELSE 0 END FROM d UNION ALL SELECT tx_id, W, '{STABLE_MINT}', qs*cents FROM d WHERE NOT nq UNION ALL SELECT tx_id, P, '{STABLE_MINT}', -qs*cents FROM d WHERE NOT nq)
 SELECT tx_id, owner, asset, delta::DOUBLE AS delta FROM x WHERE delta<>0""")
def owner_deltas(t):
    return T.owner_deltas(balances(t)).withColumn("delta", F.col("delta").cast("double"))


def watch(t, hidden: bool = False):
    """Each transaction watched for its asset and pool; ``hidden`` names a pool that never moves."""
    e = t.event_facts()
    k = F.col("k")
    pool = F.when(k % 2 == 0, addr("Q", k % 3)).otherwise(addr("P", k % 3)) if hidden else addr("P", k % 3)
    return e.select(F.col("event_id").cast("string").alias("tx_id"), addr("M", k % 10).alias("asset"), pool.alias("pool"))


@query("T02", f"WITH {CH} SELECT tx_id, M AS asset, P AS pool_side, k%2=0 AS inferred FROM d WHERE NOT err AND cents>0")
def pool_sides(t):
    w, p = dims(t)
    return T.pool_side(balances(t), watch(t, True), w.unionByName(p)).where("movers > 0").select("tx_id", "asset", "pool_side", "inferred")


def pool_rows(t):
    w, p = dims(t)
    return T.pool_activity(balances(t), watch(t, True), w.unionByName(p))


@query("T03 T04 T05 T06", f"""WITH {CH}, x AS (SELECT *, err OR cents=0 AS nx FROM d) SELECT tx_id, CASE WHEN err THEN 'FAILED' WHEN cents=0 THEN 'NO_POOL_ACTIVITY' WHEN liq THEN 'LIQUIDITY_ADDED' ELSE 'SWAP' END AS kind, NULL::VARCHAR AS reason, CASE WHEN NOT nx THEN P END AS pool_side, NOT nx AND k%2=0 AS pool_side_inferred,
 CASE WHEN NOT nx AND NOT liq THEN CASE WHEN buy THEN 'BUY' ELSE 'SELL' END END AS direction, CASE WHEN NOT nx AND NOT liq THEN W END AS trader, CASE WHEN NOT nx AND NOT liq THEN 'EXACT' END AS trader_resolution,
 CASE WHEN NOT nx THEN tok::DOUBLE END AS token_amount, CASE WHEN NOT nx THEN CASE WHEN nq THEN 'NATIVE' ELSE '{STABLE_MINT}' END END AS quote_asset, CASE WHEN NOT nx THEN cents::DOUBLE END AS quote_amount,
 CASE WHEN NOT nx AND NOT liq THEN (cents/pow(10.0,CASE WHEN nq THEN 9 ELSE 6 END))/(tok/pow(10.0,6)) END AS price_in_quote, CASE WHEN liq AND NOT nx THEN W END AS liquidity_actor,
 CASE WHEN NOT nx THEN least(1.0::DOUBLE, ((tok::HUGEINT*1000000)//1000000000000)/1e6) END AS reserve_fraction, CASE WHEN nx THEN 1.0::DOUBLE WHEN liq THEN CASE WHEN k%2=0 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END ELSE CASE WHEN k%2=0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END END AS confidence FROM x""")
def pool_activity(t):
    return pool_rows(t).drop("asset", "pool", "slot", "block_time", "fee_payer").withColumns({c: F.col(c).cast("double") for c in ("token_amount", "quote_amount")})


@query("T07", f"""WITH {CH} SELECT W AS wallet, tx_id, M AS asset, CASE WHEN buy THEN 'BUY' ELSE 'SELL' END AS side, tok::DOUBLE AS token_amount, CASE WHEN nq THEN 'NATIVE' ELSE 'STABLE' END AS quote_asset, cents::DOUBLE AS quote_amount, true AS wallet_paid_fee FROM d WHERE NOT err AND NOT liq AND cents>0""")
def wallet_trades(t):
    w, _ = dims(t)
    return T.wallet_trades(balances(t), w.select(F.col("address").alias("wallet")), (STABLE_MINT,)).drop("slot", "block_time").withColumns(
        {c: F.col(c).cast("double") for c in ("token_amount", "quote_amount")})


@query("T08", f"""WITH {CH}, i AS (SELECT P AS src, W AS dst, tx_id, slot, cents AS amount FROM d WHERE nq AND NOT err AND NOT buy AND NOT liq UNION ALL SELECT W, P, tx_id, slot, cents FROM d WHERE nq AND NOT err AND (buy OR liq) UNION ALL SELECT W, P, tx_id, slot, 100 FROM d WHERE lau)
 SELECT dst AS wallet, arg_min(src,(slot,tx_id,src)) AS funder, arg_min(tx_id,(slot,tx_id,src)) AS tx_id FROM i GROUP BY 1""")
def chain_initial_funding(t):
    return T.initial_funding(X.funding_candidates(X.facts(norm(t, "tokens", "ixs"), ["native_transfers", "account_creations"]))).select("wallet", "funder", "tx_id")


@query("T09", f"WITH {TR}, g AS (SELECT asset, quote_asset, count(*) AS n, min(slot) AS s FROM tr GROUP BY 1,2) SELECT asset, arg_max(quote_asset,(n,-s)) AS quote_asset, max(n) AS trades FROM g GROUP BY 1")
def dominant_quote(t):
    return T.dominant_quote(t.trades())


# ---- every way a trade can be read ------------------------------------------------------

OR = f"""o AS (SELECT o_orderkey AS i, 'o'||o_orderkey AS tx_id, o_orderkey%9 AS v, round(o_totalprice*100)::BIGINT AS c, {asql('W', 'o_custkey')} AS W, {asql('P', 'o_orderkey%7')} AS P FROM orders)"""


def odd_documents(t):
    """One document an order, by its number: exact, approximate, ambiguous and ownerless swaps, a second seller, removed liquidity, and three kinds nothing can be said about."""
    i, c = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    v = i % 9
    W, P, X_, M = addr("W", F.col("o_custkey")), addr("P", i % 7), addr("X", i), addr("M", i % 10)
    case = lambda default, **by: F.coalesce(*[F.when(v == int(k[1:]), e) for k, e in by.items()], default)
    zero = F.lit(0).cast("long")
    pool = case(-c, v8=c)  # of the asset
    wallet = case(c, v1=c - F.floor(c / 10), v2=F.floor(c / 2), v3=zero, v5=F.floor(c / 2), v8=-c)
    other = case(zero, v2=c - F.floor(c / 2) - 1, v5=c - F.floor(c / 2), v8=F.lit(-5).cast("long"))
    loose = case(zero, v3=c)  # an account without an owner
    native = case(c, v4=-c, v6=zero, v8=-c)  # of the pool
    stable = case(zero, v7=c)
    accounts = [(1, M, P, pool), (2, M, W, wallet), (3, M, X_, other), (4, M, F.lit(None).cast("string"), loose), (5, F.lit(STABLE_MINT), P, stable)]
    side = lambda moved: F.array(*[
        F.struct(F.lit(n).alias("accountIndex"), mint.alias("mint"), owner.alias("owner"), F.struct((F.lit(BASE) + (d if moved else zero)).cast("string").alias("amount"), F.lit(6).alias("decimals")).alias("uiTokenAmount"))
        for n, mint, owner, d in accounts])
    key = lambda a, s=False: F.struct(a.alias("pubkey"), F.lit(s).alias("signer"))
    doc = F.struct(
        i.alias("slot"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("blockTime"), F.lit("0").alias("version"),
        F.struct(F.array(F.concat(F.lit("o"), i.cast("string"))).alias("signatures"), F.struct(F.array(key(W, True), key(P), key(addr("a", i)), key(addr("b", i)), key(addr("c", i)), key(addr("d", i))).alias("accountKeys")).alias("message")).alias("transaction"),
        F.struct(F.lit(FEE).alias("fee"), F.array(F.lit(BASE), F.lit(BASE)).alias("preBalances"), F.array(BASE - native - FEE, BASE + native).alias("postBalances"), side(False).alias("preTokenBalances"), side(True).alias("postTokenBalances")).alias("meta"))
    return dealt(t.orders, "o_orderkey").select(F.to_json(doc).alias("json"))


@query("T02 T03 T04 T05 T06", f"""WITH {OR} SELECT tx_id, CASE WHEN v IN (5,6,7) THEN 'UNRESOLVED' WHEN v=4 THEN 'LIQUIDITY_REMOVED' ELSE 'SWAP' END AS kind,
 CASE v WHEN 5 THEN 'pool_side_not_found' WHEN 6 THEN 'no_counter_asset' WHEN 7 THEN 'pool_side_mixed_assets' END AS reason, CASE WHEN v<>5 THEN P END AS pool_side, false AS pool_side_inferred,
 CASE WHEN v<4 THEN 'BUY' WHEN v=8 THEN 'SELL' END AS direction, CASE WHEN v IN (0,1,8) THEN W END AS trader, CASE v WHEN 0 THEN 'EXACT' WHEN 1 THEN 'APPROXIMATE' WHEN 2 THEN 'AMBIGUOUS' WHEN 3 THEN 'NET_ZERO' WHEN 8 THEN 'EXACT' END AS trader_resolution,
 CASE WHEN v NOT IN (5,6,7) THEN c::DOUBLE END AS token_amount, CASE WHEN v NOT IN (5,6,7) THEN 'NATIVE' END AS quote_asset, CASE WHEN v NOT IN (5,6,7) THEN c::DOUBLE END AS quote_amount, CASE WHEN v IN (0,1,2,3,8) THEN 0.001::DOUBLE END AS price_in_quote,
 CASE WHEN v=4 THEN W END AS liquidity_actor, CASE WHEN v NOT IN (5,6,7) THEN least(1.0::DOUBLE, ((c::HUGEINT*1000000)//{BASE})/1e6) END AS reserve_fraction,
 CASE WHEN v IN (5,6,7) THEN 0.0::DOUBLE WHEN v=4 THEN 0.9::DOUBLE WHEN v=1 THEN 0.8::DOUBLE WHEN v IN (2,3) THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM o""")
def pool_activity_branches(t):
    parts = ("native", "tokens")
    i = F.col("o_orderkey")
    watched = t.orders.select(F.concat(F.lit("o"), i.cast("string")).alias("tx_id"), addr("M", i % 10).alias("asset"), F.when(i % 9 == 5, addr("Q", i % 7)).otherwise(addr("P", i % 7)).alias("pool"))
    own = t.orders.select(addr("P", i % 7).alias("address")).distinct().withColumn("is_wallet", F.lit(False))
    out = T.pool_activity(X.normalize(X.parse_transactions(odd_documents(t), parts=parts), parts), watched, own)
    return out.drop("asset", "pool", "slot", "block_time", "fee_payer").withColumns({c: F.col(c).cast("double") for c in ("token_amount", "quote_amount")})
