"""Raw chain transactions: explicit schema, normalisation and fact tables.

Everything about one transaction is derived inside its row with array functions, so
normalising and exploding facts needs no shuffle however many transactions there are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.functions.scalar import ladder
from assetlens.functions.text import canonical_id
from assetlens.sources.tables import NATIVE

# Well-known program and asset addresses, address shape, u64 limit, edge minimum.
TOKEN_PROGRAMS = ["TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA", "TokenzQdBNbLqP5VEhdkAS6EPFLC1PHnBqCXEpPxuEb"]
SYSTEM_PROGRAM = "11111111111111111111111111111111"
WRAPPED_NATIVE = "So11111111111111111111111111111111111111112"
ADDRESS = "^[1-9A-HJ-NP-Za-km-z]{32,44}$"
U64_MAX = 18_446_744_073_709_551_615
MIN_NATIVE_EDGE = 10_000_000

_IX = "struct<programId:string,program:string,parsed:struct<type:string,info:string>>"
_TB = "struct<accountIndex:int,mint:string,owner:string,uiTokenAmount:struct<amount:string,decimals:int>>"
RAW_SCHEMA = (
    "slot long, blockTime long, version string, "
    f"transaction struct<signatures:array<string>,message:struct<accountKeys:array<struct<pubkey:string,signer:boolean>>,instructions:array<{_IX}>>>, "
    "meta struct<err:string,fee:decimal(20,0),preBalances:array<decimal(20,0)>,postBalances:array<decimal(20,0)>,"
    f"preTokenBalances:array<{_TB}>,postTokenBalances:array<{_TB}>,innerInstructions:array<struct<index:int,instructions:array<{_IX}>>>>"
)


def read_transactions(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Landed JSON documents, as a batch or as a file stream. Never infers a schema."""
    return (spark.readStream if stream else spark.read).schema(RAW_SCHEMA).json(path)


def once(df: DataFrame) -> DataFrame:
    """Evaluate the row's columns once, before anything reads them inside an array function.

    Without the generator the optimizer folds a column into the lambdas that mention it, and it
    is then recomputed for every array element.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


#: What a normalised row can carry beyond its header, and the parts of a document each is made from.
PARTS = {"native": {"balances"}, "tokens": {"tokens"}, "ixs": {"instructions"}}


def parse_transactions(df: DataFrame, column: str = "json", parts: Iterable[str] = PARTS) -> DataFrame:
    """Documents as rows; only the fields that ``parts`` are made from are read."""
    wanted = set().union(*(PARTS[p] for p in parts))
    meta = ["err:string", "fee:decimal(20,0)"]
    if "balances" in wanted:
        meta += ["preBalances:array<decimal(20,0)>", "postBalances:array<decimal(20,0)>"]
    if "tokens" in wanted:
        meta += [f"preTokenBalances:array<{_TB}>", f"postTokenBalances:array<{_TB}>"]
    message = ["accountKeys:array<struct<pubkey:string,signer:boolean>>"]
    if "instructions" in wanted:
        meta.append(f"innerInstructions:array<struct<index:int,instructions:array<{_IX}>>>")
        message.append(f"instructions:array<{_IX}>")
    schema = f"slot long, blockTime long, version string, transaction struct<signatures:array<string>,message:struct<{','.join(message)}>>, meta struct<{','.join(meta)}>"
    return df.select(F.inline(F.array(F.from_json(column, schema))))


def _addr(c: Column) -> Column:
    return F.when(c.rlike(ADDRESS), c)


def _amount(c: Column) -> Column:
    """A non-negative integer string that fits u64, else null."""
    text = F.trim(c)
    v = text.cast("decimal(20,0)")
    return F.when(text.rlike(r"^\d{1,19}$"), v).when(text.rlike(r"^\d{20}$") & (v <= F.lit(str(U64_MAX)).cast("decimal(20,0)")), v)


def _first(arr: Column, cond) -> Column:
    return F.get(F.filter(arr, cond), F.lit(0))


def normalize(raw: DataFrame, parts: Iterable[str] = PARTS) -> DataFrame:
    """One row per readable transaction: header, and the named ``parts`` as arrays.

    ``native`` are balance changes by address, ``tokens`` token balances before and after, ``ixs`` instructions
    in order (with ``program_ids``). A part that is not named is neither read nor computed. Documents without a
    signature, slot, meta, message or fee payer are dropped.
    """
    parts = set(parts)
    msg = F.col("transaction.message")
    keys = F.transform(msg["accountKeys"], lambda k: F.coalesce(_addr(k["pubkey"]), F.lit("")))
    d = raw.withColumns({
        "tx_id": F.get("transaction.signatures", F.lit(0)), "keys": keys,
        "signers": F.filter(F.transform(msg["accountKeys"], lambda k: F.when(k["signer"], _addr(k["pubkey"]))), lambda x: x.isNotNull()),
    })
    payer = F.get("keys", F.lit(0))
    d = once(d).where(F.col("tx_id").isNotNull() & (F.length("tx_id") > 0) & (F.col("slot") >= 0) & F.col("meta").isNotNull() & msg.isNotNull() & (payer != ""))
    columns = [
        "tx_id", "slot", F.when(F.col("blockTime") > 0, F.col("blockTime") * 1000).alias("block_time"), "version",
        F.when(F.col("meta.err").isNull(), "SUCCESS").otherwise("FAILED").alias("status"), F.substring("meta.err", 1, 160).alias("error"),
        payer.alias("fee_payer"), "signers", F.col("meta.fee").alias("fee"),
    ]
    staged = {}
    if "native" in parts:
        staged["_zip"] = F.arrays_zip(F.col("keys"), F.col("meta.preBalances").alias("pre"), F.col("meta.postBalances").alias("post"))
        columns.append(_native_moves().alias("native"))
    if "tokens" in parts:
        staged |= {"_pre": _token_side("preTokenBalances"), "_post": _token_side("postTokenBalances")}
        index = F.array_distinct(F.concat(F.transform("_pre", lambda b: b["i"]), F.transform("_post", lambda b: b["i"])))
        columns.append(F.filter(F.transform(index, _token_balance), lambda b: F.coalesce(b["account"], F.lit("")) != "").alias("tokens"))
    if "ixs" in parts:
        columns.append(_instructions(msg).alias("ixs"))
    d = (once(d.withColumns(staged)) if staged else d).select(columns)
    if "ixs" not in parts:
        return once(d)
    programs = F.array_distinct(F.filter(F.transform("ixs", lambda x: x["program_id"]), lambda p: p.isNotNull()))
    return once(d).withColumn("program_ids", programs)


def _native_moves() -> Column:
    """Balance change of each address that changed; an address listed twice counts once."""
    return F.filter(
        F.transform(F.array_distinct("keys"), lambda a: F.struct(a.alias("address"), F.aggregate(
            F.filter(F.col("_zip"), lambda z: (z["keys"] == a) & z["pre"].isNotNull() & z["post"].isNotNull()),
            F.lit(0).cast("decimal(38,0)"), lambda s, z: (s + z["post"] - z["pre"]).cast("decimal(38,0)")).alias("delta"))),
        lambda m: (m["address"] != "") & (m["delta"] != 0))


def _token_side(name: str) -> Column:
    """Readable token balances of one side of a transaction."""
    empty = F.array().cast(f"array<{_TB}>")
    sides = F.transform(F.coalesce(F.col(f"meta.{name}"), empty), lambda b: F.struct(
        b["accountIndex"].alias("i"), _addr(b["mint"]).alias("asset"), _addr(b["owner"]).alias("owner"), b["uiTokenAmount"]["decimals"].alias("decimals"),
        _amount(b["uiTokenAmount"]["amount"]).alias("amount")))
    return F.filter(sides, lambda b: b["amount"].isNotNull() & b["asset"].isNotNull())


def _token_balance(i: Column) -> Column:
    """Both sides of one account; a side that is missing is zero."""
    p, q = _first(F.col("_pre"), lambda b: b["i"] == i), _first(F.col("_post"), lambda b: b["i"] == i)
    zero = F.lit(0).cast("decimal(20,0)")
    asset = F.coalesce(p["asset"], q["asset"])
    return F.struct(
        F.get("keys", i).alias("account"), F.coalesce(p["owner"], q["owner"]).alias("owner"),
        F.when(asset == WRAPPED_NATIVE, NATIVE).otherwise(asset).alias("asset"), F.coalesce(p["decimals"], q["decimals"]).alias("decimals"),
        F.coalesce(p["amount"], zero).alias("pre"), F.coalesce(q["amount"], zero).alias("post"))


def _instructions(msg: Column) -> Column:
    """Outer instructions, each followed by its inner ones; path ``i`` or ``i.j``."""

    def one(ix: Column, path: Column) -> Column:
        return F.struct(path.alias("path"), ix["programId"].alias("program_id"), ix["parsed"]["type"].alias("type"), ix["parsed"]["info"].alias("info"))

    inner = F.coalesce(F.col("meta.innerInstructions"), F.array().cast(f"array<struct<index:int,instructions:array<{_IX}>>>"))

    def with_inner(ix: Column, i: Column) -> Column:
        group = F.try_element_at(F.filter(inner, lambda g: g["index"] == i), F.lit(-1))["instructions"]
        i_text = i.cast("string")
        subs = F.transform(F.coalesce(group, F.array().cast(f"array<{_IX}>")), lambda x, j: one(x, F.concat(i_text, F.lit("."), j.cast("string"))))
        return F.concat(F.array(one(ix, i_text)), subs)

    return F.flatten(F.transform(F.coalesce(msg["instructions"], F.array().cast(f"array<{_IX}>")), with_inner))


HEADER = ["tx_id", "slot", "block_time", "status", "fee_payer", "fee"]


def flatten_transactions(norm: DataFrame) -> DataFrame:
    return norm.select(*HEADER, "error", "signers", "program_ids")


def flatten_instructions(norm: DataFrame) -> DataFrame:
    """One row per instruction; path ``i`` for outer, ``i.j`` for inner."""
    return norm.select("tx_id", "slot", F.explode("ixs").alias("x")).select("tx_id", "slot", "x.*")


def native_deltas(norm: DataFrame) -> DataFrame:
    return norm.select("tx_id", F.explode("native").alias("n")).select("tx_id", "n.*")


def token_deltas(norm: DataFrame) -> DataFrame:
    return norm.select("tx_id", "slot", "block_time", "status", F.explode("tokens").alias("b")).select(
        "tx_id", "slot", "block_time", "status", "b.*", (F.col("b.post").cast("decimal(38,0)") - F.col("b.pre")).alias("delta"))


def asset_decimals(norm: DataFrame) -> DataFrame:
    return norm.select(F.explode("tokens").alias("b")).where("b.decimals IS NOT NULL").groupBy(F.col("b.asset").alias("asset")).agg(F.max("b.decimals").alias("decimals"))


def _read(x: Column, fields: Iterable[str]) -> Column:
    """An instruction with the named fields of its info, each read from the JSON once."""
    return F.struct(x["path"].alias("path"), x["program_id"].alias("program_id"), x["type"].alias("type"), *[F.get_json_object(x["info"], f"$.{n}").alias(n.replace(".", "_")) for n in fields])


def _field(x: Column, name: str) -> Column:
    return x[name.replace(".", "_")]


def facts(norm: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """Add one array column per instruction fact kind, or for the named ones. Lookups stay within the transaction."""
    tok = F.col("tokens")
    owner_of = lambda a: _first(tok, lambda b: b["account"] == a)["owner"]
    asset_of = lambda a: _first(tok, lambda b: b["account"] == a)["asset"]
    addr = lambda x, n: _addr(_field(x, n))

    def pick(programs: list[str], types: list[str], fields: str, build, need) -> Column:
        hit = F.filter("ixs", lambda x: x["program_id"].isin(*programs) & x["type"].isin(*types))
        return F.filter(F.transform(F.transform(hit, lambda x: _read(x, fields.split())), build), lambda s: F.coalesce(need(s), F.lit(False)))

    def amount(x: Column, plain: str, name: str = "amount") -> Column:
        return _amount(F.when(x["type"] == plain, _field(x, name)).otherwise(_field(x, "tokenAmount.amount")))

    T, have = TOKEN_PROGRAMS, lambda *n: (lambda s: sum((s[c].isNotNull().cast("int") for c in n[1:]), s[n[0]].isNotNull().cast("int")) == len(n))
    every = {
        "token_transfers": pick(T, ["transfer", "transferChecked"], "mint source destination amount tokenAmount.amount", lambda x: F.struct(
            x["path"].alias("path"), F.coalesce(addr(x, "mint"), asset_of(_field(x, "source")), asset_of(_field(x, "destination"))).alias("asset"),
            addr(x, "source").alias("source"), addr(x, "destination").alias("destination"), owner_of(_field(x, "source")).alias("src_owner"),
            owner_of(_field(x, "destination")).alias("dst_owner"), amount(x, "transfer").alias("amount")), have("source", "destination", "amount")),
        "native_transfers": pick([SYSTEM_PROGRAM], ["transfer"], "source destination lamports", lambda x: F.struct(
            x["path"].alias("path"), addr(x, "source").alias("src"), addr(x, "destination").alias("dst"), _amount(_field(x, "lamports")).alias("amount")), have("src", "dst", "amount")),
        "account_creations": pick([SYSTEM_PROGRAM], ["createAccount"], "newAccount owner source lamports", lambda x: F.struct(
            x["path"].alias("path"), addr(x, "newAccount").alias("account"), addr(x, "owner").alias("owner"), addr(x, "source").alias("funder"),
            _amount(_field(x, "lamports")).alias("amount")), have("account", "owner", "funder", "amount")),
        "mint_inits": pick(T, ["initializeMint", "initializeMint2"], "mint decimals mintAuthority freezeAuthority", lambda x: F.struct(
            x["path"].alias("path"), addr(x, "mint").alias("asset"), _field(x, "decimals").cast("int").alias("decimals"), addr(x, "mintAuthority").alias("mint_authority"),
            addr(x, "freezeAuthority").alias("freeze_authority"), x["program_id"].alias("token_program")), have("asset")),
        "mint_tos": pick(T, ["mintTo", "mintToChecked"], "mint account amount tokenAmount.amount mintAuthority", lambda x: F.struct(
            x["path"].alias("path"), addr(x, "mint").alias("asset"), addr(x, "account").alias("account"), amount(x, "mintTo").alias("amount"),
            addr(x, "mintAuthority").alias("authority"), owner_of(_field(x, "account")).alias("recipient")), have("asset", "account", "amount")),
        "authority_changes": pick(T, ["setAuthority"], "mint account authorityType newAuthority authority", lambda x: F.struct(
            x["path"].alias("path"), _addr(F.coalesce(_field(x, "mint"), _field(x, "account"))).alias("target"), _field(x, "authorityType").alias("authority_type"),
            addr(x, "newAuthority").alias("new_authority"), addr(x, "authority").alias("previous_authority")), have("target", "authority_type")),
        "freezes": pick(T, ["freezeAccount", "thawAccount"], "account mint freezeAuthority", lambda x: F.struct(
            x["path"].alias("path"), F.when(x["type"] == "freezeAccount", "FREEZE").otherwise("THAW").alias("kind"), addr(x, "account").alias("account"),
            addr(x, "mint").alias("asset"), addr(x, "freezeAuthority").alias("authority"), owner_of(_field(x, "account")).alias("owner")), have("account", "asset")),
        "token_account_inits": pick(T, ["initializeAccount", "initializeAccount2", "initializeAccount3"], "account mint owner", lambda x: F.struct(
            x["path"].alias("path"), addr(x, "account").alias("account"), addr(x, "mint").alias("asset"), addr(x, "owner").alias("owner")), have("account", "asset", "owner")),
    }
    return norm.withColumns({k: v for k, v in every.items() if kinds is None or k in set(kinds)})


FACT_KINDS = ["token_transfers", "native_transfers", "account_creations", "mint_inits", "mint_tos", "authority_changes", "freezes", "token_account_inits"]


def fact_table(f: DataFrame, kind: str) -> DataFrame:
    """One of the eight instruction fact tables, with the transaction header beside it."""
    return f.select(*HEADER, F.explode(kind).alias("x")).select(*HEADER, "x.*")


#: The fact kinds that launches are read from.
LAUNCH_KINDS = ["mint_inits", "mint_tos", "token_account_inits", "account_creations", "authority_changes"]


def extract_launches(f: DataFrame, program: str, authority: str) -> DataFrame:
    """Launches by a launchpad, one row per transaction, with a rejection reason otherwise.

    The pool is the owner of the largest mint-to recipient, confirmed when the transaction also
    created that account for the launchpad. All within the row.
    """
    init = _first(F.col("mint_inits"), lambda m: m["mint_authority"] == authority)
    d = once(once(f).withColumn("init", init)).withColumn("_m", F.filter("mint_tos", lambda m: m["asset"] == F.col("init.asset")))
    largest = F.array_max(F.transform("_m", lambda m: F.struct(m["amount"].alias("amount"), m["account"].alias("account"))))["account"]
    d = once(d.withColumn("_acct", largest))
    owner = F.coalesce(_first(F.col("token_account_inits"), lambda t: t["account"] == F.col("_acct"))["owner"], _first(F.col("tokens"), lambda b: b["account"] == F.col("_acct"))["owner"])
    d = once(d.withColumn("pool", owner))
    dec = lambda: F.lit(0).cast("decimal(38,0)")
    supply = F.aggregate("_m", dec(), lambda s, m: (s + m["amount"]).cast("decimal(38,0)"))
    held = F.aggregate(F.filter("tokens", lambda b: (b["asset"] == F.col("init.asset")) & (b["owner"] == F.col("fee_payer"))), dec(), lambda s, b: (s + b["post"]).cast("decimal(38,0)"))
    rejection = ladder(F.lit(None).cast("string"), (F.col("status") == "FAILED", "failed"), (~F.array_contains("program_ids", program), "not_launchpad"), (F.col("init").isNull(), "no_mint_created"))
    return d.select(
        "tx_id", "slot", "block_time", "fee_payer", rejection.alias("rejection"), F.col("init.asset").alias("asset"), F.col("init.token_program").alias("token_program"),
        F.col("init.decimals").alias("decimals"), F.when(F.size("_m") > 0, supply).alias("initial_supply"), "pool",
        F.coalesce(F.col("pool").isNotNull() & F.exists("account_creations", lambda c: (c["account"] == F.col("pool")) & (c["owner"] == program)), F.lit(False)).alias("pool_confirmed"),
        held.alias("fee_payer_balance"),
        F.coalesce(F.exists("authority_changes", lambda a: (a["target"] == F.col("init.asset")) & (a["authority_type"] == "mintTokens") & a["new_authority"].isNull()), F.lit(False)).alias("mint_authority_revoked"))


def pool_created_events(launches: DataFrame) -> DataFrame:
    """Pool-created events; an unconfirmed pool gives confidence 0.7."""
    ok = launches.where("rejection IS NULL AND pool IS NOT NULL")
    return ok.select(canonical_id("POOL_CREATED", "tx_id", "asset", "pool").alias("id"), F.lit("POOL_CREATED").alias("type"), "asset", "tx_id", "slot",
                     F.col("block_time").alias("at"), "pool", F.col("fee_payer").alias("actor"), F.col("initial_supply").alias("amount"), F.when(F.col("pool_confirmed"), 1.0).otherwise(0.7).alias("confidence"))


def mint_events(f: DataFrame) -> DataFrame:
    """Supply and authority events of successful transactions."""
    ok = f.where("status = 'SUCCESS'")
    m = fact_table(ok, "mint_tos").select(canonical_id("TOKEN_MINT", "tx_id", "path").alias("id"), F.lit("TOKEN_MINT").alias("type"), "asset", "tx_id", "slot",
                                          F.col("authority").alias("actor"), F.col("amount").cast("decimal(20,0)").alias("amount"), F.lit(None).cast("boolean").alias("revoked"))
    a = fact_table(ok, "authority_changes").select(canonical_id("AUTHORITY_CHANGE", "tx_id", "path").alias("id"), F.lit("AUTHORITY_CHANGE").alias("type"), F.col("target").alias("asset"), "tx_id", "slot",
                                                   F.col("previous_authority").alias("actor"), F.lit(None).cast("decimal(20,0)").alias("amount"), F.col("new_authority").isNull().alias("revoked"))
    return m.unionByName(a)


def transfer_edges(f: DataFrame, excluded: DataFrame, address_dim: DataFrame) -> DataFrame:
    """Directed money edges: token moves between owners, and large native moves between wallets.

    ``excluded(address)`` holds pools. Anti and semi joins, so nothing depends on its size.
    """
    ok = f.where("status = 'SUCCESS'")
    t = fact_table(ok, "token_transfers").where(F.col("asset").isNotNull() & F.col("src_owner").isNotNull() & F.col("dst_owner").isNotNull()).select(
        "tx_id", "path", "slot", "block_time", F.lit("TOKEN_TRANSFER").alias("kind"), "asset", F.col("src_owner").alias("src"), F.col("dst_owner").alias("dst"), "amount")
    w = address_dim.where("is_wallet").select("address")
    n = fact_table(ok, "native_transfers").where(F.col("amount") >= MIN_NATIVE_EDGE).select(
        "tx_id", "path", "slot", "block_time", F.lit("NATIVE_TRANSFER").alias("kind"), F.lit(NATIVE).alias("asset"), "src", "dst", "amount")
    for end in ("src", "dst"):
        n = n.join(w.withColumnRenamed("address", end), end, "left_semi")
    e = t.unionByName(n).where("src <> dst")
    for end in ("src", "dst"):
        e = e.join(excluded.select(F.col("address").alias(end)), end, "left_anti")
    return e.withColumn("id", canonical_id(F.col("kind"), "tx_id", "path"))


def funding_candidates(f: DataFrame) -> DataFrame:
    """Inbound native transfers and account creations, as initial funding reads them."""
    n = fact_table(f, "native_transfers").select("src", "dst", "tx_id", "amount", "slot", F.col("block_time").alias("at"), "status")
    c = fact_table(f, "account_creations").select(F.col("funder").alias("src"), F.col("account").alias("dst"), "tx_id", "amount", "slot", F.col("block_time").alias("at"), "status")
    return n.unionByName(c)
