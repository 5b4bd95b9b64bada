"""Wallet graph: funding, behavioural edges, pair assessment, clusters and network levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlens.functions.durable import cut
from assetlens.functions.scalar import DAY_MS, half_up, known, ladder, lookup, sig3
from assetlens.functions.skew import spread_lookup, with_halo
from assetlens.functions.text import canonical_id

# Hub limits, entry window, crowd size, early entry, confidences.
HUB_TX, HUB_WINDOW_MS, HUB_FAN_OUT = 1000, DAY_MS, 25
ENTRY_SLOTS, CROWD, EARLY_SEC = 2, 8, 60
HARD = ["FUNDED", "TOKEN_TRANSFER"]
BEHAVIOURAL = ["COORDINATED_ENTRY", "REPEATED_ORDER_SIZE", "SAME_LAUNCH_PARTICIPATION"]
STRONG_PATHS = ["FUNDED", "TOKEN_TRANSFER", "SHARED_FUNDER", "CLUSTER"]
LEVEL_CONFIDENCE = {"CONFIRMED_RELATIONSHIP": 0.9, "STRONG_CANDIDATE": 0.7, "WEAK_CANDIDATE": 0.3}

EDGE_COLS = ["type", "a", "b", "directed", "confidence", "at", "evidence", "detail"]


def _edge(df: DataFrame, kind: str, a, b, directed: bool, conf, at, evidence, detail=None) -> DataFrame:
    a, b = F.col(a), F.col(b)
    x, y = (a, b) if directed else (F.least(a, b), F.greatest(a, b))
    conf = conf if not isinstance(conf, float) else F.lit(conf)
    detail = F.lit(None).cast("string") if detail is None else detail
    return df.where(a != b).select(
        F.lit(kind).alias("type"), x.alias("a"), y.alias("b"), F.lit(directed).alias("directed"),
        conf.alias("confidence"), at.cast("long").alias("at"), evidence.cast("string").alias("evidence"),
        detail.cast("string").alias("detail"),
    )


# ---- funding ---------------------------------------------------------------------------


def fan_out(funding: DataFrame) -> DataFrame:
    """Distinct wallets each funder has funded."""
    return funding.groupBy("funder").agg(F.countDistinct("wallet").alias("fan_out"))


def classify_funding(obs: DataFrame, stats: DataFrame) -> DataFrame:
    """DIRECT / LIKELY / INFRASTRUCTURE / UNKNOWN per (wallet, funder) observation.

    ``stats(funder, is_wallet, recent_tx, recent_window_ms, fan_out)`` may miss a funder: then
    whether it is a hub was not checked and the class stays LIKELY.
    """
    j = obs.join(stats, "funder", "left")
    checked = F.col("recent_tx").isNotNull()
    hub = (F.col("recent_tx") >= HUB_TX) & (F.col("recent_window_ms") <= HUB_WINDOW_MS)
    direct = F.col("first_inbound") & F.col("history_from_start") & checked
    cls = ladder(
        "LIKELY", (F.col("funder").isNull(), "UNKNOWN"), (~F.col("is_wallet"), "INFRASTRUCTURE"),
        (hub, "INFRASTRUCTURE"), (F.col("fan_out") >= HUB_FAN_OUT, "INFRASTRUCTURE"), (direct, "DIRECT"),
    )
    conf = ladder(
        0.55, (F.col("funder").isNull(), 0.0), (~F.col("is_wallet"), 0.85), (hub, 0.8),
        (F.col("fan_out") >= HUB_FAN_OUT, 0.75), (direct, 0.9),
    )
    return j.withColumns({"classification": cls, "confidence": conf})


def funding_edges(funding: DataFrame) -> DataFrame:
    """FUNDED edges, and SHARED_FUNDER pairs for funders of 2 to 24 directly funded wallets.

    Larger funders are hubs and form no pairs, so a pair join never sees more than 24 rows a key.
    """
    usable = funding.where(F.col("classification").isin("DIRECT", "LIKELY"))
    funded = _edge(usable, "FUNDED", "funder", "wallet", True, F.col("confidence"), F.col("at"), F.col("tx_id"),
                   F.col("classification"))
    direct = usable.where("classification = 'DIRECT'").select("funder", "wallet", "at", "tx_id")
    ok = direct.groupBy("funder").agg(F.count("*").alias("n")).where(F.col("n").between(2, CROWD * 3)).select("funder")
    small = direct.join(ok, "funder", "left_semi")
    left = small.select("funder", F.col("wallet").alias("wa"), "at", "tx_id")
    right = small.select("funder", F.col("wallet").alias("wb"))
    pairs = left.join(right, "funder").where(F.col("wa") < F.col("wb"))
    shared = _edge(pairs, "SHARED_FUNDER", "wa", "wb", False, 0.7, F.col("at"), F.col("tx_id"), F.col("funder"))
    return funded.unionByName(shared)


def transfer_wallet_edges(transfers: DataFrame, address_dim: DataFrame) -> DataFrame:
    """TOKEN_TRANSFER edges where both ends are wallets."""
    w = address_dim.where("is_wallet").select("address")
    both = (
        transfers.join(w.withColumnRenamed("address", "src"), "src", "left_semi")
        .join(w.withColumnRenamed("address", "dst"), "dst", "left_semi")
    )
    return _edge(both, "TOKEN_TRANSFER", "src", "dst", True, 0.9, F.col("at"), F.col("tx_id"), F.col("asset"))


# ---- behavioural -----------------------------------------------------------------------


def first_buys(trades: DataFrame) -> DataFrame:
    """First BUY of each wallet in each asset, by slot."""
    order = F.struct("slot", "block_time", "tx_id")
    return trades.where("side = 'BUY'").groupBy("wallet", "asset").agg(
        F.min("slot").alias("slot"), F.min_by("block_time", order).alias("block_time"),
        F.min_by("tx_id", order).alias("tx_id"),
    )


def coordinated_entry(trades: DataFrame, width: int = 64) -> DataFrame:
    """Pairs entering an asset within two slots, unless a crowd surrounds the earlier entry.

    Crowds are counted per slot first. What is left has at most eight entries in its window, so
    the slot equi-join gives each entry at most seven partners.
    """
    first = first_buys(trades)
    per_slot = first.groupBy("asset", "slot").agg(F.count("*").alias("n"))
    haloed = with_halo(per_slot, "slot", width, ENTRY_SLOTS, ENTRY_SLOTS)
    around = F.sum("n").over(Window.partitionBy("asset", "_b").orderBy("slot").rangeBetween(-ENTRY_SLOTS, ENTRY_SLOTS))
    calm = haloed.withColumn("_around", around).where(F.col("_core") & (F.col("_around") <= CROWD)).select("asset", "slot")
    left = first.join(calm, ["asset", "slot"], "left_semi").select(
        "asset", F.col("wallet").alias("wa"), F.col("slot").alias("sa"), F.col("block_time").alias("ta"),
        F.col("tx_id").alias("txa"), F.explode(F.sequence(F.col("slot"), F.col("slot") + ENTRY_SLOTS)).alias("slot"),
    )
    right = first.select("asset", "slot", F.col("wallet").alias("wb"), F.col("tx_id").alias("txb"))
    pairs = left.join(right, ["asset", "slot"]).where(
        (F.col("slot") > F.col("sa")) | ((F.col("slot") == F.col("sa")) & (F.col("wa") < F.col("wb")))
    )
    return _edge(pairs, "COORDINATED_ENTRY", "wa", "wb", False, 0.4, F.col("ta"), F.concat_ws("|", "txa", "txb"),
                 F.col("asset"))


def shared_sizes(trades: DataFrame) -> DataFrame:
    """Pairs that share at least two uncommon buy sizes (a size used by 2 to 8 wallets)."""
    sized = trades.where("side = 'BUY' AND quote_amount > 0 AND quote_asset IS NOT NULL").select(
        "wallet", F.concat_ws(":", "quote_asset", sig3("quote_amount").cast("string")).alias("size"), "block_time"
    )
    use = sized.groupBy("size", "wallet").agg(F.min("block_time").alias("at"))
    ok = use.groupBy("size").agg(F.count("*").alias("n")).where(F.col("n").between(2, CROWD)).select("size")
    use = use.join(ok, "size", "left_semi")
    left = use.select("size", F.col("wallet").alias("wa"), "at")
    right = use.select("size", F.col("wallet").alias("wb"))
    pairs = (
        left.join(right, "size").where("wa < wb").groupBy("wa", "wb")
        .agg(F.count("*").alias("shared"), F.min("size").alias("size"), F.min("at").alias("at")).where("shared >= 2")
    )
    return _edge(pairs, "REPEATED_ORDER_SIZE", "wa", "wb", False, 0.5, F.col("at"), F.col("size"),
                 F.col("shared").cast("string"))


def early_entries(trades: DataFrame, launches: DataFrame) -> DataFrame:
    """(wallet, asset) entered within a minute of a known launch."""
    j = first_buys(trades).join(launches.select("asset", "launch_time"), "asset")
    return j.where((F.col("block_time") - F.col("launch_time")) / 1000.0 <= EARLY_SEC).select("wallet", "asset").distinct()


def same_launches(trades: DataFrame, launches: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs that entered at least two of the same launches early.

    With ``pairs(a, b)`` only those pairs are counted, by two equi-joins: what clustering needs,
    and linear in the pairs. Without, pairs are found through each wallet's launches minus its
    most crowded one: two wallets sharing two launches must share one of those, so the join
    skips every wallet's hottest launch and still finds every pair. What a pair may share besides
    is the hottest launch of either, which is looked up; no pair is multiplied by its launches.
    """
    early = cut(early_entries(trades, launches))
    crowd = early.groupBy("asset").agg(F.count("*").alias("crowd"))
    many = early.groupBy("wallet").agg(F.count("*").alias("k")).where("k >= 2").select("wallet")
    e = early.join(many, "wallet", "left_semi").join(crowd, "asset")
    if pairs is not None:
        members = e.select("wallet", "asset")
        shared = pairs.join(members.withColumnRenamed("wallet", "a"), "a").join(members.withColumnRenamed("wallet", "b"), ["b", "asset"]).select("a", "b", "asset")
        counted = shared.groupBy("a", "b").agg(F.count("*").alias("launches")).where("launches >= 2")
        found = counted.join(smallest(shared, ["a", "b"], "asset", SHOWN_LAUNCHES), ["a", "b"])
    else:
        e = cut(e.withColumn("hottest", F.max(F.struct("crowd", "asset")).over(Window.partitionBy("wallet"))["asset"]).select("wallet", "asset", "hottest"))
        prefix = e.where("asset <> hottest")
        side = lambda w, h: prefix.select("asset", F.col("wallet").alias(w), F.col("hottest").alias(h))
        both = cut(side("a", "ha").join(side("b", "hb"), "asset").where("a < b"))
        once = both.select("a", "b", "ha", "hb").distinct()
        # a's hottest is b's too, or must be among the other's launches
        same = once.where("ha = hb").select("a", "b", F.col("ha").alias("asset"))
        asked = F.explode(F.array(F.struct(F.col("b").alias("wallet"), F.col("ha").alias("asset")), F.struct(F.col("a").alias("wallet"), F.col("hb").alias("asset"))))
        other = once.where("ha <> hb").select("a", "b", asked.alias("x")).select("a", "b", "x.*").join(e.select("wallet", "asset"), ["wallet", "asset"], "left_semi")
        shared = both.select("a", "b", "asset").unionByName(same).unionByName(other.select("a", "b", "asset"))
        pair = Window.partitionBy("a", "b")
        ranked = shared.withColumns({"_n": F.count("*").over(pair), "_r": F.row_number().over(pair.orderBy("asset"))}).where((F.col("_n") >= 2) & (F.col("_r") <= SHOWN_LAUNCHES))
        found = ranked.groupBy("a", "b").agg(F.max("_n").alias("launches"), F.array_sort(F.collect_list("asset")).alias("asset"))
    return _edge(found, "SAME_LAUNCH_PARTICIPATION", "a", "b", False, 0.3, F.lit(None), F.array_join("asset", ","),
                 F.col("launches").cast("string"))


def creator_edges(folded: DataFrame, creators: DataFrame) -> DataFrame:
    """Annotate folded hard edges that touch a launch creator, once for each creator they touch.

    ``creators(creator, asset)`` lists launches; the detail names the edge's type, the creator and up to
    three of its launches. The edges are looked up from either end, so the hard ones are written once.
    """
    hard = cut(folded.where(F.col("type").isin(*HARD)).select("type", "a", "b", "confidence", "first_at", F.get("evidence", F.lit(0)).alias("evidence")))
    c = smallest(creators, ["creator"], "asset", SHOWN_LAUNCHES).select(F.col("creator").alias("c"), "asset")
    touch = hard.join(c, F.col("a") == F.col("c")).unionByName(hard.where("a <> b").join(c, F.col("b") == F.col("c")))
    return _edge(touch, "CREATOR_ASSOCIATION", "a", "b", True, F.least(F.lit(0.9), F.col("confidence")), F.col("first_at"),
                 F.col("evidence"), F.concat_ws("|", "type", "c", F.array_join("asset", ",")))


# How many ids an edge shows.
SHOWN_EVIDENCE, SHOWN_LAUNCHES = 5, 3


def smallest(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The ``n`` smallest distinct values of each key as a sorted array; a map side keeps ``n`` a key too."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(value))
    few = df.where(F.col(value).isNotNull()).select(*keys, value).withColumn("_r", rank).where(F.col("_r") <= n)
    return few.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(value))


def fold_edges(raw: DataFrame) -> DataFrame:
    """One row per (type, a, b): best confidence, count, span, the five smallest evidence ids, canonical id.

    Edges are dealt and sorted by key and evidence once, and counted in that order: few keys repeat, so nothing is
    gained by folding before the shuffle, and what makes the edges is worked out once. One key's edges are sorted
    in one task, on disk if they are many.
    """
    key = ["type", "a", "b", "directed"]
    rank = F.dense_rank().over(Window.partitionBy(*key).orderBy(F.col("evidence").asc_nulls_last()))
    shown = {f"_e{i}": F.min(F.when(F.col("_r") == i, F.col("evidence"))) for i in range(1, SHOWN_EVIDENCE + 1)}
    f = raw.withColumn("_r", rank).groupBy(*key).agg(
        F.max("confidence").alias("confidence"), F.count("*").alias("count"), F.min("at").alias("first_at"),
        F.max("at").alias("last_at"), F.max("detail").alias("detail"),
        F.bool_or((F.col("type") == "FUNDED") & known(F.col("detail") == "DIRECT")).alias("direct_funding"),
        *[e.alias(c) for c, e in shown.items()],
    )
    evidence = F.when(F.col("_e1").isNotNull(), F.array_compact(F.array(*shown)))
    return f.withColumn("evidence", evidence).drop(*shown).withColumn("id", canonical_id("WALLET_EDGE", "type", "a", "b"))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert folded edges: newest confidence and detail, widest span, largest count."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return both.groupBy("id", "type", "a", "b").agg(
        F.max_by("confidence", "_v").alias("confidence"), F.max_by("detail", "_v").alias("detail"),
        F.max("count").alias("count"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
    )


def assess_pairs(edges: DataFrame) -> DataFrame:
    """CONFIRMED / STRONG / WEAK relationship per unordered pair from folded edges."""
    e = edges.where("type <> 'CREATOR_ASSOCIATION'").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "type", "count", "direct_funding"
    )
    is_beh = F.col("type").isin(*BEHAVIOURAL)
    g = e.groupBy("a", "b").agg(
        F.collect_set("type").alias("kinds"), F.bool_or("direct_funding").alias("direct"),
        F.bool_or(is_beh & (F.col("count") >= 2)).alias("repeated"),
    )
    has = lambda k: F.array_contains("kinds", k)
    hard = sum(has(k).cast("int") for k in HARD)
    beh = sum(has(k).cast("int") for k in BEHAVIOURAL)
    strong = F.col("direct") | has("TOKEN_TRANSFER")
    shared = has("SHARED_FUNDER")
    g = g.withColumn("level", ladder(
        "WEAK_CANDIDATE", (strong & ((beh >= 1) | (hard >= 2)), "CONFIRMED_RELATIONSHIP"),
        (strong | (shared & (beh >= 1)) | (beh >= 2), "STRONG_CANDIDATE"),
    ))
    return g.select("a", "b", "level", lookup("level", LEVEL_CONFIDENCE, 0.0).alias("confidence"),
                    F.array_sort("kinds").alias("kinds"))


def orient(pairs: DataFrame) -> DataFrame:
    """Each undirected pair once, from its end with fewer pairs to the busier one: (lo, hi).

    Following pairs from ``lo`` never expands a hub: no node keeps more than about the square
    root of twice the number of pairs.
    """
    p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    deg = p.select(F.col("a").alias("n")).unionByName(p.select(F.col("b").alias("n"))).groupBy("n").agg(F.count("*").alias("d"))
    j = p.join(deg.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    return j.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi"))


# ---- clusters --------------------------------------------------------------------------


def components(pairs: DataFrame, most: int = 100_000) -> DataFrame:
    """Connected components: every node gets the smallest id it can reach.

    Each round takes the minimum over neighbours, a map-side combined aggregate, and then jumps to the
    label's own label, which halves the remaining distance; rounds go on until no label changes. A node's
    neighbours are never gathered: they meet as a minimum, and both lookups, of a neighbour's label and of a
    label's label, split keys with more than ``most`` rows. The driver only ever sees one changed-count.
    """
    edges = pairs.select("a", "b").where("a <> b").distinct()
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = spread_lookup(both, "b", labels.withColumnRenamed("node", "b"), "a", most).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hop = cut(labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next")))
        up = labels.select(F.col("node").alias("next"), F.col("component").alias("up"))
        after = cut(spread_lookup(hop, "next", up, "node", most).select("node", F.least("next", "up").alias("component"), F.col("component").alias("old")))
        changed = after.where(F.col("component") != F.col("old")).limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels


def clusters(pairs: DataFrame) -> DataFrame:
    """One row per strong cluster: size, mean confidence, level, per-kind pair counts, id."""
    strong = cut(pairs.where(F.col("level").isin("CONFIRMED_RELATIONSHIP", "STRONG_CANDIDATE")))
    comp = components(strong)
    size = comp.groupBy("component").agg(F.count("*").alias("members"))
    inside = strong.join(comp, strong.a == comp.node).groupBy("component").agg(
        half_up(F.avg("confidence"), 2).alias("confidence"), F.count("*").alias("pairs"),
        F.bool_and(F.col("level") == "CONFIRMED_RELATIONSHIP").alias("_all"),
        *[F.count_if(F.array_contains("kinds", k)).alias(k.lower()) for k in HARD + ["SHARED_FUNDER"] + BEHAVIOURAL],
    )
    return size.join(inside, "component").withColumn(
        "level", F.when(F.col("_all"), "CONFIRMED_RELATIONSHIP").otherwise("STRONG_CANDIDATE")
    ).drop("_all")


def cluster_members(pairs: DataFrame) -> DataFrame:
    """(component, wallet) of strong clusters."""
    strong = pairs.where(F.col("level").isin("CONFIRMED_RELATIONSHIP", "STRONG_CANDIDATE"))
    return components(strong).select("component", F.col("node").alias("wallet"))


def clustered_traders(members: DataFrame, trades: DataFrame) -> DataFrame:
    """Traders of an asset whose cluster has at least two members trading it."""
    t = trades.select("asset", "wallet").distinct().join(members, "wallet")
    ok = t.groupBy("asset", "component").agg(F.count("*").alias("traders")).where("traders >= 2")
    return t.join(ok, ["asset", "component"]).select("asset", "component", "wallet", "traders")


def replace_clusters(stored: DataFrame, fresh: DataFrame, wallets: DataFrame) -> DataFrame:
    """Drop every stored cluster touching an affected wallet, then add the fresh ones."""
    hit = stored.join(wallets.select("wallet"), "wallet", "left_semi").select("component").distinct()
    return stored.join(hit, "component", "left_anti").unionByName(fresh)


def trusted_edges(edges: DataFrame, probed: DataFrame, hubs: DataFrame) -> DataFrame:
    """Edges whose two ends were probed and are not hubs."""
    ok = probed.select("address").join(hubs.select("address"), "address", "left_anti")
    return edges.join(ok.withColumnRenamed("address", "a"), "a", "left_semi").join(
        ok.withColumnRenamed("address", "b"), "b", "left_semi"
    )


# ---- network ---------------------------------------------------------------------------


def network_edges(subjects: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """Edges within ``depth`` hops of the subjects, each once with the hop it was first met at."""
    edges = cut(edges.select("a", "b", "type", "confidence"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "type", "confidence"))
    frontier = subjects.select(F.col("address").alias("a")).distinct()
    seen, found = frontier, None
    for hop in range(1, depth + 1):
        step = both.join(frontier, "a", "left_semi").withColumn("hop", F.lit(hop))
        found = step if found is None else found.unionByName(step)
        frontier = step.select(F.col("b").alias("a")).distinct().join(seen, "a", "left_anti")
        seen = seen.unionByName(frontier)
    return found.groupBy(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "type"
    ).agg(F.max("confidence").alias("confidence"), F.min("hop").alias("hop"))


def network_level(subjects: DataFrame, edges: DataFrame, profiles: DataFrame) -> DataFrame:
    """Best-confidence link from each subject to an address with bad history, at most two hops.

    ``profiles(address, confirmed, strongly_suspected)``. Every address keeps only its best bad
    neighbour before the next hop, so a hub contributes one row per neighbour rather than the
    product of its neighbours.
    """
    edges = cut(edges.select("type", "a", "b", "confidence"))
    bad = profiles.where("confirmed > 0 OR strongly_suspected > 0").select(
        "address", F.col("confirmed").alias("target_confirmed")
    )
    subj = subjects.select("address").distinct()

    def search(e: DataFrame, tag: str) -> DataFrame:
        both = e.select("a", "b", "confidence").unionByName(
            e.select(F.col("b").alias("a"), F.col("a").alias("b"), "confidence")
        ).groupBy("a", "b").agg(F.max("confidence").alias("confidence"))
        pick = lambda conf: F.max(
            F.struct(conf.alias("conf"), F.col("target_confirmed").alias("confirmed"), F.col("target").alias("target"))
        ).alias("best")
        zero = bad.select("address", F.struct(F.lit(1.0).alias("conf"), F.col("target_confirmed").alias("confirmed"),
                                              F.col("address").alias("target")).alias("best"))
        one = both.join(bad.withColumnRenamed("address", "b"), "b").withColumn("target", F.col("b")).groupBy(
            F.col("a").alias("address")).agg(pick(F.col("confidence")))
        via = one.select(F.col("address").alias("b"), F.col("best.conf").alias("c2"),
                         F.col("best.confirmed").alias("target_confirmed"), F.col("best.target").alias("target"))
        two = both.join(subj.withColumnRenamed("address", "a"), "a", "left_semi").join(via, "b").groupBy(
            F.col("a").alias("address")).agg(pick(F.col("confidence") * F.col("c2")))
        allhops = (
            zero.withColumn("hops", F.lit(0)).unionByName(one.withColumn("hops", F.lit(1)))
            .unionByName(two.withColumn("hops", F.lit(2)))
        )
        return allhops.join(subj, "address", "left_semi").groupBy("address").agg(
            F.max(F.struct(F.col("best.conf").alias("conf"), (-F.col("hops")).alias("nh"),
                           F.col("best.confirmed").alias("confirmed"), F.col("best.target").alias("target"))).alias(tag)
        )

    strong = search(edges.where(F.col("type").isin(*STRONG_PATHS)), "s")
    weak = search(edges, "w")
    j = subj.join(strong, "address", "left").join(weak, "address", "left")
    conf = half_up(F.col("s.conf"), 2)
    level = ladder(
        "NONE", ((F.col("s.confirmed") > 0) & (conf >= 0.5), "STRONG"), (F.col("s").isNotNull(), "MODERATE"),
        (F.col("w").isNotNull(), "WEAK_ASSOCIATION"),
    )
    return j.select(
        "address", level.alias("level"), F.col("s.target").alias("target"), (-F.col("s.nh")).alias("hops"),
        conf.alias("path_confidence"),
        F.when(F.col("s").isNull(), F.lit(0.0)).otherwise(
            half_up(conf * F.when(F.col("s.confirmed") > 0, 0.95).otherwise(0.7), 2)).alias("confidence"),
    )


def _steps(edges: DataFrame) -> DataFrame:
    """Both directions of every linked pair with its best strong edge and its best edge of any kind.

    ``strong`` and ``any`` are (minus, type, evidence), minus the confidence so that the least is best; equal
    confidences go by type and evidence. Parallel edges meet only in this aggregate.
    """
    e = edges.select("a", "b", "type", "confidence", "evidence")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "type", "confidence", "evidence"))
    edge = F.struct((-F.col("confidence")).alias("minus"), "type", "evidence")
    return both.groupBy("a", "b").agg(F.min(F.when(F.col("type").isin(*STRONG_PATHS), edge)).alias("strong"), F.min(edge).alias("any"))


def _best_paths(steps: DataFrame, kind: str, subj: DataFrame, bad: DataFrame) -> DataFrame:
    """(address, target, best): the best path of at most two edges from each subject to each bad address.

    ``best`` orders by confidence, then fewer hops, then the smaller address in the middle, and carries the
    edges of the path. A second edge is looked up once for each (middle, target) before the subjects join it.
    """
    step = steps.where(F.col(kind).isNotNull()).select("a", "b", F.col(kind).alias("e"))
    conf = lambda e: -e["minus"]
    edge = lambda a, b, e: F.struct(F.col(a).alias("from"), F.col(b).alias("to"), e["type"].alias("type"), conf(e).alias("confidence"), e["evidence"].alias("evidence"))

    def best(confidence, hops: int, middle, *path):
        path = F.array(*path) if path else F.array().cast("array<struct<from:string,to:string,type:string,confidence:double,evidence:string>>")
        return F.struct((-confidence).alias("minus"), F.lit(hops).alias("hops"), middle.alias("middle"), path.alias("path")).alias("best")

    zero = subj.join(bad, subj.address == bad.target).select("address", "target", best(F.lit(1.0), 0, F.lit("")))
    last = step.join(bad.withColumnRenamed("target", "b"), "b", "left_semi")
    one = last.join(subj.withColumnRenamed("address", "a"), "a", "left_semi").select(F.col("a").alias("address"), F.col("b").alias("target"), best(conf(F.col("e")), 1, F.lit(""), edge("a", "b", F.col("e"))))
    first = step.join(subj.withColumnRenamed("address", "a"), "a", "left_semi").select(F.col("a").alias("address"), F.col("b").alias("middle"), F.col("e").alias("e1"))
    rest = last.select(F.col("a").alias("middle"), F.col("b").alias("target"), F.col("e").alias("e2"))
    two = first.join(rest, "middle").where(F.col("address") != F.col("target")).select(
        "address", "target", best(conf(F.col("e1")) * conf(F.col("e2")), 2, F.col("middle"), edge("address", "middle", F.col("e1")), edge("middle", "target", F.col("e2"))))
    return zero.unionByName(one).unionByName(two).groupBy("address", "target").agg(F.min("best").alias("best"))


def network_findings(subjects: DataFrame, edges: DataFrame, profiles: DataFrame, events: DataFrame, most_events: int = 5) -> DataFrame:
    """Every address with bad history within two hops of a subject, with the best path to it and its events.

    ``STRONG`` findings follow funding, transfers, shared funders and clusters. ``WEAK_ASSOCIATION`` rows are
    reached only when behavioural edges count too; they are no finding against anyone. ``path`` lists the
    edges in order; ``events`` are the earliest confirmed or strongly suspected ones of the target.
    ``by_path`` and ``by_confirmed`` rank a subject's rows of one kind, by path confidence or by confirmed
    events first. ``events(address, asset, type, status, tx_id, at)``.
    """
    steps = cut(_steps(edges))
    bad = profiles.where("confirmed > 0 OR strongly_suspected > 0").select(F.col("address").alias("target"), "confirmed", "strongly_suspected")
    subj = subjects.select("address").distinct()
    strong = cut(_best_paths(steps, "strong", subj, bad.select("target")))
    weak = _best_paths(steps, "any", subj, bad.select("target")).join(strong, ["address", "target"], "left_anti")
    found = strong.withColumn("kind", F.lit("STRONG")).unionByName(weak.withColumn("kind", F.lit("WEAK_ASSOCIATION")))
    told = events.where(F.col("status").isin("CONFIRMED", "STRONGLY_SUSPECTED")).join(bad.select(F.col("target").alias("address")), "address", "left_semi")
    order = Window.partitionBy("address").orderBy("at", "tx_id")
    told = told.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most_events).groupBy(F.col("address").alias("target")).agg(
        F.array_sort(F.collect_list(F.struct("_n", "asset", "type", "status", "tx_id"))).alias("_e"))
    told = told.select("target", F.transform("_e", lambda x: x.dropFields("_n")).alias("events"))
    rows = found.join(bad, "target").join(told, "target", "left").select(
        "address", "target", "kind", "confirmed", "strongly_suspected", F.col("best.hops").alias("hops"), half_up(-F.col("best.minus"), 2).alias("path_confidence"), F.col("best.path").alias("path"), "events")
    near_first = [F.desc("path_confidence"), "hops", "target"]
    return rows.withColumns({
        "by_path": F.row_number().over(Window.partitionBy("address", "kind").orderBy(*near_first)),
        "by_confirmed": F.row_number().over(Window.partitionBy("address", "kind").orderBy(F.desc("confirmed"), *near_first))})


# ---- lookups ---------------------------------------------------------------------------


def edges_of(edges: DataFrame, addresses: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` edges touching any of the addresses."""
    x = addresses.select(F.col("address").alias("x")).distinct()
    hit = edges.join(x, F.col("a") == F.col("x"), "left_semi").unionByName(
        edges.join(x, F.col("b") == F.col("x"), "left_semi")).dropDuplicates(["id"])
    return hit.orderBy(F.desc("last_at"), "id").limit(n)


def buyer_arrivals(wallet_assets: DataFrame, funding: DataFrame) -> DataFrame:
    """Each buyer's arrival in an asset with who funded it, if known."""
    return wallet_assets.join(funding.select("wallet", "funder", "classification"), "wallet", "left")


def funded_by(funding: DataFrame, funders: DataFrame) -> DataFrame:
    return funding.join(funders.select("funder"), "funder", "left_semi")


def analysis_coverage(wallet_history: DataFrame, classified: DataFrame, attribution: DataFrame) -> DataFrame:
    """Mean of wallet-history, attribution, classified-trade and mint-history completeness."""
    w = wallet_history.groupBy("asset").agg(
        F.avg(ladder(0.0, (F.col("state") == "COMPLETE", 1.0), (F.col("state") == "REUSED", 1.0),
                     (F.col("state") == "TRUNCATED", 0.75))).alias("wallets"))
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("wallets", "attributed", "classified", "mint_history")]
    return w.join(classified, "asset", "left").join(attribution, "asset", "left").select(
        "asset", half_up(sum(parts[1:], parts[0]) / 4.0, 3).alias("coverage"))
