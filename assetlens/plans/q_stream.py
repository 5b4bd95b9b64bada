"""Streaming queries: the event table landed in several files as a stream, run to its end, read back."""

from pyspark.sql import functions as F

from assetlens.functions.durable import new_folder
from assetlens.plans.q_history import M01, M02, M03, M04, M05, PV, STABLE_SQL, THIN_SQL
from assetlens.plans.registry import query
from assetlens.plans.sqltext import ACT
from assetlens.sources.tables import Tables
from assetlens.streaming import jobs as J

PARTS = 4
LATE = "24 hours"
ROW_GROUP = 8 << 20  # bytes: a file is read by many tasks
TICK = -1  # the user whose one event, long after all others, lets the watermark pass them


class Streamed(Tables):
    """The same tapes, with the event table landed by time in a few files, each a micro-batch.

    One event in fifty comes a file late where that is at most twelve hours, and a last file holds the tick.
    """

    landed: dict[tuple[str, str], tuple[str, object]] = {}

    def read(self, name):
        if name != "events":
            return super().read(name)
        place = self.spark.sparkContext.applicationId, self.dir
        if place not in self.landed:
            self.landed[place] = self.land(super().read(name))
        folder, schema = self.landed[place]
        return J.read_stream(self.spark, folder, schema, files=1)

    def land(self, events):
        folder = new_folder(self.spark, "events")
        span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
        width = (span["hi"] - span["lo"]) / PARTS
        half_day = F.expr("interval 12 hours")
        part = lambda at: F.least(F.floor((F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.lit(span["lo"]).cast("timestamp"))) / (width.total_seconds() * 1e6)), F.lit(PARTS - 1))
        held = F.when(F.col("event_id") % 50 == 0, F.col("ts") + half_day).otherwise(F.col("ts"))
        dealt = events.withColumn("part", part(held))
        for k in range(PARTS):
            dealt.where(F.col("part") == k).drop("part").repartition(1).write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/part-{k}")
        tick = events.limit(1).withColumns({"event_type": F.lit("view"), "user_id": F.lit(TICK).cast(events.schema["user_id"].dataType), "ts": (F.lit(span["hi"]) + F.expr("interval 10 days")).cast(events.schema["ts"].dataType)})
        tick.coalesce(1).write.parquet(f"{folder}/part-{PARTS}")
        return folder, events.schema


def streamed(t):
    return Streamed(t.spark, t.dir)


def told(df, column="asset", prefix="U"):
    """Without the tick's rows."""
    return df.where(F.col(column) != f"{prefix}{TICK}")


@query("M01 M02 M03 M04 M05 streaming", f"WITH {PV} {M01} UNION ALL {M02} UNION ALL {M03} UNION ALL {M04} UNION ALL {M05}")
def stream_alerts(t):
    return told(J.run_to_table(J.alerts(streamed(t).verdicts(), LATE), "alerts"))


@query("D17 streaming", STABLE_SQL)
def stream_stable_verdicts(t):
    return told(J.run_to_table(J.stabilize(streamed(t).verdicts(), late=LATE), "stable"))


@query("S23 streaming", THIN_SQL)
def stream_thinned_history(t):
    return told(J.run_to_table(J.thin(streamed(t).verdicts().withColumn("volume24h", F.col("price") * 10), LATE), "thin"))


@query("S19 streaming", f"WITH {ACT} SELECT wallet, min(block_time) AS first_observed_at, max(block_time) AS last_observed_at, count(*) AS sightings FROM act GROUP BY 1")
def stream_wallet_registry(t):
    return told(J.registry(J.run_to_table(streamed(t).activity(), "registry", J.registry_parts)), "wallet", "W")


@query("S16 streaming", f"WITH {ACT} SELECT tx_id, asset, pool, wallet FROM act")
def stream_deduplicated(t):
    a = streamed(t).activity().withColumn("ts", F.timestamp_millis("block_time")).where(F.col("wallet") != f"W{TICK}")
    twice = a.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return J.run_to_table(J.dedupe(twice, ["tx_id", "pool", "asset"], "ts").select("tx_id", "asset", "pool", "wallet"), "dedupe")


@query("S16 S22 streaming", f"WITH {ACT} SELECT tx_id, asset, pool, wallet, block_time//86400000 AS day FROM act")
def stream_pruned_append(t):
    """Every file's rows come again with the next ones; a batch reads only the days its rows lie in."""
    a = streamed(t).activity().select("tx_id", "asset", "pool", "wallet", "block_time")
    twice = a.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    r = J.run_to_table(twice, "append", lambda path: J.append_once(path, ["tx_id", "pool", "asset"], "block_time"))
    return told(r, "wallet", "W").select("tx_id", "asset", "pool", "wallet", F.col("day").cast("long").alias("day"))


@query("D06 streaming", f"""WITH {ACT}, w AS (SELECT asset, block_time, quote_amount, unnest(range(((block_time//1800000)-11)*1800000, (block_time//1800000+1)*1800000, 1800000)) AS start_ms FROM act WHERE status='SUCCESS')
 SELECT asset, start_ms, count(*) AS trades, sum(quote_amount)::DOUBLE AS volume FROM w GROUP BY 1,2""")
def stream_sliding_activity(t):
    s = streamed(t).trades().withColumns({"ts": F.timestamp_millis("block_time"), "price": F.col("quote_amount").cast("double")})
    r = J.run_to_table(J.windowed_activity(s, "ts", LATE), "windows")
    return r.select("asset", F.unix_millis("window.start").alias("start_ms"), "trades", "volume")
