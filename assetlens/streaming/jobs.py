"""Structured Streaming jobs: file-source streams, keyed state in event-time order, idempotent sinks.

Each stateful job has a batch twin with the same result on the same readings, however late they come within
the watermark's delay. A job that depends on order keeps the readings of a hash bucket of keys in a state list
until the watermark has passed them, then works them off by key and time from one small tuple of state a key;
timers wake a bucket, so nothing is read for those that have nothing due. A key's history never meets in one
frame: a call holds a bucket's readings between two watermarks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from assetlens.functions.durable import new_folder
from assetlens.functions.scalar import lookup
from assetlens.operators import folds as FO
from assetlens.operators import monitor as M
from assetlens.operators.place import VERDICT_TIER
from assetlens.operators.tables import append_idempotent

NUM = ["score", "coverage", "price", "liquidity"]
CHUNK = 10_000  # readings handed over at once
BUCKETS = 1024  # hash buckets of assets whose readings wait together
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is always stated."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(folder)


def dedupe(stream: DataFrame, keys: list[str], time: str, late: str = "24 hours") -> DataFrame:
    """One row per natural key; keys are remembered for the watermark only."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_activity(stream: DataFrame, time: str, late: str = "24 hours", size: str = "6 hours", slide: str = "30 minutes") -> DataFrame:
    """Sliding-window trades, volume and last price per asset; a window is final and leaves the state when the watermark passes it."""
    return stream.withWatermark(time, late).groupBy("asset", F.window(time, size, slide)).agg(
        F.count("*").alias("trades"), F.sum("quote_amount").cast("double").alias("volume"), F.max_by("price", F.col(time)).alias("last_price"))


# ---- work in event-time order ----------------------------------------------------------


class InOrder(StatefulProcessor):
    """Holds a bucket's readings until the watermark has passed them, then hands on each asset's by (observed_at, seq).

    ``fold(last, readings)`` takes the asset's small state (None at first) and some readings in order, and gives
    the new state and the rows to emit. ``row`` and ``out`` are the schemas. Readings wait as Arrow pieces, one
    for each frame that came; the small states of a bucket's assets are kept as one value, since a call to the
    store for each asset costs more than reading and writing them together.
    """

    def __init__(self, row: StructType, out: StructType, fold):
        self.names, self.schema, self.out, self.fold = row.names, to_arrow_schema(row), out, fold
        self.asset = row.names.index("asset")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "piece binary")
        self.last = handle.getValueState("last", "states binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for pdf in rows:
            if pdf["observed_at"].isna().any():
                raise ValueError("a reading without a time has no place in the order")
            piece = pa.RecordBatch.from_pandas(pdf[self.names], self.schema, preserve_index=False)
            self.waiting.appendValue(_piece(piece))
            top = int(pdf["observed_at"].max())
            newest = top if newest is None else max(newest, top)
        if newest is not None:
            self.handle.registerTimer(newest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(r[0])), self.schema) for r in self.waiting.get()], self.schema)
        due = pc.less_equal(held["observed_at"], passed)
        later = held.filter(pc.invert(due)).combine_chunks()
        if later.num_rows:
            self.waiting.put([_piece(b) for b in later.to_batches()])
        else:
            self.waiting.clear()
        ready = held.filter(due).sort_by([(c, "ascending") for c in ("asset", "observed_at", "seq")])
        states = pickle.loads(bytes(self.last.get()[0])) if self.last.exists() else {}
        out = []
        for asset, readings in groupby(_tuples(ready), key=itemgetter(self.asset)):
            last = states.get(asset)
            while some := list(islice(readings, CHUNK)):
                last, made = self.fold(last, some)
                out += made
                if len(out) >= CHUNK:
                    yield pd.DataFrame(out, columns=self.out.names, dtype=object)
                    out = []
            states[asset] = last
        if ready.num_rows:
            self.last.update((pickle.dumps(states),))
        if out:
            yield pd.DataFrame(out, columns=self.out.names, dtype=object)

    def close(self) -> None:
        pass


def _piece(batch: pa.RecordBatch) -> tuple[bytes]:
    return (batch.serialize().to_pybytes(),)


def _tuples(table: pa.Table) -> Iterator[tuple]:
    for batch in table.to_batches(max_chunksize=CHUNK):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def in_order(stream: DataFrame, row: str, out: str, fold, late: str = "24 hours", buckets: int = BUCKETS) -> DataFrame:
    """Run ``fold`` over each asset's readings by event time; readings later than ``late`` are dropped.

    Assets are held by hash bucket, so the calls to Python and to the state store follow the buckets and not the assets.
    """
    kinds = [_parse_datatype_string(s) for s in (row, out)]
    s = stream.select(*kinds[0].names).withColumn("_ts", F.timestamp_millis("observed_at")).withWatermark("_ts", late)
    processor = InOrder(*kinds, fold)
    s = s.withColumn("_bucket", F.pmod(F.xxhash64("asset"), F.lit(buckets)).cast("int"))
    return s.groupBy("_bucket").transformWithStateInPandas(processor, kinds[1], "append", "EventTime")


def stabilize(stream: DataFrame, k: int = FO.CONFIRMATIONS, hold_ms: int = FO.HOLD_MS, late: str = "24 hours") -> DataFrame:
    """Stable verdict per reading; keeps the machine state and the time of the last reading."""
    table = FO._machine(k)
    tiers = VERDICT_TIER

    def fold(last, readings):
        code, seen = last or (0, None)
        out = []
        for asset, at, seq, verdict in readings:
            if seen is None or at - seen > hold_ms:
                code = 0
            code, seen = int(table[int(at == seen), code, tiers[verdict]]), at
            out.append((asset, at, seq, verdict, FO.NAMES[int(FO._shown(code, k))]))
        return (code, seen), out

    row = "asset string, observed_at long, seq long, verdict string"
    return in_order(stream, row, row + ", stable string", fold, late)


def thin(stream: DataFrame, late: str = "24 hours") -> DataFrame:
    """Readings worth storing; keeps the last stored reading and the time of the last one seen."""
    num = [*NUM, "volume24h"]
    stream = stream if "state" in stream.columns else stream.withColumn("state", F.lit(None).cast("string"))
    names = ["observed_at", "verdict", "state", *num]

    def named(values):
        d = dict(zip(names, values))
        return SimpleNamespace(**{c: float("nan") if c in num and d[c] is None else d[c] for c in names})

    def fold(last, readings):
        stored, seen = (named(last[1:]), last[0]) if last else (None, None)
        out = []
        for asset, at, seq, *values in readings:
            if at == seen:
                continue
            seen, r = at, named([at, *values])
            if stored is None:
                why = "first"
            elif (r.verdict, r.state) != (stored.verdict, stored.state):
                why = "transition"
            elif FO._material(r, stored):
                why = "material-change"
            else:
                why = "heartbeat" if at - stored.observed_at >= FO.HEARTBEAT_MS else None
            if why:
                stored = r
                out.append((asset, at, seq, r.verdict, why))
        return (seen, *(getattr(stored, c) for c in names)), out

    numbers = ", ".join(f"{c} double" for c in num)
    return in_order(stream, f"asset string, observed_at long, seq long, verdict string, state string, {numbers}", "asset string, observed_at long, seq long, verdict string, reason string", fold, late)


def with_previous(stream: DataFrame, late: str = "24 hours") -> DataFrame:
    """Each reading beside the one before it, the state being that one reading."""

    def fold(last, readings):
        out = []
        for r in readings:
            _, _, seq, verdict, score, _, price, liquidity = r
            out.append((*r, *(last or (None,) * 5), last is None))
            last = (verdict, score, price, liquidity, seq)
        return last, out

    row = "asset string, observed_at long, seq long, verdict string, score double, coverage double, price double, liquidity double"
    out = row + ", p_verdict string, p_score double, p_price double, p_liquidity double, p_seq long, first boolean"
    return in_order(stream, row, out, fold, late)


def alerts(stream: DataFrame, late: str = "24 hours") -> DataFrame:
    return M.all_alerts(with_previous(stream, late))


# ---- sinks -----------------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def append_once(path: str, keys: list[str], time: str | None = None, buckets: int = 16):
    """``foreachBatch`` writer: rows whose key is not stored yet.

    With ``time``, the epoch-millisecond column that a key's rows agree in, the table is laid out by day and by
    a hash of the key. A batch reads only the stored days and buckets that its own keys lie in, so what it reads
    does not grow with the history; equal keys always lie in the same ones. Without ``time`` it is laid out by
    bucket alone. A replayed batch overwrites its own partitions, so a restart changes nothing.
    """
    parts = ["day", "bucket"] if time else ["bucket"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        placed = placed.withColumn("day", F.floor(F.col(time) / 86_400_000).cast("int")) if time else placed
        if _exists(spark, path):
            # one row for each day and bucket of the batch reaches the driver
            touched = [tuple(r) for r in placed.select(*parts).distinct().collect()]
            stored = stored_in(spark.read.parquet(path), parts, touched).where(F.col("batch_id") != batch_id)
            fresh = append_idempotent(placed, stored, [*keys, *parts])
        else:
            fresh = append_idempotent(placed, placed.where(F.lit(False)), [*keys, *parts])
        out = fresh.withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts, "batch_id").parquet(path)

    return write


def stored_in(table: DataFrame, parts: list[str], touched: list[tuple]) -> DataFrame:
    """The rows of the touched partitions, by a condition that partition pruning understands."""
    by_first: dict = {}
    for t in touched:
        by_first.setdefault(t[0], []).append(t[1:])
    condition = F.lit(False)
    for first, rest in by_first.items():
        mine = F.col(parts[0]) == first
        condition = condition | ((mine & F.col(parts[1]).isin(*[r[0] for r in rest])) if len(parts) > 1 else mine)
    return table.where(condition)


def registry_parts(path: str, buckets: int = 16):
    """``foreachBatch`` writer of first and last sightings: a batch's own minimum, maximum and count per wallet.

    A batch writes only what it saw, by bucket of the wallet, and a replay overwrites its own parts. No state is
    kept in the stream, and late rows need no care. :func:`registry` merges the parts.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        seen = batch.groupBy("wallet").agg(F.min("block_time").alias("first_observed_at"), F.max("block_time").alias("last_observed_at"), F.count("*").alias("sightings"))
        out = seen.withColumns({"bucket": F.pmod(F.xxhash64("wallet"), F.lit(buckets)).cast("int"), "batch_id": F.lit(batch_id)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(path)

    return write


def registry(parts: DataFrame) -> DataFrame:
    """One row per wallet from the parts of all batches."""
    return parts.groupBy("wallet").agg(F.min("first_observed_at").alias("first_observed_at"), F.max("last_observed_at").alias("last_observed_at"), F.sum("sightings").alias("sightings"))


def run_to_table(stream: DataFrame, name: str, foreach=None) -> DataFrame:
    """Run a stream over what is there now into the shared folder, and read the result back.

    ``foreach`` makes a ``foreachBatch`` writer for the table's path.
    """
    spark = stream.sparkSession
    root = new_folder(spark, f"stream-{name}")
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").outputMode("append")
        q = w.foreachBatch(foreach(f"{root}/table")).start() if foreach is not None else w.format("parquet").start(f"{root}/table")
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.parquet(f"{root}/table")
