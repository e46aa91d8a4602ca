"""Structured Streaming forms of learning, feedback and time neighbourhood.

The same column expressions run in batch and in streams; state is bounded by watermarks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from recollect.functions import exprs as X
from recollect.operators.lifecycle import MOVES, candidates
from recollect.sources.store import scratch


def source(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A Parquet folder, or one file of a folder, as a stream."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", p.getName()).parquet(str(p.getParent()))


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into Parquet, and reads it.

    append: rows that are final.  complete: the state after the last micro-batch, so windows and
    sessions that the watermark has not closed yet are there too.
    """
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    if mode == "complete":
        last = []

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            last[:] = [f"{out}/batch={number}"]

        q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def learn_stream(turns: DataFrame) -> DataFrame:
    """Hash and summary of each learnable user turn of a stream of turns."""
    learn = turns.where("role = 'user'").where(F.length(X.strip_context("text")) > 0)
    return learn.select("conv_id", "turn", X.content_hash("text").alias("hash"), X.quality_gate("text").alias("passes"))


def dedup_stream(turns: DataFrame, at: str, delay: str = "1 hour") -> DataFrame:
    """First turn of each content hash within the watermark."""
    return turns.withColumn("hash", X.content_hash("text")).withWatermark(at, delay).dropDuplicatesWithinWatermark(["hash"])


def feedback_stream(events: DataFrame, window: str = "30 days", slide: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Negative signals of each memory in sliding windows; in append mode late ones count up to the watermark's delay."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    w = F.window("ts", window, slide)
    return e.where("event_type = 'error'").groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("negatives")).select(F.col("w.start").alias("start"), "user_id", "negatives")


#: What a feedback stream gives of a memory after each micro-batch that changed it.
FEEDBACK = "memory_id long, storage double, strength double, confidence long, positive long, negative long, retired_at timestamp"
_DAY_MS = 86_400_000
#: Workers have no session that could read these from text.
VALUES = StructType([*(StructField(k, DoubleType()) for k in MOVES), StructField("positive", LongType()), StructField("negative", LongType()), StructField("retired", LongType())])
WAITING = StructType([StructField("ts", LongType()), StructField("ord", LongType()), StructField("signal", StringType())])
TIMES = StructType([StructField("ts", LongType())])


class FeedbackState(StatefulProcessor):
    """A memory's values, the signals that may still be overtaken, and its negative ones of the last days.

    Signals behind the watermark are folded for good, in the order of their times; those before
    it wait in a list and count on top.  A timer drops negative signals that are too old to count.
    """

    def __init__(self, days: int = 30, limit: int = 3):
        self.span, self.limit = days * _DAY_MS, limit

    def init(self, handle) -> None:
        self.handle = handle
        self.values, self.waiting, self.bad = handle.getValueState("values", VALUES), handle.getListState("waiting", WAITING), handle.getListState("bad", TIMES)

    def _fold(self, v: list, bad: list[int], signals: list[tuple]) -> tuple[list, list[int]]:
        """Values and recent negatives after signals (microseconds, ord, signal) in order."""
        v, bad = list(v), list(bad)
        for ts, _, signal in sorted(signals):
            if signal not in ("positive", "negative"):
                continue
            up = signal == "positive"
            for i, (plus, minus, low, high) in enumerate(MOVES.values()):
                v[i] = min(high, v[i] + plus) if up else max(low, v[i] + minus)
            v[3 if up else 4] += 1
            if not up:
                bad = [t for t in bad if t >= ts - self.span * 1000] + [ts]
                if len(bad) >= self.limit and v[5] < 0:
                    v[5] = ts
        return v, bad

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(x) for x in self.waiting.get()]
        for part in rows:
            held += list(zip(part["us"].tolist(), part["ord"].tolist(), part["signal"].tolist(), strict=True))
        v = list(self.values.get()) if self.values.exists() else [0.5, 0.5, 5.0, 0, 0, -1]
        bad = [x[0] for x in self.bad.get()]
        v, bad = self._fold(v, bad, [x for x in held if x[0] <= mark])
        held = [x for x in held if x[0] > mark]
        self.values.update(tuple(v))
        for state, items in ((self.waiting, held), (self.bad, [(t,) for t in bad])):
            if items:
                state.put(items)
            else:
                state.clear()
        if bad:
            self.handle.registerTimer(min(bad) // 1000 + self.span + 1)
        out, _ = self._fold(v, bad, held)
        yield pd.DataFrame({"memory_id": [key[0]], "storage": [round(out[0], 6)], "strength": [round(out[1], 6)], "confidence": [round(out[2])], "positive": [out[3]], "negative": [out[4]], "retired_at": [pd.Timestamp(out[5], unit="us") if out[5] >= 0 else pd.NaT]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = [(x[0],) for x in self.bad.get() if x[0] // 1000 + self.span >= timerValues.getCurrentWatermarkInMs()]
        if kept:
            self.bad.put(kept)
            self.handle.registerTimer(min(kept)[0] // 1000 + self.span + 1)
        else:
            self.bad.clear()
        yield from ()

    def close(self) -> None:
        pass


def feedback_values(signals: DataFrame, delay: str = "1 day") -> DataFrame:
    """FEEDBACK of each memory that a micro-batch of signals (memory_id, ts, ord, signal) changes.

    State by memory: its values, signals up to `delay` late, which still find their place, and
    negative ones of 30 days.  retired_at: of the first negative signal that was the third in 30 days.
    """
    s = signals.select(F.col("memory_id").cast("long").alias("memory_id"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ord").cast("long").alias("ord"), "signal").withWatermark("ts", delay)
    return s.groupBy("memory_id").transformWithStateInPandas(FeedbackState(), StructType.fromDDL(FEEDBACK), "Update", "EventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def last_values(stream: DataFrame, key: str, name: str, state: str | None = None, into: str | None = None) -> DataFrame:
    """Runs a stream of updates over all that is there now; gives the last row of each key.

    Every micro-batch writes a folder under its number, so one that comes again overwrites it.
    state, into: where a run that goes on later keeps its state and its batches.
    """
    spark = stream.sparkSession
    out, state = into or scratch(spark, name), state or scratch(spark, f"{name}-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(out)
    names = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(*[F.max_by(c, "batch").alias(c) for c in names]).select(stream.columns)


def session_stream(events: DataFrame, gap: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: events at most `gap` apart."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    s = F.session_window("ts", gap)
    return e.groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def neighbour_stream(left: DataFrame, right: DataFrame, by: str, hours: float = 2.0, delay: str = "1 hour") -> DataFrame:
    """(src, dst, weight): rows (id, ts, by) of two streams with the same `by`, at most `hours` apart, each pair once.

    An interval join: the watermarks on both sides bound what either keeps.
    """
    span = F.expr(f"interval {int(hours * 3600)} seconds")
    a = left.select(F.col("id").alias("src"), F.col("ts").cast("timestamp").alias("t1"), F.col(by).alias("g1")).withWatermark("t1", delay)
    b = right.select(F.col("id").alias("dst"), F.col("ts").cast("timestamp").alias("t2"), F.col(by).alias("g2")).withWatermark("t2", delay)
    near = a.join(b, (F.col("g1") == F.col("g2")) & (F.col("src") < F.col("dst")) & (F.col("t2") >= F.col("t1") - span) & (F.col("t2") <= F.col("t1") + span))
    apart = F.abs(F.unix_micros("t1") - F.unix_micros("t2")) / (hours * 3.6e9)
    return near.select("src", "dst", F.round(1 - apart, 6).alias("weight"))


def triggered(writer, interval: str | None):
    """A writer that runs once over what is there, or every `interval` (which also spaces repeated work)."""
    return writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)


def upsert_candidates(turns: DataFrame, into: str, interval: str | None = None):
    """A query that writes the candidates of each micro-batch as one append; repeats of a batch overwrite it.

    Its state lies beside its output, so a query that starts again goes on where it stopped.
    """

    def write(batch: DataFrame, number: int) -> None:
        candidates(batch, ["conv_id", "turn"]).write.mode("overwrite").parquet(f"{into}/batch={number}")

    writer = turns.where("role = 'user'").writeStream.foreachBatch(write).option("checkpointLocation", f"{into}/_state")
    return triggered(writer, interval).start()


def serve(turns: DataFrame, engine, state: str, every: int = 20, interval: str | None = None, now: Callable[[], datetime] | None = None):
    """A query by which an engine learns from a stream of turns, one micro-batch after the other.

    Every write of a batch carries its number: what a batch that failed half-way has written is
    not written again when it comes again, and one that was taken to its end is left out.  After
    `every` learned statements since the last maintenance the engine maintains its graph.  now
    gives the time of each batch, by default the clock's (UTC).
    """
    clock = now or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))

    def write(batch: DataFrame, number: int) -> None:
        if engine.has_seen(state, number):
            return
        at = clock()
        done = engine.learn(batch, at, step=(state, number))
        engine.note_batch(state, number, done["added"], at)
        if engine.learned_since_maintenance() >= every:
            engine.maintain("light", at)

    writer = turns.where("role = 'user'").writeStream.foreachBatch(write).option("checkpointLocation", state)
    return triggered(writer, interval).start()
