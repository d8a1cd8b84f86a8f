"""Structured Streaming forms of the time-driven behaviours."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.core import under
from ..sources.files import MAX_ROOTS, short_list
from ..sources.publish import read_pointer, swap_pointer
from ..sources.store import workers_import


def debounced(events: DataFrame, key: str = "event_type", ts: str = "ts", gap: str = "30 seconds") -> DataFrame:
    """One row for each closed burst of (key, ts): a rebuild is due a gap after its last event. Batch and streaming alike."""
    rows = events.withWatermark(ts, gap) if events.isStreaming else events
    bursts = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
    return bursts.select(key, F.col("w.start").alias("started"), F.col("last"), F.col("w.end").alias("due"), "n")


def stale(beats: DataFrame, now, limit_seconds: int, key: str = "run", ts: str = "ts") -> DataFrame:
    """Each key's last heartbeat, and whether it lies more than the limit before ``now`` (a timestamp Column)."""
    last = beats.groupBy(key).agg(F.max(ts).alias("last"))
    return last.withColumn("stale", F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp")) > limit_seconds)


class Heartbeats(StatefulProcessor):
    """The last heartbeat of a key, and a timer for when it has been silent for too long."""

    def __init__(self, limit_seconds: int):
        self.limit = limit_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        seen = max(int(pd.Timestamp(f["ts"].max()).value // 1_000_000) for f in rows)
        before = self.last.get()
        if before is not None and seen <= before[0]:  # late, and no news
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((seen,))
        self.handle.registerTimer(seen + self.limit * 1000 + 1)
        if before is None:
            yield self._row(key, seen, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, self.last.get()[0], True)
        self.last.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: tuple, ms: int, stale: bool) -> pd.DataFrame:
        return pd.DataFrame({"run": [key[0]], "last": [pd.Timestamp(ms, unit="ms")], "stale": [stale]})


def watched(beats: DataFrame, limit_seconds: int, key: str = "run", ts: str = "ts", clock: str = "ProcessingTime", delay: str = "0 seconds") -> DataFrame:
    """A stream of (run, last, stale): a row when a key's heartbeats (key, ts) begin or begin again, and one, without waiting for another event, when ``limit_seconds`` have
    passed since the last; with that its state is dropped, so only live keys are held. ``clock``: ProcessingTime, or EventTime, where the watermark (``delay`` behind the latest event) is the clock.
    """
    spark = beats.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    workers_import(spark)
    rows = beats.select(F.col(key).cast("string").alias("run"), F.col(ts).alias("ts"))
    if clock == "EventTime":
        rows = rows.withWatermark("ts", delay)
    return rows.groupBy("run").transformWithStateInPandas(Heartbeats(limit_seconds), "run string, last timestamp, stale boolean", "Append", clock)


ENTRY = ["dir", "file", "base", "size", "mtime"]


def _under(rows: DataFrame, roots: DataFrame, how: str) -> DataFrame:
    """Rows whose folder lies below one of the roots (a short configured list)."""
    return rows.join(short_list(roots.select(F.col("root").alias("__root")), MAX_ROOTS), under(F.col("dir"), F.col("__root")), how)


def index_arrivals(arrivals: DataFrame, store: str, checkpoint: str, roots: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Writes each micro-batch of (dir, file, base, size, mtime) as one delta below ``store``; a batch that is run again replaces its own. ``current_index`` reads them.

    With a column ``gone`` a row that has it set takes a file away. ``roots`` gives (root, present) as it is when a batch comes: what is reported gone below a root
    that is away itself isn't taken for gone, so its files are carried forward.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = batch if "gone" in batch.columns else batch.withColumn("gone", F.lit(False))
        rows = rows.select(*ENTRY, F.coalesce("gone", F.lit(False)).alias("gone"))
        if roots is not None:
            away = roots().where("NOT present")
            rows = rows.where("NOT gone").unionByName(_under(rows.where("gone"), away, "left_anti"))
        rows.write.mode("overwrite").parquet(f"{store}/version={number}")

    return arrivals.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _store(spark: SparkSession, store: str) -> tuple[str | None, int, list[int]]:
    """The compacted part that readers use, the last delta in it, and the deltas behind it."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(store)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    base = read_pointer(spark, store)
    last = int(base.split("=")[1].split("-")[0]) if base else -1
    return base, last, sorted(v for n in names if n.startswith("version=") and (v := int(n.split("=")[1])) > last)


def _entries(spark: SparkSession, store: str) -> DataFrame:
    """The latest entry of each file, those that are gone included."""
    base, last, deltas = _store(spark, store)
    parts = []
    if base:
        parts.append(spark.read.parquet(f"{store}/{base}"))
    if deltas:
        rows = spark.read.option("basePath", store).parquet(*[f"{store}/version={v}" for v in deltas])
        parts.append(rows.select(*ENTRY, "gone", F.col("version").cast("int").alias("version")))
    rows = reduce(DataFrame.unionByName, parts)
    order = F.struct("version", F.coalesce("mtime", F.lit("0001-01-01").cast("timestamp")), "size", F.col("gone").alias("z"), "base", "mtime")
    return rows.groupBy("dir", "file").agg(F.max(order).alias("e")).select("dir", "file", "e.base", "e.size", "e.mtime", F.col("e.z").alias("gone"), "e.version")


def current_index(spark: SparkSession, store: str, roots: DataFrame | None = None) -> DataFrame:
    """Of each file the entry of the latest delta, unless that takes it away; inside one, that with the latest mtime, then the largest. ``roots`` (root): the
    configured ones; what lies below no other is left out."""
    rows = _entries(spark, store).where("NOT gone").drop("gone")
    return rows if roots is None else _under(rows, roots, "left_semi")


def compact(spark: SparkSession, store: str, into: str | None = None) -> None:
    """The current index as one part that stands for all deltas up to the last, in the store itself or as a fresh one. Readers turn to it in one step, and a delta that is
    delivered again later doesn't count, so compacting twice or beside a repeated batch changes nothing. Entries that are gone end here."""
    base, last, deltas = _store(spark, store)
    into = into or store
    if not deltas and into == store:
        return
    name = f"base={deltas[-1] if deltas else last}-{uuid.uuid4().hex}"
    _entries(spark, store).where("NOT gone").write.parquet(f"{into}/{name}")
    swap_pointer(spark, into, name)
