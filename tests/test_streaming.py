import os
import tempfile
import time

from pyspark.sql import functions as F

from cinelake.plans.index import build_index
from cinelake.streaming.jobs import compact, current_index, debounced, index_arrivals, watched


def test_debounced_stream_closes_bursts(spark):
    at = tempfile.mkdtemp()
    for i, s in enumerate(["00:00:00", "00:00:10", "00:05:00", "01:00:00"]):
        spark.createDataFrame([("trash", f"2024-01-01 {s}")], "event_type string, ts string").select("event_type", F.to_timestamp("ts").alias("ts")).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema("event_type string, ts timestamp").parquet(f"{at}/in")
    q = debounced(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("bursts").collect()) == [1, 2]


def test_index_arrivals(spark):
    at, schema = tempfile.mkdtemp(), "dir string, file string, base string, size int, mtime timestamp"
    os.makedirs(f"{at}/in")
    stream = spark.readStream.schema(schema).parquet(f"{at}/in")
    for rows in ([("/d", "a.mp4", "a", 1, None), ("/d", "a.mp4", "a", 2, None), ("/d", "b.mp4", "b", 5, None)], [("/d", "b.mp4", "b", 3, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        index_arrivals(stream, f"{at}/store", f"{at}/c").awaitTermination()
    want = [("a.mp4", 2, 0), ("b.mp4", 3, 1)]
    assert sorted((r.file, r.size, r.version) for r in current_index(spark, f"{at}/store").collect()) == want
    compact(spark, f"{at}/store", f"{at}/fresh")
    assert sorted((r.file, r.size) for r in current_index(spark, f"{at}/fresh").collect()) == [w[:2] for w in want]


def test_index_follows_adds_removals_and_a_root_that_is_away(spark):
    """Deltas give what a build over the whole listing gives, before and after compaction."""
    at, schema = tempfile.mkdtemp(), "dir string, file string, base string, size long, mtime timestamp, gone boolean"
    os.makedirs(f"{at}/in")
    stream, away = spark.readStream.schema(schema).parquet(f"{at}/in"), {"/a": False, "/b": False, "/c": False}
    roots = lambda: spark.createDataFrame([(r, not x) for r, x in away.items()], "root string, present boolean")
    listing, previous = {}, spark.createDataFrame([], "base string, file string, dir string, size long, mtime timestamp")

    def turn(changes):
        """Files appear (size) or go (None); all below a root that is away are reported gone by the scan."""
        rows = [(d, f, f[:-4], size, None, size is None) for (d, f), size in changes.items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        index_arrivals(stream, f"{at}/store", f"{at}/c", roots).awaitTermination()
        for k, size in changes.items():
            listing.pop(k, None) if size is None else listing.update({k: size})

    def same():
        nonlocal previous
        files = spark.createDataFrame([(f"{d}/{f}", d, f[:-4], "mp4", size, None) for (d, f), size in listing.items()], "path string, dir string, stem string, ext string, size long, mtime timestamp")
        built = build_index(files, previous, roots()).select("dir", "file", "size")
        got = current_index(spark, f"{at}/store", roots().select("root")).select("dir", "file", "size")
        want = sorted(map(tuple, built.collect()))
        assert sorted(map(tuple, got.collect())) == want
        previous = spark.createDataFrame([(f[:-4], f, d, size, None) for d, f, size in want], previous.schema)
        return want

    turn({("/a", "x.mp4"): 1, ("/a/s", "y.mp4"): 2, ("/b", "z.mp4"): 3, ("/b/t", "w.mp4"): 4, ("/c", "v.mp4"): 5})
    assert len(same()) == 5
    turn({("/a", "x.mp4"): 7, ("/a/s", "y.mp4"): None, ("/a", "new.mp4"): 8})
    assert ("/a", "x.mp4", 7) in same()
    away["/b"] = True
    turn({("/b", "z.mp4"): None, ("/b/t", "w.mp4"): None, ("/a", "new.mp4"): None})
    assert ("/b", "z.mp4", 3) in same() and len(previous.collect()) == 4
    compact(spark, f"{at}/store")
    before = same()
    compact(spark, f"{at}/store")
    late = spark.createDataFrame([("/a", "late.mp4", "late", 1, None, False)], schema)
    late.write.mode("overwrite").parquet(f"{at}/store/version=2")  # a batch delivered again after it was compacted
    assert same() == before
    away["/b"] = False
    turn({("/b", "z.mp4"): 9, ("/b/t", "w.mp4"): None, ("/a", "back.mp4"): 1})
    assert ("/b", "z.mp4", 9) in same()
    del away["/c"]
    assert all(d != "/c" for d, _, _ in same())


def test_heartbeats_by_the_clock_of_events(spark):
    """A run is stale once the watermark is over 120 s past its last heartbeat; its state goes, and a later heartbeat begins it again."""
    at = tempfile.mkdtemp()
    os.makedirs(f"{at}/in")
    stream = spark.readStream.schema("run string, ts timestamp").parquet(f"{at}/in")
    clock = lambda s: f"2024-01-01 00:{s // 60:02}:{s % 60:02}"
    got = []

    def beat(*rows):
        spark.createDataFrame([(r, clock(s)) for r, s in rows], "run string, t string").select("run", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(f"{at}/in")
        q = watched(stream, 120, clock="EventTime").writeStream.foreachBatch(lambda b, n: got.extend((r["run"], r["last"].strftime("%H:%M:%S")[3:], r["stale"]) for r in b.collect())).option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        new = sorted(got)
        got.clear()
        return new

    assert beat(("a", 0), ("b", 10)) == [("a", "00:00", False), ("b", "00:10", False)]
    assert beat(("a", 100)) == []
    assert beat(("c", 131)) == [("b", "00:10", True), ("c", "02:11", False)]  # b silent for 121 s, a for 31
    assert beat(("c", 220)) == []  # a silent for exactly 120 s
    assert beat(("c", 221)) == [("a", "01:40", True)]
    assert beat(("a", 230)) == [("a", "03:50", False)]
    assert beat(("a", 225), ("c", 400)) == [("a", "03:50", True)]  # what comes late doesn't count


def test_heartbeats_by_the_wall_clock(spark):
    """No further event is needed for a run to become stale."""
    at = tempfile.mkdtemp()
    spark.createDataFrame([("a",)], "run string").select("run", F.current_timestamp().alias("ts")).coalesce(1).write.parquet(f"{at}/in")
    got = []
    q = watched(spark.readStream.schema("run string, ts timestamp").parquet(f"{at}/in"), 2).writeStream.foreachBatch(lambda b, n: got.extend((r["run"], r["stale"]) for r in b.collect())).option("checkpointLocation", f"{at}/c").trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while len(got) < 2 and time.time() < end:
            time.sleep(0.2)
    finally:
        q.stop()
    assert got == [("a", False), ("a", True)]
