"""Stream output equals batch output."""

import glob
import os

import pytest
from conftest import DATA

from skycat.operators import jobs, scoring
from skycat.plans.fixtures import fixture
from skycat.streaming import streams


def test_job_status_stream(spark, tmp_path):
    rows = fixture(spark, DATA, "J")
    for i in range(4):
        rows.where(f"seq % 4 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = source.writeStream.foreachBatch(streams.job_status_sink(str(tmp_path / "log"))).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    kept = sorted(int(p.rpartition("=")[2]) for p in glob.glob(str(tmp_path / "log/generation=*")))
    assert kept == [2, 3]  # older generations are gone
    want = {tuple(r) for r in jobs.upsert_jobs(rows).select("tile", "band", "seq", "status").collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "log/generation=3")).select("tile", "band", "seq", "status").collect()} == want


def test_windows_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.windowed_resources(source, "3650 days").writeStream.outputMode("complete").format("memory").queryName("res").start()
    q.processAllAvailable()
    got = {(r.bucket.replace(tzinfo=None), r.n) for r in spark.sql("select cast(bucket as timestamp_ntz) bucket, n from res").collect()}
    q.stop()
    assert got == {(r.bucket, r.n) for r in jobs.resource_windows(events).collect()}


class Feed:
    """A folder of small files, read one after the other by each new start of a query."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        return self

    def stream(self):
        os.makedirs(f"{self.path}/in", exist_ok=True)
        return self.spark.readStream.schema(self.spark.createDataFrame([], self.schema).schema).parquet(f"{self.path}/in")


def run(query):
    query.processAllAvailable()
    query.stop()


def test_barrier(spark, tmp_path):
    feed = Feed(spark, tmp_path, "tile string, band string, ts string")
    got = []

    def batch(rows):
        feed.add(rows)
        out = streams.complete_tiles(feed.stream(), ("r", "g", "i"), "1 day", "1 hour")
        sink = lambda df, _: got.extend((r.tile, str(r.complete_at)) for r in df.collect())
        run(out.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start())

    day = "2026-01-01 "
    batch([("a", "r", day + "23:00:00"), ("a", "g", day + "23:30:00"), ("b", "r", day + "23:10:00"), ("c", "r", day + "10:00:00"), ("c", "u", day + "10:00:00")])
    assert got == []
    batch([("a", "i", "2026-01-02 00:20:00"), ("a", "r", "2026-01-02 00:30:00"), ("b", "r", "2026-01-02 00:40:00")])  # over midnight, and repeated bands
    assert got == [("a", "2026-01-02 00:20:00")]
    batch([("a", "g", "2026-01-02 01:00:00"), ("b", "g", "2026-01-02 01:00:00"), ("b", "i", "2026-01-02 01:10:00")])
    assert got[1:] == [("b", "2026-01-02 01:10:00")]
    batch([("d", "r", "2026-01-09 00:00:00")])  # moves the watermark
    batch([("c", "g", "2026-01-09 00:10:00"), ("c", "i", "2026-01-09 00:10:00")])  # c's first band is forgotten by now
    assert len(got) == 2


def test_late_rows_are_counted(spark, tmp_path):
    feed, path = Feed(spark, tmp_path, "ts string, value double"), str(tmp_path / "out")

    def batch(rows):
        feed.add(rows)
        run(feed.stream().writeStream.foreachBatch(streams.resource_sink(path, "2 hours", "1 hour")).option("checkpointLocation", str(tmp_path / "cp")).start())

    batch([("2026-01-01 10:10:00", 1.0), ("2026-01-01 10:50:00", 3.0), ("2026-01-01 12:00:00", 5.0)])
    batch([("2026-01-01 10:30:00", 8.0), ("2026-01-01 15:00:00", 2.0)])  # 10:30 is in time: its bucket ends after 12:00 - 2 h
    batch([("2026-01-01 11:30:00", 50.0), ("2026-01-01 12:59:00", 50.0), ("2026-01-01 13:30:00", 4.0)])  # two buckets ended by 15:00 - 2 h
    got = {str(r.bucket)[11:16]: (r.peak, r.mean, round(r.std, 6), r.n) for r in streams.resource_figures(spark, path).collect()}
    assert got == {"10:00": (8.0, 4.0, 2.94392, 3), "12:00": (5.0, 5.0, 0.0, 1), "15:00": (2.0, 2.0, 0.0, 1), "13:00": (4.0, 4.0, 0.0, 1)}
    t = streams.resource_totals(spark, path).first()
    assert (t.peak, t.mean, round(t.std, 6), t.rows, t.late) == (8.0, 3.75, 1.47196, 8, 2)


def test_new_positives_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path, "known_id string, ts string")
    feed.add([("K1", "2026-01-01 10:00:00"), ("K1", "2026-01-01 11:00:00"), ("K2", "2026-01-01 10:00:00")])
    got = []

    def start():
        sink = lambda df, _: got.extend(r.known_id for r in df.collect())
        run(streams.new_positive_stream(feed.stream(), "known_id").writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start())

    start()
    feed.add([("K2", "2026-01-01 12:00:00"), ("K3", "2026-01-01 12:00:00")])
    start()
    assert sorted(got) == ["K1", "K2", "K3"]


def test_score_stream_after_failure_and_restart(spark, tmp_path):
    feed, path = Feed(spark, tmp_path, "object_id long, values array<double>"), str(tmp_path / "out")

    def picky():
        def model(x):
            if (x[:, 0] == 7).any():
                raise ValueError("seven")
            return x.sum(1)

        return [model]

    sound = lambda: [lambda x: x.sum(1)]
    sink, broken = streams.score_sink(path, picky), [True]

    def crash_once(df, batch_id):
        sink(df, batch_id)
        if batch_id == 1 and broken:
            broken.clear()
            raise RuntimeError("the driver dies after the batch is written and before it is committed")

    def start():
        run(feed.stream().writeStream.foreachBatch(crash_once).option("checkpointLocation", str(tmp_path / "cp")).start())

    first, second = [(i, [float(i), 1.0]) for i in range(10)], [(i, [float(i % 9), 2.0]) for i in range(10, 20)] + [(20, None)]
    feed.add(first)
    start()
    feed.add(second)
    with pytest.raises(Exception, match="driver dies|foreachBatch|RuntimeError"):
        start()
    start()  # the same batch again
    assert {r.object_id: r.error for r in streams.failures(spark, path).collect()} == {7: "ValueError: seven", 16: "ValueError: seven", 20: "no array"}
    assert streams.retry_failed(spark, path, picky) == 3
    assert streams.retry_failed(spark, path, sound) == 1
    batch = scoring.score_arrays(spark.createDataFrame(first + second, feed.schema), sound).where("score is not null")
    assert {(r.object_id, r.score) for r in streams.scores(spark, path).select("object_id", "score").collect()} == {(r.object_id, r.score) for r in batch.collect()}
