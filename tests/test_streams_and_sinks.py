"""Streams give what batches give; sinks read back what was written."""

from pyspark.sql import functions as F

from pitchgrid.operators.tracking import track
from pitchgrid.plans import dataset_queries
from pitchgrid.sources.detections import read_detections
from pitchgrid.sources.sinks import document, markdown, run_manifest, write_csv, write_detections, write_splits
from pitchgrid.streaming import live
from tests.test_match import det


def test_windows_as_batch(spark, data):
    """Open windows are there as well: every event is counted."""
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").alias("start"), "event_type", "rows")
    assert sorted((r.start, r.event_type, r.rows) for r in dataset_queries.tumbling(spark, data).collect()) == sorted(map(tuple, batch.collect()))
    assert dataset_queries.sliding(spark, data).agg(F.sum("rows")).first()[0] == 2 * events.count()
    assert dataset_queries.user_sessions(spark, data).agg(F.sum("rows")).first()[0] == events.count()


def test_latest_over_many_batches(spark, tmp_path):
    rows = [(i, i // 7) for i in range(60)]
    for k in range(4):
        part = [(f"2025-01-01 00:{i:02d}:00", "a" if i % 2 else "b") for i, _ in rows if i % 4 == k]
        spark.createDataFrame(part, "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for mode in ("update", "complete"):
        stream = live.windowed_counts(live.source(spark, str(tmp_path / "in"), files=1), "ts", "2 hours", "10 minutes", None, ["event_type"])
        got = live.latest(stream, ["start", "end", "event_type"], str(tmp_path / mode), mode).collect()
        assert len(got) == 12 and all(r.rows == 5 for r in got)


def test_tracks_across_batches(spark, tmp_path):
    d = det(spark, *[("robots", f, (10 * f + 100 * k, 0, 10 * f + 100 * k + 40, 40)) for f in range(8) for k in range(2)])
    for i in range(4):
        d.where(f"frame_index in ({2 * i}, {2 * i + 1})").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.source(spark, str(tmp_path / "in"), files=1)
    live.run_to_table(live.live_tracks(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    streamed = {r.det_seq: r.track for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.det_seq: r.track_id for r in track(d).collect()}
    assert len(streamed) == 16 and len(set(streamed.values())) == len(set(batch.values()))


def test_sinks(spark, tmp_path):
    d = det(spark, ("ball", 3, (1, 2, 3, 4), 7), ("robots", 4, (1, 2, 5, 4)))
    write_detections(d, str(tmp_path / "d"))
    back = read_detections(spark, str(tmp_path / "d" / "*")).orderBy("frame_index").collect()
    assert [(r.frame_index, r.class_name, r.box, r.track_id) for r in back] == [(3, "ball", [1, 2, 3, 4], 7), (4, "robots", [1, 2, 5, 4], None)]
    t = spark.createDataFrame([("z", {"b": 2, "a": 1}, "train")], "zone string, n map<string,int>, split string")
    write_csv(t, str(tmp_path / "c"), ["n", "zone"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == [("a:1;b:2", "z")]
    write_splits(t, str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=train").is_dir()
    assert document(t.select("zone")) == [{"zone": "z"}] and "| z |" in markdown(t.select("zone"), "Zones")


def test_run_manifest(tmp_path):
    a, b = tmp_path / "a.py", tmp_path / "b.py"
    a.write_text("1")
    b.write_text("2")
    one, two = run_manifest(["x"], [str(a), str(b)], [str(a), "gone"]), run_manifest(["x"], [str(b), str(a)], [])
    assert one["sources"] == two["sources"] and one["artifacts"] == [{"path": str(a), "bytes": 1}, {"path": "gone", "bytes": None}]
    b.write_text("3")
    assert run_manifest(["x"], [str(a), str(b)], [])["sources"] != one["sources"]
