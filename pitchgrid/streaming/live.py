"""Causal operators over streams of detections and events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream over the parquet files of a table. Times without a zone are taken in the session's, as watermarks need."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    pattern = path[:-1] + f"[{path[-1]}]"  # a pattern takes a table of one file as well as a folder
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(pattern)
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def windowed_counts(events: DataFrame, at: str, late: str, size: str, slide: str | None, keys: list[str]) -> DataFrame:
    """Tumbling or sliding counts; rows later than the watermark are dropped by Spark."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    out = events.withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "rows")


def sessions(events: DataFrame, at: str, late: str, gap: str, keys: list[str]) -> DataFrame:
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "rows")


def deduplicated(events: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """The first of rows that agree in keys, within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def live_tracks(detections: DataFrame, threshold: float = 0.25, max_age: int = 12) -> DataFrame:
    """Greedy IoU tracking per match and class as state of a stream; each batch continues the tracks of the last.

    State: one row of open tracks a key (last frame, box, number), bounded by max_age."""
    from pitchgrid.operators.tracking import _iou_matrix

    def run(key, batches: Iterator[pd.DataFrame], state):  # noqa: ANN001, ANN202
        import numpy as np

        n, flat = state.get if state.exists else (0, [])
        open_ = np.array(flat, float).reshape(-1, 6)  # id, last frame, box
        rows = pd.concat(list(batches)).sort_values(["frame_index", "det_seq"])
        out = []
        for frame, g in rows.groupby("frame_index", sort=True):
            open_ = open_[frame - open_[:, 1] <= max_age]
            box = g[["x1", "y1", "x2", "y2"]].to_numpy(float)
            mine, taken = np.full(len(box), -1), np.zeros(len(open_), bool)
            if len(open_):
                m = _iou_matrix(box, open_[:, 2:])
                for at in np.argsort(-m, axis=None, kind="stable"):
                    i, j = divmod(int(at), len(open_))
                    if m[i, j] < threshold:
                        break
                    if mine[i] < 0 and not taken[j]:
                        mine[i], taken[j] = open_[j, 0], True
                        open_[j, 1], open_[j, 2:] = frame, box[i]
            for i in np.flatnonzero(mine < 0):
                mine[i], n = n, n + 1
                open_ = np.vstack([open_, [mine[i], frame, *box[i]]])
            out.append(pd.DataFrame({"match_id": key[0], "class_name": key[1], "frame_index": frame, "det_seq": g["det_seq"].to_numpy(), "track": mine}))
        state.update((n, open_.ravel().tolist()))
        yield pd.concat(out)

    cols = detections.select("match_id", "class_name", "frame_index", "det_seq", "x1", "y1", "x2", "y2")
    return cols.groupBy("match_id", "class_name").applyInPandasWithState(run, "match_id string, class_name string, frame_index long, det_seq long, track long", "n long, open array<double>", "append", "NoTimeout")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, exactly once, into parquet files."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def latest(stream: DataFrame, keys: list[str], at: str, mode: str = "update") -> DataFrame:
    """What an aggregating stream has counted by now, open windows included.

    Every batch writes the rows it changed (mode update) or all rows (complete) to a folder of its own number, so a batch that runs
    again replaces itself; of each key the row of the last batch holds, and in mode complete the last batch."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(f"{stream.schema.toDDL()}, batch long").parquet(f"{at}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == F.lit(last)).drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
