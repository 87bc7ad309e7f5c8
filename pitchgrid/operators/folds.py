"""Greedy folds over ordered groups: within a frame by whole arrays, along an entity as sorted streams that hold one state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.functions.geometry import Box
from pitchgrid.operators.blocks import runs_of


def greedy(df: DataFrame, keys: Sequence[str], order: Sequence[Column], clash: Callable[[Column, Column], Column], limit: int | None = None) -> DataFrame:
    """Rows kept when each group is walked in order and a row goes that clashes with a kept one; `limit` ends the walk."""
    cols = [c for c in df.columns if c not in keys]
    order_cols = [o.alias(f"__o{i}") for i, o in enumerate(order)]
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order_cols, *cols))).alias("__all"))

    def step(kept: Column, row: Column) -> Column:
        fits = ~F.exists(kept, lambda k: clash(k, row))
        if limit is not None:
            fits = fits & (F.size(kept) < limit)
        return F.when(fits, F.concat(kept, F.array(row))).otherwise(kept)

    kept = F.aggregate("__all", F.slice("__all", 1, 0), step)
    return packed.select(*keys, F.explode(kept).alias("__k")).select(*keys, *[F.col(f"__k.{c}").alias(c) for c in cols])


def _framewise(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str], work: Callable[[np.ndarray], np.ndarray], finish: Callable[[pa.Table, list], pa.Table], schema: Any) -> DataFrame:
    """Whole groups of a frame, sorted, through Arrow: work sees the columns of one group's rows, finish makes a table's output of all results."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, keys):
            code = [group.column(k).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for k in keys]
            cuts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in code], axis=0), True]).tolist()
            rows = np.column_stack([group.column(c).to_numpy() for c in columns])
            yield from finish(group, [work(rows[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]).combine_chunks().to_batches()

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _kept(clash: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: int | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """Which boxes of a group stay when it is walked in order and each one that stays takes those after it that clash; `limit` ends the walk."""

    def work(box: np.ndarray) -> np.ndarray:
        keep, count = np.ones(len(box), bool), 0
        for i in range(len(box) - (limit is None)):
            if keep[i]:
                count += 1
                if limit is not None and count >= limit:
                    keep[i + 1 :] = False
                    break
                rest = slice(i + 1, len(box))
                keep[rest] &= ~clash(box[i], box[rest])
        return keep

    return work


_CORNERS = ("x1", "y1", "x2", "y2")


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intersection of a box with others, and the areas of both."""
    size = lambda m: np.clip(m[..., 2] - m[..., 0], 0, None) * np.clip(m[..., 3] - m[..., 1], 0, None)
    inter = np.clip(np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0]), 0, None) * np.clip(np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]), 0, None)
    return inter, size(a), size(b)


def _filtered(group: pa.Table, keep: list[np.ndarray]) -> pa.Table:
    return group.filter(pa.array(np.concatenate(keep)))


def suppress(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Non-maximum suppression per frame and class: by score, a box goes that overlaps a kept one by threshold.

    Frames can hold thousands of candidates, for which an interpreted array fold is too slow: sorted
    groups stream through Arrow, and each kept box is compared with all that follow at once."""

    def clash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        inter, own, other = _shared(a, b)
        union = own + other - inter
        return (inter > 0) & (union > 0) & (inter >= threshold * union)

    return _framewise(df, ["match_id", "frame_index", "class_name"], [F.desc("score"), F.col("det_seq")], _CORNERS, _kept(clash), _filtered, df.schema)


def suppress_robots(
    df: DataFrame, others: DataFrame, near_ball: Column, fragment: Column, *, max_per_frame: int | None = None, min_area: float = 0.0,
    max_iou: float = 0.55, max_contained: float = 0.82, min_centre: float = 0.0, centre_ratio: float = 0.0,
) -> DataFrame:
    """Robots kept in order (near a ball, whole rather than fragment, score, area); other classes pass."""
    b = Box.of()

    def clash(one: np.ndarray, rest: np.ndarray) -> np.ndarray:
        inter, own, other = _shared(one, rest)
        union, least = own + other - inter, np.minimum(own, other)
        d = np.sqrt(((one[0] + one[2] - rest[:, 0] - rest[:, 2]) / 2) ** 2 + ((one[1] + one[3] - rest[:, 1] - rest[:, 3]) / 2) ** 2)
        out = ((inter > 0) & (union > 0) & (inter >= max_iou * union)) | ((least > 0) & (inter >= max_contained * least))
        if min_centre > 0:
            out |= d < min_centre
        if centre_ratio > 0:
            diagonal = lambda m: np.sqrt((m[..., 2] - m[..., 0]) ** 2 + (m[..., 3] - m[..., 1]) ** 2)
            out |= d < centre_ratio * np.maximum(diagonal(one), diagonal(rest))
        return out

    order = [(~near_ball).cast("int"), fragment.cast("int"), F.desc("score"), F.desc(b.area), F.col("det_seq")]
    size = F.when(F.coalesce("area", F.lit(0.0)) > 0, F.col("area")).otherwise(b.area)
    kept = _framewise(df.where(size >= min_area), ["match_id", "frame_index"], order, _CORNERS, _kept(clash, max_per_frame), _filtered, df.schema)
    return kept.unionByName(others) if others is not None else kept


def walked(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable[[Any, tuple], tuple[Any, bool]]) -> DataFrame:
    """The rows a walk over each group keeps: step(state, values of the order columns) gives the next state (None at first) and whether the row stays.

    Sorted groups stream through Arrow and only the state is held, however many rows a group has."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            places = []
            columns = [zip(*[batch.column(k).to_pylist() for k in part], strict=True) for part in (keys, order)]
            for i, (key, values) in enumerate(zip(*columns, strict=True)):
                if key != group:
                    group, state = key, None
                state, keep = step(state, values)
                if keep:
                    places.append(i)
            yield batch.take(pa.array(places, pa.int64()))

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, df.schema)


def cooled(events: DataFrame, keys: Sequence[str], cooldown: Column, order: Sequence[str], strength: str) -> DataFrame:
    """Events per key with a cooldown: within it of the kept event, a stronger one takes its place, others go.

    order begins with the event's time. A walk marks the event that takes another's place or begins anew, and a walk back drops
    what was replaced, so nothing but one event is held."""
    rows = events.withColumn("__cool", cooldown)
    at, n = order[0], int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [*keys, at, strength, "__cool"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, None  # last: (key, time, strength, row of a batch)
        for batch in batches:
            done: list[pa.RecordBatch] = []
            columns = [batch.column(c).to_pylist() for c in names]
            held, places = last[3] if last else None, []
            pick: int | None = None
            for i, values in enumerate(zip(*columns, strict=True)):
                key, (time, power, cool) = values[: len(keys)], values[len(keys) :]
                if key != group or time - last[1] >= cool:
                    if last is not None:
                        (places.append(pick) if pick is not None else done.append(held))
                    group, last, pick = key, (key, time, power, None), i
                elif power > last[2]:
                    last, pick = (key, time, power, None), i
            if done:
                yield from done
            yield batch.take(pa.array(places, pa.int64()))
            if last is not None:
                last = (*last[:3], batch.slice(pick, 1) if pick is not None else held)
        if last is not None:
            yield last[3]

    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, rows.schema).drop("__cool")


def spaced(df: DataFrame, keys: Sequence[str], at: str, gap: int, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows at least `gap` after the last one taken, per key, `limit` at most."""

    def step(state, values):  # noqa: ANN001, ANN202
        last, count = state or (None, 0)
        if (last is None or values[0] - last >= gap) and (limit is None or count < limit):
            return (values[0], count + 1), True
        return state, False

    return walked(df, keys, [at, *order], step)


def apart(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, gap: int) -> DataFrame:
    """Each group walked in order: a row is taken unless one taken before lies less than `gap` from it; `turn` counts those taken, from 0.

    Sorted groups stream through Arrow. Of each stretch of `gap` one row at most is taken, so that three
    stretches tell whether a row fits, however many are taken."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken, count = None, {}, 0
        for batch in batches:
            places, turns = [], []
            rows = zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), batch.column(at).to_pylist(), strict=True)
            for i, (key, x) in enumerate(rows):
                if key != group:
                    group, taken, count = key, {}, 0
                s = x // width
                if gap > 0 and any(abs(x - taken[k]) < gap for k in (s - 1, s, s + 1) if k in taken):
                    continue
                taken[s] = x
                places.append(i)
                turns.append(count)
                count += 1
            out = batch.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(turns, pa.int32())], names=[*batch.schema.names, "turn"])

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("turn", T.IntegerType())]))


def clusters(df: DataFrame, keys: Sequence[str], reach: float) -> DataFrame:
    """Boxes walked by score; each joins the first cluster with a member within reach, else opens one. One united box per cluster."""
    keys, kinds = list(keys), dict(df.dtypes)

    def work(p: np.ndarray) -> np.ndarray:
        own = np.zeros(len(p), np.int32)
        for i in range(len(p)):
            near = np.sqrt(((p[:i] - p[i]) ** 2).sum(axis=1)) <= reach
            own[i] = own[:i][near].min() if near.any() else own[:i].max(initial=0) + 1
        return own

    def finish(group: pa.Table, own: list[np.ndarray]) -> pa.Table:
        return group.append_column("cluster", pa.array(np.concatenate(own)))

    cols = [*keys, "det_seq", "score", "x1", "y1", "x2", "y2", "cx", "cy"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", cluster int"
    rows = _framewise(df.select(*cols), keys, [F.desc("score"), F.col("det_seq")], ("cx", "cy"), work, finish, schema)
    area = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))
    return rows.groupBy(*keys, "cluster").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max("score").alias("score"), F.round(F.sum(area), 4).alias("area"), F.count(F.lit(1)).alias("parts"))
