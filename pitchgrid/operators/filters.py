"""Row filters over detections. Reasons come as one first-match CASE, so a report is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import Box, ball_overlap, distance, point_in_box
from pitchgrid.sources.detections import BALL_HANDLERS, BALLS, FIELD, ROBOTS, is_in

FRAME = ["match_id", "frame_index"]


def boxes(df: DataFrame, names: tuple[str, ...], prefix: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The frame key, box and centre of the named classes, with a prefix, for joins within a frame."""
    cols = ("det_seq", "x1", "y1", "x2", "y2", "cx", "cy", *extra)
    return df.where(is_in(names)).select(*FRAME, *[F.col(c).alias(f"{prefix}{c}") for c in cols])


def edge_balls_removed(df: DataFrame, width: int, height: int, margin: float = 4.0) -> DataFrame:
    """Drops ball boxes within the margin of the frame's edge."""
    touches = (F.col("x1") <= margin) | (F.col("y1") <= margin) | (F.col("x2") >= width - margin) | (F.col("y2") >= height - margin)
    return df.where(~(is_in(BALLS) & touches))


def artifact_reason(min_area: float, max_area: float, max_extent: float, max_aspect: float, fallback: Column | None = None) -> Column:
    """Why a robot of the colour fallback is no robot; null where it may be one."""
    fallback = fallback if fallback is not None else (F.col("source") == "color_robots") | (F.col("prompt") == "hsv_dark_robot_fallback")
    area, extent = F.coalesce("area", F.lit(0.0)), F.coalesce("extent", F.lit(0.0))
    reason = (
        F.when(area < min_area, "fallback_area").when(area > max_area, "fallback_max_area").when(extent > max_extent, "fallback_extent").when(Box.of().aspect > max_aspect, "fallback_aspect")
    )
    return F.when(is_in(ROBOTS) & F.coalesce(fallback, F.lit(False)), reason)


def ball_context_reason(df: DataFrame, overlap: float = 0.20, require_context: bool = True, max_area: float | None = None, margin: float = 20.0) -> DataFrame:
    """Balls with `reason`: oversized, robot_overlap, outside_context or null (kept)."""
    balls = df.where(is_in(BALLS))
    b = Box.of()
    r = Box.of("r_")
    on_robot = point_in_box(F.col("cx"), F.col("cy"), r) | (ball_overlap(b, r) >= overlap)
    hits = balls.select(*FRAME, "det_seq", "x1", "y1", "x2", "y2", "cx", "cy")
    robot = hits.join(boxes(df, ROBOTS, "r_"), FRAME).where(on_robot).select("det_seq").distinct().withColumn("__robot", F.lit(True))
    field = hits.join(boxes(df, FIELD, "r_"), FRAME).where(point_in_box(F.col("cx"), F.col("cy"), r)).select("det_seq")
    hand = hits.join(boxes(df, BALL_HANDLERS, "r_"), FRAME).where(point_in_box(F.col("cx"), F.col("cy"), r, margin)).select("det_seq")
    context = field.union(hand).distinct().withColumn("__context", F.lit(True))
    out = balls.join(robot, "det_seq", "left").join(context, "det_seq", "left")
    size = F.when(F.coalesce("area", F.lit(0.0)) > 0, F.col("area")).otherwise(b.area)
    reason = F.when(size > max_area, "oversized") if max_area is not None else F.when(F.lit(False), "oversized")
    reason = reason.when(F.col("__robot"), "robot_overlap")
    if require_context:
        reason = reason.when(F.col("__context").isNull(), "outside_context")
    return out.withColumn("reason", reason).drop("__robot", "__context")


def balls_in_play(df: DataFrame, radius: float = 90.0, margin: float = 8.0) -> DataFrame:
    """Balls whose centre lies in a field box or near a robot."""
    balls = df.where(is_in(BALLS))
    # One scan for both roles: a union of two branches over one exchange can meet the join with another number of partitions.
    near = boxes(df, FIELD + ROBOTS, "o_", ("class_name",))
    close = distance(F.col("cx"), F.col("cy"), F.col("o_cx"), F.col("o_cy")) <= radius
    hit = (balls["match_id"] == near["match_id"]) & (balls["frame_index"] == near["frame_index"])
    inside = point_in_box(F.col("cx"), F.col("cy"), Box.of("o_"), margin)
    return balls.join(near, hit & F.when(is_in(ROBOTS, "o_class_name"), close).otherwise(inside), "left_semi")


def blobs_off_robots(df: DataFrame, margin: float = 8.0) -> DataFrame:
    """Balls whose centre lies in no robot box."""
    balls, robots = df.where(is_in(BALLS)), boxes(df, ROBOTS, "r_")
    same = (balls["match_id"] == robots["match_id"]) & (balls["frame_index"] == robots["frame_index"])
    return balls.join(robots, same & point_in_box(F.col("cx"), F.col("cy"), Box.of("r_"), margin), "left_anti")


def field_balls(df: DataFrame, calibrated: Column) -> DataFrame:
    """Balls on the calibrated field, used only in matches without any field detection; others stay whole."""
    known = df.where(is_in(FIELD)).select("match_id").distinct().withColumn("__field", F.lit(True))
    return df.where(is_in(BALLS)).join(known, "match_id", "left").where(F.col("__field").isNotNull() | calibrated).drop("__field")


def pseudo_label_reason(classes: tuple[str, ...], min_score: float = 0.60, min_area: float = 1.0, need_mask: bool = True) -> Column:
    reason = F.when(~is_in(classes), "class_filter").when(F.col("score") < min_score, "low_score").when(F.coalesce("area", Box.of().area) < min_area, "small_area")
    return reason.when(F.col("mask_path").isNull(), "missing_mask") if need_mask else reason


def best_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, name: str = "rank") -> DataFrame:
    """The first n rows of each group; ties end in det_seq by the caller's order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def dataset_selection(df: DataFrame, classes: tuple[str, ...], min_score: float, stride: int, top: int = 8, frames: int | None = None) -> DataFrame:
    """Rows for a frame dataset: named classes and score, every stride-th frame, `top` per class and frame, the first non-empty frames of each match."""
    rows = df.where(is_in(classes) & (F.col("score") >= min_score) & (F.col("frame_index") % stride == 0))
    rows = best_per(rows, [*FRAME, "class_name"], [F.desc("score"), F.col("det_seq")], top)
    if frames is not None:
        kept = best_per(rows.select(*FRAME).distinct(), ["match_id"], [F.col("frame_index")], frames, "nth")
        rows = rows.join(kept, FRAME)
    return rows


def goals_on_field(df: DataFrame, goals: tuple[str, ...], margin: float = 30.0) -> DataFrame:
    """Goals that meet an expanded field box of their frame: foot, centre or box."""
    rows, fields = df.where(is_in(goals)), boxes(df, FIELD, "f_")
    f, g = Box.of("f_"), Box.of()
    meets = point_in_box(g.cx, F.col("y2"), f, margin) | point_in_box(g.cx, g.cy, f, margin) | ((F.col("x2") > f.x1 - margin) & (F.col("x1") < f.x2 + margin) & (F.col("y2") > f.y1 - margin) & (F.col("y1") < f.y2 + margin))
    same = (rows["match_id"] == fields["match_id"]) & (rows["frame_index"] == fields["frame_index"])
    return rows.join(fields, same & meets, "left_semi")


def largest_field(df: DataFrame) -> DataFrame:
    """Per frame the field box of the largest area, prefixed f_."""
    rows = boxes(df, FIELD, "f_")
    return best_per(rows, FRAME, [F.desc(Box.of("f_").area), F.col("f_det_seq")]).drop("rank")


def vertical_gate(df: DataFrame, height: int, low: float, high: float) -> DataFrame:
    return df.where((F.col("cy") / height).between(low, high))
