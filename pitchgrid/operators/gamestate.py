"""Frame states, segments and robots that are gone or stand still."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import Box, boxes_overlap, point_in_polygon
from pitchgrid.operators.blocks import frame_runs, lagged, last_known
from pitchgrid.operators.filters import FRAME, balls_in_play, boxes
from pitchgrid.operators.folds import walked
from pitchgrid.sources.detections import BALLS, FIELD, HUMANS, ROBOTS, is_in


def dense_frames(df: DataFrame) -> DataFrame:
    """Every frame from a match's first to its last."""
    ends = df.groupBy("match_id").agg(F.min("frame_index").alias("__a"), F.max("frame_index").alias("__z"))
    return ends.select("match_id", F.explode(F.sequence("__a", "__z")).alias("frame_index"))


def human_frames(df: DataFrame, margin: float = 12.0) -> DataFrame:
    """Frames with a human who meets the field, a ball or a robot, or where none of these is seen."""
    humans, context = boxes(df, HUMANS, "h_"), boxes(df, FIELD + BALLS + ROBOTS, "c_")
    pairs = humans.join(context, FRAME, "left")
    return pairs.where(F.col("c_det_seq").isNull() | boxes_overlap(Box.of("h_"), Box.of("c_"), margin)).select(*FRAME).distinct()


def robots_removed(df: DataFrame, after: int = 18) -> DataFrame:
    """(match_id, track_id, frame_index): exactly `after` frames since a robot was last seen, where it is not back and the match goes on.

    Closed form of the frame-by-frame scan: the next sighting is missing or later than that frame.
    """
    seen = df.where(is_in(ROBOTS) & F.col("track_id").isNotNull()).select("match_id", "track_id", "frame_index").distinct()
    nxt = F.lead("frame_index").over(Window.partitionBy("match_id", "track_id").orderBy("frame_index"))
    last = df.groupBy("match_id").agg(F.max("frame_index").alias("__last"))
    rows = seen.withColumn("__next", nxt).join(last, "match_id").withColumn("frame_index", F.col("frame_index") + after)
    return rows.where((F.col("__next").isNull() | (F.col("__next") > F.col("frame_index"))) & (F.col("frame_index") <= F.col("__last"))).select("match_id", "track_id", "frame_index")


def robots_disabled(df: DataFrame, after: int = 45, threshold: float = 2.0) -> DataFrame:
    """Frames on which a seen robot has not left its anchor for exactly `after` frames; the anchor moves with it when it does.

    The anchor lasts through absences, so a track is walked as one; sorted tracks stream and only the anchor is held."""

    def step(anchor, r):  # noqa: ANN001, ANN202
        frame, _, x, y = r
        if anchor is None or math.sqrt((anchor[1] - x) ** 2 + (anchor[2] - y) ** 2) > threshold:
            return (frame, x, y), False
        return anchor, frame - anchor[0] == after

    rows = df.where(is_in(ROBOTS) & F.col("track_id").isNotNull()).select("match_id", "track_id", "frame_index", "det_seq", "cx", "cy")
    return walked(rows, ["match_id", "track_id"], ["frame_index", "det_seq", "cx", "cy"], step).select("match_id", "track_id", "frame_index").distinct()


def frame_states(df: DataFrame, missing: int = 12, removed: int = 18, disabled: int = 45, still_px: float = 2.0, polygon: list[tuple[float, float]] | None = None) -> DataFrame:
    """State, confidence and reasons of every frame between a match's first and last."""
    has = F.lit(True)
    balls = df.where(is_in(BALLS)).select(*FRAME).distinct().withColumn("__ball", has)
    play = balls_in_play(df).select(*FRAME)
    if polygon:
        play = play.union(df.where(is_in(BALLS) & point_in_polygon(F.col("cx"), F.col("cy"), polygon)).select(*FRAME))
    gone = robots_removed(df, removed).groupBy(*FRAME).agg(F.array_sort(F.collect_set("track_id")).alias("robot_removed"))
    still = robots_disabled(df, disabled, still_px).groupBy(*FRAME).agg(F.array_sort(F.collect_set("track_id")).alias("robot_disabled"))
    rows = dense_frames(df).join(balls, FRAME, "left").join(play.distinct().withColumn("__play", has), FRAME, "left")
    rows = rows.join(human_frames(df).withColumn("__human", has), FRAME, "left").join(gone, FRAME, "left").join(still, FRAME, "left")
    rows = last_known(rows, ["match_id"], "frame_index", F.when(F.col("__ball"), F.col("frame_index")), "__last_ball")
    last_ball = F.col("__last_ball")
    none = F.expr("cast(array() as array<bigint>)")
    rows = rows.withColumns({
        "__missing": F.coalesce(F.col("__ball").isNull() & (F.col("frame_index") - last_ball >= missing), F.lit(False)), "__out": F.col("__ball").isNotNull() & F.col("__play").isNull(),
        "human_intervention": F.col("__human").isNotNull(), "ball_in_play": F.col("__play").isNotNull(),
        "robot_removed": F.coalesce("robot_removed", none), "robot_disabled": F.coalesce("robot_disabled", none),
    })
    human = F.col("human_intervention")
    reasons = F.array_compact(F.array(
        F.when(F.col("__missing"), "ball_missing"), F.when(F.col("__out"), "ball_out_of_play"), F.when(human, "dead_ball_by_intervention"), F.when(human, "human_on_or_near_field"),
        F.when(F.size("robot_disabled") > 0, "robot_disabled_candidate"), F.when(F.size("robot_removed") > 0, "robot_removed_candidate"),
    ))
    dead = F.col("__missing") | F.col("__out")
    return rows.select(
        *FRAME, F.when(human, "human_intervention").when(dead, "dead_ball").otherwise("in_play").alias("state"),
        F.when(human, 0.8).when(dead, 0.7).when(F.col("ball_in_play"), 0.55).otherwise(0.45).alias("confidence"), reasons.alias("reasons"),
        "ball_in_play", "human_intervention", "robot_removed", "robot_disabled",
    )


def segments(states: DataFrame, least: int = 1) -> DataFrame:
    """Islands of one state on successive frames, with mean confidence and the union of reasons."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))  # noqa: E731  a handful of reasons
    runs = frame_runs(
        states, ["match_id", "state"], "frame_index", {"frames": F.count(F.lit(1)), "total": F.sum("confidence"), "reasons": union("reasons")},
        {"frames": F.sum("frames"), "confidence": F.round(F.sum("total") / F.sum("frames"), 6), "reasons": F.array_join(union("reasons"), ";")},
    )
    return runs.where(F.col("frames") >= least).withColumnsRenamed({"start": "start_frame", "end": "end_frame"})


def entry_events(states: DataFrame) -> DataFrame:
    """An event where a state other than in_play begins, and one for each robot gone or disabled."""
    entered = lagged(states, ["match_id"], "frame_index", {"__was": "state"}).where((F.col("state") != "in_play") & ~F.col("state").eqNullSafe(F.col("__was")))
    entered = entered.select(*FRAME, F.col("state").alias("event_type"), F.lit(-1).cast("long").alias("actor"))
    each = lambda c: states.select(*FRAME, F.lit(c).alias("event_type"), F.explode(c).alias("actor"))
    return entered.union(each("robot_removed")).union(each("robot_disabled"))
