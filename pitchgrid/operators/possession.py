"""Possession, passes, situations: per-frame joins and windows over detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import distance
from pitchgrid.operators.blocks import frame_runs, lagged
from pitchgrid.operators.filters import FRAME, best_per, boxes, largest_field
from pitchgrid.sources.detections import BALLS, ROBOTS, is_in


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def best_ball(df: DataFrame) -> DataFrame:
    """Per frame the ball of the highest score."""
    return best_per(df.where(is_in(BALLS)), FRAME, [F.desc("score"), F.col("det_seq")]).drop("rank")


def robot_distances(df: DataFrame) -> DataFrame:
    """Best ball x robots of each frame with `distance`; an equi-join on the frame, never a product."""
    balls = best_ball(df).select(*FRAME, F.col("det_seq").alias("b_det_seq"), F.col("cx").alias("b_cx"), F.col("cy").alias("b_cy"), F.col("x1").alias("b_x1"), F.col("y1").alias("b_y1"), F.col("x2").alias("b_x2"), F.col("y2").alias("b_y2"))
    robots = df.where(is_in(ROBOTS)).select(*FRAME, "det_seq", "track_id", "object_id", "team", "cx", "cy")
    return balls.join(robots, FRAME).withColumn("distance", distance(F.col("cx"), F.col("cy"), F.col("b_cx"), F.col("b_cy")))


def possession(df: DataFrame, radius: float = 90.0) -> DataFrame:
    """One row per frame present: owner (nearest robot to the best ball within the radius) or null."""
    near = best_per(robot_distances(df), FRAME, [F.col("distance"), F.col("det_seq")]).where(F.col("distance") <= radius)
    owners = near.select(*FRAME, F.col("det_seq").alias("owner_seq"), F.col("track_id").alias("owner_track"), F.col("team").alias("owner_team"), "distance")
    return df.select(*FRAME).distinct().join(owners, FRAME, "left")


def owner_changes(owned: DataFrame) -> DataFrame:
    """pass (same team, .65) or interception (.70) where the owner differs from the last known owner; an unknown team is no common team."""
    rows = lagged(owned.where("owner_seq is not null"), ["match_id"], "frame_index", {"__t": "owner_track", "__m": "owner_team", "__s": "owner_seq"})
    rows = rows.where(F.col("__s").isNotNull() & ~F.col("owner_track").eqNullSafe(F.col("__t")))
    same = F.coalesce("owner_team", F.lit("unknown")) == F.coalesce("__m", F.lit("unknown"))
    falsy = lambda c: F.when(F.col(c).isNull() | (F.col(c) == 0), F.lit(-1).cast("long")).otherwise(F.col(c))
    return rows.select(*FRAME, F.when(same, "pass").otherwise("interception").alias("event_type"), F.when(same, 0.65).otherwise(0.70).alias("confidence"), falsy("__t").alias("from_track"), falsy("owner_track").alias("to_track"))


def streaks(owned: DataFrame, top: int = 20) -> DataFrame:
    """The longest runs of successive frames with one owner."""
    runs = frame_runs(owned.where("owner_track is not null"), ["match_id", "owner_track"], "frame_index", {"frames": F.count(F.lit(1))}, {"frames": F.sum("frames")})
    runs = runs.withColumnsRenamed({"start": "start_frame", "end": "end_frame"})
    return best_per(runs, ["match_id"], [F.desc("frames"), F.col("start_frame"), F.col("owner_track")], top)


def by_team(owned: DataFrame, fps: float = 30.0) -> DataFrame:
    rows = owned.where("owner_seq is not null").groupBy("match_id", F.coalesce("owner_team", F.lit("unknown")).alias("team")).agg(F.count(F.lit(1)).alias("frames"))
    total = F.sum("frames").over(Window.partitionBy("match_id"))
    return rows.select("match_id", "team", "frames", F.round(F.col("frames") / fps, 6).alias("seconds"), F.round(F.col("frames") / total, 6).alias("ratio"))


def dominance(owned: DataFrame) -> DataFrame:
    """Per match the team with most frames (alphabetical among equals), its ratio and margin to the next."""
    counts = owned.where("owner_seq is not null").groupBy("match_id", F.coalesce("owner_team", F.lit("unknown")).alias("team")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("match_id").orderBy(F.desc("n"), "team")
    rows = counts.withColumns({"r": F.row_number().over(w), "next": F.coalesce(F.lead("n").over(w), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("match_id"))}).where("r = 1")
    return rows.select("match_id", "team", F.col("n").alias("frames"), F.round(F.col("n") / F.col("total"), 6).alias("ratio"), F.round((F.col("n") - F.col("next")) / F.col("total"), 6).alias("margin"))


def collisions(df: DataFrame, radius: float = 55.0) -> DataFrame:
    """Pairs of robots of one frame at most radius apart."""
    a, b = boxes(df, ROBOTS, "a_", ("track_id",)), boxes(df, ROBOTS, "b_", ("track_id",))
    pairs = a.join(b, FRAME).where((F.col("a_det_seq") < F.col("b_det_seq")) & (distance(F.col("a_cx"), F.col("a_cy"), F.col("b_cx"), F.col("b_cy")) <= radius))
    return pairs.select(*FRAME, F.col("a_det_seq").alias("seq_a"), F.col("b_det_seq").alias("seq_b"), F.col("a_track_id").alias("track_a"), F.col("b_track_id").alias("track_b"))


def situations(df: DataFrame, width: int, radius: float = 90.0, slack: float = 22.0) -> DataFrame:
    """Per frame with a ball: possession state and the loss, pass, shot and hold estimates (6 decimals)."""
    order = [F.col("distance"), F.coalesce("track_id", F.lit(1000000000)), F.coalesce("object_id", F.lit("None")), F.col("det_seq")]
    whole = Window.partitionBy(*FRAME).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = lambda c, k: F.nth_value(c, k).over(whole)
    near = robot_distances(df).withColumns({"d1": nth("distance", 1), "d2": nth("distance", 2), "__track": nth("track_id", 1), "__team": nth("team", 1)})
    duel = F.coalesce((F.col("d2") <= radius + slack) & (F.col("d2") - F.col("d1") <= slack), F.lit(False))
    near = near.withColumn("state", F.when(duel, "disputed").when(F.col("d1") <= radius, "controlled").otherwise("free"))
    owned = F.col("state") == "controlled"
    near = near.withColumns({"owner_track": F.when(owned, F.col("__track")), "owner_team": F.when(owned, F.col("__team"))})
    other = ~F.col("track_id").eqNullSafe(F.col("owner_track")) & (F.col("owner_team").isNull() | F.coalesce(F.col("team") == F.col("owner_team"), F.lit(False)))
    frame = near.groupBy(*FRAME).agg(*[F.first(c).alias(c) for c in ("d1", "d2", "state", "owner_track", "owner_team")], F.min(F.when(other, F.col("distance"))).alias("mate"))
    balls = best_ball(df).select(*FRAME, F.col("cx").alias("bx"))
    rows = balls.join(frame, FRAME, "left").withColumn("state", F.coalesce("state", F.lit("free"))).join(largest_field(df), FRAME, "left")
    fx1, fx2 = F.coalesce("f_x1", F.lit(0.0)), F.coalesce("f_x2", F.lit(float(width)))
    edge = F.least(F.abs(F.col("bx") - fx1), F.abs(fx2 - F.col("bx")))
    t = F.when(F.col("mate").isNull(), F.lit(0.0)).otherwise(clamp(1 - F.col("mate") / 240.0))
    g = clamp(1 - edge / F.greatest(0.25 * F.greatest(fx2 - fx1, F.lit(1.0)), F.lit(1.0)))
    touch = clamp(F.col("d1") / max(radius, 1.0))
    pressure = F.when(F.col("d2").isNull(), F.lit(0.0)).otherwise(1 - clamp((F.col("d2") - F.col("d1")) / max(3 * slack, 1.0)))
    controlled, disputed = F.col("state") == "controlled", F.col("state") == "disputed"
    loss = F.when(disputed, 0.9).when(controlled, F.round(clamp(0.12 + 0.42 * touch + 0.46 * pressure) + 1e-9, 6)).otherwise(0.0)
    rows = rows.withColumns({"__t": t, "__g": g, "loss_risk": loss})
    tt, gg, ll = F.col("__t"), F.col("__g"), F.col("loss_risk")
    pass_p = F.when(controlled, clamp(0.18 + 0.32 * tt + 0.34 * ll)).when(disputed, clamp(0.18 + 0.18 * tt)).otherwise(clamp(0.04 + 0.08 * tt))
    shot_p = F.when(controlled, clamp(0.08 + 0.52 * gg + 0.08 * (1 - ll))).when(disputed, clamp(0.05 + 0.28 * gg)).otherwise(clamp(0.03 + 0.12 * gg))
    rows = rows.withColumns({"pass_p": pass_p, "shot_p": shot_p})
    hold_p = F.when(controlled, clamp(0.86 - 0.52 * ll - 0.14 * F.col("pass_p") - 0.18 * F.col("shot_p"))).when(disputed, 0.2).otherwise(0.08)
    six = lambda c: F.round(c + 1e-9, 6)  # noqa: E731  halves go up whatever their last bit says
    return rows.select(*FRAME, "state", "owner_track", "owner_team", six(ll).alias("loss_risk"), six(F.col("pass_p")).alias("pass_p"), six(F.col("shot_p")).alias("shot_p"), six(hold_p).alias("hold_p"))
