"""Match events: shots, goals, confirmation of goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import distance
from pitchgrid.operators.blocks import lagged, last_known
from pitchgrid.operators.filters import FRAME, balls_in_play, best_per
from pitchgrid.operators.possession import possession
from pitchgrid.sources.detections import BALLS, GOALS, is_in

#: Frames in which an equal event of a type is the same event.
COOLDOWNS = {"shot": 12, "pass": 8, "interception": 8, "collision": 20, "goal_candidate": 45, "goal_confirmed": 45, "goal_rejected": 45}


def goal_side(name: Column) -> Column:
    return F.when(F.lower(name).contains("blue"), "blue").when(F.lower(name).contains("yellow"), "yellow").otherwise("unknown")


def scoring_team(side: Column) -> Column:
    return F.when(side == "blue", "yellow").when(side == "yellow", "blue").otherwise("unknown")


def known_track(c: str) -> Column:
    """Track 0 counts as none, as -1."""
    return F.when(F.col(c).isNull() | (F.col(c) == 0), F.lit(-1).cast("long")).otherwise(F.col(c))


def inside_goal(prefix_ball: str = "b_", prefix_goal: str = "g_") -> Column:
    b, g = (lambda c: F.col(prefix_ball + c)), (lambda c: F.col(prefix_goal + c))
    margin = F.greatest(F.lit(8.0), (b("x2") - b("x1")) * 0.5)
    return b("cx").between(g("x1") - margin, g("x2") + margin) & b("cy").between(g("y1") - margin, g("y2") + margin)


def _named(df: DataFrame, prefix: str, cols: tuple[str, ...]) -> DataFrame:
    return df.select(*FRAME, *[F.col(c).alias(prefix + c) for c in cols])


BALL = ("det_seq", "score", "track_id", "x1", "y1", "x2", "y2", "cx", "cy")
GOAL = (*BALL, "class_name", "source")


def best_in_play(df: DataFrame) -> DataFrame:
    return best_per(balls_in_play(df), FRAME, [F.desc("score"), F.col("det_seq")]).drop("rank")


def goal_hits(df: DataFrame) -> DataFrame:
    """Best in-play ball inside a goal box, every frame and goal."""
    hits = _named(best_in_play(df), "b_", BALL).join(_named(df.where(is_in(GOALS)), "g_", GOAL), FRAME).where(inside_goal())
    side = goal_side(F.col("g_class_name"))
    return hits.select(*FRAME, F.col("b_det_seq").alias("ball_seq"), F.col("g_det_seq").alias("goal_seq"), side.alias("goal_side"), scoring_team(side).alias("scoring_team"), known_track("b_track_id").alias("actor"))


def shots(df: DataFrame, width: int, margin_ratio: float = 0.08, speed: float = 8.0) -> DataFrame:
    """The best in-play ball moves outward into the left or right margin, faster than `speed`, since the last frame with one."""
    rows = lagged(best_in_play(df), ["match_id"], "frame_index", {"px": "cx", "py": "cy"}).where("px is not null")
    margin, dx = width * margin_ratio, F.col("cx") - F.col("px")
    side = F.when((F.col("cx") <= margin) & (dx < 0), "left").when((F.col("cx") >= width - margin) & (dx > 0), "right")
    rows = rows.withColumns({"target_side": side, "speed": distance(F.col("cx"), F.col("cy"), F.col("px"), F.col("py"))}).where(F.col("target_side").isNotNull() & (F.col("speed") > speed))
    owner = possession(df)
    owner = last_known(owner, ["match_id"], "frame_index", F.when(F.col("owner_seq").isNotNull(), F.struct("owner_track")), "__known")
    known = F.col("__known")
    owners = owner.select(*FRAME, F.when(known.isNull(), F.lit(-1).cast("long")).otherwise(known["owner_track"]).alias("actor"))
    team = F.when(F.col("target_side") == "left", "blue").otherwise("yellow")
    return rows.join(owners, FRAME).select(*FRAME, "target_side", team.alias("shooting_team"), F.round("speed", 6).alias("speed_px_frame"), "actor")


def goal_candidates(df: DataFrame, cooldown: int = 45) -> DataFrame:
    """Goal hits with at least `cooldown` frames between those of one side; the first of a frame counts."""
    from pitchgrid.operators.folds import spaced

    hits = best_per(goal_hits(df), ["match_id", "frame_index", "goal_side"], [F.col("goal_seq")]).drop("rank")
    return spaced(hits, ["match_id", "goal_side"], "frame_index", cooldown)


def previous_balls(df: DataFrame, reach: int = 8) -> DataFrame:
    """As-of join backward: for each best ball the nearest earlier ball of its track (any, where unknown) within `reach` frames, the best of its frame.

    Frames are cut into buckets of `reach`, so each ball meets two buckets by equality and no range join is needed.
    """
    balls = _named(df.where(is_in(BALLS)), "p_", BALL).withColumnRenamed("frame_index", "p_frame").withColumn("__b", F.floor(F.col("p_frame") / reach))
    now = best_per(df.where(is_in(BALLS)), FRAME, [F.desc("score"), F.col("det_seq")]).drop("rank").select(*FRAME, "det_seq", "track_id", "cx", "cy")
    probe = now.withColumn("__b", F.explode(F.array(F.floor(F.col("frame_index") / reach), F.floor(F.col("frame_index") / reach) - 1)))
    hit = probe.join(balls, ["match_id", "__b"]).where((F.col("p_frame") < F.col("frame_index")) & (F.col("p_frame") >= F.col("frame_index") - reach) & (F.col("track_id").isNull() | (F.col("track_id") == F.col("p_track_id"))))
    hit = best_per(hit, ["match_id", "frame_index", "det_seq"], [F.desc("p_frame"), F.desc("p_score"), F.col("p_det_seq")])
    return hit.select(*FRAME, "det_seq", F.col("p_frame").alias("previous_frame"), F.col("p_det_seq").alias("previous_seq"), F.round(distance(F.col("cx"), F.col("cy"), F.col("p_cx"), F.col("p_cy")), 6).alias("moved_px"))


def confirmed_goals(df: DataFrame, candidates: DataFrame, ahead: int = 4, need: int = 2, back: int = 8, min_score: float = 0.45, min_motion: float = 3.0) -> DataFrame:
    """Each candidate as goal_confirmed or goal_rejected with the first reason that holds."""
    goals = _named(df.where(is_in(GOALS)), "g_", GOAL).withColumn("goal_side", goal_side(F.col("g_class_name")))
    goals = best_per(goals, [*FRAME, "goal_side"], [F.desc("g_score"), F.col("g_det_seq")]).drop("rank")
    balls = _named(df.where(is_in(BALLS)), "b_", BALL)
    rows = candidates.select("match_id", "frame_index", "goal_side", "scoring_team", "actor").join(goals, [*FRAME, "goal_side"], "left")
    pool = rows.join(balls, FRAME, "left")
    match = F.coalesce(F.col("b_track_id") == F.col("actor"), F.lit(False)).cast("int")
    rows = best_per(pool, [*FRAME, "goal_side"], [F.desc(match), F.desc_nulls_last("b_score"), F.col("b_det_seq")]).drop("rank")
    # Frames f-back .. f+ahead around each candidate, with the ball's own track where it is known.
    around = rows.withColumn("__f", F.explode(F.expr(f"sequence(frame_index - {back}, frame_index + {ahead})")))
    near = _named(df.where(is_in(BALLS)), "n_", BALL).withColumnRenamed("frame_index", "__f")
    around = around.join(near, ["match_id", "__f"]).where(F.col("b_track_id").isNull() | (F.col("b_track_id") == F.col("n_track_id")))
    after = around.where((F.col("__f") >= F.col("frame_index")) & inside_goal("n_")).groupBy("match_id", "frame_index", "goal_side").agg(F.collect_set(F.col("__f") - F.col("frame_index")).alias("__in"))
    run = F.aggregate(F.array_sort("__in"), F.lit(0).cast("long"), lambda n, k: F.when(k == n, n + 1).otherwise(n))
    after = after.select("match_id", "frame_index", "goal_side", run.alias("inside_frames"))
    before = best_per(around.where(F.col("__f") < F.col("frame_index")), ["match_id", "frame_index", "goal_side"], [F.desc("__f"), F.desc("n_score"), F.col("n_det_seq")])
    to_goal = lambda p: distance(F.col(p + "cx"), F.col(p + "cy"), (F.col("g_x1") + F.col("g_x2")) / 2, (F.col("g_y1") + F.col("g_y2")) / 2)
    before = before.select("match_id", "frame_index", "goal_side", inside_goal("n_").alias("__was_in"), distance(F.col("b_cx"), F.col("b_cy"), F.col("n_cx"), F.col("n_cy")).alias("__moved"), (to_goal("n_") - to_goal("b_")).alias("__closer"))
    key = ["match_id", "frame_index", "goal_side"]
    rows = rows.join(after, key, "left").join(before, key, "left")
    reason = (
        F.when(F.col("g_det_seq").isNull(), "missing_goal_detection").when(F.col("b_det_seq").isNull(), "missing_ball_detection")
        .when(F.col("g_source") == "goal_geometry", "geometry_only_goal").when(F.col("g_score") < min_score, "low_goal_confidence")
        .when(F.col("__moved").isNull(), "missing_entry_history").when(F.col("__was_in"), "ball_already_inside_goal")
        .when(F.col("__moved") < min_motion, "insufficient_entry_motion").when(F.col("__closer") <= 0, "ball_not_approaching_goal")
        .when(F.coalesce("inside_frames", F.lit(0).cast("long")) < need, "insufficient_inside_frames")
    )
    return rows.select(*key, "scoring_team", F.when(reason.isNull(), "goal_confirmed").otherwise("goal_rejected").alias("event_type"), reason.alias("rejection_reason"), F.coalesce("inside_frames", F.lit(0).cast("long")).alias("inside_frames"))
