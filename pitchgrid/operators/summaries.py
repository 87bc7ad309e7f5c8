"""Track, motion and event summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import distance
from pitchgrid.sources.detections import BALLS, is_in


def six(c):  # noqa: ANN001, ANN201
    return F.round(c, 6)


def track_gaps(df: DataFrame) -> DataFrame:
    """Frames missing inside each track."""
    seen = df.where("track_id is not null").select("match_id", "track_id", "class_name", "frame_index").distinct()
    step = F.col("frame_index") - F.lag("frame_index").over(Window.partitionBy("match_id", "class_name", "track_id").orderBy("frame_index"))
    return seen.withColumn("g", F.greatest(step - 1, F.lit(0))).groupBy("match_id", "class_name", "track_id").agg(F.coalesce(F.sum("g"), F.lit(0)).alias("gaps"), F.count(F.lit(1)).alias("frames"))


def match_summary(df: DataFrame) -> DataFrame:
    area = F.when(F.col("area") > 0, F.col("area"))
    base = df.groupBy("match_id").agg(
        F.countDistinct("frame_index").alias("frames"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.count(F.lit(1)).alias("detections"),
        six(F.avg(area)).alias("mean_area"), six(F.when(F.count(area) < 2, 0.0).otherwise(F.stddev_pop(area))).alias("std_area"),
    )
    tracks = track_gaps(df).groupBy("match_id").agg(F.count(F.lit(1)).alias("tracks"), six(F.avg("frames")).alias("mean_track_length"), F.sum("gaps").alias("gaps"))
    return base.join(tracks, "match_id", "left")


def class_summary(df: DataFrame, in_play: DataFrame) -> DataFrame:
    """Per class: size, tracks, score, coverage of its frame range, gaps; for balls also rows and frames in play."""
    base = df.groupBy("match_id", "class_name").agg(
        F.count(F.lit(1)).alias("detections"), F.countDistinct("track_id").alias("tracks"), six(F.avg("score") + 1e-9).alias("mean_score"), F.countDistinct("frame_index").alias("frames"),
        six(F.countDistinct("frame_index") / (F.max("frame_index") - F.min("frame_index") + 1)).alias("coverage"),
    )
    gaps = track_gaps(df).groupBy("match_id", "class_name").agg(F.sum("gaps").alias("gaps"))
    play = in_play.groupBy("match_id", "class_name").agg(F.count(F.lit(1)).alias("in_play_detections"), F.countDistinct("frame_index").alias("in_play_frames"))
    out = base.join(gaps, ["match_id", "class_name"], "left").join(play, ["match_id", "class_name"], "left")
    return out.fillna(0, ["gaps", "in_play_detections", "in_play_frames"])


def ball_steps(balls: DataFrame) -> DataFrame:
    """Distance and frames between the successive rows of each ball track."""
    w = Window.partitionBy("match_id", "track_id").orderBy("frame_index", "det_seq")
    rows = balls.where("track_id is not null").withColumns({"pf": F.lag("frame_index").over(w), "px": F.lag("cx").over(w), "py": F.lag("cy").over(w)})
    rows = rows.withColumn("df", F.col("frame_index") - F.col("pf")).where("df > 0")
    return rows.select("match_id", "track_id", "frame_index", "df", (distance(F.col("cx"), F.col("cy"), F.col("px"), F.col("py")) / F.col("df")).alias("speed"))


def speed_summary(df: DataFrame, in_play: DataFrame, fps: float = 30.0) -> DataFrame:
    """Ball speed per match for all rows (raw) and for balls in play."""
    both = ball_steps(df.where(is_in(BALLS))).withColumn("scope", F.lit("raw")).union(ball_steps(in_play).withColumn("scope", F.lit("in_play")))
    mean, top = F.avg("speed"), F.max("speed")
    return both.groupBy("match_id", "scope").agg(F.count(F.lit(1)).alias("samples"), six(mean).alias("mean_px_frame"), six(top).alias("max_px_frame"), F.round(mean * fps, 4).alias("mean_px_s"), F.round(top * fps, 4).alias("max_px_s"))


def team_coverage(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    rows = df.where(is_in(names))
    known = F.col("team").isNotNull() & (F.lower("team") != "unknown")
    return rows.groupBy("match_id").agg(F.count(F.lit(1)).alias("samples"), F.sum(known.cast("long")).alias("assigned"), six(F.avg(known.cast("double"))).alias("ratio"))


def event_summary(events: DataFrame) -> DataFrame:
    """Counts, first and last frame by match and event type."""
    return events.groupBy("match_id", "event_type").agg(F.count(F.lit(1)).alias("events"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"))


def scoreboard(events: DataFrame) -> DataFrame:
    """Goals of each match for blue and yellow, candidate and confirmed, with zeros."""
    n = lambda kind, team: F.sum(((F.col("event_type") == kind) & (F.col("scoring_team") == team)).cast("long"))
    return events.groupBy("match_id").agg(*[n(k, t).alias(f"{k}_{t}") for k in ("goal_candidate", "goal_confirmed") for t in ("blue", "yellow")])


def timeline(events: DataFrame, first: int = 25) -> DataFrame:
    w = Window.partitionBy("match_id").orderBy("frame_index", "event_id")
    return events.withColumn("place", F.row_number().over(w)).where(F.col("place") <= first)


def event_breakdown(events: DataFrame) -> DataFrame:
    """(match_id, measure, name, events): goals by side, rejects by reason, shots by team and by target side; what is not told is `unknown`."""
    told = lambda k: F.coalesce(F.nullif(F.regexp_extract("metadata", f'"{k}"\\s*:\\s*"([^"]*)"', 1), F.lit("")), F.lit("unknown"))
    row = lambda kind, measure, key: F.when(F.col("event_type") == kind, F.struct(F.lit(measure).alias("measure"), told(key).alias("name")))
    parts = F.array_compact(F.array(row("goal_candidate", "goals_by_side", "goal_side"), row("goal_rejected", "rejects_by_reason", "rejection_reason"), row("shot", "shots_by_team", "shooting_team"), row("shot", "shots_by_side", "target_side")))
    return events.select("match_id", F.explode(parts).alias("p")).groupBy("match_id", "p.measure", "p.name").agg(F.count(F.lit(1)).alias("events"))


def exact_percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float], bins: int = 4096) -> DataFrame:
    """Interpolated percentiles of a value in 0..1 per key, by name, without a buffer of all values: counts by bin tell in which
    bins the ranks lie, and only the values of those are ranked."""
    rows = df.select(key, F.col(value).alias("__v")).where("__v is not null").withColumn("__bin", F.least(F.floor(F.col("__v") * bins), F.lit(bins - 1)))
    counts = rows.groupBy(key, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(key)
    counts = counts.withColumns({"__upto": F.sum("__n").over(w.orderBy("__bin")), "__all": F.sum("__n").over(w)})
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.floor(p * (F.col("__all") - 1)).alias("rank"), (p * (F.col("__all") - 1)).alias("at")) for n, p in shares.items()])
    targets = counts.select(key, "__bin", (F.col("__upto") - F.col("__n")).alias("__before"), "__upto", F.explode(wanted).alias("t"))
    targets = targets.withColumn("r", F.explode(F.array(F.col("t.rank"), F.col("t.rank") + 1))).where((F.col("r") >= F.col("__before")) & (F.col("r") < F.col("__upto")))
    cells = rows.join(targets.select(key, "__bin").distinct(), [key, "__bin"], "left_semi").groupBy(key, "__bin", "__v").agg(F.count(F.lit(1)).alias("__m"))
    cells = cells.withColumn("__end", F.sum("__m").over(Window.partitionBy(key, "__bin").orderBy("__v")))
    hit = targets.join(cells, [key, "__bin"]).where((F.col("r") - F.col("__before") >= F.col("__end") - F.col("__m")) & (F.col("r") - F.col("__before") < F.col("__end")))
    low, high = F.max(F.when(F.col("r") == F.col("t.rank"), F.col("__v"))), F.max(F.when(F.col("r") == F.col("t.rank") + 1, F.col("__v")))
    one = hit.groupBy(key, "t.name").agg((low + (F.coalesce(high, low) - low) * F.max(F.col("t.at") - F.col("t.rank"))).alias("v"))
    return one.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in shares])
