"""Metres on the pitch: projection, zones, speeds, forecasts, heat."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import Pitch, distance, grid_cell, lane, phase, zone_name


def placed(df: DataFrame, pitch: Pitch, rows: int = 2, cols: int = 4, anchor: str = "centroid") -> DataFrame:
    """Adds field_x_m, field_y_m, inside_field, grid row and column, zone, phase and lane; points on the horizon go."""
    if anchor not in ("centroid", "bottom_center"):
        raise ValueError(f"unknown anchor {anchor}")
    x, y = pitch.project(F.col("cx"), F.col("cy") if anchor == "centroid" else F.col("y2"))
    out = df.withColumns({"field_x_m": F.round(x, 6), "field_y_m": F.round(y, 6)}).where("field_x_m is not null and field_y_m is not null")
    fx, fy = F.col("field_x_m"), F.col("field_y_m")
    out = out.withColumns({"inside_field": fx.between(0, pitch.length_m) & fy.between(0, pitch.width_m), "grid_row": grid_cell(fy, pitch.width_m, rows), "grid_col": grid_cell(fx, pitch.length_m, cols)})
    return out.withColumns({"zone": zone_name(F.col("grid_row"), F.col("grid_col")), "phase": phase(fx, pitch.length_m, F.col("team")), "lane": lane(fy, pitch.width_m)})


def zone_counts(path: DataFrame, fps: float = 30.0) -> DataFrame:
    return path.groupBy("match_id", "grid_row", "grid_col").agg(F.count(F.lit(1)).alias("samples")).withColumn("seconds", F.round(F.col("samples") / fps, 6))


def zero_filled(counts: DataFrame, rows: int, cols: int) -> DataFrame:
    """A row for every cell of every match."""
    cells = counts.select("match_id").distinct().withColumn("grid_row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long")))).withColumn("grid_col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))))
    return cells.join(counts, ["match_id", "grid_row", "grid_col"], "left").fillna(0)


def robot_grains(path: DataFrame) -> DataFrame:
    """Samples by team, team and zone, team and phase in one pass of grouping sets."""
    rows = path.withColumn("team", F.coalesce("team", F.lit("unknown")))
    sets = rows.groupingSets([[F.col("match_id"), F.col("team")], [F.col("match_id"), F.col("team"), F.col("zone")], [F.col("match_id"), F.col("team"), F.col("phase")]], "match_id", "team", "zone", "phase")
    return sets.agg(F.grouping_id().cast("long").alias("grain"), F.count(F.lit(1)).alias("samples"))


def zone_control(path: DataFrame) -> DataFrame:
    """Leader of each zone by samples inside the field (the team first seen among equals), margin and share."""
    rows = path.where(F.col("inside_field") & F.col("team").isNotNull())
    counts = rows.groupBy("match_id", "zone", "team").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("frame_index", "det_seq")).alias("first"))
    w = Window.partitionBy("match_id", "zone").orderBy(F.desc("n"), "first")
    ranked = counts.withColumns({"r": F.row_number().over(w), "next": F.coalesce(F.lead("n").over(w), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("match_id", "zone"))}).where("r = 1")
    return ranked.select("match_id", "zone", F.col("team").alias("leader"), F.col("total").alias("samples"), (F.col("n") - F.col("next")).alias("leader_margin"), F.round(F.col("n") / F.col("total"), 6).alias("leader_ratio"))


def metric_steps(path: DataFrame, order: list[str], fps: float = 30.0) -> DataFrame:
    """Metres and speed between the successive samples of each track (null tracks are one)."""
    w = Window.partitionBy("match_id", "track_id").orderBy(*order)
    rows = path.withColumns({"pf": F.lag("frame_index").over(w), "px": F.lag("field_x_m").over(w), "py": F.lag("field_y_m").over(w)}).where(F.col("frame_index") > F.col("pf"))
    d = distance(F.col("field_x_m"), F.col("field_y_m"), F.col("px"), F.col("py"))
    return rows.withColumn("metres", d).withColumn("speed", d * fps / (F.col("frame_index") - F.col("pf")))


def travelled(path: DataFrame, order: list[str], fps: float = 30.0) -> DataFrame:
    return metric_steps(path, order, fps).groupBy("match_id", "track_id").agg(F.round(F.sum("metres"), 4).alias("metres"), F.round(F.avg("speed"), 6).alias("mean_m_s"), F.round(F.max("speed"), 6).alias("max_m_s"), F.count(F.lit(1)).alias("steps"))


def goal_mouth(x: Column, y: Column, pitch: Pitch, width_m: float, depth_m: float) -> Column:
    across = F.abs(y - pitch.width_m / 2) <= width_m / 2
    return F.when(across & x.between(-depth_m, 0.0), "left").when(across & x.between(pitch.length_m, pitch.length_m + depth_m), "right")


def mouth_entries(path: DataFrame, pitch: Pitch, width_m: float, depth_m: float, order: list[str]) -> DataFrame:
    """Per track and side, how often a goal mouth is entered."""
    w = Window.partitionBy("match_id", "track_id").orderBy(*order)
    rows = path.withColumn("side", goal_mouth(F.col("field_x_m"), F.col("field_y_m"), pitch, width_m, depth_m))
    rows = rows.withColumns({"was": F.lag("side").over(w)}).where(F.col("side").isNotNull() & ~F.col("side").eqNullSafe(F.col("was")))
    return rows.groupBy("match_id", "track_id", "side").agg(F.count(F.lit(1)).alias("entries"))


def penalty_side(x: Column, y: Column, pitch: Pitch, depth_m: float, width_m: float) -> Column:
    across = F.abs(y - pitch.width_m / 2) <= width_m / 2
    return F.when(across & x.between(0.0, depth_m), "left").when(across & x.between(pitch.length_m - depth_m, pitch.length_m), "right")


def motion_fits(path: DataFrame, history: int = 18, least: int = 6, fps: float = 30.0) -> DataFrame:
    """Straight-line fit of each track over the last `history` frames of every sample: velocity per axis and RMSE.

    The sums run over a RANGE frame, so no fit looks at rows of another window."""
    one = path.groupBy("match_id", "track_id", "frame_index").agg(F.max_by(F.struct("field_x_m", "field_y_m"), "__order").alias("p"))
    rows = one.select("match_id", "track_id", "frame_index", "p.field_x_m", "p.field_y_m")
    w = Window.partitionBy("match_id", "track_id").orderBy("frame_index").rangeBetween(-history, 0)
    # Time relative to the window's last frame keeps the sums small.
    pts = F.collect_list(F.struct("frame_index", "field_x_m", "field_y_m")).over(w)
    rows = rows.withColumn("__p", pts).where(F.size("__p") >= least)
    n = F.size("__p").cast("double")
    fold = lambda f: F.aggregate("__p", F.lit(0.0), lambda acc, p: acc + f(p))
    t = lambda p: (p["frame_index"] - F.col("frame_index")) / fps
    rows = rows.withColumns({"__n": n, "__t": fold(t), "__tt": fold(lambda p: t(p) * t(p)), "__x": fold(lambda p: p["field_x_m"]), "__y": fold(lambda p: p["field_y_m"]), "__tx": fold(lambda p: t(p) * p["field_x_m"]), "__ty": fold(lambda p: t(p) * p["field_y_m"])})
    base = F.col("__n") * F.col("__tt") - F.col("__t") * F.col("__t")
    slope = lambda s, ts: F.when(base > 0, (F.col("__n") * F.col(ts) - F.col("__t") * F.col(s)) / base).otherwise(0.0)
    rows = rows.withColumns({"vx": slope("__x", "__tx"), "vy": slope("__y", "__ty")})
    ax, ay = (F.col("__x") - F.col("vx") * F.col("__t")) / F.col("__n"), (F.col("__y") - F.col("vy") * F.col("__t")) / F.col("__n")
    rows = rows.withColumns({"__ax": ax, "__ay": ay})
    err = fold(lambda p: F.pow(p["field_x_m"] - F.col("__ax") - F.col("vx") * t(p), 2) + F.pow(p["field_y_m"] - F.col("__ay") - F.col("vy") * t(p), 2))
    return rows.select("match_id", "track_id", "frame_index", "field_x_m", "field_y_m", F.col("__n").cast("long").alias("samples"), "vx", "vy", F.sqrt(err / F.col("__n")).alias("rmse"))


def forecasts(fits: DataFrame, pitch: Pitch, horizon: float = 1.5, step: float = 0.25, turn: float = 38.0) -> DataFrame:
    """Three branches (continue, turn_left, turn_right) of each fit with their share of probability and their end point.

    A branch turns at `turn` degrees a second; its weight falls with the fit's error and with leaving the field."""
    branches = F.array(*[F.struct(F.lit(name).alias("branch"), F.lit(sign).alias("sign")) for name, sign in (("continue", 0.0), ("turn_left", 1.0), ("turn_right", -1.0))])
    rows = fits.withColumn("b", F.explode(branches)).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(round(horizon / step)))))
    t = F.col("s") * step
    angle = F.col("b.sign") * math.radians(turn) * t
    # The chord of an arc points along the mean heading and is shorter than the path by sin(a)/a.
    half = angle / 2
    chord = t * F.when(half == 0, 1.0).otherwise(F.try_divide(F.sin(half), half))
    x = F.col("field_x_m") + chord * (F.col("vx") * F.cos(half) - F.col("vy") * F.sin(half))
    y = F.col("field_y_m") + chord * (F.col("vx") * F.sin(half) + F.col("vy") * F.cos(half))
    rows = rows.withColumns({"px": x, "py": y}).withColumn("inside", (F.col("px").between(0, pitch.length_m) & F.col("py").between(0, pitch.width_m)).cast("double"))
    key = ["match_id", "track_id", "frame_index"]
    out = rows.groupBy(*key, F.col("b.branch").alias("branch"), "rmse").agg(F.avg("inside").alias("inside"), F.max_by(F.struct("px", "py"), "s").alias("e"))
    straight = 0.48 + 0.32 * F.exp(-F.col("rmse") / 0.08)
    base = F.when(F.col("branch") == "continue", straight).otherwise((1 - straight) / 2)
    weight = base * F.greatest(F.lit(0.08), F.col("inside") * F.col("inside"))
    out = out.withColumn("w", weight).withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(*key)))
    clip = lambda c, top: F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(top)) + 1e-8, 4)  # noqa: E731  halves go up whatever their last bit says
    return out.select(*key, "branch", F.round(F.col("share") + 1e-8, 6).alias("probability"), clip(F.col("e.px"), pitch.length_m).alias("end_x_m"), clip(F.col("e.py"), pitch.width_m).alias("end_y_m"))


def best_snapshot(fits: DataFrame, every: int = 5, after: int = 18, top: int = 4) -> DataFrame:
    """The reference frame of each match whose tracks move most, every fifth frame from `after` frames on."""
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    first = fits.groupBy("match_id").agg(F.min("frame_index").alias("__a"))
    rows = fits.join(first, "match_id").where((F.col("frame_index") - F.col("__a") >= after) & ((F.col("frame_index") - F.col("__a")) % every == 0)).withColumn("v", speed)
    score = rows.groupBy("match_id", "frame_index").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    score = score.withColumn("score", F.round(F.col("s") * (0.8 + 0.2 * F.least(F.lit(1.0), F.col("n") / top)), 6))
    w = Window.partitionBy("match_id").orderBy(F.desc("score"), "frame_index")
    return score.withColumn("r", F.row_number().over(w)).where("r = 1").select("match_id", "frame_index", "score", F.col("n").alias("tracks"))


def heat_cells(df: DataFrame, cell: int = 16, radius: int = 28, decay: float = 0.997) -> DataFrame:
    """Cells covered by a disk around any sample, and their heat at the match's end: decay to the power of the frames since last covered."""
    n = radius // cell + 1
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-n, n + 1) for j in range(-n, n + 1)])
    rows = df.select("match_id", "frame_index", "cx", "cy", F.explode(offsets).alias("o"))
    rows = rows.withColumns({"cell_x": F.floor(F.col("cx") / cell) + F.col("o.i"), "cell_y": F.floor(F.col("cy") / cell) + F.col("o.j")})
    centre = lambda c: (F.col(c) + 0.5) * cell
    rows = rows.where(distance(centre("cell_x"), centre("cell_y"), F.col("cx"), F.col("cy")) <= radius)
    last = df.groupBy("match_id").agg(F.max("frame_index").alias("__last"))
    cells = rows.groupBy("match_id", "cell_x", "cell_y").agg(F.max("frame_index").alias("covered"))
    return cells.join(last, "match_id").select("match_id", "cell_x", "cell_y", "covered", F.round(F.pow(F.lit(decay), F.col("__last") - F.col("covered")), 6).alias("heat"))
