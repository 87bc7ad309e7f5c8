"""Run quality: issues, scores, claims, comparison, ranking; team and calibration quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import Pitch
from pitchgrid.session import checkpointed

#: Limits of the quality rules.
LIMITS = {
    "min_ball_coverage": 0.75, "fail_ball_coverage": 0.30, "min_field_coverage": 0.90, "fail_field_coverage": 0.50, "min_robot_coverage": 0.50,
    "max_ball_jump": 45.0, "fail_ball_jump": 120.0, "max_out_of_bounds": 0.05, "fail_out_of_bounds": 0.20,
    "max_unknown_team": 0.35, "fail_unknown_team": 0.75, "min_possession": 0.30, "min_path_samples": 10,
}
#: Labels that name no team.
UNKNOWN = ("", "none", "null", "unassigned", "unknown")


def issue_rows(summary: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """One row for each rule a run breaks: severity, code, value, threshold."""
    L = limits

    def row(severity: str, code: str, value: Column, limit: float) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), value.cast("double").alias("value"), F.lit(float(limit)).alias("threshold"))

    def low(code: str, c: str, warn: float, fail: float | None) -> Column:
        v = F.col(c)
        out = F.when(v < fail, row("error", code, v, fail)) if fail is not None else F
        return out.when(v < warn, row("warning", code, v, warn))

    def high(code: str, c: str, warn: float, fail: float) -> Column:
        v = F.col(c)
        return F.when(v > fail, row("error", code, v, fail)).when(v > warn, row("warning", code, v, warn))

    teams = F.col("team_samples") <= 0
    open_goals = F.greatest(F.lit(0), F.col("goal_candidates") - F.col("goals_confirmed"))
    rules = F.array_compact(F.array(
        low("low_ball_coverage", "ball_coverage", L["min_ball_coverage"], L["fail_ball_coverage"]), low("low_field_coverage", "field_coverage", L["min_field_coverage"], L["fail_field_coverage"]),
        low("low_robot_coverage", "robot_coverage", L["min_robot_coverage"], None), high("large_ball_jump", "max_ball_jump", L["max_ball_jump"], L["fail_ball_jump"]),
        high("ball_out_of_bounds", "out_of_bounds", L["max_out_of_bounds"], L["fail_out_of_bounds"]),
        F.when(F.col("penalty_samples") > 0, row("warning", "robot_penalty_area", F.col("penalty_samples"), 0)),
        F.when(teams, row("warning", "missing_team_evidence", F.lit(0), 1)).otherwise(high("unknown_robot_teams", "unknown_team", L["max_unknown_team"], L["fail_unknown_team"])),
        F.when(open_goals > 0, row("warning", "unconfirmed_goal_candidates", open_goals, 0)),
    ))
    return summary.select("run", F.explode(rules).alias("i")).select("run", "i.severity", "i.code", "i.value", "i.threshold")


def run_status(summary: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """fail / review / good and 100 less 25 an error and 10 a warning."""
    issues = issue_rows(summary, limits).groupBy("run").agg(F.sum((F.col("severity") == "error").cast("long")).alias("errors"), F.sum((F.col("severity") == "warning").cast("long")).alias("warnings"))
    rows = summary.select("run").join(issues, "run", "left").fillna(0, ["errors", "warnings"])
    status = F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "review").otherwise("good")
    return rows.withColumns({"status": status, "score": F.greatest(F.lit(0).cast("long"), 100 - 25 * F.col("errors") - 10 * F.col("warnings"))})


def claim_rows(summary: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Which of five claims a run can support."""
    L, c = limits, F.col
    ready = {
        "ball_tracking": (c("ball_coverage") >= L["min_ball_coverage"]) & (c("max_ball_jump") <= L["max_ball_jump"]),
        "metric_speed_trajectory": (c("path_samples") >= L["min_path_samples"]) & (c("out_of_bounds") <= L["max_out_of_bounds"]),
        "team_possession": (c("team_samples") > 0) & (c("team_assigned") > 0) & (c("unknown_team") <= L["max_unknown_team"]) & (c("possession") >= L["min_possession"]),
        "goal_scoring": c("goals_confirmed") > 0,
        "shot_pressure": c("shots") > 0,
    }
    items = F.array(*[F.struct(F.lit(k).alias("claim"), F.when(v, "ready").otherwise("review").alias("status")) for k, v in ready.items()])
    return summary.select("run", F.explode(items).alias("c")).select("run", "c.claim", "c.status")


#: The compared figures and which way is better.
DIRECTIONS = {"score": 1, "ball_coverage": 1, "field_coverage": 1, "robot_coverage": 1, "possession": 1, "unknown_team": -1, "max_ball_jump": -1, "out_of_bounds": -1, "path_samples": 1}


def long_figures(summary: DataFrame, names: list[str]) -> DataFrame:
    return summary.unpivot(["run"], [F.col(n).cast("double").alias(n) for n in names], "metric", "value")


def compared(baseline: DataFrame, candidate: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(run, metric, baseline, candidate, delta, outcome) over a full outer join."""
    names = list(DIRECTIONS)
    a, b = long_figures(baseline, names).withColumnRenamed("value", "baseline"), long_figures(candidate, names).withColumnRenamed("value", "candidate")
    rows = a.join(b, ["run", "metric"], "full_outer")
    way = F.when(F.col("metric").isin([k for k, v in DIRECTIONS.items() if v < 0]), -1).otherwise(1)
    gain = (F.col("candidate") - F.col("baseline")) * way
    outcome = F.when(gain.isNull(), "missing").when(gain > tolerance, "improved").when(gain < -tolerance, "regressed").otherwise("unchanged")
    return rows.select("run", "metric", F.round("baseline", 6).alias("baseline"), F.round("candidate", 6).alias("candidate"), F.round(F.col("candidate") - F.col("baseline"), 6).alias("delta"), outcome.alias("outcome"))


def claim_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Claims gained, lost and kept, by EXCEPT and INTERSECT of the ready ones."""
    a, b = (claim_rows(x).where("status = 'ready'").select("run", "claim") for x in (before, after))
    tag = lambda df, t: df.withColumn("change", F.lit(t))
    return tag(b.exceptAll(a), "gained").union(tag(a.exceptAll(b), "lost")).union(tag(a.intersect(b), "kept"))


def verdicts(before: DataFrame, after: DataFrame) -> DataFrame:
    """improved / regressed / mixed / unchanged of each run, by claims, score, then figures."""
    figures = compared(before, after).where("metric <> 'score'").groupBy("run").agg(F.sum((F.col("outcome") == "improved").cast("long")).alias("up"), F.sum((F.col("outcome") == "regressed").cast("long")).alias("down"))
    score = compared(before, after).where("metric = 'score'").select("run", F.col("delta").alias("score_delta"))
    claims = claim_changes(before, after).groupBy("run").agg(F.sum((F.col("change") == "gained").cast("long")).alias("gained"), F.sum((F.col("change") == "lost").cast("long")).alias("lost"))
    rows = figures.join(score, "run").join(claims, "run", "left").fillna(0, ["gained", "lost"])
    gained, lost, up, down, d = (F.col(c) for c in ("gained", "lost", "up", "down", "score_delta"))
    verdict = (
        F.when((lost > 0) | (d < 0), F.when(gained > 0, "mixed").otherwise("regressed"))
        .when((gained > 0) | (d > 0), F.when(down == 0, "improved").otherwise("mixed"))
        .when((up > 0) & (down > 0), "mixed").when(up > 0, "improved").when(down > 0, "regressed").otherwise("unchanged")
    )
    return rows.select("run", "up", "down", "gained", "lost", "score_delta", verdict.alias("verdict"))


def ranked_runs(status: DataFrame) -> DataFrame:
    """good before review before fail, then by score and name."""
    place = F.when(F.col("status") == "good", 0).when(F.col("status") == "review", 1).otherwise(2)
    return status.withColumn("place", F.row_number().over(Window.orderBy(place, F.desc("score"), "run"))).select("place", "run", "status", "score")


def known_team(c: str = "team") -> Column:
    t = F.lower(F.trim(F.col(c)))
    return F.when(t.isin(*UNKNOWN), F.lit(None)).otherwise(t)


def track_teams(robots: DataFrame, dominance: float = 0.75, least: int = 2) -> DataFrame:
    """Per track: samples, dominant team (alphabetical among equals), its share, ambiguity, resolved team."""
    rows = robots.where("track_id is not null").withColumn("__t", known_team())
    counts = rows.groupBy("match_id", "track_id", "__t").agg(F.count(F.lit(1)).alias("n"))
    key = ["match_id", "track_id"]
    total = counts.groupBy(*key).agg(F.sum("n").alias("samples"), F.sum(F.when(F.col("__t").isNotNull(), F.col("n")).otherwise(0)).alias("assigned"), F.count("__t").alias("teams"))
    top = counts.where("__t is not null").withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "__t"))).where("r = 1").select(*key, F.col("__t").alias("dominant_team"), F.col("n").alias("__top"))
    out = total.join(top, key, "left").withColumn("dominant_ratio", F.coalesce(F.round(F.try_divide(F.col("__top"), F.col("assigned")), 6), F.lit(0.0)))
    strong = F.col("dominant_team").isNotNull() & (F.col("dominant_ratio") >= dominance)
    ambiguous = (F.col("samples") >= least) & (F.col("teams") > 1) & (F.col("dominant_ratio") < dominance)
    return out.select(*key, "samples", "assigned", "dominant_team", "dominant_ratio", ambiguous.alias("ambiguous"), F.when(strong, F.col("dominant_team")).otherwise("unknown").alias("resolved_team"))


def team_changes(robots: DataFrame) -> DataFrame:
    """Changes of a track's team between its frames with a clear majority."""
    rows = robots.where("track_id is not null").withColumn("__t", known_team()).where("__t is not null")
    counts = rows.groupBy("match_id", "track_id", "frame_index", "__t").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("match_id", "track_id", "frame_index").orderBy(F.desc("n"), "__t")
    clear = counts.withColumns({"r": F.row_number().over(w), "second": F.lead("n").over(w)}).where("r = 1 and (second is null or second < n)")
    t = Window.partitionBy("match_id", "track_id").orderBy("frame_index")
    rows = clear.withColumns({"from_frame": F.lag("frame_index").over(t), "from_team": F.lag("__t").over(t)}).where(F.col("from_team").isNotNull() & (F.col("from_team") != F.col("__t")))
    return rows.select("match_id", "track_id", "from_frame", F.col("frame_index").alias("to_frame"), "from_team", F.col("__t").alias("to_team"))


def frame_team_coverage(robots: DataFrame, least: float = 0.8) -> DataFrame:
    ratio = F.avg(known_team().isNotNull().cast("double"))
    return robots.groupBy("match_id", "frame_index").agg(F.count(F.lit(1)).alias("samples"), F.round(ratio, 6).alias("coverage"), (ratio < least).alias("below"))


def _turns(points: list[tuple[float, float]]) -> tuple[list[float], list[float]]:
    """Length of each edge and cross product at each corner."""
    edges = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(points, points[1:] + points[:1])]
    return [math.hypot(*e) for e in edges], [p[0] * q[1] - p[1] * q[0] for p, q in zip(edges[-1:] + edges[:-1], edges)]


def _signed_area(points: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])) / 2


def _edges_cross(points: list[tuple[float, float]]) -> bool:
    """Whether two edges without a common corner meet."""

    def side(a, b, p) -> float:  # noqa: ANN001
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    n, edges = len(points), list(zip(points, points[1:] + points[:1]))
    apart = [(e, f) for i, e in enumerate(edges) for j, f in enumerate(edges) if j > i + 1 and not (i == 0 and j == n - 1)]
    return any(side(*e, f[0]) * side(*e, f[1]) <= 0 and side(*f, e[0]) * side(*f, e[1]) <= 0 for e, f in apart)


def calibration_quality(points: list[tuple[float, float]], field: list[tuple[float, float]], pitch: Pitch, width: int | None = None, height: int | None = None) -> dict:
    """Geometry of a calibration's image polygon (its first four points) and its issues; a dozen points, on the driver."""
    polygon, ground = points[:4], field[:4]
    length, turn = _turns(polygon)
    signed, ground_signed = _signed_area(polygon), _signed_area(ground)
    area, shortest = abs(signed), min(length)
    ratio = max(length) / shortest if shortest > 1e-9 else None
    sines = [abs(t) / (a * b) if a * b > 1e-12 else 0.0 for t, a, b in zip(turn, length[-1:] + length[:-1], length)]
    xs, ys = zip(*polygon)
    box = (max(xs) - min(xs)) * (max(ys) - min(ys))
    fill = area / box if box > 0 else 0.0
    convex = all(t > 1e-9 for t in turn) or all(t < -1e-9 for t in turn)
    way = lambda a: 0 if abs(a) <= 1e-9 else 1 if a > 0 else -1
    m, errors, lost = pitch.matrix, [], False
    for (x, y), (u, v) in zip(points, field):
        w = m[6] * x + m[7] * y + m[8]
        if not math.isfinite(w) or abs(w) < 1e-9:
            lost = True
            break
        errors.append(math.hypot((m[0] * x + m[1] * y + m[2]) / w - u, (m[3] * x + m[4] * y + m[5]) / w - v))
    worst = max(errors, default=0.0)
    coverage = area / (width * height) if width and height else None
    outside = sum(not (0 <= x <= width and 0 <= y <= height) for x, y in points) if width and height else 0

    def step(value: float | None, code: tuple[str, str], limits: tuple[float, float], low: bool) -> list[tuple[str, str]]:
        """The code of the error limit, else that of the warning."""
        if value is None:
            return []
        for severity, name, limit in zip(("error", "warning"), code, limits):
            if value < limit if low else value > limit:
                return [(severity, name)]
        return []

    error = lambda hit, code: [("error", code)] if hit else []
    issues = [
        *error(lost, "invalid_homography"), *error(area <= 1.0, "degenerate_polygon"), *error(shortest <= 1e-9, "zero_length_edge"), *error(not convex or _edges_cross(polygon), "invalid_corner_order"),
        *error(way(signed) == 0 or way(ground_signed) == 0 or way(signed) != way(ground_signed), "orientation_mismatch"),
        *step(coverage, ("insufficient_frame_coverage", "low_frame_coverage"), (0.01, 0.05), True), *step(ratio, ("extreme_edge_ratio", "high_edge_ratio"), (12.0, 6.0), False),
        *step(min(sines), ("near_collinear_corner", "shallow_corner_angle"), (0.02, 0.08), True), *step(fill, ("extreme_polygon_skew", "high_polygon_skew"), (0.05, 0.15), True),
        *([("warning", "high_reprojection_error")] if worst > 0.05 else []), *error(outside, "points_outside_frame"),
    ]
    status = "fail" if any(s == "error" for s, _ in issues) else "review" if issues else "good"
    return {"area_px": area, "convex": convex, "edge_ratio": ratio, "min_corner_sine": min(sines), "bbox_fill": fill, "coverage": coverage, "max_error_m": worst, "issues": issues, "status": status}


def two_means(vectors: DataFrame, key: str, vector: str, rounds: int = 50) -> DataFrame:
    """Two clusters of unit vectors: the smallest key and the vector farthest from it begin; means are summed in the JVM.

    Only the two centres ever reach the driver."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = checkpointed(vectors.select(key, norm.alias("__n"), F.col(vector).alias("__raw")).where("__n > 0").select(key, F.transform("__raw", lambda x: x.cast("double") / F.col("__n")).alias("__v")))

    def far(c: list[float]) -> Column:
        lit = F.array(*[F.lit(float(x)) for x in c])
        return F.sqrt(F.aggregate(F.zip_with("__v", lit, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))

    def mean(rows: DataFrame) -> dict[int, list[float]]:
        out: dict[int, list[float]] = {}
        for r in rows.groupBy("__c").agg(*[F.round(F.sum(F.get("__v", F.lit(i))), 9).alias(f"s{i}") for i in range(width)]).collect():
            s = [r[f"s{i}"] for i in range(width)]
            size = math.sqrt(sum(x * x for x in s)) or 1.0
            out[r["__c"]] = [x / size for x in s]
        return out

    first = unit.orderBy(key).first()
    if first is None:
        return unit.select(key, F.lit(0).alias("cluster"))
    a = list(first["__v"])
    width = len(a)
    b = list(unit.orderBy(F.desc(F.round(far(a), 9)), key).first()["__v"])
    seen = None
    for _ in range(rounds):
        rows = unit.withColumn("__c", (far(b) < far(a)).cast("int"))
        centres = mean(rows)
        now = (tuple(centres.get(0, a)), tuple(centres.get(1, b)))
        if now == seen:
            break
        seen, (a, b) = now, (list(now[0]), list(now[1]))
    return unit.select(key, (far(b) < far(a)).cast("int").alias("cluster"))
