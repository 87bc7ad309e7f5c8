"""Queries of the match operators over the detections table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.functions import geometry as G
from pitchgrid.operators import events as E
from pitchgrid.operators import field as M
from pitchgrid.operators import filters as L
from pitchgrid.operators import folds, gamestate, possession, summaries, tracking
from pitchgrid.operators.blocks import blocked_row_number, lagged
from pitchgrid.operators.quality import frame_team_coverage, team_changes, track_teams
from pitchgrid.session import table
from pitchgrid.sources.detections import BALL_HANDLERS, BALLS, DET, FIELD, GOALS, HUMANS, ROBOTS, detections, is_in, sql_in

WIDTH, HEIGHT = 1280, 720
CORNERS = [(100.0, 60.0), (1180.0, 60.0), (1260.0, 680.0), (20.0, 680.0)]
METRES = [(0.0, 0.0), (2.43, 0.0), (2.43, 1.82), (0.0, 1.82)]
PITCH = G.Pitch.fit(CORNERS, METRES, 2.43, 1.82)
LINE, WALL = ((200.0, 100.0), (200.0, 600.0)), ((120.0, 100.0), (120.0, 600.0))
STILL_FRAMES, STILL_PX = 6, 30.0
POLYGON = [(100.0, 60.0), (1180.0, 60.0), (1260.0, 680.0), (20.0, 680.0)]

QUERIES: dict = {}
ORACLES: dict = {}
_B, _R, _F, _G, _H, _HB = map(sql_in, (BALLS, ROBOTS, FIELD, GOALS, HUMANS, BALL_HANDLERS))
W = "WITH " + DET


def q(name: str, sql: str | None = None):  # noqa: ANN201
    """Registers a function of the detections (and the session) under a name, with its SQL."""

    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = lambda spark, sf_dir: f(detections(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return put


def dist(a: str, b: str) -> str:
    return f"sqrt(({a}cx - {b}cx) * ({a}cx - {b}cx) + ({a}cy - {b}cy) * ({a}cy - {b}cy))"


def area(p: str = "") -> str:
    return f"(greatest(0.0::DOUBLE, {p}x2 - {p}x1) * greatest(0.0::DOUBLE, {p}y2 - {p}y1))"


def inter(a: str, b: str) -> str:
    return f"(greatest(0.0::DOUBLE, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0.0::DOUBLE, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))"


def iou(a: str, b: str) -> str:
    return f"(CASE WHEN {inter(a, b)} <= 0 THEN 0.0::DOUBLE ELSE {inter(a, b)} / ({area(a)} + {area(b)} - {inter(a, b)}) END)"


SAME = "a.match_id = b.match_id AND a.frame_index = b.frame_index"
PLAY = f"""play AS (SELECT b.* FROM det b WHERE b.class_name IN {_B} AND EXISTS (SELECT 1 FROM det a WHERE {SAME} AND (
  (a.class_name IN {_F} AND b.cx BETWEEN a.x1 - 8 AND a.x2 + 8 AND b.cy BETWEEN a.y1 - 8 AND a.y2 + 8) OR (a.class_name IN {_R} AND {dist('a.', 'b.')} <= 90))))
"""
BEST = f"""bb AS (SELECT * FROM det WHERE class_name IN {_B} QUALIFY row_number() OVER (PARTITION BY match_id, frame_index ORDER BY score DESC, det_seq) = 1),
rd AS (SELECT b.match_id, b.frame_index, a.det_seq, a.track_id, a.object_id, a.team, b.cx AS bx, {dist('a.', 'b.')} AS distance FROM bb b JOIN det a ON {SAME} AND a.class_name IN {_R})
"""
OWN = f"""{BEST}, near AS (SELECT * FROM rd WHERE distance <= 90 QUALIFY row_number() OVER (PARTITION BY match_id, frame_index ORDER BY distance, det_seq) = 1),
own AS (SELECT f.match_id, f.frame_index, n.det_seq AS owner_seq, n.track_id AS owner_track, n.team AS owner_team, n.distance FROM (SELECT DISTINCT match_id, frame_index FROM det) f
  LEFT JOIN near n ON f.match_id = n.match_id AND f.frame_index = n.frame_index)
"""
BIG = f"""big AS (SELECT * FROM det WHERE class_name IN {_F} QUALIFY row_number() OVER (PARTITION BY match_id, frame_index ORDER BY {area()} DESC, det_seq) = 1)
"""

# Projections -----------------------------------------------------------------------------------


@q("PRJ01_box_measures", f"""{W} SELECT det_seq, cx, cy, round({area()}, 4) AS area_px,
  round(CASE WHEN x2 <= x1 OR y2 <= y1 THEN 'Infinity'::DOUBLE ELSE greatest((x2 - x1) / (y2 - y1), (y2 - y1) / (x2 - x1)) END, 6) AS aspect,
  round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS diagonal FROM det""")  # fmt: skip
def box_measures(d: DataFrame) -> DataFrame:
    b = G.Box.of()
    return d.select("det_seq", "cx", "cy", F.round(b.area, 4).alias("area_px"), F.round(b.aspect, 6).alias("aspect"), F.round(b.diagonal, 6).alias("diagonal"))


@q("PRJ03_pair_overlaps", f"""{W} SELECT a.det_seq AS seq_a, b.det_seq AS seq_b, round({iou('a.', 'b.')}, 6) AS iou, round({inter('a.', 'b.')} / least({area('a.')}, {area('b.')}), 6) AS containment,
  round({dist('a.', 'b.')}, 6) AS distance FROM det a JOIN det b ON {SAME} AND a.det_seq < b.det_seq WHERE a.class_name IN {_R} AND b.class_name IN {_R} AND {inter('a.', 'b.')} > 0""")  # fmt: skip
def pair_overlaps(d: DataFrame) -> DataFrame:
    a, b = G.Box.of("a_"), G.Box.of("b_")
    pairs = L.boxes(d, ROBOTS, "a_").join(L.boxes(d, ROBOTS, "b_"), L.FRAME).where((F.col("a_det_seq") < F.col("b_det_seq")) & (G.intersection(a, b) > 0))
    return pairs.select(F.col("a_det_seq").alias("seq_a"), F.col("b_det_seq").alias("seq_b"), F.round(G.iou(a, b), 6).alias("iou"), F.round(G.containment(a, b), 6).alias("containment"), F.round(G.distance(a.cx, a.cy, b.cx, b.cy), 6).alias("distance"))


@q("PRJ05_ball_overlap", f"""{W} SELECT a.det_seq AS ball_seq, b.det_seq AS robot_seq, round({inter('a.', 'b.')} / greatest({area('a.')}, 1.0::DOUBLE), 6) AS overlap FROM det a JOIN det b ON {SAME}
  WHERE a.class_name IN {_B} AND b.class_name IN {_R} AND {inter('a.', 'b.')} > 0""")  # fmt: skip
def ball_overlaps(d: DataFrame) -> DataFrame:
    a, b = G.Box.of("a_"), G.Box.of("b_")
    pairs = L.boxes(d, BALLS, "a_").join(L.boxes(d, ROBOTS, "b_"), L.FRAME).where(G.intersection(a, b) > 0)
    return pairs.select(F.col("a_det_seq").alias("ball_seq"), F.col("b_det_seq").alias("robot_seq"), F.round(G.ball_overlap(a, b), 6).alias("overlap"))


_RAY = " + ".join(
    f"(CASE WHEN ({ay}::DOUBLE > cy) <> ({by}::DOUBLE > cy) AND cx < {bx - ax}::DOUBLE * (cy - {ay}::DOUBLE) / {by - ay}::DOUBLE + {ax}::DOUBLE THEN 1 ELSE 0 END)"
    for (ax, ay), (bx, by) in zip(POLYGON, POLYGON[1:] + POLYGON[:1])
    if ay != by
)


@q("PRJ08_point_in_polygon", f"{W} SELECT det_seq, class_name FROM det WHERE class_name IN {_B} AND ({_RAY}) % 2 = 1")
def in_polygon(d: DataFrame) -> DataFrame:
    return d.where(is_in(BALLS) & G.point_in_polygon(F.col("cx"), F.col("cy"), POLYGON)).select("det_seq", "class_name")


@q("PRJ12_clip_expand", f"""{W}, c AS (SELECT det_seq, x1, y1, x2, y2, least(greatest(0.0::DOUBLE, floor(x1 - 4)), {WIDTH - 1}.0::DOUBLE) AS a, least(greatest(0.0::DOUBLE, floor(y1 - 4)), {HEIGHT - 1}.0::DOUBLE) AS b FROM det)
SELECT det_seq, a AS clip_x1, b AS clip_y1, greatest(a + 1, least({WIDTH}.0::DOUBLE, ceil(x2 + 4))) AS clip_x2, greatest(b + 1, least({HEIGHT}.0::DOUBLE, ceil(y2 + 4))) AS clip_y2,
  round(greatest(0.0::DOUBLE, x1 - 5), 6) AS exp_x1, round(greatest(0.0::DOUBLE, y1 - 10), 6) AS exp_y1, round(least({WIDTH}.0::DOUBLE, x2 + 5), 6) AS exp_x2, round(least({HEIGHT}.0::DOUBLE, y2 + 3), 6) AS exp_y2 FROM c""")  # fmt: skip
def clip_expand(d: DataFrame) -> DataFrame:
    c, e = G.clip_box(G.Box.of(), WIDTH, HEIGHT, 4), G.expand_box(G.Box.of(), 5, 10, 3, WIDTH, HEIGHT)
    return d.select("det_seq", *[getattr(c, k).alias(f"clip_{k}") for k in ("x1", "y1", "x2", "y2")], *[F.round(getattr(e, k), 6).alias(f"exp_{k}") for k in ("x1", "y1", "x2", "y2")])


@q("PRJ14_mirrored_goals", f"""{W}, {BIG} SELECT a.det_seq, round(CASE WHEN f.y2 - f.y1 > f.x2 - f.x1 THEN a.x1 ELSE f.x1 + f.x2 - a.x2 END, 6) AS mx1, round(CASE WHEN f.y2 - f.y1 > f.x2 - f.x1 THEN f.y1 + f.y2 - a.y2 ELSE a.y1 END, 6) AS my1,
  round(CASE WHEN f.y2 - f.y1 > f.x2 - f.x1 THEN a.x2 ELSE f.x1 + f.x2 - a.x1 END, 6) AS mx2, round(CASE WHEN f.y2 - f.y1 > f.x2 - f.x1 THEN f.y1 + f.y2 - a.y1 ELSE a.y2 END, 6) AS my2
  FROM det a JOIN big f ON a.match_id = f.match_id AND a.frame_index = f.frame_index WHERE a.class_name IN {_G}""")  # fmt: skip
def mirrored(d: DataFrame) -> DataFrame:
    m = G.mirror_box(G.Box.of(), G.Box.of("f_"))
    return d.where(is_in(GOALS)).join(L.largest_field(d), L.FRAME).select("det_seq", *[F.round(getattr(m, c), 6).alias(f"m{c}") for c in ("x1", "y1", "x2", "y2")])


_M = [f"({x!r})::DOUBLE" for x in PITCH.matrix]
_LEN, _WID = f"{PITCH.length_m}::DOUBLE", f"{PITCH.width_m}::DOUBLE"
PLACED = f"""pp AS (SELECT *, cx * {_M[6]} + cy * {_M[7]} + {_M[8]} AS w FROM det WHERE class_name IN {_R}),
pm AS (SELECT *, round((cx * {_M[0]} + cy * {_M[1]} + {_M[2]}) / w, 6) + 0.0::DOUBLE AS field_x_m, round((cx * {_M[3]} + cy * {_M[4]} + {_M[5]}) / w, 6) + 0.0::DOUBLE AS field_y_m FROM pp WHERE abs(w) >= 1e-9),
pz AS (SELECT *, field_x_m BETWEEN 0 AND {_LEN} AND field_y_m BETWEEN 0 AND {_WID} AS inside_field, least(greatest(trunc(field_y_m / {_WID} * 2)::BIGINT, 0), 1) AS grid_row, least(greatest(trunc(field_x_m / {_LEN} * 4)::BIGINT, 0), 3) AS grid_col FROM pm),
path AS (SELECT *, 'r' || (grid_row + 1) || 'c' || (grid_col + 1) AS zone, CASE WHEN field_x_m < {_LEN} / 3 THEN 0 WHEN field_x_m < 2 * {_LEN} / 3 THEN 1 ELSE 2 END AS third,
  CASE WHEN field_y_m < {_WID} / 3 THEN 'left' WHEN field_y_m < 2 * {_WID} / 3 THEN 'center' ELSE 'right' END AS lane FROM pz)
"""
_PHASE = "CASE (CASE WHEN team = 'blue' THEN 2 - third ELSE third END) WHEN 0 THEN 'defensive' WHEN 1 THEN 'middle' ELSE 'attacking' END"


def robot_path(d: DataFrame) -> DataFrame:
    return M.placed(d.where(is_in(ROBOTS)), PITCH)


@q("PRJ16_projected_robots", f"{W}, {PLACED} SELECT det_seq, field_x_m, field_y_m, inside_field, grid_row, grid_col, zone, {_PHASE} AS phase, lane FROM path")
def projected(d: DataFrame) -> DataFrame:
    return robot_path(d).select("det_seq", "field_x_m", "field_y_m", "inside_field", "grid_row", "grid_col", "zone", "phase", "lane")


_DX, _DY = LINE[1][0] - LINE[0][0], LINE[1][1] - LINE[0][1]


@q("PRJ21_line_position", f"""{W} SELECT det_seq, round(({_DX}::DOUBLE * (cy - {LINE[0][1]}::DOUBLE) - {_DY}::DOUBLE * (cx - {LINE[0][0]}::DOUBLE)) / {(_DX**2 + _DY**2) ** 0.5}::DOUBLE, 6) + 0.0::DOUBLE AS side,
  round(((cx - {LINE[0][0]}::DOUBLE) * {_DX}::DOUBLE + (cy - {LINE[0][1]}::DOUBLE) * {_DY}::DOUBLE) / {_DX**2 + _DY**2}::DOUBLE, 6) AS along FROM det WHERE class_name IN {_B}""")  # fmt: skip
def line_position(d: DataFrame) -> DataFrame:
    x, y = F.col("cx"), F.col("cy")
    return d.where(is_in(BALLS)).select("det_seq", (F.round(G.line_side(x, y, *LINE), 6) + 0.0).alias("side"), F.round(G.segment_ratio(x, y, *LINE), 6).alias("along"))


@q("PRJ23_frame_offset", f"{W} SELECT det_seq, frame_index + 150 AS frame_index, frame_index AS clip_frame_index FROM det")
def frame_offset(d: DataFrame) -> DataFrame:
    return d.select("det_seq", (F.col("frame_index") + 150).alias("frame_index"), F.col("frame_index").alias("clip_frame_index"))


@q("PRJ26_goal_sides", f"""{W} SELECT det_seq, CASE WHEN class_name LIKE '%blue%' THEN 'blue' WHEN class_name LIKE '%yellow%' THEN 'yellow' ELSE 'unknown' END AS side,
  CASE WHEN class_name LIKE '%blue%' THEN 'yellow' WHEN class_name LIKE '%yellow%' THEN 'blue' ELSE 'unknown' END AS scoring FROM det WHERE class_name IN {_G}""")  # fmt: skip
def goal_sides(d: DataFrame) -> DataFrame:
    side = E.goal_side(F.col("class_name"))
    return d.where(is_in(GOALS)).select("det_seq", side.alias("side"), E.scoring_team(side).alias("scoring"))


# Filters ---------------------------------------------------------------------------------------


@q("FLT01_edge_balls", f"{W} SELECT det_seq, class_name FROM det WHERE NOT (class_name IN {_B} AND (x1 <= 4 OR y1 <= 4 OR x2 >= {WIDTH - 4} OR y2 >= {HEIGHT - 4}))")
def edge_balls(d: DataFrame) -> DataFrame:
    return L.edge_balls_removed(d, WIDTH, HEIGHT).select("det_seq", "class_name")


_ART = f"""CASE WHEN class_name IN {_R} AND source = 'dark_robot' THEN CASE WHEN coalesce(area, 0) < 1500 THEN 'fallback_area' WHEN coalesce(area, 0) > 4000 THEN 'fallback_max_area'
  WHEN coalesce(extent, 0) > 0.72::DOUBLE THEN 'fallback_extent' WHEN greatest((x2 - x1) / (y2 - y1), (y2 - y1) / (x2 - x1)) > 1.75::DOUBLE THEN 'fallback_aspect' END END"""


def artifact():  # noqa: ANN201
    return L.artifact_reason(1500, 4000, 0.72, 1.75, F.col("source") == "dark_robot")


@q("FLT02_artifacts", f"{W} SELECT det_seq FROM det WHERE ({_ART}) IS NULL")
def artifacts(d: DataFrame) -> DataFrame:
    return d.where(artifact().isNull()).select("det_seq")


@q("FLT02_artifact_report", f"{W} SELECT match_id, coalesce({_ART}, 'kept') AS reason, count(*) AS detections FROM det GROUP BY 1, 2")
def artifact_report(d: DataFrame) -> DataFrame:
    return d.groupBy("match_id", F.coalesce(artifact(), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("detections"))


_IN = "b.cx BETWEEN a.x1 - {0} AND a.x2 + {0} AND b.cy BETWEEN a.y1 - {0} AND a.y2 + {0}"
CONTEXT = f"""ctx AS (SELECT b.det_seq, b.match_id, CASE WHEN (CASE WHEN coalesce(b.area, 0) > 0 THEN b.area ELSE {area('b.')} END) > 2200 THEN 'oversized'
  WHEN EXISTS (SELECT 1 FROM det a WHERE {SAME} AND a.class_name IN {_R} AND (({_IN.format(0)}) OR {inter('b.', 'a.')} / greatest({area('b.')}, 1.0::DOUBLE) >= 0.2::DOUBLE)) THEN 'robot_overlap'
  WHEN NOT EXISTS (SELECT 1 FROM det a WHERE {SAME} AND ((a.class_name IN {_F} AND {_IN.format(0)}) OR (a.class_name IN {_HB} AND {_IN.format(20)}))) THEN 'outside_context' END AS reason
  FROM det b WHERE b.class_name IN {_B})
"""


@q("FLT03_ball_context", f"{W}, {CONTEXT} SELECT det_seq, reason FROM ctx")
def ball_context(d: DataFrame) -> DataFrame:
    return L.ball_context_reason(d, max_area=2200.0).select("det_seq", "reason")


@q("FLT04_balls_in_play", f"{W}, {PLAY} SELECT det_seq FROM play")
def in_play(d: DataFrame) -> DataFrame:
    return L.balls_in_play(d).select("det_seq")


@q("FLT05_field_balls", f"{W} SELECT det_seq FROM det WHERE class_name IN {_B} AND (match_id IN (SELECT match_id FROM det WHERE class_name IN {_F}) OR ({_RAY}) % 2 = 1)")
def field_balls(d: DataFrame) -> DataFrame:
    return L.field_balls(d, G.point_in_polygon(F.col("cx"), F.col("cy"), POLYGON)).select("det_seq")


@q("FLT07_pseudo_labels", f"""{W} SELECT coalesce(CASE WHEN class_name NOT IN ('ball', 'robots') THEN 'class_filter' WHEN score < 0.6::DOUBLE THEN 'low_score'
  WHEN coalesce(area, {area()}) < 1 THEN 'small_area' WHEN mask_path IS NULL THEN 'missing_mask' END, 'kept') AS reason, class_name, count(*) AS detections FROM det GROUP BY 1, 2""")  # fmt: skip
def pseudo_labels(d: DataFrame) -> DataFrame:
    return d.groupBy(F.coalesce(L.pseudo_label_reason(("ball", "robots")), F.lit("kept")).alias("reason"), "class_name").agg(F.count(F.lit(1)).alias("detections"))


@q("FLT08_blobs_off_robots", f"{W} SELECT det_seq FROM det b WHERE class_name IN {_B} AND NOT EXISTS (SELECT 1 FROM det a WHERE {SAME} AND a.class_name IN {_R} AND {_IN.format(8)})")
def blobs(d: DataFrame) -> DataFrame:
    return L.blobs_off_robots(d).select("det_seq")


@q("FLT09_goals_on_field", f"""{W} SELECT det_seq FROM det b WHERE class_name IN {_G} AND EXISTS (SELECT 1 FROM det a WHERE {SAME} AND a.class_name IN {_F} AND (({_IN.format(30)})
  OR (b.cx BETWEEN a.x1 - 30 AND a.x2 + 30 AND b.y2 BETWEEN a.y1 - 30 AND a.y2 + 30) OR (b.x2 > a.x1 - 30 AND b.x1 < a.x2 + 30 AND b.y2 > a.y1 - 30 AND b.y1 < a.y2 + 30)))""")  # fmt: skip
def goals_gate(d: DataFrame) -> DataFrame:
    return L.goals_on_field(d, GOALS).select("det_seq")


_SUP = "CASE WHEN f.det_seq IS NOT NULL AND greatest((f.x2 - f.x1) / (f.y2 - f.y1), (f.y2 - f.y1) / (f.x2 - f.x1)) >= 1.2::DOUBLE THEN {0} END"
_EDGE = "greatest(0.0::DOUBLE, 1 - (CASE WHEN f.y2 - f.y1 > f.x2 - f.x1 THEN least(abs(a.cy - f.y1), abs(f.y2 - a.cy)) / (f.y2 - f.y1) ELSE least(abs(a.cx - f.x1), abs(f.x2 - a.cx)) / (f.x2 - f.x1) END) / 0.5::DOUBLE)"


@q("FLT10_goal_rank", f"""{W}, {BIG}, s AS (SELECT a.match_id, a.frame_index, a.class_name, a.det_seq, a.score, {_SUP.format(_EDGE)} AS support FROM det a LEFT JOIN big f ON a.match_id = f.match_id AND a.frame_index = f.frame_index WHERE a.class_name IN {_G})
SELECT match_id, frame_index, class_name, det_seq, round(CASE WHEN support IS NULL THEN score ELSE 0.65::DOUBLE * support + 0.35::DOUBLE * score END, 6) AS goal_rank FROM s WHERE support IS NULL OR support >= 0.15::DOUBLE
QUALIFY row_number() OVER (PARTITION BY match_id, frame_index, class_name ORDER BY round(CASE WHEN support IS NULL THEN score ELSE 0.65::DOUBLE * support + 0.35::DOUBLE * score END, 6) DESC, det_seq) = 1""")  # fmt: skip
def goal_rank(d: DataFrame) -> DataFrame:
    """One goal of each colour and frame: support by nearness to the field's end lines, where the field is long enough to tell."""
    f = G.Box.of("f_")
    tall = f.height > f.width
    near = F.when(tall, F.least(F.abs(F.col("cy") - f.y1), F.abs(f.y2 - F.col("cy"))) / f.height).otherwise(F.least(F.abs(F.col("cx") - f.x1), F.abs(f.x2 - F.col("cx"))) / f.width)
    rows = d.where(is_in(GOALS)).join(L.largest_field(d), L.FRAME, "left").withColumn("support", F.when(f.x1.isNotNull() & (f.aspect >= 1.2), F.greatest(F.lit(0.0), 1 - near / 0.5)))
    rows = rows.where(F.col("support").isNull() | (F.col("support") >= 0.15)).withColumn("goal_rank", F.round(F.when(F.col("support").isNull(), F.col("score")).otherwise(0.65 * F.col("support") + 0.35 * F.col("score")), 6))
    return L.best_per(rows, [*L.FRAME, "class_name"], [F.desc("goal_rank"), F.col("det_seq")]).select(*L.FRAME, "class_name", "det_seq", "goal_rank")


@q("FLT12_dataset_selection", f"""{W}, r AS (SELECT match_id, frame_index, class_name, det_seq FROM det WHERE class_name IN ('ball', 'robots') AND score >= 0.5::DOUBLE AND frame_index % 5 = 0
  QUALIFY row_number() OVER (PARTITION BY match_id, frame_index, class_name ORDER BY score DESC, det_seq) <= 8)
SELECT * FROM r QUALIFY dense_rank() OVER (PARTITION BY match_id ORDER BY frame_index) <= 20""")  # fmt: skip
def selection(d: DataFrame) -> DataFrame:
    return L.dataset_selection(d, ("ball", "robots"), 0.5, 5, 8, 20).select("match_id", "frame_index", "class_name", "det_seq")


@q("FLT14_vertical_gate", f"{W} SELECT det_seq FROM det WHERE class_name IN {_R} AND cy / {HEIGHT} BETWEEN 0.15::DOUBLE AND 0.85::DOUBLE")
def vertical(d: DataFrame) -> DataFrame:
    return L.vertical_gate(d.where(is_in(ROBOTS)), HEIGHT, 0.15, 0.85).select("det_seq")


# Joins, possession, events ---------------------------------------------------------------------


@q("JN01_possession", f"{W}, {OWN} SELECT match_id, frame_index, owner_seq, owner_track, owner_team, round(distance, 6) AS distance FROM own")
def owned(d: DataFrame) -> DataFrame:
    return possession.possession(d).withColumn("distance", F.round("distance", 6))


@q("JN02_collisions", f"{W} SELECT a.match_id, a.frame_index, a.det_seq AS seq_a, b.det_seq AS seq_b, a.track_id AS track_a, b.track_id AS track_b FROM det a JOIN det b ON {SAME} AND a.det_seq < b.det_seq WHERE a.class_name IN {_R} AND b.class_name IN {_R} AND {dist('a.', 'b.')} <= 55")
def collisions(d: DataFrame) -> DataFrame:
    return possession.collisions(d)


HITS = f"""bp AS (SELECT * FROM play QUALIFY row_number() OVER (PARTITION BY match_id, frame_index ORDER BY score DESC, det_seq) = 1),
hits AS (SELECT b.match_id, b.frame_index, b.det_seq AS ball_seq, a.det_seq AS goal_seq, CASE WHEN a.class_name LIKE '%blue%' THEN 'blue' WHEN a.class_name LIKE '%yellow%' THEN 'yellow' ELSE 'unknown' END AS goal_side,
  CASE WHEN b.track_id IS NULL OR b.track_id = 0 THEN -1 ELSE b.track_id END AS actor FROM bp b JOIN det a ON {SAME} AND a.class_name IN {_G}
  WHERE b.cx BETWEEN a.x1 - greatest(8.0::DOUBLE, (b.x2 - b.x1) * 0.5::DOUBLE) AND a.x2 + greatest(8.0::DOUBLE, (b.x2 - b.x1) * 0.5::DOUBLE) AND b.cy BETWEEN a.y1 - greatest(8.0::DOUBLE, (b.x2 - b.x1) * 0.5::DOUBLE) AND a.y2 + greatest(8.0::DOUBLE, (b.x2 - b.x1) * 0.5::DOUBLE))
"""


@q("JN03_goal_hits", f"{W}, {PLAY}, {HITS} SELECT *, CASE goal_side WHEN 'blue' THEN 'yellow' WHEN 'yellow' THEN 'blue' ELSE 'unknown' END AS scoring_team FROM hits")
def goal_hits(d: DataFrame) -> DataFrame:
    return E.goal_hits(d)


HUMAN = f"""human AS (SELECT DISTINCT b.match_id, b.frame_index FROM det b WHERE b.class_name IN {_H} AND (NOT EXISTS (SELECT 1 FROM det a WHERE {SAME} AND (a.class_name IN {_F} OR a.class_name IN {_B} OR a.class_name IN {_R}))
  OR EXISTS (SELECT 1 FROM det a WHERE {SAME} AND (a.class_name IN {_F} OR a.class_name IN {_B} OR a.class_name IN {_R}) AND b.x2 + 12 >= a.x1 AND a.x2 + 12 >= b.x1 AND b.y2 + 12 >= a.y1 AND a.y2 + 12 >= b.y1)))
"""


@q("JN05_human_frames", f"{W}, {HUMAN} SELECT * FROM human")
def humans(d: DataFrame) -> DataFrame:
    return gamestate.human_frames(d)


@q("JN07_previous_ball", f"""{W}, {BEST} SELECT b.match_id, b.frame_index, b.det_seq, a.frame_index AS previous_frame, a.det_seq AS previous_seq, round({dist('a.', 'b.')}, 6) AS moved_px
  FROM bb b JOIN det a ON a.match_id = b.match_id AND a.class_name IN {_B} AND a.frame_index BETWEEN b.frame_index - 8 AND b.frame_index - 1 AND (b.track_id IS NULL OR a.track_id = b.track_id)
  QUALIFY row_number() OVER (PARTITION BY b.match_id, b.frame_index ORDER BY a.frame_index DESC, a.score DESC, a.det_seq) = 1""")  # fmt: skip
def previous(d: DataFrame) -> DataFrame:
    return E.previous_balls(d)


@q("JN16_robot_distances", f"{W}, {BEST} SELECT match_id, frame_index, det_seq, round(distance, 6) AS distance, (row_number() OVER (PARTITION BY match_id, frame_index ORDER BY distance, det_seq))::INTEGER AS rank FROM rd")
def distances(d: DataFrame) -> DataFrame:
    return L.best_per(possession.robot_distances(d), L.FRAME, [F.col("distance"), F.col("det_seq")], 1 << 30).select(*L.FRAME, "det_seq", F.round("distance", 6).alias("distance"), "rank")


_CHANGES = f"""{W}, {OWN}, ch AS (SELECT *, lag(owner_seq) OVER w AS ls, lag(owner_track) OVER w AS lt, lag(owner_team) OVER w AS lm FROM own WHERE owner_seq IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY frame_index)),
pi AS (SELECT match_id, frame_index, CASE WHEN coalesce(owner_team, 'unknown') = coalesce(lm, 'unknown') THEN 'pass' ELSE 'interception' END AS event_type,
  CASE WHEN coalesce(owner_team, 'unknown') = coalesce(lm, 'unknown') THEN 0.65::DOUBLE ELSE 0.7::DOUBLE END AS confidence,
  CASE WHEN lt IS NULL OR lt = 0 THEN -1 ELSE lt END AS from_track, CASE WHEN owner_track IS NULL OR owner_track = 0 THEN -1 ELSE owner_track END AS to_track
  FROM ch WHERE ls IS NOT NULL AND owner_track IS DISTINCT FROM lt)
"""


@q("WIN01_passes", _CHANGES + "SELECT * FROM pi")
def passes(d: DataFrame) -> DataFrame:
    return possession.owner_changes(possession.possession(d))


@q("WIN02_shots", f"""{W}, {PLAY}, {OWN}, bp AS (SELECT * FROM play QUALIFY row_number() OVER (PARTITION BY match_id, frame_index ORDER BY score DESC, det_seq) = 1),
st AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM bp WINDOW w AS (PARTITION BY match_id ORDER BY frame_index)),
sh AS (SELECT *, CASE WHEN cx <= {WIDTH * 0.08}::DOUBLE AND cx - px < 0 THEN 'left' WHEN cx >= {WIDTH - WIDTH * 0.08}::DOUBLE AND cx - px > 0 THEN 'right' END AS target_side, sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) AS speed FROM st WHERE px IS NOT NULL)
SELECT s.match_id, s.frame_index, s.target_side, CASE s.target_side WHEN 'left' THEN 'blue' ELSE 'yellow' END AS shooting_team, round(s.speed, 6) AS speed_px_frame,
  CASE WHEN o.owner_seq IS NULL THEN -1 ELSE o.owner_track END AS actor FROM sh s LEFT JOIN (SELECT * FROM own WHERE owner_seq IS NOT NULL) o ON o.match_id = s.match_id AND o.frame_index <= s.frame_index
WHERE s.target_side IS NOT NULL AND s.speed > 8 QUALIFY row_number() OVER (PARTITION BY s.match_id, s.frame_index ORDER BY o.frame_index DESC NULLS LAST) = 1""")  # fmt: skip
def shots(d: DataFrame) -> DataFrame:
    return E.shots(d, WIDTH)


@q("WIN03_streaks", f"""{W}, {OWN}, i AS (SELECT *, frame_index - row_number() OVER (PARTITION BY match_id, owner_track ORDER BY frame_index) AS g FROM own WHERE owner_track IS NOT NULL),
r AS (SELECT match_id, owner_track, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS frames FROM i GROUP BY match_id, owner_track, g)
SELECT *, (row_number() OVER (PARTITION BY match_id ORDER BY frames DESC, start_frame, owner_track))::INTEGER AS rank FROM r QUALIFY rank <= 20""")  # fmt: skip
def streaks(d: DataFrame) -> DataFrame:
    return possession.streaks(possession.possession(d))


@q("AGG05_possession_by_team", f"""{W}, {OWN}, t AS (SELECT match_id, coalesce(owner_team, 'unknown') AS team, count(*) AS frames FROM own WHERE owner_seq IS NOT NULL GROUP BY 1, 2)
SELECT match_id, team, frames, round(frames / 30.0::DOUBLE, 6) AS seconds, round(frames / sum(frames) OVER (PARTITION BY match_id), 6) AS ratio FROM t""")  # fmt: skip
def by_team(d: DataFrame) -> DataFrame:
    return possession.by_team(possession.possession(d))


@q("AGG06_dominance", f"""{W}, {OWN}, t AS (SELECT match_id, coalesce(owner_team, 'unknown') AS team, count(*) AS n FROM own WHERE owner_seq IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(n) OVER w, 0) AS nx, sum(n) OVER (PARTITION BY match_id) AS total FROM t WINDOW w AS (PARTITION BY match_id ORDER BY n DESC, team))
SELECT match_id, team, n AS frames, round(n / total, 6) AS ratio, round((n - nx) / total, 6) AS margin FROM r WHERE r = 1""")  # fmt: skip
def dominance(d: DataFrame) -> DataFrame:
    return possession.dominance(possession.possession(d))


# Summaries -------------------------------------------------------------------------------------

GAPS = """seen AS (SELECT DISTINCT match_id, track_id, class_name, frame_index FROM det WHERE track_id IS NOT NULL),
gp AS (SELECT *, greatest(frame_index - lag(frame_index) OVER (PARTITION BY match_id, class_name, track_id ORDER BY frame_index) - 1, 0) AS g FROM seen),
tg AS (SELECT match_id, class_name, track_id, coalesce(sum(g), 0)::BIGINT AS gaps, count(*) AS frames FROM gp GROUP BY 1, 2, 3)
"""


@q("AGG01_match_summary", f"""{W}, {GAPS}, m AS (SELECT match_id, count(DISTINCT frame_index) AS frames, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) AS detections,
  round(avg(CASE WHEN area > 0 THEN area END), 6) AS mean_area, round(CASE WHEN count(CASE WHEN area > 0 THEN area END) < 2 THEN 0 ELSE stddev_pop(CASE WHEN area > 0 THEN area END) END, 6) AS std_area FROM det GROUP BY 1)
SELECT m.*, t.tracks, t.mean_track_length, t.gaps FROM m LEFT JOIN (SELECT match_id, count(*) AS tracks, round(avg(frames), 6) AS mean_track_length, sum(gaps)::BIGINT AS gaps FROM tg GROUP BY 1) t USING (match_id)""")  # fmt: skip
def match_summary(d: DataFrame) -> DataFrame:
    return summaries.match_summary(d)


@q("AGG02_class_summary", f"""{W}, {GAPS}, {PLAY}, c AS (SELECT match_id, class_name, count(*) AS detections, count(DISTINCT track_id) AS tracks, round(avg(score) + 1e-9::DOUBLE, 6) AS mean_score, count(DISTINCT frame_index) AS frames,
  round(count(DISTINCT frame_index) / (max(frame_index) - min(frame_index) + 1), 6) AS coverage FROM det GROUP BY 1, 2)
SELECT c.*, coalesce(g.gaps, 0) AS gaps, coalesce(p.n, 0) AS in_play_detections, coalesce(p.f, 0) AS in_play_frames FROM c LEFT JOIN (SELECT match_id, class_name, sum(gaps)::BIGINT AS gaps FROM tg GROUP BY 1, 2) g USING (match_id, class_name)
LEFT JOIN (SELECT match_id, class_name, count(*) AS n, count(DISTINCT frame_index) AS f FROM play GROUP BY 1, 2) p USING (match_id, class_name)""")  # fmt: skip
def class_summary(d: DataFrame) -> DataFrame:
    return summaries.class_summary(d, L.balls_in_play(d))


@q("AGG03_track_gaps", f"{W}, {GAPS} SELECT * FROM tg")
def gaps(d: DataFrame) -> DataFrame:
    return summaries.track_gaps(d)


_STEP = "SELECT *, lag(frame_index) OVER w AS pf, lag(cx) OVER w AS px, lag(cy) OVER w AS py, '{1}' AS scope FROM {0} WHERE track_id IS NOT NULL WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_index, det_seq)"


@q("AGG04_ball_speed", f"""{W}, {PLAY}, balls AS (SELECT * FROM det WHERE class_name IN {_B}), s AS (SELECT match_id, scope, frame_index - pf AS df, sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) / (frame_index - pf) AS speed
  FROM ({_STEP.format('balls', 'raw')} UNION ALL {_STEP.format('play', 'in_play')}) WHERE frame_index - pf > 0)
SELECT match_id, scope, count(*) AS samples, round(avg(speed), 6) AS mean_px_frame, round(max(speed), 6) AS max_px_frame, round(avg(speed) * 30, 4) AS mean_px_s, round(max(speed) * 30, 4) AS max_px_s FROM s GROUP BY 1, 2""")  # fmt: skip
def ball_speed(d: DataFrame) -> DataFrame:
    return summaries.speed_summary(d, L.balls_in_play(d))


@q("AGG07_team_coverage", f"""{W} SELECT match_id, count(*) AS samples, sum(CASE WHEN team IS NOT NULL AND lower(team) <> 'unknown' THEN 1 ELSE 0 END)::BIGINT AS assigned,
  round(avg(CASE WHEN team IS NOT NULL AND lower(team) <> 'unknown' THEN 1.0::DOUBLE ELSE 0 END), 6) AS ratio FROM det WHERE class_name IN {_R} GROUP BY 1""")  # fmt: skip
def team_coverage(d: DataFrame) -> DataFrame:
    return summaries.team_coverage(d, ROBOTS)


_KNOWN = "CASE WHEN lower(trim(team)) IN ('', 'none', 'null', 'unassigned', 'unknown') THEN NULL ELSE lower(trim(team)) END"
_TQ = f"""rt AS (SELECT *, {_KNOWN} AS t FROM det WHERE class_name IN {_R})
"""


@q("AGG16_track_teams", f"""{W}, {_TQ}, c AS (SELECT match_id, track_id, t, count(*) AS n FROM rt WHERE track_id IS NOT NULL GROUP BY 1, 2, 3),
a AS (SELECT match_id, track_id, sum(n)::BIGINT AS samples, sum(CASE WHEN t IS NOT NULL THEN n ELSE 0 END)::BIGINT AS assigned, count(t) AS teams FROM c GROUP BY 1, 2),
top AS (SELECT * FROM c WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY match_id, track_id ORDER BY n DESC, t) = 1),
o AS (SELECT a.*, top.t AS dominant_team, coalesce(round(top.n / nullif(assigned, 0), 6), 0.0::DOUBLE) AS dominant_ratio FROM a LEFT JOIN top USING (match_id, track_id))
SELECT match_id, track_id, samples, assigned, dominant_team, dominant_ratio, samples >= 2 AND teams > 1 AND dominant_ratio < 0.75::DOUBLE AS ambiguous,
  CASE WHEN dominant_team IS NOT NULL AND dominant_ratio >= 0.75::DOUBLE THEN dominant_team ELSE 'unknown' END AS resolved_team FROM o""")  # fmt: skip
def track_quality(d: DataFrame) -> DataFrame:
    return track_teams(d.where(is_in(ROBOTS)))


@q("AGG16_frame_coverage", f"""{W}, {_TQ} SELECT match_id, frame_index, count(*) AS samples, round(avg(CASE WHEN t IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) AS coverage, avg(CASE WHEN t IS NULL THEN 0.0::DOUBLE ELSE 1 END) < 0.8::DOUBLE AS below FROM rt GROUP BY 1, 2""")
def frame_coverage(d: DataFrame) -> DataFrame:
    return frame_team_coverage(d.where(is_in(ROBOTS)))


@q("WIN08_team_changes", f"""{W}, {_TQ}, c AS (SELECT match_id, track_id, frame_index, t, count(*) AS n FROM rt WHERE track_id IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2, 3, 4),
m AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS n2 FROM c WINDOW w AS (PARTITION BY match_id, track_id, frame_index ORDER BY n DESC, t)),
z AS (SELECT *, lag(frame_index) OVER w AS from_frame, lag(t) OVER w AS from_team FROM m WHERE r = 1 AND (n2 IS NULL OR n2 < n) WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_index))
SELECT match_id, track_id, from_frame, frame_index AS to_frame, from_team, t AS to_team FROM z WHERE from_team IS NOT NULL AND from_team <> t""")  # fmt: skip
def changes(d: DataFrame) -> DataFrame:
    return team_changes(d.where(is_in(ROBOTS)))


@q("AGG23_track_vote", f"""{W}, c AS (SELECT match_id, track_id, team, count(*) AS n, min((frame_index, det_seq)) AS f FROM det WHERE class_name IN {_R} AND track_id IS NOT NULL AND team IS NOT NULL GROUP BY 1, 2, 3)
SELECT match_id, track_id, team, n AS votes FROM c QUALIFY row_number() OVER (PARTITION BY match_id, track_id ORDER BY n DESC, f) = 1""")  # fmt: skip
def track_vote(d: DataFrame) -> DataFrame:
    """The team most samples of a track name, the first seen among equals."""
    c = d.where(is_in(ROBOTS)).where("track_id is not null and team is not null").groupBy("match_id", "track_id", "team").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("frame_index", "det_seq")).alias("f"))
    return L.best_per(c, ["match_id", "track_id"], [F.desc("votes"), F.col("f")]).select("match_id", "track_id", "team", "votes")


@q("AGG24_marker_median", f"""{W} SELECT match_id, track_id, round(quantile_cont(score, 0.5), 6) AS median_score, CASE WHEN quantile_cont(score, 0.5) >= 0.6::DOUBLE THEN 'marked' ELSE 'plain' END AS label FROM det WHERE class_name IN {_R} AND track_id IS NOT NULL GROUP BY 1, 2""")
def marker_median(d: DataFrame) -> DataFrame:
    m = F.percentile("score", 0.5)
    return d.where(is_in(ROBOTS) & F.col("track_id").isNotNull()).groupBy("match_id", "track_id").agg(F.round(m, 6).alias("median_score"), F.when(m >= 0.6, "marked").otherwise("plain").alias("label"))


@q("AGG26_colour_range", f"{W} SELECT class_name, round(quantile_cont(score, 0.08), 6) AS low, round(quantile_cont(score, 0.92), 6) AS high FROM det WHERE class_name IN {_G} GROUP BY 1")
def colour_range(d: DataFrame) -> DataFrame:
    """The 8th and 92nd percentiles that bound a learned range."""
    return summaries.exact_percentiles(d.where(is_in(GOALS)), "class_name", "score", {"low": 0.08, "high": 0.92}).select("class_name", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


# Situations ------------------------------------------------------------------------------------

_CL = "least(greatest({0}, 0.0::DOUBLE), 1.0::DOUBLE)"


@q("SIT02_situations", f"""{W}, {BEST}, {BIG}, o AS (SELECT *, row_number() OVER w AS r, nth_value(distance, 1) OVER ww AS d1, nth_value(distance, 2) OVER ww AS d2, nth_value(track_id, 1) OVER ww AS t1, nth_value(team, 1) OVER ww AS m1 FROM rd
  WINDOW w AS (PARTITION BY match_id, frame_index ORDER BY distance, coalesce(track_id, 1000000000), coalesce(object_id, 'None'), det_seq), ww AS (PARTITION BY match_id, frame_index ORDER BY distance, coalesce(track_id, 1000000000), coalesce(object_id, 'None'), det_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
s AS (SELECT *, CASE WHEN d2 <= 112 AND d2 - d1 <= 22 THEN 'disputed' WHEN d1 <= 90 THEN 'controlled' ELSE 'free' END AS state FROM o),
c AS (SELECT *, CASE WHEN state = 'controlled' THEN t1 END AS owner_track, CASE WHEN state = 'controlled' THEN m1 END AS owner_team FROM s),
f AS (SELECT match_id, frame_index, min(d1) AS d1, min(d2) AS d2, min(state) AS state, min(owner_track) AS owner_track, min(owner_team) AS owner_team,
  min(CASE WHEN track_id IS DISTINCT FROM owner_track AND (owner_team IS NULL OR team = owner_team) THEN distance END) AS mate FROM c GROUP BY 1, 2),
g AS (SELECT bb.match_id, bb.frame_index, coalesce(f.state, 'free') AS state, f.owner_track, f.owner_team, f.d1, f.d2, CASE WHEN f.mate IS NULL THEN 0.0::DOUBLE ELSE {_CL.format('1 - f.mate / 240.0::DOUBLE')} END AS t,
  {_CL.format("1 - least(abs(bb.cx - coalesce(big.x1, 0.0::DOUBLE)), abs(coalesce(big.x2, 1280.0::DOUBLE) - bb.cx)) / greatest(0.25::DOUBLE * greatest(coalesce(big.x2, 1280.0::DOUBLE) - coalesce(big.x1, 0.0::DOUBLE), 1.0::DOUBLE), 1.0::DOUBLE)")} AS g
  FROM bb LEFT JOIN f ON bb.match_id = f.match_id AND bb.frame_index = f.frame_index LEFT JOIN big ON bb.match_id = big.match_id AND bb.frame_index = big.frame_index),
l AS (SELECT *, CASE state WHEN 'disputed' THEN 0.9::DOUBLE WHEN 'controlled' THEN round(1e-9::DOUBLE + {_CL.format("0.12::DOUBLE + 0.42::DOUBLE * " + _CL.format("d1 / 90.0::DOUBLE") + " + 0.46::DOUBLE * (CASE WHEN d2 IS NULL THEN 0.0::DOUBLE ELSE 1 - " + _CL.format("(d2 - d1) / 66.0::DOUBLE") + " END)")}, 6) ELSE 0.0::DOUBLE END AS loss FROM g),
p AS (SELECT *, CASE state WHEN 'controlled' THEN {_CL.format("0.18::DOUBLE + 0.32::DOUBLE * t + 0.34::DOUBLE * loss")} WHEN 'disputed' THEN {_CL.format("0.18::DOUBLE + 0.18::DOUBLE * t")} ELSE {_CL.format("0.04::DOUBLE + 0.08::DOUBLE * t")} END AS pp,
  CASE state WHEN 'controlled' THEN {_CL.format("0.08::DOUBLE + 0.52::DOUBLE * g + 0.08::DOUBLE * (1 - loss)")} WHEN 'disputed' THEN {_CL.format("0.05::DOUBLE + 0.28::DOUBLE * g")} ELSE {_CL.format("0.03::DOUBLE + 0.12::DOUBLE * g")} END AS sp FROM l)
SELECT match_id, frame_index, state, owner_track, owner_team, round(loss + 1e-9::DOUBLE, 6) AS loss_risk, round(pp + 1e-9::DOUBLE, 6) AS pass_p, round(sp + 1e-9::DOUBLE, 6) AS shot_p,
  round(1e-9::DOUBLE + CASE state WHEN 'controlled' THEN {_CL.format("0.86::DOUBLE - 0.52::DOUBLE * loss - 0.14::DOUBLE * pp - 0.18::DOUBLE * sp")} WHEN 'disputed' THEN 0.2::DOUBLE ELSE 0.08::DOUBLE END, 6) AS hold_p FROM p""")  # fmt: skip
def situations(d: DataFrame) -> DataFrame:
    return possession.situations(d, WIDTH)


@q("AGG09_situation_summary")
def situation_summary(d: DataFrame) -> DataFrame:
    s = possession.situations(d, WIDTH)
    return s.groupBy("match_id", "state").agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("loss_risk"), 4).alias("mean_loss"), F.round(F.avg("pass_p"), 4).alias("mean_pass"), F.round(F.avg("shot_p"), 4).alias("mean_shot"))


ORACLES["AGG09_situation_summary"] = f"SELECT match_id, state, count(*) AS frames, round(avg(loss_risk), 4) AS mean_loss, round(avg(pass_p), 4) AS mean_pass, round(avg(shot_p), 4) AS mean_shot FROM ({ORACLES['SIT02_situations']}) GROUP BY 1, 2"


@q("SIT06_shot_pressure", f"""{W}, {BEST}, {BIG}, v AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(frame_index) OVER w AS pf FROM bb WINDOW w AS (PARTITION BY match_id ORDER BY frame_index))
SELECT v.match_id, v.frame_index, round(0.15::DOUBLE + 0.45::DOUBLE * {_CL.format("1 - least(abs(v.cx - coalesce(big.x1, 0.0::DOUBLE)), abs(coalesce(big.x2, 1280.0::DOUBLE) - v.cx)) / greatest(0.25::DOUBLE * (coalesce(big.x2, 1280.0::DOUBLE) - coalesce(big.x1, 0.0::DOUBLE)), 1.0::DOUBLE)")}
  + 0.4::DOUBLE * least(1.0::DOUBLE, sqrt((v.cx - px) * (v.cx - px) + (v.cy - py) * (v.cy - py)) / (v.frame_index - pf) / 35.0::DOUBLE), 6) AS pressure
FROM v LEFT JOIN big ON v.match_id = big.match_id AND v.frame_index = big.frame_index WHERE pf IS NOT NULL""")  # fmt: skip
def shot_pressure(d: DataFrame) -> DataFrame:
    b = lagged(possession.best_ball(d), ["match_id"], "frame_index", {"px": "cx", "py": "cy", "pf": "frame_index"}).where("pf is not null").join(L.largest_field(d), L.FRAME, "left")
    left, right = F.coalesce("f_x1", F.lit(0.0)), F.coalesce("f_x2", F.lit(float(WIDTH)))
    near = possession.clamp(1 - F.least(F.abs(F.col("cx") - left), F.abs(right - F.col("cx"))) / F.greatest(0.25 * (right - left), F.lit(1.0)))
    v = G.distance(F.col("cx"), F.col("cy"), F.col("px"), F.col("py")) / (F.col("frame_index") - F.col("pf"))
    return b.select(*L.FRAME, F.round(0.15 + 0.45 * near + 0.4 * F.least(F.lit(1.0), v / 35.0), 6).alias("pressure"))


# Field -----------------------------------------------------------------------------------------


@q("AGG10_zone_grid", f"""{W}, {PLACED}, c AS (SELECT match_id, grid_row, grid_col, count(*) AS n FROM path GROUP BY 1, 2, 3)
SELECT m.match_id, r.range AS grid_row, k.range AS grid_col, coalesce(n, 0) AS samples, coalesce(round(n / 30.0::DOUBLE, 6), 0.0::DOUBLE) AS seconds FROM (SELECT DISTINCT match_id FROM c) m, range(2) r, range(4) k LEFT JOIN c ON c.match_id = m.match_id AND c.grid_row = r.range AND c.grid_col = k.range""")  # fmt: skip
def zone_grid(d: DataFrame) -> DataFrame:
    return M.zero_filled(M.zone_counts(robot_path(d)), 2, 4)


@q("AGG11_robot_grains", f"""{W}, {PLACED}, t AS (SELECT match_id, coalesce(team, 'unknown') AS team, zone, {_PHASE} AS phase FROM path)
SELECT match_id, team, zone, phase, grouping(match_id, team, zone, phase)::BIGINT AS grain, count(*) AS samples FROM t GROUP BY GROUPING SETS ((match_id, team), (match_id, team, zone), (match_id, team, phase))""")  # fmt: skip
def robot_grains(d: DataFrame) -> DataFrame:
    return M.robot_grains(robot_path(d))


@q("AGG12_zone_control", f"""{W}, {PLACED}, c AS (SELECT match_id, zone, team, count(*) AS n, min((frame_index, det_seq)) AS f FROM path WHERE inside_field AND team IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(n) OVER w, 0) AS nx, sum(n) OVER (PARTITION BY match_id, zone) AS total FROM c WINDOW w AS (PARTITION BY match_id, zone ORDER BY n DESC, f))
SELECT match_id, zone, team AS leader, total::BIGINT AS samples, n - nx AS leader_margin, round(n / total, 6) AS leader_ratio FROM r WHERE r = 1""")  # fmt: skip
def zone_control(d: DataFrame) -> DataFrame:
    return M.zone_control(robot_path(d))


_MS = """ms AS (SELECT *, sqrt((field_x_m - px) * (field_x_m - px) + (field_y_m - py) * (field_y_m - py)) AS metres FROM (
  SELECT *, lag(frame_index) OVER w AS pf, lag(field_x_m) OVER w AS px, lag(field_y_m) OVER w AS py FROM path WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_index, det_seq)) WHERE frame_index > pf)
"""


@q("AGG13_travelled", f"""{W}, {PLACED}, {_MS} SELECT match_id, track_id, round(sum(metres), 4) AS metres, round(avg(metres * 30 / (frame_index - pf)), 6) AS mean_m_s, round(max(metres * 30 / (frame_index - pf)), 6) AS max_m_s, count(*) AS steps FROM ms GROUP BY 1, 2""")
def travelled(d: DataFrame) -> DataFrame:
    return M.travelled(robot_path(d), ["frame_index", "det_seq"])


@q("AGG14_mouth_entries", f"""{W}, {PLACED}, s AS (SELECT *, CASE WHEN abs(field_y_m - {_WID} / 2) <= 0.3::DOUBLE THEN CASE WHEN field_x_m BETWEEN -0.3::DOUBLE AND 0 THEN 'left' WHEN field_x_m BETWEEN {_LEN} AND {PITCH.length_m + 0.3}::DOUBLE THEN 'right' END END AS side FROM path),
w AS (SELECT *, lag(side) OVER (PARTITION BY match_id, track_id ORDER BY frame_index, det_seq) AS was FROM s) SELECT match_id, track_id, side, count(*) AS entries FROM w WHERE side IS NOT NULL AND side IS DISTINCT FROM was GROUP BY 1, 2, 3""")  # fmt: skip
def mouth_entries(d: DataFrame) -> DataFrame:
    return M.mouth_entries(robot_path(d), PITCH, 0.6, 0.3, ["frame_index", "det_seq"])


@q("PRJ20_penalty_samples", f"""{W}, {PLACED} SELECT match_id, team, CASE WHEN field_x_m BETWEEN 0 AND 0.25::DOUBLE THEN 'left' ELSE 'right' END AS side, count(*) AS samples FROM path
  WHERE abs(field_y_m - {_WID} / 2) <= 0.4::DOUBLE AND (field_x_m BETWEEN 0 AND 0.25::DOUBLE OR field_x_m BETWEEN {PITCH.length_m - 0.25}::DOUBLE AND {_LEN}) GROUP BY 1, 2, 3""")  # fmt: skip
def penalty(d: DataFrame) -> DataFrame:
    p = robot_path(d).withColumn("side", M.penalty_side(F.col("field_x_m"), F.col("field_y_m"), PITCH, 0.25, 0.8))
    return p.where("side is not null").groupBy("match_id", "team", "side").agg(F.count(F.lit(1)).alias("samples"))


def fits(d: DataFrame) -> DataFrame:
    return M.motion_fits(robot_path(d).where("track_id is not null").withColumn("__order", F.struct("score", -F.col("det_seq"))), 18, 6)


_FITS = f"""{W}, {PLACED}, one AS (SELECT * FROM path WHERE track_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY match_id, track_id, frame_index ORDER BY score DESC, det_seq) = 1),
j AS (SELECT a.match_id, a.track_id, a.frame_index, a.field_x_m AS ax, a.field_y_m AS ay, (b.frame_index - a.frame_index) / 30.0::DOUBLE AS t, b.field_x_m AS x, b.field_y_m AS y FROM one a JOIN one b ON a.match_id = b.match_id AND a.track_id = b.track_id AND b.frame_index BETWEEN a.frame_index - 18 AND a.frame_index),
ff AS (SELECT match_id, track_id, frame_index, min(ax) AS field_x_m, min(ay) AS field_y_m, count(*) AS samples, regr_slope(x, t) AS vx, regr_slope(y, t) AS vy, sqrt(greatest(0.0::DOUBLE, (regr_syy(x, t) - regr_slope(x, t) * regr_sxy(x, t) + regr_syy(y, t) - regr_slope(y, t) * regr_sxy(y, t)) / count(*))) AS rmse FROM j GROUP BY 1, 2, 3 HAVING count(*) >= 6)
"""


@q("WIN10_motion_fits", _FITS + "SELECT match_id, track_id, frame_index, samples, round(vx + 1e-7::DOUBLE, 4) AS vx, round(vy + 1e-7::DOUBLE, 4) AS vy, round(rmse + 1e-7::DOUBLE, 4) AS rmse FROM ff")
def motion_fits(d: DataFrame) -> DataFrame:
    return fits(d).select("match_id", "track_id", "frame_index", "samples", F.round(F.col("vx") + 1e-7, 4).alias("vx"), F.round(F.col("vy") + 1e-7, 4).alias("vy"), F.round(F.col("rmse") + 1e-7, 4).alias("rmse"))


@q("FOR01_forecasts")
def forecasts(d: DataFrame) -> DataFrame:
    return M.forecasts(fits(d), PITCH)


@q("FOR02_best_snapshot", _FITS + """, st AS (SELECT match_id, min(frame_index) AS a FROM ff GROUP BY 1), sc AS (SELECT match_id, frame_index, sum(sqrt(vx * vx + vy * vy)) AS s, count(*) AS n FROM ff JOIN st USING (match_id) WHERE frame_index - a >= 18 AND (frame_index - a) % 5 = 0 GROUP BY 1, 2)
SELECT match_id, frame_index, round(s * (0.8::DOUBLE + 0.2::DOUBLE * least(1.0::DOUBLE, n / 4)), 4) AS score, n AS tracks FROM sc QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY round(s * (0.8::DOUBLE + 0.2::DOUBLE * least(1.0::DOUBLE, n / 4)), 6) DESC, frame_index) = 1""")  # fmt: skip
def snapshot(d: DataFrame) -> DataFrame:
    return M.best_snapshot(fits(d)).withColumn("score", F.round("score", 4))


@q("HEAT1_cells", f"""{W}, o AS (SELECT a.range - 2 AS i, b.range - 2 AS j FROM range(5) a, range(5) b), c AS (SELECT match_id, frame_index, cx, cy, floor(cx / 16)::BIGINT + i AS cell_x, floor(cy / 16)::BIGINT + j AS cell_y FROM det, o WHERE class_name IN {_R}),
k AS (SELECT match_id, cell_x, cell_y, max(frame_index) AS covered FROM c WHERE sqrt(((cell_x + 0.5::DOUBLE) * 16 - cx) * ((cell_x + 0.5::DOUBLE) * 16 - cx) + ((cell_y + 0.5::DOUBLE) * 16 - cy) * ((cell_y + 0.5::DOUBLE) * 16 - cy)) <= 28 GROUP BY 1, 2, 3)
SELECT k.*, round(pow(0.997::DOUBLE, l - covered), 6) AS heat FROM k JOIN (SELECT match_id, max(frame_index) AS l FROM det WHERE class_name IN {_R} GROUP BY 1) USING (match_id)""")  # fmt: skip
def heat(d: DataFrame) -> DataFrame:
    return M.heat_cells(d.where(is_in(ROBOTS)))


# Game state ------------------------------------------------------------------------------------

REMOVED = f"""sn AS (SELECT DISTINCT match_id, track_id, frame_index FROM det WHERE class_name IN {_R} AND track_id IS NOT NULL),
gone AS (SELECT match_id, track_id, f + 18 AS frame_index FROM (SELECT match_id, track_id, frame_index AS f, lead(frame_index) OVER (PARTITION BY match_id, track_id ORDER BY frame_index) AS n FROM sn) JOIN (SELECT match_id, max(frame_index) AS l FROM det GROUP BY 1) USING (match_id)
  WHERE (n IS NULL OR n > f + 18) AND f + 18 <= l)
"""


@q("WIN07_robots_removed", f"{W}, {REMOVED} SELECT * FROM gone")
def removed(d: DataFrame) -> DataFrame:
    return gamestate.robots_removed(d)


STATES = f"""{PLAY}, {HUMAN}, {REMOVED}, dense AS (SELECT match_id, unnest(range(a, z + 1)) AS frame_index FROM (SELECT match_id, min(frame_index) AS a, max(frame_index) AS z FROM det GROUP BY 1)),
st AS (SELECT d.match_id, d.frame_index, b.f IS NOT NULL AS ball, p.f IS NOT NULL AS play, h.frame_index IS NOT NULL AS human, max(b.f) OVER (PARTITION BY d.match_id ORDER BY d.frame_index) AS lb FROM dense d
  LEFT JOIN (SELECT DISTINCT match_id, frame_index AS f FROM det WHERE class_name IN {_B}) b ON b.match_id = d.match_id AND b.f = d.frame_index LEFT JOIN (SELECT DISTINCT match_id, frame_index AS f FROM play) p ON p.match_id = d.match_id AND p.f = d.frame_index
  LEFT JOIN human h ON h.match_id = d.match_id AND h.frame_index = d.frame_index),
fs AS (SELECT *, CASE WHEN human THEN 'human_intervention' WHEN (NOT ball AND coalesce(frame_index - lb >= 12, false)) OR (ball AND NOT play) THEN 'dead_ball' ELSE 'in_play' END AS state FROM st)
"""


def states(d: DataFrame) -> DataFrame:
    return gamestate.frame_states(d, disabled=STILL_FRAMES, still_px=STILL_PX)


@q("STM04_frame_states")
def frame_states(d: DataFrame) -> DataFrame:
    return states(d).select(*L.FRAME, "state", "confidence", "ball_in_play", "human_intervention", F.size("robot_removed").cast("long").alias("removed"), F.size("robot_disabled").cast("long").alias("disabled"), F.array_join("reasons", ";").alias("reasons"))


@q("STM05_robots_disabled")
def disabled(d: DataFrame) -> DataFrame:
    return gamestate.robots_disabled(d, STILL_FRAMES, STILL_PX)


@q("WIN04_segments")
def segments(d: DataFrame) -> DataFrame:
    return gamestate.segments(states(d))


@q("WIN05_entry_events")
def entries(d: DataFrame) -> DataFrame:
    return gamestate.entry_events(states(d))


@q("AGG15_state_summary", f"""{W}, {STATES} SELECT match_id, count(*) AS frames, sum(CASE WHEN state = 'in_play' THEN 1 ELSE 0 END)::BIGINT AS in_play, sum(CASE WHEN state = 'dead_ball' THEN 1 ELSE 0 END)::BIGINT AS dead_ball,
  sum(CASE WHEN state = 'human_intervention' THEN 1 ELSE 0 END)::BIGINT AS human_intervention, round(avg(CASE WHEN state = 'in_play' THEN 1.0::DOUBLE ELSE 0 END), 6) AS playable_ratio FROM fs GROUP BY 1""")  # fmt: skip
def state_summary(d: DataFrame) -> DataFrame:
    n = lambda s: F.sum((F.col("state") == s).cast("long")).alias(s)
    return states(d).groupBy("match_id").agg(F.count(F.lit(1)).alias("frames"), n("in_play"), n("dead_ball"), n("human_intervention"), F.round(F.avg((F.col("state") == "in_play").cast("double")), 6).alias("playable_ratio"))


@q("FLT06_playable_rows", f"{W}, {STATES} SELECT det_seq FROM det JOIN fs USING (match_id, frame_index) WHERE fs.state = 'in_play'")
def playable(d: DataFrame) -> DataFrame:
    return d.join(states(d).where("state = 'in_play'"), L.FRAME, "left_semi").select("det_seq")


# Folds and state machines ----------------------------------------------------------------------


@q("DED01_suppressed")
def suppressed(d: DataFrame) -> DataFrame:
    return folds.suppress(d, 0.7).select("match_id", "frame_index", "class_name", "det_seq")


@q("DED02_robots_suppressed")
def robots_suppressed(d: DataFrame) -> DataFrame:
    near = d.where(is_in(ROBOTS)).join(L.boxes(d, BALLS, "b_"), L.FRAME).where(G.distance(F.col("cx"), F.col("cy"), F.col("b_cx"), F.col("b_cy")) <= 70).select("det_seq").distinct().withColumn("near_ball", F.lit(True))
    robots = d.where(is_in(ROBOTS)).join(near, "det_seq", "left").withColumn("near_ball", F.coalesce("near_ball", F.lit(False))).select("match_id", "frame_index", "det_seq", "score", "x1", "y1", "x2", "y2", "area", "source", "near_ball")
    return folds.suppress_robots(robots, None, F.col("near_ball"), F.coalesce(F.col("source") == "dark_robot", F.lit(False)), max_per_frame=4, min_area=100.0, centre_ratio=0.3).select("match_id", "frame_index", "det_seq")


def all_events(d: DataFrame) -> DataFrame:
    """Passes, interceptions, collisions, goal candidates and shots as one table."""
    none = F.lit("").alias
    p = passes(d).select(*L.FRAME, "event_type", "confidence", F.concat_ws(",", F.least("from_track", "to_track").cast("string"), F.greatest("from_track", "to_track").cast("string")).alias("actors"), none("goal_side"), none("target_side"))
    t = lambda c: F.coalesce(F.col(c), F.lit(-1).cast("long"))
    c = collisions(d).select(*L.FRAME, F.lit("collision").alias("event_type"), F.lit(0.55).alias("confidence"), F.concat_ws(",", F.least(t("track_a"), t("track_b")).cast("string"), F.greatest(t("track_a"), t("track_b")).cast("string")).alias("actors"), none("goal_side"), none("target_side"))
    g = goal_hits(d).select(*L.FRAME, F.lit("goal_candidate").alias("event_type"), F.lit(0.6).alias("confidence"), F.col("actor").cast("string").alias("actors"), "goal_side", none("target_side"))
    s = shots(d).select(*L.FRAME, F.lit("shot").alias("event_type"), F.lit(0.5).alias("confidence"), F.coalesce(F.col("actor").cast("string"), F.lit("None")).alias("actors"), none("goal_side"), "target_side")
    return p.unionByName(c).unionByName(g).unionByName(s)


@q("SET02_all_events")
def event_counts(d: DataFrame) -> DataFrame:
    return all_events(d)


@q("DED03_deduplicated_events")
def deduplicated(d: DataFrame) -> DataFrame:
    cool = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in E.COOLDOWNS.items() for x in kv]), F.col("event_type")), F.lit(0))
    keys = ["match_id", "event_type", "actors", "goal_side", "target_side"]
    return folds.cooled(all_events(d), keys, cool, ["frame_index", "confidence"], "confidence").select(*keys, "frame_index", "confidence")


@q("DED04_collision_cooldown")
def collision_cooldown(d: DataFrame) -> DataFrame:
    c = collisions(d).where("track_a is not null and track_b is not null")
    c = c.select("match_id", F.least("track_a", "track_b").alias("a"), F.greatest("track_a", "track_b").alias("b"), "frame_index").distinct()
    return folds.spaced(c, ["match_id", "a", "b"], "frame_index", 20)


@q("DED07_part_clusters")
def part_clusters(d: DataFrame) -> DataFrame:
    return folds.clusters(d.where(is_in(ROBOTS) & (F.col("source") == "dark_robot")), L.FRAME, 32.0)


@q("TOP10_freeze_events")
def freeze_events(d: DataFrame) -> DataFrame:
    e = all_events(d).groupBy("match_id", "frame_index").agg(F.max_by("event_type", F.struct("confidence", "event_type")).alias("event_type"))
    return folds.spaced(e, ["match_id"], "frame_index", 60, 20)


@q("STM01_tracks")
def tracks(d: DataFrame) -> DataFrame:
    return tracking.track(d.where(is_in(ROBOTS + BALLS)))


@q("STM02_byte_tracks")
def byte_tracks(d: DataFrame) -> DataFrame:
    return tracking.byte_track(d.where(is_in(ROBOTS + BALLS)))


@q("STM03_ball_path")
def ball_path(d: DataFrame) -> DataFrame:
    return tracking.ball_path(d)


@q("STM06_goal_confirmation")
def goal_confirmation(d: DataFrame) -> DataFrame:
    return E.confirmed_goals(d, E.goal_candidates(d))


@q("STM07_calibrated_crossings")
def crossings(d: DataFrame) -> DataFrame:
    return tracking.calibrated_crossings(d, LINE, WALL)


@q("STM08_steady_goals")
def steady(d: DataFrame) -> DataFrame:
    return tracking.steady_goals(d, GOALS)


_FAMILY = f"CASE WHEN {{0}} IN {_R} THEN 'robot' WHEN {{0}} IN {_B} THEN 'ball' ELSE {{0}} END"


@q("STM09_held_tracks", f"""{W}, s AS (SELECT * FROM det WHERE track_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY match_id, class_name, track_id, frame_index ORDER BY score DESC, det_seq) = 1),
n AS (SELECT match_id, class_name, track_id, det_seq, frame_index, lead(frame_index) OVER (PARTITION BY match_id, class_name, track_id ORDER BY frame_index) AS nx FROM s),
e AS (SELECT n.*, least(frame_index + 12, coalesce(nx - 1, l)) AS stop FROM n JOIN (SELECT match_id, max(frame_index) AS l FROM det GROUP BY 1) USING (match_id)),
hh AS (SELECT match_id, class_name, track_id, unnest(range(frame_index + 1, stop + 1)) AS held_frame, frame_index AS seen_frame, det_seq FROM e WHERE stop > frame_index),
h AS (SELECT hh.*, d.x1, d.y1, d.x2, d.y2, d.cx, d.cy FROM hh JOIN det d USING (det_seq))
SELECT match_id, class_name, track_id, held_frame, seen_frame, det_seq FROM h WHERE NOT EXISTS (SELECT 1 FROM det k WHERE k.match_id = h.match_id AND k.frame_index = h.held_frame AND {_FAMILY.format('k.class_name')} = {_FAMILY.format('h.class_name')}
    AND ({iou('h.', 'k.')} >= 0.15::DOUBLE OR {inter('h.', 'k.')} / nullif(least({area('h.')}, {area('k.')}), 0) >= 0.55::DOUBLE OR {dist('h.', 'k.')} <= 80))
  AND NOT (h.class_name IN {_R} AND EXISTS (SELECT 1 FROM det k JOIN det r ON r.match_id = k.match_id AND r.frame_index = k.frame_index AND r.class_name IN {_R} AND {dist('r.', 'k.')} <= 190
    WHERE k.match_id = h.match_id AND k.frame_index = h.held_frame AND k.class_name IN {_B} AND {dist('h.', 'k.')} <= 140))""")  # fmt: skip
def held(d: DataFrame) -> DataFrame:
    return tracking.held_tracks(d)


@q("STM10_trails", f"""{W} SELECT match_id, track_id, frame_index, det_seq, count(*) OVER (PARTITION BY match_id, track_id ORDER BY frame_index, det_seq ROWS 44 PRECEDING) AS points,
  round(first_value(cx) OVER (PARTITION BY match_id, track_id ORDER BY frame_index, det_seq ROWS 44 PRECEDING), 6) AS tail_x FROM det WHERE track_id IS NOT NULL AND class_name IN {_B}""")  # fmt: skip
def trails(d: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("match_id", "track_id").orderBy("frame_index", "det_seq").rowsBetween(-44, 0)
    return d.where(is_in(BALLS) & F.col("track_id").isNotNull()).select("match_id", "track_id", "frame_index", "det_seq", F.count(F.lit(1)).over(w).alias("points"), F.round(F.first("cx").over(w), 6).alias("tail_x"))


@q("STM12_sweep_windows", f"{W} SELECT match_id, frame_index // 120 AS window_index, count(*) AS detections, count(DISTINCT class_name) AS classes FROM det GROUP BY 1, 2")
def sweep(d: DataFrame) -> DataFrame:
    return d.groupBy("match_id", F.expr("frame_index div 120").alias("window_index")).agg(F.count(F.lit(1)).alias("detections"), F.countDistinct("class_name").alias("classes"))


@q("TOP02_best_of_frame", f"{W} SELECT match_id, frame_index, det_seq FROM det WHERE class_name IN {_R} QUALIFY row_number() OVER (PARTITION BY match_id, frame_index ORDER BY coalesce(area, 0) DESC, score DESC, det_seq) = 1")
def best_of_frame(d: DataFrame) -> DataFrame:
    return L.best_per(d.where(is_in(ROBOTS)), L.FRAME, [F.desc(F.coalesce("area", F.lit(0.0))), F.desc("score"), F.col("det_seq")]).select(*L.FRAME, "det_seq")


@q("SET06_missing_goal_colour", f"""{W}, g AS (SELECT match_id, frame_index, count(DISTINCT class_name) AS n, min(class_name) AS present FROM det WHERE class_name IN ('goal_blue', 'goal_yellow') GROUP BY 1, 2)
SELECT match_id, frame_index, CASE present WHEN 'goal_blue' THEN 'goal_yellow' ELSE 'goal_blue' END AS missing FROM g WHERE n = 1""")  # fmt: skip
def missing_goal(d: DataFrame) -> DataFrame:
    both = F.array(F.lit("goal_blue"), F.lit("goal_yellow"))
    g = d.where(F.col("class_name").isin("goal_blue", "goal_yellow")).groupBy(*L.FRAME).agg(F.collect_set("class_name").alias("p"))
    return g.where(F.size("p") == 1).select(*L.FRAME, F.get(F.array_except(both, "p"), F.lit(0)).alias("missing"))


@q("DST15_inferred_goals", f"""{W}, {BIG}, g AS (SELECT match_id, frame_index, count(DISTINCT class_name) AS n FROM det WHERE class_name IN ('goal_blue', 'goal_yellow') GROUP BY 1, 2),
b AS (SELECT * FROM det WHERE class_name IN ('goal_blue', 'goal_yellow') QUALIFY row_number() OVER (PARTITION BY match_id, frame_index ORDER BY score DESC, det_seq) = 1)
SELECT b.match_id, b.frame_index, CASE b.class_name WHEN 'goal_blue' THEN 'goal_yellow' ELSE 'goal_blue' END AS class_name, 0.25::DOUBLE AS score,
  round(CASE WHEN f.y2 - f.y1 > f.x2 - f.x1 THEN b.x1 ELSE f.x1 + f.x2 - b.x2 END, 6) AS x1, round(CASE WHEN f.y2 - f.y1 > f.x2 - f.x1 THEN f.y1 + f.y2 - b.y2 ELSE b.y1 END, 6) AS y1,
  round(CASE WHEN f.y2 - f.y1 > f.x2 - f.x1 THEN b.x2 ELSE f.x1 + f.x2 - b.x1 END, 6) AS x2, round(CASE WHEN f.y2 - f.y1 > f.x2 - f.x1 THEN f.y1 + f.y2 - b.y1 ELSE b.y2 END, 6) AS y2
FROM b JOIN g USING (match_id, frame_index) JOIN big f ON f.match_id = b.match_id AND f.frame_index = b.frame_index WHERE n = 1""")  # fmt: skip
def inferred_goals(d: DataFrame) -> DataFrame:
    one = missing_goal(d)
    best = L.best_per(d.where(F.col("class_name").isin("goal_blue", "goal_yellow")), L.FRAME, [F.desc("score"), F.col("det_seq")])
    m = G.mirror_box(G.Box.of(), G.Box.of("f_"))
    return best.join(one, L.FRAME).join(L.largest_field(d), L.FRAME).select(*L.FRAME, F.col("missing").alias("class_name"), F.lit(0.25).alias("score"), *[F.round(getattr(m, c), 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


# Given event and path tables ---------------------------------------------------------------------


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "match_events").where("match_id is not null and frame_index is not null")


QUERIES["AGG08_event_summary"] = lambda s, d: summaries.event_summary(event_table(s, d))
ORACLES["AGG08_event_summary"] = "SELECT match_id, event_type, count(*) AS events, min(frame_index) AS first_frame, max(frame_index) AS last_frame FROM match_events WHERE match_id IS NOT NULL AND frame_index IS NOT NULL GROUP BY 1, 2"
QUERIES["AGG08_scoreboard"] = lambda s, d: summaries.scoreboard(event_table(s, d).withColumn("scoring_team", F.regexp_extract("metadata", '"scoring_team"\\s*:\\s*"(\\w+)"', 1)))
ORACLES["AGG08_scoreboard"] = "SELECT match_id, " + ", ".join(
    f"sum(CASE WHEN event_type = '{k}' AND regexp_extract(metadata, '\"scoring_team\"\\s*:\\s*\"(\\w+)\"', 1) = '{t}' THEN 1 ELSE 0 END)::BIGINT AS {k}_{t}" for k in ("goal_candidate", "goal_confirmed") for t in ("blue", "yellow")
) + " FROM match_events WHERE match_id IS NOT NULL AND frame_index IS NOT NULL GROUP BY 1"
QUERIES["TOP07_timeline"] = lambda s, d: summaries.timeline(event_table(s, d)).select("match_id", "event_id", "place")
ORACLES["TOP07_timeline"] = "SELECT match_id, event_id, (row_number() OVER (PARTITION BY match_id ORDER BY frame_index, event_id))::INTEGER AS place FROM match_events WHERE match_id IS NOT NULL AND frame_index IS NOT NULL QUALIFY place <= 25"


def overlay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: at every frame with a state, the last event of the 45 frames up to it. Frames are cut into stretches of 45, an event
    stands in its own and the next, so frames and events meet by equality."""
    e = event_table(spark, sf_dir).groupBy("match_id", "frame_index").agg(F.max("event_id").alias("event_id"))
    own = F.floor(F.col("frame_index") / 45)
    e = e.select("match_id", F.explode(F.array(own, own + 1)).alias("stretch"), F.struct(F.col("frame_index").alias("at"), "event_id").alias("e"))
    f = table(spark, sf_dir, "frame_states").select("match_id", "frame_index").where("match_id is not null and frame_index is not null").distinct()
    rows = f.withColumn("stretch", own).join(e, ["match_id", "stretch"]).where(F.col("e.at").between(F.col("frame_index") - 44, F.col("frame_index")))
    return rows.groupBy("match_id", "frame_index").agg(F.max("e").alias("e")).select("match_id", "frame_index", "e.event_id")


QUERIES["JN09_overlay_events"] = overlay_events
ORACLES["JN09_overlay_events"] = """SELECT f.match_id, f.frame_index, arg_max(e.event_id, (e.frame_index, e.event_id)) AS event_id FROM (SELECT DISTINCT match_id, frame_index FROM frame_states WHERE match_id IS NOT NULL AND frame_index IS NOT NULL) f
JOIN match_events e ON e.match_id = f.match_id AND e.frame_index BETWEEN f.frame_index - 44 AND f.frame_index GROUP BY 1, 2"""


def priority_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most important sure event of each frame."""
    order = F.array_position(F.array(*[F.lit(x) for x in ("goal_confirmed", "goal_candidate", "shot", "collision", "interception", "pass")]), F.col("event_type"))
    rows = event_table(spark, sf_dir).where("confidence >= 0.5").withColumn("p", order).where("p > 0")
    return L.best_per(rows, L.FRAME, [F.col("p"), F.desc("confidence"), F.col("event_id")]).select(*L.FRAME, "event_type", "event_id")


QUERIES["FLT13_priority_events"] = priority_events
ORACLES["FLT13_priority_events"] = """SELECT match_id, frame_index, event_type, event_id FROM match_events WHERE match_id IS NOT NULL AND frame_index IS NOT NULL AND confidence >= 0.5::DOUBLE
AND event_type IN ('goal_confirmed', 'goal_candidate', 'shot', 'collision', 'interception', 'pass') QUALIFY row_number() OVER (PARTITION BY match_id, frame_index
ORDER BY list_position(['goal_confirmed', 'goal_candidate', 'shot', 'collision', 'interception', 'pass'], event_type), confidence DESC, event_id) = 1"""


def metric_ball_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed in m/s between a ball track's successive finite positions, with those above 3 m/s flagged."""
    p = table(spark, sf_dir, "field_path").where("match_id is not null and track_id is not null and class_name = 'ball' and field_x_m is not null and field_y_m is not null and abs(field_x_m) < 100 and abs(field_y_m) < 100")
    p = p.groupBy("match_id", "track_id", "frame_index").agg(F.min("path_id").alias("path_id"), F.min_by(F.struct("field_x_m", "field_y_m"), "path_id").alias("p")).select("match_id", "track_id", "frame_index", "path_id", "p.*")
    s = M.metric_steps(p, ["frame_index"])
    return s.select("path_id", F.round("speed", 6).alias("m_s"), (F.col("speed") > 3).alias("flagged"))


QUERIES["SIT07_metric_ball_speed"] = metric_ball_speed
ORACLES["SIT07_metric_ball_speed"] = """WITH p AS (SELECT * FROM field_path WHERE match_id IS NOT NULL AND track_id IS NOT NULL AND class_name = 'ball' AND field_x_m IS NOT NULL AND field_y_m IS NOT NULL AND abs(field_x_m) < 100 AND abs(field_y_m) < 100
  QUALIFY row_number() OVER (PARTITION BY match_id, track_id, frame_index ORDER BY path_id) = 1),
s AS (SELECT *, lag(frame_index) OVER w AS pf, lag(field_x_m) OVER w AS px, lag(field_y_m) OVER w AS py FROM p WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_index)),
v AS (SELECT path_id, sqrt((field_x_m - px) * (field_x_m - px) + (field_y_m - py) * (field_y_m - py)) * 30 / (frame_index - pf) AS speed FROM s WHERE frame_index > pf)
SELECT path_id, round(speed, 6) AS m_s, speed > 3 AS flagged FROM v"""


def ball_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement over five samples of the best ball and its straight continuation 0.5, 1 and 1.5 s on, with falling confidence."""
    d = detections(spark, sf_dir)
    ranked = blocked_row_number(possession.best_ball(d).select(*L.FRAME, "cx", "cy").withColumn("__stretch", F.floor(F.col("frame_index") / 65_536)), ["match_id"], [F.col("frame_index")], "__stretch", "n")
    b = ranked.join(ranked.select("match_id", (F.col("n") + 5).alias("n"), F.col("frame_index").alias("pf"), F.col("cx").alias("px"), F.col("cy").alias("py")), ["match_id", "n"])
    b = b.withColumn("t", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(1.5))))
    k = F.col("t") * 30 / (F.col("frame_index") - F.col("pf"))
    return b.select(*L.FRAME, "t", F.round(F.col("cx") + k * (F.col("cx") - F.col("px")) + 1e-7, 4).alias("x"), F.round(F.col("cy") + k * (F.col("cy") - F.col("py")) + 1e-7, 4).alias("y"), F.round(F.exp(-0.45 * F.col("t")), 6).alias("confidence"))


QUERIES["WIN14_ball_extrapolation"] = ball_peaks
ORACLES["WIN14_ball_extrapolation"] = f"""{W}, {BEST}, l AS (SELECT *, lag(cx, 5) OVER w AS px, lag(cy, 5) OVER w AS py, lag(frame_index, 5) OVER w AS pf FROM bb WINDOW w AS (PARTITION BY match_id ORDER BY frame_index)),
k AS (SELECT *, unnest([0.5::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE]) AS t FROM l WHERE pf IS NOT NULL)
SELECT match_id, frame_index, t, round(cx + t * 30 / (frame_index - pf) * (cx - px) + 1e-7::DOUBLE, 4) AS x, round(cy + t * 30 / (frame_index - pf) * (cy - py) + 1e-7::DOUBLE, 4) AS y, round(exp(-0.45::DOUBLE * t), 6) AS confidence FROM k"""


@q("TOP11_canonical_order", f"""{W} SELECT det_seq, row_number() OVER (PARTITION BY match_id ORDER BY frame_index, class_name, CASE WHEN track_id IS NULL OR track_id = 0 THEN -1 ELSE track_id END, score DESC, det_seq) AS place FROM det""")
def canonical_order(d: DataFrame) -> DataFrame:
    """Every row's place in the order results are presented in; counted by stretches of frames, so that no match is one task."""
    rows = d.withColumn("__stretch", F.floor(F.col("frame_index") / 4096))
    return blocked_row_number(rows, ["match_id"], [F.col("frame_index"), F.col("class_name"), E.known_track("track_id"), F.desc("score"), F.col("det_seq")], "__stretch", "place").select("det_seq", "place")
