"""SQL of the queries that fold: ordered groups walked by recursion, and what builds on them."""

from __future__ import annotations

from pitchgrid.operators import events as E
from pitchgrid.plans import dataset_queries as D
from pitchgrid.plans import match_queries as M
from pitchgrid.sources.detections import BALLS, DET, GOALS, ROBOTS, sql_in

_R, _B, _G = map(sql_in, (ROBOTS, BALLS, GOALS))


def walk(source: str, rows: str, keys: list[str], order: str, cols: list[str], step: str, first: str = "[{row}]") -> str:
    """CTEs rows_, ord, f, fin: each group of `rows` walked in order; f.kept is a list of structs and o the next row.

    step: the next list from f.kept and {row}; source: CTEs before, ending in a comma or empty.
    """
    k, row = ", ".join(keys), "{" + ", ".join(f"'{c}': o.{c}" for c in cols) + "}"
    same = " AND ".join(f"f.{c} IS NOT DISTINCT FROM o.{c}" for c in keys)
    return f"""WITH RECURSIVE {source} rows_ AS ({rows}), ord AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY {k}) AS total FROM rows_),
f AS (SELECT {k}, rn, total, {first.format(row=row)} AS kept FROM ord o WHERE rn = 1 UNION ALL SELECT {", ".join("f." + c for c in keys)}, o.rn, f.total, {step.format(row=row)} FROM f JOIN ord o ON o.rn = f.rn + 1 AND {same}),
fin AS (SELECT {k}, unnest(kept) AS x FROM f WHERE rn = total)
"""


def kept_unless(clash: str, limit: int | None = None) -> str:
    """Appends the row unless a kept one (k) clashes with it (o)."""
    full = f" OR len(f.kept) >= {limit}" if limit else ""
    return f"CASE WHEN len(list_filter(f.kept, lambda k: {clash})) > 0{full} THEN f.kept ELSE list_append(f.kept, {{row}}) END"


def spaced(gap: int, limit: int | None = None) -> str:
    full = f" OR len(f.kept) >= {limit}" if limit else ""
    return f"CASE WHEN o.frame_index - f.kept[-1].frame_index < {gap}{full} THEN f.kept ELSE list_append(f.kept, {{row}}) END"


def _inter(a: str, b: str) -> str:
    return f"(greatest(0.0::DOUBLE, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0::DOUBLE, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"


def _area(a: str) -> str:
    return f"(greatest(0.0::DOUBLE, {a}.x2 - {a}.x1) * greatest(0.0::DOUBLE, {a}.y2 - {a}.y1))"


_IOU = f"({_inter('k', 'o')} / nullif({_area('k')} + {_area('o')} - {_inter('k', 'o')}, 0))"
_APART = "sqrt(pow((k.x1 + k.x2 - o.x1 - o.x2) / 2, 2) + pow((k.y1 + k.y2 - o.y1 - o.y2) / 2, 2))"
_DIAGONAL = "greatest(sqrt(pow(k.x2 - k.x1, 2) + pow(k.y2 - k.y1, 2)), sqrt(pow(o.x2 - o.x1, 2) + pow(o.y2 - o.y1, 2)))"
BOX = ["det_seq", "x1", "y1", "x2", "y2"]


def suppressed(threshold: float, rows: str = "SELECT * FROM det") -> str:
    return walk(DET + ",", rows, ["match_id", "frame_index", "class_name"], "score DESC, det_seq", BOX, kept_unless(f"{_inter('k', 'o')} > 0 AND {_inter('k', 'o')} >= {threshold}::DOUBLE * ({_area('k')} + {_area('o')} - {_inter('k', 'o')})"))


CHANGES = M._CHANGES.removeprefix("WITH ")
#: Every event of a match; CTEs of detections, play, owners and changes come before.
EVENTS = f"""{CHANGES}, {M.PLAY}, {M.HITS}, shots AS (SELECT * FROM ({M.ORACLES['WIN02_shots']})),
ev AS (SELECT match_id, frame_index, event_type, confidence, least(from_track, to_track)::VARCHAR || ',' || greatest(from_track, to_track)::VARCHAR AS actors, '' AS goal_side, '' AS target_side FROM pi
  UNION ALL SELECT a.match_id, a.frame_index, 'collision', 0.55::DOUBLE, least(coalesce(a.track_id, -1), coalesce(b.track_id, -1))::VARCHAR || ',' || greatest(coalesce(a.track_id, -1), coalesce(b.track_id, -1))::VARCHAR, '', ''
    FROM det a JOIN det b ON {M.SAME} AND a.det_seq < b.det_seq WHERE a.class_name IN {_R} AND b.class_name IN {_R} AND {M.dist('a.', 'b.')} <= 55
  UNION ALL SELECT match_id, frame_index, 'goal_candidate', 0.6::DOUBLE, actor::VARCHAR, goal_side, '' FROM hits
  UNION ALL SELECT match_id, frame_index, 'shot', 0.5::DOUBLE, coalesce(actor::VARCHAR, 'None'), '', target_side FROM shots)
"""
_COOL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in E.COOLDOWNS.items()) + " ELSE 0 END"
_EV = ["match_id", "event_type", "actors", "goal_side", "target_side"]
_INSIDE = "{b}.cx BETWEEN {g}.x1 - greatest(8.0::DOUBLE, ({b}.x2 - {b}.x1) * 0.5::DOUBLE) AND {g}.x2 + greatest(8.0::DOUBLE, ({b}.x2 - {b}.x1) * 0.5::DOUBLE) AND {b}.cy BETWEEN {g}.y1 - greatest(8.0::DOUBLE, ({b}.x2 - {b}.x1) * 0.5::DOUBLE) AND {g}.y2 + greatest(8.0::DOUBLE, ({b}.x2 - {b}.x1) * 0.5::DOUBLE)"
_SIDE = "CASE WHEN {0} LIKE '%blue%' THEN 'blue' WHEN {0} LIKE '%yellow%' THEN 'yellow' ELSE 'unknown' END"
_TO_GOAL = "sqrt(pow({0}.cx - (c.gx1 + c.gx2) / 2, 2) + pow({0}.cy - (c.gy1 + c.gy2) / 2, 2))"
#: Goal candidates (the first of a side in 45 frames) and their confirmation.
CANDIDATES = walk(f"{DET}, {M.PLAY}, {M.HITS}, ", "SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY match_id, frame_index, goal_side ORDER BY goal_seq) = 1", ["match_id", "goal_side"], "frame_index", ["frame_index", "actor"], spaced(45))
CONFIRMED = f"""{CANDIDATES}, cand AS (SELECT match_id, goal_side, x.frame_index AS frame_index, x.actor AS actor FROM fin),
gl AS (SELECT *, {_SIDE.format('class_name')} AS side FROM det WHERE class_name IN {_G} QUALIFY row_number() OVER (PARTITION BY match_id, frame_index, {_SIDE.format('class_name')} ORDER BY score DESC, det_seq) = 1),
balls AS (SELECT * FROM det WHERE class_name IN {_B}),
c AS (SELECT k.*, g.det_seq AS g, g.score AS gs, g.source AS gsrc, g.x1 AS gx1, g.y1 AS gy1, g.x2 AS gx2, g.y2 AS gy2, b.det_seq AS b, b.cx AS bx, b.cy AS by_, b.track_id AS bt
  FROM cand k LEFT JOIN gl g ON g.match_id = k.match_id AND g.frame_index = k.frame_index AND g.side = k.goal_side LEFT JOIN balls b ON b.match_id = k.match_id AND b.frame_index = k.frame_index
  QUALIFY row_number() OVER (PARTITION BY k.match_id, k.frame_index, k.goal_side ORDER BY CASE WHEN b.track_id = k.actor THEN 1 ELSE 0 END DESC, b.score DESC NULLS LAST, b.det_seq) = 1),
around AS (SELECT c.*, n.frame_index AS nf, n.score AS ns, n.det_seq AS nq, {_TO_GOAL.format('n')} AS n_to, sqrt(pow(c.bx - n.cx, 2) + pow(c.by_ - n.cy, 2)) AS moved,
  {_INSIDE.format(b='n', g='gg')} AS inside FROM c JOIN balls n ON n.match_id = c.match_id AND n.frame_index BETWEEN c.frame_index - 8 AND c.frame_index + 4 AND (c.bt IS NULL OR c.bt = n.track_id) LEFT JOIN gl gg ON gg.det_seq = c.g),
ins AS (SELECT match_id, frame_index, goal_side, list_sort(list_distinct(list(nf - frame_index))) AS l FROM around WHERE nf >= frame_index AND inside GROUP BY 1, 2, 3),
run_ AS (SELECT match_id, frame_index, goal_side, len(list_filter(l, lambda v, i: v = i - 1)) AS n FROM ins),
bef AS (SELECT * FROM around WHERE nf < frame_index QUALIFY row_number() OVER (PARTITION BY match_id, frame_index, goal_side ORDER BY nf DESC, ns DESC, nq) = 1),
conf AS (SELECT c.match_id, c.frame_index, c.goal_side, CASE c.goal_side WHEN 'blue' THEN 'yellow' WHEN 'yellow' THEN 'blue' ELSE 'unknown' END AS scoring_team, coalesce(r.n, 0) AS inside_frames,
  CASE WHEN c.g IS NULL THEN 'missing_goal_detection' WHEN c.b IS NULL THEN 'missing_ball_detection' WHEN c.gsrc = 'goal_geometry' THEN 'geometry_only_goal' WHEN c.gs < 0.45::DOUBLE THEN 'low_goal_confidence'
    WHEN e.moved IS NULL THEN 'missing_entry_history' WHEN e.inside THEN 'ball_already_inside_goal' WHEN e.moved < 3 THEN 'insufficient_entry_motion'
    WHEN e.n_to - sqrt(pow(c.bx - (c.gx1 + c.gx2) / 2, 2) + pow(c.by_ - (c.gy1 + c.gy2) / 2, 2)) <= 0 THEN 'ball_not_approaching_goal' WHEN coalesce(r.n, 0) < 2 THEN 'insufficient_inside_frames' END AS rejection_reason
  FROM c LEFT JOIN run_ r USING (match_id, frame_index, goal_side) LEFT JOIN bef e USING (match_id, frame_index, goal_side))
"""

(_X1, _Y1), (_X2, _Y2) = M.LINE
(_WX1, _WY1), (_WX2, _WY2) = M.WALL


def _place(x: str, y: str, x1: float, y1: float, x2: float, y2: float) -> tuple[str, str]:
    dx, dy = x2 - x1, y2 - y1
    return f"({dx}::DOUBLE * ({y} - {y1}::DOUBLE) - {dy}::DOUBLE * ({x} - {x1}::DOUBLE)) / {(dx * dx + dy * dy) ** 0.5}::DOUBLE", f"(({x} - {x1}::DOUBLE) * {dx}::DOUBLE + ({y} - {y1}::DOUBLE) * {dy}::DOUBLE) / {dx * dx + dy * dy}::DOUBLE"


_LD, _LP = _place("cx", "cy", _X1, _Y1, _X2, _Y2)
_WD, _WP = _place("cx", "cy", _WX1, _WY1, _WX2, _WY2)

ORACLES = {
    "DED01_suppressed": suppressed(0.7) + "SELECT match_id, frame_index, class_name, x.det_seq AS det_seq FROM fin",
    "SRC06_merged_scan": suppressed(0.85) + "SELECT match_id, class_name, count(*) AS rows FROM fin GROUP BY 1, 2",
    "DED02_robots_suppressed": walk(
        DET + ",",
        f"""SELECT *, EXISTS (SELECT 1 FROM det b WHERE b.match_id = a.match_id AND b.frame_index = a.frame_index AND b.class_name IN {_B} AND {M.dist('a.', 'b.')} <= 70) AS near FROM det a WHERE class_name IN {_R}
  AND (CASE WHEN coalesce(area, 0) > 0 THEN area ELSE {_area('a')} END) >= 100""",
        ["match_id", "frame_index"], f"CASE WHEN near THEN 0 ELSE 1 END, CASE WHEN source = 'dark_robot' THEN 1 ELSE 0 END, -score, -{_area('rows_')}, det_seq", BOX,
        kept_unless(f"coalesce({_IOU}, 0) >= 0.55::DOUBLE OR {_inter('k', 'o')} / nullif(least({_area('k')}, {_area('o')}), 0) >= 0.82::DOUBLE OR {_APART} < 0.3::DOUBLE * {_DIAGONAL}", 4),
    ) + "SELECT match_id, frame_index, x.det_seq AS det_seq FROM fin",
    "DED03_deduplicated_events": walk(
        EVENTS + ",", f"SELECT *, {_COOL} AS cool FROM ev", _EV, "frame_index, confidence", ["frame_index", "confidence"],
        "CASE WHEN o.frame_index - f.kept[-1].frame_index >= o.cool THEN list_append(f.kept, {row}) WHEN o.confidence > f.kept[-1].confidence THEN list_append(f.kept[:-2], {row}) ELSE f.kept END",
    ) + "SELECT match_id, event_type, actors, goal_side, target_side, x.frame_index AS frame_index, x.confidence AS confidence FROM fin",
    "DED04_collision_cooldown": walk(
        DET + ",",
        f"SELECT DISTINCT a.match_id, least(a.track_id, b.track_id) AS a, greatest(a.track_id, b.track_id) AS b, a.frame_index FROM det a JOIN det b ON {M.SAME} AND a.det_seq < b.det_seq WHERE a.class_name IN {_R} AND b.class_name IN {_R} AND {M.dist('a.', 'b.')} <= 55 AND a.track_id IS NOT NULL AND b.track_id IS NOT NULL",
        ["match_id", "a", "b"], "frame_index", ["frame_index"], spaced(20),
    ) + "SELECT match_id, a, b, x.frame_index AS frame_index FROM fin",
    "DED07_part_clusters": walk(
        DET + ",", f"SELECT * FROM det WHERE class_name IN {_R} AND source = 'dark_robot'", ["match_id", "frame_index"], "-score, det_seq", ["score", "x1", "y1", "x2", "y2", "cx", "cy"],
        "list_append(f.kept, {{'c': coalesce(list_min(list_transform(list_filter(f.kept, lambda k: sqrt(pow(k.r.cx - o.cx, 2) + pow(k.r.cy - o.cy, 2)) <= 32), lambda k: k.c)), list_max(list_transform(f.kept, lambda k: k.c)) + 1), 'r': {row}}})", "[{{'c': 1, 'r': {row}}}]",
    ) + f"""SELECT match_id, frame_index, x.c AS cluster, min(x.r.x1) AS x1, min(x.r.y1) AS y1, max(x.r.x2) AS x2, max(x.r.y2) AS y2, max(x.r.score) AS score, round(sum({_area('x.r')}), 4) AS area, count(*) AS parts FROM fin GROUP BY 1, 2, 3""",
    "TOP10_freeze_events": walk(EVENTS + ",", "SELECT match_id, frame_index, arg_max(event_type, (confidence, event_type)) AS event_type FROM ev GROUP BY 1, 2", ["match_id"], "frame_index", ["frame_index", "event_type"], spaced(60, 20)) + "SELECT match_id, x.frame_index AS frame_index, x.event_type AS event_type FROM fin",
    "SET02_all_events": f"WITH {EVENTS} SELECT * FROM ev",
    "WIN11_spaced_samples": walk(DET + ",", f"SELECT match_id, track_id, frame_index, det_seq FROM det WHERE class_name IN {_R} AND track_id IS NOT NULL", ["match_id", "track_id"], "frame_index, det_seq", ["frame_index", "det_seq"], spaced(5, 8)) + "SELECT match_id, track_id, x.frame_index AS frame_index, x.det_seq AS det_seq FROM fin",
    "STM05_robots_disabled": walk(
        DET + ",", f"SELECT * FROM det WHERE class_name IN {_R} AND track_id IS NOT NULL", ["match_id", "track_id"], "frame_index, det_seq", ["frame_index", "cx", "cy"],
        f"CASE WHEN sqrt(pow(f.kept[1].cx - o.cx, 2) + pow(f.kept[1].cy - o.cy, 2)) <= {M.STILL_PX} THEN CASE WHEN o.frame_index - f.kept[1].frame_index = {M.STILL_FRAMES} THEN list_append(f.kept, {{row}}) ELSE f.kept END ELSE list_prepend({{row}}, f.kept[2:]) END",
    ) + "SELECT DISTINCT match_id, track_id, x.frame_index AS frame_index FROM (SELECT match_id, track_id, unnest(kept[2:]) AS x FROM f WHERE rn = total)",
    "STM06_goal_confirmation": CONFIRMED + "SELECT match_id, frame_index, goal_side, scoring_team, CASE WHEN rejection_reason IS NULL THEN 'goal_confirmed' ELSE 'goal_rejected' END AS event_type, rejection_reason, inside_frames FROM conf",
    "STM07_calibrated_crossings": f"""WITH {DET}, p AS (SELECT *, coalesce(track_id, -1) AS k, row_number() OVER (PARTITION BY match_id, coalesce(track_id, -1) ORDER BY frame_index, det_seq) AS rn, {_LD} AS d, {_LP} AS along,
  abs({_WD}) <= 0.75::DOUBLE * greatest(x2 - x1, y2 - y1) * 0.5::DOUBLE + 2 AND {_WP} BETWEEN -0.08::DOUBLE AND 1.08::DOUBLE AS touch FROM det WHERE class_name IN {_B}),
l AS (SELECT *, lag(d) OVER w AS pd, lag(frame_index) OVER w AS pf, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM p WINDOW w AS (PARTITION BY match_id, k ORDER BY rn)),
x AS (SELECT * FROM l WHERE frame_index - pf <= 2 AND pd <= 0 AND d > 0 AND along BETWEEN -0.08::DOUBLE AND 1.08::DOUBLE AND sqrt(pow(cx - px, 2) + pow(cy - py, 2)) >= 2),
s AS (SELECT x.match_id, x.k, x.rn, x.frame_index AS crossing, l.rn - x.rn AS j, l.frame_index AS f, l.touch, l.d <= 0 OR (l.rn > x.rn AND l.frame_index - l.pf > 2) AS stop FROM x JOIN l ON l.match_id = x.match_id AND l.k = x.k AND l.rn BETWEEN x.rn AND x.rn + 23),
g AS (SELECT match_id, k, rn, crossing, coalesce(min(CASE WHEN stop AND j < 6 THEN j END), max(CASE WHEN j < 6 THEN j END) + 1) AS inside_frames, arg_min(f, j) FILTER (WHERE touch) AS contact FROM s GROUP BY 1, 2, 3, 4),
one AS (SELECT * FROM g WHERE inside_frames >= 3 QUALIFY row_number() OVER (PARTITION BY match_id, k ORDER BY rn) = 1)
SELECT match_id, coalesce(contact, crossing) AS frame_index, CASE WHEN contact IS NULL THEN 'goal_rejected' ELSE 'goal_confirmed' END AS event_type, CASE WHEN contact IS NULL THEN 'missing_back_wall_contact' END AS rejection_reason, crossing AS crossing_frame,
  'left' AS goal_side, k AS actor, CASE WHEN contact IS NULL THEN 0.7::DOUBLE ELSE round(least(0.95::DOUBLE, 0.68::DOUBLE + 0.04::DOUBLE * inside_frames), 6) END AS confidence, inside_frames FROM one""",
    "STM08_steady_goals": walk(
        f"""{DET}, best AS (SELECT * FROM det WHERE class_name IN {_G} QUALIFY row_number() OVER (PARTITION BY match_id, class_name, frame_index ORDER BY score DESC, det_seq) = 1),""",
        "SELECT *, frame_index - row_number() OVER (PARTITION BY match_id, class_name ORDER BY frame_index) AS run FROM best", ["match_id", "class_name", "run"], "frame_index", ["frame_index", "x1", "y1", "x2", "y2"],
        "CASE WHEN sqrt(pow((o.x1 + o.x2 - f.kept[-1].x1 - f.kept[-1].x2) / 2, 2) + pow((o.y1 + o.y2 - f.kept[-1].y1 - f.kept[-1].y2) / 2, 2)) > 240 THEN list_append(f.kept, {{'frame_index': o.frame_index, 'x1': f.kept[-1].x1, 'y1': f.kept[-1].y1, 'x2': f.kept[-1].x2, 'y2': f.kept[-1].y2, 'replaced': true}})"
        " ELSE list_append(f.kept, {{'frame_index': o.frame_index, " + ", ".join(f"'{c}': 0.25::DOUBLE * o.{c} + 0.75::DOUBLE * f.kept[-1].{c}" for c in ("x1", "y1", "x2", "y2")) + ", 'replaced': false}}) END",
        "[{{'frame_index': o.frame_index, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2, 'replaced': false}}]",
    ) + "SELECT match_id, class_name, x.frame_index AS frame_index, round(x.x1, 6) AS x1, round(x.y1, 6) AS y1, round(x.x2, 6) AS x2, round(x.y2, 6) AS y2, x.replaced AS replaced FROM fin",
    "TOP08_separate_forecasts": walk(
        M._FITS.removeprefix("WITH ") + f", snap AS (SELECT match_id, frame_index FROM ({M.ORACLES['FOR02_best_snapshot']})),",
        "SELECT ff.*, sqrt(vx * vx + vy * vy) AS v FROM ff JOIN snap USING (match_id, frame_index)", ["match_id"], "-round(v, 6), -samples, track_id", ["track_id", "frame_index", "field_x_m", "field_y_m", "v"],
        kept_unless("sqrt(pow(k.field_x_m - o.field_x_m, 2) + pow(k.field_y_m - o.field_y_m, 2)) < 0.18::DOUBLE", 4),
    ) + "SELECT match_id, x.track_id AS track_id, x.frame_index AS frame_index, round(x.v, 4) AS m_s FROM fin",
    "WIN05_entry_events": f"""{M.W}, {M.STATES}, en AS (SELECT *, lag(state) OVER (PARTITION BY match_id ORDER BY frame_index) AS was FROM fs)
SELECT match_id, frame_index, state AS event_type, -1::BIGINT AS actor FROM en WHERE state <> 'in_play' AND state IS DISTINCT FROM was UNION ALL SELECT match_id, frame_index, 'robot_removed', track_id FROM gone
UNION ALL SELECT match_id, frame_index, 'robot_disabled', track_id FROM (STM05)""",
}
ORACLES["WIN05_entry_events"] = ORACLES["WIN05_entry_events"].replace("(STM05)", f"({ORACLES['STM05_robots_disabled']})")
_SURE = "CASE state WHEN 'human_intervention' THEN 0.8::DOUBLE WHEN 'dead_ball' THEN 0.7::DOUBLE ELSE CASE WHEN play THEN 0.55::DOUBLE ELSE 0.45::DOUBLE END END"
#: Frame states with their reasons.
REASONED = f"""{M.W}, {M.STATES}, rem AS (SELECT match_id, frame_index, count(DISTINCT track_id) AS removed FROM gone GROUP BY 1, 2), dis AS (SELECT match_id, frame_index, count(DISTINCT track_id) AS disabled FROM ({ORACLES['STM05_robots_disabled']}) GROUP BY 1, 2),
why AS (SELECT fs.*, coalesce(removed, 0) AS removed, coalesce(disabled, 0) AS disabled, {_SURE} AS confidence, list_filter([CASE WHEN NOT ball AND fs.frame_index - lb >= 12 THEN 'ball_missing' END, CASE WHEN ball AND NOT play THEN 'ball_out_of_play' END,
  CASE WHEN human THEN 'dead_ball_by_intervention' END, CASE WHEN human THEN 'human_on_or_near_field' END, CASE WHEN disabled > 0 THEN 'robot_disabled_candidate' END, CASE WHEN removed > 0 THEN 'robot_removed_candidate' END], lambda r: r IS NOT NULL) AS reasons
  FROM fs LEFT JOIN rem USING (match_id, frame_index) LEFT JOIN dis USING (match_id, frame_index))
"""
ORACLES |= {
    "STM04_frame_states": REASONED + "SELECT match_id, frame_index, state, confidence, play AS ball_in_play, human AS human_intervention, removed, disabled, array_to_string(reasons, ';') AS reasons FROM why",
    "WIN04_segments": REASONED + """, i AS (SELECT *, frame_index - row_number() OVER (PARTITION BY match_id, state ORDER BY frame_index) AS g FROM why), n AS (SELECT match_id, state, g, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS frames, round(avg(confidence), 6) AS confidence FROM i GROUP BY 1, 2, 3),
w AS (SELECT match_id, state, g, string_agg(DISTINCT r, ';' ORDER BY r) AS reasons FROM (SELECT match_id, state, g, unnest(reasons) AS r FROM i) GROUP BY 1, 2, 3) SELECT match_id, state, start_frame, end_frame, frames, confidence, coalesce(reasons, '') AS reasons FROM n LEFT JOIN w USING (match_id, state, g)""",
    "STR01_tumbling_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS end, event_type, count(*) AS rows FROM events GROUP BY 1, 2, 3",
    "STR02_sliding_counts": "SELECT s AS start, s + INTERVAL 2 HOUR AS end, event_type, count(*) AS rows FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1, 2, 3",
    "STR03_sessions": """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), i AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, user_id, count(*) AS rows FROM i GROUP BY user_id, g""",
}

_RECORDING = f"coalesce({D._PATH.format('source_group')}, regexp_replace({D._PATH.format('video')}, '_f[0-9]+-[0-9]+(\\.[a-z0-9]+)?$', '\\1'))"
_TAKE = f"""SELECT *, sha256(concat_ws(chr(0), '7', tier, grp, image_id::VARCHAR)) AS d FROM (SELECT {_RECORDING} AS grp, frame_index, image_id, has_ball, CASE WHEN coalesce(has_ball, false) THEN 'positive' ELSE 'negative' END AS tier FROM manifest_images) WHERE grp IS NOT NULL AND frame_index IS NOT NULL"""
_CHOICE = """{o} AS (SELECT *, row_number() OVER (ORDER BY n, k) AS i FROM {left}),
{f} AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS ch, 0::BIGINT AS have, (SELECT total FROM t) * {aim}::DOUBLE AS aim, greatest(0, (SELECT count(*) FROM {left}) - {reserve}) AS room
  UNION ALL SELECT o.i, CASE WHEN ({take}) THEN list_append(ch, k) ELSE ch END, CASE WHEN ({take}) THEN have + n ELSE have END, aim, room FROM {f} f JOIN {o} o ON o.i = f.i + 1)"""
_TAKES = "len(ch) < room AND have <> aim AND (len(ch) = 0 OR abs(aim - have - n) <= abs(aim - have))"
ORACLES |= {
    "DST07_review_gap": walk("", _TAKE, ["tier", "grp"], "d, image_id", ["frame_index", "image_id", "has_ball"], kept_unless("abs(k.frame_index - o.frame_index) < 30")).replace("fin AS (SELECT tier, grp, unnest(kept) AS x", "fin AS (SELECT tier, grp, unnest(kept) AS x, (unnest(range(len(kept))))::INTEGER AS turn")
    + """SELECT CASE tier WHEN 'positive' THEN 'verify_mask' ELSE 'verify_absence' END AS task, grp AS "group", turn, sha256(concat_ws(chr(0), '7', tier, 'group', grp)) AS group_digest, x.image_id AS image_id, x.frame_index AS frame_index, x.has_ball AS has_ball FROM fin""",
    "DST02_balanced_split": f"WITH RECURSIVE {D.MAN}, c AS (SELECT video AS k, count(*) AS n FROM img GROUP BY 1), t AS (SELECT sum(n) AS total FROM c), {_CHOICE.format(o='o1', f='f1', left='c', aim='0.1', reserve='2', take=_TAKES)}, v AS (SELECT unnest(ch) AS k FROM f1 WHERE i = (SELECT max(i) FROM f1)), c2 AS (SELECT * FROM c WHERE k NOT IN (SELECT k FROM v)), "
    f"{_CHOICE.format(o='o2', f='f2', left='c2', aim=repr(1 - 0.8 - 0.1), reserve='1', take=_TAKES)}, e AS (SELECT unnest(ch) AS k FROM f2 WHERE i = (SELECT max(i) FROM f2)) SELECT k AS video, n AS frames, CASE WHEN k IN (SELECT k FROM v) THEN 'val' WHEN k IN (SELECT k FROM e) THEN 'test' ELSE 'train' END AS split FROM c",
    "FOR01_forecasts": M._FITS + f""", b AS (SELECT ff.*, br.name, br.sign, s.range AS s, s.range * 0.25::DOUBLE AS t, br.sign * radians(38.0::DOUBLE) * s.range * 0.25::DOUBLE / 2 AS half FROM ff, (VALUES ('continue', 0.0::DOUBLE), ('turn_left', 1.0::DOUBLE), ('turn_right', -1.0::DOUBLE)) br(name, sign), range(7) s),
c AS (SELECT *, t * CASE WHEN half = 0 THEN 1 ELSE sin(half) / half END AS chord FROM b), p AS (SELECT *, field_x_m + chord * (vx * cos(half) - vy * sin(half)) AS px, field_y_m + chord * (vx * sin(half) + vy * cos(half)) AS py FROM c),
g AS (SELECT match_id, track_id, frame_index, name AS branch, min(rmse) AS rmse, avg(CASE WHEN px BETWEEN 0 AND {M._LEN} AND py BETWEEN 0 AND {M._WID} THEN 1.0::DOUBLE ELSE 0 END) AS inside, arg_max(px, s) AS ex, arg_max(py, s) AS ey FROM p GROUP BY 1, 2, 3, 4),
w AS (SELECT *, (CASE WHEN branch = 'continue' THEN 0.48::DOUBLE + 0.32::DOUBLE * exp(-rmse / 0.08::DOUBLE) ELSE (1 - 0.48::DOUBLE - 0.32::DOUBLE * exp(-rmse / 0.08::DOUBLE)) / 2 END) * greatest(0.08::DOUBLE, inside * inside) AS w FROM g)
SELECT match_id, track_id, frame_index, branch, round(w / sum(w) OVER (PARTITION BY match_id, track_id, frame_index) + 1e-8::DOUBLE, 6) AS probability, round(least(greatest(ex, 0), {M._LEN}) + 1e-8::DOUBLE, 4) AS end_x_m, round(least(greatest(ey, 0), {M._WID}) + 1e-8::DOUBLE, 4) AS end_y_m FROM w""",
}
