"""Hand-made rows with known results for the match operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import Box, Pitch, iou, mirror_box
from pitchgrid.operators import dataset, events, field, filters, folds, gamestate, possession, quality, tracking
from pitchgrid.operators.evaluation import average_precision
from pitchgrid.sources.detections import GOALS, read_detections, typed

RAW = "det_id long, match_id string, frame_index long, class_name string, score double, box array<double>, prompt string, object_id string, track_id long, team string, mask_path string, area double, extra string"


def det(spark, *rows):
    """(class, frame, box, track, team, score, area, extra), all after box optional."""
    out = []
    for i, r in enumerate(rows):
        cls, frame, box, track, team, score, area, extra = [*r, *[None] * (8 - len(r))]
        out.append((i, "m", frame, cls, 0.9 if score is None else score, [float(v) for v in box], None, None, track, team, None, area, extra))
    return typed(spark.createDataFrame(out, RAW))


def seqs(df):
    return sorted(r.det_seq for r in df.collect())


def test_typed_rows(spark):
    rows = [
        (1, "m", 0, " Ball", 0.5, [1.0, 2.0, 3.0, 4.0], None, None, None, None, None, None, '{"source": "a", "extent": 0.5, "mask_index": 3}'),
        (2, "m", 0, "BALL", 0.5, [1.0, 2.0, 3.0, 4.0], None, None, 7, None, None, None, None),
        (3, "m", 0, "ball", float("nan"), [1.0, 2.0, 3.0, 4.0], None, None, None, None, None, None, None),
        (4, "m", 0, "ball", 0.5, [1.0, 2.0, 3.0], None, None, None, None, None, None, None),
        (5, "m", 0, "ball", 0.5, [1.0, 2.0, 3.0, float("inf")], None, None, None, None, None, None, "broken"),
        (6, None, 0, "ball", 0.5, [1.0, 2.0, 3.0, 4.0], None, None, None, None, None, None, None),
    ]
    got = typed(spark.createDataFrame(rows, RAW)).collect()
    assert [(r.det_seq, r.class_name, r.source, r.extent, r.mask_index, r.cx) for r in got] == [(1, "ball", "a", 0.5, 3, 2.0)]


def test_json_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"frame_index": 3, "class_name": "ball", "box": [1, 2, 3, 4]}\n\n{"frame_index": 4, "class_name": "ball", "score": 0.5, "box": [1, 2, 3]}\nnot json\n')
    rows = {r.frame_index: r for r in read_detections(spark, str(tmp_path / "a.json"), strict=False).collect()}
    assert rows[3].score == 1.0 and rows[3].problem is None and rows[4].problem == "box" and rows[None].problem == "broken_line"
    with pytest.raises(Exception, match="bad"):
        read_detections(spark, str(tmp_path / "a.json")).collect()


def test_possession_and_passes(spark):
    d = det(spark, ("ball", 0, (10, 10, 14, 14), 10), ("robots", 0, (0, 0, 20, 20), 1, "allied"), ("ball", 1, (100, 10, 104, 14), 10), ("robots", 1, (90, 0, 110, 20), 2, "allied"), ("field", 2, (0, 0, 9, 9)))
    owned = possession.possession(d, 30)
    assert {r.frame_index: r.owner_track for r in owned.collect()} == {0: 1, 1: 2, 2: None}
    assert [(r.event_type, r.from_track, r.to_track) for r in possession.owner_changes(owned).collect()] == [("pass", 1, 2)]
    teams = det(spark, *[x for f, t in enumerate(("blue", "blue", "yellow")) for x in (("ball", f, (10, 10, 14, 14)), ("robots", f, (10, 10, 20, 20), 1, t))])
    owned = possession.possession(teams, 25)
    assert {(r.team, r.frames, r.seconds) for r in possession.by_team(owned, 10.0).collect()} == {("blue", 2, 0.2), ("yellow", 1, 0.1)}
    top = possession.dominance(owned).first()
    assert (top.team, top.ratio, top.margin) == ("blue", 0.666667, 0.333333)
    assert [(r.start_frame, r.frames) for r in possession.streaks(owned).collect()] == [(0, 3)]


def test_collision_and_shot(spark):
    d = det(spark, ("robots", 0, (0, 0, 20, 20), 1), ("robots", 0, (10, 0, 30, 20), 2), ("robots", 0, (200, 0, 220, 20), 3))
    assert [(r.track_a, r.track_b) for r in possession.collisions(d, 25).collect()] == [(1, 2)]
    rows = [("field", f, (0, 0, 100, 50)) for f in (0, 1)] + [("ball", 0, (82, 10, 88, 16)), ("ball", 1, (93, 10, 99, 16))]
    assert [(r.target_side, r.shooting_team, r.actor) for r in events.shots(det(spark, *rows), 100, 0.1).collect()] == [("right", "yellow", -1)]
    back = rows[:2] + [("ball", 1, (82, 10, 88, 16)), ("ball", 0, (93, 10, 99, 16))]
    assert events.shots(det(spark, *back), 100, 0.1).collect() == []
    assert events.shots(det(spark, ("ball", 0, (5, 200, 9, 204)), ("ball", 1, (40, 200, 44, 204))), 100).collect() == []


def goal_rows(source=None, spots=((40, 35, 46, 41), (14, 35, 20, 41), (10, 35, 16, 41))):
    extra = None if source is None else f'{{"source": "{source}"}}'
    return [x for f, b in enumerate(spots) for x in (("field", f, (0, 0, 100, 100)), ("goal_blue", f, (0, 20, 25, 60), None, None, 0.9, None, extra), ("ball", f, b, 5))]


def test_goals(spark):
    one = det(spark, ("field", 0, (0, 0, 100, 100)), ("ball", 0, (12, 12, 18, 18)), ("goal_blue", 0, (0, 0, 30, 30)))
    assert [(r.goal_side, r.scoring_team) for r in events.goal_candidates(one).collect()] == [("blue", "yellow")]
    for source, want in ((None, ("goal_confirmed", None, 2)), ("goal_geometry", ("goal_rejected", "geometry_only_goal", 2))):
        d = det(spark, *goal_rows(source))
        assert [(r.event_type, r.rejection_reason, r.inside_frames) for r in events.confirmed_goals(d, events.goal_candidates(d)).collect()] == [want]
    d = det(spark, *goal_rows(spots=((14, 35, 20, 41),)))
    assert [r.rejection_reason for r in events.confirmed_goals(d, events.goal_candidates(d)).collect()] == ["missing_entry_history"]


def test_calibrated_crossing(spark):
    line = ((10.0, 0.0), (10.0, 100.0))

    def run(rows, wall=((4.0, 0.0), (4.0, 100.0)), **kw):
        got = tracking.calibrated_crossings(det(spark, *rows), line, wall, side="blue", **kw).collect()
        return sorted((r.frame_index, r.event_type, r.rejection_reason, r.crossing_frame, r.inside_frames, r.actor, r.confidence) for r in got)

    path = lambda xs, track=10, first=0, y=50: [("ball", first + f, (x - 1, y - 1, x + 1, y + 1), track) for f, x in enumerate(xs)]
    assert run(path([20, 15, 11, 9, 7, 5])) == [(5, "goal_confirmed", None, 3, 3, 10, 0.8)]
    assert run(path([20, 15, 9, 13]), need=2) == []  # one sample inside
    assert run(path([20, 15, 11, 9, 8, 7, 6]), ((-10.0, 0.0), (-10.0, 100.0))) == [(3, "goal_rejected", "missing_back_wall_contact", 3, 4, 10, 0.7)]
    assert run(path([20, 15, 11, 9, 8, 7, 6, 6, 6, 5])) == [(6, "goal_confirmed", None, 3, 6, 10, 0.92)]  # six samples count at most
    assert run(path([20, 15, 11, 9, 7, 5], y=150)) == []  # beside the line
    assert run(path([20, 15, 11, 9, 7, 5]), ((4.0, 900.0), (4.0, 1000.0)))[0][1] == "goal_rejected"  # the wall's segment is elsewhere
    assert run(path([20, 15, 10, 7, 6, 5]))[0][3] == 3  # a sample on the line is outside
    two = path([20, 15, 11, 9, 7, 5]) + path([20, 15, 11, 9, 7, 5], 11, 40) + path([20, 11, 9, 8, 20, 11, 9, 7, 5], None, 90)
    assert [(r[0], r[5]) for r in run(two)] == [(5, 10), (45, 11), (98, -1)]
    for block in (2, 7):
        assert run(two, block=block) == run(two)
    with pytest.raises(ValueError):
        run(path([1]), ((1.0, 1.0), (1.0, 1.0)))


def test_previous_ball_crosses_buckets(spark):
    d = det(spark, *[("ball", f, (f, 0, f + 2, 2), 1) for f in (0, 7, 9, 30)], ("ball", 8, (50, 0, 52, 2), 2))
    got = {r.frame_index: (r.previous_frame, r.moved_px) for r in events.previous_balls(d).collect()}
    assert got == {7: (0, 7.0), 9: (7, 2.0)}


def test_states(spark):
    dead = det(spark, ("field", 0, (0, 0, 100, 60)), ("ball", 0, (150, 150, 154, 154)))
    assert [(r.state, r.reasons) for r in gamestate.frame_states(dead).collect()] == [("dead_ball", ["ball_out_of_play"])]
    human = det(spark, ("field", 0, (0, 0, 100, 60)), ("person", 0, (10, 10, 30, 50)), ("ball", 0, (40, 20, 44, 24)))
    assert [(r.state, r.confidence) for r in gamestate.frame_states(human).collect()] == [("human_intervention", 0.8)]
    assert [r.event_type for r in gamestate.entry_events(gamestate.frame_states(human)).collect()] == ["human_intervention"]
    gone = det(spark, ("robots", 0, (0, 0, 9, 9), 7), *[("ball", f, (5, 5, 8, 8)) for f in range(3)])
    assert [(r.track_id, r.frame_index) for r in gamestate.robots_removed(gone, 2).collect()] == [(7, 2)]
    still = det(spark, *[("robots", f, (10, 10, 30, 30), 7) for f in range(4)], *[("ball", f, (5 * f, 5, 5 * f + 3, 8)) for f in range(4)])
    assert [(r.track_id, r.frame_index) for r in gamestate.robots_disabled(still, 3, 1.0).collect()] == [(7, 3)]
    two = det(spark, ("field", 0, (0, 0, 99, 99)), ("field", 1, (0, 0, 99, 99)), ("ball", 0, (5, 5, 8, 8)), ("ball", 1, (300, 5, 303, 8)))
    assert sorted((r.start_frame, r.state) for r in gamestate.segments(gamestate.frame_states(two)).collect()) == [(0, "in_play"), (1, "dead_ball")]
    lost = det(spark, ("ball", 0, (5, 5, 8, 8)), ("robots", 20, (0, 0, 9, 9)))
    states = {r.frame_index: r.state for r in gamestate.frame_states(lost, missing=12).collect()}
    assert len(states) == 21 and states[11] == "in_play" and states[12] == "dead_ball"


def test_filters(spark):
    d = det(spark, ("ball", 0, (0, 20, 10, 30)), ("ball", 0, (20, 20, 30, 30)), ("robots", 0, (0, 20, 10, 30)))
    assert seqs(filters.edge_balls_removed(d, 100, 100)) == [1, 2]
    d = det(spark, ("field", 0, (0, 0, 200, 120)), ("robots", 0, (50, 40, 110, 100)), ("ball", 0, (60, 60, 80, 70)), ("ball", 0, (140, 60, 150, 70)))
    assert {r.det_seq: r.reason for r in filters.ball_context_reason(d).collect()} == {2: "robot_overlap", 3: None}
    d = det(spark, ("hand", 0, (90, 40, 110, 70)), ("ball", 0, (105, 60, 115, 70)), ("ball", 1, (105, 60, 115, 70)))
    assert {r.det_seq: r.reason for r in filters.ball_context_reason(d).collect()} == {1: None, 2: "outside_context"}
    e = '{"source": "color_robots", "extent": %s}'
    d = det(spark, ("robots", 0, (0, 0, 60, 60), None, None, 0.9, 3200.0, e % 0.78), ("robots", 0, (100, 0, 170, 80), None, None, 0.9, 5200.0, e % 0.61), ("robots", 0, (200, 0, 210, 10)))
    assert {r.det_seq: r.x for r in d.select("det_seq", filters.artifact_reason(3500, 15000, 0.72, 1.75).alias("x")).collect()} == {0: "fallback_area", 1: None, 2: None}


def robots_kept(spark, rows, near=(), **options):
    d = det(spark, *[("robots", 0, b, t, None, s, a, x) for b, t, s, a, x in rows])
    d = d.select("match_id", "frame_index", "det_seq", "track_id", "score", "x1", "y1", "x2", "y2", "area", "source")
    kept = folds.suppress_robots(d, None, F.col("track_id").isin(list(near) or [-1]), F.coalesce(F.col("source") == "color_robots", F.lit(False)), **options)
    return sorted(r.track_id for r in kept.collect())


def test_suppression(spark):
    d = det(spark, ("robots", 0, (10, 10, 20, 20), None, None, 0.5), ("robots", 0, (10, 10, 20, 20), None, None, 0.9), ("ball", 0, (10, 10, 20, 20), None, None, 0.4))
    assert seqs(folds.suppress(d, 0.9)) == [1, 2]
    r = lambda b, t, s, x=None: (b, t, s, None, x)
    assert robots_kept(spark, [r((10, 10, 60, 60), 1, 0.9), r((14, 14, 56, 56), 2, 0.7), r((120, 10, 170, 60), 3, 0.88), r((220, 10, 270, 60), 4, 0.4)], max_per_frame=2, min_area=100) == [1, 3]
    assert robots_kept(spark, [r((10, 10, 40, 40), 1, 0.9), r((42, 12, 72, 42), 2, 0.8), r((140, 10, 170, 40), 3, 0.7)], max_iou=0.95, max_contained=0.95, min_centre=45) == [1, 3]
    assert robots_kept(spark, [r((10, 10, 40, 40), 1, 0.95), r((90, 10, 120, 40), 2, 0.93), r((205, 190, 245, 230), 3, 0.55)], near=[3], max_per_frame=2) == [1, 3]
    assert robots_kept(spark, [r((100, 100, 260, 300), 1, 0.9), r((215, 245, 285, 305), 2, 0.8), r((500, 100, 650, 300), 3, 0.7)], centre_ratio=0.55) == [1, 3]
    assert robots_kept(spark, [r((100, 100, 260, 300), 1, 0.5), r((210, 245, 280, 305), 2, 0.85, '{"source": "color_robots"}')], max_per_frame=1) == [1]
    rng = np.random.default_rng(0)
    many = det(spark, *[("robots", 0, (x, y, x + 40, y + 40), None, None, round(float(s), 4)) for x, y, s in zip(rng.integers(0, 300, 80), rng.integers(0, 300, 80), rng.random(80))])
    kept = folds.suppress(many, 0.3)
    a, b = kept.alias("a"), kept.alias("b")
    pairs = a.join(b, F.col("a.det_seq") < F.col("b.det_seq")).select(iou(Box(*[F.col(f"a.{c}") for c in ("x1", "y1", "x2", "y2")]), Box(*[F.col(f"b.{c}") for c in ("x1", "y1", "x2", "y2")])).alias("i"))
    assert pairs.agg(F.max("i")).first()[0] < 0.3


def test_cooldowns(spark):
    e = spark.createDataFrame([("m", "shot", 10, 0.5), ("m", "shot", 14, 0.8), ("m", "shot", 30, 0.6)], "match_id string, event_type string, frame_index long, confidence double")
    once = folds.cooled(e, ["match_id", "event_type"], F.lit(12), ["frame_index", "confidence"], "confidence").select(*e.columns)
    assert sorted(r.frame_index for r in once.collect()) == [14, 30]
    again = folds.cooled(once, ["match_id", "event_type"], F.lit(12), ["frame_index", "confidence"], "confidence")
    assert sorted(r.frame_index for r in again.collect()) == [14, 30]
    assert sorted(r.frame_index for r in folds.spaced(e, ["match_id", "event_type"], "frame_index", 5, 2).collect()) == [10, 30]


def test_clusters(spark):
    d = det(spark, ("robots", 0, (0, 0, 10, 10), None, None, 0.9), ("robots", 0, (20, 0, 30, 10), None, None, 0.8), ("robots", 0, (200, 0, 210, 10), None, None, 0.7))
    assert sorted((r.x1, r.x2, r.parts) for r in folds.clusters(d, ["match_id", "frame_index"], 32.0).collect()) == [(0.0, 30.0, 2), (200.0, 210.0, 1)]


def test_trackers(spark):
    d = det(spark, ("robots", 0, (0, 0, 10, 10)), ("robots", 1, (1, 0, 11, 10)), ("ball", 1, (1, 0, 11, 10)), ("robots", 30, (1, 0, 11, 10)))
    ids = {r.det_seq: r.track_id for r in tracking.track(d, 0.2).collect()}
    assert ids[0] == ids[1] and len({ids[0], ids[2], ids[3]}) == 3 and min(ids.values()) == 1
    moving = det(spark, *[x for f in range(12) for x in (("robots", f, (10 * f, 0, 10 * f + 40, 40), None, None, 0.9 if f % 3 else 0.3), ("robots", f, (400 - 10 * f, 200, 440 - 10 * f, 240), None, None, 0.8))])
    assert len({r.track_id for r in tracking.byte_track(moving).where("frame_index > 0").collect()}) == 2
    cost = np.array([[4.0, 1, 3], [2, 0, 5], [3, 2, 2]])
    assert sum(cost[i, j] for i, j in tracking.assign(cost)) == 5 and len(tracking.assign(cost[:2])) == 2 and len(tracking.assign(cost[:, :1])) == 1


def test_ball_path(spark):
    d = det(spark, ("ball", 0, (10, 10, 20, 20), None, None, 0.8), ("ball", 1, (300, 300, 310, 310), None, None, 0.9), ("ball", 1, (12, 10, 22, 20), None, None, 0.7), ("ball", 2, (14, 10, 24, 20), None, None, 0.8))
    path = {r.frame_index: r.det_seq for r in tracking.ball_path(d, 650.0, jump=30).collect()}
    assert path == {0: 0, 1: 2, 2: 3}


def test_steady_goals(spark):
    d = det(spark, ("goal_blue", 0, (20, 130, 60, 150)), ("goal_blue", 1, (24, 126, 64, 154)), ("goal_blue", 2, (120, 30, 150, 120)), ("goal_blue", 9, (0, 0, 10, 10)))
    got = {r.frame_index: (r.x1, r.y1, r.x2, r.y2, r.replaced) for r in tracking.steady_goals(d, GOALS, 0.25, 30).collect()}
    assert got == {0: (20, 130, 60, 150, False), 1: (21, 129, 61, 151, False), 2: (21, 129, 61, 151, True), 9: (0, 0, 10, 10, False)}


def test_mirror(spark):
    d = spark.createDataFrame([(10.0, 20.0, 30.0, 60.0, 160.0, 80.0), (20.0, 10.0, 60.0, 30.0, 80.0, 160.0)], "x1 double, y1 double, x2 double, y2 double, w double, h double")
    m = mirror_box(Box.of(), Box(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h")))
    assert [tuple(r) for r in d.select(m.x1, m.y1, m.x2, m.y2).collect()] == [(130, 20, 150, 60), (20, 130, 60, 150)]


def test_field(spark):
    pitch = Pitch.fit([(0, 0), (100, 0), (100, 50), (0, 50)], [(0, 0), (2, 0), (2, 1), (0, 1)], 2.0, 1.0)
    d = det(spark, ("ball", 0, (20, 20, 30, 30), 1), ("ball", 10, (70, 20, 80, 30), 1))
    path = field.placed(d, pitch, 2, 4)
    assert sorted((r.field_x_m, r.field_y_m, r.grid_row, r.grid_col, r.zone) for r in path.collect()) == [(0.5, 0.5, 1, 1, "r2c2"), (1.5, 0.5, 1, 3, "r2c4")]
    t = field.travelled(path, ["frame_index", "det_seq"], 10.0).first()
    assert (t.metres, t.mean_m_s, t.steps) == (1.0, 1.0, 1)
    with pytest.raises(ValueError):
        Pitch.fit([(0, 0)], [(0, 0)], 1, 1)
    q = quality.calibration_quality([(0, 0), (100, 0), (100, 50), (0, 50)], [(0, 0), (2, 0), (2, 1), (0, 1)], pitch, 200, 100)
    assert q["status"] == "good" and q["area_px"] == 5000 and q["convex"]


def test_forecast(spark):
    pitch = Pitch((1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0), 2.43, 1.82)
    rows = spark.createDataFrame([("m", 1, f, 0.4 + 0.01 * f, 0.8, f) for f in range(20)], "match_id string, track_id long, frame_index long, field_x_m double, field_y_m double, __order long")
    fit = field.motion_fits(rows, fps=10.0).where("frame_index = 19")
    r = fit.first()
    assert abs(math.hypot(r.vx, r.vy) - 0.1) < 1e-9 and r.rmse < 1e-9 and r.samples == 19
    out = {r.branch: r for r in field.forecasts(fit, pitch).collect()}
    assert set(out) == {"continue", "turn_left", "turn_right"} and abs(sum(r.probability for r in out.values()) - 1) < 1e-5 and max(out.values(), key=lambda r: r.probability).branch == "continue"
    assert abs(out["continue"].end_x_m - (0.59 + 0.15)) < 1e-4
    w = math.radians(38)
    assert abs(out["turn_left"].end_x_m - (0.59 + 0.1 / w * math.sin(1.5 * w))) < 1e-3
    assert field.motion_fits(rows.where("frame_index < 5")).collect() == []


def test_teams(spark):
    d = det(spark, ("robots", 0, (0, 0, 9, 9), 7, "blue"), ("robots", 1, (0, 0, 9, 9), 7, "unknown"), ("robots", 2, (0, 0, 9, 9), 7, "yellow"), ("robots", 3, (0, 0, 9, 9), 7, "blue"))
    t = quality.track_teams(d, 0.8).first()
    assert (t.samples, t.assigned, t.dominant_team, t.ambiguous, t.resolved_team) == (4, 3, "blue", True, "unknown")
    assert sorted((r.from_frame, r.to_frame) for r in quality.team_changes(d).collect()) == [(0, 2), (2, 3)]


def test_two_means(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.95, 0.05, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.05, 0.95, 0.0]), (5, [0.0, 0.0, 0.0])]
    got = {r.k: r.cluster for r in quality.two_means(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v").collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}
    assert quality.two_means(spark.createDataFrame([], "k long, v array<double>"), "k", "v").collect() == []


def test_precision(spark):
    t = spark.createDataFrame([(1, "a", 0.0, 0.0, 10.0, 10.0), (1, "a", 20.0, 0.0, 30.0, 10.0), (2, "a", 0.0, 0.0, 10.0, 10.0), (1, "b", 0.0, 0.0, 10.0, 10.0)], "image_id long, category string, x1 double, y1 double, x2 double, y2 double")
    scored = t.withColumn("score", F.lit(0.9))
    assert {(r.category, r.ap, r.ar100, r.ap_small, r.ap_large) for r in average_precision(t, scored).collect()} == {("a", 1.0, 1.0, 1.0, None), ("b", 1.0, 1.0, 1.0, None), (None, 1.0, 1.0, 1.0, None)}
    half = scored.where("category = 'a' and x1 = 0").unionByName(scored.where("category = 'a' and x1 = 20").withColumn("x1", F.lit(24.0)).withColumn("score", F.lit(0.99)))
    r = {r.category: r for r in average_precision(t, half).collect()}
    # The false first box halves precision until both true ones are found: 2/3 at recall 2/3; at 0.5 the moved box (IoU .6) still counts.
    assert r["a"].ap50 == 1.0 and abs(r["a"].ap75 - 67 / 101 * 2 / 3) < 1e-5 and r["b"].ap == 0.0


def coco(truth, predicted, category, least, most, top):
    """(AP per overlap, recall per overlap) of one category and size, box by box and point by point."""
    images = {p[0] for p in predicted}
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    out = []
    for t in np.linspace(0.5, 0.95, 10):
        marks, n = [], 0
        for image in images:
            gts = [g[2:6] for g in truth if g[0] == image and g[1] == category]
            n += sum(least <= area(g) <= most for g in gts)
            free = set(range(len(gts)))
            for p in sorted((p for p in predicted if p[0] == image and p[1] == category), key=lambda p: (-p[6], p[2], p[3]))[:top]:
                def iou(g, b=p[2:6]):
                    w, h = max(0, min(g[2], b[2]) - max(g[0], b[0])), max(0, min(g[3], b[3]) - max(g[1], b[1]))
                    return w * h / (area(g) + area(b) - w * h)

                fits = [(least <= area(gts[j]) <= most, iou(gts[j]), -j) for j in free if iou(gts[j]) >= t - 1e-9]
                if fits:
                    own, _, j = max(fits)
                    free.remove(-j)
                    if own:
                        marks.append((p[6], 1))
                elif least <= area(p[2:6]) <= most:
                    marks.append((p[6], 0))
        if not n:
            return None
        curve, tp, all_ = [], 0, 0
        for s in sorted({m[0] for m in marks}, reverse=True):  # equal scores are one step
            tp, all_ = tp + sum(m[1] for m in marks if m[0] == s), all_ + sum(m[0] == s for m in marks)
            curve.append((tp / n, tp / all_))
        out.append((sum(max((q for r, q in curve if r >= k / 100 - 1e-9), default=0.0) for k in range(101)) / 101, tp / n))
    return out


def test_all_twelve_figures(spark):
    rng = np.random.default_rng(8)
    truth, predicted = [], []
    for image in range(14):
        for c in "ab":
            for _ in range(int(rng.integers(0, 5))):
                x, y, w, h = *rng.uniform(0, 300, 2), *rng.choice([12.0, 50.0, 140.0], 2)
                truth.append((image, c, x, y, x + w, y + h))
                if rng.random() < 0.8:
                    dx, dy = rng.normal(0, 4, 2)
                    predicted.append((image, c, x + dx, y + dy, x + w + dx, y + h, round(float(rng.random()), 2)))
        if image != 3:
            predicted += [(image, "a", x := float(rng.uniform(0, 300)), 10.0, x + 30, 50.0, round(float(rng.random()), 2)) for _ in range(12)]
    cols = "image_id long, category string, x1 double, y1 double, x2 double, y2 double"
    rows = lambda v: [tuple(float(a) if isinstance(a, np.floating) else a for a in r) for r in v]
    df, pf = spark.createDataFrame(rows(truth), cols), spark.createDataFrame(rows(predicted), cols + ", score double")
    for bins in (4096, 3):
        got = {r.category: r for r in average_precision(df, pf, bins).collect()}
        sizes = {"": (0, 1e10), "_small": (0, 1024), "_medium": (1024, 9216), "_large": (9216, 1e10)}
        want = {}
        for c in "ab":
            for name, (least, most) in sizes.items():
                r = coco(truth, predicted, c, least, most, 100)
                want[c, f"ap{name}"], want[c, f"ar{name or 100}"] = np.mean([a for a, _ in r]), np.mean([b for _, b in r])
            r = coco(truth, predicted, c, 0, 1e10, 100)
            want[c, "ap50"], want[c, "ap75"] = r[0][0], r[5][0]
            want |= {(c, f"ar{m}"): np.mean([b for _, b in coco(truth, predicted, c, 0, 1e10, m)]) for m in (1, 10)}
        for (c, name), v in want.items():
            assert abs(got[c][name] - v) < 2e-6, (c, name)
            assert abs(got[None][name] - (want["a", name] + want["b", name]) / 2) < 2e-6
    assert average_precision(df.limit(0), pf.limit(0)).collect() == []


def test_governance(spark):
    counts = [("a", 10), ("b", 20), ("c", 70)]
    assert dataset.balanced_splits(counts) == {"a": "val", "b": "test", "c": "train"}
    assert dataset.balanced_splits([("a", 5)]) == {"a": "train"}
    rows = spark.createDataFrame([("v", 1.0, 2.0, 3.0, 4.0, 10, 10), ("v", 1.0, 2.0, 11.0, 4.0, 10, 10), ("v", 1.0, -1.0, 3.0, 4.0, 10, 10), ("v", float("nan"), 2.0, 3.0, 4.0, 10, 10), ("v", 3.0, 2.0, 3.0, 4.0, 10, 10), ("v", None, 2.0, 3.0, 4.0, 10, 10)], "k string, x1 double, y1 double, x2 double, y2 double, width int, height int")
    assert [r[0] for r in rows.select(dataset.box_problem()).collect()] == [None, "outside_width", "outside_height", "malformed_box", "non_positive_box", "malformed_box"]
    with pytest.raises(ValueError):
        dataset.hash_split(F.col("k"), 0.9, 0.2)


def summary(spark, **changes):
    base = {"run": "r", "ball_coverage": 0.7, "field_coverage": 0.95, "robot_coverage": 0.6, "max_ball_jump": 30.0, "out_of_bounds": 0.0, "penalty_samples": 0, "team_samples": 10, "team_assigned": 8, "unknown_team": 0.2, "possession": 0.5, "path_samples": 20, "goal_candidates": 0, "goals_confirmed": 0, "shots": 1, "score": 80}
    return spark.createDataFrame([base | changes])


def test_quality(spark):
    s = summary(spark, ball_coverage=0.2, max_ball_jump=50.0, goal_candidates=2)
    assert {(r.severity, r.code) for r in quality.issue_rows(s).collect()} == {("error", "low_ball_coverage"), ("warning", "large_ball_jump"), ("warning", "unconfirmed_goal_candidates")}
    r = quality.run_status(s.drop("score")).first()
    assert (r.status, r.score) == ("fail", 55)
    better = quality.verdicts(summary(spark), summary(spark, ball_coverage=0.9, max_ball_jump=20.0, score=90)).first()
    assert (better.verdict, better.gained) == ("improved", 1)
    assert quality.verdicts(summary(spark, ball_coverage=0.9, score=90), summary(spark)).first().verdict == "regressed"
    assert quality.verdicts(summary(spark), summary(spark)).first().verdict == "unchanged"
