"""SQL of run quality: one summary row a run, and the rules, scores, claims and comparisons over it."""

from __future__ import annotations

from pitchgrid.operators.quality import DIRECTIONS, LIMITS
from pitchgrid.plans import match_queries as M
from pitchgrid.plans.fold_sql import CONFIRMED
from pitchgrid.sources.detections import BALLS, DET, FIELD, ROBOTS, sql_in

_R, _F, _B = sql_in(ROBOTS), sql_in(FIELD), sql_in(BALLS)
_BALL_PATH = M.PLACED.replace(f"class_name IN {_R}", f"class_name IN {_B}")
_PENALTY = M.ORACLES["PRJ20_penalty_samples"].removeprefix("WITH " + DET)
_SHOTS = M.ORACLES["WIN02_shots"].removeprefix("WITH " + DET)
_L = {k: f"{v}::DOUBLE" for k, v in LIMITS.items()}


def summary(det: str = DET) -> str:
    """A query of the summary; det: the CTE of the run's detections."""
    own = lambda sql: sql.removeprefix(", ")
    return f"""SELECT * FROM ({CONFIRMED.replace(DET, det)}, sp AS (SELECT match_id AS run, max(frame_index) - min(frame_index) + 1 AS span, count(DISTINCT CASE WHEN class_name IN {_F} THEN frame_index END) AS f, count(DISTINCT CASE WHEN class_name IN {_R} THEN frame_index END) AS r FROM det GROUP BY 1),
pb AS (SELECT match_id AS run, count(DISTINCT frame_index) AS b FROM play GROUP BY 1),
ow AS (SELECT match_id AS run, round(avg(CASE WHEN owner_seq IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) AS possession FROM (WITH {own(M.OWN)} SELECT * FROM own) GROUP BY 1),
ju AS (SELECT match_id AS run, round(max(sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) / (frame_index - pf)), 6) AS max_ball_jump FROM ({M._STEP.format('play', 'x')}) WHERE frame_index > pf GROUP BY 1),
un AS (SELECT match_id AS run, count(*) AS team_samples, sum(CASE WHEN team IS NOT NULL AND lower(team) <> 'unknown' THEN 1 ELSE 0 END)::BIGINT AS team_assigned,
  round(1 - round(avg(CASE WHEN team IS NOT NULL AND lower(team) <> 'unknown' THEN 1.0::DOUBLE ELSE 0 END), 6), 6) AS unknown_team FROM det WHERE class_name IN {_R} GROUP BY 1),
pa AS (SELECT match_id AS run, count(*) AS path_samples, round(avg(CASE WHEN inside_field THEN 0.0::DOUBLE ELSE 1 END), 6) AS out_of_bounds FROM (WITH {own(_BALL_PATH)} SELECT * FROM path) GROUP BY 1),
pn AS (SELECT match_id AS run, sum(samples)::BIGINT AS penalty_samples FROM (WITH {own(_PENALTY)}) GROUP BY 1),
gc AS (SELECT match_id AS run, count(*) AS goal_candidates, sum(CASE WHEN rejection_reason IS NULL THEN 1 ELSE 0 END)::BIGINT AS goals_confirmed FROM conf GROUP BY 1),
sh AS (SELECT match_id AS run, count(*) AS shots FROM (WITH {own(_SHOTS)}) GROUP BY 1)
SELECT run, coalesce(max_ball_jump, 0) AS max_ball_jump, coalesce(possession, 0) AS possession, coalesce(team_samples, 0) AS team_samples, coalesce(team_assigned, 0) AS team_assigned, coalesce(unknown_team, 0) AS unknown_team,
  coalesce(path_samples, 0) AS path_samples, coalesce(out_of_bounds, 0) AS out_of_bounds, coalesce(penalty_samples, 0) AS penalty_samples, coalesce(goal_candidates, 0) AS goal_candidates, coalesce(goals_confirmed, 0) AS goals_confirmed, coalesce(shots, 0) AS shots,
  round(coalesce(b, 0) / span, 6) AS ball_coverage, round(f / span, 6) AS field_coverage, round(r / span, 6) AS robot_coverage
FROM sp LEFT JOIN pb USING (run) LEFT JOIN ow USING (run) LEFT JOIN ju USING (run) LEFT JOIN un USING (run) LEFT JOIN pa USING (run) LEFT JOIN pn USING (run) LEFT JOIN gc USING (run) LEFT JOIN sh USING (run))"""


def _low(code: str, c: str, warn: str, fail: str | None = None) -> str:
    error = f"WHEN {c} < {_L[fail]} THEN 'error' " if fail else ""
    limit = f"CASE WHEN {c} < {_L[fail]} THEN {_L[fail]} ELSE {_L[warn]} END" if fail else _L[warn]
    return f"SELECT run, '{code}' AS code, CASE {error}WHEN {c} < {_L[warn]} THEN 'warning' END AS severity, {c}::DOUBLE AS value, {limit} AS threshold FROM s"


def _high(code: str, c: str, warn: str, fail: str, only: str = "true") -> str:
    return f"SELECT run, '{code}', CASE WHEN {c} > {_L[fail]} THEN 'error' WHEN {c} > {_L[warn]} THEN 'warning' END, {c}::DOUBLE, CASE WHEN {c} > {_L[fail]} THEN {_L[fail]} ELSE {_L[warn]} END FROM s WHERE {only}"


ISSUES = "iss AS (SELECT * FROM (" + " UNION ALL ".join([
    _low("low_ball_coverage", "ball_coverage", "min_ball_coverage", "fail_ball_coverage"), _low("low_field_coverage", "field_coverage", "min_field_coverage", "fail_field_coverage"), _low("low_robot_coverage", "robot_coverage", "min_robot_coverage"),
    _high("large_ball_jump", "max_ball_jump", "max_ball_jump", "fail_ball_jump"), _high("ball_out_of_bounds", "out_of_bounds", "max_out_of_bounds", "fail_out_of_bounds"),
    "SELECT run, 'robot_penalty_area', CASE WHEN penalty_samples > 0 THEN 'warning' END, penalty_samples::DOUBLE, 0.0::DOUBLE FROM s",
    "SELECT run, 'missing_team_evidence', CASE WHEN team_samples <= 0 THEN 'warning' END, 0.0::DOUBLE, 1.0::DOUBLE FROM s", _high("unknown_robot_teams", "unknown_team", "max_unknown_team", "fail_unknown_team", "team_samples > 0"),
    "SELECT run, 'unconfirmed_goal_candidates', CASE WHEN goal_candidates > goals_confirmed THEN 'warning' END, (goal_candidates - goals_confirmed)::DOUBLE, 0.0::DOUBLE FROM s",
]) + ") WHERE severity IS NOT NULL)"
STATUS = """st AS (SELECT s.run, coalesce(e, 0)::BIGINT AS errors, coalesce(w, 0)::BIGINT AS warnings, CASE WHEN coalesce(e, 0) > 0 THEN 'fail' WHEN coalesce(w, 0) > 0 THEN 'review' ELSE 'good' END AS status, greatest(0, 100 - 25 * coalesce(e, 0) - 10 * coalesce(w, 0))::BIGINT AS score
FROM s LEFT JOIN (SELECT run, sum(CASE WHEN severity = 'error' THEN 1 ELSE 0 END) AS e, sum(CASE WHEN severity = 'warning' THEN 1 ELSE 0 END) AS w FROM iss GROUP BY 1) USING (run))"""
CLAIMS = f"""cl AS (SELECT run, c.claim AS claim, CASE WHEN c.ok THEN 'ready' ELSE 'review' END AS status FROM (SELECT run, unnest([
  {{'claim': 'ball_tracking', 'ok': ball_coverage >= {_L['min_ball_coverage']} AND max_ball_jump <= {_L['max_ball_jump']}}}, {{'claim': 'metric_speed_trajectory', 'ok': path_samples >= {_L['min_path_samples']} AND out_of_bounds <= {_L['max_out_of_bounds']}}},
  {{'claim': 'team_possession', 'ok': team_samples > 0 AND team_assigned > 0 AND unknown_team <= {_L['max_unknown_team']} AND possession >= {_L['min_possession']}}}, {{'claim': 'goal_scoring', 'ok': goals_confirmed > 0}}, {{'claim': 'shot_pressure', 'ok': shots > 0}}]) AS c FROM s))"""
_ALL = f"WITH s AS MATERIALIZED ({summary()}), {ISSUES}, {STATUS}, {CLAIMS} "
_PLACE = "CASE status WHEN 'good' THEN 0 WHEN 'review' THEN 1 ELSE 2 END"
_STRONG = f"det0 AS ({DET.strip().removeprefix('det AS (').removesuffix(')')}), det AS (SELECT * FROM det0 WHERE score >= 0.6::DOUBLE)"


def _run(name: str, det: str) -> str:
    """s, issues, status, claims and figures of one of two runs, as one CTE each."""
    return f"{name}s AS MATERIALIZED (SELECT s.*, st.score FROM (WITH s AS MATERIALIZED ({summary(det)}), {ISSUES}, {STATUS} SELECT s.*, st.score FROM s JOIN st USING (run)) s JOIN (SELECT 1) ON true)".replace("SELECT s.*, st.score FROM (", "SELECT * FROM (", 1).replace(" s JOIN (SELECT 1) ON true", "")


def _figures(name: str) -> str:
    return f"(SELECT run, unnest([{', '.join(repr(m) for m in DIRECTIONS)}]) AS metric, unnest([{', '.join(f'{m}::DOUBLE' for m in DIRECTIONS)}]) AS v FROM {name}s)"


_LESS = ", ".join(repr(m) for m, way in DIRECTIONS.items() if way < 0)
_GAIN = f"(b.v - a.v) * CASE WHEN metric IN ({_LESS}) THEN -1 ELSE 1 END"
_TWO = f"""WITH {_run('a', DET)}, {_run('b', _STRONG)}, cmp AS (SELECT run, metric, round(a.v, 6) AS baseline, round(b.v, 6) AS candidate, round(b.v - a.v, 6) AS delta,
  CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'missing' WHEN {_GAIN} > 1e-9::DOUBLE THEN 'improved' WHEN {_GAIN} < -1e-9::DOUBLE THEN 'regressed' ELSE 'unchanged' END AS outcome FROM {_figures('a')} a FULL JOIN {_figures('b')} b USING (run, metric)),
ra AS (SELECT run, claim FROM (WITH s AS (SELECT * FROM as), {CLAIMS} SELECT * FROM cl) WHERE status = 'ready'), rb AS (SELECT run, claim FROM (WITH s AS (SELECT * FROM bs), {CLAIMS} SELECT * FROM cl) WHERE status = 'ready'),
chg AS (SELECT run, claim, CASE WHEN ra.claim IS NULL THEN 'gained' WHEN rb.claim IS NULL THEN 'lost' ELSE 'kept' END AS change FROM (SELECT *, claim AS c FROM ra) ra FULL JOIN (SELECT *, claim AS c FROM rb) rb USING (run, claim))
""".replace("FROM as)", "FROM as_)").replace("as AS MATERIALIZED", "as_ AS MATERIALIZED").replace("FROM as)", "FROM as_)")
_TWO = _TWO.replace("ra.claim IS NULL", "ra.c IS NULL").replace("rb.claim IS NULL", "rb.c IS NULL")

ORACLES = {
    "QA01_run_summary": summary(),
    "QA01_coverage": f"SELECT run, ball_coverage, field_coverage, robot_coverage, max_ball_jump, unknown_team, possession FROM ({summary()})",
    "QA02_issues": _ALL + "SELECT * FROM iss",
    "QA03_status": _ALL + "SELECT * FROM st",
    "QA04_claims": _ALL + "SELECT * FROM cl",
    "TOP05_ranked_runs": _ALL + f"SELECT (row_number() OVER (ORDER BY {_PLACE}, score DESC, run))::INTEGER AS place, run, status, score FROM st",
    "TOP06_showcase": _ALL + f"SELECT run, coalesce(ready, 0) AS ready, status, score FROM st LEFT JOIN (SELECT run, count(*) AS ready FROM cl WHERE status = 'ready' GROUP BY 1) USING (run) ORDER BY coalesce(ready, 0) DESC, {_PLACE}, score DESC, run LIMIT 12",
    "QA06_missing_claims": _ALL + "SELECT run, coalesce(string_agg(CASE WHEN status <> 'ready' THEN claim END, ',' ORDER BY claim), '') AS missing FROM cl GROUP BY 1",
    "QA05_comparison": _TWO + "SELECT * FROM cmp",
    "SET03_claim_changes": _TWO + "SELECT * FROM chg",
    "QA05_verdicts": _TWO + """, f AS (SELECT run, sum(CASE WHEN outcome = 'improved' THEN 1 ELSE 0 END)::BIGINT AS up, sum(CASE WHEN outcome = 'regressed' THEN 1 ELSE 0 END)::BIGINT AS down FROM cmp WHERE metric <> 'score' GROUP BY 1),
g AS (SELECT run, sum(CASE WHEN change = 'gained' THEN 1 ELSE 0 END)::BIGINT AS gained, sum(CASE WHEN change = 'lost' THEN 1 ELSE 0 END)::BIGINT AS lost FROM chg GROUP BY 1),
v AS (SELECT f.run, up, down, coalesce(gained, 0) AS gained, coalesce(lost, 0) AS lost, c.delta AS score_delta FROM f JOIN (SELECT run, delta FROM cmp WHERE metric = 'score') c USING (run) LEFT JOIN g USING (run))
SELECT *, CASE WHEN lost > 0 OR score_delta < 0 THEN CASE WHEN gained > 0 THEN 'mixed' ELSE 'regressed' END WHEN gained > 0 OR score_delta > 0 THEN CASE WHEN down = 0 THEN 'improved' ELSE 'mixed' END
  WHEN up > 0 AND down > 0 THEN 'mixed' WHEN up > 0 THEN 'improved' WHEN down > 0 THEN 'regressed' ELSE 'unchanged' END AS verdict FROM v""",
}
