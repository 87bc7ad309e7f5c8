"""The geometry as SQL functions, for queries written in SQL: expressions that Catalyst takes apart like any other."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pitchgrid.functions.geometry import Pitch

_A, _B = (", ".join(f"{p}{c} DOUBLE" for c in ("x1", "y1", "x2", "y2")) for p in "ab")
_SHARED = "(greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1)))"
_SIZE = "(greatest(0D, {0}x2 - {0}x1) * greatest(0D, {0}y2 - {0}y1))"


def register(spark: SparkSession, pitch: Pitch | None = None) -> list[str]:
    """box_iou, box_containment and, where a pitch is given, project_x, project_y and the table function forecast_points as temporary functions of the session."""
    made = {
        f"box_iou({_A}, {_B}) RETURNS DOUBLE": f"CASE WHEN {_SHARED} <= 0 THEN 0D ELSE {_SHARED} / ({_SIZE.format('a')} + {_SIZE.format('b')} - {_SHARED}) END",
        f"box_containment({_A}, {_B}) RETURNS DOUBLE": f"coalesce({_SHARED} / nullif(least({_SIZE.format('a')}, {_SIZE.format('b')}), 0D), 0D)",
    }
    if pitch:
        m = [f"({v!r}D)" for v in pitch.matrix]
        depth = f"(px * {m[6]} + py * {m[7]} + {m[8]})"
        for name, row in (("project_x", 0), ("project_y", 3)):
            made[f"{name}(px DOUBLE, py DOUBLE) RETURNS DOUBLE"] = f"CASE WHEN abs({depth}) >= 1e-9D THEN (px * {m[row]} + py * {m[row + 1]} + {m[row + 2]}) / {depth} END"
        made["forecast_points(x DOUBLE, y DOUBLE, vx DOUBLE, vy DOUBLE, horizon DOUBLE, steps INT) RETURNS TABLE(t DOUBLE, px DOUBLE, py DOUBLE)"] = "SELECT horizon * k / steps, x + vx * horizon * k / steps, y + vy * horizon * k / steps FROM (SELECT explode(sequence(0, steps)) AS k)"
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in made]
