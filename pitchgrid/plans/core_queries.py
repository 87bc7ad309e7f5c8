"""Queries of the general data problems (1 and 2) over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.operators.intervals import canonical_label, continuous_periods
from pitchgrid.operators.spikes import implausible_positions, implausible_speeds
from pitchgrid.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "game_segments").withColumn("state", canonical_label("state")).where("match_id is not null and state is not null")
    return continuous_periods(segments, ["match_id", "state"], "start_frame", "end_frame")


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per match and state: number of periods and gaps, frames covered and left out."""
    found = p1_found(spark, sf_dir).withColumn("frames", F.expr("end_frame - start_frame + 1"))
    n = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0))
    return found.groupBy("match_id", "state").agg(n("period", F.lit(1)).alias("periods"), n("gap", F.lit(1)).alias("gaps"), n("period", F.col("frames")).alias("covered_frames"), n("gap", F.col("frames")).alias("gap_frames"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = implausible_positions(table(spark, sf_dir, "field_path"), table(spark, sf_dir, "cameras"))
    speeds = implausible_speeds(table(spark, sf_dir, "match_events"))
    return positions.select(F.lit("field_path").alias("record_kind"), F.col("path_id").alias("record_id")).unionByName(
        speeds.select(F.lit("match_events").alias("record_kind"), F.col("event_id").alias("record_id"))
    )


QUERIES = {"p1_found": p1_found, "p1_coverage": p1_coverage, "p2_found": p2_found}

_P1 = """
WITH seg AS (
  SELECT match_id, regexp_replace(lower(trim(state)), '[ -]+', '_', 'g') AS state, start_frame AS s, end_frame AS e
  FROM game_segments WHERE match_id IS NOT NULL AND state IS NOT NULL AND start_frame IS NOT NULL AND end_frame >= start_frame),
reach AS (
  SELECT *, max(e) OVER (PARTITION BY match_id, state ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM seg),
isl AS (
  SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, state ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM reach),
per AS (SELECT match_id, state, i, min(s) AS s, max(e) AS e FROM isl GROUP BY 1, 2, 3),
nxt AS (SELECT *, lead(s) OVER (PARTITION BY match_id, state ORDER BY s) AS n FROM per),
found AS (
  SELECT match_id, state, 'period' AS kind, s AS start_frame, e AS end_frame FROM per
  UNION ALL SELECT match_id, state, 'gap', e + 1, n - 1 FROM nxt WHERE n IS NOT NULL)
"""

ORACLES = {
    "p1_found": _P1 + "SELECT * FROM found",
    "p1_coverage": _P1
    + """SELECT match_id, state, sum(CASE WHEN kind = 'period' THEN 1 ELSE 0 END)::BIGINT AS periods, sum(CASE WHEN kind = 'gap' THEN 1 ELSE 0 END)::BIGINT AS gaps,
  sum(CASE WHEN kind = 'period' THEN end_frame - start_frame + 1 ELSE 0 END)::BIGINT AS covered_frames, sum(CASE WHEN kind = 'gap' THEN end_frame - start_frame + 1 ELSE 0 END)::BIGINT AS gap_frames
FROM found GROUP BY 1, 2""",
}
