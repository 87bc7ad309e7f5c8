"""Detections: the fact rows of a match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.session import table

#: Class names by role.
FIELD = ("field", "soccer_field", "green_field")
ROBOTS = ("robot", "robots", "robot_allied", "robot_rival")
BALLS = ("ball", "balon", "soccer_ball")
GOALS = ("goal", "goal_blue", "goal_yellow", "blue_goal", "yellow_goal")
BALL_HANDLERS = ("person", "human", "referee", "arbitro", "hand", "mano", "arm", "brazo")
HUMANS = ("person", "human", "referee", "arbitro", "player", "jugador", "hand", "mano", "arm", "brazo")

JSONL_SCHEMA = T.StructType([
    T.StructField("frame_index", T.LongType()), T.StructField("class_name", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("box", T.ArrayType(T.DoubleType())), T.StructField("prompt", T.StringType()), T.StructField("object_id", T.StringType()),
    T.StructField("track_id", T.LongType()), T.StructField("team", T.StringType()), T.StructField("mask_path", T.StringType()),
    T.StructField("area", T.DoubleType()), T.StructField("extra", T.StringType()), T.StructField("_corrupt_record", T.StringType()),
])


def read_detections(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """JSON lines of detections. Blank lines are skipped; a missing score is 1; strict raises on a box without
    four numbers or a broken line, else such rows stay apart in `_corrupt_record`/`problem`."""
    raw = spark.read.schema(JSONL_SCHEMA).option("mode", "PERMISSIVE").json(paths)
    problem = F.when(F.col("_corrupt_record").isNotNull(), "broken_line").when(F.coalesce(F.size("box"), F.lit(-1)) != 4, "box").when(F.col("frame_index").isNull(), "frame_index")
    if strict:
        ok = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("detection: bad "), problem)).cast("string")).otherwise(F.lit(None).cast("string"))
        raw = raw.withColumn("problem", ok)
    else:
        raw = raw.withColumn("problem", problem)
    return raw.withColumn("score", F.coalesce("score", F.lit(1.0))).withColumn("source_file", F.col("_metadata.file_path"))


def typed(raw: DataFrame, order: str = "det_id") -> DataFrame:
    """One row for each detection of the table: canonical class, valid score, four finite box values, box and
    centre in columns, promoted extras. Rows that agree in match, frame, class, score and box are one, the first
    by `order`, which becomes det_seq."""
    finite = F.forall("box", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = raw.where("match_id is not null and frame_index is not null and class_name is not null and score >= 0 and score <= 1 and size(box) = 4").where(finite)
    rest = [order, "prompt", "object_id", "track_id", "team", "mask_path", "area", "extra"]
    keys = ["match_id", "frame_index", F.lower(F.trim("class_name")).alias("class_name"), "score", "box"]
    # Rows move once, by frame: the deduplication and every join or window within a frame find them in place.
    one = rows.repartition("match_id", "frame_index").groupBy(*keys).agg(F.min(F.struct(order, *rest[1:])).alias("r"))
    b = [F.get("box", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    flat = one.select("match_id", "frame_index", F.col(f"r.{order}").alias("det_seq"), "class_name", "score", *b, *[f"r.{c}" for c in rest[1:]])
    text = lambda k: F.get_json_object("extra", f"$.{k}")
    return flat.withColumns({
        "cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "source": text("source"),
        "extent": text("extent").try_cast("double"), "circularity": text("circularity").try_cast("double"), "mask_index": text("mask_index").try_cast("int"),
    })


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(table(spark, sf_dir, "detections"))


#: The same rows in DuckDB.
DET = """det AS (
  SELECT match_id, frame_index, det_id AS det_seq, lower(trim(class_name)) AS class_name, score, box[1] AS x1, box[2] AS y1, box[3] AS x2, box[4] AS y2,
    prompt, object_id, track_id, team, mask_path, area, (box[1] + box[3]) / 2 AS cx, (box[2] + box[4]) / 2 AS cy,
    json_extract_string(extra, '$.source') AS source, TRY_CAST(json_extract_string(extra, '$.extent') AS DOUBLE) AS extent,
    TRY_CAST(json_extract_string(extra, '$.circularity') AS DOUBLE) AS circularity, TRY_CAST(json_extract_string(extra, '$.mask_index') AS INTEGER) AS mask_index
  FROM detections
  WHERE match_id IS NOT NULL AND frame_index IS NOT NULL AND class_name IS NOT NULL AND score >= 0 AND score <= 1 AND NOT isnan(score) AND len(box) = 4
    AND len(list_filter(box, lambda v: v IS NOT NULL AND isfinite(v))) = 4
  QUALIFY row_number() OVER (PARTITION BY match_id, frame_index, lower(trim(class_name)), score, box ORDER BY det_id) = 1)
"""


def is_in(names: tuple[str, ...], column: str = "class_name"):
    return F.col(column).isin(*names)


def sql_in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"
