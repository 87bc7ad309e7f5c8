"""Queries over documents the tables are written to first: manifests, reports, calibrations, model output; review packages and preflight."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.functions import geometry as G
from pitchgrid.functions import sql as S
from pitchgrid.operators import candidates as C
from pitchgrid.operators import dataset as D
from pitchgrid.operators import field, possession, quality, review, summaries
from pitchgrid.plans import match_queries as M
from pitchgrid.plans import quality_sql
from pitchgrid.plans.dataset_queries import MAN, run_summary, scratch
from pitchgrid.session import table
from pitchgrid.sources import documents
from pitchgrid.sources.detections import BALLS, DET, ROBOTS, detections, is_in, sql_in

QUERIES: dict = {}
ORACLES: dict = {}
_R, _B = sql_in(ROBOTS), sql_in(BALLS)


def q(name: str, sql: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# Documents -------------------------------------------------------------------------------------


@q("SRC09_manifest_scan", """SELECT split, count(*) AS images, count(CASE WHEN has_ball THEN 1 END) AS detections, sum(frame_index)::BIGINT AS frames, round(sum(CASE WHEN has_ball THEN (image_id % 100) / 100.0::DOUBLE END), 4) AS score, sum(CASE WHEN has_ball THEN image_id % 50 + 8 END)::DOUBLE AS right_edge
FROM manifest_images WHERE manifest IS NOT NULL GROUP BY 1""")  # fmt: skip
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests as nested documents of at most 500 images, under either key, with entries that are no objects and numbers as texts; scanned again."""
    t, at = table(spark, sf_dir, "manifest_images").where("manifest is not null"), scratch(spark)
    textual = lambda c: F.when(F.col("image_id") % 3 == 0, F.to_json(F.struct(F.col(c).cast("string").alias("v")))).otherwise(F.to_json(F.struct(F.col(c).alias("v"))))
    value = lambda c: F.coalesce(F.regexp_extract(textual(c), r'^\{"v":(.*)\}$', 1), F.lit("null"))
    x = F.col("image_id") % 50
    box = F.format_string('{"class_name":"ball","score":"%s","box":[%d,2,%d,9]}', ((F.col("image_id") % 100) / 100).cast("string"), x, x + 8)
    head = F.to_json(F.struct("image_path", "video", "source_group", "split"))
    image = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.when(F.col("h") == "{}", "").otherwise(","), F.lit('"frame_index":'), F.when(value("frame_index") == "", "null").otherwise(value("frame_index")), F.lit(',"detections":['), F.when(F.col("has_ball"), F.concat(F.lit("3,"), box)).otherwise(F.lit("null")), F.lit("]}"))
    docs = t.withColumn("h", head).select("manifest", F.floor(F.col("image_id") / 500).alias("part"), image.alias("image")).groupBy("manifest", "part").agg(F.array_join(F.collect_list("image"), ",").alias("images"))
    key = F.when(F.col("part") % 2 == 0, "images").otherwise("frames")
    docs.select("manifest", "part", F.concat(F.lit("﻿{\n\""), key, F.lit('": [null, 7, '), F.col("images"), F.lit("]\n}")).alias("text")).write.partitionBy("manifest", "part").text(at)
    # One row is one document: a partition's file holds just one.
    images, dets = documents.read_manifests(spark, at, "*")
    per = dets.groupBy("path", "position").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum(F.get("box", F.lit(2))).alias("right"))
    rows = images.join(per, ["path", "position"], "left")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.sum("n"), F.lit(0)).alias("detections"), F.sum("frame_index").alias("frames"), F.round(F.sum("s"), 4).alias("score"), F.sum("right").alias("right_edge"))


@q("SRC07_report_scan", quality_sql.ORACLES["TOP05_ranked_runs"])
def report_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality reports, a document each in nested folders among others that are none, found and ranked."""
    at = scratch(spark)
    status = quality.run_status(run_summary(detections(spark, sf_dir)))
    status.select((F.crc32(F.col("run")) % 7).alias("shelf"), "run", "status", F.col("score").alias("quality_score")).write.partitionBy("shelf", "run").json(f"{at}/reports")
    spark.createDataFrame([("other", 1)], "kind string, n int").write.json(f"{at}/other")
    spark.createDataFrame([("{broken",)], "v string").write.text(f"{at}/broken=1.json")
    found = documents.read_reports(spark, at).select(F.regexp_extract("path", "run=([^/]+)/", 1).alias("run"), "status", F.col("quality_score").alias("score"))
    return quality.ranked_runs(found)


@q("SRC08_situation_scan", f"SELECT match_id AS stem, count(*) AS frames, sum(CASE WHEN state = 'controlled' THEN 1 ELSE 0 END)::BIGINT AS controlled FROM ({M.ORACLES['SIT02_situations']}) GROUP BY 1")
def situation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Situation reports, one for each match, found by the ending of their names and keyed by its stem."""
    at = scratch(spark)
    s = possession.situations(detections(spark, sf_dir), M.WIDTH).groupBy("match_id").agg(F.count(F.lit(1)).alias("frames"), F.sum((F.col("state") == "controlled").cast("long")).alias("controlled"))
    s.withColumn("file", F.concat("match_id", F.lit("-situations.json"))).drop("match_id").write.partitionBy("file").json(at)
    found = documents.read_by_stem(spark, at, "-situations.json")
    return found.select("stem", F.from_json("text", "frames long, controlled long").alias("r")).select("stem", "r.*")


@q("SRC05_calibrated_robots", M.ORACLES["PRJ16_projected_robots"])
def calibrated_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots projected by a calibration read from a document: named corners, a mark before it, the pitch's measures as default."""
    at = scratch(spark)
    text = json.dumps({"image_points": dict(zip(documents.CORNERS, M.CORNERS)), "video": {"fps": 30}}, indent=1)
    spark.createDataFrame([("﻿" + text,)], "v string").coalesce(1).write.text(at)
    pitch, _, _ = documents.calibration(documents.read_document(spark, at))
    return field.placed(detections(spark, sf_dir).where(is_in(ROBOTS)), pitch).select("det_seq", "field_x_m", "field_y_m", "inside_field", "grid_row", "grid_col", "zone", "phase", "lane")


@q("SRC14_model_output", f"""WITH {DET}, r AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame_index, class_name ORDER BY det_seq) - 1 AS i FROM det)
SELECT match_id, frame_index, class_name, i::INTEGER AS mask_index, score, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM r WHERE score >= 0.45::DOUBLE""")  # fmt: skip
def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's boxes and scores as a detector's answer, under one name or another, corners or corner and size; normalised again."""
    d = detections(spark, sf_dir).groupBy("match_id", "frame_index", "class_name").agg(F.array_sort(F.collect_list(F.struct("det_seq", "score", "x1", "y1", "x2", "y2"))).alias("a"))
    corners = F.transform("a", lambda r: F.array(r["x1"], r["y1"], r["x2"], r["y2"]))
    sized = F.transform("a", lambda r: F.array(r["x1"], r["y1"], r["x2"] - r["x1"], r["y2"] - r["y1"]))
    scores = F.transform("a", lambda r: r["score"])
    kind = F.col("frame_index") % 4
    text = F.when(kind == 0, F.to_json(F.struct(corners.alias("boxes"), scores.alias("scores")))).when(kind == 1, F.to_json(F.struct(sized.alias("pred_boxes_xywh"), scores.alias("out_probs"))))
    text = text.when(kind == 2, F.to_json(F.struct(corners.alias("out_boxes"), scores.alias("pred_scores")))).otherwise(F.to_json(F.struct(sized.alias("out_boxes_xywh"), scores.alias("out_scores"))))
    out = C.model_detections(d.select("match_id", "frame_index", "class_name", F.from_json(text, C.OUTPUT).alias("output")))
    return out.select("match_id", "frame_index", "class_name", "mask_index", "score", *[F.round(F.get("box", F.lit(i)), 6).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


_BLOB = f"SELECT *, coalesce(area, {M.area()}) AS blob, 2 * (x2 - x1 + y2 - y1) AS edge, (x2 - x1) / (y2 - y1) AS ratio FROM det WHERE x2 > x1 AND y2 > y1 AND x1 > 4 AND y1 > 4 AND x2 < {M.WIDTH - 4} AND y2 < {M.HEIGHT - 4}"
_ROUND = "(4 * pi() * blob / (edge * edge))"


def _blobs(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """Boxes as blobs: their area, or that of the box, and the box's edge as perimeter."""
    b = G.Box.of()
    d = detections(spark, sf_dir).where(is_in(names))
    return d.select("det_seq", "x1", "y1", "x2", "y2", F.coalesce("area", b.area).alias("area"), (2 * (F.col("x2") - F.col("x1") + F.col("y2") - F.col("y1"))).alias("perimeter"))


@q("SRC15_ball_candidates", f"WITH {DET}, b AS ({_BLOB}) SELECT det_seq, round(least(0.99::DOUBLE, 0.55::DOUBLE + 0.4::DOUBLE * {_ROUND}), 6) AS score FROM b WHERE class_name IN {_B} AND blob BETWEEN 20 AND 2200 AND {_ROUND} >= 0.4::DOUBLE AND ratio BETWEEN 0.55::DOUBLE AND 1.8::DOUBLE")
def ball_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ball_candidates(_blobs(spark, sf_dir, BALLS), M.WIDTH, M.HEIGHT, min_area=20, max_area=2200, min_circularity=0.4).select("det_seq", F.round("score", 6).alias("score"))


@q("SRC16_robot_candidates", f"""WITH {DET}, b AS ({_BLOB}) SELECT det_seq, round(least(0.92::DOUBLE, 0.4::DOUBLE + least(0.25::DOUBLE, blob / 15000) + least(0.22::DOUBLE, 0.22::DOUBLE * {_ROUND})), 6) AS score, round(greatest(0.0::DOUBLE, x1 - 4), 6) AS x1, round(least({M.HEIGHT}.0::DOUBLE, y2 + 6), 6) AS y2
FROM b WHERE class_name IN {_R} AND blob BETWEEN 500 AND 15000 AND {_ROUND} >= 0.2::DOUBLE AND blob / ((x2 - x1) * (y2 - y1)) BETWEEN 0.1::DOUBLE AND 0.9::DOUBLE AND ratio BETWEEN 0.4::DOUBLE AND 2.5::DOUBLE AND (y1 + y2) / 2 / {M.HEIGHT} BETWEEN 0.1::DOUBLE AND 0.95::DOUBLE""")  # fmt: skip
def robot_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.robot_candidates(_blobs(spark, sf_dir, ROBOTS), M.WIDTH, M.HEIGHT, min_area=500, max_area=15000, min_circularity=0.2, extents=(0.1, 0.9), aspects=(0.4, 2.5), centres=(0.1, 0.95), grow=(4.0, 8.0, 6.0))
    return rows.select("det_seq", F.round("score", 6).alias("score"), F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2"))


# Review packages and preflight -----------------------------------------------------------------

_REVIEW = """rv AS (SELECT image_id, coalesce(lower(trim(split)), 'none') AS split_state, CASE WHEN has_ball THEN 'verify_mask' WHEN has_ball = false THEN 'verify_absence' ELSE 'open' END AS task,
  CASE image_id % 11 WHEN 0 THEN ' Skip' WHEN 1 THEN 'rejected' ELSE 'done' END AS status, CASE image_id % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS absent, image_id % 4 AS k FROM manifest_images),
rs AS (SELECT *, CASE WHEN k IN (1, 3) THEN k = 3 END AS masked, lower(trim(status)) IN ('rejected', 'skip', 'skipped', 'ignore', 'ignored') AS gone FROM rv),
st AS (SELECT *, CASE task WHEN 'verify_mask' THEN CASE WHEN masked IS NOT NULL THEN 'positive' WHEN gone THEN 'rejected' ELSE 'pending' END
  WHEN 'verify_absence' THEN CASE WHEN absent THEN 'absent' WHEN absent = false OR gone THEN 'rejected' ELSE 'pending' END ELSE 'pending' END AS state FROM rs)
"""
_AUDIT = """count(*) AS frames, sum((state = 'positive')::INT)::BIGINT AS positive, sum((state = 'absent')::INT)::BIGINT AS absent, sum((state = 'rejected')::INT)::BIGINT AS rejected, sum((state = 'pending')::INT)::BIGINT AS pending,
  sum((state = 'positive')::INT)::BIGINT AS annotations, sum((state = 'positive' AND masked)::INT)::BIGINT AS with_mask, sum((state = 'pending')::INT) = 0 AND sum((state = 'positive')::INT) > 0 AS ready"""


def review_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest images as a review: tasks by has_ball, states and annotations of every kind by the image's number."""
    i = table(spark, sf_dir, "manifest_images")
    n, k = F.col("image_id"), F.col("image_id") % 4
    note = lambda label, box, path, index: F.struct(label.cast("string").alias("class_name"), box.cast("array<double>").alias("box"), path.cast("string").alias("mask_path"), index.cast("int").alias("mask_index"))
    box, none = F.array(F.lit(1.0), F.lit(2.0), F.lit(9.0), F.lit(9.0)), F.lit(None)
    notes = F.when(k == 1, F.array(note(none, box, none, none))).when(k == 2, F.array(note(F.lit("robots"), box, none, none), note(F.lit("ball"), F.array(F.lit(1.0)), none, none))).when(k == 3, F.array(note(F.lit("ball"), box, F.lit("m.npz"), F.lit(0))))
    return i.select(
        "image_id", F.coalesce(F.lower(F.trim("split")), F.lit("none")).alias("split_state"), F.when(F.col("has_ball"), "verify_mask").when(~F.col("has_ball"), "verify_absence").otherwise("open").alias("review_task"),
        F.when(n % 11 == 0, " Skip").when(n % 11 == 1, "rejected").otherwise("done").alias("status"), F.when(n % 5 == 0, F.lit(None).cast("boolean")).otherwise(n % 5 != 1).alias("absent"), notes.alias("annotations"),
    )


@q("DST08_review_audit", f"WITH {_REVIEW} SELECT split_state, task, {_AUDIT} FROM st GROUP BY 1, 2")
def review_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_audit(review_package(spark, sf_dir), ["split_state", "review_task"]).withColumnRenamed("review_task", "task")


@q("AGG21_review_package", f"WITH {_REVIEW} SELECT {_AUDIT} FROM st")
def review_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole package in one row, with its readiness."""
    return review.review_audit(review_package(spark, sf_dir), [])


@q("DST08_reviewed_manifest", f"WITH {_REVIEW} SELECT image_id, task, CASE WHEN state = 'positive' THEN 1 ELSE 0 END AS detections FROM st WHERE state IN ('positive', 'absent')")
def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.reviewed_manifest(review_package(spark, sf_dir)).select("image_id", F.col("review_task").alias("task"), F.when(F.col("review_task") == "verify_mask", F.size("accepted")).otherwise(0).alias("detections"))


@q("DST12_preflight", f"""WITH {MAN}, im AS (SELECT CASE WHEN split = 'train' THEN 'train' ELSE 'val' END AS split, CASE WHEN image_id % 90 = 0 THEN NULL ELSE image_id - image_id % 3 END AS id, CASE WHEN image_id % 70 = 0 THEN ' ' ELSE video || '\\\\F' || (image_id % 700) || '.PNG' END AS file_name, image_id,
  image_id % 60 <> 0 AS ie, image_id % 80 <> 0 AS pe, image_id % 50 <> 0 AS phrase FROM img),
an AS (SELECT i.split, md.image_id - md.image_id % 3 AS image_id, class_name, x1 / 640 AS x, y1 / 360 AS y, (x2 - x1) / 640 AS w, (y2 - y1) / 360 AS h, 230400 - det_index + CASE WHEN det_index = 2 THEN 1 ELSE 0 END + det_index AS total FROM md JOIN im i USING (image_id)),
known AS (SELECT DISTINCT split, id FROM im WHERE id IS NOT NULL),
codes AS (SELECT split, unnest([CASE WHEN id IS NULL THEN 'missing_image_id' END, CASE WHEN trim(file_name) = '' THEN 'missing_file_name' END, CASE WHEN NOT ie THEN 'invalid_is_instance_exhaustive' END, CASE WHEN NOT pe THEN 'invalid_is_pixel_exhaustive' END, CASE WHEN NOT phrase THEN 'invalid_text_input' END]) AS code FROM im
  UNION ALL SELECT split, 'duplicate_image_id' FROM (SELECT split, unnest(range(count(*) - 1)) FROM im WHERE id IS NOT NULL GROUP BY split, id)
  UNION ALL SELECT an.split, unnest([CASE WHEN k.id IS NULL THEN 'unknown_annotation_image' END, CASE WHEN NOT (x >= 0 AND y >= 0 AND x <= 1 AND y <= 1 AND w > 0 AND h > 0 AND w <= 1 AND h <= 1 AND x + w <= 1.000001::DOUBLE AND y + h <= 1.000001::DOUBLE) THEN 'invalid_normalized_bbox' END,
    CASE WHEN total <> 230400 THEN 'invalid_segmentation_rle' END, CASE WHEN class_name = 'goal_blue' THEN 'unknown_category_id' END]) FROM an LEFT JOIN known k ON k.split = an.split AND k.id = an.image_id
  UNION ALL SELECT 'both', 'train_val_file_overlap' FROM (SELECT lower(replace(trim(file_name), '\\\\', '/')) AS f FROM im WHERE split = 'train' AND trim(file_name) <> '' INTERSECT SELECT lower(replace(trim(file_name), '\\\\', '/')) FROM im WHERE split = 'val'))
SELECT split, code, count(*) AS rows FROM codes WHERE code IS NOT NULL GROUP BY 1, 2""".replace("'\\\\'", "'\\'").replace("'\\\\F'", "'\\F'"))  # fmt: skip
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules a training set breaks before training, over a set with every kind of fault."""
    images, dets = D.manifest(spark, sf_dir)
    n = F.col("image_id")
    im = images.select(
        F.when(F.col("split") == "train", "train").otherwise("val").alias("split"), F.when(n % 90 != 0, n - n % 3).alias("id"), F.when(n % 70 == 0, " ").otherwise(F.concat("video", F.lit("\\F"), (n % 700).cast("string"), F.lit(".PNG"))).alias("file_name"), "image_id",
        F.when(n % 60 != 0, True).alias("instance_exhaustive"), F.when(n % 80 != 0, True).alias("pixel_exhaustive"), F.when(n % 50 == 0, "").otherwise("ball").alias("text_input"),
    )
    names = ["ball", "robots", "field", "goal_blue"]
    i = F.col("det_index").cast("long")
    an = dets.join(im.select("split", "image_id"), "image_id").select(
        "split", (n - n % 3).alias("image_id"), F.array_position(F.array(*map(F.lit, names)), F.col("class_name")).alias("category_id"),
        F.array(F.col("x1") / 640, F.col("y1") / 360, (F.col("x2") - F.col("x1")) / 640, (F.col("y2") - F.col("y1")) / 360).alias("bbox"), F.array(F.lit(360), F.lit(640)).alias("size"), F.array(230400 - i + F.when(i == 2, 1).otherwise(0), i).alias("counts"),
    )
    cats = spark.createDataFrame([(s, k + 1, c) for s in ("train", "val") for k, c in enumerate(names[:3])], "split string, id long, name string")
    return review.preflight_issues(im.drop("image_id"), an, cats)


@q("AGG08_event_breakdown", """WITH e AS (SELECT match_id, event_type, unnest(CASE event_type WHEN 'goal_candidate' THEN [{'m': 'goals_by_side', 'k': 'goal_side'}] WHEN 'goal_rejected' THEN [{'m': 'rejects_by_reason', 'k': 'rejection_reason'}]
  WHEN 'shot' THEN [{'m': 'shots_by_team', 'k': 'shooting_team'}, {'m': 'shots_by_side', 'k': 'target_side'}] END) AS p, metadata FROM match_events WHERE match_id IS NOT NULL AND frame_index IS NOT NULL),
n AS (SELECT match_id, p.m AS measure, coalesce(nullif(CASE p.k WHEN 'goal_side' THEN regexp_extract(metadata, '"goal_side"\\s*:\\s*"([^"]*)"', 1) WHEN 'rejection_reason' THEN regexp_extract(metadata, '"rejection_reason"\\s*:\\s*"([^"]*)"', 1)
  WHEN 'shooting_team' THEN regexp_extract(metadata, '"shooting_team"\\s*:\\s*"([^"]*)"', 1) ELSE regexp_extract(metadata, '"target_side"\\s*:\\s*"([^"]*)"', 1) END, ''), 'unknown') AS name FROM e)
SELECT match_id, measure, name, count(*) AS events FROM n GROUP BY 1, 2, 3""")  # fmt: skip
def event_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.event_breakdown(M.event_table(spark, sf_dir))


@q("TOP09_best_variants", f"SELECT run, ball_coverage, possession FROM ({quality_sql.summary()}) ORDER BY ball_coverage DESC, run LIMIT 6")
def best_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six runs that see the ball most."""
    return run_summary(detections(spark, sf_dir)).orderBy(F.desc("ball_coverage"), "run").limit(6).select("run", "ball_coverage", "possession")


@q("FUN01_sql_functions", f"SELECT seq_a, seq_b, iou, containment FROM ({M.ORACLES['PRJ03_pair_overlaps']})")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of robots, written in SQL with the engine's functions."""
    S.register(spark)
    four = lambda p: ", ".join(f"{p}.{c}" for c in ("x1", "y1", "x2", "y2"))
    return spark.sql(
        f"SELECT a.det_seq AS seq_a, b.det_seq AS seq_b, round(box_iou({four('a')}, {four('b')}), 6) AS iou, round(box_containment({four('a')}, {four('b')}), 6) AS containment FROM {{d}} a JOIN {{d}} b ON a.match_id = b.match_id AND a.frame_index = b.frame_index AND a.det_seq < b.det_seq WHERE box_iou({four('a')}, {four('b')}) > 0",
        d=detections(spark, sf_dir).where(is_in(ROBOTS)),
    )
