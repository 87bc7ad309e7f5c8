"""Documents, detector output, reviews and preflight on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from pitchgrid.functions import sql
from pitchgrid.functions.geometry import Pitch
from pitchgrid.operators import candidates, quality, review
from pitchgrid.sources import documents


def test_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "c.json").write_text("\ufeff" + json.dumps({"a": {"b": 3}, "n": 1}, indent=2), encoding="utf-8")
    d = documents.read_document(spark, str(tmp_path / "c.json"))
    assert documents.deep_get(d, "a.b") == 3 and documents.deep_get(d, "a.x", 7) == 7 and documents.deep_get(d, "n.b") is None
    (tmp_path / "a" / "one.json").write_text(json.dumps({"status": "good", "quality_score": 90}))
    (tmp_path / "a" / "two.json").write_text("{broken")
    (tmp_path / "three-situations.json").write_text(json.dumps({"frames": 3}))
    (tmp_path / "list.json").write_text("[1, 2]")
    assert [(r.status, r.quality_score) for r in documents.read_reports(spark, str(tmp_path)).collect()] == [("good", 90)]
    assert [(r.stem, json.loads(r.text)["frames"]) for r in documents.read_by_stem(spark, str(tmp_path), "-situations.json").collect()] == [("three", 3)]


def test_manifests(spark, tmp_path):
    image = {"image_path": "p", "frame_index": "7", "width": 640, "height": None, "detections": [None, {"class_name": "ball", "score": "0.5", "box": [1, "2", 3, "x"]}, 5]}
    (tmp_path / "a.json").write_text(json.dumps({"images": [image, None, 7, "x"]}))
    (tmp_path / "b.json").write_text(json.dumps({"frames": [{"image_path": "q", "frame_index": "nan", "detections": {}}]}))
    (tmp_path / "c.json").write_text("nothing")
    images, dets = documents.read_manifests(spark, str(tmp_path))
    assert sorted((r.image_path, r.frame_index, r.width) for r in images.collect()) == [("p", 7, 640), ("q", None, None)] or sorted((r.image_path, r.frame_index or 0, r.width) for r in images.collect()) == [("p", 7, 640), ("q", 0, None)]
    assert [(r.class_name, r.score, r.box) for r in dets.collect()] == [("ball", 0.5, [1.0, 2.0, 3.0, None])]


def test_calibration_document():
    corners = {"top_left": [0, 0], "top_right": [10, 0], "bottom_right": [10, 10], "bottom_left": [0, 10]}
    pitch, image, field = documents.calibration({"image_points": corners})
    assert field == [(0.0, 0.0), (2.43, 0.0), (2.43, 1.82), (0.0, 1.82)] and (pitch.length_m, pitch.width_m) == (2.43, 1.82) and image[2] == (10.0, 10.0)
    assert documents.calibration({"image_points": list(corners.values()), "field_length_m": 3, "field": {"width_m": 2}})[0].length_m == 3.0
    for bad in ({}, {"image_points": {"top_left": [0, 0]}}, {"image_points": [[0, 0, 1]] * 4}, {"image_points": [[0, 0]] * 3}, {"image_points": list(corners.values()), "field_points": [[0, 0]] * 5}):
        with pytest.raises(ValueError):
            documents.calibration(bad)


def test_model_output(spark):
    rows = [
        (1, {"boxes": [[1, 2, 3, 4], [5, 6, 7, 8]], "scores": [0.9, 0.1]}), (2, {"pred_boxes_xywh": [[1, 2, 3, 4]], "out_obj_ids": [5]}), (3, {"masks": [[[0, 0, 0], [0, 1, 1]], [[0, 0, 0], [0, 0, 0]]]}),
        (4, {"out_boxes": [[0.5, 0.5, 1.0, 1.0]], "pred_masks": [[[1, 0, 0, 0], [0, 0, 0, 0]]], "out_probs": [0.8]}), (5, {"boxes": [[1, 2, 3]]}), (6, {}),
    ]
    raw = spark.createDataFrame([(f, json.dumps(o)) for f, o in rows], "f int, t string").select("f", F.from_json("t", candidates.OUTPUT).alias("output"))
    got = sorted((r.f, r.mask_index, r.score, r.box, r.area, r.object_id) for r in candidates.model_detections(raw).collect())
    assert got == [
        (1, 0, 0.9, [1, 2, 3, 4], None, None), (2, 0, 1.0, [1, 2, 4, 6], None, "5"), (3, 0, 1.0, [1, 1, 3, 2], 2.0, None), (3, 1, 1.0, [0, 0, 0, 0], 0.0, None), (4, 0, 0.8, [2.0, 1.0, 4.0, 2.0], 1.0, None),
    ]


def test_blobs(spark):
    df = spark.createDataFrame([(1, 50.0, 50.0, 60.0, 60.0, 78.5, 31.4), (2, 0.0, 50.0, 10.0, 60.0, 78.5, 31.4), (3, 50.0, 50.0, 90.0, 60.0, 300.0, 100.0), (4, 50.0, 50.0, 60.0, 60.0, 78.5, 0.0)], "i int, x1 double, y1 double, x2 double, y2 double, area double, perimeter double")
    assert [(r.i, round(r.score, 3)) for r in candidates.ball_candidates(df, 100, 100, min_area=10, max_area=100, min_circularity=0.6).collect()] == [(1, 0.95)]
    assert [(r.i, r.x1, r.y2) for r in candidates.robot_candidates(df, 100, 100, min_area=10, max_area=100, grow=(2.0, 1.0, 3.0)).collect()] == [(1, 48.0, 63.0)]


def test_review(spark):
    note = "array<struct<class_name: string, box: array<double>, mask_path: string, mask_index: int>>"
    box = [1.0, 2.0, 3.0, 4.0]
    rows = [("verify_mask", "done", None, [("ball", box, "m", 0), (None, box, None, None), ("robots", box, None, None)]), ("verify_mask", "Skip ", None, None), ("verify_mask", "done", None, [("ball", [1.0], None, None)]), ("verify_absence", None, True, None), ("verify_absence", "done", False, None), ("verify_absence", "done", None, None), ("other", "done", None, None)]
    df = spark.createDataFrame(rows, f"review_task string, status string, absent boolean, annotations {note}")
    assert [(r.state, r.issue) for r in review.reviewed_frames(df).collect()] == [("positive", None), ("rejected", None), ("pending", "positive_without_annotation"), ("absent", None), ("rejected", None), ("pending", "absence_not_verified"), ("pending", "unknown_review_task")]
    whole = review.review_audit(df, []).first()
    assert (whole.frames, whole.positive, whole.absent, whole.rejected, whole.pending, whole.annotations, whole.with_mask, whole.ready) == (7, 1, 1, 2, 3, 2, 1, False)
    assert review.review_audit(df.where("review_task <> 'other' and (status is null or status <> 'done' or absent = false or size(annotations) = 3)"), []).first().ready
    assert review.reviewed_manifest(df).count() == 2 and review.reviewed_manifest(df, absence=False).count() == 1


def test_calibration_codes():
    good = [(100.0, 60.0), (1180.0, 60.0), (1260.0, 680.0), (20.0, 680.0)]
    metres = [(0.0, 0.0), (2.43, 0.0), (2.43, 1.82), (0.0, 1.82)]

    def codes(points, field=metres, size=(1280, 720), matrix=None):
        pitch = Pitch.fit(points, field, 2.43, 1.82)
        return {c for _, c in quality.calibration_quality(points, field, Pitch(matrix, 2.43, 1.82) if matrix else pitch, *size)["issues"]}

    assert codes(good) == set()
    assert "invalid_corner_order" in codes([good[0], good[2], good[1], good[3]])
    assert "orientation_mismatch" in codes(good[::-1]) and "orientation_mismatch" not in codes(good[::-1], metres[::-1])
    assert {"zero_length_edge", "near_collinear_corner"} <= codes([good[0], good[0], good[2], good[3]])
    assert {"degenerate_polygon", "extreme_polygon_skew"} <= codes([(0.0, 0.0), (10.0, 0.0), (20.0, 0.0), (30.0, 0.0)])
    assert codes(good, size=(1000, 500)) == {"points_outside_frame"} and codes(good, size=(None, None)) == set()
    assert "insufficient_frame_coverage" in codes([(10.0, 10.0), (40.0, 10.0), (40.0, 40.0), (10.0, 40.0)]) and "low_frame_coverage" in codes([(10.0, 10.0), (140.0, 10.0), (140.0, 140.0), (10.0, 140.0)])
    assert "invalid_homography" in codes(good, matrix=(1.0,) * 6 + (0.0, 0.0, 0.0)) and "high_reprojection_error" in codes(good, matrix=(1.0,) * 6 + (0.0, 0.0, 1.0))
    assert "extreme_edge_ratio" in codes([(0.0, 0.0), (1200.0, 0.0), (1200.0, 40.0), (0.0, 40.0)]) and "high_edge_ratio" in codes([(0.0, 0.0), (1200.0, 0.0), (1200.0, 150.0), (0.0, 150.0)])


def test_sql_functions(spark):
    names = sql.register(spark, Pitch((1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 2.0), 2.0, 1.0))
    assert {"box_iou", "box_containment", "project_x", "forecast_points"} <= set(names)
    r = spark.sql("SELECT box_iou(0, 0, 2, 2, 1, 0, 3, 2) AS i, box_containment(0, 0, 2, 2, 1, 0, 2, 1) AS c, project_x(4, 2) AS x, project_y(4, 2) AS y").first()
    assert (round(r.i, 6), r.c, r.x, r.y) == (0.333333, 1.0, 2.0, 1.0)
    assert [tuple(r) for r in spark.sql("SELECT * FROM forecast_points(1, 1, 2, 0, 1, 2)").collect()] == [(0.0, 1.0, 1.0), (0.5, 2.0, 1.0), (1.0, 3.0, 1.0)]
