"""What detectors give, as detections: model output under its several names, and blobs of a colour by their shape."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import Box, expand_box

#: The names under which model output has boxes, boxes as corner and size, scores, masks and ids; the first that is there counts.
BOXES = ("boxes", "out_boxes", "pred_boxes")
SIZED_BOXES = ("out_boxes_xywh", "boxes_xywh", "pred_boxes_xywh")
SCORES = ("scores", "out_scores", "out_probs", "pred_scores")
MASKS = ("masks", "out_binary_masks", "out_mask_logits", "pred_masks")
IDS = ("object_ids", "out_obj_ids", "obj_ids")

OUTPUT = ", ".join([*(f"{k} array<array<double>>" for k in BOXES + SIZED_BOXES), *(f"{k} array<double>" for k in SCORES), *(f"{k} array<array<array<double>>>" for k in MASKS), *(f"{k} array<long>" for k in IDS)])


def mask_box(mask: Column) -> Column:
    """Box of a mask given as rows of pixels: what is above 0; zeros for an empty mask."""
    on = lambda v: v > 0
    rows = F.filter(F.transform(mask, lambda r, i: F.when(F.exists(r, on), i)), lambda i: i.isNotNull())
    cols = F.filter(F.flatten(F.transform(mask, lambda r: F.transform(r, lambda v, i: F.when(v > 0, i)))), lambda i: i.isNotNull())
    whole = F.array(*[c.cast("double") for c in (F.array_min(cols), F.array_min(rows), F.array_max(cols) + 1, F.array_max(rows) + 1)])
    return F.when(F.size(rows) > 0, whole).otherwise(F.array(*[F.lit(0.0)] * 4))


def model_detections(raw: DataFrame, least: float = 0.45) -> DataFrame:
    """Rows (keys, mask_index, score, box, area, object_id) of model output, a row of raw a frame and prompt with the column `output` (OUTPUT).

    Boxes are taken as they are, else from corner and size, else from the masks. Where there are masks and no box value is above 2,
    boxes are shares of the mask's size and scaled to it. A missing score is 1; scores below `least` go. A box is four numbers.
    """
    o = lambda names: F.coalesce(*[F.col(f"output.{n}") for n in names])
    sized = F.transform(o(SIZED_BOXES), lambda b: F.array(b[0], b[1], b[0] + b[2], b[1] + b[3]))
    masks = o(MASKS)
    boxes = F.coalesce(o(BOXES), sized, F.transform(masks, mask_box))
    keys = [c for c in raw.columns if c != "output"]
    rows = raw.select(*keys, boxes.alias("__b"), o(SCORES).alias("__s"), masks.alias("__m"), o(IDS).alias("__i"))
    share = F.col("__m").isNotNull() & (F.array_max(F.flatten("__b")) <= 2.0)
    high, wide = F.size(F.get("__m", F.lit(0))), F.size(F.get(F.get("__m", F.lit(0)), F.lit(0)))
    scaled = F.transform("__b", lambda b: F.array(b[0] * wide, b[1] * high, b[2] * wide, b[3] * high))
    rows = rows.withColumn("__b", F.when(share, scaled).otherwise(F.col("__b")))
    rows = rows.select(*keys, F.posexplode("__b").alias("mask_index", "box"), "__s", "__m", "__i")
    at = lambda c: F.get(F.col(c), F.col("mask_index"))
    area = F.aggregate(F.flatten(at("__m")), F.lit(0.0), lambda a, v: a + (v > 0).cast("double"))
    rows = rows.select(*keys, "mask_index", F.coalesce(at("__s"), F.lit(1.0)).alias("score"), "box", area.alias("area"), at("__i").cast("string").alias("object_id"))
    return rows.where((F.size("box") == 4) & (F.col("score") >= least))


def _blobs(df: DataFrame, width: int, height: int, border: float) -> DataFrame:
    b = Box.of()
    inside = F.lit(border <= 0) | (F.col("x1") > border) & (F.col("y1") > border) & (F.col("x2") < width - border) & (F.col("y2") < height - border)
    rows = df.where(F.col("perimeter") > 0).where((b.width > 0) & (b.height > 0)).where(inside)
    return rows.withColumns({"circularity": 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter")), "aspect": b.width / b.height, "extent": F.col("area") / (b.width * b.height)})


def ball_candidates(blobs: DataFrame, width: int, height: int, *, min_area: float, max_area: float, min_circularity: float, border: float = 4.0) -> DataFrame:
    """Blobs (x1, y1, x2, y2, area, perimeter) round and compact enough for a ball, with their score."""
    rows = _blobs(blobs, width, height, border).where(F.col("area").between(min_area, max_area) & (F.col("circularity") >= min_circularity) & F.col("aspect").between(0.55, 1.8))
    return rows.withColumn("score", F.least(F.lit(0.99), 0.55 + 0.4 * F.col("circularity")))


def robot_candidates(
    blobs: DataFrame, width: int, height: int, *, min_area: float, max_area: float, min_circularity: float = 0.0, extents: tuple[float, float] = (0.0, 1.0), aspects: tuple[float, float] = (0.0, 99.0),
    centres: tuple[float, float] = (0.0, 1.0), border: float = 4.0, grow: tuple[float, float, float] = (0.0, 0.0, 0.0),
) -> DataFrame:
    """Dark blobs of a robot's size and shape, with their score; boxes grow by (sides, top, bottom) within the frame."""
    rows = _blobs(blobs, width, height, border)
    middle = (F.col("y1") + F.col("y2")) / 2 / height
    rows = rows.where(F.col("area").between(min_area, max_area) & (F.col("circularity") >= min_circularity) & F.col("extent").between(*extents) & F.col("aspect").between(*aspects) & middle.between(*centres))
    size, round_ = F.least(F.lit(0.25), F.col("area") / max_area), F.least(F.lit(0.22), 0.22 * F.col("circularity"))
    grown = expand_box(Box.of(), *grow, width, height)
    return rows.withColumns({"score": F.least(F.lit(0.92), 0.4 + size + round_), **{c: getattr(grown, c) for c in ("x1", "y1", "x2", "y2")}})
