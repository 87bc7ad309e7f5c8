"""JSON documents: configuration, calibrations, nested manifests, reports in folders."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import Pitch

#: The corners of a calibration given by name, in order, and the pitch's own measures in metres.
CORNERS = ("top_left", "top_right", "bottom_right", "bottom_left")
FIELD_LENGTH_M, FIELD_WIDTH_M = 2.43, 1.82


def document_texts(spark: SparkSession, paths: str | list[str], pattern: str = "*.json") -> DataFrame:
    """(path, text) of every document below the paths, however deep; a byte-order mark is dropped. A document is one row."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(paths, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def read_document(spark: SparkSession, path: str) -> Any:
    """One small document (a configuration, a calibration) as Python values; JSON, or YAML where a parser for it is installed."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one document")
    text = rows[0][0].removeprefix("﻿")
    if path.endswith((".yml", ".yaml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def deep_get(config: Mapping[str, Any], dotted: str, default: Any = None) -> Any:
    """config['a']['b'] for 'a.b'; default where a step is missing or no mapping."""
    at: Any = config
    for key in dotted.split("."):
        if not isinstance(at, Mapping) or key not in at:
            return default
        at = at[key]
    return at


def _points(value: Any, name: str, default: list[tuple[float, float]] | None = None) -> list[tuple[float, float]]:
    if value is None:
        if default is None:
            raise ValueError(f"{name} is missing")
        return default
    if isinstance(value, Mapping):
        if missing := [c for c in CORNERS if c not in value]:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
        value = [value[c] for c in CORNERS]
    if any(len(p) != 2 for p in value):
        raise ValueError(f"a point of {name} has not two values")
    return [(float(x), float(y)) for x, y in value]


def calibration(document: Mapping[str, Any]) -> tuple[Pitch, list[tuple[float, float]], list[tuple[float, float]]]:
    """Pitch, image points and field points of a calibration. Points are lists or named corners; without
    field points these are the corners of the pitch. At least four pairs, as many of one as of the other."""
    length = float(deep_get(document, "field.length_m", document.get("field_length_m", FIELD_LENGTH_M)))
    width = float(deep_get(document, "field.width_m", document.get("field_width_m", FIELD_WIDTH_M)))
    image = _points(document.get("image_points"), "image_points")
    field = _points(document.get("field_points"), "field_points", [(0.0, 0.0), (length, 0.0), (length, width), (0.0, width)])
    if len(image) != len(field):
        raise ValueError("image_points and field_points are not as many")
    return Pitch.fit(image, field, length, width), image, field


def _objects(text: Column, key: str) -> Column:
    """The objects of the array `key` of a document as texts; null where there is no such array."""
    return F.filter(F.from_json(F.get_json_object(text, f"$.{key}"), "array<string>"), lambda e: F.ltrim(e).startswith("{"))


def read_manifests(spark: SparkSession, paths: str | list[str], pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Images and their detections of nested manifests.

    Images stand under `images`, or under `frames` in older documents; entries that are no objects are
    dropped, numbers may be texts, what is no number is null. images: (path, position, image_path, video,
    source_group, split, frame_index, width, height); detections: (path, position, det_index, class_name,
    score, box). Broken documents have no images.
    """
    docs = document_texts(spark, paths, pattern)
    entries = F.coalesce(_objects(F.col("text"), "images"), _objects(F.col("text"), "frames"))
    images = docs.select("path", F.posexplode(entries).alias("position", "image"))
    text = lambda k: F.get_json_object("image", f"$.{k}").alias(k)
    number = lambda k, kind: F.get_json_object("image", f"$.{k}").try_cast("double").try_cast(kind).alias(k)
    rows = images.select("path", "position", text("image_path"), text("video"), text("source_group"), text("split"), number("frame_index", "long"), number("width", "int"), number("height", "int"))
    dets = images.select("path", "position", F.posexplode(_objects(F.col("image"), "detections")).alias("det_index", "d"))
    score = F.get_json_object("d", "$.score").try_cast("double")
    box = F.transform(F.from_json(F.get_json_object("d", "$.box"), "array<string>"), lambda v: v.try_cast("double"))
    return rows, dets.select("path", "position", "det_index", F.get_json_object("d", "$.class_name").alias("class_name"), F.when(~F.isnan(score) & (F.abs(score) < float("inf")), score).alias("score"), box.alias("box"))


def read_reports(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(path, status, quality_score, text) of the quality reports below a folder; unreadable documents and others are passed over."""
    docs = document_texts(spark, root, pattern)
    head = F.from_json("text", "status string, quality_score double")
    return docs.withColumn("h", head).where("h.status is not null and h.quality_score is not null").select("path", "h.status", F.col("h.quality_score").cast("long").alias("quality_score"), "text")


def read_by_stem(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(stem, text) of the documents whose file or folder is named <stem><suffix>."""
    docs = document_texts(spark, root, "*")
    stem = F.regexp_extract("path", r"(?:^|[/=])([^/=]+)" + suffix.replace(".", r"\.") + "(?:/|$)", 1)
    return docs.select(stem.alias("stem"), "text").where("stem <> ''")
