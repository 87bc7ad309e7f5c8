"""Writers: JSON lines, CSV in fixed column order, splits, and small reports."""

from __future__ import annotations

import hashlib
import platform
from collections.abc import Sequence
from datetime import UTC, datetime
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_detections(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Rows with box and centre; JSON lines or Parquet, parted by match."""
    out = df.withColumns({"box": F.array("x1", "y1", "x2", "y2"), "centroid_x": F.col("cx"), "centroid_y": F.col("cy")}).drop("x1", "y1", "x2", "y2", "cx", "cy")
    out.write.mode("overwrite").partitionBy("match_id").format(fmt).save(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Columns in the given order; maps are packed as k:v;k:v."""
    kinds = dict(df.dtypes)
    pack = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ";").alias(c)
    df.select(*[pack(c) if kinds[c].startswith("map") else F.col(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def document(df: DataFrame, limit: int = 10_000) -> list[dict]:
    """Rows of a small result as plain records; more than `limit` are refused rather than cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a document; write the table instead")
    return [r.asDict(recursive=True) for r in rows]


def markdown(df: DataFrame, title: str, limit: int = 10_000) -> str:
    """A small result as a report."""
    rows = document(df, limit)
    head = f"| {' | '.join(df.columns)} |\n|{'-|' * len(df.columns)}"
    return "\n".join([f"# {title}", "", head, *(f"| {' | '.join(str(r[c]) for c in df.columns)} |" for r in rows), ""])


def run_manifest(arguments: Sequence[str], sources: Sequence[str], artifacts: Sequence[str]) -> dict:
    """What a run was made of: arguments, time, versions, a digest of its source files, and the files it wrote, with their sizes where they are here."""
    digest = hashlib.sha256()
    for path in sorted(sources):
        digest.update(path.encode() + b"\0" + Path(path).read_bytes() + b"\0")
    files = [{"path": a, "bytes": Path(a).stat().st_size if Path(a).is_file() else None} for a in artifacts]
    return {
        "arguments": list(arguments), "created": datetime.now(UTC).isoformat(), "python": platform.python_version(), "spark": pyspark.__version__,
        "sources": digest.hexdigest(), "artifacts": files,
    }
