"""COCO detection metrics: the twelve figures of AP and AR over boxes, per category and overall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.operators.blocks import runs_of
from pitchgrid.session import checkpointed

THRESHOLDS = np.linspace(0.5, 0.95, 10)
#: The sizes of objects by area in pixels, and how many boxes of an image count.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
MOST = (1, 10, 100)
_REACHED = THRESHOLDS[:, None] - 1e-9


def _match(truth: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """(areas, thresholds, boxes): 1 where a box, in order of score, takes a true box of its own, 0 where it takes none, -1 where it
    takes one of another size, or none and is of another size itself, and does not count."""
    size = lambda m: (m[:, 2] - m[:, 0]) * (m[:, 3] - m[:, 1])
    own, mine = size(truth), size(boxes)
    low, high = np.maximum(boxes[:, None, :2], truth[None, :, :2]), np.minimum(boxes[:, None, 2:], truth[None, :, 2:])
    side = np.clip(high - low, 0, None)
    inter = side[..., 0] * side[..., 1]
    iou = inter / np.maximum(mine[:, None] + own[None] - inter, 1e-12)

    def walk(other: np.ndarray, far: np.ndarray) -> np.ndarray:
        taken, hit = np.zeros((len(THRESHOLDS), len(truth)), bool), np.zeros((len(THRESHOLDS), len(boxes)), np.int8)
        for i in range(len(boxes)):
            if far[i]:
                hit[:, i] = -1
            fits = (iou[i] >= _REACHED) & ~taken if len(truth) else taken
            some = fits.any(axis=1)
            if some.any():
                first = fits & ~other  # a box of the size comes first, however much another overlaps
                j = np.where(np.where(first.any(axis=1)[:, None], first, fits), iou[i], -1.0).argmax(axis=1)
                taken[some, j[some]] = True
                hit[some, i] = np.where(other[j[some]], -1, 1)
        return hit

    out, whole = [], None
    for least, most in AREAS.values():
        other, far = (own < least) | (own > most), (mine < least) | (mine > most)
        if other.all() and far.all():
            out.append(np.full((len(THRESHOLDS), len(boxes)), -1, np.int8))
        elif other.any() or far.any() or whole is None:
            out.append(walk(other, far))
        else:
            out.append(whole)
        whole = out[0]
    return np.stack(out)


def average_precision(truth: DataFrame, predicted: DataFrame, bins: int = 4096) -> DataFrame:
    """AP (over ten overlaps), AP50, AP75, AP by size of objects, AR with 1, 10 and 100 boxes an image and AR by size: per category, and
    overall (category null) as the mean of the categories that have such objects. Figures without objects are null. Only
    images that were predicted count.

    truth(image_id, category, x1..y2), predicted(.., score). Matching runs per image and category; of its hits the curves
    are made by counts of scores in `bins` bins and, inside each, by window, so that no category is one task.
    """
    images = predicted.select("image_id").distinct()
    cols = ["image_id", "category", "x1", "y1", "x2", "y2"]
    both = truth.join(images, "image_id", "left_semi").select(*cols, F.lit(None).cast("double").alias("score")).unionByName(predicted.select(*cols, "score"))
    keys = ["image_id", "category"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, keys):
            code = [group.column(k).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for k in keys]
            cuts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in code], axis=0), True])
            box, score = np.column_stack([group.column(c).to_numpy() for c in cols[2:]]), group.column("score").to_numpy(zero_copy_only=False)
            names, out = group.column("category").to_pylist(), []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                s, m = score[a:b], box[a:b]
                known = np.isnan(s)
                p = np.flatnonzero(~known)
                p = p[np.lexsort((m[p, 1], m[p, 0], -s[p]))][: max(MOST)]
                hits = _match(m[known], m[p])
                area = (m[known][:, 2] - m[known][:, 0]) * (m[known][:, 3] - m[known][:, 1])
                for j, (name, (least, most)) in enumerate(AREAS.items()):
                    out.append((names[a], name, None, None, None, int(((area >= least) & (area <= most)).sum())))
                    out += [(names[a], name, float(s[i]), rank, hits[j, :, rank].tolist(), 0) for rank, i in enumerate(p)]
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.int32()), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["category", "area", "score", "place", "hits", "truths"])

    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = both.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "category string, area string, score double, place int, hits array<int>, truths long")
    return _figures(checkpointed(hits), bins)  # the matching in Python runs once


def _figures(hits: DataFrame, bins: int) -> DataFrame:
    key = ["category", "area"]
    total = hits.groupBy(*key).agg(F.sum("truths").alias("n"))
    rows = hits.where("hits is not null").select(*key, "score", "place", F.posexplode("hits").alias("k", "hit")).where("hit >= 0")
    # Equal scores are one step of the curve, so no order among them matters.
    steps = rows.groupBy(*key, "k", "score").agg(F.sum("hit").alias("tp"), F.count(F.lit(1)).alias("all"), *[F.sum(F.when(F.col("place") < m, F.col("hit")).otherwise(0)).alias(f"tp{m}") for m in MOST])
    steps = checkpointed(steps).withColumn("bin", F.least(F.floor(F.col("score") * bins), F.lit(bins)))
    part = [*key, "k", "bin"]
    sums = steps.groupBy(*part).agg(F.sum("tp").alias("__tp"), F.sum("all").alias("__all"))
    above = Window.partitionBy(*key, "k").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*part, F.coalesce(F.sum("__tp").over(above), F.lit(0)).alias("__tp"), F.coalesce(F.sum("__all").over(above), F.lit(0)).alias("__all"))
    down, up = Window.partitionBy(*part).orderBy(F.desc("score")), Window.partitionBy(*part).orderBy("score")
    steps = steps.join(sums, part).join(total, key).where("n > 0")
    steps = steps.withColumns({"tp": F.sum("tp").over(down) + F.col("__tp"), "all": F.sum("all").over(down) + F.col("__all")})
    steps = steps.withColumns({"recall": F.col("tp") / F.col("n"), "precision": F.col("tp") / F.col("all"), "before": F.coalesce(F.lag("tp").over(down), F.col("__tp")) / F.col("n")})
    # The best precision at this recall or above: of lower scores in the bin, and of all lower bins.
    best = steps.groupBy(*part).agg(F.max("precision").alias("__best"))
    lower = Window.partitionBy(*key, "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    best = best.select(*part, F.max("__best").over(lower).alias("__lower"))
    steps = steps.join(best, part).withColumn("best", F.greatest(F.max("precision").over(up), "__lower"))
    # Recall points (.01, .02, .. 1) that fall into each step; the point 0 has the best precision of all.
    point = lambda c: F.floor(F.col(c) * 100 + 1e-9)
    per = steps.groupBy(*key, "k").agg(F.sum(F.col("best") * (point("recall") - point("before"))).alias("__sum"), F.max("best").alias("__zero"), *[(F.sum(f"tp{m}") / F.max("n")).alias(f"ar{m}") for m in MOST])
    per = per.withColumn("ap", (F.col("__sum") + F.col("__zero")) / 101)
    one = per.groupBy(*key).agg(F.sum("ap").alias("ap"), F.max(F.when(F.col("k") == 0, F.col("ap"))).alias("ap50"), F.max(F.when(F.col("k") == 5, F.col("ap"))).alias("ap75"), *[F.sum(f"ar{m}").alias(f"ar{m}") for m in MOST])
    tenth = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / len(THRESHOLDS)
    one = total.where("n > 0").join(one, key, "left").select(*key, "n", tenth("ap").alias("ap"), F.coalesce("ap50", F.lit(0.0)).alias("ap50"), F.coalesce("ap75", F.lit(0.0)).alias("ap75"), *[tenth(f"ar{m}").alias(f"ar{m}") for m in MOST])
    of = lambda area, c: F.max(F.when(F.col("area") == area, F.col(c)))
    wide = {"ap": of("all", "ap"), "ap50": of("all", "ap50"), "ap75": of("all", "ap75"), **{f"ap_{a}": of(a, "ap") for a in ("small", "medium", "large")}, **{f"ar{m}": of("all", f"ar{m}") for m in MOST}, **{f"ar_{a}": of(a, "ar100") for a in ("small", "medium", "large")}}
    flat = one.groupBy("category").agg(of("all", "n").alias("truths"), *[c.alias(n) for n, c in wide.items()])
    overall = flat.agg(F.sum("truths").alias("truths"), *[F.avg(n).alias(n) for n in wide]).where("truths is not null").withColumn("category", F.lit(None).cast("string"))
    return flat.unionByName(overall).select("category", "truths", *[F.round(n, 6).alias(n) for n in wide])
