"""Governance of frame datasets: audit, curation, splits, selections, COCO rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import hash_bucket
from pitchgrid.operators.blocks import blocked_row_number
from pitchgrid.operators.filters import best_per
from pitchgrid.operators.folds import apart
from pitchgrid.session import table


def manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Images and detections of a frame dataset laid over orders and their lines."""
    images = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.concat(F.lit("v"), (F.col("o_custkey") % 20).cast("string")).alias("video"), F.col("o_orderkey").alias("frame_index"),
        F.lit(640).alias("width"), F.lit(360).alias("height"),
    )
    images = images.withColumn("split", hash_split(F.col("video")))
    line = table(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    # All lines of an order are a few; their numbers need one window on the order.
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long")
    part, supp, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    names = F.element_at(F.array(F.lit("ball"), F.lit("robots"), F.lit("field"), F.lit("goal_blue")), (part % 4 + 1).cast("int"))
    x1, y1 = (part % 600).cast("double"), supp.cast("double")
    detections = line.select(
        F.col("l_orderkey").alias("image_id"), seq.alias("det_index"), names.alias("class_name"), (1 - 5 * F.col("l_discount")).alias("score"),
        x1.alias("x1"), y1.alias("y1"), (x1 + q - 3).alias("x2"), (y1 + q - 5).alias("y2"), F.col("l_returnflag").alias("source"),
    )
    return images, detections


def hash_split(key: Column, train: float = 0.8, val: float = 0.1) -> Column:
    """A split by the key's hash alone: reruns and other rows never change it."""
    if train <= 0 or val < 0 or train + val > 1:
        raise ValueError("ratios out of range")
    b = hash_bucket(key)
    return F.when(b < train, "train").when(b < train + val, "val").otherwise("test")


def box_problem(width: str | None = "width", height: str | None = "height") -> Column:
    b = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    malformed = b[0].isNull()
    for c in b:
        malformed = malformed | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    out = F.when(malformed, "malformed_box").when((b[2] <= b[0]) | (b[3] <= b[1]), "non_positive_box")
    if width and height:
        out = out.when((b[0] < 0) | (b[2] > F.col(width)), "outside_width").when((b[1] < 0) | (b[3] > F.col(height)), "outside_height")
    return out


def curated(images: DataFrame, detections: DataFrame, classes: Sequence[str], min_score: float, excluded: DataFrame) -> DataFrame:
    """Every detection with the first reason against it (null: accepted). excluded: (image_id, det_index)."""
    rows = detections.join(images, "image_id")
    marked = excluded.select("image_id", "det_index").distinct().withColumn("__ex", F.lit(True))
    rows = rows.join(marked, ["image_id", "det_index"], "left")
    score = F.col("score")
    reason = (
        F.when(F.col("__ex"), "review_exclusion").when(F.col("class_name").isNull(), "malformed").when(~F.col("class_name").isin(*classes), "class_not_selected")
        .when(score.isNull() | F.isnan(score) | (score < 0) | (score > 1), "invalid_score").when(score < min_score, "score_below_minimum").when(box_problem().isNotNull(), "invalid_box")
    )
    return rows.withColumn("reason", reason).drop("__ex")


def reason_report(rows: DataFrame) -> DataFrame:
    """Counts by reason, by class, by both and in all, in one pass."""
    r = rows.select(F.coalesce("reason", F.lit("accepted")).alias("reason"), "class_name")
    return r.cube("reason", "class_name").agg(F.grouping_id().cast("long").alias("grain"), F.count(F.lit(1)).alias("detections"))


def quality_buckets(images: DataFrame, detections: DataFrame, low: float = 0.6) -> DataFrame:
    """Frames, detections, invalid and low-scored rows by class, split, video and source, as grouping sets of one scan."""
    rows = detections.join(images, "image_id").withColumn("invalid", box_problem().isNotNull().cast("long")).withColumn("low", (F.col("score") < low).cast("long"))
    g = [F.col(c) for c in ("class_name", "split", "video", "source")]
    sets = rows.groupingSets([[c] for c in g], *g)
    return sets.agg(F.count(F.lit(1)).alias("detections"), F.countDistinct("image_id").alias("frames"), F.sum("invalid").alias("invalid"), F.sum("low").alias("low_score"))


def repeated(df: DataFrame, keys: list[Column], names: list[str]) -> DataFrame:
    """Groups of rows with the same key, and how many are too many."""
    cols = [k.alias(n) for k, n in zip(keys, names, strict=True)]
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumn("extra", F.col("rows") - 1)


def leaking(df: DataFrame, key: Column, split: Column) -> DataFrame:
    """Keys that stand in more than one split."""
    rows = df.select(key.alias("key"), split.alias("split")).where("key is not null and split is not null").distinct()
    out = rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count(F.lit(1)).alias("n"))
    return out.where("n > 1").drop("n")


def balanced_splits(counts: list[tuple[str, int]], train: float = 0.8, val: float = 0.1) -> dict[str, str]:
    """Whole sources to val, then test, smallest first while the distance to the aim does not grow; the rest is train."""
    total = sum(n for _, n in counts)
    test = max(0.0, 1 - train - val)

    def choose(left: list[tuple[str, int]], aim: float, reserve: int) -> set[str]:
        chosen: set[str] = set()
        have = 0
        if aim > 0:
            for key, n in sorted(left, key=lambda kv: (kv[1], kv[0])):
                if len(chosen) >= max(0, len(left) - reserve) or have == aim:
                    break
                if not chosen or abs(aim - have - n) <= abs(aim - have):
                    chosen.add(key)
                    have += n
        return chosen

    first = choose(counts, total * val, 1 + int(test > 0 and len(counts) >= 3))
    second = choose([kv for kv in counts if kv[0] not in first], total * test, 1)
    return {k: "val" if k in first else "test" if k in second else "train" for k, _ in counts}


def balanced_split(df: DataFrame, source: str, limit: int = 100_000) -> DataFrame:
    """(source, frames, split). Sources (recordings) are walked in order on the driver; more than `limit` are refused."""
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("frames"))
    rows = counts.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many sources to walk; split by hash instead")
    split = balanced_splits([(r[source], r["frames"]) for r in rows if r[source] is not None])
    return df.sparkSession.createDataFrame([(r[source], r["frames"], split[r[source]]) for r in rows if r[source] is not None], f"`{source}` string, frames long, split string")


def strongest_frames(images: DataFrame, detections: DataFrame, key: list[str]) -> DataFrame:
    """Of images of one source frame the one with most valid boxes, then the highest sum of scores, then the first."""
    stats = detections.join(images.select("image_id", "width", "height"), "image_id").groupBy("image_id").agg(F.sum(box_problem().isNull().cast("long")).alias("valid"), F.round(F.sum("score"), 6).alias("total"))
    rows = images.join(stats, "image_id", "left").fillna(0, ["valid", "total"])
    return best_per(rows, key, [F.desc("valid"), F.desc("total"), F.col("image_id")]).drop("rank")


def digest(*parts: Column | str) -> Column:
    """sha256 over the parts, parted by NUL."""
    return F.sha2(F.concat_ws("\x00", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def balanced_take(df: DataFrame, group: str, identity: Column, limit: int, seed: str = "7", tier: str = "a") -> DataFrame:
    """Round robin over the groups in digest order, one image a turn in digest order: closed form by the row number in the group."""
    rows = df.withColumn("__d", digest(seed, tier, F.col(group), identity))
    rows = rows.withColumns({"turn": F.row_number().over(Window.partitionBy(group).orderBy("__d")), "__g": digest(seed, tier, "group", F.col(group))})
    # Only rows of the first `limit` turns can be taken, and of a turn only the groups ahead in order.
    return rows.where(F.col("turn") <= limit).orderBy("turn", "__g", "__d").limit(limit).drop("__d", "__g")


def balanced_take_with_gap(df: DataFrame, group: str, identity: Column, at: str, gap: int, limit: int | None = None, seed: str = "7", tier: str = "a") -> DataFrame:
    """Round robin over the groups, a turn each, every image at least `gap` from those of its group taken before.

    The gap holds within a group only, so a group's turns need no other group; all turns in order of
    (turn, group_digest) are the round robin, and `limit` is its beginning."""
    rows = df.withColumn("__d", digest(seed, tier, F.col(group), identity)).withColumn("__id", identity)
    rows = apart(rows, [group], ["__d", "__id"], at, gap).withColumn("group_digest", digest(seed, tier, "group", F.col(group)))
    if limit is not None:
        rows = rows.where(F.col("turn") < limit).orderBy("turn", "group_digest").limit(limit)
    return rows.drop("__d", "__id")


def coco_categories(detections: DataFrame) -> DataFrame:
    """Stable ids by sorted name; the vocabulary is a handful of names."""
    names = detections.select("class_name").where("class_name is not null").distinct()
    return names.withColumn("category_id", F.row_number().over(Window.orderBy("class_name")).cast("long"))


def coco_annotations(images: DataFrame, detections: DataFrame) -> DataFrame:
    """Annotations with xywh boxes; boxes are clipped to the image and empty ones go."""
    cats = coco_categories(detections)
    rows = detections.join(images.select("image_id", "width", "height"), "image_id")
    x1, y1 = F.greatest(F.lit(0.0), F.col("x1")), F.greatest(F.lit(0.0), F.col("y1"))
    w, h = F.least(F.col("x2"), F.col("width").cast("double")) - x1, F.least(F.col("y2"), F.col("height").cast("double")) - y1
    rows = rows.select("image_id", "det_index", "class_name", "score", x1.alias("bx"), y1.alias("by"), w.alias("bw"), h.alias("bh"), "width", "height").where("bw > 0 and bh > 0")
    return rows.join(cats, "class_name").withColumn("area", F.col("bw") * F.col("bh"))


def ranked_by_digest(df: DataFrame, keys: Sequence[str], digest_column: str, name: str) -> DataFrame:
    """Rank of each row by its digest (hex) within the keys, counted in 4,096 even blocks of digests."""
    rows = df.withColumns({"__top": F.substring(digest_column, 1, 3), "__one": F.lit(0)})
    return blocked_row_number(rows, [*keys, "__one"], [F.col(digest_column)], "__top", name).drop("__top", "__one")


def phrase_pairs(images: DataFrame, detections: DataFrame, negatives: float = 0.5, most_phrases: int = 1000) -> DataFrame:
    """Image x phrase rows: a positive for each class seen in an image, and of the others, per class, round(positives * negatives) by digest.

    Phrases are the class names, a closed vocabulary; more than most_phrases are refused. Every image is read once and
    gives a row for each phrase it lacks."""
    seen = detections.where("class_name is not null").select("image_id", "class_name").distinct()
    counts = seen.groupBy("class_name").agg(F.count(F.lit(1)).alias("p"))
    names = [r[0] for r in counts.select("class_name").limit(most_phrases + 1).collect()]
    if len(names) > most_phrases:
        raise ValueError("too many phrases")
    has = seen.groupBy("image_id").agg(F.collect_set("class_name").alias("has"))
    phrases = F.array(*map(F.lit, sorted(names))) if names else F.array().cast("array<string>")
    lacking = images.select("image_id").join(has, "image_id", "left").select("image_id", F.explode(F.array_except(phrases, F.coalesce("has", F.array().cast("array<string>")))).alias("class_name"))
    ranked = ranked_by_digest(lacking.withColumn("d", digest("neg", F.col("class_name"), F.col("image_id"))), ["class_name"], "d", "r").join(counts, "class_name")
    drawn = ranked.where(F.col("r") <= F.round(F.col("p") * negatives)).select("image_id", "class_name", F.lit(False).alias("positive"))
    own = images.select("image_id").join(seen, "image_id").select("image_id", "class_name", F.lit(True).alias("positive"))
    return own.unionByName(drawn)
