"""Human review of ball images: audit of a package, and the reviewed manifest; preflight rules of a training set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a reviewed image that reject it.
REJECTED = ("rejected", "skip", "skipped", "ignore", "ignored")


def _accepted(label: str) -> Column:
    """Annotations of the class (or of none named) with a box of four numbers."""
    return F.filter("annotations", lambda a: (F.coalesce(a["class_name"], F.lit(label)) == label) & (F.coalesce(F.size(a["box"]), F.lit(-1)) == 4) & F.forall(a["box"], lambda v: v.isNotNull()))


def reviewed_frames(images: DataFrame, label: str = "ball") -> DataFrame:
    """Every image of a review with its `state` (positive, absent, rejected, pending), the accepted annotations, and the issue that leaves it pending.

    images: review_task, status, absent (bool), annotations array<struct<class_name, box, mask_path, mask_index>>.
    """
    rows = images.withColumn("accepted", F.coalesce(_accepted(label), F.slice("annotations", 1, 0)))
    rejected = F.coalesce(F.lower(F.trim("status")).isin(*REJECTED), F.lit(False))
    mask, absence = F.col("review_task") == "verify_mask", F.col("review_task") == "verify_absence"
    state = (
        F.when(mask, F.when(F.size("accepted") > 0, "positive").when(rejected, "rejected").otherwise("pending"))
        .when(absence, F.when(F.col("absent"), "absent").when(~F.col("absent") | rejected, "rejected").otherwise("pending")).otherwise("pending")
    )
    issue = F.when(F.col("state") == "pending", F.when(mask, "positive_without_annotation").when(absence, "absence_not_verified").otherwise("unknown_review_task"))
    return rows.withColumn("state", state).withColumn("issue", issue)


def review_audit(images: DataFrame, keys: list[str], label: str = "ball") -> DataFrame:
    """Per keys (none: the whole package) frames by state, accepted annotations with and without a mask, and whether it is ready:
    nothing pending and at least one positive."""
    rows = reviewed_frames(images, label)
    with_mask = F.size(F.filter("accepted", lambda a: a["mask_path"].isNotNull() & a["mask_index"].isNotNull()))
    n = lambda s: F.sum((F.col("state") == s).cast("long"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), n("positive").alias("positive"), n("absent").alias("absent"), n("rejected").alias("rejected"), n("pending").alias("pending"),
        F.sum(F.when(F.col("state") == "positive", F.size("accepted")).otherwise(0).cast("long")).alias("annotations"), F.sum(F.when(F.col("state") == "positive", with_mask).otherwise(0).cast("long")).alias("with_mask"),
        ((n("pending") == 0) & (n("positive") > 0)).alias("ready"),
    )


def reviewed_manifest(images: DataFrame, label: str = "ball", absence: bool = True) -> DataFrame:
    """The images a review lets into training: those with accepted annotations, and verified absences."""
    rows = reviewed_frames(images, label)
    return rows.where((F.col("state") == "positive") | ((F.col("state") == "absent") & F.lit(absence)))


def normal_name(c: Column) -> Column:
    """A file name apart from slashes and case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"[\\/]+", "/"), r"^(\./)+|(?<=/)(\./)+", ""))


def preflight_issues(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(split, code, rows): the rules that images(split, id, file_name, instance_exhaustive, pixel_exhaustive, text_input),
    annotations(split, image_id, category_id, bbox, size, counts) and categories(split, id, name) of a training set break.

    Boxes are shares of the image, run lengths fill their mask. Names that train and val share are one row each of split `both`.
    """
    one = lambda df, code: df.select("split", F.lit(code).alias("code"))
    copies = images.where("id is not null").groupBy("split", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    codes = F.array_compact(F.array(
        F.when(F.col("id").isNull(), "missing_image_id"), F.when(F.coalesce(F.trim("file_name"), F.lit("")) == "", "missing_file_name"),
        F.when(F.col("instance_exhaustive").isNull(), "invalid_is_instance_exhaustive"), F.when(F.col("pixel_exhaustive").isNull(), "invalid_is_pixel_exhaustive"),
        F.when(F.coalesce(F.trim("text_input"), F.lit("")) == "", "invalid_text_input"),
    ))
    found = [images.select("split", F.explode(codes).alias("code")), copies.select("split", F.explode(F.array_repeat(F.lit("duplicate_image_id"), F.col("n").cast("int") - 1)).alias("code"))]
    ids = images.where("id is not null").select("split", F.col("id").alias("image_id")).distinct().withColumn("__known", F.lit(True))
    known = categories.select("split", F.col("id").alias("category_id")).distinct().withColumn("__class", F.lit(True))
    rows = annotations.join(ids, ["split", "image_id"], "left").join(known, ["split", "category_id"], "left")
    b = lambda i: F.get("bbox", F.lit(i))
    good_box = (F.size("bbox") == 4) & F.forall("bbox", lambda v: v.between(0, 1)) & (b(2) > 0) & (b(3) > 0) & (b(0) + b(2) <= 1 + 1e-6) & (b(1) + b(3) <= 1 + 1e-6)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, v: a + v)
    good_mask = (F.size("size") == 2) & (F.get("size", F.lit(0)) > 0) & (F.get("size", F.lit(1)) > 0) & F.forall("counts", lambda v: v >= 0) & (total == F.get("size", F.lit(0)).cast("long") * F.get("size", F.lit(1)))
    codes = F.array_compact(F.array(
        F.when(F.col("__known").isNull(), "unknown_annotation_image"), F.when(~F.coalesce(good_box, F.lit(False)), "invalid_normalized_bbox"),
        F.when(~F.coalesce(good_mask, F.lit(False)), "invalid_segmentation_rle"), F.when(F.col("__class").isNull(), "unknown_category_id"),
    ))
    found.append(rows.select("split", F.explode(codes).alias("code")))
    names = lambda s: images.where(F.col("split") == s).select(normal_name(F.col("file_name")).alias("file_name")).where("file_name <> ''").distinct()
    found.append(one(names("train").join(names("val"), "file_name", "left_semi").withColumn("split", F.lit("both")), "train_val_file_overlap"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.groupBy("split", "code").agg(F.count(F.lit(1)).alias("rows"))
