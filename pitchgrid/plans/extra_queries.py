"""Further queries: look-ups, seeds, run-length masks, samples, merged manifests, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchgrid.functions import geometry as G
from pitchgrid.operators import dataset as D
from pitchgrid.operators import field, folds, quality
from pitchgrid.plans import match_queries as M
from pitchgrid.plans.dataset_queries import _PATH, MAN, _path, run_summary, scratch
from pitchgrid.session import table
from pitchgrid.sources.detections import BALLS, DET, GOALS, ROBOTS, detections, is_in, sql_in

QUERIES: dict = {}
ORACLES: dict = {}
_R, _B, _G = map(sql_in, (ROBOTS, BALLS, GOALS))


def q(name: str, sql: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def normalised_output(raw: DataFrame, width: int, height: int, least: float = 0.45) -> DataFrame:
    """Model output as detections: boxes given in shares of the frame (largest value at most 2) are scaled to pixels, low scores go."""
    relative = F.array_max("box") <= 2.0
    scale = lambda i, n: F.when(relative, F.get("box", F.lit(i)) * n).otherwise(F.get("box", F.lit(i)))
    return raw.where(F.col("score") >= least).withColumn("box", F.array(scale(0, width), scale(1, height), scale(2, width), scale(3, height)))


@q("SRC14_normalised_output", f"""WITH {DET} SELECT det_seq, round(x1 + 1e-7::DOUBLE, 4) AS x1, round(y1 + 1e-7::DOUBLE, 4) AS y1, round(x2 + 1e-7::DOUBLE, 4) AS x2, round(y2 + 1e-7::DOUBLE, 4) AS y2 FROM det WHERE score >= 0.45::DOUBLE""")
def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes given in shares of the frame for every other row come out as those given in pixels."""
    d = detections(spark, sf_dir)
    share = F.array(F.col("x1") / 2048, F.col("y1") / 2048, F.col("x2") / 2048, F.col("y2") / 2048)
    raw = d.withColumn("box", F.when(F.col("det_seq") % 2 == 0, share).otherwise(F.array("x1", "y1", "x2", "y2")))
    out = normalised_output(raw, 2048, 2048)
    return out.select("det_seq", *[F.round(F.get("box", F.lit(i)) + 1e-7, 4).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


@q("FLT11_heat_selection", f"WITH {DET}, {M.PLACED} SELECT det_seq FROM path WHERE ({M._ART}) IS NULL AND field_x_m BETWEEN 0.1::DOUBLE AND {M.PITCH.length_m - 0.1}::DOUBLE AND field_y_m BETWEEN 0.1::DOUBLE AND {M.PITCH.width_m - 0.1}::DOUBLE")
def heat_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots that are no artifacts, at least 0.1 m inside the field."""
    p = M.robot_path(detections(spark, sf_dir)).where(M.artifact().isNull())
    return p.where(F.col("field_x_m").between(0.1, M.PITCH.length_m - 0.1) & F.col("field_y_m").between(0.1, M.PITCH.width_m - 0.1)).select("det_seq")


@q("JN12_stem_lookup", r"""WITH i AS (SELECT image_id, regexp_extract(regexp_replace(lower(trim(replace(video, '\', '/'))), '\.[a-z0-9]+$', ''), '([^/]+)$', 1) AS stem FROM manifest_images WHERE video IS NOT NULL),
g AS (SELECT DISTINCT regexp_extract(regexp_replace(lower(trim(replace(source_group, '\', '/'))), '\.[a-z0-9]+$', ''), '([^/]+)$', 1) AS stem FROM manifest_images WHERE source_group IS NOT NULL)
SELECT i.image_id, g.stem AS recording FROM i LEFT JOIN g ON g.stem = regexp_replace(i.stem, '_f[0-9]+-[0-9]+$', '')""")  # fmt: skip
def stem_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips and their recordings, met by the stem of their names."""
    t = table(spark, sf_dir, "manifest_images")
    stem = lambda c: F.regexp_extract(F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\\", "/"))), r"\.[a-z0-9]+$", ""), "([^/]+)$", 1)
    g = t.where("source_group is not null").select(stem("source_group").alias("recording")).distinct()
    i = t.where("video is not null").select("image_id", F.regexp_replace(stem("video"), "_f[0-9]+-[0-9]+$", "").alias("stem"))
    return i.join(g, i["stem"] == g["recording"], "left").select("image_id", "recording")


@q("JN13_seeded_goals", f"""WITH {DET}, seed AS (SELECT match_id, class_name, min(x1) - 40 AS x1, min(y1) - 40 AS y1, max(x2) + 40 AS x2, max(y2) + 40 AS y2 FROM det WHERE class_name IN {_G} AND score >= 0.9::DOUBLE GROUP BY 1, 2)
SELECT det_seq FROM det d WHERE class_name IN {_G} AND EXISTS (SELECT 1 FROM seed s WHERE s.match_id = d.match_id AND s.class_name = d.class_name AND d.x2 > s.x1 AND s.x2 > d.x1 AND d.y2 > s.y1 AND s.y2 > d.y1)""")  # fmt: skip
def seeded_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals that meet the window of their colour's sure ones."""
    d = detections(spark, sf_dir).where(is_in(GOALS))
    s = d.where("score >= 0.9").groupBy(F.col("match_id").alias("m"), F.col("class_name").alias("c")).agg((F.min("x1") - 40).alias("s_x1"), (F.min("y1") - 40).alias("s_y1"), (F.max("x2") + 40).alias("s_x2"), (F.max("y2") + 40).alias("s_y2"))
    return d.join(s, (d["match_id"] == s["m"]) & (d["class_name"] == s["c"]) & G.boxes_cross(G.Box.of(), G.Box.of("s_")), "left_semi").select("det_seq")


@q("WIN11_spaced_samples")
def spaced_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each robot track rows at least 5 frames apart, 8 at most."""
    d = detections(spark, sf_dir).where(is_in(ROBOTS) & F.col("track_id").isNotNull())
    return folds.spaced(d.select("match_id", "track_id", "frame_index", "det_seq"), ["match_id", "track_id"], "frame_index", 5, 8, ["det_seq"])


def run_lengths(pixels: DataFrame, mask: str, at: str, total: int) -> DataFrame:
    """COCO run lengths of masks given as rows of set pixels (column-major index): background first, by islands."""
    w = Window.partitionBy(mask).orderBy(at)
    runs = pixels.select(mask, at, (F.col(at) - F.row_number().over(w)).alias("__i")).groupBy(mask, "__i").agg(F.min(at).alias("a"), F.max(at).alias("z"))
    runs = runs.select(mask, "a", (F.col("a") - F.coalesce(F.lag("z").over(Window.partitionBy(mask).orderBy("a")), F.lit(-1)) - 1).alias("off"), (F.col("z") - F.col("a") + 1).alias("on"))
    out = runs.groupBy(mask).agg(F.array_sort(F.collect_list(F.struct("a", "off", "on"))).alias("r"))
    flat = F.flatten(F.transform("r", lambda x: F.array(x["off"], x["on"])))
    left = F.lit(total).cast("long") - F.aggregate(flat, F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(mask, F.when(left > 0, F.concat(flat, F.array(left))).otherwise(flat).alias("counts"))


def box_run_lengths(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """COCO run lengths of a box as a mask, column by column: no row for a pixel."""
    tall, columns = y2 - y1, x2 - x1
    middle = F.flatten(F.transform(F.sequence(F.lit(1).cast("long"), columns), lambda i: F.when(i < columns, F.array(tall, height - tall)).otherwise(F.array(tall))))
    before, after = x1 * height + y1, (width - x2) * height + height - y2
    whole = F.concat(F.array(before), middle)
    return F.when(after > 0, F.concat(whole, F.array(after))).otherwise(whole)


@q("WIN13_run_lengths", f"""WITH {DET}, b AS (SELECT det_seq, floor(x1)::BIGINT AS a, floor(y1)::BIGINT AS t, floor(x2)::BIGINT - floor(x1)::BIGINT AS w, floor(y2)::BIGINT - floor(y1)::BIGINT AS h FROM det WHERE class_name IN {_B})
SELECT det_seq, 2 * w + 1 AS runs, a * 2304 + t AS first_off, w * h AS set_pixels FROM b WHERE w > 0 AND h > 0""")  # fmt: skip
def mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run lengths of the balls' boxes as masks in a frame of 4096 x 2304."""
    d = detections(spark, sf_dir).where(is_in(BALLS))
    d = d.where((F.floor("x2") > F.floor("x1")) & (F.floor("y2") > F.floor("y1")))
    r = d.select("det_seq", box_run_lengths(*[F.floor(c) for c in ("x1", "y1", "x2", "y2")], 4096, 2304).alias("counts"))
    on = F.aggregate(F.filter("counts", lambda _, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, x: s + x)
    return r.select("det_seq", F.size("counts").cast("long").alias("runs"), F.get("counts", F.lit(0)).alias("first_off"), on.alias("set_pixels"))


@q("TOP06_showcase")
def showcase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by ready claims, status and score, the first twelve."""
    s = run_summary(detections(spark, sf_dir))
    ready = quality.claim_rows(s).where("status = 'ready'").groupBy("run").agg(F.count(F.lit(1)).alias("ready"))
    rows = quality.run_status(s).join(ready, "run", "left").fillna(0, ["ready"])
    place = F.when(F.col("status") == "good", 0).when(F.col("status") == "review", 1).otherwise(2)
    return rows.orderBy(F.desc("ready"), place, F.desc("score"), "run").limit(12).select("run", "ready", "status", "score")


@q("QA06_missing_claims")
def missing_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims each run still lacks."""
    every = F.array(*map(F.lit, ("ball_tracking", "goal_scoring", "metric_speed_trajectory", "shot_pressure", "team_possession")))
    c = quality.claim_rows(run_summary(detections(spark, sf_dir)))
    ready = c.groupBy("run").agg(F.collect_list(F.when(F.col("status") == "ready", F.col("claim"))).alias("r"))
    return ready.select("run", F.array_join(F.array_except(every, "r"), ",").alias("missing"))


@q("QA08_rule_candidates", f"""WITH {DET}, {M.PLACED} SELECT match_id, count(*) AS samples, sum(CASE WHEN inside_field THEN 0 ELSE 1 END)::BIGINT AS outside, sum(CASE WHEN team IS NULL THEN 1 ELSE 0 END)::BIGINT AS unknown_team FROM path GROUP BY 1""")
def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.robot_path(detections(spark, sf_dir))
    return p.groupBy("match_id").agg(F.count(F.lit(1)).alias("samples"), F.sum((~F.col("inside_field")).cast("long")).alias("outside"), F.sum(F.col("team").isNull().cast("long")).alias("unknown_team"))


@q("SET01_united_sources", f"WITH {DET} SELECT source, count(*) AS rows, count(DISTINCT match_id) AS matches FROM det GROUP BY 1")
def united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources as files of their own, united again: each branch scans its own."""
    at, names = scratch(spark), ("sam3", "color_ball", "dark_robot", "goal_geometry", "other")
    d = detections(spark, sf_dir).select("match_id", "source", F.when(F.col("source").isin(*names[:-1]), F.col("source")).otherwise("other").alias("file"))
    d.write.partitionBy("file").parquet(at)
    whole = None
    for name in names:
        part = spark.read.schema("match_id string, source string, file string").option("basePath", at).parquet(at).where(F.col("file") == name).drop("file")
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("match_id").alias("matches"))


@q("SET08_unknown_classes", f"WITH {DET} SELECT DISTINCT class_name FROM det EXCEPT SELECT unnest(['ball', 'robots', 'field', 'goal_blue'])")
def unknown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(c,) for c in ("ball", "robots", "field", "goal_blue")], "class_name string")
    return detections(spark, sf_dir).select("class_name").distinct().exceptAll(known)


@q("DST03_merged_manifests", f"""SELECT manifest, {_PATH.format('image_path')} AS path, min(image_id) AS image_id, count(*) AS copies FROM manifest_images WHERE image_path IS NOT NULL GROUP BY 1, 2""")
def merged_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All manifests as one, an image of each path and manifest, with its copies counted."""
    t = table(spark, sf_dir, "manifest_images").where("image_path is not null")
    return t.groupBy("manifest", _path("image_path").alias("path")).agg(F.min("image_id").alias("image_id"), F.count(F.lit(1)).alias("copies"))


@q("AGG29_class_counts", f"WITH {MAN} SELECT class_name, count(*) AS annotations, count(DISTINCT image_id) AS images, round(sum((x2 - x1) * (y2 - y1)), 2) AS area FROM md WHERE x2 > x1 AND y2 > y1 GROUP BY 1")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.manifest(spark, sf_dir)[1].where("x2 > x1 and y2 > y1")
    return d.groupBy("class_name").agg(F.count(F.lit(1)).alias("annotations"), F.countDistinct("image_id").alias("images"), F.round(F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))), 2).alias("area"))


@q("TOP08_separate_forecasts")
def separate_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the tracks seen at a match's best snapshot the fastest, none within 0.18 m of one taken, four at most."""
    fits = M.fits(detections(spark, sf_dir))
    at = field.best_snapshot(fits).select("match_id", "frame_index")
    rows = fits.join(at, ["match_id", "frame_index"]).withColumn("v", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))
    near = lambda k, r: G.distance(k["field_x_m"], k["field_y_m"], r["field_x_m"], r["field_y_m"]) < 0.18
    return folds.greedy(rows, ["match_id"], [-F.round("v", 6), -F.col("samples"), F.col("track_id")], near, 4).select("match_id", "track_id", "frame_index", F.round("v", 4).alias("m_s"))
