"""Queries of dataset governance, run quality, embeddings, scans and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchgrid.operators import dataset as D
from pitchgrid.operators import evaluation, possession, quality
from pitchgrid.operators import filters as L
from pitchgrid.operators import summaries as S
from pitchgrid.operators.filters import best_per
from pitchgrid.plans import match_queries as M
from pitchgrid.session import checkpointed, shared_folder, table
from pitchgrid.sources.detections import BALLS, DET, FIELD, ROBOTS, detections, is_in, read_detections, typed
from pitchgrid.streaming import live

QUERIES: dict = {}
ORACLES: dict = {}

_SPLIT = "CASE WHEN ('0x' || sha256({0})[:8])::BIGINT / 4294967295.0::DOUBLE < 0.8::DOUBLE THEN 'train' WHEN ('0x' || sha256({0})[:8])::BIGINT / 4294967295.0::DOUBLE < 0.9::DOUBLE THEN 'val' ELSE 'test' END"
MAN = f"""img AS (SELECT o_orderkey AS image_id, 'v' || (o_custkey % 20) AS video, o_orderkey AS frame_index, 640 AS width, 360 AS height, {_SPLIT.format("'v' || (o_custkey % 20)")} AS split FROM orders),
md AS (SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS det_index, ['ball', 'robots', 'field', 'goal_blue'][l_partkey % 4 + 1] AS class_name,
  1 - 5 * l_discount AS score, (l_partkey % 600)::DOUBLE AS x1, l_suppkey::DOUBLE AS y1, (l_partkey % 600)::DOUBLE + l_quantity - 3 AS x2, l_suppkey::DOUBLE + l_quantity - 5 AS y2, l_returnflag AS source FROM lineitem)
"""
_BOX = "CASE WHEN x1 IS NULL OR y1 IS NULL OR x2 IS NULL OR y2 IS NULL THEN 'malformed_box' WHEN x2 <= x1 OR y2 <= y1 THEN 'non_positive_box' WHEN x1 < 0 OR x2 > width THEN 'outside_width' WHEN y1 < 0 OR y2 > height THEN 'outside_height' END"


def q(name: str, sql: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def m(name: str, sql: str | None = None):  # noqa: ANN201
    """A query of the manifest (images, detections)."""

    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = lambda spark, sf_dir: f(*D.manifest(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return put


# Governance ------------------------------------------------------------------------------------


@m("DST01_hash_split", f"WITH {MAN} SELECT video, split, count(*) AS images FROM img GROUP BY 1, 2")
def hash_split(images: DataFrame, _: DataFrame) -> DataFrame:
    return images.groupBy("video", "split").agg(F.count(F.lit(1)).alias("images"))


@q("DST02_balanced_split")
def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.balanced_split(D.manifest(spark, sf_dir)[0], "video")


_EX = "image_id % 7 = 0 AND det_index = 1"


@m("DST04_curation", f"""WITH {MAN} SELECT image_id, det_index, CASE WHEN {_EX} THEN 'review_exclusion' WHEN class_name IS NULL THEN 'malformed' WHEN class_name NOT IN ('ball', 'robots', 'goal_blue') THEN 'class_not_selected'
  WHEN score IS NULL OR score < 0 OR score > 1 THEN 'invalid_score' WHEN score < 0.6::DOUBLE THEN 'score_below_minimum' WHEN ({_BOX}) IS NOT NULL THEN 'invalid_box' END AS reason FROM md JOIN img USING (image_id)""")  # fmt: skip
def curation(images: DataFrame, dets: DataFrame) -> DataFrame:
    excluded = dets.where(_EX).select("image_id", "det_index")
    return D.curated(images, dets, ["ball", "robots", "goal_blue"], 0.6, excluded).select("image_id", "det_index", "reason")


@m("AGG20_curation_report")
def curation_report(images: DataFrame, dets: DataFrame) -> DataFrame:
    return D.reason_report(D.curated(images, dets, ["ball", "robots", "goal_blue"], 0.6, dets.where(_EX).select("image_id", "det_index")))


ORACLES["AGG20_curation_report"] = f"SELECT reason, class_name, grouping(reason, class_name)::BIGINT AS grain, count(*) AS detections FROM (SELECT coalesce(reason, 'accepted') AS reason, class_name FROM ({ORACLES['DST04_curation'].replace('SELECT image_id, det_index, CASE', 'SELECT image_id, det_index, class_name, CASE')})) GROUP BY CUBE (reason, class_name)"


@m("DST05_box_problems", f"WITH {MAN} SELECT coalesce({_BOX}, 'valid') AS problem, count(*) AS detections FROM md JOIN img USING (image_id) GROUP BY 1")
def box_problems(images: DataFrame, dets: DataFrame) -> DataFrame:
    return dets.join(images, "image_id").groupBy(F.coalesce(D.box_problem(), F.lit("valid")).alias("problem")).agg(F.count(F.lit(1)).alias("detections"))


@m("AGG17_quality_buckets", f"""WITH {MAN} SELECT class_name, split, video, source, count(*) AS detections, count(DISTINCT image_id) AS frames, sum(CASE WHEN ({_BOX}) IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS invalid,
  sum(CASE WHEN score < 0.6::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS low_score FROM md JOIN img USING (image_id) GROUP BY GROUPING SETS ((class_name), (split), (video), (source))""")  # fmt: skip
def buckets(images: DataFrame, dets: DataFrame) -> DataFrame:
    return D.quality_buckets(images, dets)


def _path(c: str) -> Column:  # one spelling of a path, as far as these audits need it
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "%20", " "), r"\\", "/"))), "/+", "/")


_PATH = r"regexp_replace(lower(trim(replace(replace({0}, '%20', ' '), '\', '/'))), '/+', '/', 'g')"


@q("AGG18_repeated_paths", f"SELECT {_PATH.format('image_path')} AS path, count(*) AS rows, count(*) - 1 AS extra FROM manifest_images WHERE image_path IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.repeated(table(spark, sf_dir, "manifest_images").where("image_path is not null"), [_path("image_path")], ["path"])


@q("AGG18_repeated_frames", f"SELECT {_PATH.format('video')} AS video, frame_index, count(*) AS rows, count(*) - 1 AS extra FROM manifest_images WHERE video IS NOT NULL AND frame_index IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.repeated(table(spark, sf_dir, "manifest_images").where("video is not null and frame_index is not null"), [_path("video"), F.col("frame_index")], ["video", "frame_index"])


@q("AGG19_leaking_videos", f"SELECT {_PATH.format('video')} AS key, string_agg(DISTINCT lower(trim(split)), ',' ORDER BY lower(trim(split))) AS splits FROM manifest_images WHERE video IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1")
def leaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.leaking(table(spark, sf_dir, "manifest_images"), _path("video"), F.lower(F.trim("split")))


@m("AGG22_manifest_summary", f"WITH {MAN} SELECT split, class_name, count(*) AS detections, count(DISTINCT image_id) AS images FROM md JOIN img USING (image_id) GROUP BY 1, 2")
def manifest_summary(images: DataFrame, dets: DataFrame) -> DataFrame:
    return dets.join(images, "image_id").groupBy("split", "class_name").agg(F.count(F.lit(1)).alias("detections"), F.countDistinct("image_id").alias("images"))


@m("DED05_strongest_frames", f"""WITH {MAN}, s AS (SELECT image_id, sum(CASE WHEN ({_BOX}) IS NULL THEN 1 ELSE 0 END)::BIGINT AS valid, round(sum(score), 6) AS total FROM md JOIN img USING (image_id) GROUP BY 1)
SELECT image_id, video, coalesce(valid, 0) AS valid FROM img LEFT JOIN s USING (image_id) QUALIFY row_number() OVER (PARTITION BY video, frame_index // 4 ORDER BY coalesce(valid, 0) DESC, coalesce(total, 0) DESC, image_id) = 1""")  # fmt: skip
def strongest(images: DataFrame, dets: DataFrame) -> DataFrame:
    return D.strongest_frames(images.withColumn("near", F.expr("frame_index div 4")), dets, ["video", "near"]).select("image_id", "video", "valid")


_DIG = "sha256(concat_ws(chr(0), {0}))"


@m("DED06_holdout_frames", f"""WITH {MAN} SELECT image_id FROM img QUALIFY row_number() OVER (PARTITION BY video, frame_index // 4 ORDER BY CASE WHEN split = 'test' THEN 0 ELSE 1 END, {_DIG.format("'7', 'duplicate', image_id::VARCHAR")}) = 1""")
def holdout_frames(images: DataFrame, _: DataFrame) -> DataFrame:
    order = [F.when(F.col("split") == "test", 0).otherwise(1), D.digest("7", "duplicate", F.col("image_id"))]
    return best_per(images.withColumn("near", F.expr("frame_index div 4")), ["video", "near"], order).select("image_id")


@m("AGG28_class_union", f"WITH {MAN} SELECT video, frame_index // 4 AS near, string_agg(DISTINCT class_name, ';' ORDER BY class_name) AS classes FROM md JOIN img USING (image_id) GROUP BY 1, 2")
def class_union(images: DataFrame, dets: DataFrame) -> DataFrame:
    rows = dets.join(images, "image_id").groupBy("video", F.expr("frame_index div 4").alias("near"))
    return rows.agg(F.array_join(F.array_sort(F.collect_set("class_name")), ";").alias("classes"))


@m("DST06_holdout_take", f"""WITH {MAN}, r AS (SELECT image_id, video, row_number() OVER (PARTITION BY video ORDER BY {_DIG.format("'7', 'a', video, image_id::VARCHAR")}) AS turn FROM img)
SELECT image_id, video, turn::INTEGER AS turn FROM r ORDER BY r.turn, {_DIG.format("'7', 'a', 'group', video")} LIMIT 100""")  # fmt: skip
def holdout_take(images: DataFrame, _: DataFrame) -> DataFrame:
    return D.balanced_take(images, "video", F.col("image_id"), 100).select("image_id", "video", "turn")


@q("DST07_review_gap")
def review_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with a ball to verify its mask, and images without to verify its absence, each as a round robin over the recordings
    in which none lies within 30 frames of one taken before. The rows in order of (turn, group_digest) are the sampler's order;
    its overall limits are the caller's, and any limit is the beginning of that order."""
    t = table(spark, sf_dir, "manifest_images")
    recording = F.coalesce(_path("source_group"), F.regexp_replace(_path("video"), r"_f[0-9]+-[0-9]+(\.[a-z0-9]+)?$", "$1"))
    i = t.select(recording.alias("group"), "frame_index", "image_id", "has_ball").where("group is not null and frame_index is not null")
    seen = F.coalesce("has_ball", F.lit(False))
    take = lambda rows, tier: D.balanced_take_with_gap(rows, "group", F.col("image_id"), "frame_index", 30, tier=tier)
    both = take(i.where(seen), "positive").withColumn("task", F.lit("verify_mask")).unionByName(take(i.where(~seen), "negative").withColumn("task", F.lit("verify_absence")))
    return both.select("task", "group", "turn", "group_digest", "image_id", "frame_index", "has_ball")


@m("DST09_coco_annotations", f"""WITH {MAN}, c AS (SELECT class_name, row_number() OVER (ORDER BY class_name) AS category_id FROM (SELECT DISTINCT class_name FROM md)),
b AS (SELECT *, greatest(0.0::DOUBLE, x1) AS bx, greatest(0.0::DOUBLE, y1) AS by_, least(x2, width::DOUBLE) - greatest(0.0::DOUBLE, x1) AS bw, least(y2, height::DOUBLE) - greatest(0.0::DOUBLE, y1) AS bh FROM md JOIN img USING (image_id))
SELECT image_id, det_index, category_id, bx, by_, bw, bh, bw * bh AS area FROM b JOIN c USING (class_name) WHERE bw > 0 AND bh > 0""")  # fmt: skip
def coco(images: DataFrame, dets: DataFrame) -> DataFrame:
    return D.coco_annotations(images, dets).select("image_id", "det_index", "category_id", "bx", F.col("by").alias("by_"), "bw", "bh", "area")


@m("PRJ24_normalised_boxes", f"""WITH {MAN}, b AS (SELECT *, greatest(0.0::DOUBLE, x1) AS bx, greatest(0.0::DOUBLE, y1) AS by_, least(x2, width::DOUBLE) - greatest(0.0::DOUBLE, x1) AS bw, least(y2, height::DOUBLE) - greatest(0.0::DOUBLE, y1) AS bh FROM md JOIN img USING (image_id))
SELECT image_id, det_index, round(bx / width + 1e-9::DOUBLE, 6) AS nx, round(by_ / height + 1e-9::DOUBLE, 6) AS ny, round(bw / width + 1e-9::DOUBLE, 6) AS nw, round(bh / height + 1e-9::DOUBLE, 6) AS nh FROM b WHERE bw > 0 AND bh > 0""")  # fmt: skip
def normalised(images: DataFrame, dets: DataFrame) -> DataFrame:
    c = D.coco_annotations(images, dets)
    n = lambda a, b, name: F.round(F.col(a) / F.col(b) + 1e-9, 6).alias(name)
    return c.select("image_id", "det_index", n("bx", "width", "nx"), n("by", "height", "ny"), n("bw", "width", "nw"), n("bh", "height", "nh"))


@m("DST10_negative_subset", f"""WITH {MAN}, p AS (SELECT DISTINCT image_id FROM md WHERE class_name = 'ball'), n AS (SELECT image_id FROM img WHERE image_id NOT IN (SELECT image_id FROM p)),
k AS (SELECT round(count(*) * 0.25::DOUBLE)::BIGINT AS k FROM p) SELECT image_id FROM n QUALIFY row_number() OVER (ORDER BY {_DIG.format("'11', image_id::VARCHAR")}) <= (SELECT k FROM k)""")  # fmt: skip
def negative_subset(images: DataFrame, dets: DataFrame) -> DataFrame:
    """Images without a ball, a quarter as many as there are with one, the first by digest.

    Ranks are counted in blocks of digests, so no single task has all negatives."""
    positives = dets.where("class_name = 'ball'").select("image_id").distinct()
    k = int(positives.count() * 0.25 + 0.5)
    rest = images.select("image_id").join(positives, "image_id", "left_anti").withColumn("d", D.digest("11", F.col("image_id")))
    return D.ranked_by_digest(rest, [], "d", "r").where(F.col("r") <= k).select("image_id")


@m("DST11_phrase_pairs", f"""WITH {MAN}, s AS (SELECT DISTINCT image_id, class_name FROM md), g AS (SELECT image_id, class_name FROM (SELECT image_id FROM img), (SELECT DISTINCT class_name FROM md)),
r AS (SELECT g.image_id, g.class_name, s.image_id IS NOT NULL AS positive FROM g LEFT JOIN s USING (image_id, class_name)), c AS (SELECT class_name, count(*) AS p FROM s GROUP BY 1)
SELECT image_id, r.class_name, positive FROM r JOIN c ON r.class_name = c.class_name QUALIFY positive OR row_number() OVER (PARTITION BY r.class_name, positive ORDER BY {_DIG.format("'neg', r.class_name, image_id::VARCHAR")}) <= round(p * 0.5::DOUBLE)""")  # fmt: skip
def phrase_pairs(images: DataFrame, dets: DataFrame) -> DataFrame:
    return D.phrase_pairs(images, dets)


@q("SET04_split_overlap", f"SELECT DISTINCT {_PATH.format('image_path')} AS path FROM manifest_images WHERE lower(trim(split)) = 'train' AND image_path IS NOT NULL INTERSECT SELECT DISTINCT {_PATH.format('image_path')} FROM manifest_images WHERE lower(trim(split)) = 'val' AND image_path IS NOT NULL")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "manifest_images").where("image_path is not null")
    one = lambda s: i.where(F.lower(F.trim("split")) == s).select(_path("image_path").alias("path"))
    return one("train").intersect(one("val"))


@m("SET05_images_without_rows", f"WITH {MAN} SELECT image_id FROM img EXCEPT SELECT image_id FROM md")
def images_without(images: DataFrame, dets: DataFrame) -> DataFrame:
    return images.select("image_id").exceptAll(dets.select("image_id").distinct())


@m("AGG27_average_precision")
def precision(images: DataFrame, dets: DataFrame) -> DataFrame:
    """Lines of one order as truth, the same boxes moved by a little and scored as predictions."""
    valid = dets.join(images, "image_id").where(D.box_problem().isNull())
    truth = valid.select("image_id", F.col("class_name").alias("category"), "x1", "y1", "x2", "y2")
    shift = F.col("det_index") % 4
    predicted = valid.where("score >= 0.6").select("image_id", F.col("class_name").alias("category"), (F.col("x1") + shift).alias("x1"), "y1", (F.col("x2") + shift).alias("x2"), "y2", F.round("score", 4).alias("score"))
    return evaluation.average_precision(truth, predicted)


# Run quality -----------------------------------------------------------------------------------


def run_summary(d: DataFrame) -> DataFrame:
    """The figures the quality rules read, one row a match. A match without a step of the ball has 0 as its largest jump, one without robots 0 as unknown share.

    The typed rows are made once: ten figures would each scan, clean and move them again."""
    d = checkpointed(d)
    span = (F.max("frame_index") - F.min("frame_index") + 1).alias("span")
    base = d.groupBy(F.col("match_id").alias("run")).agg(span)
    seen = lambda names, c: d.where(is_in(names)).groupBy(F.col("match_id").alias("run")).agg(F.countDistinct("frame_index").alias(c))
    play = L.balls_in_play(d)
    balls = play.groupBy(F.col("match_id").alias("run")).agg(F.countDistinct("frame_index").alias("b"))
    steps = S.ball_steps(play).groupBy(F.col("match_id").alias("run")).agg(F.round(F.max("speed"), 6).alias("max_ball_jump"))
    owned = possession.possession(d).groupBy(F.col("match_id").alias("run")).agg(F.round(F.avg(F.col("owner_seq").isNotNull().cast("double")), 6).alias("possession"))
    teams = S.team_coverage(d, ROBOTS).select(F.col("match_id").alias("run"), F.col("samples").alias("team_samples"), F.col("assigned").alias("team_assigned"), F.round(1 - F.col("ratio"), 6).alias("unknown_team"))
    path = M.M.placed(d.where(is_in(BALLS)), M.PITCH).groupBy(F.col("match_id").alias("run")).agg(F.count(F.lit(1)).alias("path_samples"), F.round(F.avg((~F.col("inside_field")).cast("double")), 6).alias("out_of_bounds"))
    pen = M.penalty(d).groupBy(F.col("match_id").alias("run")).agg(F.sum("samples").alias("penalty_samples"))
    # Each candidate is one row here, confirmed or rejected; hits of the same entry on later frames are no candidates of their own.
    goals = M.goal_confirmation(d).groupBy(F.col("match_id").alias("run")).agg(F.count(F.lit(1)).alias("goal_candidates"), F.sum((F.col("event_type") == "goal_confirmed").cast("long")).alias("goals_confirmed"))
    shot = M.shots(d).groupBy(F.col("match_id").alias("run")).agg(F.count(F.lit(1)).alias("shots"))
    rows = base
    for part in (seen(FIELD, "f"), seen(ROBOTS, "r"), balls, steps, owned, teams, path, pen, goals, shot):
        rows = rows.join(part, "run", "left")
    ratio = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / F.col("span"), 6)
    rows = rows.withColumns({"ball_coverage": ratio("b"), "field_coverage": ratio("f"), "robot_coverage": ratio("r")}).drop("span", "b", "f", "r")
    return rows.fillna(0)


@q("QA01_run_summary")
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_summary(detections(spark, sf_dir))


@q("QA01_coverage")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_summary(detections(spark, sf_dir)).select("run", "ball_coverage", "field_coverage", "robot_coverage", "max_ball_jump", "unknown_team", "possession")


@q("QA02_issues")
def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issue_rows(run_summary(detections(spark, sf_dir)))


@q("QA03_status")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.run_status(run_summary(detections(spark, sf_dir)))


@q("QA04_claims")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.claim_rows(run_summary(detections(spark, sf_dir)))


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All detections, and those of score 0.6 and more, as two runs over the same matches."""
    d = detections(spark, sf_dir)
    out = []
    for part in (d, d.where("score >= 0.6")):
        s = run_summary(part)
        s = checkpointed(s)  # a row a match; its plan would otherwise run once for each use
        out.append(s.join(quality.run_status(s).select("run", F.col("score")), "run"))
    return out[0], out[1]


@q("QA05_comparison")
def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compared(*_two_runs(spark, sf_dir))


@q("QA05_verdicts")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(*_two_runs(spark, sf_dir))


@q("SET03_claim_changes")
def claim_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.claim_changes(*_two_runs(spark, sf_dir))


@q("TOP05_ranked_runs")
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ranked_runs(quality.run_status(run_summary(detections(spark, sf_dir))))


@q("QA07_calibration")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geometry of the calibration all field queries use."""
    c = quality.calibration_quality(M.CORNERS, M.METRES, M.PITCH, M.WIDTH, M.HEIGHT)
    return spark.createDataFrame([(c["status"], round(c["area_px"], 4), round(c["edge_ratio"], 6), round(c["min_corner_sine"], 6), round(c["bbox_fill"], 6), round(c["coverage"], 6), round(c["max_error_m"], 6), len(c["issues"]))], "status string, area_px double, edge_ratio double, min_corner_sine double, bbox_fill double, coverage double, max_error_m double, issues int")


# Embeddings ------------------------------------------------------------------------------------


@q("DST13_two_means")
def two_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.two_means(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@q("DST14_cluster_teams")
def cluster_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters named so that most labelled rows agree (even labels blue, odd yellow)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 2 == 0, "blue").otherwise("yellow").alias("seen"))
    c = two_means(spark, sf_dir).join(e, "vec_id")
    straight = F.sum(((F.col("cluster") == 0) == (F.col("seen") == "blue")).cast("long"))
    kept = c.agg(straight.alias("s"), F.count(F.lit(1)).alias("n")).select((2 * F.col("s") >= F.col("n")).alias("straight"))
    team = F.when((F.col("cluster") == 0) == F.col("straight"), "blue").otherwise("yellow")
    return c.crossJoin(F.broadcast(kept)).select("vec_id", "cluster", team.alias("team"))  # kept is one row


# Scans, sinks, streams -------------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared place."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@q("SRC01_json_lines", f"WITH {DET} SELECT match_id, count(*) AS rows, round(sum(score), 4) AS score FROM det GROUP BY 1")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections written as JSON lines and read back through the strict scan."""
    at = scratch(spark)
    d = detections(spark, sf_dir)
    d.select("match_id", "frame_index", "class_name", "score", F.array("x1", "y1", "x2", "y2").alias("box")).write.partitionBy("match_id").json(at)
    back = read_detections(spark, f"{at}/*").withColumn("match_id", F.regexp_extract("source_file", "match_id=([^/]+)/", 1)).where("problem is null")
    return back.groupBy("match_id").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("score"), 4).alias("score"))


@q("SRC02_typed_scan", f"WITH {DET} SELECT class_name, count(*) AS rows, count(track_id) AS tracked, count(extent) AS with_extent, count(mask_index) AS masked FROM det GROUP BY 1")
def typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(table(spark, sf_dir, "detections")).groupBy("class_name").agg(F.count(F.lit(1)).alias("rows"), F.count("track_id").alias("tracked"), F.count("extent").alias("with_extent"), F.count("mask_index").alias("masked"))


@q("SRC06_merged_scan")
def merged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of detections, written here, scanned as one and suppressed: what the two have of one thing stands once."""
    at, d = scratch(spark), detections(spark, sf_dir).select("match_id", "frame_index", "class_name", "det_seq", "score", "x1", "y1", "x2", "y2")
    model = F.coalesce(F.col("source"), F.lit("")) == "sam3"
    sources = detections(spark, sf_dir).select(*d.columns, model.alias("model"))
    for name, part in (("model", F.col("model")), ("colour", ~F.col("model"))):
        sources.where(part).drop("model").write.parquet(f"{at}/{name}")
    return merged(spark, [f"{at}/model", f"{at}/colour"], 0.85).groupBy("match_id", "class_name").agg(F.count(F.lit(1)).alias("rows"))


def merged(spark: SparkSession, paths: list[str], threshold: float) -> DataFrame:
    """Rows of all files, those suppressed that overlap a better one of their frame and class."""
    from pitchgrid.operators.folds import suppress

    return suppress(spark.read.parquet(*paths), threshold)


@q("SRC11_sampled_frames", "SELECT match_id, unnest(range(a, z + 1, 30)) AS frame_index FROM (SELECT match_id, min(frame_index) AS a, max(frame_index) AS z FROM frame_states WHERE match_id IS NOT NULL AND frame_index IS NOT NULL GROUP BY 1)")
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "frame_states").where("match_id is not null and frame_index is not null").groupBy("match_id").agg(F.min("frame_index").alias("a"), F.max("frame_index").alias("z"))
    return f.select("match_id", F.explode(F.sequence("a", "z", F.lit(30).cast("long"))).alias("frame_index"))


@q("SRC19_window_plan", "SELECT match_id, unnest(range(0, z + 1, 120)) AS anchor FROM (SELECT match_id, max(frame_index) AS z FROM frame_states WHERE match_id IS NOT NULL AND frame_index IS NOT NULL GROUP BY 1)")
def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "frame_states").where("match_id is not null and frame_index is not null").groupBy("match_id").agg(F.max("frame_index").alias("z"))
    return f.select("match_id", F.explode(F.sequence(F.lit(0).cast("long"), "z", F.lit(120).cast("long"))).alias("anchor"))


@q("WIN12_prompt_rotation", "SELECT match_id, anchor, ['ball', 'robot', 'field', 'goal'][((row_number() OVER (PARTITION BY match_id ORDER BY anchor) - 1) % 4 + 1)::BIGINT] AS prompt FROM (" + ORACLES["SRC19_window_plan"] + ")")
def prompt_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = (F.row_number().over(Window.partitionBy("match_id").orderBy("anchor")) - 1) % 4
    return window_plan(spark, sf_dir).withColumn("prompt", F.element_at(F.array(*map(F.lit, ("ball", "robot", "field", "goal"))), i + 1))


def _streamed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    at = scratch(spark)
    live.run_to_table(stream, f"{at}/out", f"{at}/state")
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@q("STR01_tumbling_counts")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type as a stream, open windows with what they have."""
    stream = live.windowed_counts(live.source(spark, f"{sf_dir}/events.parquet"), "ts", "1 hour", "1 hour", None, ["event_type"])
    return live.latest(stream, ["start", "end", "event_type"], scratch(spark))


@q("STR02_sliding_counts")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = live.windowed_counts(live.source(spark, f"{sf_dir}/events.parquet"), "ts", "1 hour", "2 hours", "1 hour", ["event_type"])
    return live.latest(stream, ["start", "end", "event_type"], scratch(spark))


@q("STR03_sessions")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.latest(live.sessions(live.source(spark, f"{sf_dir}/events.parquet"), "ts", "1 hour", "30 minutes", ["user_id"]), ["start", "end", "user_id"], scratch(spark), "complete")


@q("STR04_live_tracks")
def live_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker as state of a stream over the raw detections, repeated deliveries dropped within a watermark."""
    raw = live.source(spark, f"{sf_dir}/detections.parquet")
    rows = raw.where("match_id is not null and frame_index is not null and score between 0 and 1 and size(box) = 4").withColumn("class_name", F.lower(F.trim("class_name")))
    # Rows without a time of arrival count as the oldest; the watermark is wider than any delay of the source.
    rows = rows.where(is_in(ROBOTS + BALLS)).withColumn("ingested_at", F.coalesce("ingested_at", F.lit("2000-01-01").cast("timestamp")))
    once = live.deduplicated(rows, "ingested_at", "36500 days", ["match_id", "frame_index", "class_name", "score", "box"])
    cols = [F.get("box", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return _streamed(spark, live.live_tracks(once.select("match_id", "class_name", "frame_index", F.col("det_id").alias("det_seq"), *cols)))

