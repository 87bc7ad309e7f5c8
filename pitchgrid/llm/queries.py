"""Queries of problems 3 to 10, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.llm.group_split import image_groups, image_splits
from pitchgrid.llm.leaks import leaked_passages
from pitchgrid.llm.packing import pack_texts, packing_fill
from pitchgrid.llm.runs import state_runs
from pitchgrid.llm.sampling import review_sample
from pitchgrid.llm.spans import shared_spans
from pitchgrid.llm.splits_overlap import overlap_report, overlapping_images
from pitchgrid.llm.topn import top_detections
from pitchgrid.session import table


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images drawn for review, about a tenth of every source group."""
    return review_sample(table(spark, sf_dir, "manifest_images")).select("image_id", "image_key", "source_group", "ingest_batch")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images drawn by arrival batch."""
    return p3_sample(spark, sf_dir).groupBy("ingest_batch").agg(F.count(F.lit(1)).alias("drawn"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_runs(table(spark, sf_dir, "frame_states"), least=2).select("match_id", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"))


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run, also of one row, with its number of events and duration in frames."""
    return state_runs(table(spark, sf_dir, "frame_states")).select("match_id", "state", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), "events", "duration", F.round("mean_number", 6).alias("mean_confidence"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlapping_images(table(spark, sf_dir, "manifest_images"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: images, those met in train exactly or nearly, and mean coverage."""
    return overlap_report(table(spark, sf_dir, "manifest_images"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_detections(table(spark, sf_dir, "detections")).select("det_id")


def p6_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of every group with rank and score."""
    return top_detections(table(spark, sf_dir, "detections"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_groups(table(spark, sf_dir, "manifest_images"))


def p7_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split of every image."""
    return image_splits(table(spark, sf_dir, "manifest_images"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of every text."""
    return pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number beside the least possible."""
    return packing_fill(p8_containers(spark, sf_dir))


def p9_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_windows(spark, sf_dir).where("verbatim").select("item_id", "doc_id").distinct()


def p9_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: documents with a verbatim window, and passage windows found verbatim."""
    return p9_windows(spark, sf_dir).where("verbatim").groupBy("item_id").agg(F.countDistinct("doc_id").alias("verbatim_docs"), F.countDistinct("item_at").alias("windows"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: documents with a verbatim window, and documents that have a re-filled one but no verbatim one."""
    docs = p9_windows(spark, sf_dir).groupBy("item_id", "doc_id").agg(F.max(F.col("verbatim").cast("long")).alias("v"))
    return docs.groupBy("item_id").agg(F.sum("v").alias("verbatim_docs"), F.sum(1 - F.col("v")).alias("refilled_docs"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each document that stand in shared spans, their number and share of the text."""
    docs = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max(F.length("text")).alias("chars"))
    spans = shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("chars").alias("shared_chars"), F.size("spans").cast("long").alias("spans"))
    return spans.join(docs, "doc_id").select("doc_id", "shared_chars", "spans", F.round(F.col("shared_chars") / F.col("chars"), 6).alias("share"))


QUERIES = {f.__name__: f for f in (p3_sample, p3_rates, p4_found, p4_runs, p5_found, p5_report, p6_found, p6_ranked, p7_found, p7_splits, p8_containers, p8_fill, p9_found, p9_verbatim, p9_items, p10_found, p10_shared)}


def _spelling(c: str) -> str:
    """SQL for one spelling of a path."""
    out = f"replace(replace(lower({c}), '%20', ' '), '\\', '/')"
    for a, b in ((r"\s+", " "), (" ?/[ /]*", "/")):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return f"nullif(regexp_replace(trim({out}), '^(\\./)+|^/', ''), '')"


_PATH = _spelling("image_path")
_NO_END = r"\.[a-z0-9]{2,4}$"
_CLIP_PATH = f"nullif(regexp_extract({_PATH}, '([^/]+/[^/]+)/[^/]+$', 1), '')"
_CLIP_VIDEO = f"nullif(regexp_extract(regexp_replace({_spelling('video')}, '{_NO_END}', ''), '([^/]+/[^/]+)$', 1), '')"
_NAME = f"regexp_extract({_PATH}, '([^/]+)$', 1)"
# DuckDB's patterns have no look-ahead: the marks of variants are spelled out by what they are not.
_FRAME_PATH = f"TRY_CAST(regexp_extract(regexp_replace(regexp_replace({_NAME}, '{_NO_END}', ''), '([_-](?:[a-eg-z][a-z]*|f[a-qs-z][a-z]*|fr[b-z][a-z]*)[0-9]*|\\s*\\([0-9]+\\))+$', ''), '([0-9]+)$', 1) AS BIGINT)"
_SPLIT = "CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'val' THEN 'val' WHEN 'validation' THEN 'val' WHEN 'valid' THEN 'val' WHEN 'test' THEN 'test' END"
_RECORDS = f"""SELECT image_id, {_SPLIT} AS split, {_spelling('source_group')} AS source_group, coalesce({_CLIP_VIDEO}, {_CLIP_PATH}) AS clip,
  coalesce(frame_index, {_FRAME_PATH}) AS frame FROM manifest_images"""
_SAMPLE = f"""
WITH rows AS (
  SELECT image_id, concat_ws('/', {_CLIP_PATH}, {_NAME}, coalesce(frame_index, {_FRAME_PATH})::VARCHAR) AS image_key, {_spelling('source_group')} AS source_group, ingest_batch AS b FROM manifest_images),
firsts AS (SELECT image_key, min(b) AS b, coalesce(min((b, source_group IS NOT NULL, coalesce(source_group, ''), image_id)) FILTER (WHERE b IS NOT NULL),
  min((0, source_group IS NOT NULL, coalesce(source_group, ''), image_id))) AS f, bool_or(b IS NULL) AS loose FROM rows GROUP BY 1),
items AS (SELECT image_key, b, CASE WHEN struct_extract(f, 2) THEN struct_extract(f, 3) END AS source_group, struct_extract(f, 4) AS image_id, sha256('review' || chr(31) || image_key) AS h, loose FROM firsts),
sizes AS (SELECT source_group, b, count(*) AS n, sum(count(*)) OVER (PARTITION BY source_group ORDER BY b) AS cum FROM items WHERE b IS NOT NULL GROUP BY 1, 2),
quota AS (SELECT source_group, b, ceil(round(cum * 0.1::DOUBLE, 9)) - ceil(round((cum - n) * 0.1::DOUBLE, 9)) AS k FROM sizes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_group, b ORDER BY h, image_key) AS r FROM items),
drawn AS (SELECT image_id, image_key, r.source_group, r.b::INTEGER AS ingest_batch FROM ranked r LEFT JOIN quota q ON r.b = q.b AND r.source_group IS NOT DISTINCT FROM q.source_group
  WHERE coalesce(r.r <= q.k, false) OR (loose AND ('0x' || h[:8])::BIGINT / 4294967296.0::DOUBLE < 0.1::DOUBLE))
"""
_RUNS = """
WITH one AS (
  SELECT match_id, frame_index AS f, arg_max((regexp_replace(lower(trim(state)), '[ -]+', '_', 'g'), CASE WHEN isnan(confidence) THEN NULL ELSE confidence END), (coalesce(ingested_at, '0001-01-01'::TIMESTAMP), state_id)) AS e
  FROM frame_states WHERE match_id IS NOT NULL AND frame_index IS NOT NULL GROUP BY 1, 2),
r AS (SELECT match_id, f, struct_extract(e, 1) AS s, struct_extract(e, 2) AS c FROM one),
p AS (SELECT *, lag(f) OVER w AS pf, lag(s) OVER w AS ps, lag(c) OVER w AS pc FROM r WINDOW w AS (PARTITION BY match_id ORDER BY f)),
i AS (SELECT *, sum(CASE WHEN f = pf + 1 AND s = ps AND round(abs(c - pc), 9) <= 0.05::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY f ROWS UNBOUNDED PRECEDING) AS g FROM p),
runs AS (SELECT match_id, s AS state, min(f) AS start_frame, max(f) AS end_frame, count(*) AS events, max(f) - min(f) + 1 AS duration, round(avg(c), 6) AS mean_confidence FROM i WHERE s IS NOT NULL AND c IS NOT NULL GROUP BY match_id, s, g)
"""
_TOP = """
WITH d AS (
  SELECT match_id, frame_index, lower(trim(class_name)) AS class_name, score, box, min(det_id) AS det_id FROM detections
  WHERE score >= 0 AND score <= 1 AND NOT isnan(score) GROUP BY ALL)
SELECT match_id, frame_index, class_name, (row_number() OVER (PARTITION BY match_id, frame_index, class_name ORDER BY score DESC, det_id))::INTEGER AS rank, score, det_id
FROM d QUALIFY rank <= 3"""
_PAIRS = f"""
WITH r AS ({_RECORDS}), ok AS (SELECT * FROM r WHERE clip IS NOT NULL AND frame IS NOT NULL AND split IS NOT NULL),
m AS (SELECT e.image_id AS e, t.image_id AS t, e.clip, e.frame, t.frame AS tf, e.split, e.source_group FROM ok e JOIN ok t ON e.clip = t.clip AND abs(e.frame - t.frame) <= 2 WHERE e.split <> 'train' AND t.split = 'train')
"""
_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"

ORACLES = {
    "p3_sample": _SAMPLE + "SELECT * FROM drawn",
    "p3_rates": _SAMPLE + "SELECT ingest_batch, count(*) AS drawn FROM drawn GROUP BY 1",
    "p4_found": _RUNS + "SELECT match_id, start_frame, end_frame FROM runs WHERE events >= 2",
    "p4_runs": _RUNS + "SELECT * FROM runs",
    "p5_found": _PAIRS + "SELECT least(e, t) AS image_id_a, greatest(e, t) AS image_id_b FROM m",
    "p5_report": _PAIRS
    + """, one AS (SELECT DISTINCT clip, frame, tf FROM m), isl AS (SELECT *, tf - row_number() OVER (PARTITION BY clip, frame ORDER BY tf) AS i FROM one),
part AS (SELECT clip, frame, i, count(*) AS n, max(CASE WHEN frame = tf THEN 1 ELSE 0 END) AS x FROM isl GROUP BY 1, 2, 3),
hit AS (SELECT clip, frame, sum(n) AS n, max(x) AS x, count(*) AS stretches, max(n) AS longest FROM part GROUP BY 1, 2)
SELECT split, source_group, count(*) AS images, sum(coalesce(x, 0))::BIGINT AS exact_images, sum(CASE WHEN n IS NULL THEN 0 ELSE 1 END)::BIGINT AS near_images, round(avg(coalesce(n, 0) / 5.0::DOUBLE), 6) AS mean_coverage,
  sum(coalesce(stretches, 0))::BIGINT AS stretches, max(coalesce(longest, 0))::BIGINT AS longest
FROM ok LEFT JOIN hit USING (clip, frame) WHERE split <> 'train' GROUP BY 1, 2""",
    "p6_found": f"SELECT det_id FROM ({_TOP})",
    "p6_ranked": _TOP,
    "p7_found": f"""
WITH RECURSIVE rows AS (SELECT image_id, 'v' || {_spelling('video')} AS v, 'g' || {_spelling('source_group')} AS g FROM manifest_images),
edge AS (SELECT DISTINCT v AS a, g AS b FROM rows WHERE v IS NOT NULL AND g IS NOT NULL), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT DISTINCT coalesce(v, g) AS a, coalesce(v, g) AS b FROM rows WHERE coalesce(v, g) IS NOT NULL UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
own AS (SELECT image_id, coalesce(v, g) AS k FROM rows), least_of AS (SELECT r.a AS k, min(o.image_id) AS group_id FROM reach r JOIN own o ON o.k = r.b GROUP BY 1)
SELECT image_id, coalesce(group_id, image_id) AS group_id FROM own LEFT JOIN least_of USING (k)""",
    "p9_found": f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), e AS (SELECT item_id, {_WORDS.format('passage')} AS w FROM eval_items),
dw AS (SELECT doc_id, hash(array_to_string(w[i:i + 11], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
ew AS (SELECT item_id, hash(array_to_string(w[i:i + 11], ' ')) AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
SELECT DISTINCT item_id, doc_id FROM ew JOIN dw USING (h)""",
    "p9_verbatim": f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), e AS (SELECT item_id, {_WORDS.format('passage')} AS w FROM eval_items),
dw AS (SELECT doc_id, hash(array_to_string(w[i:i + 11], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
ew AS (SELECT item_id, i, hash(array_to_string(w[i:i + 11], ' ')) AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
SELECT item_id, count(DISTINCT doc_id) AS verbatim_docs, count(DISTINCT i) AS windows FROM ew JOIN dw USING (h) GROUP BY 1""",
    "p10_found": """
WITH w AS (SELECT doc_id, hash(substring(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
g AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id))
SELECT DISTINCT doc_id FROM w JOIN g USING (h)""",
    "p10_shared": """
WITH w AS (SELECT doc_id, i, hash(substring(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
g AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), s AS (SELECT DISTINCT doc_id, i FROM w JOIN g USING (h)), l AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM s),
k AS (SELECT *, sum(CASE WHEN p IS NULL OR i > p + 300 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM l), r AS (SELECT doc_id, n, max(i) + 300 - min(i) AS chars FROM k GROUP BY 1, 2)
SELECT doc_id, sum(chars)::BIGINT AS shared_chars, count(*) AS spans, round(sum(chars) / max(length(text)), 6) AS share FROM r JOIN documents USING (doc_id) GROUP BY 1""",
}
