"""Problem 5: records of evaluation splits that stand, themselves or nearly, in train."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.paths import clip_of_path, clip_of_video, frame_of_path, one_spelling
from pitchgrid.operators.blocks import runs_of
from pitchgrid.session import checkpointed, partitions_for

_MARK = "\x01"


def canonical_split(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s == "train", "train").when(s.isin("val", "validation", "valid"), "val").when(s == "test", "test")


def image_records(images: DataFrame) -> DataFrame:
    """image_id, split, source_group, clip, frame in one spelling; path tells where video or frame_index is null."""
    spelt = images.select("image_id", canonical_split(F.col("split")).alias("split"), one_spelling(F.col("source_group")).alias("source_group"), one_spelling(F.col("video")).alias("__v"), one_spelling(F.col("image_path")).alias("__p"), F.col("frame_index").cast("long").alias("__f"))
    return spelt.select("image_id", "split", "source_group", F.coalesce(clip_of_video(F.col("__v")), clip_of_path(F.col("__p"))).alias("clip"), F.coalesce(F.col("__f"), frame_of_path(F.col("__p"))).alias("frame"))


def passage_matches(train: DataFrame, held_out: DataFrame, near: int = 2, width: int = 512) -> DataFrame:
    """(clip, frame, train_frame): where train's text meets the passage of a held-out record.

    The passage of a held-out frame is the stretch of 2 * near + 1 frame names around it; train's text
    is the sequence of the names of its frames. Both are cut into shards by clip and stretch of `width`
    frames; a shard's passages make an Aho-Corasick automaton, each name in it once, that scans the
    shard's text once and tells for every name found which passages it lies in. Names are made distinct
    first, so copies cost nothing here; sorted shards stream, and beside a batch only the open one, of
    width names at most, is held.
    """
    n, cols = partitions_for(train), ["clip", "__stretch", "__text", "frame"]
    passages = held_out.select("clip", "frame").distinct()
    passages = passages.withColumn("__stretch", F.explode(F.sequence(F.floor((F.col("frame") - near) / width), F.floor((F.col("frame") + near) / width)))).withColumn("__text", F.lit(False))
    texts = train.select("clip", "frame").distinct().withColumn("__stretch", F.floor(F.col("frame") / width)).withColumn("__text", F.lit(True))
    rows = passages.select(*cols).unionByName(texts.select(*cols)).repartition(n, "clip", "__stretch").sortWithinPartitions(*cols)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards in runs_of(batches, ["clip", "__stretch"]):
            named = shards.append_column("__name", pa.array([f"{c}#{s}" for c, s in zip(shards.column("clip").to_pylist(), shards.column("__stretch").to_pylist(), strict=True)]))
            is_text = shards.column("__text")
            held = named.filter(pc.invert(is_text))
            found: dict[str, list[tuple[str, int, int]]] = {}
            for clip, shard, frame, name in zip(*(held.column(c).to_pylist() for c in ("clip", "__stretch", "frame", "__name")), strict=True):
                for at in range(frame - near, frame + near + 1):
                    if at // width == shard:
                        found.setdefault(f"{_MARK}{name}#{at}{_MARK}", []).append((clip, frame, at))
            out: list[tuple[str, int, int]] = []
            if found:
                automaton = ahocorasick.Automaton()
                for name, hits in found.items():
                    automaton.add_word(name, hits)
                automaton.make_automaton()
                names = named.filter(is_text)
                text = "".join(f"{_MARK}{name}#{frame}{_MARK}" for name, frame in zip(names.column("__name").to_pylist(), names.column("frame").to_pylist(), strict=True))
                for _, hits in automaton.iter(text):
                    out += hits
            clips, frames, others = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([pa.array(clips, pa.string()), pa.array(frames, pa.int64()), pa.array(others, pa.int64())], names=["clip", "frame", "train_frame"])

    return rows.mapInArrow(scan, "clip string, frame long, train_frame long")


def coverage(matches: DataFrame) -> DataFrame:
    """(clip, frame, covered, stretches, longest, exact) of each held-out frame that is met: its matched frames merged into intervals."""
    # A passage has 2 * near + 1 frames, so the array is as short.
    merged = matches.groupBy("clip", "frame").agg(F.array_sort(F.collect_set("train_frame")).alias("__m"))
    step = lambda acc, f: F.when(
        acc["end"] == f, F.struct((f + 1).alias("end"), (acc["run"] + 1).alias("run"), F.greatest(acc["longest"], acc["run"] + 1).alias("longest"), acc["n"].alias("n"))
    ).otherwise(F.struct((f + 1).alias("end"), F.lit(1).alias("run"), F.greatest(acc["longest"], F.lit(1)).alias("longest"), (acc["n"] + 1).alias("n")))
    start = F.struct(F.lit(None).cast("long").alias("end"), F.lit(0).alias("run"), F.lit(0).alias("longest"), F.lit(0).alias("n"))
    out = merged.withColumn("__i", F.aggregate("__m", start, step))
    return out.select("clip", "frame", F.size("__m").alias("covered"), F.col("__i.n").alias("stretches"), F.col("__i.longest").alias("longest"), F.array_contains("__m", F.col("frame")).alias("exact"))


def _sides(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = checkpointed(image_records(images).where("clip is not null and frame is not null and split is not null"))
    return rows.where("split = 'train'"), rows.where("split <> 'train'")


def overlapping_images(images: DataFrame, near: int = 2) -> DataFrame:
    """image_id_a < image_id_b: one image in train, the other in val or test, of one clip, frames at most `near` apart.

    Images without split, clip or frame are in none. Every row counts, also copies; empty tables give no rows.
    """
    train, held_out = _sides(images)
    hits = passage_matches(train, held_out, near)
    t = train.select("clip", F.col("frame").alias("train_frame"), F.col("image_id").alias("__t"))
    pairs = hits.join(held_out.select("clip", "frame", F.col("image_id").alias("__e")), ["clip", "frame"]).join(t, ["clip", "train_frame"])
    return pairs.select(F.least("__t", "__e").alias("image_id_a"), F.greatest("__t", "__e").alias("image_id_b"))


def overlap_report(images: DataFrame, near: int = 2) -> DataFrame:
    """Per split and source: images, those with an exact or a near train frame, the mean share of the 2*near+1 frames
    around them that merged intervals of train cover, the number of intervals and the longest."""
    train, held_out = _sides(images)
    rows = held_out.join(coverage(passage_matches(train, held_out, near)), ["clip", "frame"], "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.groupBy("split", "source_group").agg(
        F.count(F.lit(1)).alias("images"), F.sum(F.coalesce(F.col("exact").cast("long"), F.lit(0))).alias("exact_images"), F.count("covered").alias("near_images"),
        F.round(F.avg(none("covered") / (2 * near + 1)), 6).alias("mean_coverage"), F.sum(none("stretches").cast("long")).alias("stretches"), F.max(none("longest")).cast("long").alias("longest"),
    )
