"""Problem 3: a reproducible sample that stays as data grow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.llm.paths import clip_of_path, frame_of_path, name_of_path, one_spelling
from pitchgrid.llm.ranking import hash_rank, hash_share, salted
from pitchgrid.operators.blocks import null_safe
from pitchgrid.session import checkpointed


def frozen_bottom_k(df: DataFrame, item: Sequence[str], strata: Sequence[str], batch: str, rate: float = 0.1, salt: str = "review", keep: Sequence[str] = ()) -> DataFrame:
    """The sampled items: per stratum, of each arrival batch the smallest salted hashes.

    A batch is immutable: rows of its number arrive together and none later. An item belongs to the first
    numbered batch it came with; later copies, and copies without a number, change nothing. Batch b of a
    stratum gives ceil(rate * N_b) - ceil(rate * N_(b-1)) items, N_b its items up to b: exactly the
    ceil(rate * size) smallest of the first batch, and on the whole exactly ceil(rate * size) of the
    stratum, where a ceil of each batch alone would draw far more than the rate from many small batches.
    What a batch gives depends on it and on earlier batches alone, so the sample only ever grows.

    Rows without a batch belong to no batch that could be frozen, whatever arrives when; an item delivered
    that way is drawn where its hash lies in the first `rate` of all hashes, which no other row changes.
    Its batch is null unless a numbered batch has the item too.

    Output: item, strata, batch, keep: strata and keep of the item's first row, in the order of their values.
    Null strata form a stratum; null item columns are a value; items with equal hash go by their columns;
    an empty table gives no rows.
    """
    item, strata, keep = list(item), list(strata), list(keep)
    named, known = F.struct(*strata, *keep), F.col(batch).isNotNull()
    first = df.groupBy(*item).agg(F.min(F.when(known, F.struct(F.col(batch).alias("b"), named.alias("f")))).alias("__known"), F.min(named).alias("__any"), F.max((~known).cast("int")).alias("__loose"))
    value = lambda c: F.coalesce(F.col("__known.f"), F.col("__any"))[c].alias(c)
    rows = first.select(*item, F.col("__known.b").alias(batch), *[value(c) for c in (*strata, *keep)], "__loose").withColumn("__h", salted(salt, *map(F.col, item)))
    rows = checkpointed(rows)  # ranks, sizes and loose rows each need other columns of it, for which one exchange would run three times
    batched = rows.where(F.col(batch).isNotNull())
    sizes = batched.groupBy(*strata, batch).agg(F.count(F.lit(1)).alias("__n")).withColumn("__cum", F.sum("__n").over(Window.partitionBy(*strata).orderBy(batch)))
    ceil_of = lambda n: F.ceil(F.round(n * F.lit(rate), 9))
    sizes = sizes.select(*strata, batch, (ceil_of(F.col("__cum")) - ceil_of(F.col("__cum") - F.col("__n"))).alias("__k"))
    ranked = hash_rank(batched, [*strata, batch], "__h", item)
    loose = (F.col("__loose") == 1) & (hash_share(F.col("__h")) < rate)
    out = [*item, *strata, batch, *keep]
    drawn = null_safe(ranked, sizes, [*strata, batch]).where((F.col("__rank") <= F.col("__k")) | loose)
    return drawn.select(*out).unionByName(rows.where(F.col(batch).isNull() & loose).select(*out))


def image_key(spelt: Column, frame: Column) -> Column:
    """An image (path in one spelling, frame): folder, clip, file name and frame."""
    return F.concat_ws("/", clip_of_path(spelt), name_of_path(spelt), F.coalesce(frame, frame_of_path(spelt)).cast("string"))


def review_sample(images: DataFrame, rate: float = 0.1, salt: str = "review") -> DataFrame:
    """image_key, source_group (one spelling), ingest_batch and the smallest image_id of each image drawn for review."""
    rows = images.select(one_spelling(F.col("image_path")).alias("__p"), "frame_index", one_spelling(F.col("source_group")).alias("source_group"), "ingest_batch", "image_id")
    rows = rows.select(image_key(F.col("__p"), F.col("frame_index")).alias("image_key"), "source_group", "ingest_batch", "image_id")
    return frozen_bottom_k(rows, ["image_key"], ["source_group"], "ingest_batch", rate, salt, ["image_id"])
