"""Problem 1: overlapping and gapped intervals per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.operators.blocks import null_safe


def continuous_periods(df: DataFrame, keys: Sequence[str], start: str, end: str, block: int = 4096) -> DataFrame:
    """Periods covered by inclusive integer intervals, and the gaps between successive periods, per keys.

    Spark's session_window with a duration per row merges what overlaps inside a block of `block`
    starts; touching periods and those an interval of an earlier block reaches are joined after it,
    and periods and gaps follow by lead. Equal starts are combined before any shuffle, so a block
    has at most `block` rows however hot its entity is.

    Output: keys, kind ('period' | 'gap'), the start and end columns (inclusive).
    Null or reversed bounds count for nothing; null keys are a group of their own; repeated rows and
    ties change nothing; an empty table gives no rows; other columns are ignored.
    """
    keys = list(keys)
    rows = df.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).select(*keys, F.col(start).cast("long").alias("__s"), (F.col(end).cast("long") + 1).alias("__e"))
    rows = rows.withColumn("__b", F.floor(F.col("__s") / block)).groupBy(*keys, "__b", "__s").agg(F.max("__e").alias("__e"))
    gap = F.make_interval(secs=((F.col("__e") - F.col("__s")).cast("decimal(24,0)") / F.lit(1000000).cast("decimal(8,0)")).cast("decimal(18,6)"))
    window = F.session_window(F.timestamp_micros(F.col("__s")), gap)
    merged = rows.groupBy(*keys, "__b", window.alias("__w")).agg(F.count(F.lit(1)).alias("__n"))
    merged = merged.select(*keys, "__b", F.unix_micros("__w.start").alias("__s"), F.unix_micros("__w.end").alias("__e"))

    by_block = Window.partitionBy(*keys).orderBy("__b")
    reach = rows.groupBy(*keys, "__b").agg(F.max("__e").alias("__be"))
    reach = reach.select(*keys, "__b", F.max("__be").over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"), F.max("__be").over(Window.partitionBy(*keys)).alias("__last"))
    inside = Window.partitionBy(*keys, "__b").orderBy("__s")
    opened = null_safe(merged, reach, [*keys, "__b"]).withColumn("__reach", F.greatest("__carry", F.lag("__e").over(inside)))
    opened = opened.where(F.col("__reach").isNull() | (F.col("__s") > F.col("__reach")))  # touching: __s = __reach goes on

    first = opened.groupBy(*keys, "__b").agg(F.min_by("__reach", "__s").alias("__first"))
    first = first.select(*keys, "__b", F.lead("__first").over(by_block).alias("__next"))
    closed = null_safe(opened.withColumn("__in", F.lead("__reach").over(inside)), first, [*keys, "__b"])
    closed = closed.withColumn("__end", F.coalesce("__in", "__next", "__last"))
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("__s").alias("s"), (F.col("__end") - 1).alias("e")),
        F.struct(F.lit("gap").alias("kind"), F.col("__reach").alias("s"), (F.col("__s") - 1).alias("e")),
    )
    out = closed.select(*keys, F.explode(kinds).alias("__k")).where(F.col("__k.s").isNotNull())
    return out.select(*keys, F.col("__k.kind").alias("kind"), F.col("__k.s").alias(start), F.col("__k.e").alias(end))


def canonical_label(name: str):
    """A label apart from case, outer blanks and `-` or blanks for `_`."""
    return F.regexp_replace(F.lower(F.trim(F.col(name))), "[ -]+", "_")
