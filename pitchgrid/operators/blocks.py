"""Ordered work on groups of any size.

A window over a whole group puts that group into one task. These helpers cut a group's order into
blocks, work inside the blocks, and carry what must cross a border through one summary row per block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; right's key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"__r_{k}"])
        on = one if on is None else on & one
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def blocked_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: str, name: str) -> DataFrame:
    """row_number over (keys order by order) from row numbers inside blocks.

    block: a column that rises with the order; each (keys, block) must be small enough for a task.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*keys, block).orderBy(*order))
    return null_safe(df, offsets, [*keys, block]).withColumn(name, (F.col("__before") + inside).cast("long")).drop("__before")


def _cut(df: DataFrame, keys: Sequence[str], at: str, width: int) -> DataFrame:
    """Rows with __cut, the stretch of `width` they lie in, placed by (keys, __cut)."""
    return df.withColumn("__cut", F.floor(F.col(at) / width)).repartition(*keys, "__cut")


def lagged(df: DataFrame, keys: Sequence[str], at: str, columns: dict[str, str], width: int = 65_536) -> DataFrame:
    """Adds, for {new: column}, the values of the row before in the order of `at` (whole, unique in the keys); null on the first.

    Inside a stretch by lag; at its head from the last row of the stretch before, so no key is one task."""
    keys = list(keys)
    rows = _cut(df, keys, at, width)
    row = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    lasts = rows.groupBy(*keys, "__cut").agg(F.max_by(row, at).alias("__last"))
    lasts = lasts.select(*keys, "__cut", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__cut")).alias("__before"))
    rows = rows.withColumn("__row", F.lag(row).over(Window.partitionBy(*keys, "__cut").orderBy(at)))
    rows = null_safe(rows, lasts, [*keys, "__cut"]).withColumn("__row", F.coalesce("__row", "__before"))
    return rows.withColumns({n: F.col(f"__row.{n}") for n in columns}).drop("__row", "__before", "__cut")


def last_known(df: DataFrame, keys: Sequence[str], at: str, value: Column, name: str, width: int = 65_536) -> DataFrame:
    """Adds the last value that is not null up to each row in the order of `at`, carried across stretches."""
    keys = list(keys)
    rows = _cut(df.withColumn("__v", value), keys, at, width)
    ends = rows.groupBy(*keys, "__cut").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(at))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__cut", F.last("__end", ignorenulls=True).over(before).alias("__before"))
    inside = Window.partitionBy(*keys, "__cut").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__here", F.last("__v", ignorenulls=True).over(inside))
    return null_safe(rows, ends, [*keys, "__cut"]).withColumn(name, F.coalesce("__here", "__before")).drop("__here", "__before", "__v", "__cut")


def frame_runs(df: DataFrame, keys: Sequence[str], at: str, parts: dict[str, Column], merged: dict[str, Column], width: int = 65_536) -> DataFrame:
    """Runs of successive `at` (whole, unique in the keys): keys, start, end and the merged figures.

    parts: what a run inside one stretch gives, by name; merged: what the pieces of a run give, over those names. Only the first and
    last run of a stretch can go on beyond it, and only these meet in a window over the key."""
    keys = list(keys)
    rows = _cut(df, keys, at, width)
    island = F.col(at) - F.row_number().over(Window.partitionBy(*keys, "__cut").orderBy(at))
    runs = rows.withColumn("__island", island).groupBy(*keys, "__cut", "__island").agg(F.min(at).alias("start"), F.max(at).alias("end"), *[c.alias(n) for n, c in parts.items()])
    edge = (F.col("start") == F.col("__cut") * width) | (F.col("end") == F.col("__cut") * width + width - 1)
    order = Window.partitionBy(*keys).orderBy("start")
    inner = runs.where(~edge).withColumn("__run", F.col("start"))
    outer = runs.where(edge).withColumn("__new", F.when(F.lag("end").over(order) == F.col("start") - 1, None).otherwise(F.col("start"))).withColumn("__run", F.last("__new", ignorenulls=True).over(order)).drop("__new")
    joined = outer.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[c.alias(n) for n, c in merged.items()])
    alone = inner.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[c.alias(n) for n, c in merged.items()])
    return joined.unionByName(alone).drop("__run")


def with_piece(df: DataFrame, keys: Sequence[str], at: str, gap: int, width: int = 65_536) -> DataFrame:
    """Adds __piece: rows of the keys in stretches of time between which nothing stands for more than `gap`; a piece is named by its first `at`.

    State that is forgotten after `gap` is empty at each beginning, so pieces can be worked apart."""
    keys = list(keys)
    times = lagged(df.select(*keys, at).distinct(), keys, at, {"__was": at}, width)
    opens = F.when(F.col("__was").isNull() | (F.col(at) - F.col("__was") > gap), F.col(at))
    named = last_known(times, keys, at, opens, "__piece", width).select(*keys, at, "__piece")
    return null_safe(df, named, [*keys, at])


def block_rows(df: DataFrame, key: str, order: str, width: int, block: int, halo: int, ranked: bool = False) -> DataFrame:
    """Rows in blocks of `block` successive ones of a key, sorted by (key, __block, order), for work on one block at a time.

    Adds __block and __core; rows within `halo` of a border also stand, not as core, in the block beyond
    it. key and order are not null and order is a whole number, unique within the key: stretches of
    `width` of it are numbered apart and their sizes summed, so no window spans a key. ranked: order is
    the row's number in its key already.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranked:
        rows = df.withColumn("__rank", F.col(order))
    else:
        cut = df.withColumn("__cut", F.floor(F.col(order) / width)).repartition(n, key, "__cut")
        sizes = cut.groupBy(key, "__cut").agg(F.count(F.lit(1)).alias("__n"))
        before = F.sum("__n").over(Window.partitionBy(key).orderBy("__cut")) - F.col("__n")
        rows = cut.join(sizes.select(key, "__cut", before.alias("__before")), [key, "__cut"])
        rows = rows.withColumn("__rank", F.col("__before") + F.row_number().over(Window.partitionBy(key, "__cut").orderBy(order))).drop("__cut", "__before")
    own, of = F.floor((F.col("__rank") - 1) / block), lambda shift: F.floor((F.col("__rank") - 1 + shift) / block)
    rows = rows.withColumns({"__own": own, "__in": F.sequence(F.greatest(F.lit(0), of(-halo)), of(halo))})
    rows = rows.withColumn("__block", F.explode("__in")).withColumn("__core", F.col("__block") == F.col("__own")).drop("__own", "__in", "__rank")
    return rows.repartition(n, key, "__block").sortWithinPartitions(key, "__block", order)


def runs_of(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys; at most the open group is held beside a batch."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        last = [t.column(k)[t.num_rows - 1].as_py() for k in keys]
        lo, hi = 0, t.num_rows - 1  # first row of the last group, by halving
        while lo < hi:
            mid = (lo + hi) // 2
            if [t.column(k)[mid].as_py() for k in keys] == last:
                hi = mid
            else:
                lo = mid + 1
        open_key = [held[-1].column(k)[0].as_py() for k in keys] if held else None
        if open_key is not None and open_key != [t.column(k)[0].as_py() for k in keys]:
            yield pa.concat_tables(held)
            held = []
        if lo > 0:
            yield pa.concat_tables([*held, t.slice(0, lo)])
            held = []
        held.append(t.slice(lo))
    if held:
        yield pa.concat_tables(held)
