"""Problem 6: the N best of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 63
SALTS = 8


def items_above(df: DataFrame, group: Sequence[str], score: str, same: Sequence[str], key: str, n: int) -> DataFrame:
    """The distinct items of every group that reach its lower threshold, with their `__bin` and `__salt`.

    Rows that agree in group, score and `same` are one item, standing under its smallest key; copies
    combine before any shuffle. A histogram of 63 score bins, each in 8 parts by a hash of the item, is
    kept for every group as the bits of eight numbers, which combine before the shuffle as well. A filled
    bit is at least one distinct item, so at least n items reach the n-th filled bin from above; what
    lies below it is filtered. The filter meets items by (group, bin, part), of which a group has up to
    504, so a hot group is spread; only bins that are cut are sent, none for a group that loses nothing.
    """
    group = list(group)
    part = F.pmod(F.xxhash64(score, *same), F.lit(SALTS)).cast("int")
    rows = df.select(*group, score, *same, key)
    items = rows.groupBy(*group, score, *same).agg(F.min(key).alias(key))
    items = items.withColumns({"__bin": F.floor(F.col(score) * (BINS - 1e-6)).cast("int"), "__salt": part})
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bin"))
    parts = [f"__p{s}" for s in range(SALTS)]
    histogram = items.groupBy(*group).agg(*[F.coalesce(F.bit_or(F.when(F.col("__salt") == s, bit)), F.lit(0).cast("long")).alias(p) for s, p in enumerate(parts)])
    filled = F.col(parts[0])
    for p in parts[1:]:
        filled = filled.bitwiseOR(F.col(p))
    has = lambda bits, b: F.call_function("shiftright", bits, b).bitwiseAND(F.lit(1)) == 1
    cut = histogram.withColumn("__filled", filled).where(F.bit_count("__filled") > n)
    down = F.filter(F.sequence(F.lit(BINS - 1), F.lit(0)), lambda b: has(F.col("__filled"), b))
    cut = cut.withColumn("__below", F.slice(down, n + 1, BINS))

    def of_part(s: int) -> Column:
        return F.transform(F.filter("__below", lambda b: has(F.col(parts[s]), b)), lambda b: F.struct(b.alias("b"), F.lit(s).alias("s")))

    cells = F.flatten(F.array(*map(of_part, range(SALTS))))
    cut = cut.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.explode(cells).alias("__cell")).select("*", "__cell.b", "__cell.s")
    on = (F.col("__bin") == F.col("b")) & (F.col("__salt") == F.col("s"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return items.join(cut, on, "left_anti")


def top_n(df: DataFrame, group: Sequence[str], score: str, same: Sequence[str], key: str, n: int = 3) -> DataFrame:
    """The n items of every group with the highest score, ties by smaller key.

    score lies in 0..1 and is not null. Items are filtered by their group's histogram (items_above);
    survivors are cut to n in each task, then ranked exactly with the key as tie.

    Null group values are a group. Groups of fewer than n items come out whole; empty input gives no rows.
    """
    group = list(group)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), key))
    return items_above(df, group, score, same, key, n).withColumn("rank", rank).where(F.col("rank") <= n).select(*group, "rank", score, key)


def scored(detections: DataFrame) -> DataFrame:
    """Detections with one spelling of their class (case, outer blanks); scores null, NaN or outside 0..1 are out."""
    return detections.select("match_id", "frame_index", F.lower(F.trim("class_name")).alias("class_name"), "score", "box", "det_id").where("score >= 0 and score <= 1 and not isnan(score)")


GROUP = ["match_id", "frame_index", "class_name"]


def top_detections(detections: DataFrame, n: int = 3) -> DataFrame:
    """The n best detections of every match, frame and class."""
    return top_n(scored(detections), GROUP, "score", ["box"], "det_id", n)
