"""Problem 4: runs of repeated consecutive events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.operators.intervals import canonical_label


def collapse_runs(df: DataFrame, entity: Sequence[str], at: str, value: str, number: str, tolerance: float, latest: Sequence[Column], block: int = 65_536, least: int = 1) -> DataFrame:
    """One row for each maximal run of events of an entity whose `at` rises by 1, whose value is equal and whose number moves by at most tolerance.

    Of several rows of one `at` the last by `latest` counts. A row with null value or number belongs to
    no run and ends one; null entity or `at` count for nothing. Events are made canonical: value with
    the number of breaks so far (a jump of `at` or of the number). Row number within the entity less row
    number within entity and canonical value is constant in a run, and runs are aggregated by it. That is
    done in blocks of `block` positions, so a hot entity is never in one task; then the first and last
    runs of the blocks, which alone can go on beyond a border, are joined where one does.

    Output: entity, value, start, end, events, duration, mean_number; runs of `least` rows at least.
    An empty table gives no rows.
    """
    entity = list(entity)
    rows = df.where(F.col(at).isNotNull())
    for e in entity:
        rows = rows.where(F.col(e).isNotNull())
    rows = rows.groupBy(*entity, F.col(at).cast("long").alias("__at")).agg(F.max_by(F.struct(F.col(value).alias("v"), F.col(number).cast("double").alias("c")), F.struct(*latest)).alias("__e"))
    rows = rows.select(*entity, "__at", F.col("__e.v").alias("__v"), F.when(~F.isnan("__e.c"), F.col("__e.c")).alias("__c"), F.floor(F.col("__at") / block).alias("__b"))
    inside = Window.partitionBy(*entity, "__b").orderBy("__at")
    close = lambda c, before: F.round(F.abs(c - before), 9) <= tolerance
    goes_on = (F.col("__at") == F.lag("__at").over(inside) + 1) & close(F.col("__c"), F.lag("__c").over(inside))
    rows = rows.withColumn("__break", (~F.coalesce(goes_on, F.lit(False))).cast("long"))
    rows = rows.withColumns({"__stretch": F.sum("__break").over(inside), "__all": F.row_number().over(inside)})
    usable = rows.where("__v is not null and __c is not null")
    own = F.row_number().over(Window.partitionBy(*entity, "__b", "__v", "__stretch").orderBy("__at"))
    runs = usable.withColumn("__run", F.col("__all") - own).groupBy(*entity, "__b", "__v", "__stretch", "__run").agg(
        F.min("__at").alias("start"), F.max("__at").alias("end"), F.count(F.lit(1)).alias("events"), F.sum("__c").alias("__sum"),
        F.min_by("__c", "__at").alias("__first"), F.max_by("__c", "__at").alias("__last"),
    )
    runs = runs.select(*entity, F.col("__v").alias(value), "start", "end", "events", "__sum", "__first", "__last", (F.col("start") == F.col("__b") * block).alias("__opens"), (F.col("end") == F.col("__b") * block + block - 1).alias("__closes"))
    edge = F.col("__opens") | F.col("__closes")
    order = Window.partitionBy(*entity).orderBy("start")
    joins = F.col("__opens") & F.lag("__closes").over(order) & (F.col("start") == F.lag("end").over(order) + 1) & (F.col(value) == F.lag(value).over(order)) & close(F.col("__first"), F.lag("__last").over(order))
    chain = runs.where(edge).withColumn("__new", (~F.coalesce(joins, F.lit(False))).cast("long"))
    chain = chain.withColumn("__chain", F.sum("__new").over(order)).groupBy(*entity, value, "__chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("events").alias("events"), F.sum("__sum").alias("__sum"))
    cols = [*entity, value, "start", "end", "events", "__sum"]
    out = runs.where(~edge).select(*cols).unionByName(chain.select(*cols))
    return out.where(F.col("events") >= least).select(*entity, value, "start", "end", "events", F.expr("end - start + 1").alias("duration"), (F.col("__sum") / F.col("events")).alias("mean_number"))


def state_runs(states: DataFrame, tolerance: float = 0.05, least: int = 1) -> DataFrame:
    """Runs of nearly unchanged frame states per match."""
    return collapse_runs(states.withColumn("state", canonical_label("state")), ["match_id"], "frame_index", "state", "confidence", tolerance, [F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp")), F.col("state_id")], least=least)
