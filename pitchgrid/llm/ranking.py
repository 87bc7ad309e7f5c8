"""Exact ranks by a uniform hash in groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.operators.blocks import blocked_row_number


def salted(salt: str, *columns: Column) -> Column:
    """A reproducible hash (hex) of the values, never of their place; null and '' differ."""
    return F.sha2(F.concat_ws("\x1f", F.lit(salt), *[F.coalesce(c.cast("string"), F.lit("\x1e")) for c in columns]), 256)


def hash_share(hashed: Column) -> Column:
    """Where a hash (hex) lies between 0 and 1, by its first 8 digits."""
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_rank(df: DataFrame, keys: Sequence[str], hashed: str, ties: Sequence[str], name: str = "__rank", digits: int = 3) -> DataFrame:
    """row_number over (keys order by hashed, ties). The leading hex digits of the hash cut a group into 16^digits even blocks."""
    cut = df.withColumn("__top", F.substring(hashed, 1, digits))
    return blocked_row_number(cut, keys, [F.col(hashed), *map(F.col, ties)], "__top", name).drop("__top")
