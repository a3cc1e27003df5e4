"""Dense numbers over an order, of all rows or in groups, without one task that sees a whole group (WIN-1 to WIN-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill import shared


def number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its rank from 1 in the order given, which should be total."""
    return number_within(df, [], order, name)


def number_within(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with its rank from 1 among the rows with equal ``by`` (null equals null); the order should be total there.

    Rows are sorted by ranges of (by, order) and stored with their place, so a large
    group lies in as many ranges as its size asks for. Each range has a row for each
    group in it, with how many rows of it there are and where they start; a running
    sum of these, by group, is what a place still needs to be a rank.
    """
    placed = shared.stored(df.orderBy(*by, *order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    keyed = placed.withColumns({"_part": F.shiftright("_at", 33), "_g": F.struct(*by) if by else F.lit(0)})
    spans = keyed.groupBy("_g", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spans.select("_g", "_part", (before - F.col("_first") + 1).alias("_shift"))
    if not by:
        starts = F.broadcast(starts)  # a row for each partition
    return keyed.join(starts, ["_g", "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_g", "_shift")
