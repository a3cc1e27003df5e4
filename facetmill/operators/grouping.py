"""Signature groups of blocks (FIL-1, AGG-1, AGG-2, WIN-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.functions import text as tx

from . import numbering


def number_sets(rows: DataFrame, ids: str, prefix: str = "G") -> DataFrame:
    """(ids, group_id, n_rows) of the distinct id arrays, numbered in array order."""
    distinct = rows.groupBy(ids).agg(F.count("*").alias("n_rows"))
    return numbering.number(distinct, [F.col(ids)], "_n").withColumn("group_id", F.concat(F.lit(prefix), F.col("_n").cast("string"))).drop("_n")


def universe(rows: DataFrame, ids: str) -> DataFrame:
    """One row: the sorted union of all id arrays (AGG-2)."""
    each = rows.select(F.explode(ids).alias("x")).distinct()
    return each.agg(F.array_sort(F.collect_list("x")).alias("universe"))


def groupable(blocks: DataFrame) -> DataFrame:
    """IF, ELIF and ELSE blocks with products (FIL-1), with canonical ids."""
    kept = blocks.where(F.col("directive").isin("IF", "ELIF", "ELSE") & (F.size("ids") > 0))
    return kept.withColumn("canonical", tx.canonical_ids(F.col("ids")))


def group(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups(group_id, ids, signature, block_count) and group_blocks: each block with its group."""
    kept = groupable(blocks)
    named = number_sets(kept, "canonical")
    groups = named.select("group_id", F.col("canonical").alias("ids"), tx.join_ids(F.col("canonical")).alias("signature"), F.col("n_rows").alias("block_count"))
    members = kept.join(groups.select("group_id", F.col("ids").alias("canonical"), "signature"), "canonical").drop("canonical")
    return groups, members


def commonality(ids, universe_ids):
    """FULL, SUBGROUP or VARIABLE by how a signature compares with the universe (FIL-14)."""
    return F.when(ids == universe_ids, "FULL_COMMONALITY").when(F.size(ids) > 1, "SUBGROUP_COMMONALITY").otherwise("VARIABLE_SIGNATURE")
