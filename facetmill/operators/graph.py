"""The cross-file dependency graph (GRA-1, JOIN-3, JOIN-4, FIL-9 to FIL-11, AGG-5, AGG-6, WIN-4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetmill import shared

from .numbering import number


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    unresolved: DataFrame


NODE = ["entity_id", "entity_type", "simple_name", "qualified_name", "file", "start_line", "end_line", "group_id", "signature", "observed_products"]
#: Why a relation is no edge, by what its target was resolved to.
REASONS = {"RESOLVED_EXTERNAL": "external target", "AMBIGUOUS": "ambiguous target", "UNRESOLVED": "unresolved target", "RESOLVED_INTERNAL": "missing internal target"}


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def reason(source: Column, source_found: Column, target: Column, target_found: Column, status: Column, invalid: Column) -> Column:
    """The first rule that a relation breaks, or null (FIL-10)."""
    by_status = F.lit(None).cast("string")
    for k, v in REASONS.items():
        by_status = F.when(status == k, v).otherwise(by_status)
    return (
        F.when(_blank(source), "missing source entity").when(~source_found, "source entity not found").when(_blank(target), by_status)
        .when(~target_found, "target entity not found").when(invalid, "invalid constructor target type")
    )


def build(entities: DataFrame, relations: DataFrame) -> Graph:
    """Nodes, numbered edges D1.., and what stays unresolved."""
    # entities grow with the input: without the hint Spark would send them whole through the driver while their files are small
    e = entities.select("entity_id", "entity_type", "file", "group_id", "signature").hint("shuffle_hash")
    src = e.toDF(*[f"s_{c}" for c in e.columns])
    dst = e.toDF(*[f"t_{c}" for c in e.columns])
    # ends without text, which may be very many, are dealt over tasks by keys that no entity has
    key = lambda c: F.when(_blank(F.col(c)), F.concat(F.lit("\n"), F.col("relation_id"))).otherwise(F.col(c))
    r = relations.withColumns({"_s": key("source_entity_id"), "_t": key("target_entity_id")})
    r = r.join(src, F.col("_s") == F.col("s_entity_id"), "left").join(dst, F.col("_t") == F.col("t_entity_id"), "left")
    invalid = (F.col("relation_type") == "CONSTRUCTOR_CALL") & (F.col("t_entity_type") != "CONSTRUCTOR")
    r = r.withColumn("failure_reason", reason(F.col("source_entity_id"), F.col("s_entity_id").isNotNull(), F.col("target_entity_id"), F.col("t_entity_id").isNotNull(), F.col("resolution_status"), F.coalesce(invalid, F.lit(False))))
    unresolved = r.where("failure_reason is not null").select(*relations.columns, "failure_reason")

    ok = r.where("failure_reason is null")
    first = F.min(F.struct(F.length("relation_id"), "relation_id", "t_file", "block_id", "s_group_id", "s_signature", "t_group_id", "t_signature", F.col("s_file").alias("s_file")))
    edges = ok.groupBy("source_entity_id", "target_entity_id", "relation_type", "file", "source_line").agg(first.alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("observed_products")))).alias("observed_products"))
    edges = edges.select(
        "source_entity_id", "target_entity_id", "relation_type", F.col("file").alias("source_file"), "source_line", F.col("f.t_file").alias("target_file"), F.col("f.block_id").alias("source_block_id"),
        F.col("f.s_group_id").alias("source_group_id"), F.col("f.s_signature").alias("source_signature"), F.col("f.t_group_id").alias("target_group_id"), F.col("f.t_signature").alias("target_signature"),
        (F.col("f.s_file") != F.col("f.t_file")).alias("cross_file"), "observed_products", F.lit("RESOLVED_INTERNAL").alias("resolution_status"),
    )
    # lines count as text in this key
    key = F.concat_ws("|", "source_file", F.col("source_line").cast("string"), "relation_type", "source_entity_id", "target_entity_id")
    numbered = number(edges, [key], "_n").withColumn("edge_id", F.concat(F.lit("D"), F.col("_n").cast("string"))).drop("_n")
    return Graph(entities.select(*NODE), shared.stored(numbered.select("edge_id", *edges.columns), "edges"), unresolved)


def rollup(edges: DataFrame, keys: list[str], flag: str, total: str = "edge_count", flagged: str = "cross_file_edge_count") -> DataFrame:
    """Edge counts by key, and how many carry the flag (AGG-6, AGG-7)."""
    return edges.groupBy(*keys).agg(F.count("*").alias(total), F.sum(F.col(flag).cast("long")).alias(flagged))


def group_dependencies(edges: DataFrame) -> DataFrame:
    return rollup(edges, ["source_group_id", "target_group_id", "relation_type"], "cross_file")


def degrees(edges: DataFrame, src: str, dst: str, by: list[str] | None = None) -> DataFrame:
    """in_degree, out_degree and degree of each endpoint (AGG-14, GRA-5)."""
    by = by or []
    ends = edges.select(*by, F.col(src).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(*by, F.col(dst), F.lit(1), F.lit(0)))
    out = ends.groupBy(*by, "node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
