"""Ranked evidence profiles of aggregated candidates (AGG-12 to AGG-16, WIN-7, TOP-2, TOP-5, LAB-5 to LAB-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetmill.config import ENTITY_TYPES, AggregationConfig
from facetmill.functions import text as tx

from . import graph, numbering, tokens
from .clustering import Aggregation
from .components import Candidates

NOTE = "NOTE: descriptive implementation concept only; not a recovered feature name"


def importance_order(order: str = "asc") -> list[Column]:
    """By score, ascending unless asked otherwise, then degree descending and place (WIN-7)."""
    score = F.asc("score") if order == "asc" else F.desc("score")
    return [score, F.desc("degree"), F.asc("file"), F.asc("start_line"), F.asc("entity_id")]


def ranked(entities: DataFrame, degree: DataFrame, by: str, order: str = "asc") -> DataFrame:
    """Entities of each candidate with degrees, score and rank."""
    d = degree.select(by, F.col("node").alias("entity_id"), "in_degree", "out_degree", "degree")
    out = entities.join(d, [by, "entity_id"], "left").na.fill(0, ["in_degree", "out_degree", "degree"])
    out = out.withColumn("score", 2 * F.col("degree") + F.col("in_degree") + F.col("out_degree"))
    return numbering.number_within(out, [by], importance_order(order), "rank").withColumn("rank", F.col("rank").cast("int"))


def concept(top: Column) -> Column:
    """LAB-5."""
    a, b = F.get(top, F.lit(0)), F.get(top, F.lit(1))
    return F.when(F.size(top) == 0, "Unlabeled implementation cluster").when(F.size(top) == 1, F.concat(tx.capitalize(a), F.lit(" implementation cluster"))).otherwise(F.concat(tx.capitalize(a), F.lit("-"), b, F.lit(" implementation cluster")))


def endpoints(edges: DataFrame, end: str, names: DataFrame | None, out: str) -> DataFrame:
    """The eight most frequent ends of internal edges as ``name:count`` (AGG-15, TOP-5); without ``names``, ends are names."""
    n = edges.groupBy("candidate_id", F.col(end).alias("entity_id")).agg(F.count("*").alias("n"))
    top = tokens.top_k(n, ["candidate_id"], [F.desc("n"), F.asc("entity_id")], 8)
    named = top.withColumn("name", F.col("entity_id")) if names is None else top.join(names, ["candidate_id", "entity_id"], "left")
    named = named.withColumn("x", F.concat(F.coalesce("name", F.lit("<external>")), F.lit(":"), F.col("n").cast("string")))
    return named.groupBy("candidate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "x"))), lambda v: v["x"]).alias(out))


def _sorted(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.groupBy("candidate_id").agg(F.array_sort(F.collect_set(value)).alias(name))


def build(c: Candidates, a: Aggregation, config: AggregationConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """profiles, one row each, and importance: the ranked entities."""
    config = config or AggregationConfig()
    of = a.members.select("candidate_id", "component_id")
    own = lambda df: df.withColumnRenamed("candidate_id", "component_id").join(of, "component_id")
    entities, internal = own(c.entities), own(c.internal)
    ends = internal.select("candidate_id", F.col("source_entity_id").alias("s"), F.col("target_entity_id").alias("t"))
    inner = graph.degrees(ends, "s", "t", ["candidate_id"])
    inc = a.incoming.groupBy("candidate_id", F.col("target_entity_id").alias("node")).agg(F.count("*").alias("in_degree"))
    out = a.outgoing.groupBy("candidate_id", F.col("source_entity_id").alias("node")).agg(F.count("*").alias("out_degree"))
    zero = F.lit(0)
    degree = inner.select("candidate_id", "node", "in_degree", "out_degree").union(inc.select("candidate_id", "node", "in_degree", zero)).union(out.select("candidate_id", "node", zero, "out_degree"))
    degree = degree.groupBy("candidate_id", "node").agg(F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    name = tx.display_name(F.col("qualified_name"), F.col("simple_name"))
    rank = ranked(entities, degree, "candidate_id", config.importance_order).withColumn("name", name)

    item = F.struct("rank", "name", "score", "entity_type", "file", "start_line", "end_line")
    first = [F.array_sort(F.collect_list(F.when(F.col("rank") <= k, item))).alias(c) for k, c in ((5, "representative_entities"), (3, "_three"))]
    tops = rank.groupBy("candidate_id").agg(*first, F.count_if(F.col("degree") == 0).alias("isolated_entity_count"))
    by_type = tokens.top_k(rank, ["candidate_id", "entity_type"], [F.col("rank")], 5, "t_rank")
    of_type = [F.array_sort(F.collect_list(F.when(F.col("entity_type") == t, item))).alias(f"top_{t.lower()}") for t in ENTITY_TYPES]
    typed = by_type.groupBy("candidate_id").agg(*of_type)

    freq = a.frequencies.join(of, "component_id").groupBy("candidate_id", "token").agg(F.sum("n").alias("n"))
    names = entities.select("candidate_id", "entity_id", name.alias("name"))
    seen = a.evidence.join(of, "component_id").join(names.withColumnRenamed("entity_id", "source_entity_id"), ["candidate_id", "source_entity_id"], "left")
    top = tokens.top_k(freq, ["candidate_id"], [F.desc("n"), F.asc("token")], 8)
    seen = seen.join(top.select("candidate_id", "token"), ["candidate_id", "token"], "left_semi")
    origin = seen.groupBy("candidate_id", "token").agg(F.array_sort(F.collect_set(F.concat("provenance", F.lit(":"), F.coalesce("name", F.lit("<external>"))))).alias("origins"))
    top = top.join(origin, ["candidate_id", "token"])
    top = top.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("rank", "token", "n", "origins"))).alias("top_tokens"))

    types = internal.groupBy("candidate_id", "relation_type").agg(F.count("*").alias("n"))  # AGG-9
    types = types.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("relation_type", "n"))).alias("internal_types"))
    is_type, is_code = F.col("entity_type").isin("CLASS", "INTERFACE"), F.col("entity_type").isin("METHOD", "CONSTRUCTOR")
    package = tx.package_prefix(F.col("qualified_name"))
    parts = [
        tops, typed, top, types, endpoints(internal, "target_entity_id", names, "top_targets"), endpoints(internal, "source_entity_id", names, "top_sources"),
        _sorted(entities.where("qualified_name is not null").where(F.trim(package) != ""), package, "packages"), _sorted(entities.where(is_type), name, "classes"), _sorted(entities.where(is_code), name, "methods"),
        _sorted(entities.select("candidate_id", F.explode("observed_products").alias("p")), F.col("p"), "_products"),
    ]
    p = a.candidates
    for part in parts:
        p = p.join(part, "candidate_id", "left")
    none = F.array().cast("array<string>")
    p = p.withColumns({k: F.coalesce(k, none) for k in ("packages", "classes", "methods", "top_targets", "top_sources")})
    words = F.coalesce(F.transform("top_tokens", lambda x: x["token"]), none)
    counted = F.coalesce(F.transform("top_tokens", lambda x: F.concat(x["token"], F.lit(":"), x["n"].cast("string"))), none)
    p = p.withColumns({"observed_products": F.coalesce("_products", F.array_sort(tx.parse_signature(F.col("signature")))), "implementation_concept": concept(words), "token_counts": counted, "isolated_entity_count": F.coalesce("isolated_entity_count", F.lit(0))})
    said = F.array(
        F.when(F.size("token_counts") > 0, F.concat(F.lit("tokens="), F.array_join("token_counts", "|"))),
        F.when(F.size("_three") > 0, F.concat(F.lit("entities="), F.array_join(F.transform("_three", lambda x: x["name"]), "|"))),
        F.when(F.size("top_targets") > 0, F.concat(F.lit("dependencyTargets="), F.array_join(F.slice("top_targets", 1, 3), "|"))), F.lit(NOTE),
    )
    return p.withColumn("concept_evidence", F.filter(said, lambda x: x.isNotNull())).drop("_three", "_products"), rank
