"""Structural candidates: weak components of each signature group, and what belongs to them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetmill import shared
from facetmill.config import SCOPES

from . import intervals, numbering
from .wcc import weakly_connected_components, with_isolated


@dataclass(frozen=True)
class Candidates:
    """candidates, and by candidate_id: entities, blocks, internal, incoming and outgoing edges; dependencies."""

    candidates: DataFrame
    entities: DataFrame
    blocks: DataFrame
    internal: DataFrame
    incoming: DataFrame
    outgoing: DataFrame
    dependencies: DataFrame


UNASSIGNED_BLOCKS = "block_id string, group_id string, signature string, file string, branch_type string, start_line int, end_line int, reason string"


#: Rows with one name in a block, so that a cell of containers and members makes BLOCK**2 pairs at most.
BLOCK = 4096


def containment(entities: DataFrame, keys: list[str], name: str, ident: str, is_container: Column, separator: str = ".", is_member: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(container, member) where the member's name goes on from the container's, within equal keys (JOIN-12).

    A member looks for each beginning of its name that ends before a separator, so
    the join is by equality. Containers of one name, and members below one, are cut into
    blocks of rows, and every two blocks meet in a cell of their own, so a name with
    very many of both, which makes quadratically many pairs, spreads over tasks.
    """
    c = entities.where(is_container & F.col(name).isNotNull() & (F.trim(name) != "")).select(*[F.col(k).alias(f"c_{k}") for k in keys], F.col(name).alias("c_name"), F.col(ident).alias("container"))
    parts = F.split(F.col(name), re.escape(separator), -1)
    m = entities.where(F.col(name).isNotNull() if is_member is None else is_member & F.col(name).isNotNull()).select(*[F.col(k).alias(f"m_{k}") for k in keys], F.col(ident).alias("member"), parts.alias("_p")).where(F.size("_p") > 1)
    m = m.withColumn("m_name", F.explode(F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda i: F.array_join(F.slice("_p", F.lit(1), i), separator)))).drop("_p")
    at_c, at_m = [f"c_{x}" for x in (*keys, "name")], [f"m_{x}" for x in (*keys, "name")]
    m = m.dropna(subset=at_m).join(c.select(*[F.col(x).alias(f"m{x[1:]}") for x in at_c]).distinct(), at_m, "left_semi")
    # only names with more than a block of either are dealt; blocks come from hashes of what is there, so a block holds about ``block`` rows
    many = c.groupBy(*at_c).agg(F.count("*").alias("_n")).where(F.col("_n") > block).select(*at_c, F.ceil(F.col("_n") / block).cast("int").alias("_i"))
    below = m.groupBy(*at_m).agg(F.count("*").alias("_n")).where(F.col("_n") > block).select(*at_m, F.ceil(F.col("_n") / block).cast("int").alias("_j"))
    sizes = many.toDF(*at_m, "_i").join(below, at_m, "full").select(*at_m, F.coalesce("_i", F.lit(1)).alias("_i"), F.coalesce("_j", F.lit(1)).alias("_j"))
    sizes = shared.stored(sizes, "blocks_of_names")
    cells = lambda n: F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)
    mine = lambda x, n: F.pmod(F.xxhash64(x), F.coalesce(n, F.lit(1))).cast("int")
    c = c.join(sizes.toDF(*at_c, "_i", "_j"), at_c, "left").select(*at_c, "container", mine("container", F.col("_i")).alias("_ci"), F.explode(cells(F.col("_j"))).alias("_cj"))
    m = m.join(sizes, at_m, "left").select(*at_m, "member", F.explode(cells(F.col("_i"))).alias("_mi"), mine("member", F.col("_j")).alias("_mj"))
    c, m = shared.dealt(c, *at_c, "_ci", "_cj"), shared.dealt(m, *at_m, "_mi", "_mj")
    on = (F.col("_ci") == F.col("_mi")) & (F.col("_cj") == F.col("_mj"))
    for x, y in zip(at_c, at_m, strict=True):
        on = on & (F.col(x) == F.col(y))
    return c.join(m, on & (F.col("container") != F.col("member"))).select("container", "member")


def classification(block_only: Column, entities: Column, internal: Column) -> Column:
    """FIL-12."""
    return F.when(block_only, "BLOCK_ONLY").when((entities == 1) & (internal == 0), "ISOLATED_ENTITY").when(entities > 0, "STRUCTURALLY_CONNECTED").otherwise("UNCLASSIFIED")


def scope(source: Column, target: Column, source_group: Column, target_group: Column) -> Column:
    """FIL-13."""
    return F.when(source == target, SCOPES[0]).when(source_group == target_group, SCOPES[1]).otherwise(SCOPES[2])


def associate(members: DataFrame, blocks: DataFrame, internal_sources: DataFrame) -> DataFrame:
    """(candidate_id, block_id): an entity names the block, stands in it, or an edge starts in it (JOIN-13).

    Three joins and a union: one OR condition would be a nested loop. Lines meet blocks
    by nodes of a tree over the lines, so a hot file is not one key.
    """
    b = blocks.select("group_id", "block_id", "file", "start_line", "end_line").distinct()
    named = members.join(b.select("group_id", "block_id"), ["group_id", "block_id"]).select("candidate_id", "block_id")
    m = members.select("candidate_id", "group_id", "file", F.col("start_line").alias("_at")).distinct()
    inside = intervals.covering(m, b, ["group_id", "file"], "_at", "start_line", "end_line").select("candidate_id", "block_id")
    starts = internal_sources.join(b.select("group_id", "block_id"), ["group_id", "block_id"]).select("candidate_id", "block_id")
    return named.union(inside).union(starts).distinct()


def numbered(prefix: str, group: Column, n: Column) -> Column:
    """Two digits at least (WIN-5, WIN-6)."""
    return F.format_string(f"{prefix}%s-%02d", group, n)


def build(groups: DataFrame, group_blocks: DataFrame, entities: DataFrame, edges: DataFrame) -> Candidates:
    """Components of same-group edges and containment, then blocks that none covers."""
    ids = groups.select("group_id")
    members = entities.join(ids, "group_id", "left_semi")
    # what has a row for each entity is never sent through the driver, however small its files
    known = members.select(F.col("entity_id")).hint("shuffle_hash")
    same = edges.where("source_group_id = target_group_id")
    same = same.join(known, F.col("source_entity_id") == F.col("entity_id"), "left_semi").join(known, F.col("target_entity_id") == F.col("entity_id"), "left_semi")
    holds = containment(members, ["group_id", "file"], "qualified_name", "entity_id", F.col("entity_type").isin("CLASS", "INTERFACE"))
    links = same.select("source_entity_id", "target_entity_id").union(holds)
    labels = with_isolated(members, "entity_id", weakly_connected_components(links, "source_entity_id", "target_entity_id"))
    placed = members.join(labels.withColumnRenamed("node", "entity_id").hint("shuffle_hash"), "entity_id")

    # the first entity of a component, with its line as text, orders components
    first = placed.groupBy("group_id", "label").agg(F.min(F.struct("file", "start_line", "entity_id")).alias("m"))
    key = F.concat_ws("|", "m.file", F.col("m.start_line").cast("string"), "m.entity_id")
    ordered = numbering.number_within(first, ["group_id"], [key], "n")
    named = ordered.select("group_id", "label", "n", numbered("FEC-", F.col("group_id"), F.col("n")).alias("candidate_id"))
    owned = shared.stored(placed.join(named.drop("n"), ["group_id", "label"]).drop("label"), "members")
    of = owned.select("entity_id", "candidate_id").hint("shuffle_hash")

    s, t = of.toDF("source_entity_id", "s_candidate"), of.toDF("target_entity_id", "t_candidate")
    touched = shared.stored(edges.join(s, "source_entity_id").join(t, "target_entity_id"), "touched")
    internal = touched.where("s_candidate = t_candidate and source_group_id = target_group_id").withColumnRenamed("s_candidate", "candidate_id").drop("t_candidate")
    across = touched.where("s_candidate <> t_candidate")
    outgoing = across.select(F.col("s_candidate").alias("candidate_id"), *edges.columns, F.col("t_candidate").alias("other_candidate_id"))
    incoming = across.select(F.col("t_candidate").alias("candidate_id"), *edges.columns, F.col("s_candidate").alias("other_candidate_id"))

    sources = touched.where("source_group_id = target_group_id").select(F.col("s_candidate").alias("candidate_id"), F.col("source_group_id").alias("group_id"), F.col("source_block_id").alias("block_id")).distinct()
    covered = associate(owned, group_blocks, sources)
    block = group_blocks.groupBy("group_id", "block_id", "file", "directive", "start_line", "end_line", "signature").agg(F.count("*").alias("_n")).drop("_n")
    left = block.join(covered.select("block_id").distinct(), "block_id", "left_anti")  # JOIN-14, SET-5
    taken = named.groupBy("group_id").agg(F.max("n").alias("base"))
    left = numbering.number_within(left, ["group_id"], [F.col("file"), F.col("start_line"), F.col("directive"), F.col("block_id")], "k").join(taken, "group_id", "left").withColumn("n", F.coalesce("base", F.lit(0)) + F.col("k")).drop("k")
    left = left.withColumn("candidate_id", numbered("FEC-", F.col("group_id"), F.col("n")))
    blocks = shared.stored(covered.join(block, "block_id").unionByName(left.select("candidate_id", *block.columns)), "candidate_blocks")

    all_ = named.select("candidate_id", "group_id", F.lit(False).alias("block_only")).union(left.select("candidate_id", "group_id", F.lit(True)))
    candidates = shared.stored(summarise(all_, groups, owned, blocks, internal, incoming, outgoing), "candidates")
    return Candidates(candidates, owned, blocks, internal, incoming, outgoing, dependencies(candidates, internal, outgoing))


def summarise(ids: DataFrame, groups: DataFrame, entities: DataFrame, blocks: DataFrame, internal: DataFrame, incoming: DataFrame, outgoing: DataFrame) -> DataFrame:
    """One row for each candidate with its sets and counts (AGG-8)."""

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("candidate_id").agg(F.count("*").alias(name))

    files = entities.select("candidate_id", "file").union(blocks.select("candidate_id", "file")).groupBy("candidate_id").agg(F.array_sort(F.collect_set("file")).alias("files"))
    products = entities.select("candidate_id", F.explode("observed_products").alias("p")).groupBy("candidate_id").agg(F.array_sort(F.collect_set("p")).alias("products"))
    lines = entities.groupBy("candidate_id").agg(F.min("file").alias("min_file"), F.min("start_line").alias("min_line"))
    out = ids.join(groups.select("group_id", "signature", "ids"), "group_id")
    for part in (files, products, lines, count(entities, "entity_count"), count(blocks, "block_count"), count(internal, "internal_edge_count"), count(internal.where("cross_file"), "cross_file_internal_edge_count"), count(incoming, "incoming_edge_count"), count(outgoing, "outgoing_edge_count")):
        out = out.join(part, "candidate_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("entity_count", "block_count", "internal_edge_count", "cross_file_internal_edge_count", "incoming_edge_count", "outgoing_edge_count")}
    out = out.withColumns(zero).withColumns({"files": F.coalesce("files", F.array().cast("array<string>")), "observed_products": F.coalesce("products", F.array_sort("ids"))})
    out = out.withColumn("classification_status", classification(F.col("block_only"), F.col("entity_count"), F.col("internal_edge_count")))
    return out.withColumn("isolated_entity_count", (F.col("classification_status") == "ISOLATED_ENTITY").cast("int")).drop("products", "ids")


def dependencies(candidates: DataFrame, internal: DataFrame, outgoing: DataFrame) -> DataFrame:
    """Edges by candidate pair, scope and type (AGG-7, JOIN-15)."""
    pairs = internal.select("candidate_id", F.col("candidate_id").alias("other"), "relation_type", "cross_file").union(outgoing.select("candidate_id", "other_candidate_id", "relation_type", "cross_file"))
    c = candidates.select("candidate_id", "group_id", "signature")
    s, t = c.toDF("source_candidate_id", "source_group_id", "source_signature"), c.toDF("target_candidate_id", "target_group_id", "target_signature")
    counted = pairs.groupBy(F.col("candidate_id").alias("source_candidate_id"), F.col("other").alias("target_candidate_id"), "relation_type").agg(F.count("*").alias("edge_count"), F.sum(F.col("cross_file").cast("long")).alias("cross_file_edge_count"))
    out = counted.join(s, "source_candidate_id").join(t, "target_candidate_id")
    return out.withColumn("dependency_scope", scope(F.col("source_candidate_id"), F.col("target_candidate_id"), F.col("source_group_id"), F.col("target_group_id")))
