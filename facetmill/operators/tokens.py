"""Token evidence of components (STR-1 to STR-5, AGG-10 to AGG-13, TOP-1, TOP-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetmill.config import STOP_WORDS
from facetmill.functions import text as tx

from .components import Candidates


def provenance(entity_type):
    """STR-5."""
    return F.when(entity_type.isin("CLASS", "INTERFACE", "CONSTRUCTOR"), "TYPE_NAME").when(entity_type == "METHOD", "METHOD_NAME").otherwise("FIELD_NAME")


def explode_tokens(rows: DataFrame, text: str, stop_words=STOP_WORDS, raw: bool = False) -> DataFrame:
    """Rows by token, with ``tok_pos`` in the text."""
    made = tx.raw_tokens(F.col(text)) if raw else tx.tokens(F.col(text), stop_words)
    return rows.select("*", F.posexplode(made).alias("tok_pos", "token"))


def evidence(c: Candidates, stop_words=STOP_WORDS) -> DataFrame:
    """component_id, token, provenance, source_entity_id, pos: tokens, and what orders those of a component, by entities, then by internal edges.

    Only the first few of a component are ever shown, so none are sorted or numbered here.
    """
    e = c.entities.select(F.col("candidate_id").alias("component_id"), F.col("entity_id").alias("source_entity_id"), "entity_type", "file", F.col("start_line").alias("line"), "simple_name", "qualified_name")
    simple = e.select("component_id", "source_entity_id", F.lit(0).alias("phase"), "file", "line", F.lit("").alias("k1"), F.col("source_entity_id").alias("k2"), F.lit(0).alias("k3"), provenance(F.col("entity_type")).alias("provenance"), F.col("simple_name").alias("_t"))
    full = e.select("component_id", "source_entity_id", F.lit(0), "file", "line", F.lit(""), "source_entity_id", F.lit(1), F.lit("IDENTIFIER"), "qualified_name")
    edge = c.internal.select(F.col("candidate_id"), "source_entity_id", F.lit(1), "source_file", "source_line", "relation_type", F.concat_ws("|", "source_entity_id", "target_entity_id"), F.lit(0), F.lit("IDENTIFIER"), "relation_type")
    rows = explode_tokens(simple.union(full).union(edge).where("_t is not null"), "_t", stop_words)
    return rows.select("component_id", "token", "provenance", "source_entity_id", F.struct("phase", "file", "line", "k1", "k2", "k3", "tok_pos").alias("pos"))


def frequencies(rows: DataFrame, by: str, token: str = "token") -> DataFrame:
    """How often each token occurs (AGG-10)."""
    return rows.groupBy(by, token).agg(F.count("*").alias("n"))


def text_frequencies(rows: DataFrame, by: str, text: str, stop_words=STOP_WORDS) -> DataFrame:
    """(by, token, n) of texts whose token order doesn't matter (AGG-10).

    Words between separators are counted first, so each distinct one of a group is
    split and stemmed once, not each time it occurs.
    """
    words = rows.select(by, F.explode(F.split(text, "[^A-Za-z0-9]+")).alias("_w")).where("_w <> ''").groupBy(by, "_w").agg(F.count("*").alias("_n"))
    return words.select(by, F.explode(tx.tokens(F.col("_w"), stop_words)).alias("token"), "_n").groupBy(by, "token").agg(F.sum("_n").alias("n"))


def top_k(rows: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in an order (TOP-1, TOP-2, TOP-5, TOP-6).

    A task keeps k rows of a group before the shuffle (the plan's WindowGroupLimit), so
    what one group sends is bounded by the number of tasks.
    """
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def representative(freq: DataFrame, by: str, k: int = 8) -> DataFrame:
    """The k most frequent tokens of each group, as an array (TOP-1)."""
    top = top_k(freq, [by], [F.desc("n"), F.asc("token")], k)
    return top.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token", "n"))), lambda x: F.struct(x["token"].alias("token"), x["n"].alias("n"))).alias("top"))


#: The sets that components are compared by.
KINDS = ["packages", "classes", "files", "neighbors", "block_ids"]


def sets(c: Candidates) -> DataFrame:
    """(component_id, kind, x): packages, classes, files, blocks and neighbours of each component, a row for each element (AGG-11, GRA-6, SET-3)."""
    cid = F.col("candidate_id").alias("component_id")
    q = c.entities.where("qualified_name is not null")
    parts = {
        "packages": q.select(cid, tx.package_prefix(F.col("qualified_name")).alias("x")),
        "classes": q.select(cid, tx.enclosing_class(F.col("qualified_name")).alias("x")),
        "files": c.entities.select(cid, F.col("file").alias("x")).union(c.blocks.select(cid, "file")),
        "block_ids": c.blocks.select(cid, F.col("block_id").alias("x")),
        "neighbors": c.internal.select(cid, F.col("target_entity_id").alias("x")).union(c.incoming.select(cid, "source_entity_id")).union(c.outgoing.select(cid, "target_entity_id")),
    }
    out = None
    for kind, rows in parts.items():
        made = rows.select("component_id", F.lit(kind).alias("kind"), "x")
        out = made if out is None else out.union(made)
    return out.where("x is not null").distinct()
