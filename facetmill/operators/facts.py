"""Code facts of projected sources: entities and relations merged over products.

Each file is projected for every product; equal projections are parsed once and
count for all their products. Parsing is the only step in Python workers; merging,
contexts, numbers and names are DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetmill import javaparse, shared
from facetmill.config import COMMON
from facetmill.functions import text as tx
from facetmill.sources import scan

from . import intervals, resolve
from .numbering import number
from .projection import variants

KEY = ["entity_type", "declaring", "key_name", "params", "start_line"]
_KEY = "struct<entity_type:string,declaring:string,key_name:string,params:string,start_line:int>"
_TEXTS = ("entity_type", "declaring", "key_name", "params")
_KEY_FIELDS = pa.struct([*[(c, pa.string()) for c in _TEXTS], ("start_line", pa.int32())])
_BODY_FIELDS = pa.struct([*_KEY_FIELDS, ("end_line", pa.int32()), *[(c, pa.string()) for c in ("simple_name", "qualified_name", "relation_type", "target_text")], ("source_line", pa.int32()), ("source_key", _KEY_FIELDS), ("target_key", _KEY_FIELDS), ("target_name", pa.string()), ("message", pa.string()), ("line", pa.int32())])
_BODY = f"entity_type string, declaring string, key_name string, params string, start_line int, end_line int, simple_name string, qualified_name string, relation_type string, target_text string, source_line int, source_key {_KEY}, target_key {_KEY}, target_name string, message string, line int"
RAW = f"file string, products array<string>, kind string, ord long, b struct<{_BODY.replace(' string', ':string').replace(' int', ':int').replace(' struct', ':struct')}>"


@dataclass(frozen=True)
class Facts:
    entities: DataFrame
    relations: DataFrame
    failures: DataFrame
    stats: DataFrame


def _keyed(r: dict) -> dict:
    for k in ("source_key", "target_key"):
        if r[k] is not None:
            r[k] = dict(zip(KEY, r[k], strict=True))
    return r


def rows_of(source: str, products: list[str]) -> list[tuple[list[str], str, int, dict]]:
    """(products, kind, order, body) of one file: entities, relations, parsed variants and failures (PAR-1 to PAR-14)."""
    out: list[tuple[list[str], str, int, dict]] = []
    for text, of in variants(source, products).items():
        try:
            entities, relations = javaparse.facts(javaparse.parse(text))
        except javaparse.Failure as e:
            out.append((of, "failure", 0, {"message": e.message, "line": e.line}))
            continue
        out.append((of, "parsed", 0, {}))
        out += [(of, "entity", i, e) for i, e in enumerate(entities)]
        out += [(of, "relation", i, _keyed(r)) for i, r in enumerate(relations)]
    return out


def parse(files: DataFrame, universe: DataFrame) -> DataFrame:
    """One row for each fact of each variant, typed in Arrow."""
    shared.ship(files.sparkSession)
    pairs = shared.dealt(files.where("src is not null"), "path").crossJoin(universe).where(F.size("universe") > 0)

    def run(batches):
        for b in batches:
            rows = [(f, of, kind, i, body) for f, s, u in zip(*[c.to_pylist() for c in b.columns], strict=True) for of, kind, i, body in rows_of(s, u)]
            if rows:
                kinds = [pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), _BODY_FIELDS]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "products", "kind", "ord", "b"])

    return pairs.select("path", "src", "universe").mapInArrow(run, RAW)


def merge_entities(drafts: DataFrame) -> DataFrame:
    """Drafts of one key as one entity: products united, the last end line, the rest of the first product (AGG-3)."""
    first = F.min(F.struct(F.element_at("products", 1), "ord", "simple_name", "qualified_name"))
    out = drafts.groupBy("file", *KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("products")))).alias("observed_products"), F.max("end_line").alias("end_line"), first.alias("f"))
    return out.select("file", *KEY, "end_line", "observed_products", "f.simple_name", "f.qualified_name")


def merge_relations(drafts: DataFrame) -> DataFrame:
    """Drafts of one key as one relation: products united, first bound target, resolved if any is (AGG-4)."""
    key = ["file", "source_line", "relation_type", "target_text", "target_name", "source_key", "block_id"]
    first = F.min(F.struct(F.col("target_key").isNull(), F.element_at("products", 1), "ord", "target_key"))
    out = drafts.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("products")))).alias("observed_products"), first["target_key"].alias("target_key"), F.max("resolved_by_parser").alias("resolved_by_parser"), F.first("group_id").alias("group_id"), F.first("signature").alias("signature"))
    return out


def contexts(points: DataFrame, line: str, blocks: DataFrame, common: Column) -> DataFrame:
    """``points`` with block_id, group_id and signature of the innermost grouped block (JOIN-2)."""
    inner = intervals.innermost(points.withColumnRenamed(line, "_line"), blocks.withColumnRenamed("block_id", "b_id"), "file", "_line", "start_line", "end_line", [F.col("depth"), F.col("start_line")], ["b_id", "group_id", "signature"])
    out = intervals.with_default(points.withColumn("_line", F.col(line)), inner, "file", "_line", {"b_id": COMMON, "group_id": COMMON, "signature": common})
    return out.withColumnRenamed("b_id", "block_id").drop("_line")


def extract(files: DataFrame, groups: DataFrame, group_blocks: DataFrame, universe: DataFrame) -> Facts:
    """Entities E1.., relations R1.., parse failures and counts of files (path, src)."""
    drafts = shared.stored(parse(files, universe), "facts")
    common = F.lit(universe.select(tx.join_ids(F.col("universe"))).first()[0] or "")
    blocks = group_blocks.select("file", "start_line", "end_line", "depth", "block_id", "group_id", "signature")

    found = merge_entities(drafts.where("kind = 'entity'").select("file", "products", "ord", "b.*"))
    found = contexts(found, "start_line", blocks, common)
    order = [F.col("file"), F.col("start_line"), F.col("entity_type"), F.coalesce("qualified_name", "simple_name"), F.col("declaring"), F.col("params")]
    numbered = number(found, order, "_n").withColumn("entity_id", F.concat(F.lit("E"), F.col("_n").cast("string"))).drop("_n")
    entities = shared.stored(numbered.withColumn("resolution_status", F.when(F.col("qualified_name").isNull(), "UNRESOLVED").otherwise("RESOLVED_INTERNAL")), "entities")

    said = contexts(drafts.where("kind = 'relation'").select("file", "products", "ord", "b.*").withColumn("resolved_by_parser", F.lit(False)), "source_line", blocks, common)
    merged = merge_relations(said)
    bound = resolve.resolve(merged, entities)
    order = [F.col("file"), F.col("source_line"), F.col("relation_type"), F.col("target_text"), F.col("source_key"), F.col("block_id"), F.col("target_name")]
    numbered = number(bound, order, "_n").withColumn("relation_id", F.concat(F.lit("R"), F.col("_n").cast("string")))
    relations = shared.stored(numbered.select("relation_id", "source_entity_id", "target_entity_id", "target_text", "relation_type", "file", "source_line", "block_id", "group_id", "signature", "observed_products", "resolution_status"), "relations")

    failed = drafts.where("kind = 'failure'").select("file", F.explode("products").alias("product"), F.col("b.line").alias("line"), F.col("b.message").alias("message"), F.lit(True).alias("extraction_skipped"))
    attempts = files.where("src is not null").crossJoin(universe).agg(F.coalesce(F.sum(F.size("universe")), F.lit(0)).alias("attempts"))
    done = drafts.where("kind = 'parsed'").agg(F.countDistinct("file").alias("parsed_files"), F.coalesce(F.sum(F.size("products")), F.lit(0)).alias("successes"))
    shown = entities.select("entity_id", "entity_type", "simple_name", "qualified_name", "file", "start_line", "end_line", "block_id", "group_id", "signature", "observed_products", "resolution_status")
    return Facts(shown, relations, failed.unionByName(scan.unreadable(files)), done.crossJoin(attempts).select("parsed_files", "attempts", "successes"))
