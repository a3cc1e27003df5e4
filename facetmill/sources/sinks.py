"""Reports as files: CSV with quoted text and bare numbers, text, tab-separated, and Parquet.

Spark's CSV writer can't leave numbers and nulls bare while it quotes text, so each
row is one rendered string and the text sink writes it, in order, in as many files as
the rows ask for. Parquet is the native form of every table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetmill import shared
from facetmill.functions import text as tx
from facetmill.operators import tokens
from facetmill.operators.numbering import number

from . import tree

#: Fixed values, as readers of the reports expect them: file name, its columns in order (name or name=source column), and the order of its rows.
CSV = {
    "entities": ("entity_id,entity_type,simple_name,qualified_name,file,start_line,end_line,block_id,group_id,signature,observed_products,resolution_status", ["file", "start_line", "entity_type", "qualified_name"]),
    "relations": ("relation_id,source_entity_id,target_entity_id,target_text,relation_type,file,line=source_line,block_id,group_id,signature,observed_products,resolution_status", ["file", "source_line", "relation_type", "target_text"]),
    "dependency-nodes": ("entity_id,entity_type,simple_name,qualified_name,file,start_line,end_line,group_id,signature,observed_products", ["file", "start_line", "entity_type", "qualified_name"]),
    "dependency-edges": ("edge_id,source_entity_id,target_entity_id,relation_type,source_file,source_line,target_file,source_group_id,target_group_id,source_signature,target_signature,cross_file,observed_products,resolution_status", ["source_file", "source_line", "relation_type", "source_entity_id", "target_entity_id"]),
    "unresolved-relations": ("relation_id,relation_type,source_entity_id,target_text,file,line=source_line,group_id,signature,resolution_status,failure_reason,observed_products", ["file", "source_line", "relation_type", "source_entity_id", "target_text"]),
    "group-dependencies": ("source_group_id,target_group_id,relation_type,edge_count,cross_file_edge_count", ["source_group_id", "target_group_id", "relation_type"]),
    "feature-effect-candidates": ("candidate_id,group_id,signature,classification_status,entity_count,block_count,file_count,internal_edge_count,incoming_edge_count,outgoing_edge_count,cross_file_internal_edge_count,observed_products", ["group_id", "min_file", "min_line", "candidate_id"]),
    "feature-effect-members": ("candidate_id,member_type,member_id,entity_type,qualified_name,file,start_line,end_line,block_id,group_id,signature", ["candidate_id", "kind", "file", "start_line", "member_id"]),
    "candidate-dependencies": ("source_candidate_id,target_candidate_id,dependency_scope,relation_type,edge_count,cross_file_edge_count,source_group_id,target_group_id,source_signature,target_signature", ["source_candidate_id", "target_candidate_id", "dependency_scope", "relation_type"]),
    "unassigned-blocks": ("block_id,group_id,signature,file,branch_type,start_line,end_line,reason", ["block_id"]),
    "aggregated-feature-effect-candidates": ("candidate_id,group_id,signature,commonality_classification=commonality,suggested_label,label_confidence,candidate_confidence,component_count,entity_count,block_count,file_count,internal_edge_count,incoming_edge_count,outgoing_edge_count,representative_tokens,unresolved_concerns", ["group_id", "first_file", "first_component", "candidate_id"]),
    "aggregated-feature-effect-members": ("candidate_id,member_type,member_id,entity_type,qualified_name,file,start_line,end_line,block_id,group_id,signature", ["group_id", "first_file", "first_component", "candidate_id", "kind", "file", "start_line", "member_id"]),
    "component-similarities": ("group_id,component_a=a,component_b=b,lexical_similarity=lexical,context_similarity=context,neighborhood_similarity=neighborhood,direct_dependency=direct,shared_block_evidence=block,combined_score=combined,threshold,supporting_evidence_count=support_count", ["group_id", "a", "b"]),
    "component-merge-decisions": ("group_id,component_a=a,component_b=b,decision,combined_score=combined,supporting_evidence=support,reason", ["group_id", "a", "b"]),
    "candidate-labels": ("candidate_id,suggested_label,label_confidence,representative_tokens,representative_token_evidence,representative_entities,representative_strings,explanation", ["group_id", "first_file", "first_component", "candidate_id"]),
    "unassigned-components": ("component_id=candidate_id,group_id,signature,component_type=classification_status,entity_count,block_count,reason", ["candidate_id"]),
    "feature-evidence-profile": ("component_id=candidate_id,group_id,signature,entity_count,file_count,block_count,top_classes,top_methods,top_fields,top_tokens=token_counts,top_dependency_targets=top_targets,top_dependency_sources=top_sources,packages,classes,representative_entities", ["candidate_id"]),
}


def rendered(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        return tx.csv_quote(tx.join_ids(F.col(column)))
    if isinstance(kind, T.StringType):
        return tx.csv_quote(F.col(column))
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def csv_rows(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """The header, and rows as one string column beside the columns (o0, o1, ...) that order them."""
    spec, order = CSV[name]
    columns = [c.partition("=") for c in spec.split(",")]
    line = F.concat_ws(",", *[rendered(df, s or n) for n, _, s in columns])
    keys = [F.coalesce(F.col(c), F.lit("")) if dict(df.dtypes)[c] == "string" else F.col(c) for c in order]
    return ",".join(n for n, _, _ in columns), df.select(line.alias("value"), *[k.alias(f"o{i}") for i, k in enumerate(keys)])


def write_lines(rows: DataFrame, keys: list[str], path: str, header: str | None = None) -> None:
    """``value`` of rows as text in the order of keys, then of the text itself, after the header; replaced as a whole.

    Rows are dealt to files by ranges of the order, so no task writes them all: the
    names of the part files ascend with the rows, and the first begins with the header.
    ``_SUCCESS``, which Spark writes last, says that all files are there.
    """
    both = rows.select(F.lit(1).alias("_part"), "value", *keys)
    if header is not None:
        both = rows.sparkSession.createDataFrame([(0, header)], "_part int, value string").unionByName(both, allowMissingColumns=True)
    both.orderBy("_part", *keys, "value").select("value").write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines that ``write_lines`` wrote, numbered from 0 in their order."""
    m = F.col("_metadata")
    rows = spark.read.text(path).select(F.regexp_extract(m["file_name"], r"part-(\d+)", 1).cast("int").alias("_file"), m["file_block_start"].alias("_start"), F.monotonically_increasing_id().alias("_line"), "value")
    return number(rows, [F.col("_file"), F.col("_start"), F.col("_line")], "n").select((F.col("n") - 1).alias("n"), "value")


def write_files(rows: DataFrame, directory: str) -> DataFrame:
    """(files): how many of the files (path, content) below a folder each task wrote; a task that runs again writes the same. Lazy."""

    def go(batches):
        fs, at, _ = tree.opened(directory)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                fs.create_dir(f"{at}/{path}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{at}/{path}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["files"])

    shared.ship(rows.sparkSession)
    return rows.select("path", "content").mapInArrow(go, "files long")


def write_csv(df: DataFrame, name: str, directory: str) -> None:
    """``name``.csv as a folder of text files in order, the header first (SNK-1 to SNK-17)."""
    header, rows = csv_rows(df, name)
    write_lines(rows, [c for c in rows.columns if c != "value"], f"{directory}/{name}.csv", header)


def write_tables(tables: dict[str, DataFrame], directory: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{directory}/{name}.parquet")


def blocks_tsv(blocks: DataFrame, path: str) -> None:
    """The forest in pre-order with tabs (SNK-19)."""
    cells = {"file": F.col("file"), "directive": F.lower("directive"), "startLine": F.col("start_line"), "endLine": F.col("end_line"), "nestingDepth": F.col("depth"), "productIds": tx.join_ids(F.col("ids"))}
    rows = blocks.select(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells.values()]).alias("value"), "file", "seq")
    write_lines(rows, ["file", "seq"], path, "\t".join(cells))


def candidate_members(entities: DataFrame, blocks: DataFrame, internal: DataFrame) -> DataFrame:
    """Three kinds of members in one table (SET-1)."""
    e = entities.select("candidate_id", F.lit(0).alias("kind"), F.lit("ENTITY").alias("member_type"), F.col("entity_id").alias("member_id"), "entity_type", "qualified_name", "file", "start_line", "end_line", "block_id", "group_id", "signature")
    b = blocks.select("candidate_id", F.lit(1).alias("kind"), F.lit("BLOCK").alias("member_type"), F.col("block_id").alias("member_id"), F.lit("").alias("entity_type"), F.lit("").alias("qualified_name"), "file", "start_line", "end_line", "block_id", "group_id", "signature")
    d = internal.select("candidate_id", F.lit(2).alias("kind"), F.lit("INTERNAL_DEPENDENCY").alias("member_type"), F.col("edge_id").alias("member_id"), F.col("relation_type").alias("entity_type"), F.concat("source_entity_id", F.lit("->"), "target_entity_id").alias("qualified_name"), F.col("source_file").alias("file"), F.col("source_line").alias("start_line"), F.col("source_line").alias("end_line"), F.col("source_block_id").alias("block_id"), F.col("source_group_id").alias("group_id"), F.col("source_signature").alias("signature"))
    return e.unionByName(b).unionByName(d)


def ordered(aggregated: DataFrame) -> DataFrame:
    """With the keys that order aggregated candidates in their group: first file, first component (ORD-5)."""
    return aggregated.withColumns({"first_file": F.coalesce(F.get("files", F.lit(0)), F.lit("")), "first_component": F.coalesce(F.get("component_ids", F.lit(0)), F.lit(""))})


def aggregated_members(aggregated: DataFrame, members: DataFrame, entities: DataFrame) -> DataFrame:
    """Components, entities and blocks of aggregated candidates in one table (SET-2)."""
    no = lambda t: F.lit(None).cast(t)
    a = ordered(aggregated).select("candidate_id", "group_id", "signature", "component_ids", "block_ids", "first_file", "first_component")

    def wide(kind: int, word: str, ids: str, block: Column) -> DataFrame:
        x = a.select("candidate_id", "group_id", "signature", "first_file", "first_component", F.explode(ids).alias("member_id"))
        return x.select("candidate_id", F.lit(kind).alias("kind"), F.lit(word).alias("member_type"), "member_id", no("string").alias("entity_type"), no("string").alias("qualified_name"), no("string").alias("file"), no("int").alias("start_line"), no("int").alias("end_line"), block.alias("block_id"), "group_id", "signature", "first_file", "first_component")

    e = entities.withColumnRenamed("candidate_id", "component_id").join(members.select("component_id", "candidate_id"), "component_id")
    e = e.select("candidate_id", F.lit(1).alias("kind"), F.lit("ENTITY").alias("member_type"), F.col("entity_id").alias("member_id"), "entity_type", "qualified_name", "file", "start_line", "end_line", "block_id", "group_id", "signature").join(a.select("candidate_id", "first_file", "first_component"), "candidate_id")
    return wide(0, "STRUCTURAL_COMPONENT", "component_ids", F.lit("")).unionByName(e).unionByName(wide(2, "BLOCK", "block_ids", F.col("member_id")))


def labels(aggregated: DataFrame, members: DataFrame, entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Labels with the first five entities and twelve pieces of token evidence (SNK-15, TOP-6)."""
    of = members.select("candidate_id", "component_id")
    e = entities.withColumnRenamed("candidate_id", "component_id").join(of, "component_id")
    name = tx.display_name(F.col("qualified_name"), F.col("simple_name"))
    firsts = lambda rows, order, k, name: tokens.top_k(rows, ["candidate_id"], [F.col(c) for c in order], k).groupBy("candidate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "x"))), lambda v: v["x"]).alias(name))
    named = firsts(e.withColumn("x", name), ["file", "start_line", "entity_id"], 5, "representative_entities")
    said = evidence.join(of, "component_id").join(aggregated.select("candidate_id", "representative_tokens"), "candidate_id").where(F.array_contains("representative_tokens", F.col("token")))
    said = firsts(said.withColumn("x", F.concat_ws(":", "token", "provenance", "source_entity_id")), ["component_id", "pos"], 12, "representative_token_evidence")
    out = aggregated.join(named, "candidate_id", "left").join(said, "candidate_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({
        "representative_entities": F.coalesce("representative_entities", none), "representative_token_evidence": F.coalesce("representative_token_evidence", none),
        "representative_strings": F.lit(""), "explanation": F.lit("label derived from representative code identifier tokens"),
    })


def _ranked(column: str) -> Column:
    """``name[rank=,score=]`` of each entity (SNK-17)."""
    item = lambda x: F.concat(x["name"], F.lit("[rank="), x["rank"].cast("string"), F.lit(",score="), x["score"].cast("string"), F.lit("]"))
    return F.coalesce(F.array_join(F.transform(column, item), "|"), F.lit(""))


def profile_rows(profiles: DataFrame) -> DataFrame:
    return profiles.withColumns({"top_classes": _ranked("top_class"), "top_methods": _ranked("top_method"), "top_fields": _ranked("top_field"), "representative_entities": _ranked("representative_entities")})


def profile_report(profiles: DataFrame) -> DataFrame:
    """One text for each profile (SNK-18)."""
    s = lambda c: F.col(c).cast("string")
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    entity = lambda x: F.concat(F.lit("- rank "), x["rank"].cast("string"), F.lit(" score "), x["score"].cast("string"), F.lit(" "), x["entity_type"], F.lit(" "), x["name"], F.lit(" "), x["file"], F.lit(":"), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string"), F.lit("\n"))
    token = lambda x: F.concat(F.lit("- "), x["token"], F.lit(" = "), x["n"].cast("string"), F.lit(" origins ["), F.array_join(x["origins"], ", "), F.lit("]\n"))
    types = F.concat(F.lit("{"), F.coalesce(F.array_join(F.transform("internal_types", lambda x: F.concat(x["relation_type"], F.lit("="), x["n"].cast("string"))), ", "), F.lit("")), F.lit("}"))
    rule, some = "=================================================\n", lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ""), F.lit(""))
    counts = [("Entities : ", "entity_count"), ("Files : ", "file_count"), ("Blocks : ", "block_count"), ("Internal : ", "internal_edge_count"), ("Incoming : ", "incoming_edge_count"), ("Outgoing : ", "outgoing_edge_count"), ("Cross-file internal : ", "cross_file_internal_edge_count"), ("Isolated entities : ", "isolated_entity_count")]
    text = F.concat(
        F.lit(rule + "Component "), s("candidate_id"), F.lit("\n\nSignature\n"), s("signature"), F.lit("\n\nImplementation concept\n"), s("implementation_concept"),
        F.lit("\nNOTE: This is only a descriptive interpretation, not a recovered feature name.\n\nRepresentative entities\n"), some("representative_entities", entity),
        F.lit("\nRepresentative tokens\n"), some("top_tokens", token), F.lit("\nDependency summary\n- internal types: "), types, F.lit("\n- top targets: "), listed("top_targets"), F.lit("\n- top sources: "), listed("top_sources"),
        F.lit("\n\nStructural summary\n"), *[x for t, c in counts for x in (F.lit(t), s(c), F.lit("\n"))], F.lit("\nConcept evidence\n"), some("concept_evidence", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), F.lit(rule),
    )
    return profiles.select("candidate_id", text.alias("value"))


def write_report(profiles: DataFrame, directory: str) -> None:
    write_lines(profile_report(profiles), ["candidate_id"], f"{directory}/feature-evidence-report.txt")
