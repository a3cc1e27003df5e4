"""Corpus pipeline: language ID, near-copies, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and all
but the last return the columns of ``docs``, whatever they are called.

Cases: a row with null or empty text is rejected by language ID; without that stage
it would pass the others untouched and end as the end token alone. Repeated rows
count as copies. Empty tables give empty results. Mixing repeats a document's row
as often as it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetmill.llm import decontaminate as _decontaminate
from facetmill.llm import langid as _langid
from facetmill.llm import mixing as _mixing
from facetmill.llm import ngram_join as _ngram_join
from facetmill.llm import textcore as _tc
from facetmill.llm import token_output as _token_output


#: Near copies: words of a shingle and the least Jaccard similarity in per cent.
NEAR_WORDS, NEAR_ALIKE = 5, 80


def _guarded(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with every column under a plain name of its own, beside the columns that operators read."""
    plain = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: p for c, p in zip(docs.columns, plain, strict=True)}
    read = [F.col(at[c]).alias(c) for c in ("doc_id", "text", "lang", "source") if c in at]
    return docs.toDF(*plain).select(*plain, *read), plain


def _back(out: DataFrame, docs: DataFrame, plain: list[str]) -> DataFrame:
    return out.select(*[F.col(p).alias(c) for c, p in zip(docs.columns, plain, strict=True)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; a missing ``lang`` is filled in. Without a column ``lang`` nothing can be learned and no document passes."""
    rows, plain = _guarded(docs)
    if "lang" not in docs.columns:
        return docs.limit(0)
    model = _langid.train(rows.select("text", "lang", F.col("doc_id").alias("key")))
    found = _langid.identify(rows, model, plain).where("not rejected")
    return _back(found.withColumn(lang := plain[docs.columns.index("lang")], F.coalesce(lang, "lang_pred")), docs, plain)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one with the least id."""
    rows, plain = _guarded(docs)
    found = _tc.stored(_ngram_join.jaccard_components(rows, NEAR_WORDS, NEAR_ALIKE), "groups")
    first = found.where("label is not null").groupBy("label").agg(F.min(F.struct("did", "tkey")).alias("k")).select("k.did", "k.tkey")
    keep = first.union(found.where("label is null").select("did", "tkey").distinct())
    keyed = rows.select(*plain, F.coalesce(F.col("doc_id").cast("long"), F.lit(_tc.NO_ID)).alias("did"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tkey"))
    kept = keyed.join(keep, ["did", "tkey"], "left_semi")
    one = F.row_number().over(Window.partitionBy("did", "tkey").orderBy(F.lit(0)))
    return _back(kept.withColumn("_n", one).where("_n = 1"), docs, plain)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    rows, plain = _guarded(docs)
    found = _decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), plain)
    return _back(found.where("n_hit = 0"), docs, plain)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows, plain = _guarded(docs)
    taken = _mixing.mix(rows, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    keys = {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_tc.NO_ID)), "_text": F.coalesce("text_key", F.lit(0)), "_source": F.struct(F.col("source").cast("string"))}
    same = Window.partitionBy("_id", "_text", "_source")
    left = rows.withColumn("text_key", F.xxhash64("text")).withColumns(keys).withColumn("_n", F.row_number().over(same.orderBy(F.lit(0))))
    right = taken.withColumns(keys).withColumn("_n", F.row_number().over(same.orderBy(F.desc("copies")))).where("copies > 0").select("_id", "_text", "_source", "_n", "copies")
    out = left.join(right, ["_id", "_text", "_source", "_n"])
    return _back(out.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs, plain)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the documents read back from the token files."""
    return _token_output.encode_corpus(docs)


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("decontamination", decontamination), ("source_mixing", source_mixing), ("token_output", token_output)]

#: SQL can't express language ID.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _tc.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
