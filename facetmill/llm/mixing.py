"""Operator 2: mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share ``SHARE`` times the size of all documents by weight; no target is
above ``EPOCHS`` times its source's size, and what is above goes to the others by
weight (solved in closed form over the sources sorted by limit over weight). A
source's target is met by whole epochs of all its documents first and then by a
weighted sample without replacement: a document's key is an exponential variable,
made from a hash of its id, over its quality weight; documents are taken in order
of their keys until the prefix sum of their sizes reaches what is left of the
target, with the document at the edge if that comes nearer.

Keys spread over ``BUCKETS`` ranges, which are summed before they are shuffled, so
prefix sums run over (source, range) totals and only the range at the edge is
sorted by document: a source with a third of all rows is never in one task.

Cases: a null source is a source of its own, the last one; a null text has size 0
and is taken 0 times; documents with the same id and text stay apart only by
their order and have equal keys, sizes and weights; a null ``doc_id`` gives
way to the text, so that such rows have keys of their own; an empty table or sizes of 0 give targets of 0; only
doc_id, text and source are read, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textcore as tc

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, EPOCHS = 1.5, 2
BUCKETS = 4096
#: Weights of documents labelled good, bad, and not labelled.
GOOD, BAD, UNKNOWN = 1.0, 0.25, 0.75


def size_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponential(doc_id: Column, text: Column) -> Column:
    """A standard exponential variable from the first 52 bits of the MD5 of the id, or of the text where that is null."""
    told = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), text.cast("string")), F.lit("null"))
    bits = F.conv(F.substring(F.md5(told.cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / 4503599627370496.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size), one row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.withColumn("w", F.element_at(w, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumns({"cap": F.col("source_size") * float(epochs), "total": F.sum("source_size").over(Window.partitionBy()) * float(share)})
    tight = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = tight.rowsBetween(Window.unboundedPreceding, -1), tight.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    ranked = ranked.withColumns({"level": level, "limit": F.col("cap") / F.col("w")})
    # the first source that stays below its limit gives the level of all after it
    first = F.min(F.when(F.col("level") < F.col("limit"), F.struct("limit", F.col("source").isNull().alias("n"), "source", "level"))).over(Window.partitionBy())["level"]
    return ranked.withColumn("open", first).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("open") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, text_key, size, source, source_size, target, copies, taken of each document.

    quality: (doc_id, quality 0/1) rows that give documents their weights.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), F.xxhash64(F.col("text")).alias("text_key"), exponential(F.col("doc_id").cast("long"), F.col("text")).alias("key"))
    if quality is not None:
        marks = quality.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"))
        rows = rows.join(marks, "doc_id", "left").withColumn("weight", F.when(F.col("q") == 1, GOOD).when(F.col("q") == 0, BAD).otherwise(UNKNOWN)).drop("q")
    else:
        rows = rows.withColumn("weight", F.lit(UNKNOWN))
    rows = rows.withColumn("key", F.col("key") / F.col("weight"))
    rows = tc.stored(rows.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets).cast("int")), "mix")

    spans = rows.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    budget = targets(spans.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = budget.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    below = F.sum("part").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    edges = spans.withColumn("below", F.coalesce(below, F.lit(0)))
    edges = edges.join(budget, same(edges, budget)).drop(budget["source"])
    edges = edges.select("source", "bucket", "below", "source_size", "target", "whole", "rest", (F.col("below") + F.col("part") <= F.col("rest")).alias("inside"), (F.col("below") >= F.col("rest")).alias("outside"))
    placed = rows.alias("r").join(edges.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.bucket") == F.col("e.bucket"))).select("r.*", *[f"e.{c}" for c in ("below", "source_size", "target", "whole", "rest", "inside", "outside")])
    edge = placed.where("not inside and not outside")
    run = Window.partitionBy("source").orderBy("key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("below") + F.coalesce(F.sum("size").over(run), F.lit(0))
    edge = edge.withColumn("extra", (at + F.col("size") / 2 <= F.col("rest")).cast("long"))
    rest = placed.where("inside or outside").withColumn("extra", F.col("inside").cast("long"))
    out = rest.unionByName(edge).withColumn("copies", F.col("whole") + F.col("extra"))
    return out.select("doc_id", "text_key", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(tc.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH m AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || text, 'null')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)
          / CASE q WHEN 1 THEN 1.0 WHEN 0 THEN 0.25 ELSE 0.75 END AS k
      FROM documents LEFT JOIN m USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * CAST(sum(size) AS DOUBLE) AS cap,
        [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM l WHERE level < cap / w) * w, cap)) AS target FROM l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (SELECT d.*, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS rest,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN size > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
"""

QUERIES = {"op2_source_mixing": op2_source_mixing}
ORACLE_SQL = {"op2_source_mixing": SQL}
