"""Blocks of files as they arrive: the narrow first stages on a stream of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.operators import directives


def watch(spark: SparkSession, path: str) -> DataFrame:
    """(path, src) of each new file below ``path``, whole."""
    found = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    return found.select(F.expr("url_decode(replace(regexp_replace(_metadata.file_path, '^file:/+', '/'), '+', '%2B'))").alias("path"), F.col("value").alias("src"))


def blocks_to(spark: SparkSession, path: str, target: str, checkpoint: str):
    """A query that appends the blocks of new files to Parquet, once for each file."""

    def batch(files: DataFrame, _: int) -> None:
        directives.extract(files).write.mode("append").parquet(target)

    return watch(spark, path).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
