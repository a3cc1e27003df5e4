"""Tables kept between steps in the folder that the whole cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; one below the warehouse where it is unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "checkpoints")
    return at if ":" in at.split("/", 1)[0] else f"file://{os.path.abspath(at)}"


def stored(df: DataFrame, name: str = "step", compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys over ``spark.sql.shuffle.partitions`` tasks, for rows that are small to read and long to work on."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_package_sent", False):
        return
    package = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp()) / f"{package.name}_sent.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(at))
    sc._package_sent = True
