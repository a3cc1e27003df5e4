"""Reading source trees: paths, guards, files and lines."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill import shared

from . import tree


@dataclass(frozen=True)
class Project:
    """A source folder below the assets folder, and how it is shown."""

    path: Path
    display: str


def base_directory_display(root: str | Path) -> str:
    return str(Path(root) / "assets")


def resolve_project(root: str | Path, sub: str | None) -> Project:
    """The folder ``sub`` below ``root``/assets (SRC-4).

    Raises ValueError where it is empty, absolute, steps up, leaves the assets
    folder, or is no folder.
    """
    text = (sub or "").strip()
    if not text:
        raise ValueError("the asset folder must not be empty")
    given = Path(text)
    if given.is_absolute():
        raise ValueError("the asset folder must be relative")
    if ".." in given.parts:
        raise ValueError("the asset folder must not step up")
    base = Path(os.path.abspath(Path(root) / "assets"))
    path = Path(os.path.normpath(base / given))
    if base != path and base not in path.parents:
        raise ValueError("the asset folder must be below the assets folder")
    if not path.exists():
        raise ValueError(f"no such asset folder: {text}")
    if not path.is_dir():
        raise ValueError(f"not a folder: {text}")
    return Project(path, str(Path("assets") / os.path.normpath(text)))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, src of every regular file at or below ``path``, without a filter of names (SRC-1, SRC-2).

    ``src`` is null where a file can't be read or isn't UTF-8. A missing path raises
    (SRC-3). A store that only Spark reads is listed by Spark, which leaves out names
    that begin with ``_`` or ``.`` and ends the run where a file can't be read.
    """
    try:
        tree.opened(str(path))
    except ValueError:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(path)).select("path", "content")
    else:
        shared.ship(spark)
        spark.dataSource.register(tree.TreeSource)
        found = spark.read.format("source_tree").option("tasks", str(spark.sparkContext.defaultParallelism * 2)).load(str(path))
    text = F.col("content").cast("string")
    return found.select("path", F.when(F.is_valid_utf8(text), text).alias("src"))


def checked() -> Column:
    """The source of a file; one that can't be read or isn't UTF-8 ends the run."""
    return F.when(F.col("src").isNull(), F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path")))).otherwise(F.col("src"))


def split_lines(src: Column) -> Column:
    """The lines of a text; what ends with a line end has no empty line after it."""
    parts = F.split(src, "\r\n|\n|\r", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lines(files: DataFrame) -> DataFrame:
    """path, ln (from 1), text of each line (SRC-5)."""
    return files.select("path", F.posexplode(split_lines(checked())).alias("i", "text")).select("path", (F.col("i") + 1).alias("ln"), "text")


def unreadable(files: DataFrame) -> DataFrame:
    """A failure row for each file that can't be read or isn't UTF-8 (SRC-6)."""
    return files.where("src is null").select(F.col("path").alias("file"), F.lit("<all>").alias("product"), F.lit(0).alias("line"), F.lit("the file is not UTF-8").alias("message"), F.lit(True).alias("extraction_skipped"))
