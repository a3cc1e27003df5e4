"""Directive lines to a forest of conditional blocks (DIR-1 to DIR-7)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetmill import shared
from facetmill.functions import text as tx
from facetmill.sources import scan

#: The directive line. Matches whole lines; spaces are ASCII.
PATTERN = r"^[ \t\n\x0B\f\r]*//[ \t\n\x0B\f\r]*#(if|elif|else|endif)\b[ \t\n\x0B\f\r]*([^\n\r\u0085\u2028\u2029]*)$"
_DIRECTIVE = re.compile(PATTERN, re.ASCII)
_LINE = re.compile("\r\n|\n|\r")
_SPACE = "".join(map(chr, range(33)))


def recognise(line: str) -> tuple[str, str] | None:
    """The directive of a line and its trimmed expression (DIR-1)."""
    m = _DIRECTIVE.match(line)
    return (m[1], m[2].strip(_SPACE)) if m else None


def ids_of(raw: str) -> list[str]:
    return [x for x in (p.strip(_SPACE) for p in raw.split("|")) if x]


def marks(files: DataFrame) -> DataFrame:
    """(file, ln, word, expression, last): the directive lines of files (path, src), with the number of the last line (DIR-1)."""
    parts = scan.split_lines(scan.checked())
    found = shared.dealt(files.where(F.instr("src", "#") > 0), "path").select(F.col("path").alias("file"), F.size(parts).alias("last"), F.posexplode(parts).alias("i", "text"))
    whole = PATTERN.removesuffix("$") + r"\z"
    found = found.where(F.col("text").rlike(whole))
    cut = lambda k: F.regexp_extract("text", whole, k)
    return found.select("file", (F.col("i") + 1).alias("ln"), cut(1).alias("word"), F.regexp_replace(cut(2), r"^[\x00-\x20]+|[\x00-\x20]+$", "").alias("expression"), "last")


def nested(found: DataFrame) -> DataFrame:
    """``found`` (file, ln, word, ...) without orphans, with depth, and ``seq`` in pre-order, which is the order of lines (DIR-3, WIN-8).

    The running sum of +1 for ``if`` and -1 for ``endif``, less its least value so far
    where that is below 0, is how many ``if`` are open: an ``endif`` too many closes none.
    """
    order = Window.partitionBy("file").orderBy("ln")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    is_if = F.col("word") == "if"
    out = found.withColumn("_s", F.sum(F.when(is_if, 1).when(F.col("word") == "endif", -1).otherwise(0)).over(until))
    out = out.withColumn("_open", F.col("_s") - F.least(F.lit(0), F.min("_s").over(until)))
    out = out.withColumn("_before", F.lag("_open", 1, 0).over(order)).where(is_if | (F.col("_before") > 0))
    out = out.withColumns({"depth": (F.col("_before") - F.when(is_if, 0).otherwise(1)).cast("int"), "seq": (F.row_number().over(order) - 1).cast("int")})
    return out.drop("_s", "_open", "_before")


def ends(placed: DataFrame) -> DataFrame:
    """``nested`` rows with ``end_line``: a branch ends before the next directive of its depth, which is of its frame, or with the file (DIR-4)."""
    after = F.lead("ln").over(Window.partitionBy("file", "depth").orderBy("ln"))
    return placed.withColumn("end_line", F.when(F.col("word") == "endif", F.col("ln")).otherwise(F.greatest(F.col("ln"), F.coalesce(after - 1, F.col("last")))).cast("int"))


def extract(files: DataFrame) -> DataFrame:
    """Blocks of all files (path, src), a row each, with their block_id (DIR-2 to DIR-7).

    The blocks around a directive of depth d are, for each depth below d, the last branch
    of that depth before it. So each directive asks once for each of these depths, a
    window over (file, depth) answers, and ids are own ones that all blocks around have.
    ``endif`` is a block of its own beside the branches.
    """
    placed = ends(nested(marks(files)))
    own = F.when(F.col("word").isin("if", "elif"), tx.parse_signature(F.col("expression"))).otherwise(F.array().cast("array<string>"))
    placed = placed.withColumn("own", own)
    is_branch = F.col("word") != "endif"
    asks = F.struct(F.col("depth").alias("level"), F.lit(False).alias("ask"), F.when(is_branch, F.struct("seq", "own")).alias("branch"))
    levels = F.transform(F.sequence(F.lit(0), F.col("depth")), lambda k: F.when(k == F.col("depth"), asks).otherwise(F.struct(k.alias("level"), F.lit(True).alias("ask"), F.lit(None).cast("struct<seq:int,own:array<string>>").alias("branch"))))
    each = placed.withColumn("_l", F.explode(levels)).select("*", "_l.*").drop("_l")
    around = F.last("branch", ignorenulls=True).over(Window.partitionBy("file", "level").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0))
    met = each.withColumn("around", F.when(F.col("ask"), around))
    same = ["file", "seq", "word", "ln", "end_line", "depth", "expression", "own"]
    met = met.groupBy(*same).agg(F.collect_list("around.own").alias("above"), F.max(F.when(F.col("level") == F.col("depth") - 1, F.col("around.seq"))).alias("parent_seq"))
    ids = F.filter("own", lambda x: F.forall("above", lambda a: F.array_contains(a, x)))
    raw = F.when(~F.col("word").isin("if", "elif"), "").when(F.col("depth") == 0, F.col("expression")).otherwise(F.array_join("ids", "|"))
    out = met.withColumn("ids", ids).withColumn("raw", raw)
    out = out.select("file", "seq", F.upper("word").alias("directive"), F.col("ln").cast("int").alias("start_line"), "end_line", "depth", "raw", "ids", "parent_seq")
    return out.withColumn("block_id", tx.block_id(F.col("file"), F.col("directive"), F.col("start_line"), F.col("end_line")))
