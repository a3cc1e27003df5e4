"""Points in nested intervals (JOIN-2, JOIN-13), near-linear in both.

The line is a tree: a node of level k is ``WIDTH**k`` places wide. An interval is cut
into the fewest nodes that make it up, up to level ``LEVELS``, beyond which it takes a
node for each ``WIDTH**LEVELS`` places; a point lies in one node of each level. So
points meet intervals by equality on (key, level, node), in exactly one node of each
interval that holds them. A node has at most as many distinct points as places, so
one hot key (a file of a million lines) spreads over many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbering

WIDTH, LEVELS = 8, 4
BITS = WIDTH.bit_length() - 1


def _floor(x: Column, level: int) -> Column:
    return F.shiftright(x, BITS * level)


def nodes_of(start: Column, end: Column) -> Column:
    """(level, node) of an interval with both ends inside it; none if it ends before it starts."""
    low, high = start.cast("long"), end.cast("long") + 1
    cells = []
    for k in range(LEVELS + 1):
        first, last = -_floor(-low, k), _floor(high, k)  # nodes first..last-1 lie inside
        run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<long>"))
        if k == LEVELS:
            inside = run(first, last)
        else:
            up_first, up_last = -_floor(-low, k + 1) * WIDTH, _floor(high, k + 1) * WIDTH
            inside = F.when(up_first < up_last, F.concat(run(first, up_first), run(up_last, last))).otherwise(run(first, last))
        cells.append(_at_level(inside, k))
    return F.concat(*cells)


def _at_level(nodes: Column, level: int) -> Column:
    return F.transform(nodes, lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))


def nodes_at(at: Column) -> Column:
    """(level, node) of a point, one for each level."""
    return F.array(*[F.struct(F.lit(k).alias("level"), _floor(at.cast("long"), k).alias("node")) for k in range(LEVELS + 1)])


def _key(cell: Column) -> Column:
    """A (level, node) as one number."""
    return (cell["node"] * (LEVELS + 1) + cell["level"]).alias("_c")


def covering(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Every pair of a point and an interval of equal keys that holds it: the columns of both, the keys once."""
    p = points.where(F.col(at).isNotNull()).select("*", F.explode(nodes_at(F.col(at))).alias("_c")).select("*", "_c.*").drop("_c")
    i = intervals.where(F.col(start) <= F.col(end)).select("*", F.explode(nodes_of(F.col(start), F.col(end))).alias("_c")).select("*", "_c.*").drop("_c")
    return p.join(i, [*keys, "level", "node"]).drop("level", "node")


def innermost(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, rank: list[Column], take: list[str]) -> DataFrame:
    """Distinct (key, at) of ``points`` that lie in an interval, with the ``take`` columns of the best one.

    Of the intervals in a node only the one that ranks highest can be the best of a
    point there, so each node keeps one before points come in, and a point meets one
    row for each level however deep intervals nest. Points outside all intervals
    aren't returned: ``with_default`` puts them in.
    """
    i = intervals.where(F.col(start) <= F.col(end)).select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.struct(*rank).alias("_r"), F.struct(*take).alias("_t"))
    # intervals are cut into many nodes, so a node carries the place of its interval among all, not what ranks and is taken
    i = numbering.number(i, [F.col("_r"), F.col("_t")], "_b")
    best = i.select("_k", "_b", F.explode(nodes_of(F.col("_s"), F.col("_e"))).alias("_c")).select("_k", _key(F.col("_c")), "_b").groupBy("_k", "_c").agg(F.max("_b").alias("_b"))
    p = points.select(F.col(key).alias("_k"), F.col(at).alias("_p")).where("_k is not null and _p is not null").distinct()
    hits = p.select("_k", "_p", F.explode(nodes_at(F.col("_p"))).alias("_c")).select("_k", "_p", _key(F.col("_c"))).join(best, ["_k", "_c"])
    found = hits.groupBy("_k", "_p").agg(F.max("_b").alias("_b")).join(i.select("_b", "_t"), "_b")
    return found.select(F.col("_k").alias(key), F.col("_p").alias(at), "_t.*")


def with_default(points: DataFrame, found: DataFrame, key: str, at: str, defaults: dict[str, object]) -> DataFrame:
    """Every row of ``points`` with its interval's columns, or the defaults."""
    out = points.join(found, [key, at], "left")
    return out.withColumns({c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)) for c, v in defaults.items()})
