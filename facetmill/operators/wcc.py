"""Weakly connected components (GRA-2, GRA-3).

Large-star and small-star steps alternate: each links what a vertex knows to the
least vertex it knows. The number of steps grows with the logarithm of a
component's width, each is stored in the shared folder, and only a count and a
checksum reach the driver. Before the first step each task joins what it reads by
union and find and passes on one edge for each vertex, so many edges among few vertices
are never shuffled. Once ``FEW`` edges or less are left, which one task holds
at any size of the input, it joins them in the same way instead of further steps.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill import shared

#: Edges that one task finishes.
FEW = 50_000
#: Vertices that a task holds at a time; when it has more, it passes on what it has and begins anew.
HELD = 500_000


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.union(least.select("u", "m")).where("a <> b").distinct()


def _joined(edges: DataFrame, held: int | None) -> DataFrame:
    """(a, b): each vertex but the least of its component, and the least, of the edges that a task has held together."""

    def run(batches):
        number: dict = {}
        names: list = []
        up: list[int] = []

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def found():
            ends = [(i, root(i)) for i in range(len(up))]
            ends = [(i, r) for i, r in ends if i != r]
            return pa.RecordBatch.from_arrays([pa.array([names[e[k]] for e in ends], kind) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            both = pa.concat_arrays([batch.column(0), batch.column(1)]).dictionary_encode()
            at = []
            for x in both.dictionary.to_pylist():
                if (i := number.setdefault(x, len(names))) == len(names):
                    names.append(x)
                    up.append(i)
                at.append(i)
            codes = pc.take(pa.array(at, pa.int64()), both.indices).to_pylist()
            for a, b in zip(codes[: batch.num_rows], codes[batch.num_rows :], strict=True):
                a, b = root(a), root(b)
                if a != b:
                    low, high = (a, b) if names[a] < names[b] else (b, a)
                    up[high] = low
            if held and len(names) > held:
                yield found()
                number, names, up = {}, [], []
        if names:
            yield found()

    shared.ship(edges.sparkSession)
    return edges.mapInArrow(run, edges.schema)


def weakly_connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, label): each linked vertex and the least vertex of its component, of any ordered type.

    Loops and null ends are ignored; vertices without links aren't returned.
    """
    now, before = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b"), None
    plain = all(now.schema[c].dataType.typeName() in ("string", "integer", "long") for c in "ab") and now.schema["a"].dataType == now.schema["b"].dataType
    now = shared.stored((_joined(now, HELD) if plain else now).distinct(), "edges")
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        if state[0] <= FEW and plain:
            now = shared.stored(_joined(now.coalesce(1), None), "edges")
            break
        before = state
        now = shared.stored(_small(_large(now)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())


def with_isolated(vertices: DataFrame, vertex: str, found: DataFrame) -> DataFrame:
    """Every vertex with its label; one without links is its own."""
    v = vertices.select(F.col(vertex).alias("node")).distinct()
    return v.join(found.hint("shuffle_hash"), "node", "left").withColumn("label", F.coalesce("label", "node"))
