"""Operator 6: n-gram Jaccard self-join with rare-first prefix filtering.

A document's set is its distinct n-word shingles. All documents with one set
are one *node*. Shingles are ordered rare first by a frequency sketch of fixed
size over all documents (any order is right; rare ones first keep buckets small).
For a similarity of p % two sets of sizes x and y share one of their first
``x - ceil(p x / 100) + 1`` shingles (prefix filter), 100 min >= p max of the sizes
(length filter), and from the first shared shingle on both still hold
``ceil(p (x + y) / (100 + p))`` shingles (positional filter). Words of a shingle and
p are parameters; the query has three and 90. Prefix shingles meet in a
hash exchange; those of one node only go at once.

Links are verified once per pair, by counts in ranges of hash first (suffix
filter: a bound of the difference), then exactly. To find components no pair
within a component already found is looked at: first each node meets the member
of its buckets that holds the shared shingle earliest, then, until no bucket
holds two components, all pairs across components that pass the filters. What is
left out are only pairs that are connected anyway.

Cases: null texts and texts without words have empty sets and are linked with
nothing; fewer words than n are one shingle; rows with one text are one node;
a null doc_id stands after all others; other columns are ignored; an empty table
gives an empty result. Nodes are told apart by 64-bit sums of mixed hashes and
their sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.operators.wcc import weakly_connected_components

from . import exchange as ex
from . import membership
from . import textcore as tc

N = 3
#: Least similarity of linked sets, in per cent.
ALIKE = 90
SKETCH_BITS = 22
_BLOCK = 1 << 16
#: Ranges of hash whose counts outline a set; the top six bits of a hash tell.
CLASSES = 64
#: Members that are verified against one node in a task.
MEMBERS = 256
#: Members of a bucket that one task holds against all others of it.
BUCKET = 512


def shingles(b: pa.RecordBatch, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle, repeats included, by row."""
    data, offs = tc.string_buffers(b.column("text"))
    data = tc.lower_ascii(data)
    start, end, row = tc.word_bounds(data, offs, tc.WHITE)
    words = tc.span_hashes(data, start, end)
    g, at = tc.ngram_hashes(words, row, n)
    hashes, rows = [g], [row[at]]
    count = np.bincount(row, minlength=b.num_rows)
    for k in range(1, n):
        short = count[row] == k
        if short.any():
            s, at = tc.ngram_hashes(words[short], row[short], k)
            hashes.append(s)
            rows.append(row[short][at])
    return np.concatenate(hashes), np.concatenate(rows)


def sketch(base: DataFrame, n: int = N) -> np.ndarray:
    """How often shingles of each of 2**SKETCH_BITS classes occur in all texts."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            h, _ = shingles(b, n)
            total += np.bincount((h & tc.U((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS)
        blocks = [ex.pack({"n": ex.small(total[i : i + _BLOCK])}) for i in range(0, len(total), _BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "n"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("block").to_pylist(), b.column("n").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + ex.unpack(x)["n"].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([ex.pack({"n": ex.small(x)}) for x in total.values()], pa.binary())], ["block", "n"])

    blocks = (1 << SKETCH_BITS) // _BLOCK
    parts = tc.arrow_batches(base.select("text"), count, "block int, n binary").repartition(blocks, "block")
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in tc.arrow_batches(parts, add, "block int, n binary").collect():  # of a fixed size
        out[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.minimum(ex.unpack(r.n)["n"].astype(np.int64), 0xFFFFFFFF)
    return out


def node_sets(h: np.ndarray, row: np.ndarray, rows: int, order_by: np.ndarray | None = None):
    """Distinct hashes in order within rows, their rows, where rows start, and the nodes."""
    if order_by is None:
        order = np.lexsort((h, row))
    else:
        order = np.lexsort((h, order_by[(h & tc.U(len(order_by) - 1)).astype(np.int64)], row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    at = tc.row_starts(row, rows)
    s = np.concatenate([np.zeros(1, tc.U), np.cumsum(tc.mix(h ^ tc.U(0x5851F42D4C957F2D)), dtype=tc.U)])
    node = tc.mix((s[at[1:]] - s[at[:-1]]) * tc.U(3) + np.diff(at).astype(tc.U)).view(np.int64)
    return h, row, at, node


_ROW = {"hash": tc.U, "node": np.int64, "n": np.int64, "pos": np.int64}


def _distinct(kept: list[ex.Arrays]) -> ex.Arrays:
    """The distinct (hash, node) rows, by hash and size."""
    x = {k: np.concatenate([np.zeros(0, t), *(p[k].astype(t) for p in kept)]) for k, t in _ROW.items()}
    order = np.lexsort((x["node"], x["n"], x["hash"]))
    x = {k: v[order] for k, v in x.items()}
    new = np.ones(len(order), bool)
    new[1:] = (x["hash"][1:] != x["hash"][:-1]) | (x["node"][1:] != x["node"][:-1])
    return {k: v[new] for k, v in x.items()}


def _with_partners(x: ex.Arrays, alike: int) -> ex.Arrays:
    """Those of all rows of some hashes that may have a partner in their bucket.

    The size nearest to a row's own is a neighbour's in the bucket: without one that
    passes the length filter it has no partner. The smallest size that passes gives
    the least overlap, and so the last position, that a partner can ask for.
    """
    while len(x["hash"]):
        h, n = x["hash"], x["n"]
        near = (h[1:] == h[:-1]) & (100 * n[:-1] >= alike * n[1:])
        has = np.append(near, False) | np.append(False, near)
        bucket = np.cumsum(np.append(True, h[1:] != h[:-1])).astype(np.int64)
        place = bucket << 40 | n
        at = np.searchsorted(place, bucket << 40 | -(-alike * n // 100))
        at += at == np.arange(len(n))  # itself
        least = n[np.minimum(at, len(n) - 1)]
        has &= n - x["pos"] >= -(-alike * (n + np.where(has, least, n)) // (100 + alike))
        if has.all():
            break
        x = {k: v[has] for k, v in x.items()}
    return x


def enough(x: str, y: str, alike: int) -> F.Column:
    """The least overlap of two sets of these sizes."""
    return F.ceil(alike * (F.col(x) + F.col(y)) / (100 + alike))


def _passes(a: str, b: str, alike: int) -> F.Column:
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    least = enough(f"{a}.n", f"{b}.n", alike)
    return (100 * F.least(na, nb) >= alike * F.greatest(na, nb)) & (na - F.col(f"{a}.pos") >= least) & (nb - F.col(f"{b}.pos") >= least)


def _outline(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many items of each set fall into each of CLASSES ranges of hash."""
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    return np.bincount(row * CLASSES + (h >> tc.U(58)).astype(np.int64), minlength=rows * CLASSES).reshape(rows, CLASSES).astype(np.uint32)


class _Candidates:
    """Nodes that share buckets, each with one document that stands for it."""

    def __init__(self, base: DataFrame, chosen: DataFrame, n: int, percent: int):
        self.base, self.n, self.percent, self.spark = base, n, percent, base.sparkSession
        self.chosen = tc.stored(chosen, "chosen")
        outlines = self._scan(self.chosen, lambda h, at: [x.tobytes() for x in _outline(h, at)])
        self.outlines = tc.stored(outlines, "outlines")

    def _scan(self, chosen: DataFrame, made) -> DataFrame:
        """(node, items) of chosen nodes; a bitmap of fixed size keeps other texts out of the shuffle."""
        bits = self.spark.sparkContext.broadcast(membership.bitmap(chosen.select("tkey")))
        n = self.n

        def scan(batches):
            for b in batches:
                b = b.filter(pa.array(membership.maybe(bits.value, b.column("tkey").to_numpy())))
                if b.num_rows:
                    h, row = shingles(b, n)
                    h, row, at, _ = node_sets(h, row, b.num_rows)
                    yield pa.RecordBatch.from_arrays([b.column("did"), b.column("tkey"), pa.array(made(h, at), pa.binary())], ["did", "tkey", "items"])

        found = tc.arrow_batches(self.base, scan, "did long, tkey long, items binary")
        return found.join(chosen.hint("merge"), ["did", "tkey"]).dropDuplicates(["node"]).select("node", "items")

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose outlines differ in no more places than links may (suffix filter)."""
        x, y = self.outlines.toDF("a", "x"), self.outlines.toDF("b", "y")
        percent = self.percent

        def near(batches):
            for b in batches:
                u, v = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, CLASSES).astype(np.int64) for c in ("x", "y"))
                total = u.sum(1) + v.sum(1)
                ok = np.abs(u - v).sum(1) <= total - 2 * -(-percent * total // (100 + percent))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))

        return tc.arrow_batches(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), near, "a long, b long")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Those (a, b) whose sets are alike enough; a member at a time meets its centre's set."""
        pairs = tc.stored(self.alike(pairs), "pairs")
        named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = tc.stored(self._scan(self.chosen.join(named, "node"), lambda h, at: [h[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]), "sets")
        tc.release(self.spark)
        sets = sets.hint("merge")
        share = pairs.groupBy("a").agg(F.count("*").alias("n"))
        dealt = pairs.join(share, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / MEMBERS)).cast("int").alias("salt"))
        members = dealt.join(sets, dealt.b == sets.node).select("a", "salt", F.lit(1).alias("kind"), "b", "items")
        centres = dealt.select("a", "salt").distinct().join(sets, F.col("a") == sets.node).select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), "items")
        lined = centres.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")

        percent = self.percent

        def compare(batches):
            centre, own = None, None
            for r in batches:
                out: tuple[list, list] = ([], [])
                for a, kind, b, items in zip(*(r.column(c).to_pylist() for c in ("a", "kind", "b", "items")), strict=True):
                    x = np.frombuffer(items, np.uint64)
                    if kind == 0:
                        centre, own = x, a
                        continue
                    if own != a:
                        raise ValueError("a member without its centre")
                    both = len(x) + len(centre) - len(np.union1d(x, centre))
                    if 100 * both >= percent * (len(x) + len(centre) - both):
                        out[0].append(a)
                        out[1].append(b)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

        links = tc.stored(tc.arrow_batches(lined, compare, "a long, b long"), "links")
        tc.release(self.spark)
        return links


def jaccard_components(docs: DataFrame, n: int = N, alike: int = ALIKE) -> DataFrame:
    """did, tkey, n_shingles, label (of the component, null for empty sets) and cid (least did reachable) of each row of ``docs``."""
    spark = docs.sparkSession
    base = tc.keyed(docs)
    rare = spark.sparkContext.broadcast(sketch(base, n))  # of a fixed size
    parts = ex.parts_of(base)

    def prefixes(b):
        h, row = shingles(b, n)
        h, row, at, node = node_sets(h, row, b.num_rows, rare.value)
        size = np.diff(at)
        pos = np.arange(len(h)) - at[row]
        keep = pos < (size - -(-alike * size // 100) + 1)[row]
        entries = {"hash": h[keep], "row": row[keep], "pos": pos[keep]}
        return entries, {"did": b.column("did").to_numpy(), "tkey": b.column("tkey").to_numpy(), "n": size, "node": node}

    def fold(table, e):
        order = np.lexsort((e["node"], e["hash"]))
        table.add(e["hash"][order], {"low": e["node"][order], "high": e["node"][order]})

    def shared(table, e):
        t = table.at(e["hash"])
        m = np.flatnonzero(t["low"] != t["high"])
        if len(m):
            table.kept = [*getattr(table, "kept", []), {k: e[k][m] for k in ("hash", "node", "n", "pos")}]
            if sum(len(x["hash"]) for x in table.kept) > 2 * len(table.kept[0]["hash"]) + (1 << 20):
                table.kept = [_distinct(table.kept)]

    def partners(table):
        kept = _with_partners(_distinct(getattr(table, "kept", [])), alike)
        return {"hash": kept["hash"], "node": kept["node"].view(tc.U), "n": kept["n"], "pos": kept["pos"]}

    settled = tc.stored(ex.settle(ex.deal(base, prefixes, parts, carry=("node", "n")), fold, {"low": np.minimum, "high": np.maximum}, shared, last=partners), "prefixes")
    tc.release(spark)

    def rows_of(batches):
        for b in batches:
            for x in b.column("payload").to_pylist():
                d = ex.unpack(x)
                cols = {"did": d["did"], "tkey": d["tkey"], "n": d["n"].astype(np.int64), "node": d["node"]}
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], list(cols))

    def buckets_of(batches):
        for b in batches:
            for x in b.column("payload").to_pylist():
                d = ex.unpack(x)
                cols = {"h": d["hash"].view(np.int64), "node": d["node"].astype(tc.U).view(np.int64), "n": d["n"].astype(np.int64), "pos": d["pos"].astype(np.int64)}
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], list(cols))

    rows = tc.arrow_batches(settled.where("kind = 0").select("payload"), rows_of, "did long, tkey long, n long, node long")
    buckets = tc.arrow_batches(settled.where("kind = 3").select("payload"), buckets_of, "h long, node long, n long, pos long")
    linked = _link(base, rows, buckets, n, alike)
    least = rows.where("n > 0").groupBy("node").agg(F.min("did").alias("did"))
    named = least.join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    cids = named.groupBy("label").agg(F.min("did").alias("cid"))
    nodes = named.join(cids, "label").select("node", "label", "cid")
    out = tc.salted_join(rows, nodes, ["node"], "left", "did")  # many copies are one node
    return out.select("did", "tkey", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("label")).alias("label"), F.when(F.col("n") > 0, F.col("cid")).otherwise(F.col("did")).alias("cid"))


def _link(base: DataFrame, rows: DataFrame, buckets: DataFrame, n: int, alike: int) -> DataFrame:
    """(node, label) of all nodes that are linked with another one."""
    chosen = buckets.select("node").distinct().join(rows, "node").groupBy("node").agg(F.min(F.struct("did", "tkey")).alias("k")).select("node", "k.*")
    candidates = _Candidates(base, chosen, n, alike)
    tc.release(base.sparkSession)

    # the member that holds a bucket's shingle earliest has the fewest rare ones: what others are copies of
    centre = buckets.groupBy("h").agg(F.min(F.struct("pos", "n", "node")).alias("c"))
    met = buckets.alias("x").join(centre.select("h", "c.*").alias("c"), "h").where((F.col("x.node") != F.col("c.node")) & _passes("x", "c", alike))
    counted = met.groupBy(F.col("x.node").alias("b"), F.col("c.node").alias("a")).agg(F.count("*").alias("k"))
    best = tc.stored(counted.groupBy("b").agg(F.max(F.struct("k", "a")).alias("m")).select("m.a", "b"), "best")
    links = candidates.verify(best)
    labels = weakly_connected_components(links, "a", "b")

    alive = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = alive.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("h")
    alive = tc.stored(alive.join(open_, "h"), "open")
    # a large bucket is cut: each part of one side meets all of the other
    parts = alive.groupBy("h").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("parts"))
    cut = alive.join(parts, "h")
    x = cut.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("x")
    y = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    across = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.label") < F.col("y.label")) & _passes("x", "y", alike))
    pairs = across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    tried = best.union(best.select("b", "a"))  # those that passed are inside a component
    pairs = pairs.join(tried, ["a", "b"], "left_anti")
    return weakly_connected_components(links.union(candidates.verify(pairs)), "a", "b")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(tc.documents(spark, sf_dir))
    return out.select(tc.doc_id(), "n_shingles", F.when(F.col("cid") != tc.NO_ID, F.col("cid")).alias("component_id"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 3) - 1), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(min(r.other) AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY ALL
"""

QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
ORACLE_SQL = {"op6_ngram_jaccard_join": SQL}
