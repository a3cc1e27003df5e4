"""Operator 4: benchmark decontamination by a prefix-filtered containment join.

A benchmark item gives windows of ``WINDOW`` consecutive words (an item of fewer
words is one window). A window is the set of its three-word shingles, ordered by
rarity: how many documents of the whole corpus hold each. Containment needs every
shingle, so the necessary prefix is the first, rarest one; documents are probed
for these prefix shingles only. A hit at word ``p`` of a shingle that stands
``o`` words into a window of ``n`` words puts the window at ``p - o``: positional
and length bounds ask that ``p - o .. p - o + n`` lies inside the document. What
passes is verified word by word over the item-sized window.

The benchmark's distinct rows are read in blocks of about ``BLOCK`` bytes of text, an
item that is longer in pieces (the query side, in blocks, against all documents); a
block's index is broadcast, equal windows are one in it, and documents pass through
one matching step for each block, so no text is shuffled. Each block costs a pass over
all documents for its shingles' rarity: the benchmark is taken to be small beside them.

Cases: null texts have no words; items without words are ignored, a null item id
counts as the id "" ; items or documents that repeat give the same result for
each row; a null ``doc_id`` is carried along; an empty benchmark hits nothing;
an input column that has the name of an output column is replaced by it.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc

WINDOW = 10
SHINGLE = 3
#: Bytes of benchmark text in a block, the bound of what is broadcast.
BLOCK = 4 << 20
_BITS = 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _words_of(data: np.ndarray, offs: np.ndarray):
    data = tc.lower_ascii(data)
    start, end, row = tc.word_bounds(data, offs, tc.ASCII)
    return tc.span_hashes(data, start, end), row


class _Lookup:
    """Positions of keys in a sorted table, with a bitmap before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.keys >> tc.U(64 - _BITS)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into ``x`` of the keys found, and where they stand in the table."""
        maybe = np.flatnonzero(self.bits[(x >> tc.U(64 - _BITS)).astype(np.int64)])
        if not len(maybe) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, x[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == x[maybe]
        return maybe[ok], at[ok]


class Windows:
    """The distinct windows of a block of items, the items of each, and the shingles.

    Windows of equal words are one, whatever items have them, so a passage that
    many items share costs one look at each place.
    """

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        data, offs = tc.string_buffers(pa.array(texts, pa.string()))
        words, row = _words_of(data, offs)
        self.words, names = words, ["" if x is None else str(x) for x in ids]
        bounds = tc.row_starts(row, len(texts))
        found: dict[bytes, int] = {}
        start, size, self.items = [], [], []
        for k in range(len(texts)):
            a, b = int(bounds[k]), int(bounds[k + 1])
            n = min(window, b - a)
            for s in range(a, b - n + 1) if n else ():
                w = found.setdefault(words[s : s + n].tobytes(), len(start))
                if w == len(start):
                    start.append(s)
                    size.append(n)
                    self.items.append(set())
                self.items[w].add(names[k])
        self.start, self.size = np.array(start, np.int64), np.array(size, np.int64)
        self.by_size = {k: tc.ngram_hashes(words, np.zeros(len(words), np.int64), k)[0] for k in sorted({min(SHINGLE, n) for n in size})}

    def shingles(self) -> dict[int, np.ndarray]:
        """All shingle hashes by their number of words."""
        out = {}
        for k, g in self.by_size.items():
            at = [self.start[i] + np.arange(n - k + 1) for i, n in enumerate(self.size.tolist()) if min(SHINGLE, n) == k]
            out[k] = np.unique(g[np.concatenate(at)])
        return out

    def prefixes(self, rarity: dict[int, dict[int, int]]) -> dict[int, dict[str, np.ndarray]]:
        """By words in a shingle: each window's rarest shingle, its place in the window, and the window."""
        out = {}
        for k, g in self.by_size.items():
            w = [i for i, n in enumerate(self.size.tolist()) if min(SHINGLE, n) == k]
            seen = rarity.get(k, {})
            hashes, places = [], []
            for i in w:
                s, n = int(self.start[i]), int(self.size[i]) - k + 1
                h = g[s : s + n].tolist()
                best = min(range(n), key=lambda j: (seen.get(h[j], 0), h[j], j))
                hashes.append(h[best])
                places.append(best)
            h, p, w = np.array(hashes, tc.U), np.array(places, np.int64), np.array(w, np.int64)
            order = np.argsort(h, kind="stable")
            h, p, w = h[order], p[order], w[order]
            look = _Lookup(h)
            first = np.searchsorted(h, look.keys)
            out[k] = {"look": look, "first": first, "count": np.diff(np.append(first, len(h))), "place": p, "window": w}
        return out


def _rarity(docs: DataFrame, block: Windows) -> dict[int, dict[int, int]]:
    """For each shingle of the block: how many documents of all hold it."""
    tables = {k: _Lookup(v) for k, v in block.shingles().items()}

    def count(batches):
        total = {k: np.zeros(len(t.keys), np.int64) for k, t in tables.items()}
        for b in batches:
            data, offs = tc.string_buffers(b.column(0))
            for i, j in tc.slices(offs):
                words, row = _words_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                for k, t in tables.items():
                    g, at = tc.ngram_hashes(words, row, k)
                    x, where = t.find(g)
                    pairs = np.unique(row[at[x]] * len(t.keys) + where) if len(x) else np.zeros(0, np.int64)
                    total[k] += np.bincount(pairs % max(len(t.keys), 1), minlength=len(t.keys))
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(n[at])], ["k", "at", "n"])

    rows = tc.arrow_batches(docs.select(F.col("text").cast("string")), count, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect()
    out: dict[int, dict[int, int]] = {k: {} for k in tables}
    for r in rows:
        out[r.k][int(tables[r.k].keys[r.at])] = r.n
    return out


def match(words: np.ndarray, row: np.ndarray, bounds: np.ndarray, block: Windows, prefix: dict) -> tuple[np.ndarray, np.ndarray]:
    """Word index and window of each verified occurrence."""
    starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, t in prefix.items():
        g, at = tc.ngram_hashes(words, row, k)
        x, where = t["look"].find(g)
        n = t["count"][where]
        entry = np.repeat(t["first"][where], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        p = np.repeat(at[x], n)
        w, s = t["window"][entry], p - t["place"][entry]
        r = row[p]
        ok = (s >= bounds[r]) & (s + block.size[w] <= bounds[r + 1])
        s, w = s[ok], w[ok]
        for size in np.unique(block.size[w]):
            m = block.size[w] == size
            same = np.ones(m.sum(), bool)
            for i in range(int(size)):
                same &= words[s[m] + i] == block.words[block.start[w[m]] + i]
            starts.append(s[m][same])
            windows.append(w[m][same])
    return np.concatenate(starts), np.concatenate(windows)


def _cut(texts: str, limit: int, window: int) -> list[str]:
    """A text in pieces of about ``limit`` characters; a piece begins with the last ``window - 1`` words of the one before, so no window is lost."""
    ends = [m.end() for m in _WORD.finditer(texts)]
    if len(texts) <= limit or len(ends) <= window:
        return [texts]
    starts = [m.start() for m in _WORD.finditer(texts)]
    out, i = [], 0
    while True:
        j = i + window
        while j < len(ends) and ends[j] - starts[i] <= limit:
            j += 1
        out.append(texts[starts[i] : ends[min(j, len(ends)) - 1]])
        if j >= len(ends):
            return out
        i = j - window + 1


def _blocks(benchmark: DataFrame, limit: int = BLOCK, window: int = WINDOW):
    """The benchmark's distinct rows, block by block of about ``limit`` bytes each; a longer item is cut to pieces."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()

    def pieces(batches):
        for b in batches:
            for k, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for x in _cut(t, max(limit // 16, 1024), window):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.string()), pa.array([x], pa.string())], ["id", "text"])

    made = tc.stored(tc.arrow_batches(items, pieces, "id string, text string"), "items")
    total = made.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // limit))
    for k in range(n):
        rows = made.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()  # half of limit on average
        if rows:
            yield Windows([r.id for r in rows], [r.text for r in rows])


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` with n_words, hit_spans (word ranges ``[start, end)``), hit_items (distinct ids), n_hit.

    keep: the document columns to carry along, by default all.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("n_words", "hit_spans", "hit_items", "n_hit")]
    base = docs.select(*keep, *([] if "text" in keep else ["text"]))
    spark, text = docs.sparkSession, base.columns.index("text")
    out = base.withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.lit(None).cast("array<bigint>"), "hit_items": F.lit(None).cast("array<string>")})

    def step(shared):
        def scan(batches):
            found, prefix = shared.value if shared else (None, {})
            for b in batches:
                data, offs = tc.string_buffers(b.column(text).cast(pa.string()))
                old_spans, old_items = b.column("hit_spans").to_pylist(), b.column("hit_items").to_pylist()
                counts, spans, items = [], [], []
                for i, j in tc.slices(offs):
                    words, row = _words_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    bounds = tc.row_starts(row, j - i)
                    counts.append(np.diff(bounds))
                    hits: dict[int, tuple[list, set]] = {}
                    if found is not None:
                        s, w = match(words, row, bounds, found, prefix)
                        for a, k in zip(s.tolist(), w.tolist(), strict=True):
                            r = int(row[a])
                            h = hits.setdefault(r, ([], set()))
                            a -= int(bounds[r])
                            h[0].append((a, a + int(found.size[k])))
                            h[1].update(found.items[k])
                    for r in range(j - i):
                        a, b_ = hits.get(r, ([], set()))
                        spans.append(_union([*a, *_pairs(old_spans[i + r])]))
                        items.append(sorted(b_ | set(old_items[i + r] or ())))
                cols = {n: b.column(n) for n in b.schema.names}
                cols |= {"n_words": pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64)), "hit_spans": pa.array(spans, pa.list_(pa.int64())), "hit_items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

        return scan

    steps = 0
    for found in _blocks(benchmark, block):
        shared = spark.sparkContext.broadcast((found, found.prefixes(_rarity(docs, found))))
        out = tc.arrow_batches(out, step(shared), out.schema)
        steps += 1
    if not steps:
        out = tc.arrow_batches(out, step(None), out.schema)
    pairs = F.expr("transform(sequence(0, cast(size(hit_spans) / 2 as int) - 1), i -> struct(hit_spans[2 * i] as start, hit_spans[2 * i + 1] as end))")
    out = out.withColumn("hit_spans", F.when(F.size("hit_spans") > 0, pairs).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")))
    out = out.withColumn("n_hit", F.expr("aggregate(hit_spans, 0L, (a, x) -> a + x.end - x.start)"))
    return out.select(*keep, "n_words", "hit_spans", "hit_items", "n_hit")


def _pairs(flat: list | None) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2], strict=True)) if flat else []


def _union(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint ascending ranges of what the spans cover, flat."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def items_sha256(ids) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(tc.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.rid, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid)
"""

QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
ORACLE_SQL = {"op4_benchmark_decontamination": SQL}
