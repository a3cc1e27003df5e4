"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on UTF-8 bytes of whole Arrow string columns: word bounds,
word hashes and n-gram hashes come from numpy prefix sums, so no operator loops
over words in Python. A hash of bytes ``l..r`` is ``sum(T[b_i] * B**(i-l))``
modulo 2**64 with a fixed random byte table ``T`` and an odd ``B``, followed by
a bit mixer; it depends on the bytes alone, never on where they stand.

Texts are worked on in slices of about ``SLICE`` bytes (or one text, if it is
longer), and hashes inside a slice in pieces, so memory stays bounded.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill import shared
from facetmill.shared import shared_dir, ship

__all__ = ["shared_dir", "ship"]

SLICE = 4 << 20
PIECE = 1 << 20
RECORDS = 256
NO_ID = (1 << 63) - 1

U = np.uint64
_B = 0x9E3779B97F4A7C15
_C = 0xD1342543DE82EF95


def _table() -> np.ndarray:
    """256 odd 64-bit values from the splitmix64 sequence."""
    x = (np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)).astype(U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return (x ^ (x >> U(31))) | U(1)


TABLE = _table()


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_B), _Powers(_C)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def separators(spec: str) -> np.ndarray:
    """``white``: bytes 09-0D and 20. ``ascii``: every ASCII byte but 0-9 and a-z
    (look at bytes lowered before)."""
    t = np.zeros(256, bool)
    if spec == "white":
        t[[0x20, *range(0x09, 0x0E)]] = True
    else:
        t[:0x80] = True
        t[0x30:0x3A] = False
        t[0x61:0x7B] = False
    return t


WHITE, ASCII = separators("white"), separators("ascii")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes outside ``sep``; rows are not crossed."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~sep[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    cuts = offsets[:-1]
    first[cuts[cuts < n]] = True
    start = np.flatnonzero(word & first)
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(word[1:], out=last[:-1])
    ends = offsets[1:]
    last[ends[ends > 0] - 1] = True
    end = np.flatnonzero(word & last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``start..end`` (ascending, not overlapping), worked on in pieces."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, a + PIECE, "right")))
        b = int(end[j - 1])
        up, down = _BYTES.get(b - a)
        s = np.empty(b - a + 1, U)
        s[0] = 0
        np.cumsum(TABLE[data[a:b]] * up, out=s[1:])
        l, r = start[i:j] - a, end[i:j] - a
        out[i:j] = (s[r] - s[l]) * down[l]
        i = j
    return mix(out)


def row_starts(row: np.ndarray, rows: int) -> np.ndarray:
    """For ascending ``row``: where each row's entries start, and the end."""
    return np.searchsorted(row, np.arange(rows + 1))


def ngram_hashes(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive words within a row, and the index of each one's first word."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    out = np.zeros(m, U)
    keep = np.flatnonzero(row[n - 1 :] == row[:m])
    if n <= 8:
        for k in range(n):
            out = out * U(_C) + words[k : k + m]
        return mix(out[keep]), keep
    out = np.empty(m, U)
    for i in range(0, m, PIECE):
        j = min(m, i + PIECE)
        up, down = _WORDS.get(j - i + n)
        s = np.empty(j - i + n, U)
        s[0] = 0
        np.cumsum(words[i : j + n - 1] * up[: j - i + n - 1], out=s[1:])
        out[i:j] = (s[n:] - s[: j - i])[: j - i] * down[: j - i]
    return mix(out[keep]), keep


def cover(starts: np.ndarray, length: int | np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the runs of ``length`` at ``starts``."""
    d = np.bincount(starts, minlength=size + 1) - np.bincount(starts + length, minlength=size + 1)
    return np.cumsum(d[:size]) > 0


def text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key of each whole text."""
    out = span_hashes_any(data, offsets[:-1], offsets[1:])
    return mix(out ^ (offsets[1:] - offsets[:-1]).astype(U))


def span_hashes_any(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of whole rows: pieces of long rows are chained."""
    out = np.zeros(len(start), U)
    size = end - start
    for i in np.flatnonzero(size > PIECE).tolist():
        h = 0
        for a in range(int(start[i]), int(end[i]), PIECE):
            b = min(a + PIECE, int(end[i]))
            up, _ = _BYTES.get(b - a)
            h = (h * _C + int((TABLE[data[a:b]] * up).sum(dtype=U))) % (1 << 64)
        out[i] = h
    short = (size > 0) & (size <= PIECE)
    if short.all():
        return mix(span_hashes(data, start, end))
    out[short] = span_hashes(data, start[short], end[short])
    return mix(out)


def row_ends(b: pa.RecordBatch) -> np.ndarray:
    """Where each row's bytes end, about, if the rows of ``b`` stand one after the other; 0 first."""
    n = b.num_rows
    out = np.zeros(n + 1, np.int64)
    for c in b.columns:
        kind = c.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            wide = np.int64 if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) else np.int32
            if (offsets := c.buffers()[1]) is not None:
                o = np.frombuffer(offsets, wide, n + 1, c.offset * np.dtype(wide).itemsize).astype(np.int64)
                out += o - o[0]
        else:
            out += np.arange(n + 1) * (c.nbytes // max(n, 1))
    return out


def gathered(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes, or of one row that is longer."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        if b.nbytes > limit:
            if held:
                yield _one(held)
                held, size = [], 0
            for i, j in slices(row_ends(b), limit):
                yield b.slice(i, j - i)
            continue
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield _one(held)
            held, size = [], 0
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in held]) for i in range(held[0].num_columns)], held[0].schema.names)


def arrow_batches(df: DataFrame, fn, schema, limit: int = SLICE) -> DataFrame:
    """``df.mapInArrow`` with batches of about ``limit`` bytes, or of one row that is longer.

    Lowers ``spark.sql.execution.arrow.maxRecordsPerBatch`` and ``.maxBytesPerBatch``
    in the session, never raises them: the defaults of 10,000 texts or 64 MB are no
    bound for small executors. As the result is lazy, they stay lowered.
    """
    ship(df.sparkSession)
    lower(df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", RECORDS)
    lower(df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", SLICE)

    def run(batches):
        yield from fn(gathered(batches, limit))
        trim()

    return df.mapInArrow(run, schema)


def lower(spark: SparkSession, setting: str, most: int) -> None:
    """Set a bound of the session to ``most`` unless it is a smaller positive number already."""
    now = str(spark.conf.get(setting)).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(setting, str(most))


#: Shuffle files of a query go at its end, not when the driver's collector gets to them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "step", compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; the shuffle files of the write go at its end."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return shared.stored(df, name, compression)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def replayable(df: DataFrame) -> bool:
    """Whether a task that runs again surely reads the same rows in the same order: scans, projections and filters."""
    plans = [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        p = plans.pop()
        if not p.deterministic() or p.nodeName() not in ("Project", "Filter") and not p.nodeName().startswith(("LogicalRelation", "Relation", "LocalRelation", "DataSourceV2Relation")):
            return False
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return True


def fixed(df: DataFrame, name: str = "input") -> DataFrame:
    """``df``, written first where a task that runs again may not read the same rows in the same order."""
    return df if replayable(df) else stored(df, name)


def trim() -> None:
    """Give freed memory back at a task's end: Python workers stay for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def thinned(rows: DataFrame, key: str, sample: int) -> DataFrame:
    """About ``sample`` rows, those with the smallest hashes of ``key``: what a limit is then cheap on.

    A limit alone would gather as many rows from every partition.
    """
    n = rows.count()
    share = int(min(1.0, 1.1 * sample / max(n, 1)) * (1 << 30))
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keyed(docs: DataFrame) -> DataFrame:
    """did (doc_id, a null one after all others), tkey (64-bit key of the text) and text of each row; safe to read again."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return fixed(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("tkey"), text.alias("text")))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str, spread: str, salts: int = 16) -> DataFrame:
    """``big.join(small, on, how)`` where a key may hold much of ``big``: its rows go to ``salts`` tasks by ``spread``, and ``small``, a row for each key, to all of them."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def doc_id() -> F.Column:
    """The doc_id that ``keyed`` made did from."""
    return F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
