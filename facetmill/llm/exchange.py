"""A shuffle for hashes: columns of numbers, packed by task and part, instead of rows.

``deal`` turns each slice of texts (a *unit*) into entries ``(hash, row, ...)``,
sorts them by hash, cuts them into parts by range of hash and ships each part as
one packed binary: differences of sorted hashes and byte planes, under zstandard.
A part's task then sees all entries of its hashes. It first folds them into a
table of distinct hashes (``fold``), holding packs in a spooled file meanwhile, and
then answers each pack (``answer``). Memory grows with the distinct hashes of a
part, not with how often one occurs, and the number of parts with the data. The
answers of a unit are put together, by row, in ``assemble``.

A unit is named by its task and its place there: a task that runs again makes the
same units, as it reads the same rows in the same order. What is dealt must be so
(``textcore.fixed`` writes it first where it isn't).
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

Arrays = dict[str, np.ndarray]
RAW = "unit long, kind int, payload binary"


def pack(arrays: Arrays) -> bytes:
    """Bytes of named arrays; ``hash`` is ascending and stored as differences."""
    head, parts = [], []
    for name, a in arrays.items():
        if name == "hash":
            a = np.diff(a, prepend=a.dtype.type(0))
        head.append((name, a.dtype.str, len(a)))
        parts.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    h = pickle.dumps(head)
    return zstandard.ZstdCompressor(level=1).compress(len(h).to_bytes(4, "little") + h + b"".join(parts))


def unpack(data: bytes) -> Arrays:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    out, at = {}, 4 + n
    for name, kind, size in pickle.loads(raw[4 : 4 + n]):
        w = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size * w, at).reshape(w, size)
        a = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        out[name] = np.cumsum(a, dtype=a.dtype) if name == "hash" else a
        at += size * w
    return out


def carried(e: Arrays) -> Arrays:
    """A pack's entries with the columns they bring along."""
    return {k.removeprefix("_"): v[e["row"]] if k[0] == "_" else v for k, v in e.items()}


def small(a: np.ndarray) -> np.ndarray:
    """``a`` in the narrowest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def parts_of(df: DataFrame, factor: int = 2, least: int = 48) -> int:
    """The number of parts: in proportion to ``spark.sql.shuffle.partitions``, and some for the smallest input too."""
    return max(least, factor * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def deal(df: DataFrame, entries: Callable[[pa.RecordBatch], tuple[Arrays, Arrays]], parts: int, drop: int = 0, carry: tuple[str, ...] = ("did",), unit_bytes: int = 0) -> DataFrame:
    """Packs (kind 1, dealt by ``part``) and directories (kind 0) of each unit of ``df``.

    entries: gives a unit's entries (``hash`` and others) and its directory (``did`` of
    each row, and others). drop: low bits of a hash that aren't sent. carry: columns
    of the directory that entries bring along. unit_bytes: the size of a unit where
    it is larger than a batch.
    """

    def go(batches):
        task, n = TaskContext.get().partitionId(), 0
        for b in tc.gathered(batches, unit_bytes) if unit_bytes else batches:
            e, directory = entries(b)
            unit = (task << 32) | n
            n += 1
            h = e["hash"]
            order = np.argsort(h)
            e = {k: v[order] for k, v in e.items()}
            part = ((e["hash"] >> tc.U(40)) * tc.U(parts)) >> tc.U(24)
            e["hash"] = e["hash"] >> tc.U(drop)
            cuts = np.searchsorted(part, np.arange(parts + 1, dtype=tc.U))
            units, kinds, where, data = [unit], [0], [unit % parts], [pack(directory)]
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                s = slice(cuts[p], cuts[p + 1])
                mine = {k: v[s] for k, v in e.items()}
                rows, mine["row"] = np.unique(mine["row"], return_inverse=True)
                mine = {k: v if k == "hash" else small(v) for k, v in mine.items()} | {"rows": small(rows)} | {f"_{c}": directory[c][rows] for c in carry}
                units.append(unit)
                kinds.append(1)
                where.append(p)
                data.append(pack(mine))
            yield pack_rows(units, kinds, where, data)

    return by_part(tc.arrow_batches(df, go, "unit long, kind int, part int, payload binary"), parts)


def by_part(packs: DataFrame, parts: int) -> DataFrame:
    """Each part in a task of its own."""
    return packs.repartitionById(parts, F.col("part")) if hasattr(packs, "repartitionById") else packs.repartition(parts, "part")


def pack_rows(units: list, kinds: list, parts: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["unit", "kind", "part", "payload"])


class Table:
    """Distinct hashes with folded columns, grown from sorted packs."""

    def __init__(self, folds: dict[str, np.ufunc]):
        self.folds, self.pending, self.size = folds, [], 0
        self.hash: np.ndarray | None = None
        self.cols: Arrays = {}

    def add(self, hash_: np.ndarray, cols: Arrays) -> None:
        if not len(hash_):
            return
        first = np.flatnonzero(np.append(True, hash_[1:] != hash_[:-1]))
        self.pending.append((hash_[first], {k: self.folds[k].reduceat(v, first) for k, v in cols.items()}))
        self.size += len(first)
        if self.size > max(1 << 20, 0 if self.hash is None else len(self.hash)):
            self.close()

    def close(self) -> Table:
        if self.pending:
            held = self.pending if self.hash is None else [(self.hash, self.cols), *self.pending]
            self.hash, self.cols, self.pending, self.size = None, {}, [], 0
            h = np.concatenate([x[0] for x in held])
            held = [x[1] for x in held]
            order = np.argsort(h, kind="stable")  # runs are merged
            h = h[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            self.hash = h[first]
            del h
            for k, f in self.folds.items():  # a column at a time, and what it came from is let go
                self.cols[k] = f.reduceat(np.concatenate([x.pop(k) for x in held])[order], first)
        return self

    def at(self, hash_: np.ndarray) -> Arrays:
        i = np.searchsorted(self.hash, hash_)
        return {k: v[i] for k, v in self.cols.items()}


def settle(packs: DataFrame, fold: Callable[[Table, Arrays], None], folds: dict[str, np.ufunc], answer: Callable[[Table, Arrays], Arrays | None], total: Callable[[Table], Arrays] | None = None, last: Callable[[Table], Arrays] | None = None) -> DataFrame:
    """Answers (kind 1) to the packs of ``deal``, beside the directories (kind 0).

    fold: adds a pack to the part's table. answer: what goes back to the pack's unit;
    its ``row``, if any, is the row within the unit. total: one more row (kind 2) for the part,
    made before the answers. last: one more row (kind 3), made after them.
    """

    def go(batches):
        table, held = Table(folds), tempfile.SpooledTemporaryFile(max_size=16 << 20)
        sizes: list[tuple[int, int]] = []
        with held:
            for b in batches:
                units, kinds = b.column("unit").to_pylist(), b.column("kind").to_pylist()
                for i, (u, k) in enumerate(zip(units, kinds, strict=True)):
                    data = b.column("payload")[i].as_py()
                    if k == 0:
                        yield raw([u], [0], [data])
                        continue
                    e = carried(unpack(data))
                    fold(table, e)
                    held.write(data)
                    sizes.append((u, len(data)))
            table.close()
            if total is not None and table.hash is not None:
                yield raw([-1], [2], [pack(total(table))])
            held.seek(0)
            out: tuple[list, list, list] = ([], [], [])
            for u, n in sizes:
                e = carried(unpack(held.read(n)))
                a = answer(table, e)
                if a is not None and len(next(iter(a.values()))):
                    if "row" in a:
                        a["row"] = e["rows"][a["row"]]
                    out[0].append(u)
                    out[1].append(1)
                    out[2].append(pack({k: small(v) if v.dtype.kind in "ui" else v for k, v in a.items()}))
                    if len(out[0]) == 64:
                        yield raw(*out)
                        out = ([], [], [])
            if out[0]:
                yield raw(*out)
            if last is not None and table.hash is not None:
                yield raw([-1], [3], [pack(last(table))])

    return tc.arrow_batches(packs, go, RAW)


def raw(units: list, kinds: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], ["unit", "kind", "payload"])


def assemble(settled: DataFrame, make: Callable[[Arrays, list[Arrays]], pa.RecordBatch], schema: str) -> DataFrame:
    """One call of ``make`` for each unit, with its directory and all answers to it."""

    def go(batches):
        for directory, answers in _by_unit(batches):
            yield make(directory, answers)

    parts = parts_of(settled)
    by_unit = settled.repartition(parts, "unit").sortWithinPartitions("unit", "kind")
    return tc.arrow_batches(by_unit, go, schema)


def _by_unit(batches) -> Iterator[tuple[Arrays, list[Arrays]]]:
    directory, answers = None, []
    for b in batches:
        for k, data in zip(b.column("kind").to_pylist(), b.column("payload").to_pylist(), strict=True):
            if k == 0:
                if directory is not None:
                    yield directory, answers
                directory, answers = unpack(data), []
            else:
                answers.append(unpack(data))
    if directory is not None:
        yield directory, answers


def by_row(rows: np.ndarray, values: np.ndarray, n: int) -> list[np.ndarray]:
    """``values`` of each of ``n`` rows, ascending."""
    order = np.lexsort((values, rows))
    return np.split(values[order], np.searchsorted(rows[order], np.arange(1, n)))
