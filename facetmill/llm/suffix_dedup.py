"""Operator 7: suffix-array dedup of 50-byte strings by external induced sorting.

Texts are cut to shards by content: each 50-byte window belongs to the leftmost of
the least hashes of the 20-byte strings in it, so equal windows belong to equal
anchors. An anchor that stands in one document alone has no repeats. Runs of windows
of one shared anchor are segments; a segment's bytes go to the shard of its anchor,
so all occurrences of a window meet in one shard. There distinct segments are laid
end to end and their suffixes sorted by induction with queues on disk
(``induced_sort``), whose queues carry the common prefixes of neighbours; neighbours
with 50 bytes in common are one string, and it is removed wherever a document with a
smaller id has it too. The string of names is sorted by doubling instead of a further
induction, as the README tells. Beyond a limit the text of a shard and the least id of
each of its places stand in files.

Cases: null texts are empty; texts under 50 bytes lose nothing; a null doc_id stands
after all others, and rows with one id never remove bytes of each other; repeated
rows give repeated results; exact copies are settled by their keys and only the
first is sorted; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as ex
from . import induced_sort
from . import textcore as tc

LENGTH = 50
ANCHOR = 20
#: Bytes beyond which a shard's segments, text and ids go to files.
LIMIT = 32 << 20
_TOP = np.iinfo(np.uint64).max


def _string_hashes(data: np.ndarray, offs: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at each place; the largest value where a row ends before."""
    n = len(data)
    out = np.full(n, _TOP, tc.U)
    for a in range(0, n - k + 1, tc.PIECE):
        b = min(n, a + tc.PIECE + k - 1)
        up, down = tc._BYTES.get(b - a)
        s = np.empty(b - a + 1, tc.U)
        s[0] = 0
        np.cumsum(tc.TABLE[data[a:b]] * up, out=s[1:])
        out[a : b - k + 1] = tc.mix((s[k:] - s[:-k]) * down[: b - a - k + 1])
    out[~_whole(offs, k)] = _TOP
    return out


def _whole(offs: np.ndarray, k: int) -> np.ndarray:
    """Which places have k bytes of their row from there on."""
    out = np.ones(int(offs[-1]), bool)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        out[max(a, b - k + 1) : b] = False
    return out


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the least of the w values from each place on, as far as high bits tell; the leftmost of equals.

    Places stand in the low bits, so one minimum finds both.
    """
    low = max(1, len(h).bit_length())
    mask = tc.U((1 << low) - 1)
    key, have = (h & ~mask) | np.arange(len(h), dtype=tc.U), 1
    while have < w:
        step = min(have, w - have)
        if len(key) <= step:
            return np.zeros(0, np.int64)
        key = np.minimum(key[:-step], key[step:])
        have += step
    return (key & mask).astype(np.int64)


def owners(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts of windows, and the places and hashes of their anchors, for rows of about a megabyte at a time."""
    for i, j in tc.slices(offs, 1 << 20):
        part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        h = _string_hashes(part, o, anchor)
        place = _least(h, length - anchor + 1)
        at = np.flatnonzero(_whole(o, length)[: len(place)])
        place = place[at]
        yield at + offs[i], place + offs[i], h[place]


def _dealt(h: np.ndarray) -> np.ndarray:
    """Keys of anchors, spread evenly: anchors are least hashes, and so small ones."""
    return tc.mix(h ^ tc.U(0x94D049BB133111EB))


def _unit(b: pa.RecordBatch):
    data, offs = tc.string_buffers(b.column("text"))
    return data, offs


def deal_segments(near: DataFrame, parts: int, length: int = LENGTH) -> DataFrame:
    """Packs of segments by the hash of their anchors, beside directories, as ``exchange.deal`` makes them."""

    def go(batches):
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            unit, n = (task << 32) | n, n + 1
            data, offs = _unit(b)
            did, tkey = b.column("did").to_numpy(), b.column("tkey").to_numpy()
            shared = np.zeros(len(data) + 1, bool)
            for r, p in enumerate(b.column("hits").to_pylist()):
                shared[offs[r] + np.frombuffer(p, np.uint32)] = True
            runs = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, tc.U))]
            for at, anchor, h in owners(data, offs, length):
                keep = shared[anchor]
                at, anchor, h = at[keep], anchor[keep], h[keep]
                if len(at):
                    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
                    runs.append((at[first], np.diff(np.append(first, len(at))), h[first]))
            start, count, key = (np.concatenate(x) for x in zip(*runs, strict=True))
            key = _dealt(key)
            order = np.argsort(key, kind="stable")
            start, count, key = start[order], count[order], key[order]
            row = np.searchsorted(offs, start, "right") - 1
            part = ((key >> tc.U(40)) * tc.U(parts)) >> tc.U(24)
            cuts = np.searchsorted(part, np.arange(parts + 1, dtype=tc.U))
            yield ex.pack_rows([unit], [0], [unit % parts], [ex.pack({"did": did, "tkey": tkey})])
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                s = slice(cuts[p], cuts[p + 1])
                size = count[s] + length - 1
                done = np.cumsum(size)
                text = data[np.repeat(start[s] - (done - size), size) + np.arange(done[-1])]
                e = {"hash": key[s], "row": ex.small(row[s]), "pos": ex.small(start[s] - offs[row[s]]), "count": ex.small(count[s]), "did": did[row[s]], "text": text}
                yield ex.pack_rows([unit], [1], [p], [ex.pack(e)])

    packs = tc.arrow_batches(near.select("did", "tkey", "text", "hits"), go, "unit long, kind int, part int, payload binary")
    return ex.by_part(packs, parts)


def _numbers(n: int, kind: type, limit: int = LIMIT) -> np.ndarray:
    """An array of n numbers, in a file beyond ``limit`` bytes; the file has no name and goes with the array."""
    if n * np.dtype(kind).itemsize <= limit:
        return np.empty(n, kind)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, kind, "w+", shape=(n,))


def repeats(text: np.ndarray, low: np.ndarray, length: int = LENGTH, limit: int = LIMIT) -> None:
    """Lowers ``low``, the id (or its rank) of the segment of each place, to the least of all segments that hold the ``length`` bytes there.

    text: segments, each followed by a zero byte, other bytes one up. Strings across a
    zero byte get values too, which mean nothing.
    """
    open_at: list[np.ndarray] = []  # places of the string that the blocks so far end with
    for x, lcp in induced_sort.order(text, length, limit):
        cut = np.flatnonzero(lcp < length)
        if not len(cut):
            open_at.append(x)
            continue
        if cut[0]:
            open_at.append(x[: cut[0]])
        _lower(low, open_at)
        size = np.diff(cut)
        many = np.flatnonzero(size > 1)
        if len(many):
            n = size[many]
            done = np.cumsum(n)
            at = x[np.repeat(cut[many] - (done - n), n) + np.arange(done[-1])]
            low[at] = np.repeat(np.minimum.reduceat(low[at], done - n), n)
        open_at = [x[cut[-1] :].copy()]
    _lower(low, open_at)


def _lower(low: np.ndarray, places: list[np.ndarray]) -> None:
    if sum(map(len, places)) > 1:
        least = min(low[x].min() for x in places)
        for x in places:
            low[x] = least


def settle_segments(packs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Removed runs (row, start, size) of each unit's segments."""

    def go(batches):
        held, texts = tempfile.SpooledTemporaryFile(LIMIT), tempfile.SpooledTemporaryFile(LIMIT)
        sizes: list[tuple[int, int]] = []
        known: dict[int, int] = {}
        ids, lengths, anchors = array("q"), array("q"), array("Q")
        with held, texts:
            for b in batches:
                for u, k, data in zip(b.column("unit").to_pylist(), b.column("kind").to_pylist(), b.column("payload").to_pylist(), strict=True):
                    if k == 0:
                        yield ex.raw([u], [0], [data])
                        continue
                    e = ex.unpack(data)
                    key, a, z = _segment_keys(e, length)
                    for i in np.unique(key, return_index=True)[1].tolist():
                        if int(key[i]) not in known:
                            known[int(key[i])] = len(ids)
                            texts.write(e["text"][a[i] : z[i]].tobytes())
                            lengths.append(int(z[i] - a[i]))
                            ids.append(tc.NO_ID)
                            anchors.append(int(e["hash"][i]))
                    seg = np.array([known[x] for x in key.tolist()], np.int64)
                    order = np.argsort(seg, kind="stable")
                    cut = np.flatnonzero(np.append(True, seg[order][1:] != seg[order][:-1]))
                    for s, d in zip(seg[order][cut].tolist(), np.minimum.reduceat(e["did"][order], cut).tolist(), strict=True):
                        ids[s] = min(ids[s], d)
                    held.write(data)
                    sizes.append((u, len(data)))
            if not ids:
                return
            # a segment that is alone with its anchor shares windows with no other one
            ids_of = np.array(ids, np.int64)
            _, which, times = np.unique(np.array(anchors, np.uint64), return_inverse=True, return_counts=True)
            many = np.flatnonzero(times[which] > 1)
            size = np.array(lengths, np.int64)[many]
            start = np.cumsum(size + 1) - size - 1
            place = np.full(len(ids), -1, np.int64)
            place[many] = start
            low, by_rank = np.zeros(0, np.int32), np.zeros(0, np.int64)
            if len(many):
                n = int(start[-1] + size[-1] + 1)
                # ids by their ranks, in half the bytes
                by_rank, rank = np.unique(ids_of[many], return_inverse=True)
                text, low = _numbers(n, np.uint8), _numbers(n, np.int32)
                from_ = np.cumsum(np.array(lengths, np.int64))[many] - size
                for i, a, z, d in zip(from_.tolist(), start.tolist(), (start + size).tolist(), rank.tolist(), strict=True):
                    texts.seek(i)
                    text[a:z] = np.minimum(np.frombuffer(texts.read(z - a), np.uint8), 252) + np.uint8(1)
                    text[z] = 0
                    low[a : z + 1] = d
                repeats(text, low, length)
            held.seek(0)
            for u, n in sizes:
                e = ex.unpack(held.read(n))
                key, _, _ = _segment_keys(e, length)
                seg = np.array([known[x] for x in key.tolist()], np.int64)
                count = e["count"].astype(np.int64)
                done = np.cumsum(count)
                within = np.arange(done[-1]) - np.repeat(done - count, count)
                least = np.repeat(ids_of[seg], count)
                at = np.repeat(place[seg], count)
                sorted_ = at >= 0
                least[sorted_] = by_rank[low[at[sorted_] + within[sorted_]]]
                gone = least < np.repeat(e["did"], count)
                if not gone.any():
                    continue
                # runs of removed windows inside each segment
                lead = within == 0
                begin = gone & (lead | ~np.concatenate([[False], gone[:-1]]))
                b0 = np.flatnonzero(begin)
                stop = gone & np.concatenate([lead[1:] | ~gone[1:], [True]])
                b1 = np.flatnonzero(stop)
                owner = np.repeat(np.arange(len(count)), count)[b0]
                pos = e["pos"].astype(np.int64)[owner] + within[b0]
                yield ex.raw([u], [1], [ex.pack({"row": ex.small(e["row"][owner]), "pos": ex.small(pos), "size": ex.small(b1 - b0 + length)})])

    return tc.arrow_batches(packs, go, ex.RAW)


def _segment_keys(e: ex.Arrays, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = e["count"].astype(np.int64) + length - 1
    z = np.cumsum(size)
    a = z - size
    return tc.mix(tc.span_hashes_any(e["text"], a, z) ^ size.astype(tc.U)), a, z


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """did, tkey, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges) of each row of ``docs``."""
    spark = docs.sparkSession
    base = tc.keyed(docs)
    parts = ex.parts_of(base)

    def anchors(b):
        data, offs = _unit(b)
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, tc.U)]
        for _, p, h in owners(data, offs, length):
            new = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, np.int64)
            places.append(p[new])
            hashes.append(h[new])
        place, h = np.concatenate(places), np.concatenate(hashes)
        row = np.searchsorted(offs, place, "right") - 1
        raw = data.tobytes()
        sha = "".join(hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True))
        return {"hash": _dealt(h), "row": row, "pos": place - offs[row]}, {"did": b.column("did").to_numpy(), "tkey": b.column("tkey").to_numpy(), "n_bytes": np.diff(offs), "sha": np.frombuffer(sha.encode(), np.uint8)}

    def fold(table, e):
        table.add(e["hash"], {"low": e["did"], "high": e["did"]})

    def shared(table, e):
        t = table.at(e["hash"])
        m = t["low"] != t["high"]
        return {"row": e["row"][m], "pos": e["pos"][m]}

    found = tc.stored(ex.settle(ex.deal(base, anchors, parts, drop=16), fold, {"low": np.minimum, "high": np.maximum}, shared), "anchors")
    tc.release(spark)

    def rows_of(directory, answers):
        n = len(directory["did"])
        row = np.concatenate([a["row"] for a in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)
        pos = np.concatenate([a["pos"] for a in answers]).astype(np.uint32) if answers else np.zeros(0, np.uint32)
        hits = [p.tobytes() if len(p) else None for p in ex.by_row(row, pos, n)]
        cols = {"did": pa.array(directory["did"]), "tkey": pa.array(directory["tkey"]), "n_bytes": pa.array(directory["n_bytes"].astype(np.int64)), "sha": pa.array(directory["sha"].view("S64").astype(str).tolist(), pa.string()), "hits": pa.array(hits, pa.binary())}
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    rows = ex.assemble(found, rows_of, "did long, tkey long, n_bytes long, sha string, hits binary")
    rows = tc.stored(rows, "rows")
    firsts = rows.groupBy("tkey", "n_bytes").agg(F.min("did").alias("first"), F.max("did").alias("last"))
    copies = firsts.where("first < last").select("tkey", "n_bytes", "first")
    hits = tc.salted_join(rows.where("hits is not null"), copies, ["tkey", "n_bytes"], "left", "did").where("first is null or did = first").select("did", "tkey", "hits").dropDuplicates(["did", "tkey"])
    near = tc.stored(base.join(hits, ["did", "tkey"]).dropDuplicates(["did", "tkey"]), "near")
    tc.release(spark)

    gone = tc.stored(settle_segments(deal_segments(near, parts, length), length), "gone")
    tc.release(spark)

    def spans_of(directory, answers):
        n = len(directory["did"])
        cat = lambda c: np.concatenate([a[c] for a in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)
        row, pos, size = cat("row"), cat("pos"), cat("size")
        order = np.lexsort((pos, row))
        row, pos, size = row[order], pos[order], size[order]
        cuts = np.searchsorted(row, np.arange(n + 1))
        spans = [_union(pos[a:b], pos[a:b] + size[a:b]) if b > a else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(directory["did"]), pa.array(directory["tkey"]), pa.array(spans, pa.list_(pa.int64()))], ["did", "tkey", "spans"])

    spans = ex.assemble(gone, spans_of, "did long, tkey long, spans array<long>").where("spans is not null")

    def cut(batches):
        for b in batches:
            data, offs = _unit(b)
            n, sha, spans_in = [], [], b.column("spans").to_pylist()
            for r, s in enumerate(spans_in):
                raw, at, keep = data[offs[r] : offs[r + 1]], 0, hashlib.sha256()
                for i, j in zip(s[::2], s[1::2], strict=True):
                    keep.update(raw[at:i].tobytes())
                    at = j
                keep.update(raw[at:].tobytes())
                sha.append(keep.hexdigest())
                n.append(sum(s[1::2]) - sum(s[::2]))
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("tkey"), pa.array(n, pa.int64()), pa.array([len(s) // 2 for s in spans_in], pa.int64()), pa.array(sha, pa.string()), b.column("spans")], ["did", "tkey", "n_removed", "n_spans", "kept", "spans"])

    kind = "did long, tkey long, n_removed long, n_spans long, kept string, spans array<long>"
    cuts = tc.arrow_batches(near.select("did", "tkey", "text").join(spans, ["did", "tkey"]), cut, kind)
    out = tc.salted_join(rows.select("did", "tkey", "n_bytes", "sha").join(cuts, ["did", "tkey"], "left"), copies, ["tkey", "n_bytes"], "left", "did")
    copy = (F.col("did") > F.col("first")) & (F.col("n_bytes") >= length)
    all_gone = F.coalesce(copy, F.lit(False))
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "did", "tkey", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(all_gone, empty).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(all_gone, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
    )


def _union(start: np.ndarray, end: np.ndarray) -> list[int]:
    """Disjoint ascending ranges of what sorted ranges cover, flat."""
    reach = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return np.stack([start[first], reach[np.append(first[1:], len(start)) - 1]], 1).ravel().tolist()


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(tc.documents(spark, sf_dir)).select(tc.doc_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op7_suffix_array_dedup": op7_suffix_array_dedup}
ORACLE_SQL: dict[str, str] = {}
