"""Operator 10: exact substring dedup over words by fixed-block anchors.

Any 50 consecutive words hold a whole reference block of 25 words that starts at
a multiple of 25 in its document. All reference blocks are indexed and every
rolling window of 25 words probes the index; a hash that is a reference block in
one document and stands in another marks its places as anchors. Around anchors
the hits are extended: the 50-word windows that hold an anchor are looked up by
their hashes, a window is a repeat if its words also start in a document with a
smaller id, and the union of repeated windows are the maximal exact repeats.

Both look-ups are hash exchanges (``exchange``): no pairs of documents are formed,
one common passage costs one entry for each time it stands somewhere. Texts are
shuffled only for documents with anchors.

Cases: null or empty texts have no words; a null doc_id stands after all others and
two nulls are the same id; rows with the same id never remove words of each other;
repeated rows give repeated results; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as ex
from . import textcore as tc

WINDOW = 50


def _word_rows(b: pa.RecordBatch):
    data, offs = tc.string_buffers(b.column("text"))
    start, end, row = tc.word_bounds(data, offs, tc.WHITE)
    return data, offs, start, end, row, tc.row_starts(row, b.num_rows)


def _digests(data, offs, bounds, keep=None) -> list[str]:
    """SHA-256 of each row's words (those kept), joined by one space."""
    out = []
    for r, (i, j) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        words = data[i:j].tobytes().split()  # at 09-0D and 20, as words are
        if keep is not None:
            words = itertools.compress(words, keep[bounds[r] : bounds[r + 1]].tolist())
        out.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return out


def _hit_rows(directory: ex.Arrays, answers: list[ex.Arrays], columns: list[str]) -> pa.RecordBatch:
    n = len(directory["did"])
    rows = np.concatenate([a["row"] for a in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)
    pos = np.concatenate([a["pos"] for a in answers]).astype(np.uint32) if answers else np.zeros(0, np.uint32)
    hits = [p.tobytes() if len(p) else None for p in ex.by_row(rows, pos, n)]
    cols = [pa.array(directory[c]) if c != "sha" else pa.array(directory["sha"].view("S64").astype(str).tolist()) for c in columns]
    return pa.RecordBatch.from_arrays([*cols, pa.array(hits, pa.binary())], [*columns, "hits"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """did, tkey, n_words, n_removed, kept_sha256, removed (word ranges) of each row of ``docs``."""
    spark, block = docs.sparkSession, max(1, window // 2)
    base = tc.keyed(docs)
    parts = ex.parts_of(base)

    def probes(b):
        data, offs, start, end, row, bounds = _word_rows(b)
        h, at = tc.ngram_hashes(tc.span_hashes(data, start, end), row, block)
        row = row[at].astype(np.int32)
        entries = {"hash": h, "row": row, "pos": (at - bounds[row]).astype(np.int32)}
        sha = np.array(_digests(data, offs, bounds), "S64").view(np.uint8)
        return entries, {"did": b.column("did").to_numpy(), "tkey": b.column("tkey").to_numpy(), "n_words": np.diff(bounds), "sha": sha}

    folds = {"low": np.minimum, "high": np.maximum, "block": np.maximum}

    def fold(table, e):
        table.add(e["hash"], {"low": e["did"], "high": e["did"], "block": (e["pos"] % block == 0).astype(np.uint8)})

    def anchors(table, e):
        t = table.at(e["hash"])
        m = (t["low"] != t["high"]) & (t["block"] > 0)
        return {"row": e["row"][m], "pos": e["pos"][m]}

    # 24 bits fewer: a false anchor only costs a look at its windows
    found = tc.stored(ex.settle(ex.deal(base, probes, parts, drop=24), fold, folds, anchors), "anchors")
    tc.release(spark)
    names = ["did", "tkey", "n_words", "sha"]
    rows = tc.stored(ex.assemble(found, lambda d, a: _hit_rows(d, a, names), "did long, tkey long, n_words long, sha string, hits binary"), "rows")
    hits = rows.where("hits is not null").select("did", "tkey", "hits").dropDuplicates(["did", "tkey"])
    near = tc.stored(base.join(hits, ["did", "tkey"]).dropDuplicates(["did", "tkey"]), "near")
    tc.release(spark)

    def windows(b):
        data, offs, start, end, row, bounds = _word_rows(b)
        h, at = tc.ngram_hashes(tc.span_hashes(data, start, end), row, window)
        touched = np.zeros(len(start) + 1, np.int64)
        for r, p in enumerate(b.column("hits").to_pylist()):
            touched[bounds[r] + np.frombuffer(p, np.uint32)] = 1
        seen = np.concatenate([[0], np.cumsum(touched)])
        m = seen[at + window - block + 1] > seen[at]
        return {"hash": h[m], "row": row[at[m]], "pos": at[m] - bounds[row[at[m]]]}, {"did": b.column("did").to_numpy(), "tkey": b.column("tkey").to_numpy()}

    def first(table, e):
        table.add(e["hash"], {"low": e["did"]})

    def later(table, e):
        m = table.at(e["hash"])["low"] < e["did"]
        return {"row": e["row"][m], "pos": e["pos"][m]}

    again = tc.stored(ex.settle(ex.deal(near.select("did", "tkey", "text", "hits"), windows, parts), first, {"low": np.minimum}, later), "repeats")
    tc.release(spark)
    repeats = ex.assemble(again, lambda d, a: _hit_rows(d, a, ["did", "tkey"]), "did long, tkey long, hits binary").where("hits is not null")

    def cut(batches):
        for b in batches:
            data, offs, start, end, row, bounds = _word_rows(b)
            at = [bounds[r] + np.frombuffer(p, np.uint32).astype(np.int64) for r, p in enumerate(b.column("hits").to_pylist())]
            gone = tc.cover(np.concatenate(at), window, len(start))
            spans = [_runs(gone[bounds[r] : bounds[r + 1]]) for r in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column("did"), b.column("tkey"), pa.array(np.diff(np.concatenate([[0], np.cumsum(gone)])[bounds])), pa.array(_digests(data, offs, bounds, ~gone)), pa.array(spans, pa.list_(pa.int64()))],
                ["did", "tkey", "n_removed", "kept", "removed"],
            )

    cuts = tc.arrow_batches(near.select("did", "tkey", "text").join(repeats, ["did", "tkey"]), cut, "did long, tkey long, n_removed long, kept string, removed array<long>")
    out = rows.select("did", "tkey", "n_words", "sha").join(cuts, ["did", "tkey"], "left")
    return out.select("did", "tkey", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"), "removed")


def _runs(mask: np.ndarray) -> list[int]:
    """Start and end of each run of true values, flat."""
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(d == 1), np.flatnonzero(d == -1)], 1).ravel().tolist()


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(tc.documents(spark, sf_dir)).select(tc.doc_id(), "n_words", "n_removed", "kept_sha256")


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
