"""Operator 1: language identification by nearest clustered centroids.

A text is a vector of hashed character n-grams (bytes of the lower-cased text
with runs of other than letters as one space) of 1 to 3 bytes, weighted by
sublinear term frequency times inverse document frequency and normalised. Each
language has ``CENTROIDS`` centroids from spherical k-means; a text gets the
language of the centroid with the largest cosine. Texts farther from every
centroid than their length explains are rejected: the least accepted cosine of
a length class is a share of the quantile that the training rows of that class reach.

Centroids and document frequencies are fitted on about ``SAMPLE`` labelled rows for
each language (by hash of their ids) of the training folds, a language to a task, so
the driver gets centroids only; the quantiles come from all training rows, and every
whole text is classified. No language is left out.

Cases: a text that is null or has no letter is ``und`` with score 0 and is
rejected; a null language teaches nothing; without training rows every text
with letters is ``und``; repeated rows each get a row; a null ``doc_id`` is
never held out nor learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as ex
from . import textcore as tc
from .classifier import fold

#: Bound of the labelled rows for each language that the centroids are fitted on.
SAMPLE = 1200
BUCKETS = 1 << 12
CENTROIDS = 4
#: A text is rejected below this share of the cosine that all but SLACK of the training rows of its length reach.
SHARE, SLACK = 0.6, 0.002
#: Steps of cosine that quantiles are told apart by.
STEPS = 4096
PIECE = 1 << 20
#: Languages whose shares are broadcast; more are joined by a shuffle.
BROADCAST = 1 << 16
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")
_LENGTHS = np.array([0, 8, 16, 32, 64, 128, 256, 1024])


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text, hashed in pieces that overlap by what an n-gram needs; None without a letter."""
    if not _LETTER.search(text):
        return None
    out = np.zeros(BUCKETS)
    whole = np.frombuffer(b" " + _OTHER.sub(b" ", text.lower().encode("utf-8", "replace")) + b" ", np.uint8)
    for n in (1, 2, 3):
        for i in range(0, max(len(whole) - n + 1, 0), PIECE):
            m = min(PIECE, len(whole) - n + 1 - i)
            data = whole[i : i + m + n - 1].astype(np.uint32)
            x = np.full(m, n, np.uint32)
            for k in range(n):
                x = (x + data[k : k + m]) * np.uint32(0x9E3779B1)
                x ^= x >> np.uint32(15)
            out += np.bincount((x >> np.uint32(7)) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


def length_class(rows: np.ndarray) -> np.ndarray:
    return np.searchsorted(_LENGTHS, rows.sum(1) / 3, "right") - 1


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(rows).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def centroids_of(rows: np.ndarray, idf: np.ndarray, k: int = CENTROIDS, seed: int = 5) -> np.ndarray:
    """Centroids of one language's rows of counts, by spherical k-means."""
    v = vectors(rows, idf)
    c = v[np.random.default_rng(seed).choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(12):
        near = (v @ c.T).argmax(1)
        c = np.stack([v[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def thresholds(seen: np.ndarray) -> np.ndarray:
    """Least accepted cosine of each length class, from counts of rows by class and step of cosine.

    A class without rows takes the next longer one's, or else the next shorter one's;
    shorter texts are never asked for more than longer ones.
    """
    n = seen.sum(1)
    at = np.array([np.searchsorted(np.cumsum(x), max(1, int(np.ceil(SLACK * k)))) / STEPS if k else np.nan for x, k in zip(seen, n, strict=True)])
    have = np.flatnonzero(n)
    if not len(have):
        return np.zeros(len(n))
    at = at[[have[min(np.searchsorted(have, i), len(have) - 1)] for i in range(len(n))]]
    return SHARE * np.minimum.accumulate(at[::-1])[::-1]


class CentroidModel:
    """Clustered centroids of TF-IDF vectors for each language, and the least cosines accepted."""

    def __init__(self, idf: np.ndarray, names: list[str], centroids: list[np.ndarray]):
        self.idf, self.names, self.matrix = idf, np.array(names), np.concatenate(centroids).T.astype(np.float32)
        self.owner = np.repeat(np.arange(len(names)), [len(c) for c in centroids])
        self.least = np.zeros(len(_LENGTHS))

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, cosine and whether the row is rejected."""
        s = vectors(rows, self.idf) @ self.matrix
        at = s.argmax(1)
        best = np.clip(s[np.arange(len(s)), at], 0, 1).astype(float)
        return self.owner[at], best, best < self.least[length_class(rows)]


def train(labelled: DataFrame, sample: int = SAMPLE) -> CentroidModel | None:
    """A model from (text, lang, key) rows; ``key`` decides, by hash, which rows centroids are fitted on."""
    spark = labelled.sparkSession
    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), "key")
    sizes = rows.groupBy("lang").agg((F.lit(1_000_000) * F.least(F.lit(1.0), sample / F.count("*"))).alias("share"))
    sizes = tc.stored(sizes, "languages")
    if sizes.count() <= BROADCAST:  # a short name and a number each
        sizes = F.broadcast(sizes)
    picked = rows.join(sizes, "lang").where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.col("share"))

    def counted(batches):
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (c := counts(t)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([ex.pack({"n": ex.small(c.astype(np.int64))})])], ["lang", "v"])

    kept = tc.stored(tc.arrow_batches(picked.select("text", "lang"), counted, "lang string, v binary"), "counts")

    def present(batches):
        n, df = 0, np.zeros(BUCKETS, np.int64)
        for b in batches:
            for v in b.column("v").to_pylist():
                df += ex.unpack(v)["n"] > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()])], ["n", "df"])

    n, df = 0, np.zeros(BUCKETS, np.int64)
    for r in tc.arrow_batches(kept.select("v").coalesce(64), present, "n long, df binary").collect():  # 32 kB from each of 64 tasks at most
        n, df = n + r.n, df + np.frombuffer(r.df, np.int64)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.3)

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([ex.unpack(v)["n"].astype(np.float32) for v in sorted(part["v"])])  # the order of partitions doesn't matter
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "c": [centroids_of(x, idf).astype(np.float32).tobytes()]})

    tc.ship(spark)
    got = sorted(kept.groupBy("lang").applyInPandas(cluster, "lang string, c binary").collect(), key=lambda r: r.lang)  # CENTROIDS vectors a language
    model = CentroidModel(idf, [r.lang for r in got], [np.frombuffer(r.c, np.float32).reshape(-1, BUCKETS) for r in got])
    shared = spark.sparkContext.broadcast(model)

    def reached(batches):
        seen = np.zeros((len(_LENGTHS), STEPS), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = [c for c in map(counts, b.column(0).slice(i, 256).to_pylist()) if c is not None]
                if part:
                    x = np.stack(part)
                    np.add.at(seen, (length_class(x), np.minimum((shared.value.predict(x)[1] * STEPS).astype(int), STEPS - 1)), 1)
        at = np.argwhere(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(seen[tuple(at.T)])], ["k", "step", "n"])

    seen = np.zeros((len(_LENGTHS), STEPS), np.int64)
    for r in tc.arrow_batches(rows.select("text"), reached, "k long, step long, n long").groupBy("k", "step").agg(F.sum("n").alias("n")).collect():  # of a fixed size
        seen[r.k, r.step] = r.n
    model.least = thresholds(seen)
    return model


def identify(docs: DataFrame, model: CentroidModel | None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score (the cosine) and rejected; input columns of these names are replaced."""
    own = ("lang_pred", "score", "rejected")
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in own]
    base = docs.select(*keep, F.col("text").cast("string").alias("_lang_id_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        m = shared.value
        for b in batches:
            texts = b.column(len(keep))
            for i in range(0, b.num_rows, 256):
                part = [counts(t) if t else None for t in texts.slice(i, 256).to_pylist()]
                n, ok = len(part), [k for k, c in enumerate(part) if c is not None]
                lang, score, out = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
                if ok and m is not None:
                    at, score[ok], out[ok] = m.predict(np.stack([part[k] for k in ok]))
                    lang[ok] = m.names[at]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, n) for k in range(len(keep))), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(out)], [*keep, *own])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "lang_pred string, score double, rejected boolean"])
    return tc.arrow_batches(base, scan, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tc.documents(spark, sf_dir)
    model = train(docs.where(fold("doc_id", 3) != 1).select("text", "lang", F.col("doc_id").alias("key")))
    return identify(docs, model, ["doc_id"]).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
