"""Operator 8: quality classifier on supervised subword embeddings.

Words and character n-grams are hashed into ``BUCKETS`` learned vectors; a
document is the average of the vectors of all its features, a softmax layer gives
the label's probability, and both are trained together by stochastic gradient
descent in numpy. As the document vector is an average and the output is linear
in it, a trained model is also one weight per bucket, which is how whole texts
are scored in one vectorised pass.

The model is fitted on at most ``SAMPLE`` labelled rows (those with the smallest
hashes of their ids, from the training folds, whatever their length); their features
are counted on the executors. Every row is scored.

Cases: null and empty texts have no features and get the prior's score; a null
``doc_id`` is never labelled nor held out; labels that repeat for an id count
once, as their minimum; without labels of both kinds the score is the prior
(0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as ex
from . import textcore as tc

#: Bound of the labelled rows that the model is fitted on.
SAMPLE = 6000
BUCKETS = 1 << 16
DIM = 8
NGRAMS = (2, 3, 4)
#: The bucket of a word that stands again right after itself; it counts four times, as a word's n-grams do.
REPEAT = 0
EPOCHS = 8
RATE = 0.5
THRESHOLD = 0.7


def features(data: np.ndarray, offs: np.ndarray, ngrams: tuple[int, ...] = NGRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each feature: the words, their immediate repeats, and the byte n-grams inside words and over their ends."""
    start, end, row = tc.word_bounds(data, offs, tc.WHITE)
    w = tc.span_hashes(data, start, end)
    buckets, rows = [(w & tc.U(BUCKETS - 1)).astype(np.int32)], [row.astype(np.int32)]
    again = np.flatnonzero((w[1:] == w[:-1]) & (row[1:] == row[:-1])) + 1
    buckets += [np.full(len(again), REPEAT, np.int32)] * 4
    rows += [row[again].astype(np.int32)] * 4
    if len(data):
        code = np.where(tc.WHITE[data], 0x20, data).astype(np.uint32)
        at = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
        for n in ngrams:
            m = len(data) - n + 1
            if m <= 0:
                continue
            x = np.full(m, n, np.uint32)
            for k in range(n):
                x = x * np.uint32(0x01000193) + code[k : k + m] * np.uint32(0x9E3779B1)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            ok = at[n - 1 :] == at[:m]
            buckets.append((x[ok] & np.uint32(BUCKETS - 1)).astype(np.int32))
            rows.append(at[:m][ok])
    return np.concatenate(buckets), np.concatenate(rows)


def counted(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text's features, ascending, and how often each occurs; a long text is taken a megabyte at a time.

    A feature over such a cut counts on neither side but its word does: cuts are at white space.
    """
    total = np.zeros(BUCKETS, np.int64)
    a, end = 0, len(data)
    while a < end:
        b = min(a + tc.PIECE, end)
        if b < end:
            white = np.flatnonzero(tc.WHITE[data[a:b]])
            b = a + int(white[-1]) + 1 if len(white) else b
        f, _ = features(data[a:b], np.array([0, b - a], np.int64))
        total += np.bincount(f, minlength=BUCKETS)
        a = b
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at]


class SubwordClassifier:
    """Averaged hashed vectors and a softmax over labels, trained by SGD."""

    def __init__(self, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11):
        self.dim, self.epochs, self.rate, self.seed = dim, epochs, rate, seed

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int = 2) -> SubwordClassifier:
        """bags: the buckets of each text's features, and the share of each (``bag``)."""
        rng = np.random.default_rng(self.seed)
        e = rng.uniform(-1 / self.dim, 1 / self.dim, (BUCKETS, self.dim)).astype(np.float32)
        w = np.zeros((classes, self.dim), np.float32)
        prior = np.bincount(labels, minlength=classes) + 1
        b = np.log(prior / prior.sum()).astype(np.float32)
        steps, done = self.epochs * len(bags), 0
        for _ in range(self.epochs):
            for i in rng.permutation(len(bags)):
                f, n = bags[i]
                rate = self.rate * (1 - done / steps)
                done += 1
                if not len(f):
                    continue
                rows = e[f]
                v = n @ rows
                z = w @ v + b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                g = p @ w
                w -= rate * np.outer(p, v)
                b -= 0.1 * rate * p
                # a bag of many rare features moves as much as one of few
                e[f] = rows - (rate * n * len(n))[:, None] * g / np.sqrt(len(n))
        self.vectors, self.out, self.bias = e, w, b
        return self

    def table(self) -> tuple[np.ndarray, float]:
        """For two labels: the log-odds weight of each bucket, and the bias."""
        d = self.out[1] - self.out[0]
        return (self.vectors @ d).astype(np.float32), float(self.bias[1] - self.bias[0])


def score_slice(data: np.ndarray, offs: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """The probability of label 1 for each text of a slice."""
    rows = len(offs) - 1
    f, r = features(data, offs)
    n = np.bincount(r, minlength=rows)
    z = np.bincount(r, weights=table[f], minlength=rows) / np.maximum(n, 1) + bias
    return 1 / (1 + np.exp(-z))


def classify(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` of every row of ``docs``.

    labelled: (text, label 0/1, key) rows to learn from; ``key`` decides, by hash, which are sampled.
    """
    def bags(batches):
        for b in batches:
            for i in range(b.num_rows):
                data, offs = tc.string_buffers(b.column("text").slice(i, 1))
                f, n = counted(data, offs)
                yield pa.RecordBatch.from_arrays([b.column("label").slice(i, 1), b.column("key").slice(i, 1), pa.array([ex.pack({"hash": f, "n": ex.small(n)})])], ["label", "key", "bag"])

    kept = tc.arrow_batches(labelled.select(F.col("text").cast("string"), F.col("label").cast("long"), F.col("key").cast("long")), bags, "label long, key long, bag binary")
    rows = kept.withColumn("h", F.xxhash64("key")).orderBy("h", "key", "label", "bag").limit(sample).select("label", "bag").collect()
    y = np.array([r.label for r in rows], np.int64)
    if len(set(y.tolist())) == 2:
        made = []
        for r in rows:
            e = ex.unpack(r.bag)
            made.append((e["hash"], (e["n"] / max(e["n"].sum(), 1)).astype(np.float32)))
        table, bias = SubwordClassifier().fit(made, y).table()
    else:
        table, bias = np.zeros(BUCKETS, np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    model = docs.sparkSession.sparkContext.broadcast((table, bias))

    def scan(batches):
        t, b0 = model.value
        for b in batches:
            data, offs = tc.string_buffers(b.column(1))
            for i, j in tc.slices(offs, 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(score_slice(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], t, b0))], ["doc_id", "score"])

    out = tc.arrow_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scan, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fold(column: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tc.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))
    chosen = tc.thinned(labels.where(fold("doc_id", 4) != 2), "doc_id", SAMPLE)
    picked = F.broadcast(chosen)  # about SAMPLE rows
    labelled = docs.where("text is not null").join(picked, "doc_id").select("text", F.col("label").cast("long"), F.col("doc_id").alias("key"))
    out = classify(docs, labelled)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
