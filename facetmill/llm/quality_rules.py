"""Operator 5: quality rules with an isolation forest over rule statistics.

``rule_statistics`` scans each text once. ``IsolationForest`` (Liu et al., 2008)
isolates rows by random splits; rows with short paths are anomalous. The forests
come from at most ``SAMPLE`` labelled rows (those with the smallest hashes of their
ids); thresholds come from the scores of all labelled good rows, and statistics and
verdicts cover all rows.

Cases: a null or empty text has no words and fails the base rules; a null
``doc_id`` matches no label; repeated rows each get a row; without labelled good
rows nothing is anomalous; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc

#: Bound of the labelled rows that the forests are fitted on.
SAMPLE = 20_000
#: Share of good labelled rows that all thresholds together may reject.
REJECT_GOOD = 0.001
#: Steps of score that thresholds are told apart by.
STEPS = 1 << 14

#: Each family of rule statistics has a forest of its own, so that rows which stand
#: out in one family are not hidden by what is usual in the others.
FAMILIES = [["symbols"], ["dup_lines", "repeats"], ["mean_word", "distinct"], ["upper", "digits", "marks"]]

RATIOS = ["mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct"]
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"r_{x} double" for x in RATIOS)

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?;:=_~^@\\/{}[]+")] = True


def _repeated(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more in their row."""
    k = tc.mix(keys + row.astype(tc.U) * tc.U(0x9E3779B97F4A7C15))
    order = np.argsort(k)
    s = k[order]
    same = np.zeros(len(k), bool)
    eq = s[1:] == s[:-1]
    same[order[1:][eq]] = True
    same[order[:-1][eq]] = True
    return same


def _distinct_per_row(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    k = tc.mix(keys + row.astype(tc.U) * tc.U(0x9E3779B97F4A7C15))
    order = np.argsort(k)
    s = k[order]
    new = np.ones(len(k), bool)
    new[1:] = s[1:] != s[:-1]
    return np.bincount(row[order[new]], minlength=rows)


def statistics(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The rule statistics of a slice of texts, as arrays by name."""
    rows = len(offs) - 1

    def per_row(mask: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return s[offs[1:]] - s[offs[:-1]]

    start, end, row = tc.word_bounds(data, offs, tc.WHITE)
    n_words = np.bincount(row, minlength=rows)
    lead = (data & 0xC0) != 0x80
    words = tc.span_hashes(data, start, end)
    grams, at = tc.ngram_hashes(words, row, 5)
    hits = at[_repeated(grams, row[at])] if len(at) else at
    covered = tc.cover(hits, 5, len(words)) if len(words) else np.zeros(0, bool)
    line_sep = np.zeros(256, bool)
    line_sep[0x0A] = True
    ls, le, lrow = tc.word_bounds(data, offs, line_sep)
    w = np.concatenate([[0], np.cumsum(~tc.WHITE[data], dtype=np.int64)])
    full = w[le] > w[ls]
    ls, le, lrow = ls[full], le[full], lrow[full]
    n_lines = np.bincount(lrow, minlength=rows)
    lines = _long_spans(data, ls, le)
    out = {
        "n_words": n_words, "word_chars": per_row(lead & ~tc.WHITE[data]), "n_symbols": per_row(_SYMBOLS[data]),
        "n_dup_lines": n_lines - _distinct_per_row(lines, lrow, rows), "n_repeat_words": np.bincount(row[covered], minlength=rows),
    }
    upper = per_row((data >= 0x41) & (data <= 0x5A))
    lower = per_row((data >= 0x61) & (data <= 0x7A))
    n, chars = np.maximum(n_words, 1), np.maximum(out["word_chars"], 1)
    ratios = [
        out["word_chars"] / n, out["n_symbols"] / n, out["n_dup_lines"] / np.maximum(n_lines, 1), out["n_repeat_words"] / n, upper / np.maximum(upper + lower, 1),
        per_row((data >= 0x30) & (data <= 0x39)) / chars, per_row(_MARKS[data]) / n, _distinct_per_row(words, row, rows) / n,
    ]
    return out | {f"r_{k}": v.astype(float) for k, v in zip(RATIOS, ratios, strict=True)}


def _long_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = tc.span_hashes_any(data, start, end)
    return tc.mix(out ^ (end - start).astype(tc.U))


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the rule statistics of every whole text, one row for each row of ``docs``."""

    def scan(batches):
        for b in batches:
            data, offs = tc.string_buffers(b.column(1))
            for i, j in tc.slices(offs):
                s = statistics(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(v.astype(float) if k[:2] == "r_" else v.astype(np.int64)) for k, v in s.items())], ["doc_id", *s])

    return tc.arrow_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scan, STATS)


class IsolationForest:
    """Random split trees over sub-samples, in arrays; ``score`` is 2**(-mean path / c)."""

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 7):
        self.trees, self.sample, self.seed = trees, sample, seed

    @staticmethod
    def _c(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        size = min(self.sample, len(x))
        depth = int(np.ceil(np.log2(max(size, 2))))
        self.norm, self.forest = max(self._c(size), 1e-9), []
        for _ in range(self.trees):
            nodes: list[list[float]] = []

            def grow(rows: np.ndarray, level: int) -> int:
                at = len(nodes)
                nodes.append([-1, 0.0, 0, 0, level + self._c(len(rows))])
                part = x[rows]
                lo, hi = (part.min(0), part.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
                varied = np.flatnonzero(hi > lo)
                if level >= depth or len(rows) < 2 or not len(varied):
                    return at
                f = int(rng.choice(varied))
                cut = rng.uniform(lo[f], hi[f])
                left = grow(rows[part[:, f] <= cut], level + 1)
                right = grow(rows[part[:, f] > cut], level + 1)
                nodes[at] = [f, cut, left, right, 0.0]
                return at

            grow(rng.choice(len(x), size, replace=False), 0)
            self.forest.append(np.array(nodes))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.forest:
            f, cut, left, right, path = t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4]
            at = np.zeros(len(x), int)
            while len(go := np.flatnonzero(f[at] >= 0)):
                k = at[go]
                at[go] = np.where(x[go, f[k]] <= cut[k], left[k], right[k])
            total += path[at]
        return 2.0 ** (-total / len(self.forest) / self.norm)


def calibrate(good: np.ndarray, reject_good: float = REJECT_GOOD) -> float:
    """The lowest threshold, in steps of score, that rejects at most ``reject_good`` of the good rows; 2 without any.

    good: how many good rows have a score of each step.
    """
    n = int(good.sum())
    if not n:
        return 2.0
    above = n - np.cumsum(good)  # rows past each step
    return (int(np.flatnonzero(above <= reject_good * n)[0]) + 1) / STEPS


def step_of(score: np.ndarray) -> np.ndarray:
    return np.minimum((score * STEPS).astype(np.int64), STEPS - 1)


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, reject_good: float = REJECT_GOOD) -> DataFrame:
    """Statistics, anomaly (the largest score of a family over its threshold) and verdict of each document."""
    stats = tc.stored(rule_statistics(docs).withColumn("base_failed", base_failed()), "rules")
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cols = [f"r_{x}" for x in RATIOS]
    labelled = tc.stored(stats.where("not base_failed").join(marks, "doc_id").select("doc_id", "quality", *cols), "labelled")
    some = tc.thinned(labelled, "doc_id", sample).withColumn("h", F.xxhash64("doc_id"))
    rows = some.orderBy("h", "doc_id", *cols).limit(sample).select(*cols).toPandas()
    models: list[tuple[list[int], IsolationForest, float]] = []
    if len(rows):
        x = rows.to_numpy(float)
        fitted = [(at := [RATIOS.index(c) for c in family], IsolationForest().fit(x[:, at])) for family in FAMILIES]

        def scored(batches):
            seen = np.zeros((len(fitted), STEPS), np.int64)
            for b in batches:
                v = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols], 1)
                for f, (at, forest) in enumerate(fitted):
                    seen[f] += np.bincount(step_of(forest.score(v[:, at])), minlength=STEPS)
            at = np.argwhere(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(seen[tuple(at.T)])], ["f", "step", "n"])

        good = np.zeros((len(fitted), STEPS), np.int64)
        for r in tc.arrow_batches(labelled.where("quality = 1").select(*cols), scored, "f long, step long, n long").groupBy("f", "step").agg(F.sum("n").alias("n")).collect():  # of a fixed size
            good[r.f, r.step] = r.n
        models = [(at, forest, calibrate(g, reject_good / len(FAMILIES))) for (at, forest), g in zip(fitted, good, strict=True)]

    def judge(batches):
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols], 1)
            s = np.max([np.zeros(len(x)), *((step_of(forest.score(x[:, at])) + 0.5) / STEPS / t for at, forest, t in models)], axis=0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEEP), pa.array(s)], [*KEEP, "anomaly"])

    KEEP = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly double"
    return tc.arrow_batches(stats, judge, kinds).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < 1))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(tc.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE_SQL: dict[str, str] = {}
