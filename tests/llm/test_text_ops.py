"""Operators on repeats: brute force on a fixture with every awkward case."""

import hashlib
import os
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, counted, frame, order, rows, sentence, words
from pyspark import TaskContext
from pyspark.sql import functions as F

from facetmill.llm import decontaminate, induced_sort, ngram_join, quality_rules, substring_dedup, suffix_dedup
from facetmill.llm import textcore as tc


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return frame(spark, data).cache()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_suffix_order_and_common_prefixes_with_queues_on_disk(monkeypatch):
    rng = np.random.default_rng(0)
    for turn in range(200):
        t = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(1, 300))).astype(np.uint8)
        if turn % 3 == 0:  # long repeats
            t = np.tile(t[: len(t) // 7 + 1], 8)
        depth = int(rng.choice([2, 17, 50, 255]))
        # blocks smaller than the queues, and spills while a queue's file is read
        monkeypatch.setattr(induced_sort, "BLOCK", int(rng.choice([3, 7, 64, 1 << 18])))
        got = list(induced_sort.order(t, depth, limit=int(rng.choice([16, 200, 1 << 20]))))
        at, common = (np.concatenate(x).tolist() for x in zip(*got, strict=True))
        assert sorted(at) == list(range(len(t)))
        heads = [t[i : i + depth].tobytes() for i in at]
        assert heads == sorted(heads, reverse=True)
        assert common == [0, *(len(os.path.commonprefix([x, y])) for x, y in zip(heads, heads[1:], strict=False))]


def test_op7_least_ids_of_repeats_in_files(monkeypatch):
    """Text, ids and queues in files, at a tenth of the text's size."""
    monkeypatch.setattr(induced_sort, "BLOCK", 256)
    rng = np.random.default_rng(1)
    common = [rng.integers(97, 123, 80).astype(np.uint8) for _ in range(20)]
    segments = [np.concatenate([rng.integers(97, 100, 60).astype(np.uint8), common[rng.integers(20)], rng.integers(97, 100, 30).astype(np.uint8)]) for _ in range(120)]
    did = rng.permutation(len(segments)) // 2
    n = sum(map(len, segments)) + len(segments)
    text, low = (suffix_dedup._numbers(n, kind, n // 10) for kind in (np.uint8, np.int64))
    assert isinstance(text, np.memmap) and isinstance(low, np.memmap)
    at, want, places = 0, {}, []
    for s, d in zip(segments, did.tolist(), strict=True):
        text[at : at + len(s)], text[at + len(s)], low[at : at + len(s) + 1] = s + np.uint8(1), 0, d
        for i in range(len(s) - 49):
            w = s[i : i + 50].tobytes()
            want[w] = min(want.get(w, d), d)
            places.append((at + i, w))
        at += len(s) + 1
    own = np.array(low)
    suffix_dedup.repeats(text, low, 50, n // 10)
    assert [int(low[i]) for i, _ in places] == [want[w] for _, w in places]
    assert any(low[i] < own[i] for i, _ in places)


def removed(units, size, data_):
    """For (id, units): which units are covered by a window that also starts under a smaller id."""
    first = {}
    for r in sorted(data_, key=lambda r: order(r[0])):
        u = units(r[1])
        for i in range(len(u) - size + 1):
            first.setdefault(tuple(u[i : i + size]), order(r[0]))
    for r in data_:
        u, gone = units(r[1]), set()
        for i in range(len(u) - size + 1):
            if first[tuple(u[i : i + size])] < order(r[0]):
                gone.update(range(i, i + size))
        yield r[0], u, gone


def test_op7_removes_repeated_bytes(docs, data):
    got = suffix_dedup.remove_repeats(docs).select(tc.doc_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = []
    for k, u, gone in removed(lambda t: (t or "").encode(), 50, data):
        spans = len(re.findall("1+", "".join("1" if i in gone else "0" for i in range(len(u)))))
        want.append((k, len(u), len(gone), spans, sha(bytes(x for i, x in enumerate(u) if i not in gone))))
    assert counted(got) == counted(want)


def test_op10_removes_repeated_words(docs, data):
    got = substring_dedup.remove_repeats(docs).select(tc.doc_id(), "n_words", "n_removed", "kept_sha256").collect()
    want = [(k, len(u), len(gone), sha(" ".join(x for i, x in enumerate(u) if i not in gone).encode())) for k, u, gone in removed(words, 50, data)]
    assert counted(got) == counted(want)


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + min(3, len(w))]) for i in range(len(w) - min(3, len(w)) + 1)} if w else set()


def test_op6_links_and_components(docs, data):
    got = ngram_join.jaccard_components(docs).select(tc.doc_id(), "n_shingles", F.when(F.col("cid") != tc.NO_ID, F.col("cid"))).collect()
    s = [shingles(r[1]) for r in data]
    label = list(range(len(data)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 90 * len(s[i] | s[j]):
                label[find(i)] = find(j)
    least = {}
    for i, r in enumerate(data):
        least[find(i)] = min(least.get(find(i), (True, 0)), order(r[0]))
    want = [(r[0], len(s[i]), None if least[find(i)][0] else least[find(i)][1]) for i, r in enumerate(data)]
    assert counted(got) == counted(want)


def test_op6_chains_across_buckets(spark):
    """Links that only a chain of near-copies makes, in groups that share most shingles."""
    base = [f"w{i}" for i in range(120)]
    data = []
    for g in range(3):
        t = [f"g{g}{x}" for x in base]
        for i in range(9):
            t = [*t]
            t[10 * i] = f"new{g}_{i}"
            data.append((g * 100 + 50 - i, " ".join(t), *[None] * 6))
    test_op6_links_and_components(frame(spark, data), data)


def test_near_copies_between_the_limits(spark):
    """Five words and 80 %: brute force on pairs that three words and 90 % don't link."""
    import corpus_pipeline

    rng = random.Random(8)
    data = []
    for g, n in enumerate([6, 18, 49, 50, 51, 80, 200]):
        t = [f"g{g}x{i}" for i in range(n)]
        for i in range(6):
            w = [*t]
            for k in rng.sample(range(n), min(n, i)):
                w[k] = f"new{g}_{i}_{k}"
            data.append((g * 100 + i, " ".join(w), *[None] * 6))
    s = [{tuple(x[i : i + 5]) for i in range(max(len(x) - 4, 1))} for x in (words(r[1]) for r in data)]
    linked = lambda least: [(i, j) for i in range(len(s)) for j in range(i) if 100 * len(s[i] & s[j]) >= least * len(s[i] | s[j])]
    assert len(linked(80)) > len(linked(90))
    label = list(range(len(s)))
    for i, j in linked(80):
        label = [label[j] if x == label[i] else x for x in label]
    least = {x: min(r[0] for r, y in zip(data, label, strict=True) if y == x) for x in label}
    got = ngram_join.jaccard_components(frame(spark, data), 5, 80).select("did", "cid").collect()
    assert sorted(map(tuple, got)) == sorted((r[0], least[x]) for r, x in zip(data, label, strict=True))
    kept = corpus_pipeline.near_copies(spark, frame(spark, data), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(least.values()))


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and then some more"), (2, "Short item"), (3, None), (4, "..."), (None, "null id item words"), (2, "Short item"), (11, "The Quick brown fox jumps over the lazy dog AND")]


@pytest.mark.parametrize("block", [4 << 20, 60])
def test_op4_hits(spark, block):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = ["x the QUICK-brown fox jumps over the lazy dog and then y", "short; ITEM short", "nothing", "", None, "null id item words null id item words", "the quick brown fox jumps over the lazy dog", "short item " * 400]
    data = [(i if i else None, t, None, None, None, 0.1, "l", "n") for i, t in enumerate(texts)] + [(3, "nothing", None, None, None, None, None, None)]
    got = decontaminate.decontaminate(frame(spark, data), spark.createDataFrame(ITEMS, "item_id int, text string"), ["doc_id", "label"], block=block)
    want = []
    for r in data:
        w, gone, items = low(r[1]), set(), set()
        for k, t in ITEMS:
            v = low(t)
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[s : s + n]:
                        gone.update(range(i, i + n))
                        items.add("" if k is None else str(k))
        want.append((r[0], r[6], len(w), len(gone), ",".join(sorted(items))))
    assert counted(got.select("doc_id", "label", "n_words", "n_hit", F.array_join("hit_items", ",")).collect()) == counted(want)
    assert all(s.end > s.start for r in got.collect() for s in r.hit_spans)


def test_op4_empty_benchmark(spark, docs):
    got = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id int, text string"), ["doc_id"])
    assert got.where("n_hit > 0").count() == 0 and got.count() == docs.count()


def test_op5_statistics_and_verdicts(spark, docs, data):
    labels = spark.createDataFrame([(r[0], 1) for r in data if r[0] is not None] + [(1004, 0), (None, 0)], "doc_id long, quality int")
    got = quality_rules.quality_rules(docs, labels).collect()
    want = []
    for r in data:
        w, t = words(r[1]), r[1] or ""
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        cover = {j for i, x in enumerate(g) if g.count(x) > 1 for j in range(i, i + 5)} if len(g) < 1000 else None
        lines = [x for x in t.split("\n") if words(x)]
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), cover and len(cover) or 0))
    assert counted((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words if x.n_words < 1000 else 0) for x in got) == counted(want)
    assert all(x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words) and not (x.base_failed and x.kept) for x in got)


def test_op5_forest_isolates_odd_rows():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (400, 2)), [[9, 9]]])
    s = quality_rules.IsolationForest().fit(x).score(x)
    assert s.argmax() == 400
    good = np.bincount(quality_rules.step_of(s[:400]), minlength=quality_rules.STEPS)
    t = quality_rules.calibrate(good, 0.01)
    step = lambda x: (quality_rules.step_of(x) + 0.5) / quality_rules.STEPS
    assert step(s[400:])[0] >= t and (step(s[:400]) >= t).sum() <= 4 and quality_rules.calibrate(good * 0) == 2.0


def test_op5_verdicts_by_brute_force(spark):
    """Kept rows from paths through the trees, walked one row at a time."""
    rng = random.Random(4)
    data = [(i, sentence(rng, 60) if i % 9 else "#$% !! " * 3 + sentence(rng, 30).upper() + " ?!" * 40, *[None] * 6) for i in range(180)]
    docs = tc.stored(frame(spark, data).select("doc_id", "text"))
    labels = spark.createDataFrame([(r[0], int(r[0] % 9 > 0)) for r in data if r[0] % 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    stats = {r.doc_id: r for r in quality_rules.rule_statistics(docs).collect()}
    cols = [f"r_{x}" for x in quality_rules.RATIOS]
    fit = [i for i in got if i % 2 and not got[i].base_failed]
    fit.sort(key=lambda i: (spark.sql(f"select xxhash64({i}L)").first()[0], i))
    x = np.array([[stats[i][c] for c in cols] for i in fit])
    verdict = {i: not got[i].base_failed for i in got}
    for family in quality_rules.FAMILIES:
        at = [quality_rules.RATIOS.index(c) for c in family]
        forest = quality_rules.IsolationForest().fit(x[:, at])

        def score(i, at=at, forest=forest):
            v, total = [stats[i][cols[k]] for k in at], 0.0
            for t in forest.forest:
                k = 0
                while t[k][0] >= 0:
                    k = int(t[k][2] if v[int(t[k][0])] <= t[k][1] else t[k][3])
                total += t[k][4]
            return int(2.0 ** (-total / len(forest.forest) / forest.norm) * quality_rules.STEPS)

        good = sorted(score(i) for i in fit if i % 9)
        spared = next(s for s in range(quality_rules.STEPS) if sum(g > s for g in good) <= quality_rules.REJECT_GOOD / len(quality_rules.FAMILIES) * len(good))
        for i in got:
            verdict[i] = verdict[i] and score(i) <= spared
    assert {i: r.kept for i, r in got.items()} == verdict and not all(verdict[i] for i in got if not got[i].base_failed)


@pytest.mark.parametrize("run", [lambda d, s: ngram_join.jaccard_components(d), lambda d, s: suffix_dedup.remove_repeats(d), lambda d, s: substring_dedup.remove_repeats(d), lambda d, s: quality_rules.quality_rules(d, s.createDataFrame([], "doc_id long, quality int")), lambda d, s: decontaminate.decontaminate(d, s.createDataFrame(ITEMS, "item_id int, text string"))])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA), spark).count() == 0


def test_batches_are_bounded_by_bytes():
    """256 rows of 1 MiB come in slices; row order and slices of slices stay right."""
    b = pa.RecordBatch.from_arrays([pa.array(range(256)), pa.array(["é" * (1 << 19)] * 255 + [None])], ["did", "text"])
    got = list(tc.gathered(iter([b.slice(0, 0), b.slice(250), b, b.slice(3, 2)])))
    assert [x for g in got for x in g.column("did").to_pylist()] == [*range(250, 256), *range(256), 3, 4]
    assert max(g.nbytes for g in got) <= tc.SLICE + (1 << 20) + 4096
    long_ = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["x", "y" * (3 * tc.SLICE), ""])], ["did", "text"])
    assert sum(g.num_rows for g in tc.gathered(iter([long_]))) == 3


def test_long_rows_in_one_partition(spark):
    """Rows of a megabyte each, more of them than a batch may hold."""
    docs = spark.range(0, 8, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(120_000)), lambda i: F.concat(F.lit("w"), (i * (F.col("id") + 7)).cast("string")))).alias("text"))
    assert [r.n_words for r in substring_dedup.remove_repeats(tc.stored(docs)).select("n_words").collect()] == [120_001] * 8


def test_inputs_that_may_change_are_written_first(spark):
    scan = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    at = tc.stored(scan, "scan")
    assert tc.replayable(at.where("doc_id > 1").select("text"))
    assert not tc.replayable(at.repartition(3)) and not tc.replayable(at.where("rand() > 0.5")) and not tc.replayable(at.join(scan, "doc_id"))
    assert tc.fixed(at) is at


def test_a_task_that_fails_midway_is_run_again(spark, tmp_path):
    """Recovery: a batch function fails once in each task; answers are those of a run without failures."""
    docs = tc.stored(frame(spark, rows()).select("doc_id", "text"), "retry")
    want = counted(substring_dedup.remove_repeats(docs).drop("removed").collect())
    marks = str(tmp_path)
    whole = tc.arrow_batches

    def failing(df, fn, schema, *more):
        def once(batches):
            c = TaskContext.get()
            mark = Path(marks) / f"{c.stageId()}-{c.partitionId()}"
            for k, b in enumerate(fn(batches)):
                yield b
                if not k and c.attemptNumber() == 0 and not mark.exists():
                    mark.touch()
                    raise RuntimeError("lost")

        return whole(df, once, schema, *more)

    tc.arrow_batches = failing
    try:
        got = counted(substring_dedup.remove_repeats(docs).drop("removed").collect())
    finally:
        tc.arrow_batches = whole
    assert got == want


def test_op4_cut_items_and_shared_passages(spark):
    """Items cut to pieces lose no window; a passage of many items is one window with all of them."""
    rng = random.Random(2)
    long_ = sentence(rng, 900)
    w = long_.split()
    pieces = decontaminate._cut(long_, 1024, 10)
    assert len(pieces) > 3 and {tuple(x[i : i + 10]) for x in (p.split() for p in pieces) for i in range(len(x) - 9)} == {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    items = [(i, "one passage that all of the many items have in it " + sentence(rng, 3)) for i in range(40)] + [(99, long_)]
    block = decontaminate.Windows([i for i, _ in items[:40]], [t for _, t in items[:40]])
    assert max(map(len, block.items)) == 40 and len(block.start) < 40 * 5
    docs = frame(spark, [(1, "x one passage that all of the many items have in it y", *[None] * 6), (2, " ".join(w[400:420]), *[None] * 6), (3, " ".join(w[400:409]), *[None] * 6)])
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id int, text string"), ["doc_id"], block=16_384).collect()}
    assert (got[1].n_hit, len(got[1].hit_items), got[2].n_hit, got[2].hit_items, got[3].n_hit) == (11, 40, 20, ["99"], 0)


def test_op6_hot_bucket_with_many_components(spark):
    """One shingle that sets share which are otherwise apart, in more members than a part of a bucket holds."""
    data = [(i, f"a b c d{i} e{i} f{i}" if i % 3 else f"a b c d{i}", *[None] * 6) for i in range(60)]
    was, ngram_join.BUCKET = ngram_join.BUCKET, 7
    try:
        test_op6_links_and_components(frame(spark, data), data)
    finally:
        ngram_join.BUCKET = was


def test_stored_restores_the_setting_of_shuffle_files(spark):
    before = spark.conf.get(tc.CLEANUP)
    made = spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count()
    for _ in range(2):  # the same frame may be written again
        assert sorted(r[0] for r in tc.stored(made).collect()) == list(range(7))
    assert spark.conf.get(tc.CLEANUP) == before
