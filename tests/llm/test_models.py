"""Operators that learn or write: held-out accuracy, exact round trips, brute force for counts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from helpers import SCHEMA, counted, frame, order, rows, sentence, words
from pyspark.sql import functions as F

from facetmill.llm import classifier, langid, language_model, membership, mixing, token_output
from facetmill.llm import textcore as tc

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
LANGS = {"en": ["the", "thing", "which", "order", "water", "she"], "de": ["schön", "und", "nicht", "straße", "auch", "über"], "fr": ["être", "où", "quelle", "garçon", "avec", "août"]}


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return frame(spark, data).cache()


def test_op1_held_out_accuracy_and_cases(spark):
    rng = random.Random(2)
    made = [(i, sentence(rng, rng.choice([5, 30, 200]), LANGS[k]), k, None, None, None, None, None) for i, k in enumerate(list(LANGS) * 60)]
    odd = [(900, None, "en", None, None, None, None, None), (901, "12 34 !!", "en", None, None, None, None, None), (902, "", None, None, None, None, None, None), (None, "the water order", None, None, None, None, None, None), (903, "the thing " * 300_000, None, None, None, None, None, None)]
    df = frame(spark, made + odd)
    model = langid.train(df.where(langid.fold("doc_id", 3) != 1).select("text", "lang", F.col("doc_id").alias("key")))
    got = {r.doc_id: r for r in langid.identify(df, model, ["doc_id"]).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k, *_ in made if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (900, 901, 902)) and got[None].lang_pred == got[903].lang_pred == "en"
    assert not any(got[i].rejected for i, *_ in made)
    wide = langid.identify(df, model)
    assert wide.columns[:5] == df.columns[:5] and wide.columns.count("score") == 1
    assert langid.train(df.where("false").select("text", "lang", F.col("doc_id").alias("key"))) is None
    assert {r.lang_pred for r in langid.identify(df, None, ["doc_id"]).collect()} == {"und"}


def slow_counts(text):
    """N-gram buckets of a text by plain loops."""
    data = b" " + re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", text.lower().encode()) + b" "
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            x = n
            for c in data[i : i + n]:
                x = (x + c) * 0x9E3779B1 % (1 << 32)
                x ^= x >> 15
            out[(x >> 7) % langid.BUCKETS] += 1
    return out


def test_op1_by_brute_force(spark):
    """Every prediction and cosine from the model's own centroids, by plain loops; counts over cuts are those of the whole."""
    rng = random.Random(6)
    made = [(i, sentence(rng, rng.choice([1, 4, 25]), LANGS[k]), k, None, None, None, None, None) for i, k in enumerate(list(LANGS) * 12)]
    df = frame(spark, made + [made[0], (500, "12", "en", None, None, None, None, None)])
    model = langid.train(df.select("text", "lang", F.col("doc_id").alias("key")))
    whole = {}
    for r in df.collect():
        c = slow_counts(r.text)
        v = {b: math.log1p(n) * float(model.idf[b]) for b, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(model.matrix[b, j]) for b, x in v.items()) / size for j in range(model.matrix.shape[1])]
        whole[r.doc_id] = (model.names[model.owner[int(np.argmax(cos))]], max(cos)) if any(ch.isalpha() for ch in r.text) else ("und", 0.0)
    got = langid.identify(df, model, ["doc_id"]).collect()
    assert len(got) == len(made) + 2 and all(r.lang_pred == whole[r.doc_id][0] and r.score == pytest.approx(whole[r.doc_id][1], abs=1e-4) for r in got)
    text = "Ünder " * 30 + "x" * 50
    try:
        langid.PIECE = 7
        assert {b: n for b, n in enumerate(langid.counts(text)) if n} == slow_counts(text)
    finally:
        langid.PIECE = 1 << 20


def test_op1_learns_every_language_and_rejects_unlearned_ones(spark):
    rng = random.Random(7)
    letters = lambda k: [chr(0x400 + 7 * k + rng.randrange(7)) * 2 + chr(0x400 + 7 * k + rng.randrange(7)) for _ in range(6)]
    made = [(k * 4 + i, sentence(rng, 20, letters(k)), f"l{k:03d}", None, None, None, None, None) for k in range(210) for i in range(3)]
    df = frame(spark, made)
    model = langid.train(df.select("text", "lang", F.col("doc_id").alias("key")))
    assert len(model.names) == 210
    other = frame(spark, [(1, " ".join("ابتثجحخ"[i % 7] * 3 for i in range(90)), None, *[None] * 5)])
    assert langid.identify(other, model, ["doc_id"]).first().rejected


def test_op1_thresholds():
    seen = np.zeros((8, langid.STEPS), np.int64)
    assert not langid.thresholds(seen).any()
    seen[3, 2048] = 5
    seen[6, 1024:] = 10
    t = langid.thresholds(seen) / langid.SHARE
    assert t[6] == t[7] == t[0] and t[6] == pytest.approx(0.2515, abs=1e-3) and (np.diff(t) >= 0).all()


def test_op2_targets_and_samples(spark, docs, data):
    quality = spark.createDataFrame([(0, 1), (3, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    got = mixing.mix(docs, quality).collect()
    again = mixing.mix(docs.repartition(5), quality).collect()
    assert counted((r.doc_id, r.size, r.source, r.taken) for r in got) == counted((r.doc_id, r.size, r.source, r.taken) for r in again)
    assert counted((r.doc_id, r.size) for r in got) == counted((r[0], len(words(r[1]))) for r in data)
    size = defaultdict(int)
    for r in data:
        size[r[3]] += len(words(r[1]))
    names = sorted(size, key=lambda x: (x is None, (x or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * size[s]}
        target |= {s: 2 * size[s] for s in full} or share
        left -= sum(2 * size[s] for s in full)
        open_ = open_ - full if full else set()
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(r.size for r in got if r.source == s) / 2 + 1


def test_op2_buckets_don_t_change_the_sample(docs):
    few, many = (counted((r.doc_id, r.taken) for r in mixing.mix(docs, buckets=b).collect()) for b in (1, 4096))
    assert few == many


def test_op3_round_trip(spark, docs, data, tmp_path):
    from tokenizers import Tokenizer

    shards = token_output.write_tokens(docs, f"file://{tmp_path}", VOCAB, shards=3, frame=2048)
    got = token_output.read_tokens(spark, shards).orderBy("start").collect()
    tok = Tokenizer.from_file(VOCAB)
    want = counted((r[0], *tok.encode(r[1] or "", add_special_tokens=False).ids, 2) for r in data)
    assert counted((r.doc_id, *r.ids) for r in got) == want
    assert [order(r.doc_id) for r in got] == sorted(order(r[0]) for r in data)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    digests = {r.start: r.ids_crc32 for r in token_output.read_tokens(spark, shards, digest=True).collect()}
    assert all(digests[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


def test_op3_random_access_and_damage(tmp_path):
    path = tmp_path / "x.tokz"
    with pafs.LocalFileSystem().open_output_stream(str(path)) as f:
        w = token_output.ShardWriter(f, 2, frame=40)
        for i in range(50):
            w.add(i if i != 7 else None, np.arange(i, dtype="<u2").tobytes())
        w.close()
    with pafs.LocalFileSystem().open_input_file(str(path)) as f:
        r = token_output.ShardReader(f)
        frames = []
        r.frame_bytes = lambda k, read=r.frame_bytes: frames.append(k) or read(k)
        assert [(i, len(x)) for i, x in r.documents(np.array([3, 30]))] == [(3, 3), (30, 30)] and len(frames) == 2 < len(r.table)
        assert r.null.tolist().index(1) == 7
    raw = bytearray(path.read_bytes())
    raw[r.offset[5] + 12] ^= 255
    path.write_bytes(raw)
    with pafs.LocalFileSystem().open_input_file(str(path)) as f, pytest.raises(Exception):
        list(token_output.ShardReader(f).documents())


def test_op3_pieces_of_odd_texts():
    from tokenizers import Tokenizer

    texts = ["", " ", "  ", "a  b", "a \n b", " a", "a ", "\n", "it's 5'll  x", "<|endoftext|> a b", "x \x1c y", "\x1c a b", "a　 b", "a 　b", "à b é c", "a  b", "  a b c"]
    data, offs = tc.string_buffers(pa.array(texts))
    tok = Tokenizer.from_file(VOCAB)
    got = token_output.PieceEncoder(VOCAB, 2).encode(data, offs)
    assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_op8_held_out_accuracy_and_cases(spark):
    rng = random.Random(4)
    made = [(i, sentence(rng, 40) if i % 3 else " ".join(x + rng.choice("#$%") for x in sentence(rng, 40).split()), i % 3 > 0) for i in range(240)]
    df = frame(spark, [(i, t, *[None] * 6) for i, t, _ in made] + [(900, None, *[None] * 6), (901, "", *[None] * 6), (None, "x", *[None] * 6)])
    labelled = spark.createDataFrame([(t, int(y), i) for i, t, y in made if zlib.crc32(str(i).encode()) % 4 != 2], "text string, label long, key long")
    got = {r.doc_id: r for r in classifier.classify(df, labelled).collect()}
    assert np.mean([(got[i].predicted == 1) == y for i, _, y in made if zlib.crc32(str(i).encode()) % 4 == 2]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values()) and got[900].score == got[901].score
    none = classifier.classify(df, labelled.where("false"))
    assert {r.score for r in none.collect()} == {0.5}


def slow_features(text):
    """Buckets of a text's features by plain loops."""
    data = (text or "").encode()
    out, last = Counter(), None
    for w in re.findall(rb"[^\x20\x09-\x0D]+", data):
        h = sum(int(tc.TABLE[c]) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(w)) % (1 << 64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> shift)) * by % (1 << 64)
        h ^= h >> 31
        out[h % classifier.BUCKETS] += 1
        out[classifier.REPEAT] += 4 * (h == last)
        last = h
    code = [32 if c in b" \t\n\r\x0b\x0c" else c for c in data]
    for n in classifier.NGRAMS:
        for i in range(len(code) - n + 1):
            x = n
            for c in code[i : i + n]:
                x = (x * 0x01000193 + c * 0x9E3779B1) % (1 << 32)
            x ^= x >> 15
            x = x * 0x2C1B3C6D % (1 << 32)
            x ^= x >> 13
            out[x % classifier.BUCKETS] += 1
    return +out


def test_op8_scores_by_brute_force():
    rng = random.Random(1)
    texts = [sentence(rng, n) for n in (1, 7, 30)] + ["", "éü ü ü\n\n x", "same same same"]
    table, bias = np.random.default_rng(2).normal(size=classifier.BUCKETS).astype(np.float32), 0.3
    data, offs = tc.string_buffers(pa.array(texts))
    got = classifier.score_slice(data, offs, table, bias)
    for t, s in zip(texts, got, strict=True):
        f = slow_features(t)
        z = sum(float(table[b]) * n for b, n in f.items()) / max(sum(f.values()), 1) + bias
        assert s == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
        d, o = tc.string_buffers(pa.array([t]))
        at, n = classifier.counted(d, o)
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == f


def test_op8_long_and_repeated_labelled_rows(spark):
    """A labelled row of a megabyte is learned from as any other; repeats count."""
    rng = random.Random(3)
    good, bad = sentence(rng, 180_000), "### $$$ " * 150_000
    assert len(good) > 1 << 20 < len(bad)
    labelled = spark.createDataFrame([(good, 1, 1), (bad, 0, 2), (bad, 0, 2), (None, 1, 3)], "text string, label long, key long")
    docs = frame(spark, [(1, sentence(rng, 30), *[None] * 6), (2, "$$$ ###", *[None] * 6)])
    got = {r.doc_id: r.score for r in classifier.classify(docs, labelled).collect()}
    assert got[1] > got[2]


def test_op9_base_scores_are_exact_and_the_model_is_a_distribution(docs, data):
    got = language_model.score_corpus(docs, classifier.fold("doc_id", 7) != 2).withColumn("doc_id", tc.doc_id()).collect()
    tok = lambda t: [*words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = Counter()
    for r in data:
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2:
            c.update(tok(r[1]))
    n, v = sum(c.values()), len(c)
    want = counted((r[0], len(tok(r[1])), sum(c[x] > 0 for x in tok(r[1])), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tok(r[1])), 3)) for r in data)
    assert counted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_op9_gradients_and_lockstep():
    m = language_model.GatedModel(np.arange(20, dtype=np.uint64) * np.uint64(7), np.concatenate([[5], np.arange(20, 0, -1), [30]]), hidden=5, classes=4)
    rng = np.random.default_rng(1)
    h, ids = rng.normal(size=(40, 5)), rng.integers(0, 22, 40)
    assert np.allclose(sum(np.exp(m.log_probs(h, np.full(40, j))) for j in range(22)), 1, atol=1e-5)
    m.par = {k: v.astype(float) for k, v in m.par.items()}
    g = {k: np.zeros_like(v) for k, v in m.par.items()}
    m.log_probs(h, ids, g)
    for k in ("wc", "bc", "wo", "bo"):
        i = tuple(rng.integers(0, x) for x in m.par[k].shape)
        loss = []
        for e in (1e-5, -2e-5):
            m.par[k][i] += e
            loss.append(-m.log_probs(h, ids).sum())
        m.par[k][i] += 1e-5
        assert g[k][i] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=1e-4)
    # the whole network: finite differences of a window's loss through the recurrent state
    tok, new = rng.integers(0, 22, (6, 3)), np.zeros((6, 3), bool)
    tok[2, 1], new[3, 1], new[0] = 0, True, [True, False, True]
    state = rng.normal(size=(3, 5)) * 0.3

    def loss():
        h, out = state, 0.0
        for t in range(6):
            h = np.where(new[t][:, None], 0.0, h)
            out -= m.log_probs(h, tok[t]).sum()
            h = m.step(h, tok[t])
        return out

    grad, after = m.gradients(tok, new, state)
    for k in m.par:
        for _ in range(6):
            i = (int(rng.choice(tok.ravel())), int(rng.integers(15))) if k == "x" else tuple(rng.integers(0, x) for x in m.par[k].shape)
            m.par[k][i] += 1e-5
            up = loss()
            m.par[k][i] -= 2e-5
            down = loss()
            m.par[k][i] += 1e-5
            assert grad[k][i] == pytest.approx((up - down) / 2e-5, abs=1e-4), k
    lengths = np.array([3, 1, 7, 4])
    all_ = rng.integers(0, 22, lengths.sum())
    whole = m.score(all_, lengths, limit=5)
    alone = [m.score(x, np.array([len(x)]))[0] for x in np.split(all_, np.cumsum(lengths)[:-1])]
    assert np.allclose(whole, alone, atol=1e-5)
    # logits beyond what powers of e can hold are shifted first
    for k in ("bc", "bo"):
        m.par[k] = m.par[k] + 900
    assert m.log_probs(h, ids)[0] < 0 and np.allclose(m.score(all_, lengths), whole, atol=1e-3)


def test_op9_training_helps():
    rng = np.random.default_rng(0)
    texts = [np.append(np.resize([1 + k, 2 + k], 30), 0) for k in rng.integers(0, 2, 60) * 4]
    m = language_model.GatedModel(np.arange(8, dtype=np.uint64), np.concatenate([[60], np.full(8, 200), [1]]), hidden=8, classes=3)
    before = m.score(np.concatenate(texts), np.array([len(t) for t in texts])).sum()
    m.fit(texts, epochs=10, streams=8)
    assert m.score(np.concatenate(texts), np.array([len(t) for t in texts])).sum() > 0.6 * before


def test_op9_is_a_distribution_over_all_words(spark):
    """Probabilities of different whole texts, with words on the short list, in rare classes and unknown ones, add up to less than 1."""
    was, language_model.SHORT_LIST = language_model.SHORT_LIST, 6
    try:
        vocab = [a + b for a in "abcdefg" for b in "hijklm"]
        rng = random.Random(5)
        texts = [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(60)]
        # an unknown word of each class, found by trying
        unknown = {}
        for i in range(5000):
            w = f"x{i}"
            tail = int(language_model.words_of(pa.RecordBatch.from_arrays([pa.array([w])], ["text"]))[2][0])
            unknown.setdefault(tail, w)
        asked = ["", *vocab, *unknown.values()]
        docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)] + [(1000 + i, w, False) for i, w in enumerate(asked)], "doc_id long, text string, t boolean")
        got = {r.did: r.score for r in language_model.score_corpus(docs, F.col("t")).collect()}
        tokens = Counter(w for t in texts for w in t.split())
        assert len(tokens) == len(vocab) and all(math.isfinite(x) and x < 0 for x in got.values())
        assert sum(10 ** got[1000 + i] for i in range(len(asked))) < 1
    finally:
        language_model.SHORT_LIST = was


def test_op9_learns_from_every_training_row(spark):
    """Short list and weights don't hang on the sample, and long rows are learned from too."""
    texts = ["red stone " * 20] * 150 + ["blue river " * 20] * 150 + ["moon lamp " * 10_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = language_model.score_corpus(docs, F.lit(True), sample=0).where("did < 300").collect()
    assert len(got) == 300 and sum(r.score for r in got) > 0.7 * sum(r.base_score for r in got)
    rows = docs.select(F.col("doc_id").alias("did"), F.xxhash64("text").alias("tkey"), "text", F.lit(True).alias("train"))
    tokens = sum(len(words(t)) + 1 for t in texts)
    model = language_model.train(rows, len(texts), sample=0)
    assert model.learned == tokens and len(model.keys) == 6
    again = language_model.train(rows.repartition(5), len(texts), sample=0)
    assert all(np.array_equal(model.par[k], again.par[k]) for k in model.par)


def test_bitmaps_never_lose_a_key(spark):
    keys = spark.range(0, 1000).select((F.col("id") * 1_000_003 - 77).alias("k"))
    bits = membership.bitmap(keys)
    assert membership.maybe(bits, np.arange(1000) * 1_000_003 - 77).all() and membership.maybe(bits, np.arange(1000) * 999_983 + 5).mean() < 0.01


@pytest.mark.parametrize("run", [lambda d: mixing.mix(d), lambda d: token_output.encode_corpus(d), lambda d: langid.identify(d, None), lambda d: language_model.score_corpus(d, F.lit(True)), lambda d: classifier.classify(d, d.select("text", F.lit(1).cast("long").alias("label"), F.col("doc_id").alias("key")))])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
