"""Operator 9: scoring with a gated recurrent language model.

``GatedModel`` is a GRU over words with a class-factored softmax: words of a short
list are sorted by frequency into classes of equal weight, a word's probability is
that of its class times that within the class; all other words belong to one of
``RARE`` classes by their last two bytes, which the network reads and predicts as
any other class, and in which a word has its smoothed share of the corpus' counts.
No token is scored by corpus counts alone. It is trained in numpy
by backpropagation truncated to windows, with the state carried on; texts are
scored whole, all of a unit in step, with states carried across windows.

Counts of all words of all training documents are made by a hash exchange, whose
answers are already sums per document; base scores are add-one unigram scores from
them. The short list and the weights of classes are the exact counts of words over
all training documents, and every training document is learned from: the network
starts from about ``SAMPLE`` rows of at most ``ROW_BYTES``, then each shard of the
training rows, dealt by hash, goes on from there in one pass, and the shards'
weights are averaged by their tokens.

Cases: a null or empty text is its end token alone; a null doc_id is neither
learned from nor held out; repeated rows each get a row and count as often;
without training rows the model is the class of other words with no counts; other
columns are ignored; an empty table gives an empty result. Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as ex
from . import textcore as tc
from .classifier import fold as id_fold

SAMPLE = 1200
ROW_BYTES = 64 << 10
SHORT_LIST = 2000
HIDDEN = 16
CLASSES = 40
#: Classes of words outside the short list, by the hash of their last two bytes.
RARE = 40
WINDOW = 24
STREAMS = 64
EPOCHS = 2
RATE = 0.08
UNIT = 8 << 20
#: Streams and tokens of a block of the pass over all training rows.
PASS_STREAMS = 256
BLOCK = 1 << 20
#: Weights of a piece, as shards' weights are added up.
WEIGHTS = 2048
#: Words counted at once in a task.
COUNTED = 4 << 20
#: Sums of logarithms travel as multiples of this.
STEP = 2.0**-24
#: Logits within this need no shift before they are raised to powers of e.
SAFE = 60.0
#: The end token's place in the short list.
END = 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function of ``x``, in its place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _powers(z: np.ndarray, bias: np.ndarray, own: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-softmax of ``z + bias`` at the columns ``own``, e to it (in the place of ``z``, up to a factor a row) and its sums by row.

    bound: no logit is larger in size.
    """
    z += bias
    if not bound < SAFE:
        z -= z.max(1, keepdims=True)
    picked = z[np.arange(len(own)), own]
    np.exp(z, out=z)
    s = z @ np.ones(z.shape[1], z.dtype)
    return picked - np.log(s), z, s


def _errors(e: np.ndarray, s: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Gradients of the loss by the logits, in the place of ``e``."""
    e *= (1 / s)[:, None]
    e[np.arange(len(own)), own] -= 1
    return e


class GatedModel:
    """GRU with a class-factored softmax over a short list and ``rare`` classes of other words (the last ones)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 3, rare: int = 1):
        # words: hashes of the short list, by falling count; ids are END, then these, then the rare classes
        self.hidden, self.rare = hidden, rare
        order = np.argsort(words)
        self.keys, self.ids = words[order], order + 1
        weight = np.sqrt(np.maximum(counts[:-rare], 1))
        cls = np.minimum((np.cumsum(weight) - weight) / weight.sum() * classes, classes - 1).astype(int)
        cls = np.unique(cls, return_inverse=True)[1]
        self.cls = np.append(cls, cls[-1] + 1 + np.arange(rare)).astype(np.uint8 if classes + rare < 256 else np.int64)  # bytes are sorted by radix
        self.low = np.searchsorted(self.cls, np.arange(int(self.cls[-1]) + 2))
        v, c = len(self.cls), int(self.cls[-1]) + 1
        rng = np.random.default_rng(seed)
        f32 = lambda x: x.astype(np.float32)
        self.par = {"x": f32(rng.normal(0, 0.1, (v, 3 * hidden))), "u": f32(rng.normal(0, 0.2, (hidden, 3 * hidden))), "wc": f32(rng.normal(0, 0.1, (hidden, c))), "wo": f32(rng.normal(0, 0.1, (v, hidden)))}
        share = np.bincount(self.cls, weights=counts)
        self.square: dict | None = None
        self.par |= {"bc": f32(np.log((share + 1) / (share + 1).sum())), "bo": f32(np.log(np.maximum(counts, 1)))}

    def encode(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Ids of words by their hashes, or by their tails where they aren't on the short list."""
        other = len(self.cls) - self.rare + tails.astype(np.int64)
        if not len(self.keys):
            return other
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ids[at], other)

    def step(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self._step(h.T, ids).T

    def _step(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """States after ``ids``; a column of ``h`` for each text."""
        n = self.hidden
        x, g = np.ascontiguousarray(self.par["x"][ids].T), self.par["u"].T @ h
        return self._gated(h, x, g, n)[1]

    @staticmethod
    def _gated(h: np.ndarray, x: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Gates and candidate, in the place of ``x``, and the new states."""
        x[: 2 * n] += g[: 2 * n]
        rz = _sigmoid(x[: 2 * n])
        c = x[2 * n :]
        c += rz[:n] * g[2 * n :]
        np.tanh(c, out=c)
        out = h - c
        out *= rz[n:]
        out += c
        return x, out

    def log_probs(self, h: np.ndarray, ids: np.ndarray, grad: dict | None = None) -> np.ndarray:
        """Natural log probabilities of ``ids`` after states ``h``, which are within -1 and 1; with ``grad``, also the loss's gradients."""
        p, cls = self.par, self.cls[ids]
        of_classes = float((np.abs(p["wc"]).sum(0) + np.abs(p["bc"])).max())
        of_words = np.abs(p["wo"]) @ np.ones(self.hidden, np.float32) + np.abs(p["bo"])
        # in order of classes, the rows of a class are a slice
        order = np.argsort(cls, kind="stable")
        cls, h = cls[order], h[order]
        word = ids[order] - self.low[cls]
        cuts = np.searchsorted(cls, np.arange(len(self.low)))
        got, e, s = _powers(h @ p["wc"], p["bc"], cls, of_classes)
        got = got.astype(np.float64)
        if grad is not None:
            d = _errors(e, s, cls)
            grad["wc"] += h.T @ d
            grad["bc"] += np.ones(len(d), d.dtype) @ d
            back = d @ p["wc"].T
        for c in range(len(self.low) - 1):
            rows = slice(cuts[c], cuts[c + 1])
            a, b = self.low[c], self.low[c + 1]
            if cuts[c] == cuts[c + 1] or b - a == 1:
                continue
            hr, wo = h[rows], p["wo"][a:b]
            more, e, s = _powers(hr @ wo.T, p["bo"][a:b], word[rows], float(of_words[a:b].max()))
            got[rows] += more
            if grad is not None:
                d = _errors(e, s, word[rows])
                grad["wo"][a:b] += d.T @ hr
                grad["bo"][a:b] += np.ones(len(d), d.dtype) @ d
                back[rows] += d @ wo
        out = np.empty(len(ids))
        out[order] = got
        if grad is not None:
            grad["h"] = np.empty_like(back)
            grad["h"][order] = back
        return out

    def fit(self, texts: list[np.ndarray], epochs: int = EPOCHS, window: int = WINDOW, streams: int = STREAMS, rate: float = RATE) -> GatedModel:
        """Train on texts of ids, each ending in END, by truncated backpropagation."""
        rng = np.random.default_rng(9)
        for _ in range(epochs):
            ids = np.concatenate([texts[i] for i in rng.permutation(len(texts))])
            whole = len(ids) // streams * streams if len(ids) >= 2 * streams else 0
            for part, k in ((ids[:whole], streams), (ids[whole:], 1)):
                if len(part):
                    self._pass(part, k, window, rate)
        return self

    def _pass(self, ids: np.ndarray, streams: int, window: int, rate: float) -> None:
        n, p = self.hidden, self.par
        if self.square is None:
            self.square = {k: np.full_like(v, 1e-3) for k, v in p.items()}
        square, length = self.square, len(ids) // streams
        if length:
            ids = ids.reshape(streams, length).T
            fresh = np.ones_like(ids, bool)
            fresh[1:] = ids[:-1] == END
            state = np.zeros((streams, n), np.float32)
            for t0 in range(0, length, window):
                grad, state = self.gradients(ids[t0 : t0 + window], fresh[t0 : t0 + window], state)
                for k, d in grad.items():
                    d = np.clip(d / streams, -1, 1)
                    square[k] += d * d
                    p[k] -= rate * d / np.sqrt(square[k])

    def gradients(self, tok: np.ndarray, new: np.ndarray, state: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the loss of a window (time, stream) by backpropagation through it, and the state after it.

        new: where a text begins, and the state with it.
        """
        n, p, streams = self.hidden, self.par, tok.shape[1]
        flat = tok.ravel()
        if len(self.cls) < 1 << 16:
            flat = flat.astype(np.uint16)  # sorted by radix
        # a column for each stream, so that gates are whole rows
        hs = np.empty((len(tok), n, streams), state.dtype)
        gates = np.ascontiguousarray(p["x"][tok].transpose(0, 2, 1))
        old, state = (~new).astype(state.dtype), state.T
        mixed = []
        for t in range(len(tok)):
            h = np.multiply(state, old[t], out=hs[t])
            g = p["u"].T @ h
            state = self._gated(h, gates[t], g, n)[1]
            mixed.append(g[2 * n :])
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        self.log_probs(hs.transpose(0, 2, 1).reshape(-1, n), flat, grad)
        gh = np.ascontiguousarray(grad.pop("h").reshape(len(tok), streams, n).transpose(0, 2, 1))
        back, gx, gu = np.zeros_like(hs[0]), np.empty_like(gates), np.empty_like(gates)
        for t in range(len(tok) - 1, -1, -1):
            h, g, du = hs[t], mixed[t], gu[t]
            r, z, c = gates[t, :n], gates[t, n : 2 * n], gates[t, 2 * n :]
            bz = back * z
            dc = back - bz
            dc *= 1 - c * c
            dr = np.multiply(dc, r, out=du[2 * n :])
            du[:n] = dr * g * (1 - r)
            du[n : 2 * n] = (h - c) * bz * (1 - z)
            gx[t, : 2 * n], gx[t, 2 * n :] = du[: 2 * n], dc
            back = p["u"] @ du
            back += bz
            back += gh[t]
            back *= old[t]
        grad["u"] += np.matmul(hs, gu.transpose(0, 2, 1)).sum(0)
        gx, state = gx.transpose(0, 2, 1), np.ascontiguousarray(state.T)
        order = np.argsort(flat, kind="stable")
        at = flat[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        grad["x"][at[first]] = np.add.reduceat(gx.reshape(-1, 3 * n)[order], first)
        return grad, state

    def score(self, ids: np.ndarray, lengths: np.ndarray, limit: int = 1 << 14) -> np.ndarray:
        """Log10 probability of each text; ``ids`` holds the texts one after the other."""
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
        off = np.append(0, np.cumsum(active))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first = np.cumsum(lengths) - lengths
        time = np.arange(len(ids)) - np.repeat(first, lengths)
        packed = np.empty(len(ids), np.int32)
        packed[off[time] + np.repeat(rank, lengths)] = ids
        del time
        out = np.zeros(len(order))
        state = np.zeros((self.hidden, len(order)), np.float32)
        t = 0
        while t < len(active):
            end = max(t + 1, int(np.searchsorted(off, off[t] + limit, "right")) - 1)
            hs = np.empty((off[end] - off[t], self.hidden), np.float32)
            for k in range(t, end):
                n = active[k]
                state = state[:, :n]
                hs[off[k] - off[t] : off[k + 1] - off[t]] = state.T
                state = self._step(state, packed[off[k] : off[k + 1]])
            got = self.log_probs(hs, packed[off[t] : off[end]])
            who = np.arange(off[t], off[end]) - np.repeat(off[t:end], active[t:end])
            out += np.bincount(who, weights=got, minlength=len(out))
            t = end
        return out[rank] / np.log(10)


def words_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and rare class of each word, A-Z lowered."""
    data, offs = tc.string_buffers(b.column("text"))
    data = tc.lower_ascii(data)
    start, end, row = tc.word_bounds(data, offs, tc.WHITE)
    before = np.where(end - start > 1, data[np.maximum(end - 2, 0)], 0) if len(end) else np.zeros(0, np.uint8)
    last = data[end - 1].astype(tc.U) | before.astype(tc.U) << tc.U(8)
    return tc.span_hashes(data, start, end), row, (tc.mix(last) % tc.U(RARE)).astype(np.uint8)


def word_counts(rows: DataFrame) -> DataFrame:
    """kind, hash, tail, n: how often each word stands in training rows (kind 0), and all words of each tail do (kind 1)."""
    names = ["kind", "hash", "tail", "n"]

    def batch(kind, h, tail, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(tail.astype(np.int32)), pa.array(n.astype(np.int64))], names)

    def count(batches):
        held, size, total = [], 0, np.zeros(RARE, np.int64)

        def out():
            h, tail = (np.concatenate(x) for x in zip(*held, strict=True))
            h, first, n = np.unique(h, return_index=True, return_counts=True)
            return batch(0, h, tail[first], n)

        for b in batches:
            h, _, tail = words_of(b)
            held.append((h, tail))
            size += len(h)
            total += np.bincount(tail, minlength=RARE)
            if size >= COUNTED:
                yield out()
                held, size = [], 0
        if held:
            yield out()
        yield batch(1, np.zeros(RARE, tc.U), np.arange(RARE), total)

    found = tc.arrow_batches(rows.where("train").select("text"), count, "kind int, hash long, tail int, n long")
    return found.groupBy("kind", "hash", "tail").agg(F.sum("n").alias("n"))


def untrained(rows: DataFrame, ends: int) -> GatedModel:
    """A model of the exact counts of all training rows, with their most frequent words as its short list."""
    got = word_counts(rows).orderBy(F.desc("kind"), F.desc("n"), "hash", "tail").limit(SHORT_LIST + RARE).collect()
    rare = np.zeros(RARE, np.int64)
    for r in got:
        rare[r.tail] += r.n if r.kind else -r.n
    top = [r for r in got if not r.kind]
    n = np.array([r.n for r in top], np.int64)
    return GatedModel(np.array([r.hash for r in top], np.int64).view(tc.U), np.concatenate([[ends], n, np.maximum(rare, 1)]), rare=RARE)


def encoded(model: GatedModel, b: pa.RecordBatch) -> list[np.ndarray]:
    """The ids of each text, END last."""
    h, row, tail = words_of(b)
    ids, at = model.encode(h, tail), tc.row_starts(row, b.num_rows)
    return [np.append(ids[i:j], END) for i, j in zip(at[:-1], at[1:], strict=True)]


def train(rows: DataFrame, ends: int, sample: int = SAMPLE) -> GatedModel:
    """A model that has learned from every training row of ``rows``."""
    spark = rows.sparkSession
    model = untrained(rows, ends)
    texts = sample_texts(rows, sample)
    if texts:
        model.fit(encoded(model, pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])))
    if not ends:
        return model
    start = spark.sparkContext.broadcast(model)

    def encode(batches):
        for b in batches:
            ids = [x.astype(np.uint16).tobytes() for x in encoded(start.value, b)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(ids, pa.binary())], ["key", "ids"])

    def learn(batches):
        own, held, size, seen = copy.deepcopy(start.value), [], 0, 0
        for b in batches:
            for x in b.column("ids").to_pylist():
                held.append(np.frombuffer(x, np.uint16).astype(np.int64))
                size += len(held[-1])
                if size >= BLOCK:
                    own.fit(held, epochs=1, streams=PASS_STREAMS)
                    held, seen, size = [], seen + size, 0
        if held:
            own.fit(held, epochs=1, streams=PASS_STREAMS)
            seen += size
        if seen:
            shard = TaskContext.get().partitionId()
            cut = [(k, i, v.ravel()[i : i + WEIGHTS].tobytes()) for k, v in own.par.items() for i in range(0, v.size, WEIGHTS)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in cut], pa.string()), pa.array([x[1] for x in cut], pa.int32()), pa.array([shard] * len(cut), pa.int32()), pa.array([seen] * len(cut), pa.int64()), pa.array([x[2] for x in cut], pa.binary())], ["name", "at", "shard", "n", "v"])

    def add(batches):
        n: dict[tuple[str, int], int] = {}
        v: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for name, at, k, x in zip(*(b.column(c).to_pylist() for c in ("name", "at", "n", "v")), strict=True):
                n[name, at] = n.get((name, at), 0) + k
                v[name, at] = v.get((name, at), 0) + np.frombuffer(x, np.float32).astype(float) * k
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([x.tobytes() for x in v.values()], pa.binary())], ["name", "at", "n", "v"])

    keyed = rows.where("train").select(F.xxhash64("did", "tkey").alias("key"), "text")
    dealt = tc.arrow_batches(keyed, encode, "key long, ids binary").repartition(ex.parts_of(rows, factor=1), "key").sortWithinPartitions("key", "ids")
    learned = tc.arrow_batches(dealt, learn, "name string, at int, shard int, n long, v binary")
    pieces = sum(-(-v.size // WEIGHTS) for v in model.par.values())  # weights of all shards meet a piece at a time
    summed = tc.arrow_batches(learned.repartition(pieces, "name", "at").sortWithinPartitions("name", "at", "shard"), add, "name string, at int, n long, v binary")
    for r in summed.collect():  # of a fixed size
        x = np.frombuffer(r.v) / r.n
        model.par[r.name].ravel()[r["at"] : r["at"] + len(x)] = x
        model.learned = r.n
    model.square = None
    return model


def sample_texts(rows: DataFrame, sample: int = SAMPLE) -> list[str]:
    """About ``sample`` training texts of at most ROW_BYTES, by hash of their ids."""
    n = rows.where("train").count()
    share = int(min(1.0, sample / max(n, 1)) * (1 << 30))
    picked = rows.where("train").where(F.pmod(F.xxhash64("did"), F.lit(1 << 30)) < share).where(F.octet_length("text") <= ROW_BYTES)
    return sorted(r.text for r in picked.select("text").collect())


def score_corpus(docs: DataFrame, train_rows: F.Column, sample: int = SAMPLE) -> DataFrame:
    """did, tkey, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(tc.NO_ID)).alias("did"), F.xxhash64(text).alias("tkey"), text.alias("text"), F.coalesce(train_rows, F.lit(False)).alias("train"))
    ends = rows.where("train").count()
    shared = spark.sparkContext.broadcast(train(rows, ends, sample))

    def entries(b):
        model = shared.value
        h, row, tail = words_of(b)
        n = np.bincount(row, minlength=b.num_rows)
        ids = model.encode(h, tail)
        other = len(model.cls) - RARE
        rare = np.bincount(row[ids >= other] * RARE + tail[ids >= other], minlength=b.num_rows * RARE)
        bounds = np.append(0, np.cumsum(n))
        full = np.insert(ids.astype(np.int32), bounds[1:], END)
        net = model.score(full, n + 1)
        key = tc.mix(h + row.astype(tc.U) * tc.U(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(h) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(h)))
        at = order[first]
        out = {"hash": h[at], "row": row[at], "tf": tf, "other": np.where(ids[at] >= other, tail[at] + 1, 0).astype(np.uint8)}
        return out, {"did": b.column("did").to_numpy(), "tkey": b.column("tkey").to_numpy(), "train": b.column("train").to_numpy(zero_copy_only=False).astype(np.uint8), "n": n + 1, "rare": ex.small(rare), "net": net}

    def fold(table, e):
        table.add(e["hash"], {"c": e["tf"].astype(np.int64) * e["train"], "other": e["other"]})

    def answer(table, e):
        c = table.at(e["hash"])["c"]
        logs, e["other"] = e["tf"] * np.log10(c + 1.0), e["other"] > 0
        m = int(e["row"].max()) + 1
        fixed = lambda w: np.rint(np.bincount(e["row"], w, m) / STEP).astype(np.int64)
        return {"row": np.arange(m), "common_log": fixed(logs * (1 - e["other"].astype(float))), "rare_log": fixed(logs * e["other"]), "known": np.bincount(e["row"], e["tf"] * (c > 0), m).astype(np.int64)}

    def total(table):
        c, o = table.cols["c"], table.cols["other"]
        return {"n": np.bincount(o, c, RARE + 1).astype(np.int64), "v": np.bincount(o, c > 0, RARE + 1).astype(np.int64)}

    dealt = ex.deal(rows, entries, ex.parts_of(rows, factor=1), carry=("train",), unit_bytes=UNIT)
    settled = tc.stored(ex.settle(dealt, fold, {"c": np.add, "other": np.maximum}, answer, total), "counts")
    tc.release(spark)
    sums = {k: np.zeros(RARE + 1, np.int64) for k in "nv"}
    for r in settled.where("kind = 2").select("payload").collect():  # RARE + 1 pairs of numbers for each part
        for k, x in ex.unpack(r.payload).items():
            sums[k] += x
    n_all, v_all = int(sums["n"].sum()) + ends, int(sums["v"].sum()) + (ends > 0)
    shares = np.log10(sums["n"][1:] + sums["v"][1:] + 1.0)

    def make(d, answers):
        m = len(d["did"])
        log, rare_log, known = np.zeros(m), np.zeros(m), np.zeros(m)
        for a in answers:
            log += np.bincount(a["row"], a["common_log"] * STEP, m)
            rare_log += np.bincount(a["row"], a["rare_log"] * STEP, m)
            known += np.bincount(a["row"], a["known"].astype(float), m)
        n = d["n"].astype(np.int64)
        base = log + rare_log + np.log10(ends + 1.0) - n * np.log10(n_all + v_all + 1.0)
        score = d["net"] + rare_log - d["rare"].reshape(m, RARE) @ shares
        cols = {"did": d["did"], "tkey": d["tkey"], "n_tokens": n, "n_known": known.astype(np.int64) + (ends > 0), "train_tokens": np.full(m, n_all), "base_score": base, "score": score}
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols.values()], list(cols))

    return ex.assemble(settled.where("kind < 2"), make, "did long, tkey long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_corpus(tc.documents(spark, sf_dir), id_fold("doc_id", 7) != 2).withColumn("doc_id", tc.doc_id())
    return out.select("doc_id", F.coalesce(id_fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_lm_scoring": op9_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
