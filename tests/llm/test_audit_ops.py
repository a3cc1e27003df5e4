"""Alignment of tokenizers, source divergence and token counts against plain forms."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import helpers as h
import pyarrow as pa
import pytest
from pyspark import TaskContext

public_tokenizers = pytest.importorskip("public_tokenizers")

from facetmill.llm import alignment, divergence, token_counts  # noqa: E402
from facetmill.llm import textcore as tc  # noqa: E402

A, B, W = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = [
    "a▁b", " lead", "trail ", "two  spaces\n\nand  lines \t x", "<|endoftext|> and </s> <0x41> <s>", "<|ENDOFTEXT|>x <|startoftext|>", "　wide   no break x \u0085 \x1c \x1f y", "é ́x ΣΣ σΣ. İI",
    "\U0001f600\U0001f600 中文字 \x00 z", "it's we'll 12345 x_y a.b.c http://www.x.org/?q=1", "=" * 300, "a" * 5000, "�​ ​x", "x  y", "A  B", "STRASSE ẞ Å K",
]


def table(spark):
    rng = random.Random(5)
    chars = "ab  cd\n.,'é中 　\U0001f600 X1"
    odd = ODD + ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    data = h.rows(seed=7) + [(5000 + i, t, "en", "odd", 1, None, None, None) for i, t in enumerate(odd)]
    return data, h.frame(spark, data)


def groups_by_bytes(t, text):
    """Tokens of both with their ends, or None where they don't give back the bytes."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    if b"".join(t.bytes_a[i] for i in a) != raw or b"".join(t.bytes_b[i] for i in b) != raw:
        return None
    out = []
    for ids, size in ((a, t.bytes_a), (b, t.bytes_b)):
        at, rows = 0, []
        for i in ids:
            rows.append((at, at + len(size[i]), i))
            at += len(size[i])
        out.append(rows)
    return out


def plain_alignment(data):
    t = alignment.Tokenizers(A, B)
    per, total = [], Counter()
    for r in data:
        got = groups_by_bytes(t, r[1])
        if got is None:
            per.append((r[0], None))
            continue
        a, b = got
        links = []
        for s, e, i in a:
            for s2, e2, j in b:
                if s2 >= e:
                    break
                if e2 > s:
                    links.append((i, j))
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        text, x, y = [], 0, 0
        for c in cuts:
            m, n = x, y
            while x < len(a) and a[x][1] <= c:
                x += 1
            while y < len(b) and b[y][1] <= c:
                y += 1
            text.append(",".join(str(v[2]) for v in a[m:x]) + "|" + ",".join(str(v[2]) for v in b[n:y]))
        total.update(links)
        per.append((r[0], (len(a), len(b), len(cuts), links, hashlib.sha256(";".join(text).encode()).hexdigest())))
    best = defaultdict(int)
    for (_, j), n in total.items():
        best[j] = max(best[j], n)
    out = []
    for k, p in per:
        if p is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
        else:
            counts = [total[x] for x in p[3]]
            out.append((k, *p[:3], len(counts), sum(total[x] == best[x[1]] for x in p[3]), sum(counts), p[4]))
    return Counter(out)


@pytest.mark.parametrize("unit", [alignment.UNIT, 500])
def test_alignment_against_tokens_of_whole_texts(spark, unit):
    data, docs = table(spark)
    data = [r if not r[1] or len(r[1]) < 20_000 else (*r[:1], r[1][:20_000], *r[2:]) for r in data]
    docs = h.frame(spark, data)
    got = h.counted(alignment.align(docs, A, B, unit).collect())
    assert got == plain_alignment(data)
    assert sum(not r[7] for r in got) >= 3 and sum(r[4] > r[3] for r in got) > 20


def test_alignment_of_nothing(spark):
    assert alignment.align(h.frame(spark, []), A, B).collect() == []


def test_long_group_makes_a_row_for_each_end(spark):
    """Tokens of a group that never meet are linked by ends, not by pairs."""
    n = 20_000
    units = spark.createDataFrame([(1, 2, [5] * n, [4] * n, [7] * (n + 1), [2] + [4] * (n - 1) + [2])], "sid long, n long, a array<int>, size_a array<int>, b array<int>, size_b array<int>")
    links = alignment.linked(alignment.tokens(units, "a", "size_a"), alignment.tokens(units, "b", "size_b"))
    assert links.count() == 2 * n and links.select("group").distinct().count() == 1
    assert alignment.pair_counts(links).collect()[0][:3] == (5, 7, 4 * n)


def plain_audit(data, min_docs, prior, top):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    docs = [(r[2] or "", r[3] or "", word.findall((r[1] or "").translate(lower))) for r in data]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = {w for w, n in df.items() if n >= min_docs}
        v = len(kept)
        counts = {s: Counter(w for d in mine if d[1] == s for w in d[2] if w in kept) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + prior) // (sum(c.values()) + prior * v)
        for s, c in counts.items():
            pair = [(u, sum(abs(p(c, w) - p(counts[u], w)) for w in kept)) for u in counts if u != s]
            term = [(w, p(c, w) - p(whole, w)) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, rows, most in (("pair", pair, None), ("term", term, top)):
                rows.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(rows[:most])]
    return Counter(out)


@pytest.mark.parametrize(("least", "top"), [(1, 5), (4, 50), (1000, 50)])
def test_divergence_against_dense_tables(spark, least, top):
    data, docs = table(spark)
    got = h.counted(divergence.audit(docs, least, 5, top).collect())
    assert got == plain_audit(data, least, 5, top)


def test_divergence_of_nothing(spark):
    assert divergence.audit(h.frame(spark, [])).collect() == []


def test_share_is_exact_for_large_counts(spark):
    rng = random.Random(3)
    rows = [(n, n + rng.randrange(10**15)) for n in (rng.randrange(1, 10 ** rng.randrange(1, 16)) for _ in range(200))]
    got = spark.createDataFrame(rows, "n long, t long").select("n", "t", divergence.share(*(divergence.F.col(c) for c in "nt")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * r.n // r.t for r in got)


@pytest.mark.parametrize("path", [W, A, B])
def test_counts_are_the_librarys(spark, tmp_path, path):
    data, docs = table(spark)
    cache = f"file://{tmp_path}/cache"
    if path == B:
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lambda t: len(s.encode(t))
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    want = Counter((r[0], len((r[1] or "").encode()), k := n(r[1] or ""), k > 100) for r in data)
    assert h.counted(token_counts.count_tokens(docs, cache, path, 100).collect()) == want


def test_only_what_the_cache_lacks_is_encoded(spark, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/cache"
    sent = []
    encode = token_counts.encode
    monkeypatch.setattr(token_counts, "encode", lambda df, t: (sent.append(sorted(r.content for r in df.collect())), encode(df, t))[1])
    first = h.frame(spark, [(i, t, *[None] * 6) for i, t in enumerate(["One\ntwo", "one TWO ", None, "", "three", "three"])])
    token_counts.count_tokens(first, cache, W).collect()
    assert sent.pop() == ["", "one two", "three"]
    more = first.union(h.frame(spark, [(9, "four", *[None] * 6)]))
    got = token_counts.count_tokens(more, cache, W)
    assert sent.pop() == ["four"] and got.count() == 7
    token_counts.count_tokens(more, cache, W)
    assert sent.pop() == []
    token_counts.count_tokens(first, cache, A)  # another tokenizer has counts of its own, and tells case
    assert sent.pop() == ["", "One\ntwo", "one TWO ", "three"]
    # the rows that two runs append are read once
    spark.read.parquet(cache).write.mode("append").parquet(f"{cache}-2")
    spark.read.parquet(cache).write.mode("append").parquet(f"{cache}-2")
    assert token_counts.count_tokens(more, f"{cache}-2", W).count() == 7


def test_counts_of_nothing(spark, tmp_path):
    assert token_counts.count_tokens(h.frame(spark, []), f"file://{tmp_path}/none", W).collect() == []


def test_tasks_that_fail_midway_are_run_again(spark, tmp_path):
    """Recovery: each batch function fails once in each task after its first batch; answers are those of a run without failures."""
    docs = tc.stored(table(spark)[1].select("doc_id", "text", "lang", "source").where("length(text) < 20000"), "retry")
    runs = {
        "align": lambda k: alignment.align(docs, A, B, 2000), "audit": lambda k: divergence.audit(docs, 2), "count": lambda k: token_counts.count_tokens(docs, f"file://{tmp_path}/cache-{k}", W),
    }
    want = {k: h.counted(f("whole").collect()) for k, f in runs.items()}
    marks, whole = str(tmp_path), tc.arrow_batches

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
        got = {k: h.counted(f("again").collect()) for k, f in runs.items()}
    finally:
        tc.arrow_batches = whole
    assert got == want and len(list(tmp_path.glob("*-*"))) > 6


def test_a_hot_source_and_copies_change_nothing_but_counts(spark):
    """Half of the rows are one text of one source: tokens align alike, the pair counts grow by as many links."""
    text, n = "The river, the stone: zwölf Lampen.", 400
    one = alignment.align(h.frame(spark, [(0, text, *[None] * 6)]), A, B).collect()[0]
    many = alignment.align(h.frame(spark, [(i, text, *[None] * 6) for i in range(n)]), A, B).collect()
    assert len(many) == n and {tuple(r)[1:6] for r in many} == {tuple(one)[1:6]} and {r.count_sum for r in many} == {n * one.count_sum}
    counts = token_counts.Counter(W)
    assert set(counts.count(pa.array([text] * n)).tolist()) == set(counts.count(pa.array([text])).tolist())
