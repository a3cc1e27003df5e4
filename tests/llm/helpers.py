"""Rows that hold the awkward cases, and plain forms of the contracts."""

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n, words=("red", "blue", "stone", "river", "Cloud", "tree", "wind", "éü", "x1", "lamp", "glass", "moon")):
    return " ".join(rng.choice(words) + rng.choice(["", "a", "o", "er", "ing"]) for _ in range(n))


def rows(seed=1, n=24):
    """Random texts with copies, near-copies, shared passages, nulls, ties, repeats, a long text and clashing columns."""
    rng = random.Random(seed)
    passage, base = sentence(rng, 70), sentence(rng, 90)
    out = []
    for i in range(n):
        t = sentence(rng, rng.choice([1, 3, 12, 60, 120]))
        if i % 4 == 0:
            t = f"{t} {passage}  {sentence(rng, 5)}\n{t}"
        if i % 5 == 0:
            w = base.split(" ")
            w[rng.randrange(len(w))] = f"changed{i}"
            t = " ".join(w) if i % 10 else base
        out.append((i * 3, t, ["en", "de", None][i % 3], [None, "a", "b"][i % 3], len(t), 0.5, "x", "y"))
    out += [(1000, None, None, None, None, None, None, None), (1001, "", "en", "a", 0, None, None, None), (1002, " \t\n ", "en", "a", 4, None, None, None), (1003, "word", "en", "b", 4, None, None, None), (1004, "### $$$ 12 !!", "en", "b", 13, None, None, None)]
    out += [(None, out[1][1], "en", None, 1, None, None, None), (None, passage, None, "c", 1, None, None, None), out[3], out[3], (1005, out[4][1], "de", "c", 1, None, None, None)]
    out += [(1006, "long " + sentence(rng, 9000) + " " + passage, "en", "c", 1, None, None, None), (1007, "a" * 3000, "en", "c", 3000, None, None, None), (1008, "a" * 3000, "en", "c", 3000, None, None, None)]
    return out


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def words(text):
    return WORD.findall(text or "")


def counted(rows_):
    return Counter(map(tuple, rows_))
