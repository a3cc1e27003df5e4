"""Operator 13: token counts of documents by a cache of content digests.

The cache is a Parquet table (version, digest, n_tokens) in any store that Spark
reads: ``digest`` is the SHA-256 of a document's normalised content, ``version``
that of the tokenizer's file, of its library's release and of the rule of
normalising. Documents are joined to the stored counts; of those without one, each
distinct content is encoded once, whole, and appended. So a second run over the
same documents, or over a corpus that holds them, encodes only what is new.

Contents are the same to the tokenizer where its own normaliser makes them so. If
that lowers case and drops white space, texts of ASCII are lowered, and in all texts line
feeds become spaces and spaces at the ends go, before the digest; except in texts that
hold the string of an added token, which is looked for before normalising. Other
tokenizers get texts as they are.

Inside a worker a text of such a tokenizer is counted chunk by chunk between white
space, which no token crosses, and a bounded table remembers counts of chunks.

Cases: a null text is empty; an empty text has the count that the library gives;
rows that repeat, and null or equal doc_ids, give a row each; extra columns are
ignored; an empty table gives no rows; a cache that isn't there yet is made; digests
that two runs appended at once are read once.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc

LIMIT = 2048
#: Chunks that a Python worker remembers before it starts anew.
CACHE = 1_000_000
CACHED = "version string, digest binary, n_tokens long"


class Counter:
    """Counts of tokens of whole texts by one tokenizer file."""

    def __init__(self, path: str, cache: int = CACHE):
        self.limit, self.known = cache, {}
        if path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.batch = lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.batch = lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
        self.chunked = folds(path)

    def count(self, column: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        if not self.chunked:
            return np.array(self.batch(column.to_pylist()), np.int64)
        data, offs = tc.string_buffers(column)
        start, end, row = tc.word_bounds(data, offs, tc.WHITE)
        size = end - start
        letters = data[~tc.WHITE[data]]
        at = np.append(0, np.cumsum(size)).astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.tobytes()), pa.py_buffer(letters.tobytes())).dictionary_encode()
        each = np.array(self._chunks(chunks.dictionary.to_pylist()), np.int64)
        sums = np.append(0, np.cumsum(each[chunks.indices.to_numpy()])) if len(start) else np.zeros(1, np.int64)
        ends = tc.row_starts(row, len(offs) - 1)
        return np.diff(sums[ends])

    def _chunks(self, chunks: list[str]) -> list[int]:
        if len(self.known) + len(chunks) > self.limit:
            self.known = {}
        new = [c for c in chunks if c not in self.known]
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.known.update(zip(part, self.batch(part), strict=True))
        return [self.known[c] for c in chunks]


_COUNTERS: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    """This worker's counter: what it knows serves later tasks too."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


@lru_cache
def _described(path: str) -> dict:
    return {} if path.endswith(".model") else {k: v for k, v in json.loads(Path(path).read_text()).items() if k in ("added_tokens", "normalizer", "pre_tokenizer")}


def folds(path: str) -> bool:
    """Whether the tokenizer's own normaliser lowers case and its words never hold white space."""
    d = _described(path)
    steps = lambda x: x.get("normalizers", x.get("pretokenizers", [x])) if x else []
    lowers = {s["type"] for s in steps(d.get("normalizer"))}
    cut = steps(d.get("pre_tokenizer"))[:1]
    # fixed values: the word pattern of which this is known
    words = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    tokens = d.get("added_tokens", [])
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens)
    return "Lowercase" in lowers and lowers <= {"NFC", "Replace", "Lowercase"} and plain and bool(cut) and cut[0].get("pattern") == {"Regex": words} and cut[0].get("invert") is True


def contents(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``content``: the text as far as the tokenizer tells it from others."""
    if not folds(path):
        return rows.withColumn("content", F.col("text"))
    ascii_only = F.octet_length("text") == F.length("text")
    # a column that is used more than once is made in a step of its own, so that it is made once
    out = rows.withColumn("_low", F.when(ascii_only, F.lower("text")).otherwise(F.col("text")))
    special = F.lit(False)
    for t in _described(path).get("added_tokens", []):
        special = special | F.contains("_low", F.lit(t["content"].lower()))
    folded = F.trim(F.replace("_low", F.lit("\n"), F.lit(" ")))
    return out.withColumn("content", F.when(special, F.col("text")).otherwise(folded)).drop("_low")


def version(path: str) -> str:
    """Digest of all but the text that a count depends on."""
    import sentencepiece
    import tokenizers

    release = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    return hashlib.sha256(Path(path).read_bytes() + f"|{release}|{'folded' if folds(path) else 'whole'}-2".encode()).hexdigest()


def cached(spark: SparkSession, cache: str, of: str) -> DataFrame | None:
    """(digest, n_tokens) stored for a version, each digest once; None where there is no cache yet."""
    try:
        rows = spark.read.schema(CACHED).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.where(F.col("version") == of).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode(contents: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of (digest, content)."""

    def go(batches):
        counter = _counter(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counter.count(b.column(1)))], ["digest", "n_tokens"])

    return tc.arrow_batches(contents, go, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; counts that ``cache`` lacks are appended to it."""
    spark, of = docs.sparkSession, version(tokenizer)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    keyed = contents(keyed, tokenizer).withColumn("digest", F.unhex(F.sha2("content", 256)))
    missing, stored = keyed.select("digest", "content"), cached(spark, cache, of)
    if stored is not None:
        missing = missing.join(stored, "digest", "left_anti")
    # copies are dropped in each task before the shuffle, so a hot content is a row for each task
    distinct = missing.dropDuplicates(["digest"])
    encode(distinct, tokenizer).select(F.lit(of).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = cached(spark, cache, of)
    rows = tc.salted_join(keyed.select("doc_id", "n_bytes", "digest"), counts, ["digest"], "inner", "doc_id")
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a cache that is new in each run, so that every distinct content is encoded."""
    import public_tokenizers

    return count_tokens(tc.documents(spark, sf_dir), f"{tc.shared_dir(spark)}/token-counts-{uuid.uuid4().hex}", public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLE_SQL: dict[str, str] = {}
