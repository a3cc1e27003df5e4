"""Operator 11: alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut the bytes of space+text. Where a token of each ends, the text is
cut into groups; two tokens are linked if their ranges overlap; an id pair counts
as many links as hold it in the whole corpus.

Neither tokenizer has a token across the place before a single space between two
characters that aren't white space (``Tokenizers`` checks that on the vocabularies),
so a text is a row of *segments* that are aligned apart. The corpus is first put in
terms of its distinct segments, then aligned by joins, windows and grouping:

1. ``dictionaries``: units of texts as codes of their distinct segments, in Arrow.
2. ``encoded``: each distinct segment of the corpus is encoded once by both.
3. ``tokens``: tokens are exploded by position, and a window adds up their lengths.
4. ``linked``: both sides meet on (segment, end). Each end is one link: of the tokens
   with the next end on either side, which are the two that cover the bytes before
   it. So the range join of links is a look at the next row that has an id, and
   tokens that don't overlap never form a pair, however long a group is. A running
   count of the ends that both share numbers the groups.
5. ``scored``: links, times the number of their segment's occurrences, are counted by
   id pair; the counts are joined back, and a segment's links, groups and sums are
   put together.
6. ``align``: the dictionaries are joined with that by segment; a task packs what it has
   for each unit and sends it there, where texts take sums and groups from it.

A frequent segment is a row for each unit, not for each occurrence. Partitioned by
segment, steps 3 to 5 need no further shuffle but that of the counts.

Cases: texts that are null or empty or that a tokenizer doesn't give back byte by byte
have no tokens and count for nothing; null doc_ids and rows that repeat get a row
each; a text without such places is one segment, in one task; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import exchange as ex
from . import textcore as tc

#: Bytes of text in a unit, about.
UNIT = 24 << 20
#: Segments encoded at a time, and codes of texts put together at a time.
BATCH, CODES = 4096, 1 << 20
#: Bytes of rows in a pack of answers, about, before they are dealt to their units.
PACK = 16 << 20
#: Id pairs whose counts are broadcast, 24 bytes each; more are joined by a shuffle.
BROADCAST = 1 << 20
_SPACE = "▁"


class Tokenizers:
    """A byte-level one of the tokenizers library (A) and one of sentencepiece (B) with byte fallback."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        n = self.b.get_piece_size()
        if not any(self.b.is_byte(i) for i in range(n)):
            raise ValueError("the second tokenizer needs byte fallback")
        back = byte_decoder()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.size_a = np.zeros(max(vocab.values()) + 1, np.int32)
        for t, i in vocab.items():
            self.size_a[i] = len(t) if all(c in back for c in t) else len(t.encode())
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.size_b = np.array([1 if self.b.is_byte(i) else len(p.replace(_SPACE, " ").encode()) for i, p in enumerate(pieces)], np.int32)
        self.bytes_a = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        pre = self.a.pre_tokenizer
        words = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and getattr(pre, "use_regex", True) and self.a.normalizer is None
        self.cuts = words and not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces) and self.b.normalize("a  b") == f"{_SPACE}a{_SPACE}{_SPACE}b"

    def whole(self, text: str) -> bool:
        """Whether both give back space+text; A, byte-level and without a normaliser, always does."""
        return bool(text) and _SPACE not in text and self.b.normalize(text) == (" " + text).replace(" ", _SPACE)

    def encode(self, segments: list[str]) -> tuple[list, list]:
        """Ids of segments, which begin with a space."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        return a, self.b.encode([s[1:] for s in segments], num_threads=1)


def byte_decoder() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def _tokenizers(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


def starts(data: np.ndarray, offs: np.ndarray, cuts: bool) -> np.ndarray:
    """Where segments start: at rows, and before single spaces between characters that are surely not of white space.

    Beside ASCII, what may end or begin a longer space character (lead bytes C2, E1, E2, E3) is left uncut.
    """
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    if cuts and len(data) > 2:
        at = np.flatnonzero(data[1:-1] == 0x20) + 1
        ahead, back = data[at + 1], data[at - 1]
        wide = lambda x: (x == 0xE1) | (x == 0xE2) | (x == 0xE3)
        # after: no first byte of such a character; before: no last byte of one of two or three bytes
        good = (ahead > 0x20) & (ahead != 0x7F) & (ahead != 0xC2) & ~wide(ahead) & (back > 0x20) & (back != 0x7F)
        good &= (back < 0x80) | ((data[np.maximum(at - 2, 0)] != 0xC2) & ~wide(data[np.maximum(at - 3, 0)]))
        at = at[good]
        # a space at either end of a row isn't between two characters of it
        first[at[~first[at] & ~first[at + 1]]] = True
    return np.flatnonzero(first[:-1])


def dictionaries(docs: DataFrame, a: str, b: str, unit: int = UNIT) -> DataFrame:
    """One row for each unit of texts: its distinct segments, how often each occurs, and its rows as codes of them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit(" "), text).alias("text"))

    def go(batches):
        t, task, n = _tokenizers(a, b), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            good = np.array([t.whole(x.as_py()[1:]) for x in texts], bool)
            data, offs = tc.string_buffers(pc.if_else(pa.array(good), texts, ""))
            at = starts(data, offs, t.cuts)
            bounds = np.append(at, len(data)).astype(np.int64)
            seen = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]).dictionary_encode()
            codes = seen.indices.to_numpy()
            row = np.searchsorted(at, offs)
            payload = ex.pack({"doc_id": ids.fill_null(0).to_numpy(), "null": ids.is_null().to_numpy(zero_copy_only=False), "ends": row, "codes": ex.small(codes)})
            counts = np.bincount(codes, minlength=len(seen.dictionary))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) | n]), pa.array([seen.dictionary.cast(pa.binary()).cast(pa.string())], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([payload])],
                ["unit", "segments", "counts", "payload"],
            )
            n += 1

    return tc.stored(tc.arrow_batches(rows, go, "unit long, segments array<string>, counts array<long>, payload binary", unit), "units", "zstd")


def encoded(segments: DataFrame, a: str, b: str) -> DataFrame:
    """(sid, n, segment) of distinct (segment, n), with ids and lengths of tokens of both."""

    def go(batches):
        t, task, n = _tokenizers(a, b), TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                texts = part.column(0).to_pylist()
                ids_a, ids_b = t.encode(texts)
                for s, x, y in zip(texts, ids_a, ids_b, strict=True):
                    raw = s.encode()
                    if b"".join(map(t.bytes_a.__getitem__, x)) != raw or b"".join(map(t.bytes_b.__getitem__, y)) != raw:
                        raise ValueError(f"a tokenizer changes {s[:80]!r}, not in its normal form")
                lists = [pa.array(x, pa.list_(pa.int32())) for x in (ids_a, ids_b)]
                sizes = [pa.ListArray.from_arrays(x.offsets, pa.array(size[x.values.to_numpy()])) for x, size in zip(lists, (t.size_a, t.size_b), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + len(texts)) + task), part.column(1), part.column(0), lists[0], sizes[0], lists[1], sizes[1]], ["sid", "n", "segment", "a", "size_a", "b", "size_b"])
                n += len(texts)

    return tc.arrow_batches(segments, go, "sid long, n long, segment string, a array<int>, size_a array<int>, b array<int>, size_b array<int>")


def tokens(units: DataFrame, ids: str, sizes: str) -> DataFrame:
    """(sid, n, id, end): tokens in order, with the byte each ends before."""
    each = units.select("sid", "n", F.posexplode(F.arrays_zip(F.col(ids).alias("id"), F.col(sizes).alias("size"))).alias("pos", "t"))
    until = Window.partitionBy("sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("sid", "n", F.col("t.id").alias("id"), F.sum("t.size").over(until).alias("end"))


def linked(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sid, n, end, a, b, a_ends, b_ends, group) from tokens of both sides: a row for each link; groups are numbered from a segment's last to its first."""
    none = F.lit(None).cast("int")
    ends = a.select("sid", "n", "end", F.col("id").alias("x"), none.alias("y")).union(b.select("sid", "n", "end", none, F.col("id")))
    met = ends.groupBy("sid", "n", "end").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    back = Window.partitionBy("sid").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    covers = lambda c: F.last(c, ignorenulls=True).over(back)
    cut = F.col("x").isNotNull() & F.col("y").isNotNull()
    return met.select("sid", "n", "end", covers("x").alias("a"), covers("y").alias("b"), F.col("x").isNotNull().alias("a_ends"), F.col("y").isNotNull().alias("b_ends"), F.sum(cut.cast("int")).over(back).alias("group"))


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best) over the whole corpus; a B id has no more rows than A has ids."""
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def scored(links: DataFrame, counts: DataFrame) -> DataFrame:
    """(sid, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each segment; ``groups`` ends with a semicolon."""
    few = counts.count() <= BROADCAST
    known = links.drop("n").join(F.broadcast(counts), ["a", "b"]) if few else tc.salted_join(links.drop("n"), counts, ["a", "b"], "inner", "sid")
    # in a group the A ids come first; the last id of a side ends where the group does
    cut = F.col("a_ends") & F.col("b_ends")
    part = lambda c, side, last: F.collect_list(F.when(F.col(f"{c}_ends"), F.struct((-F.col("group")).alias("k"), F.lit(side).alias("side"), "end", F.concat(F.col(c).cast("string"), F.when(cut, last).otherwise(",")).alias("x"))))
    count = lambda c: F.sum(F.col(c).cast("long"))
    out = known.groupBy("sid").agg(count("a_ends").alias("n_a"), count("b_ends").alias("n_b"), F.sum(cut.cast("long")).alias("n_groups"), F.count("*").alias("n_links"), count("best").alias("n_best"), F.sum("count").alias("count_sum"), F.concat(part("a", 0, "|"), part("b", 1, ";")).alias("ids"))
    return out.withColumn("groups", F.array_join(F.transform(F.sort_array("ids"), lambda t: t["x"]), "")).drop("ids")


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _texts(pieces: pa.Array, codes: np.ndarray, ends: np.ndarray) -> list[str]:
    """Digest of the pieces of each row, put together without the last byte."""
    out = []
    for i in range(len(ends) - 1):
        h, a, b = hashlib.sha256(), int(ends[i]), int(ends[i + 1])
        for j in range(a, b, CODES):
            k = min(j + CODES, b)
            raw, _ = tc.string_buffers(pieces.take(pa.array(codes[j:k])))
            h.update(np.ascontiguousarray(raw[:-1] if k == b else raw))
        out.append(h.hexdigest() if b > a else "")
    return out


def packed(rows: DataFrame) -> DataFrame:
    """(of, pack): rows of a unit (of, code, FIELDS, groups) that a task has, in one binary for each batch."""

    def go(batches):
        for b in batches:
            of = b.column("of").to_numpy()
            order = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
            numbers = {f: b.column(f).to_numpy()[order] for f in ("code", *FIELDS)}
            data, offs = tc.string_buffers(b.column("groups").take(pa.array(order)))
            packs = []
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                packs.append(ex.pack({k: ex.small(v[i:j]) for k, v in numbers.items()} | {"size": ex.small(np.diff(offs[i : j + 1])), "text": data[offs[i] : offs[j]]}))
            yield pa.RecordBatch.from_arrays([pa.array(of[order][cuts]), pa.array(packs, pa.binary())], ["of", "pack"])

    return tc.arrow_batches(rows, go, "of long, pack binary", PACK)


def _put_together(payload: bytes, packs: list[bytes]) -> pa.RecordBatch:
    """The rows of a unit; ``packs`` have what is known of each of its segments."""
    d, parts = ex.unpack(payload), [ex.unpack(p) for p in packs]
    codes, ends = d["codes"].astype(np.int64), d["ends"].astype(np.int64)
    column = lambda k, kind=np.int64: np.concatenate([p[k].astype(kind) for p in parts]) if parts else np.zeros(0, kind)
    place = np.argsort(column("code"))
    cols = [pa.array(d["doc_id"], mask=d["null"].astype(bool))]
    full = np.flatnonzero(np.diff(ends))
    for f in FIELDS:
        sums = np.zeros(len(ends) - 1, np.int64)
        if len(full):
            sums[full] = np.add.reduceat(column(f)[place][codes], ends[:-1][full])
        cols.append(pa.array(sums))
    bounds = np.append(0, np.cumsum(column("size"))).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(place), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(column("text", np.uint8).tobytes())]).take(pa.array(place))
    cols.append(pa.array(_texts(pieces, codes, ends), pa.string()))
    return pa.RecordBatch.from_arrays(cols, ["doc_id", *FIELDS, "groups_sha256"])


def align(docs: DataFrame, a: str, b: str, unit: int = UNIT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    units = dictionaries(docs, a, b, unit)
    each = units.select(F.explode(F.arrays_zip("segments", "counts")).alias("s"))
    distinct = each.groupBy(F.col("s.segments").alias("segment")).agg(F.sum("s.counts").alias("n"))
    known = tc.stored(encoded(distinct, a, b), "encoded", "zstd")
    parts = ex.parts_of(docs)
    by_sid = known.select("sid", "n", "a", "size_a", "b", "size_b").repartition(parts, "sid")
    links = linked(tokens(by_sid, "a", "size_a"), tokens(by_sid, "b", "size_b"))  # made twice: smaller to sort again than to keep
    counts = tc.stored(pair_counts(links), "pairs")
    made = tc.stored(scored(links, counts).join(known.select("sid", "segment"), "sid").drop("sid"), "scored", "zstd")

    rows = units.select(F.col("unit").alias("of"), F.posexplode("segments").alias("code", "segment")).join(made, "segment").drop("segment")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_put_together(x.as_py(), right.column("pack").to_pylist()) for x in left.column("payload")])

    packs = tc.stored(packed(rows), "packs")  # here the shuffles by segment end
    return units.select("unit", "payload").groupBy("unit").cogroup(packs.groupBy("of")).applyInArrow(go, schema)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(tc.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment}
ORACLE_SQL: dict[str, str] = {}
