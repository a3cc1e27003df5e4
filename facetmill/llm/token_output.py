"""Operator 3: token-ID output in seekable zstandard files.

A shard file holds, one after the other:

* independent zstandard frames, each the ids (little-endian, ``id_bytes`` wide) of
  whole consecutive documents, about ``FRAME`` bytes before compression;
* a skippable frame (magic 0x184D2A50) with the compressed document index: doc_id,
  null flag, frame number, offset in the frame and token count of each document;
* the trailing seek table of the public seekable format: a skippable frame (magic
  0x184D2A5E) with compressed size, decompressed size and checksum (low 32 bits of
  XXH64 of the decompressed bytes) of every frame, then frame count, descriptor and
  magic 0x8F92EAB1.

A reader gets the table and the index from the end of the file and decompresses
only the frames of the documents asked for. Documents are dealt to shards by
range of doc_id and sorted, so shards in order hold ascending doc_ids. A task
writes below a name of its own and renames at the end: a task that runs again
leaves the same file. Files go to the shared folder through ``pyarrow.fs``.

Ids come from the tokenizers library. A text is cut at single spaces between
characters that are not white space, which are always token bounds for a
byte-level vocabulary with the usual word pattern; each distinct piece is encoded
once and remembered in a bounded table.

Cases: a null text is empty and gives the end id alone; null doc_ids come last;
documents that repeat each get their ids, ordered by a hash of the text; extra
columns are ignored; an empty table gives no file and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc

FRAME = 128 << 10
END_ID = 2
#: Pieces that a Python worker remembers before it starts anew.
CACHE = 2_000_000
LEVEL = 3
_INDEX_MAGIC, _TABLE_MAGIC, _FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class PieceEncoder:
    """Exact ids of whole texts, with each distinct piece encoded once.

    A piece runs from a single space between characters other than white space to
    the next one; pieces are told apart by 64-bit hashes. Pieces after the first
    start with their only space, so in the ids of many pieces in a row each piece
    starts at a token that starts with a space. Vocabularies that aren't byte-level
    get whole texts, as do texts that hold a token which the library splits off
    before anything else.
    """

    def __init__(self, path: str, width: int, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tok, self.limit, self.kind = Tokenizer.from_file(path), cache, f"<u{width}"
        pre = self.tok.pre_tokenizer
        self.by_piece = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self.tok.normalizer is None
        if resize := getattr(self.tok.model, "_resize_cache", None):
            resize(0)  # no piece comes twice
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab()
        self.lead = np.zeros(max(vocab.values()) + 1, bool)
        self.lead[[i for t, i in vocab.items() if t[:1] == "\u0120"]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, tc.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes], first: np.ndarray) -> None:
        """Add the ids of new pieces to the pool."""
        plain = np.array([not f and b" " not in p for p, f in zip(pieces, first.tolist(), strict=True)], bool)
        order, parts, sizes = [], [], []
        rows = np.flatnonzero(plain)
        for i in range(0, len(rows), 4096):
            part = rows[i : i + 4096]
            text = b" " + b" ".join(pieces[k] for k in part.tolist())
            ids = np.array(self.tok.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(self.lead[ids])
            if len(cuts) != len(part):
                raise ValueError("the vocabulary doesn't split at spaces")
            order.append(part)
            parts.append(ids)
            sizes.append(np.diff(np.append(cuts, len(ids))))
        for k in np.flatnonzero(~plain).tolist():
            ids = self.whole(pieces[k].decode() if first[k] else " " + pieces[k].decode())
            order.append(np.array([k]))
            parts.append(ids)
            sizes.append(np.array([len(ids)]))
        if not order:
            return
        order, size = np.concatenate(order), np.concatenate(sizes)
        known = np.concatenate([self.known, hashes[order]])
        at = np.concatenate([self.at, len(self.pool) + np.cumsum(size) - size])
        size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, *parts])
        by = np.argsort(known)
        self.known, self.at, self.size = known[by], at[by], size[by]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a slice."""
        rows = len(offs) - 1
        raw = data.tobytes()
        odd = [False] * rows
        if not self.by_piece:
            odd = [True] * rows
        elif any(t in raw for t in self.added):
            odd = [any(t in raw[a:b] for t in self.added) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        start, end, row, first = _pieces(data, offs)
        h = tc.span_hashes_any(data, start, end) ^ (first.astype(tc.U) * tc.U(0xA24BAED4963EE407))
        distinct, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > self.limit:
            self._forget()
        new = ~np.isin(distinct, self.known, assume_unique=True, kind="sort") if len(self.known) else np.ones(len(distinct), bool)
        k = where[new]
        self._learn(distinct[new], [raw[a:b] for a, b in zip(start[k].tolist(), end[k].tolist(), strict=True)], first[k])
        slot = np.searchsorted(self.known, distinct)[inverse] if len(distinct) else np.zeros(0, np.int64)
        at, size = self.at[slot], self.size[slot]
        done = np.cumsum(size)
        total = int(done[-1]) if len(done) else 0
        ids = self.pool[np.repeat(at - (done - size), size) + np.arange(total)]
        ends = np.append(0, done)[np.searchsorted(row, np.arange(rows + 1))]
        return [self.whole(raw[offs[i] : offs[i + 1]].decode()) if odd[i] else ids[ends[i] : ends[i + 1]] for i in range(rows)]


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def _encoder(path: str, width: int) -> PieceEncoder:
    """This worker's encoder: what it knows serves later tasks too."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = PieceEncoder(path, width)
    return _ENCODERS[path, width]


def _pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and whether it is its row's first, of each piece without the space before it.

    Bytes next to a cut are surely not of white space: beside ASCII, what may end
    or begin a longer space character (lead bytes C2, E1, E2, E3) is left uncut.
    """
    n = len(data)
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < n - 1)]
    back = [data[np.maximum(at - k, 0)] for k in (1, 2, 3)]
    ahead = data[at + 1]
    wide = lambda x: (x == 0xE1) | (x == 0xE2) | (x == 0xE3)
    good = (back[0] > 0x20) & (back[0] != 0x7F) & (ahead > 0x20) & (ahead != 0x7F) & (ahead != 0xC2) & ~wide(ahead)
    good &= (back[0] < 0x80) | ((back[1] != 0xC2) & ~wide(back[2]))
    at = at[good]
    # a space at either end of a row isn't between two characters of it
    inner = np.searchsorted(offs, at, "right") - 1
    at = at[(at > offs[inner]) & (at + 1 < offs[inner + 1])]
    full = np.flatnonzero(offs[1:] > offs[:-1])
    start = np.concatenate([offs[full], at + 1])
    first = np.concatenate([np.ones(len(full), bool), np.zeros(len(at), bool)])
    order = np.argsort(start, kind="stable")
    start, first = start[order], first[order]
    row = np.searchsorted(offs, start, "right") - 1
    end = np.empty_like(start)
    end[:-1] = np.where(first[1:], offs[row[:-1] + 1], start[1:] - 1)
    end[-1:] = offs[row[-1:] + 1]
    return start, end, row, first


class ShardWriter:
    """Frames, document index and seek table of one shard."""

    def __init__(self, sink, id_bytes: int, frame: int = FRAME, level: int = LEVEL):
        self.sink, self.id_bytes, self.frame = sink, id_bytes, frame
        self.zip = zstandard.ZstdCompressor(level=level)
        self.part: list[bytes] = []
        self.held = self.tokens = 0
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, bool, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Add a document's ids, as bytes."""
        n = len(ids) // self.id_bytes
        self.index.append((doc_id or 0, doc_id is None, len(self.table), self.held, n))
        self.part.append(ids)
        self.held += len(ids)
        self.tokens += n
        if self.held >= self.frame:
            self._flush()

    def _flush(self) -> None:
        if self.part:
            raw = b"".join(self.part)
            data = self.zip.compress(raw)
            self.sink.write(data)
            self.table.append((len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.part, self.held = [], 0

    def close(self) -> None:
        self._flush()
        cols = list(zip(*self.index, strict=True)) or [()] * 5
        body = b"".join(np.array(c, k).tobytes() for c, k in zip(cols, ("<i8", "<u1", "<u4", "<u8", "<u8"), strict=True))
        index = self.zip.compress(struct.pack("<QB", len(self.index), self.id_bytes) + body)
        self.sink.write(struct.pack("<II", _INDEX_MAGIC, len(index)) + index)
        rows = [*self.table, (len(index) + 8, 0, 0)]
        self.sink.write(struct.pack("<II", _TABLE_MAGIC, 12 * len(rows) + 9))
        self.sink.write(b"".join(struct.pack("<III", *r) for r in rows) + struct.pack("<IBI", len(rows), 0x80, _FOOT_MAGIC))


class ShardReader:
    """Random access to the documents of a shard."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _FOOT_MAGIC or not flags & 0x80:
            raise ValueError("no seek table at the end of the file")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self.table = [struct.unpack_from("<III", table, 12 * i) for i in range(n)]
        self.offset = np.concatenate([[0], np.cumsum([t[0] for t in self.table])]).tolist()
        index = zstandard.ZstdDecompressor().decompress(self._at(self.offset[n - 1] + 8, self.table[-1][0] - 8))
        count, self.id_bytes = struct.unpack_from("<QB", index)
        at, cols = 9, []
        for k in ("<i8", "<u1", "<u4", "<u8", "<u8"):
            cols.append(np.frombuffer(index, k, count, at))
            at += cols[-1].nbytes
        self.doc_id, self.null, self.frame, self.place, self.n_tokens = cols

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame_bytes(self, k: int) -> bytes:
        size, raw, check = self.table[k]
        data = zstandard.ZstdDecompressor().decompress(self._at(self.offset[k], size), max_output_size=raw)
        if len(data) != raw or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Place in the shard and ids of the documents at the places ``wanted`` (ascending), by default all."""
        held, data = -1, b""
        for i in (range(len(self.doc_id)) if wanted is None else wanted.tolist()):
            if (k := int(self.frame[i])) != held:
                held, data = k, self.frame_bytes(k)
            yield i, np.frombuffer(data, f"<u{self.id_bytes}", int(self.n_tokens[i]), int(self.place[i]))


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path)
    return fs, at


def write_tokens(docs: DataFrame, directory: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None, frame: int = FRAME) -> list[tuple]:
    """Write shards below ``directory`` and return (path, documents, tokens) of each, in order."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    end = np.array([end_id], f"<u{width}").tobytes()
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns({"h": F.xxhash64("text"), "m": F.monotonically_increasing_id()})
    # rows that repeat in all columns may fall to several shards: m tells them apart
    dealt = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_last(), "h", "m").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "h").select("doc_id", "text")

    def write(batches):
        k = TaskContext.get().partitionId()
        fs, at = _open(f"{directory}/shard-{k:06d}.tokz")
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        own, encoder, out, sink = f"{at}.{uuid.uuid4().hex}", None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                encoder, sink = _encoder(tokenizer, width), fs.open_output_stream(own)
                out = ShardWriter(sink, width, frame)
            data, offs = tc.string_buffers(b.column(1))
            for i, j in tc.slices(offs):
                for d, ids in zip(b.column(0).slice(i, j - i).to_pylist(), encoder.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), strict=True):
                    out.add(d, ids.tobytes() + end)
        if out is not None:
            out.close()
            sink.close()
            if fs.get_file_info(at).type != pafs.FileType.NotFound:
                fs.delete_file(at)  # of an attempt before: not every store replaces
            fs.move(own, at)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([f"{directory}/shard-{k:06d}.tokz"]), pa.array([len(out.index)]), pa.array([out.tokens])], ["shard", "path", "docs", "tokens"])

    made = tc.arrow_batches(dealt, write, "shard long, path string, docs long, tokens long").collect()  # a row for each file
    return [(r.path, r.docs, r.tokens) for r in sorted(made, key=lambda r: r.shard)]


def read_tokens(spark: SparkSession, shards: list[tuple], digest: bool = False) -> DataFrame:
    """Documents read back from the files: doc_id, start, n_tokens, and ids or their ids_crc32."""
    base, rows = 0, []
    for k, (path, _, tokens) in enumerate(shards):
        rows.append((k, path, base))
        base += tokens
    last = "ids_crc32 long" if digest else "ids array<long>"
    schema = f"doc_id long, start long, n_tokens long, {last}"
    if not rows:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(rows, "k long, path string, base long").repartitionByRange(len(rows), "k")

    def read(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                fs, at = _open(path)
                with fs.open_input_file(at) as f:
                    r = ShardReader(f)
                    starts = start + np.concatenate([[0], np.cumsum(r.n_tokens)[:-1]]).astype(np.int64)
                    held: list = []
                    for i, ids in r.documents():
                        held.append(zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int64))
                        if len(held) == 1024 or i == len(r.doc_id) - 1:
                            s = slice(i + 1 - len(held), i + 1)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(r.doc_id[s], pa.int64(), mask=r.null[s].astype(bool)), pa.array(starts[s]), pa.array(r.n_tokens[s].astype(np.int64)), pa.array(held, pa.int64() if digest else pa.list_(pa.int64()))],
                                ["doc_id", "start", "n_tokens", last.split()[0]],
                            )
                            held = []

    return tc.arrow_batches(files, read, schema)


def encode_corpus(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to a new folder in the shared one and return the digests read back from the files."""
    import public_tokenizers

    spark = docs.sparkSession
    directory = f"{tc.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    shards = write_tokens(docs, directory, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, shards, digest=True)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(tc.documents(spark, sf_dir))


QUERIES = {"op3_token_output": op3_token_output}
ORACLE_SQL: dict[str, str] = {}
