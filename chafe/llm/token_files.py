"""Operator 6 - token ids in binary files with Elias-Fano document boundaries.

A shard file holds the ids of its documents one after the other, in ascending
doc_id order, and two Elias-Fano sequences: the documents' boundaries in that
array and their doc_ids.  An Elias-Fano sequence stores the low bits of each
value packed and the high parts in unary (about 2 + log2(range / n) bits a
value); a sampled position for every 256th value is its select structure, so
one boundary is found without a table of 64-bit offsets.

Layout: 8 bytes of magic, the ids (u16 or u32, little-endian), the
boundaries, the doc_ids, and a footer of fixed size that says where they are.

Shards are written by tasks over range partitions of doc_id into a folder
that all machines share, under a temporary name that is moved into
place, so a repeated or speculative task leaves the same file.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, utf8, written

MAGIC = b"CHTOKEN1"
FOOTER = "<8Q"     # n_docs n_null n_ids id_width least_doc bounds_at docs_at end
SAMPLE = 256                      # ones between two sampled positions
ROWS_PER_SHARD = 8_192
_CACHE = 400_000                  # words remembered by an encoder
_EF_HEAD = "<4Q"   # n low_bits high_bytes sample_bytes


def ef_encode(values: np.ndarray) -> bytes:
    """Elias-Fano bytes of a non-decreasing sequence of non-negative integers."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    low_bits = max(0, int(int(v[-1]) // n).bit_length() - 1) if n else 0
    low = np.zeros((n, low_bits), np.uint8)
    for b in range(low_bits):
        low[:, b] = (v >> np.uint64(b)) & np.uint64(1)
    ones = (v >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones.astype(np.int64)] = 1
    high_bytes = np.packbits(high, bitorder="little").tobytes()
    samples = ones[::SAMPLE].astype(np.uint32 if len(high) < 1 << 32 else np.uint64)
    return (struct.pack(_EF_HEAD, n, low_bits, len(high_bytes), samples.itemsize) + samples.tobytes() + high_bytes
            + np.packbits(low.reshape(-1), bitorder="little").tobytes())


class EliasFano:
    """Reads an encoded sequence: one value by select, or all of them."""

    def __init__(self, raw: bytes):
        self.n, self.low_bits, n_high, width = struct.unpack_from(_EF_HEAD, raw)
        at = struct.calcsize(_EF_HEAD)
        n_samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(raw, np.uint32 if width == 4 else np.uint64, n_samples, at)
        at += n_samples * width
        self.high = np.frombuffer(raw, np.uint8, n_high, at)
        self.low = np.frombuffer(raw, np.uint8, -(-self.n * self.low_bits // 8), at + n_high)

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        word = int.from_bytes(self.low[a // 8:(a + self.low_bits + 7) // 8].tobytes(), "little")
        return word >> a % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """Value i, from the sampled position before it and the bytes that follow."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE                    # ones still to pass
        byte = at // 8
        cur = int(self.high[byte]) >> at % 8 << at % 8
        while cur.bit_count() <= left:
            left -= cur.bit_count()
            byte += 1
            cur = int(self.high[byte])
        for _ in range(left):
            cur &= cur - 1
        one = byte * 8 + (cur & -cur).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64)[:self.n]
        out = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
        for b in range(self.low_bits):
            out |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return out


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Whole texts to ids, word by word.

    The vocabulary's pre-tokenizer drops white space and never joins across it, so
    a text's ids are those of its words.  Words of Latin letters with
    closing punctuation go straight to the library's model (letters, then
    punctuation, each one pre-token); all others through its whole pipeline.
    """

    _PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if max(end_id, self.tokenizer.get_vocab_size() - 1) < 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.bytes_as = _byte_alphabet()
        self.words: dict[bytes, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _unit(self, unit: str) -> bytes:
        got = self.units.get(unit)
        if got is None:
            mapped = unit if unit.isascii() else "".join(map(self.bytes_as.__getitem__, unit.encode()))
            got = self.units[unit] = self._pack([t.id for t in self.model.tokenize(mapped)])
        return got

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        m = self._PLAIN.fullmatch(text)
        if not m:
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        letters = self._unit(m[1].lower())
        return letters + self._unit(m[2]) if m[2] else letters

    def encode(self, text: bytes) -> bytes:
        """Packed ids of a text (UTF-8), the end id appended."""
        if len(self.words) > _CACHE:
            self.words.clear()
        if len(self.units) > _CACHE:
            self.units.clear()
        known, out = self.words, []
        for w in text.split():
            ids = known.get(w)
            if ids is None:
                ids = known[w] = self._word(w)
            out.append(ids)
        out.append(self.end)
        return b"".join(out)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder and the path in it: file, hdfs, s3, gs or a plain path."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", uri):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return pafs.LocalFileSystem(), uri


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """Write one file per range of doc_ids; (shard, path, n_docs, n_ids, start).

    ``start`` is the number of ids in all shards before.  Defined cases: a null text is
    empty, and every document gets the end id; rows without an id come first;
    rows that share an id stay next to each other, ordered by text; a table
    without rows writes no file; a text is encoded whole whatever its length.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = docs.count()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("t")) \
        .repartitionByRange(max(1, -(-n // ROWS_PER_SHARD)), "doc_id").sortWithinPartitions("doc_id", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        task = TaskContext.get()
        name = f"{root}/shard-{task.partitionId():08d}.tok"
        encoder, out, bounds, ids, nulls = None, None, [0], [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None:
                    encoder = WordEncoder(tokenizer_path, end_id)
                    store.create_dir(root, recursive=True)
                    part = f"{name}.{task.taskAttemptId()}.part"
                    out = store.open_output_stream(part)
                    out.write(MAGIC)
                packed = encoder.encode(t)
                out.write(packed)
                bounds.append(bounds[-1] + len(packed) // encoder.dtype.itemsize)
                if d is None:
                    nulls += 1
                else:
                    ids.append(d)
        if out is None:
            return
        width, least = encoder.dtype.itemsize, ids[0] if ids else 0
        b, i = ef_encode(np.array(bounds, np.uint64)), ef_encode((np.array(ids, np.int64) - least).view(np.uint64))
        bounds_at = len(MAGIC) + bounds[-1] * width
        out.write(b + i + struct.pack(FOOTER, len(bounds) - 1, nulls, bounds[-1], width, least & (1 << 64) - 1, bounds_at,
                                      bounds_at + len(b), bounds_at + len(b) + len(i)))
        out.close()
        store.move(part, name)
        yield pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([len(bounds) - 1], pa.int64()),
             pa.array([bounds[-1]], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

    # one row per file
    shards = written(rows.mapInArrow(write, "shard int, path string, n_docs long, n_ids long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


class TokenFile:
    """A shard opened for reading."""

    def __init__(self, store: pafs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = struct.calcsize(FOOTER)
        self.file.seek(self.file.size() - size)
        (self.n_docs, self.n_null, self.n_ids, width, least, self._bounds_at, docs_at, end) = \
            struct.unpack(FOOTER, self.file.read(size))
        self.dtype = np.dtype(f"<u{width}")
        self.least = least - (1 << 64) if least >= 1 << 63 else least
        self.file.seek(self._bounds_at)
        self.bounds = EliasFano(self.file.read(docs_at - self._bounds_at))
        self.docs = EliasFano(self.file.read(end - docs_at))

    def ids(self, i: int) -> np.ndarray:
        """The ids of document i, found by select."""
        a, b = self.bounds.select(i), self.bounds.select(i + 1)
        self.file.seek(len(MAGIC) + a * self.dtype.itemsize)
        return np.frombuffer(self.file.read((b - a) * self.dtype.itemsize), self.dtype)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + [int(v) + self.least for v in self.docs.values().view(np.int64)]


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    n = max(1, shards.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = file_system(folder)[0]
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = TokenFile(store, path)
                bounds = f.bounds.values().astype(np.int64)
                f.file.seek(len(MAGIC))
                crc = [zlib.crc32(np.frombuffer(f.file.read(int(k) * f.dtype.itemsize), f.dtype).astype("<u4").tobytes())
                       for k in np.diff(bounds)]
                f.file.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.doc_ids(), pa.int64()), pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)),
                     pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    return shards.select("path", "start").repartition(n).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")
