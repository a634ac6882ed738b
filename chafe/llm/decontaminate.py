"""Operator 4 - benchmark decontamination by SimHash over item-sized windows.

A document is compared with each benchmark item through windows of exactly the
item's number of words, or as a whole where it has fewer words than the item.
Window and item fingerprints are 64-bit SimHashes of five-word shingles, weighted by
occurrences.  Multi-index Hamming blocks find
the pairs: with 4 blocks of 16 bits, fingerprints within 15 bits agree in some
block up to 3 bits (4 blocks with 4 or more would make 16), so indexing each
item under the 697 values within 3 bits of each of its blocks misses no
pair within the radius.  Two unrelated fingerprints meet in 4.3 % of all cases.
Pairs at similarity 0.8 differ in about 10 bits; pairs beyond 15 bits that agree in
a block are candidates too, so over 99 % of the pairs at exactly 0.8 are found (a
test measures it).  Candidates are verified by the exact weighted-shingle similarity.

Two shingle bags of m and n at similarity J >= 0.8 share at least 4/9 (m + n)
shingles, and the smaller one holds at least 0.8 of the larger one's number.
Windows with fewer shingles that occur in an item of that size
(a bit set of bounded size, no false negatives) can't match, so no fingerprint
is made for them.  A window whose first shingle is in no item is dominated by the
next one to the right, unless it ends the text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, text_key, utf8, written

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 3
MAX_BITS = BLOCKS * (BLOCK_RADIUS + 1) - 1              # every pair within so many bits meets
MIN_FILTER_BITS, MAX_FILTER_BITS = 1 << 16, 1 << 31     # of the broadcast bit set
_CACHE_WORDS = 400_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: list[bytes], size: int, cache: _WordHashes) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` words."""
    w = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(w) - size + 1
    h = np.zeros(max(0, n), np.uint64)
    for j in range(size if n > 0 else 0):
        h = h * _MULT + w[j:j + n]
    return _mix(h)


def simhash(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<i8")[0])


def weighted_similarity(a: list[bytes], b: list[bytes], size: int = SHINGLE_WORDS) -> float:
    """Sum of least over sum of largest occurrence counts of the shingles
    (of all words at once where there are fewer than ``size``)."""
    def bag(w):
        k = min(size, len(w))
        return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if k else Counter()
    x, y = bag(a), bag(b)
    top = sum((x | y).values())
    return sum((x & y).values()) / top if top else 0.0


def _salted(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """Another hash of the shingles for each window size."""
    return _mix(hashes + np.uint64(n_words * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))


def benchmark_items(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item, item_id, size, fp, words): item is a key of the row (stable once written),
    size in words; items without a word are left out."""
    def item(b: pa.RecordBatch) -> pa.RecordBatch:
        cache, rows = _WordHashes(), []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = words_of(t)
            if w:
                rows.append((i, len(w), simhash(shingle_hashes(w, min(SHINGLE_WORDS, len(w)), cache)), b" ".join(w)))
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["item_id", "size", "fp", "words"])
    return map_batches(benchmark.select(F.col(item_id).cast("long"), utf8(text)), item,
                       "item_id long, size int, fp long, words binary") \
        .select(F.monotonically_increasing_id().alias("item"), "*")


def _shingle_filter(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bit set of the items' shingles, plain and salted by size, and the sizes."""
    per = items.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect()   # one row per size
    sizes = [r["size"] for r in per]
    entries = sum(2 * max(1, r["size"] - SHINGLE_WORDS + 1) * r["n"] for r in per)
    bits = max(MIN_FILTER_BITS, min(MAX_FILTER_BITS, 1 << int(16 * entries).bit_length()))

    def places(b: pa.RecordBatch) -> pa.RecordBatch:
        cache, out = _WordHashes(), []
        for size, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            h = shingle_hashes(w.split(b" "), min(SHINGLE_WORDS, size), cache)
            out += [h, _salted(h, size)]
        at = np.unique(np.concatenate(out) & np.uint64(bits - 1))
        return pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary())], ["at"])

    filled = np.zeros(bits // 8, np.uint8)
    for r in map_batches(items.select("size", "words"), places, "at binary").toLocalIterator():
        at = np.frombuffer(r["at"], np.uint64)
        np.bitwise_or.at(filled, (at >> np.uint64(3)).astype(np.int64),
                         (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
    return filled, sizes


def _has(filled: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(filled) * 8 - 1)
    return (filled[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def item_windows(words: list[bytes], sizes: list[int], filled: np.ndarray, cache: _WordHashes):
    """(size, start, fp) of the windows that can match an item of that size.  A text
    shorter than the item is one window, with its own number of words."""
    by_len: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in sizes:
        k = min(SHINGLE_WORDS, size)
        full = size - k + 1                    # shingles of the item
        m = min(size, len(words)) - k + 1      # and of a window
        if 5 * m < 4 * full:                   # so it is for all larger sizes
            break
        if k not in by_len:
            h = shingle_hashes(words, k, cache)
            by_len[k] = h, np.flatnonzero(_has(filled, h))
        h, some = by_len[k]
        need = -(-4 * (m + full) // 9)
        if len(some) < need:
            continue
        own = some[_has(filled, _salted(h[some], size))]
        if len(own) < need:
            continue
        last = max(0, len(words) - size)
        starts = np.unique(np.r_[own[own <= last], last])
        inside = np.searchsorted(own, starts + m) - np.searchsorted(own, starts)
        for s in starts[inside >= need]:
            yield size, int(s), simhash(np.ascontiguousarray(h[s:s + m]))


def _block(fp: Column, j: int) -> Column:
    return F.shiftrightunsigned(fp, BLOCK_BITS * j).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long"))


def _near_block_values() -> list[int]:
    return [v for v in range(1 << BLOCK_BITS) if v.bit_count() <= BLOCK_RADIUS]


def block_pairs(windows: DataFrame, items: DataFrame) -> DataFrame:
    """``windows`` (size, fp and others) joined to the items (item) of their size with a
    block within BLOCK_RADIUS bits, each pair once."""
    blocks = F.array(*[F.struct(F.lit(j).alias("j"), _block(F.col("fp"), j).alias("v")) for j in range(BLOCKS)])
    masks = F.lit(_near_block_values()).cast("array<long>")
    probe = windows.select("*", F.explode(blocks).alias("__b")).select(*windows.columns, "__b.j", "__b.v")
    index = items.select("item", "size", F.col("fp").alias("item_fp"), F.explode(blocks).alias("b")) \
        .select("item", "size", "item_fp", "b.j", "b.v", F.explode(masks).alias("mask")) \
        .select("item", "size", "item_fp", "j", F.col("v").bitwiseXOR(F.col("mask")).alias("v"))
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*[F.when(F.bit_count(_block(differ, j)) <= BLOCK_RADIUS, F.lit(j)) for j in range(BLOCKS)])
    return probe.join(index, ["size", "j", "v"]).where(F.col("j") == first).select(*windows.columns, "item")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, item_id, similarity): every document and item with a window of the
    item's size (the whole document where that is shorter) at weighted-shingle
    similarity MIN_SIMILARITY or more, with the largest similarity.  ``key`` is the
    document's text_key(), so rows of a null or repeated doc_id are judged each by
    its own text.

    Defined cases: null or empty texts and items without a word match nothing;
    items of under five words are one shingle and match when they occur word
    for word; rows that share doc_id and text count as one document; items
    without an id (null) are found like any other, and items of one id count as
    one; an empty table on either side gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = written(benchmark_items(benchmark))
    filled, sizes = _shingle_filter(items)
    shared = spark.sparkContext.broadcast((filled, sizes))

    def windows(batches):
        cache = _WordHashes()
        bits, lengths = shared.value
        for b in batches:
            rows = []
            for d, t in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist()):
                w = words_of(t)
                rows += [(*d, n, fp, b" ".join(w[s:s + n])) for n, s, fp in item_windows(w, lengths, bits, cache)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["doc_id", "key", "size", "fp", "window"])

    found = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text), utf8(text)).mapInArrow(
        windows, "doc_id long, key long, size int, fp long, window binary").distinct())
    # a passage shared by many documents is looked up once
    unique = written(found.groupBy("size", "fp", "window").agg(F.count("*").alias("n")).drop("n"))

    pairs = block_pairs(unique, items).select("size", "fp", "window", "item")

    @F.pandas_udf("double")
    def similarity(window: pd.Series, item: pd.Series) -> pd.Series:
        return pd.Series([weighted_similarity(a.split(b" "), b.split(b" ")) for a, b in zip(window, item)],
                         dtype=float)

    verified = written(pairs.join(items.select("item", "item_id", "words"), "item")
                       .withColumn("similarity", similarity("window", "words"))
                       .where(F.col("similarity") >= MIN_SIMILARITY)
                       .select("size", "fp", "window", "item_id", "similarity"))
    return found.join(verified, ["size", "fp", "window"]) \
        .groupBy("doc_id", "key", "item_id").agg(F.max("similarity").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, similarity): contaminated_rows() with the rows of a doc_id
    (a null one too) as one document."""
    return contaminated_rows(docs, benchmark, text, doc_id) \
        .groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns stay."""
    bad = written(contaminated_rows(docs, benchmark)
                  .select(F.col("doc_id").alias("__bad"), F.col("key").alias("__bad_key")).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]) & (text_key() == bad["__bad_key"]), "left_anti")
