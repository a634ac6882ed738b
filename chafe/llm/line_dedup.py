"""Operator 5 - line dedup with two Bloom filters for once- and twice-seen lines.

Pass 1 hashes every eligible line into register-blocked Bloom bits: all bits
of a line live in one 64-bit word.  Each task keeps two bit sets, ``once``
(some document holds the line) and ``twice`` (a second one does), and sends
only the words it touched.  Merging is ``twice = t1 | t2 | (o1 & o2)`` and
``once = o1 | o2``; it has no false negatives, so a line that repeats
anywhere is in ``twice``.  Pass 2 shuffles only the lines found there, counts
their documents exactly on the line itself, and picks the document that keeps
it.  Documents with no suspected line are never shuffled.

The merged ``twice`` set is broadcast while its size at BITS_PER_LINE is within
MAX_FILTER_BITS.  Beyond that the filters are dealt by hash: only hashes
shuffle, every task keeps the two bit sets of its range of hashes, and the hashes that
it saw twice come back to the rows that hold them.  Both ways suspect about the
same lines, at every size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_batches, small_batches, text_key, utf8, written

MIN_CHARS = 20
MIN_DOCS = 3
BITS_PER_LINE = 16
MAX_FILTER_BITS = 1 << 31   # 256 MB: proven bound of what is broadcast
RANGE_LINES = 1 << 22       # lines of a range when the filters are dealt: two bit sets of 8 MB
_COMBINE = 1 << 20          # hashes that a task holds to merge equal ones
MIN_FILTER_BITS = 1 << 16
_MAX_CHUNKS = 1024


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return line.strip().lower()


def eligible(key: bytes, min_chars: int = MIN_CHARS) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def _word_and_mask(h: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """A line's word in the filter and its four bits there."""
    one, low = np.uint64(1), np.uint64(63)
    mask = one << (h & low)
    for s in (6, 12, 18):
        mask |= one << ((h >> np.uint64(s)) & low)
    return ((h >> np.uint64(24)) % np.uint64(n_words)).astype(np.int64), mask


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), dtype=np.uint64)


def line_count(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)
                    .alias("n")).first()["n"] or 0


def filter_bits(lines: int) -> int:
    """Filter size for the number of lines, a power of two of at least MIN_FILTER_BITS."""
    return max(MIN_FILTER_BITS, 1 << max(0, int(lines * BITS_PER_LINE - 1).bit_length()))


def twice_seen_filter(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS,
                      lines: int | None = None) -> np.ndarray:
    """The merged ``twice`` bit set as 64-bit words, at most MAX_FILTER_BITS."""
    bits = min(MAX_FILTER_BITS, filter_bits(line_count(docs, text) if lines is None else lines))
    n_words = bits // 64
    per_chunk = max(1024, n_words // _MAX_CHUNKS)
    n_chunks = -(-n_words // per_chunk)

    def sketch(batches):
        seen = [np.empty(0, np.uint64)]
        for b in batches:
            for t in b.column(0).to_pylist():
                keys = {k for k in map(line_key, t.split(b"\n")) if eligible(k, min_chars)}
                if keys:
                    seen.append(_hashes(keys))
        h, docs_with = np.unique(np.concatenate(seen), return_counts=True)
        if not len(h):
            return
        word, mask = _word_and_mask(h, n_words)
        order = np.argsort(word, kind="stable")
        word, mask, docs_with = word[order], mask[order], docs_with[order]
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        once = np.bitwise_or.reduceat(mask, starts)
        twice = np.bitwise_or.reduceat(np.where(docs_with > 1, mask, np.uint64(0)), starts)
        word = word[starts]
        cut = np.searchsorted(word, np.arange(n_chunks + 1) * per_chunk)
        for c in range(n_chunks):
            lo, hi = cut[c], cut[c + 1]
            if lo < hi:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c], pa.int32())]
                    + [pa.array([x.tobytes()], pa.binary()) for x in
                       ((word[lo:hi] - c * per_chunk).astype(np.uint32), once[lo:hi], twice[lo:hi])],
                    ["chunk", "word", "once", "twice"])

    def merge(batches):
        got: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for c, word, o, t in zip(*(b.column(i).to_pylist() for i in range(4))):
                once, twice = got.setdefault(c, (np.zeros(per_chunk, np.uint64), np.zeros(per_chunk, np.uint64)))
                i, o = np.frombuffer(word, np.uint32), np.frombuffer(o, np.uint64)
                twice[i] |= np.frombuffer(t, np.uint64) | (once[i] & o)
                once[i] |= o
        for c, (_, twice) in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([twice.tobytes()], pa.binary())],
                                             ["chunk", "twice"])

    spark = docs.sparkSession
    small_batches(spark)
    parts = min(n_chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    merged = docs.select(utf8(text).alias("t")) \
        .mapInArrow(sketch, "chunk int, word binary, once binary, twice binary") \
        .repartition(parts, "chunk").mapInArrow(merge, "chunk int, twice binary")
    out = np.zeros(n_chunks * per_chunk, np.uint64)
    for r in merged.toLocalIterator():    # a bit set of bounded size, one chunk at a time
        out[r["chunk"] * per_chunk:(r["chunk"] + 1) * per_chunk] = np.frombuffer(r["twice"], np.uint64)
    return out[:n_words]


def _suspects(keys: list[bytes], twice: np.ndarray) -> list[bytes]:
    if not keys:
        return keys
    word, mask = _word_and_mask(_hashes(keys), len(twice))
    return [k for k, hit in zip(keys, (twice[word] & mask) == mask) if hit]


def _by_broadcast(docs: DataFrame, lines: int, text: str, doc_id: str, row: str, mark: str,
                  min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(id, row, key) of suspected lines, and ``docs`` with ``mark``: it may hold one."""
    twice = docs.sparkSession.sparkContext.broadcast(twice_seen_filter(docs, text, min_chars, lines))

    def suspected(b: pa.RecordBatch) -> pa.RecordBatch:
        at, keys = [], []
        for i, t in enumerate(b.column(2).to_pylist()):
            own = _suspects(list({k for k in map(line_key, t.split(b"\n")) if eligible(k, min_chars)}), twice.value)
            at += [i] * len(own)
            keys += own
        at = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(keys, pa.binary())],
                                          ["id", "row", "key"])

    @F.pandas_udf("boolean")
    def has_suspect(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(_suspects(
            [k for k in map(line_key, t.split(b"\n")) if eligible(k, min_chars)], twice.value)))

    named = docs.where(F.col(doc_id).isNotNull())
    pairs = map_batches(named.select(F.col(doc_id).cast("long"), row, utf8(text)), suspected,
                        "id long, row long, key binary")
    return pairs, docs.withColumn(mark, has_suspect(utf8(text)))


def _by_ranges(docs: DataFrame, lines: int, text: str, doc_id: str, row: str, mark: str,
               min_chars: int) -> tuple[DataFrame, DataFrame]:
    """As ``_by_broadcast``, with the filters dealt over tasks by hash."""
    n_words = filter_bits(RANGE_LINES) // 64

    def hashed(b: pa.RecordBatch) -> pa.RecordBatch:
        at, out = [], []
        for i, t in enumerate(b.column(2).to_pylist()):
            h = np.unique(_hashes({k for k in map(line_key, t.split(b"\n")) if eligible(k, min_chars)}))
            at.append(np.full(len(h), i, np.int64))
            out.append(h)
        at = pa.array(np.concatenate(at))
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at),
                                           pa.array(np.concatenate(out).view(np.int64))], ["id", "row", "h"])

    def combine(batches):
        """Equal hashes of a task become one row, so that a line of many documents is no hot key."""
        def merged(held):
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n > 1)], ["h", "many"])
        held, size = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            size += b.num_rows
            if size >= _COMBINE:
                yield merged(held)
                held, size = [], 0
        if size:
            yield merged(held)

    def seen_twice(batches):
        once, twice = np.zeros(n_words, np.uint64), np.zeros(n_words, np.uint64)
        for b in batches:
            h, at, n = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
            many = (n > 1) | (np.bincount(at, weights=b.column(1).to_numpy(zero_copy_only=False)) > 0)
            word, mask = _word_and_mask(h.view(np.uint64), n_words)
            again = many | ((once[word] & mask) == mask)
            np.bitwise_or.at(twice, word[again], mask[again])
            np.bitwise_or.at(once, word, mask)
            yield pa.RecordBatch.from_arrays([pa.array(h[(twice[word] & mask) == mask])], ["h"])

    named = docs.where(F.col(doc_id).isNotNull())
    owned = written(map_batches(named.select(F.col(doc_id).cast("long"), row, utf8(text)), hashed,
                                "id long, row long, h long"))
    repeated = written(owned.select("h").mapInArrow(combine, "h long, many boolean")
                       .repartition(max(1, -(-lines // RANGE_LINES)), "h").mapInArrow(seen_twice, "h long").distinct())
    id_, row_of, hs = fresh(docs, "__hash_id", "__hash_row", "__hashes")
    own = written(owned.join(repeated, "h", "left_semi").groupBy(F.col("id").alias(id_), F.col("row").alias(row_of))
                  .agg(F.collect_set("h").alias(hs)))
    held = docs.join(own, (F.col(doc_id).cast("long") == F.col(id_)) & (F.col(row) == F.col(row_of)), "left")

    def suspected(b: pa.RecordBatch) -> pa.RecordBatch:
        at, keys = [], []
        for i, (t, mine) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
            every = list({k for k in map(line_key, t.split(b"\n")) if eligible(k, min_chars)})
            hit = np.isin(_hashes(every).view(np.int64), np.array(mine, np.int64))
            own_keys = [k for k, h in zip(every, hit) if h]
            at += [i] * len(own_keys)
            keys += own_keys
        at = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(keys, pa.binary())],
                                          ["id", "row", "key"])

    pairs = map_batches(held.where(F.col(hs).isNotNull()).select(id_, row, utf8(text), hs), suspected,
                        "id long, row long, key binary")
    return pairs, held.withColumn(mark, F.col(hs).isNotNull()).drop(id_, row_of, hs)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                counts: tuple[str, str] = ("__n_lines", "__n_dropped")) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``; all columns stay, and
    the numbers of lines before and of lines dropped are added in the columns
    named by ``counts`` (columns of these names are replaced).

    A line whose key has at least ``min_chars`` code points and is held by at
    least ``min_docs`` documents goes everywhere but in the largest doc_id
    holding it (where each of its repeats stays).  Defined cases: a null text
    has one empty line and stays null; rows that share a doc_id are one document
    for the count and are treated alike; a row with a null doc_id counts as no
    document and keeps its lines; a document that loses all its lines becomes
    an empty text; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    cols = [c for c in docs.columns if c not in counts]
    row, mark, id_, row_of, gone, new = fresh(docs, "__row", "__suspect", "__of_id", "__of_row", "__keys", "__new")
    # a row is known by its id and its text: what is gathered for it never exceeds its own lines
    docs = docs.select(*cols).withColumn(row, text_key(text))
    lines = line_count(docs, text)
    split = _by_broadcast if filter_bits(lines) <= MAX_FILTER_BITS else _by_ranges
    pairs, counted = split(docs, lines, text, doc_id, row, mark, min_chars)
    pairs = written(pairs)
    repeated = written(pairs.groupBy("key").agg(F.countDistinct("id").alias("docs"), F.max("id").alias("keeper"))
                       .where(F.col("docs") >= min_docs).select("key", "keeper"))
    drops = written(pairs.join(repeated, "key").where(F.col("id") != F.col("keeper"))
                    .groupBy(F.col("id").alias(id_), F.col("row").alias(row_of)).agg(F.collect_set("key").alias(gone)))

    @F.pandas_udf("text string, n long")
    def without(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out, n = [], []
        for t, gone in zip(texts, keys):
            lines = t.split(b"\n")
            gone = set() if gone is None else set(gone)
            kept = [x for x in lines if line_key(x) not in gone]
            out.append(b"\n".join(kept).decode())
            n.append(len(lines) - len(kept))
        return pd.DataFrame({"text": out, "n": n})

    n_lines, n_dropped = counts
    total = F.coalesce(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    counted = counted.withColumn(n_lines, total.cast("long"))
    clean = counted.where(~F.col(mark)).withColumn(n_dropped, F.lit(0).cast("long"))
    changed = counted.where(mark) \
        .join(drops, (F.col(doc_id).cast("long") == F.col(id_)) & (F.col(row) == F.col(row_of)), "left") \
        .withColumn(new, F.when(F.col(gone).isNotNull(), without(utf8(text), F.col(gone)))) \
        .withColumn(text, F.coalesce(F.col(new)["text"], F.col(text))) \
        .withColumn(n_dropped, F.coalesce(F.col(new)["n"], F.lit(0)).cast("long"))
    out = [*cols, n_lines, n_dropped]
    return clean.select(*out).unionByName(changed.select(*out))
