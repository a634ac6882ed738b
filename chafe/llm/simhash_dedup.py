"""Operator 1 - SimHash near-dedup with a segment-popcount embedding.

Each text becomes a 64-bit SimHash over its word shingles.  Distinct
fingerprints are embedded as 24 popcounts, one for each segment of 3 or 2
bits.  The Manhattan distance of two such points never exceeds the Hamming
distance of the fingerprints, so a range join on the integer grid of points is
a lossless candidate search.  Radius 2 is split between the sides: a
fingerprint enters every grid cell within Manhattan distance 1 of its point
(49 cells), and two points within distance 2 meet in at least one cell.  Two
unrelated fingerprints meet with probability about 2e-9, so false candidates
stay below the number of entries up to some 10^10 documents.

Verification is exact and never pairs a crowded cell: within a shared cell a
fingerprint stands for the bit patterns of that cell one flip (or none) away
from it.  Two fingerprints within Hamming distance 2 share such a pattern, and
two that share one are within distance 2.  Linking each sharer to the least
one gives a star for every pattern (of 65 fingerprints at most), linear in the
number of fingerprints however many near copies a group has, with the same
components as all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, small_batches, text_key, utf8, written
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2           # the cell ranges below are built for this radius
SEED = 42
SEGMENTS = [3] * 16 + [2] * 8          # widths in bits
_CHUNK = 1 << 15       # shingles counted at a time (bounds memory on long texts)


def simhash64(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text: a bit is 1 when set in over half the shingle hashes.

    A-Z is lower-cased, words are runs without ASCII white space, repeated
    shingles count each time; fewer words than a shingle has: one shingle of
    all of them; no word: zero.
    """
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8",
                         count=max(1, len(parts) - words + 1))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        block = hashes[at:at + _CHUNK]
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, key, fp): the text_key(), and the 64 bits as a signed long.  Null text
    counts as empty."""
    small_batches(docs.sparkSession)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([simhash64(t, words) for t in b.column(2).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))],
                                          ["doc_id", "key", "fp"])
    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("key"),
                                   utf8(text).alias("t")), one, "doc_id long, key long, fp long")


def _long(v: int) -> Column:
    """A 64-bit pattern (or a plain number) as a signed long."""
    return F.lit(v - (1 << 64) if v >= 1 << 63 else v).cast("long")


def _weights() -> list[int]:
    """Place value of each segment in a cell number.  A coordinate runs from -1
    to width + 1 (one step past the popcounts), so its radix is width + 3; the
    product of all radices is below 2^63."""
    out, w = [], 1
    for width in SEGMENTS:
        out.append(w)
        w *= width + 3
    return out


_WEIGHTS = _weights()
_BIT_WEIGHTS = [w for w, width in zip(_WEIGHTS, SEGMENTS) for _ in range(width)]


def segment_point(fp: Column) -> Column:
    """Cell number of the point of popcounts (each coordinate raised by 1):
    every set bit adds its segment's place value."""
    point = F.lit(sum(_WEIGHTS)).cast("long")
    for i, w in enumerate(_BIT_WEIGHTS):
        point = point + F.shiftrightunsigned(fp, i).bitwiseAND(_long(1)) * _long(w)
    return point


def _entries(fps: DataFrame) -> DataFrame:
    """(fp, cell, pattern): the 65 patterns within one flip of a fingerprint,
    each in its grid cell.  A flip moves the point one step in its segment, up
    if the bit was 0 and down if it was 1."""
    flips = F.array(*[F.struct(_long(f).alias("flip"), _long(w).alias("step"))
                      for f, w in [(0, 0), *((1 << i, w) for i, w in enumerate(_BIT_WEIGHTS))]])
    one = fps.select("fp", segment_point(F.col("fp")).alias("point")).select("fp", "point", F.explode(flips).alias("f"))
    up = F.col("fp").bitwiseAND(F.col("f.flip")) == 0
    return one.select("fp", F.when(up, F.col("point") + F.col("f.step"))
                      .otherwise(F.col("point") - F.col("f.step")).alias("cell"),
                      F.col("fp").bitwiseXOR(F.col("f.flip")).alias("pattern"))


def _cells(fps: DataFrame) -> DataFrame:
    """(fp, cell): the grid cells within Manhattan distance 1."""
    point = F.col("point")
    steps = [s for w in _WEIGHTS for s in (_long(w), _long(-w))]
    return fps.select("fp", segment_point(F.col("fp")).alias("point")) \
        .select("fp", F.explode(F.array(point, *[point + s for s in steps])).alias("cell"))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): verified links between distinct fingerprints, a the star's centre.

    Step 1 (range join): grid cells that two or more fingerprints enter.
    Step 2 (verify): in those cells only, fingerprints that share a bit
    pattern; every link is checked to differ in at most MAX_BITS bits.
    """
    crowded = written(_cells(fps).groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
                      .where(F.col("lo") != F.col("hi")).select("cell"))
    # fingerprints with a candidate partner; all others are done.  Both inputs
    # are scans, so the join can split a cell that a large group crowds.
    # (merge hints: a generator's rows are not in the planner's size estimate.)
    near = written(_cells(fps).hint("merge").join(crowded, "cell").select("fp").distinct())
    entries = _entries(near)
    stars = entries.groupBy("cell", "pattern").agg(F.min("fp").alias("a"), F.max("fp").alias("hi")) \
        .where(F.col("a") != F.col("hi")).select("cell", "pattern", "a")
    return entries.hint("merge").join(stars, ["cell", "pattern"]).where(F.col("fp") != F.col("a")) \
        .select("a", F.col("fp").alias("b")) \
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).distinct()


def _labelled(reps: DataFrame) -> DataFrame:
    """``reps`` (fp and other columns) with the label of each fingerprint's component."""
    labels = connected_components(written(links(reps.select("fp"))))
    return written(reps.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
                   .select(*reps.columns, F.coalesce("label", "fp").alias("label")))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    component_id is the least doc_id reachable over links of at most
    ``max_bits`` differing bits.  Defined cases: null or empty text has
    fingerprint zero and links like any other; repeated rows each return a row;
    a null doc_id keeps its row and links, but never names a component (it is
    null only if no member has an id); other columns of ``docs`` are not read,
    so their names cannot clash; an empty table returns no rows.
    """
    if max_bits != MAX_BITS:
        raise ValueError(f"the grid ranges are built for {MAX_BITS} differing bits")
    rows = written(fingerprints(docs, text, doc_id, words).drop("key"))
    reps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    named = _labelled(reps)
    least = written(named.groupBy("label").agg(F.min("rep").alias("component_id")))
    by_fp = written(named.join(least, "label").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first_of_each(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the least doc_id (of
    rows that share it, the least text_key()).

    All columns stay.  Rows are judged by (doc_id, text), so the other texts of
    a repeated id stay with their own groups; of rows equal in both one stays.
    A row without an id stays only where no member of its group has an id.
    Only ids and hashes are shuffled, and the rows of repeated ones.
    """
    rows = written(fingerprints(docs, words=words))
    # least (id, key) of the rows with an id, least key of those without
    mine = F.struct("doc_id", "key")
    noid = F.col("doc_id").isNull()
    best = [F.min(F.when(~noid, mine)).alias("named"), F.min(F.when(noid, F.col("key"))).alias("unnamed")]
    reps = written(rows.groupBy("fp").agg(*best))
    labelled = _labelled(reps)
    least = labelled.groupBy("label").agg(F.min("named").alias("keep"), F.min("unnamed").alias("keep_unnamed"))
    by_fp = written(labelled.select("fp", "label").join(written(least), "label").select("fp", "keep", "keep_unnamed"))
    stays = F.when(noid, F.col("keep").isNull() & (F.col("key") == F.col("keep_unnamed"))).otherwise(mine == F.col("keep"))
    gone = written(rows.join(by_fp, "fp").where(~stays)
                   .select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct())
    twice = written(rows.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).count()
                    .where("count > 1").drop("count"))

    def same(d: DataFrame, keys: DataFrame) -> Column:
        return d["doc_id"].eqNullSafe(keys["__id"]) & (text_key() == keys["__key"])
    kept = docs.join(gone, same(docs, gone), "left_anti")
    nth = Window.partitionBy("doc_id", text_key()).orderBy(F.xxhash64(*docs.columns))
    first = kept.join(twice, same(kept, twice), "left_semi").withColumn("__nth", F.row_number().over(nth)) \
        .where("__nth = 1").select(*docs.columns)
    return kept.join(twice, same(kept, twice), "left_anti").unionByName(first)
