"""Operator 12 - phrase collocations by best-first branch-and-bound growth.

Phrases of 2 to ``longest`` words are scored by their weakest cut, for each
language: floor(2000000 a / (l + r)), where a, l and r count the phrase, its first
part and the rest.  Phrases grow to the right from prefixes.  Cutting behind
the first word gives an admissible bound for all that a prefix p can grow into,
from its count alone: an extension occurs a <= f(p) times and its rest at least
a times, so no extension scores more than floor(2000000 f(p) / (f(p1) + f(p))).

The frontier is expanded in batches, best bounds first.  A threshold for each
language starts below twice the wanted number of two-word scores; each level
counts, in one pass over the texts, the extensions of exactly those prefixes whose
bound reaches it.  Phrases that score that much also get their extensions to
the left counted, as a phrase goes if a longer one holds it with nearly its count (a
phrase one word longer decides, since counts fall with length).  So every phrase at
or above the threshold is known with its fate, ties included.  A language is settled
once enough of them survive, or its threshold is zero; the others go on with a
lower one.

Words are hashed to 64 bits (with the language); a hash that two words share is
looked for among all words, and the run starts anew with another seed then.
Tasks count blocks of text in numpy and Spark adds the counts up, combined on the
map side, so that no key is gathered.  What tasks know of words and prefixes are bit
arrays of at most ``MAX_BITS`` bits: more entries let more phrases be counted than
needed, whose counts are exact like all others, and change no result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_batches, written

SCALE = 2_000_000
TOP, MIN_COUNT, SHARE, LONGEST = 2000, 30, 80, 4
UNKNOWN = "und"
BLOCK = 4 << 20            # bytes of text that a task tokenises at once
BITS_PER_ENTRY = 16
MAX_BITS = 1 << 27         # of a bit array that tasks share: 16 MB
BUCKET = 1000              # scores are binned to find a threshold
FIRST_BATCH, GROWTH = 2, 4  # times TOP two-word scores lie above the first threshold; then more
_OUT_ROWS = 1 << 16

# ---- fixed values: A-Z to lower case, tab to blank, ends of pieces to line feed ----
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_UPPER + b"\t" + _ENDS, _LOWER + b" " + b"\n" * len(_ENDS))
# ------------------------------------------------------------------------------------
_SPACE, _END = 0x20, 0x0A


@dataclass
class Words:
    """Words of a block: number in ``distinct``, number of the piece, and how many of the
    first ones were counted with the block in front."""
    at: np.ndarray
    piece: np.ndarray
    distinct: list[bytes]
    seen: int


def tokenise(data: bytes, seen: int = 0) -> tuple[Words, bytes]:
    """Words of a translated block, and those at its end that a phrase can go on from
    (joined, without a separator behind)."""
    raw = np.frombuffer(data, np.uint8)
    end = raw == _END
    gap = end | (raw == _SPACE)
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends_before = np.cumsum(end, dtype=np.int32)
    piece = ends_before[starts] if len(starts) else np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                  [None, pa.py_buffer(offsets), pa.py_buffer(raw[~gap].tobytes())]).dictionary_encode()
    words = Words(coded.indices.to_numpy(), piece, coded.dictionary.to_pylist(), seen)
    carry = b""
    if len(starts) and piece[-1] == ends_before[-1]:
        last = max(len(starts) - (LONGEST - 1), int(np.searchsorted(piece, piece[-1])))
        carry = b" ".join(data[starts[i]:stops[i]] for i in range(last, len(starts)))
    return words, carry


def blocks(texts: Sequence[bytes], limit: int = BLOCK) -> Iterator[Words]:
    """All texts as blocks of words.  A text beyond ``limit`` is cut at separators, each
    block beginning with the last words of the one in front."""
    held, size = [], 0
    for t in texts:
        t = t.translate(_TABLE)
        if len(t) <= limit:
            held.append(t)
            size += len(t)
            if size > limit:
                yield tokenise(b"\n".join(held))[0]
                held, size = [], 0
            continue
        at, carry = 0, b""
        while at < len(t):
            stop = min(len(t), at + limit)
            near = [x for x in (t.find(b" ", stop), t.find(b"\n", stop)) if x >= 0]
            stop = min(near, default=len(t))
            seen = carry.count(b" ") + 1 if carry else 0
            words, carry = tokenise(carry + t[at:stop], seen)
            yield words
            at = stop
    if held:
        yield tokenise(b"\n".join(held))[0]


def hashes(words: Sequence[bytes], lang: str, seed: int) -> np.ndarray:
    own = xxhash.xxh64_intdigest(lang, seed)
    return np.fromiter((xxhash.xxh64_intdigest(w, own) for w in words), np.uint64, len(words))


def key(columns: Sequence[np.ndarray]) -> np.ndarray:
    """One 64-bit key of the hashes of a phrase's words."""
    out = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        out = (out ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(32)
    return out


def _bit_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(32)) & mask).astype(np.int64)


def has(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the bit array may hold."""
    out = np.ones(len(keys), bool)
    for at in _bit_places(keys, len(filter_) * 64):
        out &= (filter_[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def _bit_array(rows: DataFrame, columns: Sequence[str], most: int = MAX_BITS) -> np.ndarray:
    """Bit array of the rows' keys.  Set bits are combined in Spark; what comes to the
    driver is bounded by the array's size."""
    rows = rows.select(*columns)
    bits = 64
    n = rows.count()
    while bits < min(most, n * BITS_PER_ENTRY):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = key([c.to_numpy().view(np.uint64) for c in b.columns])
            at = np.concatenate(_bit_places(keys, bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))],
                names=["word", "bits"])
    out = np.zeros(bits // 64, np.uint64)
    if n:
        got = rows.mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _task_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """(lang, words) of a task's texts, gathered over batches up to a block."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
            size += len(text) + 64
            if size > BLOCK:
                for name, texts in held.items():
                    for words in blocks(texts):
                        yield name, words
                held, size = {}, 0
    for name, texts in held.items():
        for words in blocks(texts):
            yield name, words


def _slices(arrays: list[pa.Array], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(arrays, names=list(names))
    for lo in range(0, whole.num_rows, _OUT_ROWS):
        yield whole.slice(lo, _OUT_ROWS)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(h, lang, word, f) of all words of ``docs(lang, text)``, text as bytes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, w in _task_blocks(batches):
            n = np.bincount(w.at[w.seen:], minlength=len(w.distinct))
            there = np.flatnonzero(n)
            found = [w.distinct[i] for i in there.tolist()]
            yield from _slices([pa.array(hashes(found, lang, seed).view(np.int64)), pa.array([lang] * len(found)),
                                pa.array(found, pa.binary()).cast(pa.string()), pa.array(n[there])],
                               ("h", "lang", "word", "f"))
    return docs.mapInArrow(count, "h long, lang string, word string, f long") \
        .groupBy("h", "lang", "word").agg(F.sum("f").alias("f"))


def phrase_table(w: Words, size: int, h: np.ndarray, allowed: np.ndarray, wanted) -> tuple[list[np.ndarray], np.ndarray]:
    """Hash columns and counts of a block's phrases of ``size`` words: all words allowed, inside
    one piece, ending behind the words seen before, and picked by ``wanted``, which gets
    the hash columns and returns a mask (None: all)."""
    n = len(w.at) - size + 1
    if n <= 0:
        return [np.zeros(0, np.uint64)] * size, np.zeros(0, np.int64)
    ok = allowed[w.at]
    take = w.piece[:n] == w.piece[size - 1:]
    for j in range(size):
        take &= ok[j:n + j]
    take[:max(0, w.seen - size + 1)] = False
    at = np.flatnonzero(take)
    if wanted is not None and len(at):
        at = at[wanted([h[w.at[at + j]] for j in range(size)])]
    ids = [w.at[at + j].astype(np.int64) for j in range(size)]
    code, width = ids[0], len(w.distinct)
    for j in range(1, size):
        if j > 1:      # numbers of the distinct prefixes, so that the code stays within 63 bits
            _, code = np.unique(code, return_inverse=True)
        code = code * width + ids[j]
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return [h[x[first]] for x in ids], counts


def phrase_counts(docs: DataFrame, size: int, seed: int, min_count: int, words: np.ndarray,
                  prefixes: np.ndarray | None = None, suffixes: np.ndarray | None = None,
                  only: np.ndarray | None = None) -> DataFrame:
    """(h0.., a) of phrases that occur ``min_count`` times, written.

    Counted are those whose words may be in ``words`` and whose first words may be in
    ``prefixes`` or last words in ``suffixes`` (one word shorter), or which may be in ``only``."""
    columns = [f"h{i}" for i in range(size)]
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((words, prefixes, suffixes, only))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, prefixes, suffixes, only = shared.value

        def wanted(h: list[np.ndarray]) -> np.ndarray:
            if only is not None:
                return has(only, key(h))
            return has(prefixes, key(h[:-1])) | has(suffixes, key(h[1:]))
        for lang, w in _task_blocks(batches):
            h = hashes(w.distinct, lang, seed)
            cols, n = phrase_table(w, size, h, has(words, key([h])), wanted if size > 2 else None)
            yield from _slices([*(pa.array(c.view(np.int64)) for c in cols), pa.array(n)], (*columns, "a"))
    counts = docs.mapInArrow(count, ", ".join(f"{c} long" for c in (*columns, "a")))
    out = written(counts.groupBy(*columns).agg(F.sum("a").alias("a")).where(F.col("a") >= min_count))
    shared.unpersist()
    return out


def ratio(a: Column, over: Column) -> Column:
    """floor(SCALE * a / over), exact also where the product passes 64 bits."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * a.cast("decimal(20,0)")
    return F.call_function("div", wide, over.cast("decimal(20,0)"))


def _at(frame: DataFrame, size: int, first: int, name: str) -> DataFrame:
    """Counts of phrases of ``size`` words, to be joined to columns from h<first> on."""
    return frame.select(*[F.col(f"h{i}").alias(f"h{first + i}") for i in range(size)], F.col("a").alias(name))


def _scored(cuts: list[tuple[Column, Column]]) -> Column:
    """The weakest cut as (score, k, l, r); ties to the smallest k."""
    return F.array_min(F.array(*[
        F.struct(ratio(F.col("a"), left + right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
        for k, (left, right) in enumerate(cuts, 1)]))


def _with_bound(frame: DataFrame) -> DataFrame:
    return frame.select("*", "cut.score", "cut.l", "cut.r", ratio(F.col("a"), F.col("f0") + F.col("a")).alias("bound")) \
        .drop("cut", "f0")


def _thresholds(pairs: DataFrame, want: int) -> DataFrame:
    """(lang, least): the lower edge of the score bin down to which a language has
    ``want`` two-word phrases; 0 if it hasn't as many.  At most SCALE / BUCKET rows a language."""
    bins = pairs.groupBy("lang", F.floor(F.col("score") / BUCKET).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("bin"))
    reach = bins.withColumn("above", F.sum("n").over(w))
    return reach.groupBy("lang").agg(
        F.coalesce(F.max(F.when(F.col("above") >= want, F.col("bin") * BUCKET)), F.lit(0)).alias("least"))


def _survivors(phrases: DataFrame, longer: DataFrame | None, size: int, share: int) -> DataFrame:
    """Phrases that no phrase one word longer holds with ``share`` percent of their count."""
    if longer is None:
        return phrases
    own = [f"h{i}" for i in range(size)]
    held = longer.select(*own, F.col("a").alias("most")).unionByName(
        longer.select(*[F.col(f"h{i + 1}").alias(f"h{i}") for i in range(size)], F.col("a").alias("most"))) \
        .groupBy(*own).agg(F.max("most").alias("most"))
    return phrases.join(held, own, "left").where(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True))) \
        .drop("most")


def _grow(docs: DataFrame, seed: int, words: DataFrame, pairs: DataFrame, least: DataFrame, min_count: int,
          share: int, longest: int) -> DataFrame:
    """(lang, size, hs, a, l, r, score) of all surviving phrases that score at least their
    language's threshold, for the languages of ``least(lang, least)``."""
    limit = least.select(F.col("lang").alias("__lang"), "least")

    def reaching(frame: DataFrame, what: str) -> DataFrame:
        return frame.join(limit, F.col("lang") == F.col("__lang")).where(F.col(what) >= F.col("least")) \
            .drop("__lang", "least")
    known = _bit_array(reaching(words.withColumn("all", F.lit(SCALE)), "all"), ["h"])
    single = words.select(F.col("h").alias("h0"), F.col("f").alias("a"))
    counts = {1: single, 2: pairs}
    frontier = reaching(pairs, "bound")
    competing = {2: reaching(pairs, "score")}
    for size in range(3, longest + 1):
        cols = [f"h{i}" for i in range(size)]
        counts[size] = counted = phrase_counts(docs, size, seed, min_count, known,
                                               _bit_array(frontier, cols[:-1]), _bit_array(competing[size - 1], cols[:-1]))
        # only extensions of the frontier can reach the threshold; their prefixes are all counted
        grown = counted.join(frontier.select(*cols[:-1], "lang"), cols[:-1]) \
            .join(single.select("h0", F.col("a").alias("f0")), "h0")
        for k in range(2, size):
            grown = grown.join(_at(counts[k], k, 0, f"f0_{k}"), cols[:k])
        for m in range(1, size):
            part = _at(counts[m], m, size - m, f"r_{size - m}")
            grown = grown.join(part, cols[size - m:], "left" if m > 2 else "inner")
        grown = written(grown)
        left = {k: F.col("f0") if k == 1 else F.col(f"f0_{k}") for k in range(1, size)}
        for m in range(3, size):      # rests that the frontier didn't reach, where they can matter
            k = size - m
            sure = [j for j in range(1, size) if size - j <= 2 or size - j < m]
            at_most = F.least(*[ratio(F.col("a"), left[j] + F.col(f"r_{j}")) for j in sure],
                              ratio(F.col("a"), left[k] + F.col("a")))
            lost = reaching(grown.where(F.col(f"r_{k}").isNull()).withColumn("at_most", at_most), "at_most") \
                .select(*[F.col(c).alias(f"h{i}") for i, c in enumerate(cols[k:])]).distinct()
            lost = written(lost)
            if lost.isEmpty():
                grown = grown.where(F.col(f"r_{k}").isNotNull())
                continue
            more = phrase_counts(docs, m, seed, min_count, known, only=_bit_array(lost, [f"h{i}" for i in range(m)]))
            grown = written(grown.join(_at(more, m, k, "late"), cols[k:], "left")
                            .withColumn(f"r_{k}", F.coalesce(f"r_{k}", "late")).drop("late")
                            .where(F.col(f"r_{k}").isNotNull()))
        cuts = [(left[k], F.col(f"r_{k}")) for k in range(1, size)]
        scored = written(_with_bound(grown.select("lang", *cols, "a", "f0", _scored(cuts).alias("cut"))))
        frontier, competing[size] = reaching(scored, "bound"), reaching(scored, "score")
    out = None
    for size, rows in competing.items():
        cols = [f"h{i}" for i in range(size)]
        rows = _survivors(rows, counts.get(size + 1), size, share) \
            .select("lang", F.array(*cols).alias("hs"), "a", "l", "r", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def _named(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` with their words joined by blanks in ``phrase``."""
    names = words.select(F.col("h").alias("one"), "word")
    parts = phrases.select("lang", "hs", "a", "l", "r", "score", F.posexplode("hs").alias("pos", "one")).join(names, "one")
    return parts.groupBy("lang", "hs", "a", "l", "r", "score") \
        .agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("parts")) \
        .select("lang", F.concat_ws(" ", "parts.word").alias("phrase"), "a", "l", "r", "score")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, share: int = SHARE,
                 longest: int = LONGEST, lang: str = "lang", text: str = "text", seed: int = 0) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score and a,
    descending, then phrase.

    Texts are lower-cased (A-Z) and cut into pieces at . , ; : ! ? and line ends, pieces into
    words at blanks and tabs.  Candidates occur ``min_count`` times inside pieces; one goes
    if a longer candidate holds it with at least ``share`` percent of its count.

    Defined cases: a null lang is ``und``; null and empty texts hold no words; texts of any length
    count whole; repeated rows count each time; an empty table has no phrases; only the two named
    columns are read.  Equal scores and counts are ranked by the phrase's UTF-8 bytes.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"longest must be 2 to {LONGEST}")
    byte_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"),
                        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    while True:
        every = written(word_counts(texts, seed))
        if every.groupBy("h").count().where("count > 1").isEmpty():
            break
        seed += 1
    totals = written(every.groupBy("lang").agg(F.sum("f").alias("n")))
    words = written(every.where(F.col("f") >= min_count))
    pairs = phrase_counts(texts, 2, seed, min_count, _bit_array(words, ["h"]))
    first = words.select(F.col("h").alias("h0"), "lang", F.col("f").alias("f0"))
    second = words.select(F.col("h").alias("h1"), F.col("f").alias("f1"))
    scored = pairs.join(first, "h0").join(second, "h1") \
        .select("lang", "h0", "h1", "a", "f0", _scored([(F.col("f0"), F.col("f1"))]).alias("cut"))
    pairs = written(_with_bound(scored))
    open_, want, out = totals.select("lang"), FIRST_BATCH * top, None
    while True:
        least = written(_thresholds(pairs.join(open_, "lang", "left_semi"), want))
        found = written(_grow(texts, seed, words, pairs, least, min_count, share, longest))
        # a language without phrases has no threshold and is settled
        enough = least.join(found.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "left") \
            .withColumn("settled", (F.col("least") == 0) | (F.coalesce("n", F.lit(0)) >= top))
        enough = written(enough.select("lang", "settled"))
        part = found.join(enough.where("settled").select("lang"), "lang", "left_semi")
        out = part if out is None else out.unionByName(part)
        open_, want = enough.where(~F.col("settled")).select("lang"), want * GROWTH
        if open_.isEmpty():
            break
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return _named(out, words).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top) \
        .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
