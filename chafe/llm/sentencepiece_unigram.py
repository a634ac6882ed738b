"""Operator 7 - SentencePiece encoding and decoding with a unigram Viterbi.

The pieces of a public vocabulary file stand in a double-array trie over their
UTF-8 bytes.  Encoding marks blanks with U+2581, puts one in front, and takes
the segmentation with the largest sum of log scores; a character without a
piece of its own falls back to its byte pieces.  Decoding joins pieces and
bytes, turns markers into blanks and removes the one in front, so every text
comes back exactly (a literal U+2581 is always written as bytes).

No piece has a marker behind another character and none holds a line feed, so
the best segmentation never crosses the point in front of a run of blanks or
a line feed.  Texts are cut there, and the distinct units of an Arrow batch
run through the trie together, all units of one length step by step.

The vocabulary file holds merge ranks, not log probabilities.  The log
score of a piece is that of a Zipf law over the ranks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_batches, small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0       # below the least score, as in the public library
_LITERAL = (0xF8, 0xF9, 0xFA)    # bytes no UTF-8 text holds stand for a literal marker's bytes
_CACHE_UNITS = 400_000
_LONG_UNIT = 48              # bytes; longer units go one by one


@dataclass
class Vocabulary:
    """Double array (base, check), piece id of each state (-1: none), score of
    each id, id of each byte, and the bytes that each id decodes to."""
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    byte_id: np.ndarray
    text: list[bytes]
    cut_lines: bool


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trie of the keys: the child of state s by byte c is base[s] + c if its
    check is s.  State 0 is the root."""
    kids: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for key, value in keys:
        s = 0
        for c in key:
            n = kids[s].get(c)
            if n is None:
                n = kids[s][c] = len(kids)
                kids.append({})
                ends.append(-1)
            s = n
        ends[s] = value
    size = 2 * len(kids) + 1024
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = bytearray(size)
    used[0], check[0] = 1, -2
    low, queue = 1, [(0, 0)]
    while queue:
        nxt = []
        for node, slot in queue:
            if not kids[node]:
                continue
            codes = sorted(kids[node])
            at = max(low, codes[0] + 1)
            while any(used[at - codes[0] + c] for c in codes):
                at += 1
            b = at - codes[0]
            if len(codes) > 32:
                low = max(low, at)
            while used[low]:
                low += 1
            base[slot] = b
            for c in codes:
                used[b + c], check[b + c] = 1, slot
                piece[b + c] = ends[kids[node][c]]
                nxt.append((kids[node][c], b + c))
            if at + 1024 > len(used) - 512:
                grow = len(used)
                used += bytearray(grow)
                base, check, piece = (np.concatenate([x, np.full(grow, f, np.int32)])
                                      for x, f in ((base, 0), (check, -1), (piece, -1)))
        queue = nxt
    return base, check, piece


def load_vocabulary(path: str) -> Vocabulary:
    """Read the pieces of a SentencePiece model file (on the driver)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    score = np.full(n, -np.inf)
    score[normal] = -np.log(np.arange(1, len(normal) + 1)) - np.log((1.0 / np.arange(1, len(normal) + 1)).sum())
    byte_id = np.full(256, -1, np.int64)
    text = [b""] * n
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_id[int(p[1:-1], 16)] = i
            text[i] = bytes([int(p[1:-1], 16)])
        elif score[i] > -np.inf:
            text[i] = p.replace(MARK, " ").encode()
    if (byte_id < 0).any():
        raise ValueError("the vocabulary has no byte pieces")
    pieces = [sp.id_to_piece(i) for i in normal]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece holds a marker behind another character")
    base, check, piece = double_array([(p.encode(), i) for p, i in zip(pieces, normal)])
    return Vocabulary(base, check, piece, score, byte_id, text, not any("\n" in p for p in pieces))


def unit_bytes(unit: str) -> bytes:
    return unit.encode().replace(MARK.encode(), bytes(_LITERAL)).replace(b" ", MARK.encode())


def _char_starts(raw: np.ndarray) -> np.ndarray:
    return (raw & 0xC0) != 0x80


def viterbi(units: np.ndarray, v: Vocabulary) -> list[list[int]]:
    """Best piece ids of equally long byte units, given as a matrix of bytes.

    Ties go to the longer last piece.  A character without a piece of its own
    counts as one unknown and yields its byte pieces.
    """
    rows, size = units.shape
    starts = _char_starts(units)
    best = np.full((rows, size + 1), -np.inf)
    best[:, 0] = 0.0
    came = np.zeros((rows, size + 1), np.int32)
    took = np.full((rows, size + 1), -1, np.int32)
    unknown = v.score[np.isfinite(v.score)].min() - UNKNOWN_PENALTY
    limit = len(v.check)
    # where the character that starts here ends
    ends = np.full((rows, size + 1), size, np.int32)
    for s in range(size - 1, 0, -1):
        ends[:, s] = np.where(starts[:, s], s, ends[:, s + 1])
    for s in range(size):
        row = np.flatnonzero(starts[:, s] & np.isfinite(best[:, s]))
        if not len(row):
            continue
        whole = np.zeros(rows, bool)       # has a piece of exactly this character
        end_of = ends[:, s + 1]
        state, alive, here = np.zeros(len(row), np.int64), row, best[:, s]
        for e in range(s, size):
            to = v.base[state] + units[alive, e].astype(np.int64)
            ok = (to < limit) & (to > 0)
            ok[ok] = v.check[to[ok]] == state[ok]
            state, alive = to[ok], alive[ok]
            if not len(alive):
                break
            p = v.piece[state]
            hit = p >= 0
            r, p = alive[hit], p[hit]
            whole[r[end_of[r] == e + 1]] = True
            total = here[r] + v.score[p]
            up = total > best[r, e + 1]
            r = r[up]
            best[r, e + 1], came[r, e + 1], took[r, e + 1] = total[up], s, p[up]
        row = row[~whole[row]]
        e = end_of[row]
        total = here[row] + unknown
        up = total > best[row, e]
        row, e = row[up], e[up]
        best[row, e], came[row, e], took[row, e] = total[up], s, -1
    out = []
    for r in range(rows):
        ids, e = [], size
        while e:
            s = came[r, e]
            if took[r, e] >= 0:
                ids.append(int(took[r, e]))
            else:
                ids += [int(v.byte_id[b]) for b in reversed(_real(units[r, s:e]))]
            e = s
        out.append(ids[::-1])
    return out


def _real(raw: np.ndarray) -> list[int]:
    mark = MARK.encode()
    return [mark[_LITERAL.index(b)] if b in _LITERAL else b for b in raw.tolist()]


def viterbi_long(raw: bytes, v: Vocabulary) -> list[int]:
    """The same for one unit of any length, in time linear in it."""
    base, check, piece, score = v.base, v.check, v.piece, v.score
    unknown = score[np.isfinite(score)].min() - UNKNOWN_PENALTY
    size, limit = len(raw), len(check)
    best, came, took = [-np.inf] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
    best[0] = 0.0
    for s in range(size):
        if raw[s] & 0xC0 == 0x80 or best[s] == -np.inf:
            continue
        end = s + 1
        while end < size and raw[end] & 0xC0 == 0x80:
            end += 1
        state, whole = 0, False
        for e in range(s, size):
            to = int(base[state]) + raw[e]
            if not 0 < to < limit or check[to] != state:
                break
            state = to
            p = piece[to]
            if p >= 0:
                whole |= e + 1 == end
                total = best[s] + score[p]
                if total > best[e + 1]:
                    best[e + 1], came[e + 1], took[e + 1] = total, s, int(p)
        if not whole and best[s] + unknown > best[end]:
            best[end], came[end], took[end] = best[s] + unknown, s, -1
    ids, e = [], size
    while e:
        s = came[e]
        if took[e] >= 0:
            ids.append(took[e])
        else:
            ids += [int(v.byte_id[b]) for b in reversed(_real(np.frombuffer(raw[s:e], np.uint8)))]
        e = s
    return ids[::-1]


class Encoder:
    """Encodes batches of texts, remembering a bounded number of units."""

    def __init__(self, v: Vocabulary, cache_units: int = _CACHE_UNITS):
        self.v, self.known, self.cache_units = v, {}, cache_units
        self.cut = re.compile(r"\n| *[^ \n]+| +" if v.cut_lines else r" *[^ ]+| +")

    def learn(self, units: set[str]) -> None:
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for u in units:
            raw = unit_bytes(u)
            if len(raw) > _LONG_UNIT:
                self.known[u] = np.array(viterbi_long(raw, self.v), np.int32).tobytes()
            else:
                by_size.setdefault(len(raw), []).append((u, raw))
        for size, group in by_size.items():
            m = np.frombuffer(b"".join(r for _, r in group), np.uint8).reshape(-1, size)
            for (u, _), ids in zip(group, viterbi(m, self.v)):
                self.known[u] = np.array(ids, np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > self.cache_units:
            self.known.clear()
        cut = [self.cut.findall(" " + t) if t else [] for t in texts]
        fresh = set().union(*cut).difference(self.known)
        self.learn(fresh)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, c)), np.int32) for c in cut]


def decode_ids(ids, text: list[bytes]) -> str:
    """Pieces and bytes joined, markers as blanks, the blank in front removed."""
    return b"".join(map(text.__getitem__, ids))[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "__ids") -> DataFrame:
    """``docs`` with the array of piece ids in ``out``.

    Null and empty texts have no ids; texts are encoded whole, whatever their
    length; other columns stay as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    v = load_vocabulary(model_path)
    shared = spark.sparkContext.broadcast((v.base, v.check, v.piece, v.score, v.byte_id, v.text, v.cut_lines))

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = Encoder(Vocabulary(*shared.value))
        for s in batches:
            yield pd.Series(e.encode(s.tolist()), dtype=object)
    return docs.withColumn(out, ids(F.col(text)))


def decode(encoded: DataFrame, model_path: str, ids: str = "__ids", out: str = "__text") -> DataFrame:
    """The text of each array of ids in ``out``; a null array decodes to an empty text."""
    spark = encoded.sparkSession
    pieces = spark.sparkContext.broadcast(load_vocabulary(model_path).text)

    @F.pandas_udf("string")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(["" if x is None else decode_ids(x.tolist(), pieces.value) for x in s], dtype=object)
    return encoded.withColumn(out, back(F.col(ids)))


def round_trip(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids",
               out: str = "decoded") -> DataFrame:
    """``docs`` with the piece ids of ``text`` in ``ids`` and the text decoded from
    them in ``out``, both from one Python worker a task.

    One pass holds one vocabulary and one cache of units where ``encode`` and
    ``decode`` behind each other hold two; batches are bounded in bytes.  Null
    and empty texts have no ids and an empty decoded text.  ``ids`` and ``out``
    must not be columns of ``docs``.
    """
    clash = {ids, out} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    spark = docs.sparkSession
    byte_batches(spark)
    v = load_vocabulary(model_path)
    shared = spark.sparkContext.broadcast((v.base, v.check, v.piece, v.score, v.byte_id, v.text, v.cut_lines))
    at = docs.columns.index(text)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*shared.value)
        e = Encoder(vocabulary, _CACHE_UNITS // 4)
        for b in batches:
            coded = e.encode(b.column(at).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *coded])
            back = [decode_ids(c.tolist(), vocabulary.text) for c in coded]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
                 pa.array(back, pa.string())], names=[*b.schema.names, ids, out])
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())),
                           T.StructField(out, T.StringType())])
    return docs.mapInArrow(both, schema)
