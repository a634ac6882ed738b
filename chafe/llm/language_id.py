"""Operator 10 - language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every
substring of it.  A text is cross-parsed: from each point the longest match in
the language's text is one phrase, and the next phrase starts behind it; the
language needing fewest phrases wins, with the phrases normalised to
phrases * (LENGTH_BITS + log2(length of the language's text)) / symbols of the document:
a phrase names a place in that text and a length.  (Without the length's bits a
language of one short text would win short documents, its places being cheap.)

Texts are read as symbols: the code point of a letter, and one symbol for each run of
non-letters.  Pieces of PIECE symbols walk all automata at once, one vectorised step
per symbol.  Each piece is parsed from its own start; its last phrase then runs on into the
next pieces until it ends where a phrase of theirs begins.  From there on the two
parses are the same, so following these meeting points from the start of a text
gives its parse as a whole, whatever the piece length.
Learning reads a bounded number of documents per language, whole; every text
is parsed whole.  Transitions are kept sparse, so the alphabet may have any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import group_side
from .common import byte_batches, crc32_bucket, text_key

TRAIN_DOCS = 40             # rows that a language's automaton is built from, at most
LENGTH_BITS = 8.0           # what the length of a phrase costs
PIECE = 512                 # symbols that a piece is parsed for
BLOCK_SYMBOLS = 4_000_000   # symbols x languages parsed at a time (one text at least)
SPACE = 0
UNDETERMINED = "und"


def suffix_edges(symbols: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix automaton of a sequence: number of states (1 is the start, 0 is none),
    and from, symbol and to of its transitions."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in symbols.tolist():
        cur = len(nxt)
        nxt.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    size = [len(t) for t in nxt]
    return (len(nxt), np.repeat(np.arange(len(nxt)), size), np.array([c for t in nxt for c in t], np.int64),
            np.array([to for t in nxt for to in t.values()], np.int64))


def suffix_automaton(symbols: np.ndarray, width: int) -> np.ndarray:
    """The same as a dense table over ``width`` symbols, 0 for no transition."""
    n, state, c, to = suffix_edges(symbols)
    table = np.zeros((n, width), np.int32)
    table[state, c] = to
    return table


class Transitions:
    """state, symbol -> state as an open hash table with linear probing, 0 for none."""

    def __init__(self, width: int, keys: np.ndarray, to: np.ndarray):
        self.width, self.keys, self.to = width, keys, to
        self.mask, self.shift = len(keys) - 1, np.uint64(65 - len(keys).bit_length())

    def parts(self) -> tuple:
        return self.width, self.keys, self.to

    @classmethod
    def of_edges(cls, width: int, state: np.ndarray, symbol: np.ndarray, to: np.ndarray) -> Transitions:
        slots = 1 << max(4, (2 * len(state)).bit_length())
        t = cls(width, np.full(slots, -1, np.int64), np.zeros(slots, np.int32))
        key = state.astype(np.int64) * width + symbol
        at = t._slot(key)
        while len(key):
            free = np.flatnonzero(t.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            t.keys[at[put]], t.to[at[put]] = key[put], to[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, to, at = key[rest], to[rest], (at[rest] + 1) & t.mask
        return t

    @classmethod
    def of_table(cls, table: np.ndarray) -> Transitions:
        state, symbol = np.nonzero(table)
        return cls.of_edges(table.shape[1], state, symbol, table[state, symbol])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = (state * self.width + symbol).reshape(-1)
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.to[at], 0)
        todo = np.flatnonzero((found != key) & (found >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            k, found = key[todo], self.keys[at]
            hit = found == k
            out[todo[hit]] = self.to[at[hit]]
            on = ~hit & (found >= 0)
            todo, at = todo[on], at[on]
        return out.reshape(state.shape)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)


def _letters() -> np.ndarray:
    """Symbol of each code point: itself if it is a letter, else SPACE."""
    import sys
    return np.fromiter((c if chr(c).isalpha() else SPACE for c in range(sys.maxunicode + 1)),
                       np.int32, sys.maxunicode + 1)


def symbols_of(text: str | None, symbol: np.ndarray) -> np.ndarray:
    """The text as symbols, each run of non-letters as one SPACE."""
    s = symbol[code_points(text)]
    return s[~((s == SPACE) & np.r_[False, s[:-1] == SPACE])]


class LanguageModel:
    """names; symbol of each code point; the transitions of all automata, as parts of
    Transitions or a dense table (their starts in ``starts``), and what a phrase costs in each."""

    def __init__(self, names: list[str], symbol: np.ndarray, table: tuple | np.ndarray, starts: np.ndarray,
                 logs: np.ndarray):
        table = Transitions.of_table(table) if isinstance(table, np.ndarray) else Transitions(*table)
        self.names, self.symbol, self.table, self.starts, self.logs = names, symbol, table, starts, logs

    def parts(self) -> tuple:
        return self.names, self.symbol, self.table.parts(), self.starts, self.logs

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Phrases of each document (rows) in each language (columns)."""
        total = np.zeros((len(docs), len(self.names)), np.int64)
        ends = np.cumsum([len(d) for d in docs])
        a = 0
        while a < len(docs):
            room = max(1, BLOCK_SYMBOLS // len(self.names)) + (ends[a - 1] if a else 0)
            b = max(a + 1, int(np.searchsorted(ends, room, side="right")))
            # a text too long for all languages at once takes them in turns
            n_lang = max(1, min(len(self.names), BLOCK_SYMBOLS // max(1, sum(len(d) for d in docs[a:b]))))
            for lang in range(0, len(self.names), n_lang):
                total[a:b, lang:lang + n_lang] = self._phrases(docs[a:b], self.starts[lang:lang + n_lang])
            a = b
        return total

    def _advance(self, state: np.ndarray, start: np.ndarray, symbol: np.ndarray):
        """(state behind the symbol, whether a phrase begins at it); a state equal to its
        automaton's start: the open phrase is empty."""
        to = self.table.step(state, symbol)
        stop = np.flatnonzero(to == 0)
        begins = state == start
        if len(stop):
            begins[stop] = True
            again = self.table.step(start[stop], symbol[stop])
            # a symbol that the language never has is a phrase of its own
            to[stop] = np.where(again == 0, start[stop], again)
        return to, begins

    def _phrases(self, docs: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
        n_lang, size = len(starts), np.array([len(d) for d in docs])
        flat = np.concatenate(docs).astype(np.int64) if size.sum() else np.empty(0, np.int64)
        n, pieces = len(flat), -(-size // PIECE)
        n_pieces = int(pieces.sum())
        if not n_pieces:
            return np.zeros((len(docs), n_lang), np.int64)
        doc = np.repeat(np.arange(len(docs)), pieces)
        doc_at, first = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(pieces)]
        at = doc_at[doc] + PIECE * (np.arange(n_pieces) - first[doc])      # where each piece begins
        end = np.minimum(at + PIECE, doc_at[doc + 1])
        # every piece from its own start; lanes are (language, piece), long pieces first
        order = np.argsort(at - end, kind="stable")
        live = np.searchsorted((at - end)[order], -np.arange(PIECE), side="left")
        state = np.repeat(starts[:, None], n_pieces, axis=1)               # in the order of ``order``
        start = state.copy()
        begins = np.zeros((n_lang, n), bool)                               # a phrase begins at this symbol
        for i in range(PIECE):
            m = live[i]
            if not m:
                break
            where = at[order[:m]] + i
            to, b = self._advance(state[:, :m].reshape(-1), start[:, :m].reshape(-1), np.tile(flat[where], n_lang))
            state[:, :m] = to.reshape(n_lang, m)
            begins[:, where] = b.reshape(n_lang, m)
        before = np.zeros((n_lang, n + 1), np.int32)                       # phrases that begin in front of a symbol
        np.cumsum(begins, axis=1, out=before[:, 1:])
        # the last phrase of each piece, and what follows, up to where it meets another parse
        lang, lane = np.repeat(np.arange(n_lang), n_pieces), np.tile(order, n_lang)
        meets = np.full((n_lang, n_pieces), -1)                            # -1: at the end of the text
        extra = np.zeros((n_lang, n_pieces), np.int64)                     # phrases begun behind the piece
        state, start, pos, stop = state.reshape(-1), start.reshape(-1), end[lane], doc_at[doc[lane] + 1]
        while True:
            on = np.flatnonzero(pos < stop)
            if not len(on):
                break
            lang, lane, state, start, pos, stop = (v[on] for v in (lang, lane, state, start, pos, stop))
            state, b = self._advance(state, start, flat[pos])
            met = b & begins[lang, pos]
            meets[lang[met], lane[met]] = pos[met]
            extra[lang, lane] += b & ~met
            pos = np.where(met, stop, pos + 1)
        # follow the meeting points through each text
        total = np.zeros((len(docs), n_lang), np.int64)
        d, lang = (v.reshape(-1) for v in np.meshgrid(np.flatnonzero(size), np.arange(n_lang), indexing="ij"))
        pos = doc_at[d]
        while len(d):
            piece = first[d] + (pos - doc_at[d]) // PIECE
            total[d, lang] += before[lang, end[piece]] - before[lang, pos] + extra[lang, piece]
            pos = meets[lang, piece]
            on = pos >= 0
            d, lang, pos = d[on], lang[on], pos[on]
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; score: how far the second language lies
        behind, as a share of its normalised phrases."""
        docs = [symbols_of(t, self.symbol) for t in texts]
        cost = self.phrases(docs) * self.logs[None, :]
        best = cost.argmin(axis=1)
        order = np.sort(cost, axis=1)
        second = order[:, 1] if cost.shape[1] > 1 else np.where(order[:, 0] > 0, 2 * order[:, 0], 1)
        score = np.where(second > 0, 1.0 - order[:, 0] / np.maximum(second, 1e-12), 0.0)
        names = [self.names[b] if (d != SPACE).any() else UNDETERMINED for b, d in zip(best, docs)]
        return names, np.where([n == UNDETERMINED for n in names], 0.0, score)


def training_sample(docs: DataFrame) -> DataFrame:
    """(lang, text): TRAIN_DOCS rows of each language at most, whole and with different
    texts, the first ones by a hash of id and text, from rows whose crc32 of the id as
    text, modulo 5, is not 0."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                       & (crc32_bucket("doc_id", 5) != 0)) \
        .select("lang", "text", F.xxhash64("doc_id", "text").alias("__h"), text_key().alias("__key"))
    per = learn.groupBy("lang").agg(F.count("*").alias("__n"))
    # a first cut for cheap sorting: eight times as many rows as needed
    share = group_side(per.select(F.col("lang").alias("__lang"), (F.lit(8.0 * TRAIN_DOCS) / F.col("__n")).alias("__p")))
    part = F.pmod("__h", F.lit(1_000_000)) / F.lit(1_000_000.0)
    some = learn.join(share, F.col("lang") == F.col("__lang")).where(part < F.col("__p")) \
        .groupBy("lang", "__key").agg(F.min("__h").alias("__h"), F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("__h", "__key"))
    return some.withColumn("__nth", nth).where(F.col("__nth") <= TRAIN_DOCS).select("lang", "text", "__nth")


def _automaton(rows: pd.DataFrame) -> pd.DataFrame:
    """The automaton of one language's sampled texts, its arrays as bytes."""
    symbol = _letters()
    text = np.concatenate([symbols_of(t, symbol) for t in rows.sort_values("__nth")["text"]])
    n, *edges = suffix_edges(text)
    return pd.DataFrame([[rows["lang"].iloc[0], n, len(text), *(e.astype(np.int32).tobytes() for e in edges)]],
                        columns=["lang", "states", "symbols", "state", "symbol", "to"])


def learn(docs: DataFrame) -> LanguageModel | None:
    """One automaton for each label, built by a task each; None without labelled text.
    The driver and every worker hold the model: some 6 transitions for each sampled character."""
    rows = training_sample(docs).groupBy("lang").applyInPandas(
        _automaton, "lang string, states long, symbols long, state binary, symbol binary, to binary").collect()
    if not rows:
        return None
    edges, starts, logs, at = [], [], [], 0
    rows.sort(key=lambda r: r["lang"])
    for r in rows:
        state, c, to = (np.frombuffer(r[k], np.int32).astype(np.int64) for k in ("state", "symbol", "to"))
        starts.append(at + 1)
        edges.append((state + at, c, to + at))
        logs.append(LENGTH_BITS + np.log2(max(2, r["symbols"])))
        at += r["states"]
    symbol = _letters()
    table = Transitions.of_edges(len(symbol), *map(np.concatenate, zip(*edges)))
    return LanguageModel([r["lang"] for r in rows], symbol, table.parts(), np.array(starts), np.array(logs))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    Defined cases: a null text or one without a letter is ``und`` with score 0, and
    so is every text if no document has a label; ties go to the first language
    by name; repeated rows each return a row; a null doc_id is predicted, not
    learnt from, and not held out; other columns are not read.
    """
    spark = docs.sparkSession
    byte_batches(spark)
    model = learn(docs)
    shared = spark.sparkContext.broadcast(model.parts() if model else None)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = LanguageModel(*shared.value) if shared.value else None
        for s in batches:
            lang, score = m.predict(s.tolist()) if m else ([UNDETERMINED] * len(s), np.zeros(len(s)))
            yield pd.DataFrame({"lang": lang, "score": score})
    return docs.select("doc_id", predict(F.col("text")).alias("__p")).select(
        "doc_id", F.coalesce(crc32_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("__p.lang").alias("lang_pred"), F.col("__p.score").alias("score"))
