"""Scoring expressions: the built-in lexicon scorer (U9), friction / label /
negative flag over any probability column (U2-U4) and the keyword category
rule (U7).  All native expressions, no Python in the row path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# ---- fixed values -----------------------------------------------------------
# Sentiment label order of every probability array in this library.
SENTIMENT_LABELS = ["negative", "neutral", "positive"]

# Default lexicon for the offline scorer (lowercase whole tokens).
NEGATIVE_WORDS = [
    "bad", "wrong", "broken", "fail", "failed", "fails", "failing", "poor",
    "ugly", "terrible", "awful", "horrible", "hate", "useless", "garbage",
    "nonsense", "confusing", "messy", "sloppy", "annoying", "incorrect",
    "trash", "scum", "idiot", "clown", "worthless", "moron", "pathetic",
    "loser", "stupid", "disgusting",
]
POSITIVE_WORDS = [
    "good", "great", "thanks", "thank", "nice", "excellent", "awesome",
    "love", "perfect", "helpful", "happy", "glad", "clear", "best", "better",
    "lgtm", "clean", "elegant", "neat",
]

# Friction categories and their keywords; a keyword scores when it occurs
# as a substring of the lowercased text.  Order breaks ties.
CATEGORY_KEYWORDS = {
    "Testing": ["test", "coverage", "unit", "integration", "mock", "assert", "pytest", "jest", "spec"],
    "Security": ["security", "vulnerab", "auth", "inject", "xss", "csrf", "secret", "password", "token"],
    "Code Style": ["format", "naming", "convention", "lint", "style", "indent", "camel", "snake"],
    "Logic": ["bug", "edge case", "algorithm", "correct", "null", "error", "exception", "logic", "fix"],
    "Documentation": ["doc", "comment", "readme", "docstring", "explain", "example", "description"],
}
OTHER_CATEGORY = "Other"
NOT_APPLICABLE = "N/A"
# ---------------------------------------------------------------------------

# Token = maximal run of letters, digits and underscore (Unicode aware).
TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"


def tokens(text) -> Column:
    return F.split(F.lower(col_(text)), TOKEN_SPLIT)


def hits(tok: Column, words: Sequence[str]) -> Column:
    ws = list(words)
    return F.size(F.filter(tok, lambda t: t.isin(ws)))


def lexicon_probs(text, negative: Sequence[str] = NEGATIVE_WORDS,
                  positive: Sequence[str] = POSITIVE_WORDS) -> Column:
    """[g, 1, h] / (g + h + 1) with g negative and h positive hits.

    Rational shares, so any engine computes the same doubles.  Most texts
    hold no lexicon word: a code-generated ``arrays_overlap`` test answers
    [0, 1, 0] for them, and only the rest pay for the per-token lambda."""
    words = list(negative) + list(positive)
    tok = tokens(text)
    lex = F.array(*[F.lit(w) for w in words])
    neutral = F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))

    def shares(n: Column) -> Column:
        z = n[0] + n[1] + F.lit(1.0)
        return F.array(n[0] / z, F.lit(1.0) / z, n[1] / z)
    counted = _once(F.filter(tok, lambda t: t.isin(words)), lambda found: _once(
        F.array(hits(found, negative).cast("double"), hits(found, positive).cast("double")), shares))
    # the text, not its tokens, is asked for null: they would be made once more
    return F.when(F.arrays_overlap(tok, lex), counted).when(col_(text).isNotNull(), neutral)


def friction(probs, labels: Sequence[str] = SENTIMENT_LABELS) -> Column:
    """The probability of 'negative'; 0 when that label is absent."""
    if "negative" not in labels:
        return F.lit(0.0)
    i = list(labels).index("negative") + 1
    return F.coalesce(F.try_element_at(col_(probs), F.lit(i)), F.lit(0.0))


def argmax_label(probs, labels: Sequence[str] = SENTIMENT_LABELS) -> Column:
    """Label of the largest probability, first one on ties."""
    p = col_(probs)
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]),
                            F.array_position(p, F.array_max(p)).cast("int"))


def is_negative(label) -> Column:
    """U4."""
    return col_(label) == F.lit("negative")


def _once(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, not inlined at each use."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _keyword_scores(low: Column, keyword_map: Mapping[str, Sequence[str]]) -> Column:
    per_cat = []
    for kws in keyword_map.values():
        s = F.lit(0)
        for kw in kws:
            s = s + low.contains(kw).cast("int")
        per_cat.append(s)
    return F.array(*per_cat)


def keyword_category(text, keyword_map: Mapping[str, Sequence[str]] = CATEGORY_KEYWORDS) -> Column:
    """Category with the most keyword hits; first on ties; 'Other' if none."""
    names = F.array(*[F.lit(k) for k in keyword_map])

    def winner(sc: Column) -> Column:
        best = F.array_max(sc)
        return F.when(F.coalesce(best, F.lit(0)) > 0,
                      F.try_element_at(names, F.array_position(sc, best).cast("int"))) \
            .otherwise(F.lit(OTHER_CATEGORY))
    return _once(F.lower(col_(text)), lambda low: _once(_keyword_scores(low, keyword_map), winner))


def assign_category(negative, category) -> Column:
    """Category for negative rows, 'N/A' elsewhere."""
    return F.when(F.coalesce(col_(negative), F.lit(False)), col_(category)) \
        .otherwise(F.lit(NOT_APPLICABLE))


def score_columns(df, text: str, probs_col: Column | None = None,
                  labels: Sequence[str] = SENTIMENT_LABELS):
    """Attach friction_score, sentiment_label, is_negative to ``df``."""
    p = probs_col if probs_col is not None else lexicon_probs(text)
    out = df.withColumn("_probs", p)
    return (out.withColumn("friction_score", friction("_probs", labels))
               .withColumn("sentiment_label", argmax_label("_probs", labels))
               .withColumn("is_negative", is_negative("sentiment_label"))
               .drop("_probs"))
