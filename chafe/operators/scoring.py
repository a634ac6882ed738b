"""Model scoring behind a pluggable predictor.

Models run through ``pyspark.ml.functions.predict_batch_udf``: Arrow batches
of ``batch_size`` texts, the model built once per Python worker by the
user's ``make_predict_fn``.  Offline defaults are a lexicon predictor (the
same rational shares as the native scorer) and a keyword classifier, so
the batch path is testable without downloading models.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import (CATEGORY_KEYWORDS, NEGATIVE_WORDS, OTHER_CATEGORY,
                                 POSITIVE_WORDS, SENTIMENT_LABELS, argmax_label, friction,
                                 is_negative, keyword_category)
from ..functions.text import col_
from ..session import scratch_table

_TOKEN = re.compile(r"[^\w]+")


def make_lexicon_predictor(negative: Sequence[str] = NEGATIVE_WORDS,
                           positive: Sequence[str] = POSITIVE_WORDS) -> Callable:
    """``make_predict_fn`` for U1: numpy batch -> [neg, neu, pos] rows."""
    neg, pos = frozenset(negative), frozenset(positive)

    def make():
        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.empty((len(texts), 3), dtype=np.float64)
            for i, t in enumerate(texts):
                toks = _TOKEN.split(str(t).lower())
                g = float(sum(1 for w in toks if w in neg))
                h = float(sum(1 for w in toks if w in pos))
                z = g + h + 1.0
                out[i] = (g / z, 1.0 / z, h / z)
            return out
        return predict
    return make


def make_keyword_classifier(keyword_map=CATEGORY_KEYWORDS, labels=None) -> Callable:
    """``make_predict_fn`` for U6: the index of the winning label (-1 = none)."""
    names = list(labels or keyword_map)
    kws = [keyword_map[n] for n in names]

    def make():
        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.empty(len(texts), dtype=np.int32)
            for i, t in enumerate(texts):
                low = str(t).lower()
                sc = [sum(1 for k in ks if k in low) for ks in kws]
                best = max(sc)
                out[i] = sc.index(best) if best > 0 else -1
            return out
        return predict
    return make


def unlabelled_on_error(make_predict_fn: Callable) -> Callable:
    """U8: a batch that the predictor fails on is tried text by text, and a text that
    it still fails on gets -1 (no label)."""
    def make():
        predict = make_predict_fn()

        def careful(texts: np.ndarray) -> np.ndarray:
            try:
                return predict(texts)
            except Exception:  # noqa: BLE001 - any failure of a user's model
                out = np.full(len(texts), -1, dtype=np.int32)
                for i in range(len(texts)):
                    try:
                        out[i] = predict(texts[i:i + 1])[0]
                    except Exception:  # noqa: BLE001
                        pass
                return out
        return careful
    return make


def score_sentiment(df: DataFrame, text: str, make_predict_fn: Callable | None = None,
                    labels: Sequence[str] = SENTIMENT_LABELS, batch_size: int = 32) -> DataFrame:
    """Probabilities from a batch model -> friction, label, flag."""
    fn = predict_batch_udf(make_predict_fn or make_lexicon_predictor(),
                           return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    s = df.withColumn("_probs", fn(F.coalesce(col_(text), F.lit(""))))
    return (s.withColumn("friction_score", friction("_probs", labels))
             .withColumn("sentiment_label", argmax_label("_probs", labels))
             .withColumn("is_negative", is_negative("sentiment_label"))
             .drop("_probs"))


def classify(df: DataFrame, text: str, labels: Sequence[str] | None = None,
             make_predict_fn: Callable | None = None, batch_size: int = 8,
             fallback: bool = True, max_chars: int | None = None, out: str = "friction_category") -> DataFrame:
    """Single-label classification of text by a batch model returning a
    label index; rows the model leaves unlabelled (-1 or null) or fails on fall
    back to the keyword rule.  ``max_chars`` (P20) cuts texts for models with a
    short input; by default they are read whole."""
    labels = list(labels or CATEGORY_KEYWORDS)
    fn = predict_batch_udf(unlabelled_on_error(make_predict_fn or make_keyword_classifier(labels=labels)),
                           return_type=T.IntegerType(), batch_size=batch_size)
    short = F.coalesce(col_(text), F.lit(""))
    if max_chars is not None:
        short = F.substring(short, 1, max_chars)
    idx = fn(short)
    names = F.array(*[F.lit(x) for x in labels])
    model = F.when(idx >= 0, F.try_element_at(names, (idx + 1).cast("int")))
    if fallback:
        model = F.coalesce(model, keyword_category(short))
    else:
        model = F.coalesce(model, F.lit(OTHER_CATEGORY))
    return df.withColumn(out, model)


def fit_scorer(df: DataFrame, text: str, label: str, num_features: int = 1 << 18,
               max_iter: int = 50):
    """Trainable scorer (tokens -> hashed TF -> IDF -> logistic regression).

    The counted tokens are written once.  The IDF and each step of the regression sum
    up arrays of ``num_features`` in every task and send them on, so the rows are
    read in one partition a core: what is sent doesn't grow with the rows."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
    tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[^\p{L}\p{N}_]+")
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_feat")
    lr = LogisticRegression(featuresCol="_feat", labelCol=label, maxIter=max_iter,
                            probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")
    rows = df.select(text, F.col(label).cast("double").alias(label))
    rows = scratch_table(PipelineModel(stages=[tok, tf]).transform(rows).select("_tf", label))
    rows = rows.coalesce(df.sparkSession.sparkContext.defaultParallelism)
    idf = idf.fit(rows)
    return PipelineModel(stages=[tok, tf, idf, lr.fit(idf.transform(rows))])


def apply_scorer(model, df: DataFrame) -> DataFrame:
    """Friction = probability of the positive (negative-sentiment) class."""
    from pyspark.ml.functions import vector_to_array
    s = model.transform(df)
    p = vector_to_array("_prob")
    return s.withColumn("friction_score", p[1]) \
        .withColumn("is_negative", F.col("_pred") == 1.0) \
        .drop("_tok", "_tf", "_feat", "_prob", "_raw", "_pred")


def good_vector(v, dim: int) -> Column:
    """The width contract: ``dim`` components, all of them finite numbers."""
    v = col_(v)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) == dim) & finite, F.lit(False))


def of_width(make_predict_fn: Callable, dim: int, strict: bool) -> Callable:
    """The predictor is asked for the texts that need a vector (not null) only; a batch of
    another width than ``dim`` is an error, or unless ``strict`` no vector."""
    def make():
        predict = make_predict_fn()

        def checked(texts: np.ndarray) -> np.ndarray:
            out = np.full((len(texts), dim), np.nan, dtype=np.float64)
            need = np.array([t is not None for t in texts], dtype=bool)
            if need.any():
                got = np.asarray(predict(texts[need]), dtype=np.float64)
                if got.shape == (int(need.sum()), dim):
                    out[need] = got
                elif strict:
                    raise ValueError(f"the model returned vectors of shape {got.shape}, not ({int(need.sum())}, {dim})")
            return out
        return checked
    return make


def embed(df: DataFrame, text: str, make_predict_fn: Callable, dim: int, batch_size: int = 64,
          out: str = "embedding", precomputed: str | None = None, strict: bool = False) -> DataFrame:
    """A vector of exactly ``dim`` doubles for each row, and in ``<out>_source`` where it
    comes from.

    A good vector in the column ``precomputed`` is taken first (``precomputed``); rows
    without one are given to the user's model (``model``), and only those: others
    reach it as nulls that are skipped.  A row has no vector (both columns null) if its
    text is null, or the model returned another width or a component that is not a
    finite number.  With ``strict`` another width ends the job instead."""
    fn = predict_batch_udf(of_width(make_predict_fn, dim, strict), return_type=T.ArrayType(T.DoubleType()),
                           batch_size=batch_size)
    have = F.lit(False)
    given = F.lit(None).cast("array<double>")
    if precomputed is not None:
        have, given = good_vector(precomputed, dim), F.col(precomputed).cast("array<double>")
    told = df.withColumn("_have", have).withColumn("_given", given) \
        .withColumn("_made", fn(F.when(~F.col("_have"), col_(text))))
    made = good_vector("_made", dim)
    return told.withColumn(out, F.when(F.col("_have"), F.col("_given")).when(made, F.col("_made"))) \
        .withColumn(f"{out}_source", F.when(F.col("_have"), F.lit("precomputed")).when(made, F.lit("model"))) \
        .drop("_have", "_given", "_made")


def make_letter_shares(dim: int) -> Callable:
    """A small text model for offline runs: the shares of the letters a to z (either
    case) in the first 26 of ``dim`` components; zeros for a text without them."""
    def make():
        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                raw = np.frombuffer(str(t).encode("utf-8", "replace"), np.uint8)
                n = np.bincount(raw, minlength=256)
                n = (n[97:123] + n[65:91]).astype(np.float64)
                out[i, :26] = n / n.sum() if n.sum() else n
            return out
        return predict
    return make


# ---- fixed values: the hypothesis that each category label is put into ----
LABEL_PROMPT = "This code review comment is about {}."
# ---------------------------------------------------------------------------
GRAM = 3
_SCORE_DIGITS = 9


def word_grams(text: str, n: int = GRAM) -> dict[str, int]:
    """Counts of the ``n``-character pieces of the text's words, lower-cased, each word with
    a blank at both ends, so that "tests" and "testing" share most of theirs."""
    out: dict[str, int] = {}
    for w in _TOKEN.split(text.lower()):
        if w:
            w = f" {w} "
            for i in range(len(w) - n + 1):
                out[w[i:i + n]] = out.get(w[i:i + n], 0) + 1
    return out


def make_label_similarity(labels: Sequence[str], prompt: str = LABEL_PROMPT) -> Callable:
    """``make_predict_fn`` for U6: texts and label prompts as vectors in one space, the label of
    the largest cosine (the first of equal ones).

    The space are the prompts' word pieces.  Pieces that all prompts share say nothing
    about the label: each counts ln(number of labels / prompts that hold it).  A text
    without any piece that tells labels apart is left unlabelled (-1)."""
    prompts = [word_grams(prompt.format(x)) for x in labels]
    holders: dict[str, int] = {}
    for p in prompts:
        for g in p:
            holders[g] = holders.get(g, 0) + 1
    weight = {g: np.log(len(prompts) / n) for g, n in holders.items() if n < len(prompts)}
    names = {g: i for i, g in enumerate(sorted(weight))}
    idf = np.array([weight[g] for g in names])
    m = np.zeros((len(prompts), len(names)))
    for j, p in enumerate(prompts):
        for g, n in p.items():
            if g in names:
                m[j, names[g]] = n * idf[names[g]]
    norms = np.sqrt((m * m).sum(axis=1))
    m /= np.where(norms > 0, norms, 1.0)[:, None]

    def make():
        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.full(len(texts), -1, dtype=np.int32)
            for i, t in enumerate(texts):
                v = np.zeros(len(names))
                for g, n in word_grams(str(t)).items():
                    if g in names:
                        v[names[g]] = n * idf[names[g]]
                norm = np.sqrt((v * v).sum())
                if norm > 0:
                    out[i] = int(np.argmax(np.round(m @ v / norm, _SCORE_DIGITS)))
            return out
        return predict
    return make


def score_distinct(df: DataFrame, text: str, score_fn: Callable | None = None) -> DataFrame:
    """Score each distinct text once and join the scores back.

    Exact (the join key is the text itself).  It costs one shuffle of the
    distinct texts (de-duplicated map-side first) and a join; it pays off
    when texts repeat (templates, bot messages, quoted replies) and not when
    almost every text is unique, so it is opt-in.  ``score_fn(df, text)``
    adds score columns (default: the native lexicon scorer)."""
    from ..functions.lexicon import score_columns
    fn = score_fn or score_columns
    texts = df.select(text).where(F.col(text).isNotNull()).distinct()
    scored = fn(texts, text)
    return df.join(scored, text, "left")
