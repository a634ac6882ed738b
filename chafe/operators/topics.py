"""Topic terms, class-based TF-IDF, topic info and embedding clustering
(T1-T10).

Terms are counted per topic with ``explode`` + partial aggregation, so a
topic holding a third of all texts is combined map-side.  Clustering uses
BisectingKMeans over few dimensions (PCA of given vectors, or a randomised SVD of
TF-IDF rows, ``vectors``) in place of the reference's single-machine UMAP/HDBSCAN.
Small clusters and rows far from their centre become the outlier topic -1, and
topics are numbered by size; cuts and numbers are fitted and stay with the
model (``topic_map``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_
from ..session import cut_lineage, group_side, scratch_table, where_here
from .cosine import cosine_pairs
from .topic_map import MIN_TOPIC_SIZE, OUTLIER_QUANTILE, OUTLIER_TOPIC, fit_topic_map
from .vectors import VOCABULARY, fit_text_vectors

# ---- fixed values -----------------------------------------------------------
# English stop words removed before n-grams are built.
STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and",
    "any", "are", "as", "at", "be", "because", "been", "before", "being", "below",
    "between", "both", "but", "by", "can", "could", "did", "do", "does", "doing", "down",
    "during", "each", "few", "for", "from", "further", "had", "has", "have", "having",
    "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "if", "in",
    "into", "is", "it", "its", "itself", "just", "me", "more", "most", "my", "myself",
    "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our",
    "ours", "ourselves", "out", "over", "own", "same", "she", "should", "so", "some",
    "such", "than", "that", "the", "their", "theirs", "them", "themselves", "then",
    "there", "these", "they", "this", "those", "through", "to", "too", "under", "until",
    "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who",
    "whom", "why", "will", "with", "would", "you", "your", "yours", "yourself",
    "yourselves",
]
# Terms: lowercase runs of two or more letters, digits or underscores.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
TERM_SPLIT = r"[^\p{L}\p{N}_]+"
MIN_STUDY_ROWS = 10
# Terms that a task holds before it adds up equal ones.
HELD_TERMS = 1 << 21
# ---------------------------------------------------------------------------


def negatives(df: DataFrame, flag: str = "is_negative") -> DataFrame:
    """T1."""
    return df.where(F.col(flag))


def _words(text, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The text's tokens without stop words."""
    sw = list(stop_words)
    # maximal runs of word characters, then runs of length >= 2: the same
    # tokens as extracting TERM_PATTERN, but a split is cheaper in Java
    return F.filter(F.split(F.lower(col_(text)), TERM_SPLIT), lambda w: (F.length(w) >= 2) & ~w.isin(sw))


def _with_pairs(tok: str) -> Column:
    """The tokens and the pairs of neighbours."""
    n = F.size(tok)
    bi = F.when(n >= 2, F.zip_with(F.slice(tok, 1, n - 1), F.slice(tok, 2, n - 1),
                                   lambda a, b: F.concat_ws(" ", a, b))) \
        .otherwise(F.array().cast("array<string>"))
    return F.concat(F.col(tok), bi)


def doc_terms(df: DataFrame, text: str, stop_words: Sequence[str] = STOP_WORDS,
              ngrams: int = 2) -> DataFrame:
    """Per-row array of uni- and bi-grams after stop-word removal."""
    df = df.withColumn("_tok", _words(text, stop_words))
    return df.withColumn("terms", _with_pairs("_tok") if ngrams >= 2 else F.col("_tok")).drop("_tok")


def term_counts(df: DataFrame, text: str, topic: str, min_df: int = 2,
                stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(topic, term, n, f) for terms found in at least ``min_df`` topics;
    ``f`` is the term's count over all topics.

    Written once: c-TF-IDF and topic info read it several times."""
    return _counted(df.select(topic, _words(text, stop_words).alias("_tok")), topic, min_df)


def _counted(tokens: DataFrame, topic: str, min_df: int) -> DataFrame:
    """``term_counts`` of (topic, _tok).

    Tasks add up the terms that they hold before anything is shuffled, so a hot
    term is a few rows a task.  The sums are dealt by term alone: counts of a topic's
    term, its document frequency and ``f`` all come from that one shuffle (each
    term has at most #topics rows)."""
    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by([topic, "term"], use_threads=False).aggregate([([], "count_all")]) \
            .select([topic, "term", "count_all"]).rename_columns([topic, "term", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            tok, row = b.column(1).flatten(), pc.list_parent_indices(b.column(1))
            names = b.column(0)
            same = pc.equal(row[:-1], row[1:])
            pairs = pc.binary_join_element_wise(tok[:-1], tok[1:], " ").filter(same)
            for terms, at in ((tok, row), (pairs, row[1:].filter(same))):
                held.append(pa.table([names.take(at), terms], names=[topic, "term"]))
                size += len(terms)
            if size >= HELD_TERMS:
                yield from summed(held).to_batches()
                held, size = [], 0
        if size:
            yield from summed(held).to_batches()

    kind = T.StructType([tokens.schema[topic], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    counts = tokens.select(topic, "_tok").mapInArrow(count, kind).repartition("term") \
        .groupBy(topic, "term").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("term")
    kept = counts.withColumn("_df", F.count(F.lit(1)).over(w)) \
        .withColumn("f", F.sum("n").over(w)) \
        .where(F.col("_df") >= min_df).drop("_df")
    return scratch_table(kept)


def topic_terms(df: DataFrame, text: str, topic: str, min_df: int = 2,
                stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """T5: (topic, term, n) counts, keeping terms that occur in at least
    ``min_df`` topics (texts of one topic count as one document)."""
    return term_counts(df, text, topic, min_df, stop_words).select(topic, "term", "n")


def ctfidf(terms: DataFrame, topic: str, n_topics=None) -> DataFrame:
    """``sqrt(n / sum_topic n) * ln(1 + A / f)``, f = the term's count
    over all topics, A = floor(total count / number of topics).  Without
    ``n_topics`` the topics present in ``terms`` are counted."""
    if "f" not in terms.columns:
        terms = terms.withColumn("f", F.sum("n").over(Window.partitionBy("term")))
    per_topic = terms.groupBy(topic).agg(F.sum("n").alias("_tn"))  # one row per topic
    total = per_topic.agg(F.sum("_tn")).scalar()
    k = n_topics if n_topics is not None else per_topic.agg(F.count(F.lit(1))).scalar()
    avg = F.floor(total / k)
    j = terms.join(group_side(per_topic), topic)
    score = F.sqrt(F.col("n") / F.col("_tn")) * F.log(F.lit(1.0) + avg / F.col("f"))
    return j.select(topic, "term", "n", score.alias("score"))


def top_terms(scores: DataFrame, topic: str, k: int = 10) -> DataFrame:
    """Best ``k`` terms per topic (ties: term ascending)."""
    w = Window.partitionBy(topic).orderBy(F.desc("score"), F.asc("term"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topic_info(df: DataFrame, text: str, topic: str, doc_id: str, k: int = 10,
               n_docs: int = 3, min_df: int = 2) -> DataFrame:
    """Topic, count, name (topic + top 4 terms), representation (top k
    terms) and representative documents (those containing most top terms,
    ties to the lowest id)."""
    df = scratch_table(df.select(doc_id, topic, _words(text).alias("_tok")))
    top = top_terms(ctfidf(_counted(df, topic, min_df), topic), topic, k)
    rep = top.groupBy(topic).agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_r"))
    rep = group_side(rep.select(topic, F.transform("_r", lambda s: s["term"]).alias("_terms")))
    sizes = df.groupBy(topic).agg(F.count(F.lit(1)).alias("count"))
    # each row's terms meet its topic's few where they are: only those found are shuffled
    hits = df.join(rep, topic).select(
        doc_id, topic, F.explode_outer(F.array_intersect(_with_pairs("_tok"), "_terms")).alias("term")) \
        .where(F.col("term").isNotNull()).groupBy(topic, doc_id).agg(F.count(F.lit(1)).alias("_h"))
    w = Window.partitionBy(topic).orderBy(F.desc("_h"), F.asc(doc_id))
    best = hits.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n_docs) \
        .groupBy(topic).agg(F.sort_array(F.collect_list(F.struct("_k", doc_id))).alias("_d"))
    best = best.select(topic, F.transform("_d", lambda s: s[doc_id].cast("string")).alias("_docs"))
    out = sizes.join(rep, topic, "left").join(best, topic, "left")
    name = F.concat_ws("_", F.col(topic).cast("string"), F.slice(F.coalesce("_terms", F.array()), 1, 4))
    return out.select(F.col(topic), "count", name.alias("name"),
                      F.concat_ws(", ", "_terms").alias("representation"),
                      F.concat_ws(", ", "_docs").alias("representative_docs"))


# ---- clustering (T2-T4, T8) ---------------------------------------------------
def topic_count(n: int) -> int:
    """Clusters asked for, twice the cube root of the number of vectors."""
    return max(2, round(2 * n ** (1 / 3)))


def _with_topics(stages: list, clustered: DataFrame, vector: str, min_size: int, quantile: float | None):
    """The fitted stages and the topic map of their clusters, as one pipeline."""
    from pyspark.ml import PipelineModel
    topics = fit_topic_map(clustered, stages[-1].clusterCenters(), vector, min_size=min_size, quantile=quantile)
    return PipelineModel(stages=[*stages, topics])


def fit_topic_model(df: DataFrame, vec: str, k: int | None = None, dims: int = 5, seed: int = 42,
                    min_size: int = MIN_TOPIC_SIZE, quantile: float | None = OUTLIER_QUANTILE):
    """Array column -> vector -> PCA(dims) -> BisectingKMeans(k, by default
    ``topic_count`` of the data) -> topic map."""
    k = k if k is not None else topic_count(df.count())
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import PCA
    pca = PCA(k=dims, inputCol="_vec", outputCol="_pca")
    km = BisectingKMeans(k=k, seed=seed, featuresCol="_pca", predictionCol="_cluster")
    rows = with_vector(df, vec)
    base = Pipeline(stages=[pca, km]).fit(rows)
    model = _with_topics(base.stages, base.transform(rows), "_pca", min_size, quantile)
    model._chafe_vec = vec
    return model


def fit_text_topics(df: DataFrame, text: str, k: int | None = None, dims: int = 5, seed: int = 42,
                    vocabulary: int = VOCABULARY, min_size: int = MIN_TOPIC_SIZE,
                    quantile: float | None = OUTLIER_QUANTILE):
    """T2/T3 without a sentence embedder: TF-IDF rows over a counted vocabulary ->
    randomised SVD -> BisectingKMeans -> topic map.  The fitted pipeline saves,
    loads and assigns like any Spark ML model."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import RegexTokenizer, StopWordsRemover
    words = [RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TERM_SPLIT, minTokenLength=2),
             StopWordsRemover(inputCol="_tok", outputCol="_terms", stopWords=STOP_WORDS, locale="en_US")]
    # read by the vocabulary, the sparse rows and the projection
    tokens = scratch_table(PipelineModel(stages=words).transform(df).select("_terms"))
    vectors = fit_text_vectors(tokens, "_terms", "_vec", dims, vocabulary, seed=seed)
    rows = cut_lineage(vectors.transform(tokens).select("_vec"))
    k = k if k is not None else topic_count(rows.count())
    clusters = BisectingKMeans(k=k, seed=seed, featuresCol="_vec", predictionCol="_cluster").fit(rows)
    return _with_topics([*words, vectors, clusters], clusters.transform(rows), "_vec", min_size, quantile)


@dataclass
class TopicStudy:
    model: object          # fitted pipeline
    assigned: DataFrame    # rows with their topic
    info: DataFrame        # T7
    matrix: DataFrame      # A11, long, outliers left out
    top: DataFrame         # T10: each group's topics with most rows, and their words


def topic_study(df: DataFrame, text: str, by: str, doc_id: str, k: int | None = None, top: int = 3,
                words: int = 10, min_rows: int = MIN_STUDY_ROWS) -> TopicStudy | None:
    """T1-T10 end to end: fit, assign, info, topic x group counts, top topics with words.
    None where there are fewer than ``min_rows`` rows to model.

    The rows are written once: the fit and the assignment read them again, and what
    they come from (cleaning, scoring) would be worked out anew each time."""
    df = scratch_table(where_here(df, F.col(text).isNotNull()))
    if df.limit(min_rows).count() < min_rows:
        return None
    model = fit_text_topics(df, text, k)
    rows = scratch_table(model.transform(df).drop("_tok", "_terms", "_vec", "_cluster"))
    inside = rows.where(F.col("topic") != OUTLIER_TOPIC)
    info = topic_info(rows, text, "topic", doc_id, words, min_df=1)
    matrix = inside.groupBy("topic", by).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), F.asc("topic"))
    best = matrix.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return TopicStudy(model, rows, info, matrix,
                      best.join(info.select("topic", "representation"), "topic", "left"))


def with_vector(df: DataFrame, vec: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("_vec", array_to_vector(F.col(vec)))


def assign_topics(model, df: DataFrame) -> DataFrame:
    """The fitted model's topic (-1: outlier) and the distance from its centre.
    Numbers and cuts are those of the fit, whatever rows come."""
    return model.transform(with_vector(df, getattr(model, "_chafe_vec", "embedding"))) \
        .drop("_vec", "_pca", "_cluster")


def merge_topics(scores: DataFrame, topic: str, threshold: float = 0.9) -> DataFrame:
    """T4: topics whose c-TF-IDF vectors (all terms) have cosine >= threshold
    are merged into the smallest topic id of their connected group.

    Pairs come from the bounded cosine join; components by min-label propagation
    with pointer jumping over the small topic graph."""
    pairs = cosine_pairs(scores, topic, threshold)
    edges = pairs.select(F.col("a").alias("t1"), F.col("b").alias("t2"))
    norms = scores.select(topic).where(F.col(topic).isNotNull()).distinct()
    und = cut_lineage(edges.union(edges.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"))))
    labels = cut_lineage(norms.select(F.col(topic).alias("node"), F.col(topic).alias("label")))
    while True:
        near = und.join(labels.withColumnRenamed("node", "t1"), "t1") \
            .groupBy(F.col("t2").alias("node")).agg(F.min("label").alias("_l"))
        step = labels.join(near, "node", "left") \
            .select("node", F.col("label").alias("_was"), F.least("label", F.coalesce("_l", "label")).alias("_via"))
        jump = labels.select(F.col("node").alias("_via"), F.col("label").alias("_on"))
        new = cut_lineage(step.join(jump, "_via").select("node", "_was", F.least("_via", "_on").alias("label")))
        labels = new.select("node", "label")
        if not new.where(F.col("label") != F.col("_was")).limit(1).count():
            return labels.select(F.col("node").alias(topic), F.col("label").alias("merged_topic"))
