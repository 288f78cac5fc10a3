"""Structured features of labelled text: lexicon hits, TF-IDF over a bounded vocabulary, truncated SVD."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, StopWordsRemover,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import hint_count
from tabloom.operators.cleaning import TextSpec, label_ids, label_order_ids, require_columns
from tabloom.session import cut_lineage, spread

# Fixed value: what counts as a word.
WORD = r"[\p{L}\p{N}_]{2,}"
STATISTICS = ("text_length", "word_count", "digit_ratio", "uppercase_ratio")


def document_terms(df: DataFrame, text_col: str, stop_words: Sequence[str] | None, bigrams: bool = True) -> DataFrame:
    """Add the array column ``terms``: lower-case words of two or more letters, digits or underscores that are
    not stop words and, with ``bigrams``, each pair of neighbours among them joined by a space."""
    stop = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else list(stop_words)
    words = RegexTokenizer(inputCol="_text", outputCol="_words", gaps=False, pattern=WORD, toLowercase=True)
    keep = StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=stop, caseSensitive=True)
    text = spread(df).withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    out = keep.transform(words.transform(text))
    if bigrams:
        out = NGram(n=2, inputCol="_kept", outputCol="_pairs").transform(out)
        terms = F.concat("_kept", "_pairs")
    else:
        terms = F.col("_kept")
    return out.withColumn("terms", terms).drop("_text", "_words", "_kept", "_pairs")


def term_cells(docs: DataFrame) -> DataFrame:
    """``(term, tf, df)``: a row for each occurrence and one for each document of a term."""
    once = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
    each = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    return docs.select(F.explode(F.concat(each, once)).alias("t")).select("t.*")


def summed_terms(cells: DataFrame) -> DataFrame:
    return cells.groupBy("term").agg(F.sum("tf").alias("corpus_count"), F.sum("df").alias("doc_count"))


def term_counts(docs: DataFrame) -> DataFrame:
    """``(term, corpus_count, doc_count)`` of all terms in one pass; occurrences are summed before the shuffle."""
    return summed_terms(term_cells(docs))


#: Counters of the frequency sketch.
COUNTERS = 1 << 18


def _counter(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(COUNTERS))


def term_sketch(docs: DataFrame) -> DataFrame:
    """``(counter, n)``: occurrences of all terms that share a counter, so no term occurs more often than its counter
    says. Counters add up over parts of a corpus; a task sends at most ``COUNTERS`` rows."""
    # a plain explode would let Spark ask for non-empty arrays before texts are spread, and split them twice
    each = docs.select(F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
    return each.groupBy(_counter(F.col("term")).alias("counter")).agg(F.count("*").alias("n"))


#: Counters up to which terms are sorted out within each document, before any of them becomes a row.
MAX_INLINE = 20_000


def heavy_terms(docs: DataFrame, sketch: DataFrame, threshold: int) -> DataFrame:
    """``docs`` with only those terms whose counter reaches ``threshold``; all documents stay."""
    heavy = sketch.where(F.col("n") >= threshold).select("counter")
    counters = [r["counter"] for r in heavy.limit(MAX_INLINE + 1).collect()]
    if len(counters) > MAX_INLINE:
        return docs
    return docs.withColumn("terms", F.filter("terms", lambda t: _counter(t).isin(counters)))


def vocabulary(docs: DataFrame, size: int = 200, min_df: int = 2) -> DataFrame:
    """The terms of ``chosen_terms``."""
    return chosen_terms(docs, size, min_df)[0]


def chosen_terms(docs: DataFrame, size: int, min_df: int, store: bool = False) -> tuple[DataFrame, DataFrame]:
    """The vocabulary, and ``docs`` with the terms that could be in it; with ``store`` these are written out once.

    The ``size`` terms with the most occurrences among those in at least ``min_df`` documents; ties by term.

    Two passes. A sketch of counters bounds every term's occurrences from above; only terms whose counter reaches a
    threshold are then counted, exactly. If the last term chosen reaches the threshold, no other term can belong here;
    else the threshold is lowered, down to one, which counts all. So the result is exact, and what is shuffled is the
    sketch and the few terms near the top, not the terms of the corpus. The sketch's bound makes it safe to broadcast.
    """
    sketch = term_sketch(docs).persist()
    # some more counters than terms wanted, as rare terms share counters and terms of one document do not count
    top = sketch.orderBy(F.desc("n")).limit(4 * size).agg(F.count("*").alias("held"), F.min("n").alias("n")).first()
    threshold = top["n"] if top["held"] == 4 * size else 1
    while True:
        kept = heavy_terms(docs, sketch, threshold) if threshold > 1 else docs
        if store and kept is not docs:
            kept = cut_lineage(kept)
        terms = term_cells(kept)
        if threshold > 1 and kept is docs:
            heavy = sketch.where(F.col("n") >= threshold).select("counter")
            terms = terms.join(F.broadcast(heavy), _counter(terms["term"]) == heavy["counter"], "left_semi")
        counted = summed_terms(terms).filter(F.col("doc_count") >= min_df)
        chosen = cut_lineage(counted.orderBy(F.desc("corpus_count"), "term").limit(size))
        found = chosen.agg(F.count("*").alias("n"), F.min("corpus_count").alias("least")).first()
        if threshold <= 1 or (found["n"] == size and (found["least"] or 0) >= threshold):
            sketch.unpersist()
            return chosen, kept
        threshold //= 8


def smooth_idf(doc_count: int, n_docs: int) -> float:
    return math.log((1.0 + n_docs) / (1.0 + doc_count)) + 1.0


def tfidf_vectors(docs: DataFrame, vocab: Sequence[tuple[str, int]], n_docs: int) -> DataFrame:
    """Add ``tfidf``: L2-normalised term counts times smooth idf, built per row without a shuffle."""
    counter = CountVectorizerModel.from_vocabulary([t for t, _ in vocab], inputCol="terms", outputCol="_tf")
    weights = ElementwiseProduct(
        scalingVec=Vectors.dense([smooth_idf(d, n_docs) for _, d in vocab]), inputCol="_tf", outputCol="_weighted"
    )
    scaled = weights.transform(counter.transform(docs))
    return Normalizer(p=2.0, inputCol="_weighted", outputCol="tfidf").transform(scaled).drop("_tf", "_weighted")


def tfidf(
    df: DataFrame, key: str, text_col: str = "text", max_features: int = 200, min_df: int = 2,
    stop_words: Sequence[str] | None = None, bigrams: bool = True,
) -> tuple[DataFrame, list[str]]:
    """``(key, tfidf)`` vectors of every document and the vocabulary in term order."""
    docs = document_terms(df.select(key, text_col), text_col, stop_words, bigrams).select(key, "terms")
    chosen, kept = chosen_terms(docs, max_features, min_df, store=True)
    vocab = sorted((r["term"], r["doc_count"]) for r in chosen.collect())
    if not vocab:
        raise ValueError("Empty vocabulary: every term was filtered out.")
    # the stored documents hold every term of the vocabulary, so texts are not split again
    n_docs = df.count() if kept is docs else kept.count()
    return tfidf_vectors(kept, vocab, n_docs).select(key, "tfidf"), [t for t, _ in vocab]


def tfidf_weights(vectors: DataFrame, terms: Sequence[str], key: str) -> DataFrame:
    """Long form ``(key, term, weight)`` of the non-zero weights."""
    names = F.array(*[F.lit(t) for t in terms])
    return (
        vectors.select(key, F.posexplode(vector_to_array("tfidf")).alias("at", "weight"))
        .filter(F.col("weight") != 0.0)
        .select(key, F.element_at(names, F.col("at") + 1).alias("term"), "weight")
    )


def right_singular_vectors(vectors: DataFrame, k: int) -> np.ndarray:
    """Top ``k`` right singular vectors, from the Gram matrix Spark sums over all rows.

    Only the vocabulary-sized square matrix reaches the driver. The largest loading of each component is
    made positive; components beyond the rank are zero.
    """
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors.select("tfidf"), "tfidf"))
    energy, loadings = np.linalg.eigh(matrix.computeGramianMatrix().toArray())
    top = np.argsort(energy)[::-1][:k]
    loadings = np.where(energy[top] > 1e-12 * max(energy.max(), 1.0), loadings[:, top], 0.0)
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    return loadings * np.where(signs == 0.0, 1.0, signs)


def project(vectors: DataFrame, loadings: np.ndarray, key: str, prefix: str = "text_svd_") -> DataFrame:
    """Scores of each row on the components, as columns ``<prefix>1`` …"""

    @F.pandas_udf("array<double>")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(rows.to_list()) @ loadings) if len(rows) else [])

    scored = vectors.select(key, score(vector_to_array("tfidf")).alias("_scores"))
    return scored.select(key, *[
        F.col("_scores")[i].alias(f"{prefix}{i + 1}") for i in range(loadings.shape[1])
    ])


def svd_features(vectors: DataFrame, n_terms: int, key: str, components: int = 30) -> DataFrame:
    """Truncated SVD scores; a vocabulary of one term is used as it is."""
    if n_terms <= 1:
        return vectors.select(key, vector_to_array("tfidf")[0].alias("text_svd_1"))
    vectors = vectors.persist()
    loadings = right_singular_vectors(vectors, min(components, n_terms - 1))
    return project(vectors, loadings, key)


def text_features(
    df: DataFrame, spec: TextSpec, key: str, max_features: int = 200, components: int = 30, min_df: int = 2,
    stop_words: Sequence[str] | None = None, bigrams: bool = True,
) -> DataFrame:
    """Label, label id, four statistics, two lexicon counts and the SVD columns of a cleaned text table.

    The text itself is dropped; ``key`` is kept.
    """
    require_columns(df, [key, spec.text_col, spec.label_col, *STATISTICS])
    vectors, terms = tfidf(df, key, spec.text_col, max_features, min_df, stop_words, bigrams)
    svd = svd_features(vectors, len(terms), key, components)
    text = F.col(spec.text_col)
    hinted = spread(df).withColumns({
        "positive_hint_count": hint_count(text, [w.lower() for w in spec.positive_hints]),
        "negative_hint_count": hint_count(text, [w.lower() for w in spec.negative_hints]),
    }).drop(spec.text_col)
    if spec.label_to_id:
        labelled = label_ids(hinted, spec.label_col, spec.label_to_id)
    else:
        labelled = label_order_ids(hinted, spec.label_col, key)
    head = [key, spec.label_col, f"{spec.label_col}_id", *STATISTICS, "positive_hint_count", "negative_hint_count"]
    return labelled.select(*head).join(svd, key, "left")
