"""Vocabulary, TF-IDF, SVD and assembled text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import STOP_WORDS, TEXT_SPEC, quoted, raw_text, table
from tabloom.operators import textfeatures as tf
from tabloom.operators.cleaning import clean_text


def tfidf_vocab(spark, sf):
    docs = tf.document_terms(table(spark, sf, "documents").select("doc_id", "text"), "text", STOP_WORDS)
    return tf.vocabulary(docs)


def tfidf(spark, sf):
    vectors, terms = tf.tfidf(table(spark, sf, "documents"), "doc_id", stop_words=STOP_WORDS)
    return tf.tfidf_weights(vectors, terms, "doc_id").withColumn("weight", F.round("weight", 6))


def svd_features(spark, sf):
    vectors, terms = tf.tfidf(table(spark, sf, "documents"), "doc_id", stop_words=STOP_WORDS)
    return tf.svd_features(vectors, len(terms), "doc_id")


def text_features(spark, sf):
    cleaned = clean_text(raw_text(spark, sf), TEXT_SPEC, "doc_id")
    return tf.text_features(cleaned, TEXT_SPEC, "doc_id", stop_words=STOP_WORDS)


_TERMS = f"""words AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({quoted(STOP_WORDS)})) AS w
  FROM documents
), terms AS (
  SELECT doc_id, unnest(w) AS term FROM words
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM words
), vocab AS (
  SELECT term, count(*) AS corpus_count, count(DISTINCT doc_id) AS doc_count FROM terms GROUP BY term
  HAVING count(DISTINCT doc_id) >= 2 ORDER BY corpus_count DESC, term LIMIT 200
)"""

QUERIES = {
    "tfidf_vocab": (
        tfidf_vocab,
        f"WITH {_TERMS} SELECT term, CAST(corpus_count AS BIGINT) AS corpus_count, CAST(doc_count AS BIGINT) AS doc_count FROM vocab",
    ),
    "tfidf": (
        tfidf,
        f"""WITH {_TERMS}, n AS (SELECT count(*) AS n FROM documents), raw AS (
          SELECT doc_id, term, count(*) * (ln((1 + n)::DOUBLE / (1 + doc_count)) + 1) AS x
          FROM terms JOIN vocab USING (term), n GROUP BY doc_id, term, doc_count, n)
          SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""",
    ),
    "svd_features": (svd_features, None),
    "text_features": (text_features, None),
}
