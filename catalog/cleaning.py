"""Cleaning, text statistics, labels and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import (
    CLEAN_ROWS, LABEL_IDS, NEGATIVE, POSITIVE, TEXT_SPEC, aligned, aligned_sql, labelled_text, quoted, raw_text,
    rules_values, table, _SIMPLE_LABEL,
)
from tabloom.functions import text as tx
from tabloom.operators import cleaning as cl
from tabloom.session import spread
from tabloom.sources.tables import STRICT_RULES, rules_frame

_MESSY = ("' ' || {c} || chr(9)", "concat(' ', {c}, chr(9))")


def _messy_orders(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(" Order-Key"), F.expr(_MESSY[1].format(c="o_orderpriority")).alias("Order Priority"),
        F.expr(_MESSY[1].format(c="o_orderstatus")).alias("ORDER-STATUS"), F.col("o_totalprice").alias("total price "),
    )


_CLEAN_PRIORITY = (
    "CASE WHEN trim(o_orderpriority) = '4-NOT SPECIFIED' THEN 'unknown' ELSE trim(o_orderpriority) END"
)


def column_names(spark, sf):
    return cl.standardize_columns(_messy_orders(spark, sf))


def missing_tokens(spark, sf):
    return cl.clean_strings(cl.standardize_columns(_messy_orders(spark, sf)), ["4-NOT SPECIFIED"])


def target_map(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return cl.target_from_map(df, "o_orderstatus", {"F": 1, "O": 0, "P": 0})


def target_binary12(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", F.expr("CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END").alias("outcome")
    )
    return cl.target_from_domain(df, "outcome")


def clean_tabular(spark, sf):
    spec = cl.TabularSpec("order_status", {"F": 1, "O": 0, "P": 0}, True, ("4-NOT SPECIFIED",))
    return cl.clean_tabular(_messy_orders(spark, sf), spec)


def clean_text(spark, sf):
    out = cl.clean_text(raw_text(spark, sf), TEXT_SPEC, "doc_id")
    return out.withColumns({c: F.round(c, 9) for c in ("digit_ratio", "uppercase_ratio")})


def text_dedupe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return cl.first_per_group(docs, ["text", "lang"], "doc_id").select("doc_id", "lang")


def text_stats(spark, sf):
    stats = cl.text_statistics(table(spark, sf, "documents").select("doc_id", "text")).drop("text")
    return stats.withColumns({c: F.round(c, 9) for c in ("digit_ratio", "uppercase_ratio")})


def hint_counts(spark, sf):
    return spread(table(spark, sf, "documents")).select(
        "doc_id", tx.hint_count(F.col("text"), POSITIVE).alias("positive_hint_count"),
        tx.hint_count(F.col("text"), NEGATIVE).alias("negative_hint_count"),
    )


def label_ids(spark, sf):
    return cl.label_ids(labelled_text(spark, sf), "sentiment", LABEL_IDS).drop("text")


def label_factorize(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return cl.label_order_ids(docs.withColumn("lang", F.expr("nullif(lang, 'de')")), "lang", "doc_id")


def rules(spark, sf):
    """Targets of the orders with the labels their rules allow."""
    targets = table(spark, sf, "orders").selectExpr("CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target")
    counts = targets.groupBy("target").agg(F.count("*").alias("n"))
    return counts.join(rules_frame(spark, STRICT_RULES), "target")


def allowed_text(spark, sf):
    """Documents by target they may serve; a label shared by two targets serves both."""
    docs = labelled_text(spark, sf).select("doc_id", F.col("sentiment").alias("label"))
    return docs.join(F.broadcast(rules_frame(spark)), "label").select("doc_id", "label", "target")


def feature_prep(spark, sf):
    """Drop the target and the column it was derived from, keep the rest."""
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus AS y",
        "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target",
    )
    cl.target_classes(df, "target")
    return cl.drop_leakage(df, "target")


def weak_alignment(spark, sf):
    return _rounded_alignment(aligned(spark, sf))


def weak_alignment_strict(spark, sf):
    return _rounded_alignment(aligned(spark, sf, "strict"))


def _rounded_alignment(df):
    return df.withColumns({c: F.round(c, 9) for c in ("text_digit_ratio", "text_uppercase_ratio")})


_ROUNDED = """SELECT * REPLACE (round(text_digit_ratio, 9) AS text_digit_ratio, round(text_uppercase_ratio, 9) AS text_uppercase_ratio)
FROM aligned"""
_STATS = """CAST(length(text) AS BIGINT) AS text_length,
  CAST(len(regexp_extract_all(text, '[^\\s]+')) AS BIGINT) AS word_count,
  round(len(regexp_extract_all(text, '\\p{Nd}'))::DOUBLE / greatest(length(text), 1)::DOUBLE, 9) AS digit_ratio,
  round(len(regexp_extract_all(text, '[A-Z]'))::DOUBLE / greatest(length(text), 1)::DOUBLE, 9) AS uppercase_ratio"""


def _hits(words) -> str:
    edge = ".,;:!?()[]{}\"''"
    return (
        "CAST(len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), "
        f"lambda w: lower(trim(w, '{edge}')) IN ({quoted(words)}))) AS BIGINT)"
    )


QUERIES = {
    "column_names": (
        column_names,
        f"""SELECT o_orderkey AS order_key, {_MESSY[0].format(c='o_orderpriority')} AS order_priority,
          {_MESSY[0].format(c='o_orderstatus')} AS order_status, o_totalprice AS total_price FROM orders""",
    ),
    "missing_tokens": (
        missing_tokens,
        f"""SELECT o_orderkey AS order_key, {_CLEAN_PRIORITY} AS order_priority, trim(o_orderstatus) AS order_status,
          o_totalprice AS total_price FROM orders""",
    ),
    "target_map": (
        target_map,
        "SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 WHEN 'P' THEN 0 END AS target FROM orders",
    ),
    "target_binary12": (
        target_binary12,
        """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS outcome,
          CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS target FROM events""",
    ),
    "clean_tabular": (
        clean_tabular,
        f"""SELECT o_orderkey AS order_key, {_CLEAN_PRIORITY} AS order_priority, o_totalprice AS total_price,
          CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target FROM orders""",
    ),
    "clean_text": (clean_text, f"WITH {CLEAN_ROWS} SELECT doc_id, text, sentiment, {_STATS} FROM deduped"),
    "text_dedupe": (
        text_dedupe,
        """SELECT doc_id, lang FROM (
          SELECT doc_id, lang, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn FROM documents
        ) WHERE rn = 1""",
    ),
    "text_stats": (text_stats, f"SELECT doc_id, {_STATS} FROM documents"),
    "hint_counts": (
        hint_counts,
        f"SELECT doc_id, {_hits(POSITIVE)} AS positive_hint_count, {_hits(NEGATIVE)} AS negative_hint_count FROM documents",
    ),
    "label_ids": (
        label_ids,
        f"""SELECT doc_id, sentiment, CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS sentiment_id
          FROM (SELECT doc_id, {_SIMPLE_LABEL} AS sentiment FROM documents JOIN labels USING (doc_id))""",
    ),
    "label_factorize": (
        label_factorize,
        """WITH d AS (SELECT doc_id, nullif(lang, 'de') AS lang FROM documents),
          f AS (SELECT lang, row_number() OVER (ORDER BY min(doc_id)) - 1 AS id FROM d WHERE lang IS NOT NULL GROUP BY lang)
          SELECT d.doc_id, d.lang, CAST(coalesce(f.id, -1) AS INTEGER) AS lang_id FROM d LEFT JOIN f ON d.lang = f.lang""",
    ),
    "rules": (
        rules,
        f"""WITH {rules_values('strict')}, t AS (
          SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target, count(*) AS n FROM orders GROUP BY 1)
          SELECT target, n, label FROM t JOIN rules USING (target)""",
    ),
    "allowed_text": (
        allowed_text,
        f"""WITH {rules_values()}, d AS (SELECT doc_id, {_SIMPLE_LABEL} AS label FROM documents JOIN labels USING (doc_id))
          SELECT doc_id, label, target FROM d JOIN rules USING (label)""",
    ),
    "feature_prep": (feature_prep, "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders"),
    "weak_alignment": (weak_alignment, f"WITH {aligned_sql()} {_ROUNDED}"),
    "weak_alignment_strict": (weak_alignment_strict, f"WITH {aligned_sql('strict')} {_ROUNDED}"),
}
