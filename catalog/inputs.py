"""Input tables of the queries, derived from the given Parquet tables, and the same inputs as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.alignment import weak_alignment
from tabloom.operators.cleaning import TextSpec, label_ids, text_statistics
from tabloom.session import cut_lineage, spread
from tabloom.sources.tables import DEFAULT_RULES, STRICT_RULES, rules_frame

# Small word lists for the invented prose of the test documents.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "with", "by", "are", "was", "le", "la", "les", "des", "un", "une", "der", "die", "und", "el", "los")
POSITIVE = ("the", "with", "for", "une", "und")
NEGATIVE = ("is", "by", "was", "le", "der")
LABEL_IDS = {"negative": 0, "neutral": 1, "positive": 2}
TEXT_SPEC = TextSpec(
    text_col="text", label_col="sentiment", valid_labels=("positive", "neutral", "negative"),
    dedupe_cols=("text", "sentiment"), label_to_id=LABEL_IDS, positive_hints=POSITIVE, negative_hints=NEGATIVE,
)
RULES = {"default": DEFAULT_RULES, "strict": STRICT_RULES}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def u_sql(seed: int, salt: str, *ids: str) -> str:
    """The seeded uniform in SQL."""
    tail = " || ':' || ".join(f"CAST({i} AS VARCHAR)" for i in ids)
    return f"(('0x' || substr(md5('{seed}:{salt}:' || {tail}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def draw_sql(seed: int, salt: str, size: str, *ids: str) -> str:
    return f"CAST(floor({u_sql(seed, salt, *ids)} * {size}) AS BIGINT)"


# --- raw labelled text: documents with a label, odd spacing and odd capitals ----------------------

_LABEL = (
    "CASE WHEN toxic = 1 THEN ' Negative ' WHEN quality = 1 THEN 'POSITIVE' WHEN quality = 0 THEN 'neutral' END"
)


def raw_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every document; those without a label have a NULL one. Spaces are doubled to give cleaning some work."""
    documents = spread(table(spark, sf, "documents").select("doc_id", "text"))
    joined = documents.join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select(
        "doc_id", F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\t")).alias("text"),
        F.expr(_LABEL).alias("sentiment"),
    )


RAW_TEXT = f"""raw_text AS (
  SELECT d.doc_id, '  ' || replace(d.text, ' ', '  ') || chr(9) AS text, {_LABEL} AS sentiment
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""
CLEAN_ROWS = RAW_TEXT + """, clean_rows AS (
  SELECT * FROM (
    SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, lower(trim(sentiment)) AS sentiment FROM raw_text
  ) WHERE sentiment IN ('positive', 'neutral', 'negative') AND length(text) > 0
), deduped AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY text, sentiment ORDER BY doc_id) AS rn FROM clean_rows
  ) WHERE rn = 1
)"""

# --- labelled text with the light features used for alignment ------------------------------------

_SIMPLE_LABEL = "CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END"


def labelled_text(spark: SparkSession, sf: str) -> DataFrame:
    documents = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    joined = documents.join(table(spark, sf, "labels"), "doc_id")
    return joined.select("doc_id", "text", F.expr(_SIMPLE_LABEL).alias("sentiment"))


def light_features(spark: SparkSession, sf: str) -> DataFrame:
    # stored without the texts: checks and ranges read them more than once
    stats = cut_lineage(text_statistics(labelled_text(spark, sf)).drop("text"))
    return label_ids(stats, "sentiment", LABEL_IDS)


LIGHT_FEATURES = f"""light AS (
  SELECT doc_id, sentiment, CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS sentiment_id,
    CAST(length(text) AS BIGINT) AS text_length,
    CAST(len(regexp_extract_all(text, '[^\\s]+')) AS BIGINT) AS word_count,
    len(regexp_extract_all(text, '\\p{{Nd}}'))::DOUBLE / greatest(length(text), 1)::DOUBLE AS digit_ratio,
    len(regexp_extract_all(text, '[A-Z]'))::DOUBLE / greatest(length(text), 1)::DOUBLE AS uppercase_ratio
  FROM (SELECT d.doc_id, d.text, {_SIMPLE_LABEL} AS sentiment FROM documents d JOIN labels l USING (doc_id))
)"""

# --- orders with a binary target, and the aligned table ------------------------------------------


def orders_target(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("target", F.expr("CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END"))


ORDERS_TARGET = """tab AS (
  SELECT *, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target FROM orders
)"""


def aligned(spark: SparkSession, sf: str, rules: str = "default", keep_text_key: bool = True) -> DataFrame:
    """Orders with one allowed text row each."""
    return weak_alignment(
        orders_target(spark, sf), light_features(spark, sf), rules_frame(spark, RULES[rules]),
        "o_orderkey", "doc_id", keep_text_key=keep_text_key,
    )


def rules_values(rules: str = "default") -> str:
    rows = ", ".join(f"({t}, '{label}')" for t, labels in RULES[rules].items() for label in labels)
    return f"rules(target, label) AS (VALUES {rows})"


def aligned_sql(rules: str = "default") -> str:
    return f"""{ORDERS_TARGET}, {LIGHT_FEATURES}, {rules_values(rules)}, pool AS (
  SELECT r.target, light.*, row_number() OVER (PARTITION BY r.target ORDER BY doc_id) - 1 AS pool_idx
  FROM light JOIN rules r ON r.label = light.sentiment
), pool_size AS (SELECT target, count(*) AS m FROM pool GROUP BY target
), aligned AS (
  SELECT tab.*, p.doc_id AS text_doc_id, p.sentiment AS text_sentiment, p.sentiment_id AS text_sentiment_id,
    p.text_length AS text_text_length, p.word_count AS text_word_count, p.digit_ratio AS text_digit_ratio,
    p.uppercase_ratio AS text_uppercase_ratio
  FROM tab JOIN pool_size s USING (target)
  JOIN pool p ON p.target = tab.target AND p.pool_idx = {draw_sql(42, "align", "s.m", "o_orderkey")}
)"""


#: Columns of the real table in the fidelity queries, with their order in an independent draw.
FIDELITY_COLUMNS = ("o_totalprice", "o_orderdate", "o_orderpriority", "text_sentiment", "target")
_FEW = ("o_orderpriority", "text_sentiment", "target")


def fidelity_real(spark: SparkSession, sf: str) -> DataFrame:
    return aligned(spark, sf).select("o_orderkey", *FIDELITY_COLUMNS)


def independent_sql(source: str, columns, few, key: str, seed: int = 42, out: str = "synth") -> str:
    """CTEs drawing each column on its own: a draw is a position in the order of the column and then the key."""
    parts = [f"{out}_size AS (SELECT count(*) AS n FROM {source})", f"{out}_rows AS (SELECT unnest(range(n)) AS row_id, n FROM {out}_size)"]
    joins, picks = [], ["r.row_id"]
    for i, c in enumerate(columns):
        order = c if c in few else f"{c}, {key}"
        parts.append(f"{out}_c{i} AS (SELECT {c}, row_number() OVER (ORDER BY {order}) - 1 AS idx FROM {source})")
        joins.append(f"JOIN {out}_c{i} c{i} ON c{i}.idx = {draw_sql(seed, f'independent:{c}', 'r.n', 'r.row_id')}")
        picks.append(f"c{i}.{c}")
    parts.append(f"{out} AS (SELECT {', '.join(picks)} FROM {out}_rows r {' '.join(joins)})")
    return ", ".join(parts)


def fidelity_sides_sql() -> str:
    real = f"real AS (SELECT o_orderkey, {', '.join(FIDELITY_COLUMNS)} FROM aligned)"
    return f"{aligned_sql()}, {real}, {independent_sql('real', FIDELITY_COLUMNS, _FEW, 'o_orderkey')}"


# --- result rows of a sweep, taken from line items -----------------------------------------------

def _mean(column: str, scale: int = 100, divisor: int = 1) -> str:
    """Mean of a column of at most two decimals from whole numbers, so that no summation order changes it."""
    total = f"CAST(sum(CAST(round({column} * {scale}) AS BIGINT)) AS DOUBLE)"
    return f"({total} / CAST({scale * divisor} * count(*) AS DOUBLE))"


_RESULT_MEASURES = {
    "trtr_accuracy": _mean("l_discount"), "trtr_f1": _mean("l_tax"), "trtr_auroc": _mean("l_quantity", 1, 50),
    "tstr_accuracy": f"max(l_discount) - {_mean('l_tax')}", "tstr_f1": _mean("l_quantity", 1, 100),
    "tstr_auroc": _mean("l_extendedprice", 100, 100000), "gap_accuracy": f"{_mean('l_discount')} - {_mean('l_tax')}",
    "gap_f1": f"{_mean('l_tax')} - CAST(0.04 AS DOUBLE)", "gap_auroc": f"{_mean('l_discount')} - CAST(0.05 AS DOUBLE)",
    "mean_numeric_abs_mean_diff": _mean("l_extendedprice", 100, 1000), "mean_numeric_abs_std_diff": _mean("l_quantity", 1),
    "mean_categorical_tvd": _mean("l_tax", 100, 2), "mean_cross_modal_abs_diff": _mean("l_discount", 100, 2),
    "target1_cross_modal_abs_diff": _mean("l_discount", 100, 3),
}
_RESULT_DATASET = (
    "CASE l_returnflag WHEN 'A' THEN 'weak_multimodal' WHEN 'N' THEN 'weak_multimodal_strict' ELSE 'other_table' END"
)
_RESULT_METHOD = (
    "CASE l_linenumber WHEN 1 THEN 'independent' WHEN 2 THEN 'gaussian_copula' WHEN 3 THEN 'random_forest' "
    "WHEN 4 THEN 'xgboost' WHEN 5 THEN 'ctgan' WHEN 6 THEN 'tvae' ELSE 'unlisted' END"
)


def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows shaped like sweep results, one per (dataset, method, seed), aggregated from all line items."""
    items = table(spark, sf, "lineitem")
    keyed = items.withColumns({
        "dataset": F.expr(_RESULT_DATASET), "method": F.expr(_RESULT_METHOD), "seed": F.year("l_shipdate"),
    })
    return keyed.groupBy("dataset", "method", "seed").agg(
        *[F.expr(e).alias(m) for m, e in _RESULT_MEASURES.items()]
    )


RESULT_ROWS = f"""results AS (
  SELECT {_RESULT_DATASET} AS dataset, {_RESULT_METHOD} AS method, CAST(year(l_shipdate) AS INTEGER) AS seed,
    {', '.join(f'{e} AS {m}' for m, e in _RESULT_MEASURES.items())}
  FROM lineitem GROUP BY 1, 2, 3
)"""
