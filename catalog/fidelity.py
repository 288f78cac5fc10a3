"""Profiles, distributions, fidelity and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import FIDELITY_COLUMNS, fidelity_real, fidelity_sides_sql, orders_target, table, u_sql
from tabloom.functions.hashing import uniform
from tabloom.operators import fidelity as fd
from tabloom.operators import metrics as mt
from tabloom.operators import profile as pf
from tabloom.operators.synthesis import independent
from tabloom.session import cut_lineage


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def profile_columns(spark, sf):
    parts = [
        pf.profile_columns(table(spark, sf, t)).withColumn("table", F.lit(t)) for t in ("part", "lineitem", "events")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def column_metadata(spark, sf):
    """Kind and exact distinct count of every column of the orders."""
    return pf.column_metadata(table(spark, sf, "orders"), ids=["o_orderkey"])


def metadata_document(spark, sf):
    """The metadata of the orders as one JSON document."""
    return pf.metadata_document(column_metadata(spark, sf))


def sketched_metadata(spark, sf):
    """Kinds and gaps of the lineitems from sketches of two parts that are merged; estimates are left out."""
    df = table(spark, sf, "lineitem")
    early = F.col("l_orderkey") % 2 == 0
    parts = pf.column_sketches(df.where(early)).unionByName(pf.column_sketches(df.where(~early)))
    return pf.sketched_metadata(df, pf.merged_sketches(parts), ids=["l_orderkey"]).select(
        "column", "dtype", "sdtype", "n_rows", "n_missing",
        F.when(F.col("exact") & (F.col("sdtype") == "categorical"), F.col("n_distinct")).alias("n_levels"),
    )


def _metadata_sql() -> str:
    kinds = {
        "o_orderkey": ("bigint", "'id'"), "o_custkey": ("bigint", None), "o_orderstatus": ("string", "'categorical'"),
        "o_totalprice": ("double", "'numerical'"), "o_orderdate": ("timestamp_ntz", "'datetime'"),
        "o_orderpriority": ("string", "'categorical'"),
    }
    by_count = "CASE WHEN count(DISTINCT {c}) <= 20 THEN 'categorical' ELSE 'numerical' END"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{dtype}' AS dtype, {kind or by_count.format(c=c)} AS sdtype, count(DISTINCT {c}) AS n_distinct FROM orders"
        for c, (dtype, kind) in kinds.items()
    )


_DOCUMENT_SQL = f"""WITH m AS ({_metadata_sql()})
SELECT '{{"columns":{{' || string_agg('"' || "column" || '":{{"dtype":"' || dtype || '","sdtype":"' || sdtype || '","n_distinct":' || n_distinct || '}}',
  ',' ORDER BY "column") || '}}}}' AS document FROM m"""


def _sketched_sql() -> str:
    dtypes = {
        "l_orderkey": ("bigint", "id"), "l_partkey": ("bigint", None), "l_suppkey": ("bigint", None), "l_linenumber": ("int", None),
        **{c: ("double", "numerical") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")},
        "l_returnflag": ("string", "categorical"), "l_linestatus": ("string", "categorical"), "l_shipdate": ("timestamp_ntz", "datetime"),
    }
    rows = []
    for c, (dtype, kind) in dtypes.items():
        few = f"count(DISTINCT {c}) <= 20"
        sdtype = f"'{kind}'" if kind else f"CASE WHEN {few} THEN 'categorical' ELSE 'numerical' END"
        levels = "CAST(NULL AS BIGINT)" if kind else f"CASE WHEN {few} THEN count(DISTINCT {c}) END"
        rows.append(
            f"SELECT '{c}' AS \"column\", '{dtype}' AS dtype, {sdtype} AS sdtype, count(*) AS n_rows, count(*) - count({c}) AS n_missing, "
            f"{levels} AS n_levels FROM lineitem"
        )
    return " UNION ALL ".join(rows)


def _profile_sql() -> str:
    tables = {
        "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
        "lineitem": {
            "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
            "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
            "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
        },
        "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
    }
    rows = []
    for t, columns in tables.items():
        for c, dtype in columns.items():
            if dtype in ("bigint", "int"):
                low = f"count(DISTINCT {c}) <= 20"
                n, kind = f"CASE WHEN {low} THEN count(DISTINCT {c}) END", f"CASE WHEN {low} THEN 'categorical' ELSE 'numeric' END"
            else:
                n, kind = "CAST(NULL AS BIGINT)", "'numeric'" if dtype == "double" else "'categorical'"
            rows.append(f"SELECT '{c}' AS \"column\", '{dtype}' AS dtype, {n} AS n_levels, {kind} AS sdtype, '{t}' AS \"table\" FROM {t} HAVING count(*) > 0")
    return " UNION ALL ".join(rows)


def value_distribution(spark, sf):
    return rounded(pf.value_distribution(table(spark, sf, "orders"), "o_orderpriority"), "share")


def scale_stats(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(pf.scale_statistics(table(spark, sf, "lineitem"), columns), "mean", "scale")


_GAPS = "CASE WHEN l_quantity > 40 THEN NULL ELSE {c} END"


def impute_median(spark, sf):
    df = table(spark, sf, "lineitem").select(*[
        F.expr(_GAPS.format(c=c)).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_partkey")
    ])
    return rounded(pf.exact_median(df, df.columns), "median")


def impute_mode(spark, sf):
    df = table(spark, sf, "lineitem").select(*[F.expr(_GAPS.format(c=c)).alias(c) for c in ("l_returnflag", "l_linestatus")])
    return pf.most_frequent(df, df.columns)


def sides(spark, sf):
    """The real table and its independent synthesis, both whole."""
    real = cut_lineage(fidelity_real(spark, sf))
    synth = cut_lineage(independent(real, ["o_orderkey"]).select(*FIDELITY_COLUMNS))
    return real.drop("o_orderkey"), synth


_NUMERIC = ["o_totalprice"]
_CATEGORICAL = ["o_orderdate", "o_orderpriority", "text_sentiment", "target"]
_NUMERIC_OUT = ("real_mean", "synth_mean", "abs_mean_diff", "real_std", "synth_std", "abs_std_diff")


def numeric_fidelity(spark, sf):
    real, synth = sides(spark, sf)
    return rounded(fd.numeric_summary(fd.moments(real, _NUMERIC), fd.moments(synth, _NUMERIC)), *_NUMERIC_OUT)


def categorical_tvd(spark, sf):
    real, synth = sides(spark, sf)
    out = fd.categorical_summary(fd.level_shares(real, _CATEGORICAL), fd.level_shares(synth, _CATEGORICAL))
    return rounded(out, "total_variation_distance")


def crosstab(spark, sf):
    return rounded(fd.contingency(fidelity_real(spark, sf)), "prob")


def cross_modal(spark, sf):
    real, synth = sides(spark, sf)
    return rounded(fd.cross_modal_summary(fd.contingency(real), fd.contingency(synth)), "real_prob", "synth_prob", "abs_diff")


def fidelity_report(spark, sf):
    real, synth = sides(spark, sf)
    doubles = [*_NUMERIC_OUT, "total_variation_distance", "real_prob", "synth_prob", "abs_diff"]
    return rounded(fd.fidelity_report(real, synth), *doubles)


def fidelity_rollup(spark, sf):
    out = fd.fidelity_rollup(fd.fidelity_report(*sides(spark, sf)))
    return rounded(out, *out.columns)


def worst_columns(spark, sf):
    return rounded(fd.worst_columns(fd.fidelity_report(*sides(spark, sf))), "difference")


def _scored(spark, sf):
    score = F.floor(uniform(42, "score", F.col("o_orderkey")) * 100) / 100
    scored = orders_target(spark, sf).select(F.col("target").alias("label"), score.alias("score"))
    return scored.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


_SCORED = f"""scored AS (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, floor({u_sql(42, 'score', 'o_orderkey')} * 100) / 100 AS score FROM orders
)"""


def auroc(spark, sf):
    return rounded(mt.auroc(_scored(spark, sf)), "auroc")


def confusion_f1(spark, sf):
    return rounded(mt.confusion(_scored(spark, sf)), "accuracy", "f1")


def constant_classifier(spark, sf):
    return rounded(mt.constant_metrics(orders_target(spark, sf), 1), "accuracy", "f1")


_SIDES = fidelity_sides_sql()
_NUM_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", 'numeric' AS type, r.m AS real_mean, s.m AS synth_mean, abs(r.m - s.m) AS abs_mean_diff,
    r.d AS real_std, s.d AS synth_std, abs(r.d - s.d) AS abs_std_diff
    FROM (SELECT avg({c}) AS m, stddev_samp({c}) AS d FROM real) r, (SELECT avg({c}) AS m, stddev_samp({c}) AS d FROM synth) s"""
    for c in _NUMERIC
)


def _shares(side: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", coalesce(CAST({c} AS VARCHAR), 'nan') AS level, count(*)::DOUBLE / (SELECT count(*) FROM {side}) AS p
        FROM {side} GROUP BY 1, 2""" for c in _CATEGORICAL
    )


_CAT_SQL = f"""SELECT "column", 'categorical' AS type, count(*) AS num_levels,
  0.5::DOUBLE * sum(abs(coalesce(r.p, 0) - coalesce(s.p, 0))) AS total_variation_distance
  FROM ({_shares('real')}) r FULL OUTER JOIN ({_shares('synth')}) s USING ("column", level) GROUP BY 1"""


def _prob(side: str) -> str:
    return f"""SELECT target, text_sentiment AS label, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY target) AS prob
      FROM {side} GROUP BY 1, 2"""


_CROSS_SQL = f"""SELECT 'target_vs_text_sentiment' AS "column", 'cross_modal' AS type, CAST(g.target AS VARCHAR) AS target, g.label AS sentiment,
  coalesce(r.prob, 0) AS real_prob, coalesce(s.prob, 0) AS synth_prob, abs(coalesce(r.prob, 0) - coalesce(s.prob, 0)) AS abs_diff
  FROM (SELECT t.target, l.label FROM (SELECT DISTINCT target FROM real) t CROSS JOIN (SELECT DISTINCT text_sentiment AS label FROM real) l) g
  LEFT JOIN ({_prob('real')}) r USING (target, label) LEFT JOIN ({_prob('synth')}) s USING (target, label)"""
_REPORT = f"{_SIDES}, report AS ({_NUM_SQL} UNION ALL BY NAME {_CAT_SQL} UNION ALL BY NAME {_CROSS_SQL})"


def _round(columns) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_REPORT_DOUBLES = [*_NUMERIC_OUT, "total_variation_distance", "real_prob", "synth_prob", "abs_diff"]

QUERIES = {
    "profile_columns": (profile_columns, _profile_sql()),
    "column_metadata": (column_metadata, _metadata_sql()),
    "metadata_document": (metadata_document, _DOCUMENT_SQL),
    "sketched_metadata": (sketched_metadata, _sketched_sql()),
    "value_distribution": (
        value_distribution,
        "SELECT o_orderpriority, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1",
    ),
    "scale_stats": (
        scale_stats,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS scale FROM lineitem"
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
        ),
    ),
    "impute_median": (
        impute_median,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", round(median(CAST({_GAPS.format(c=c)} AS DOUBLE)), 6) AS median FROM lineitem"
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_partkey")
        ),
    ),
    "impute_mode": (
        impute_mode,
        " UNION ALL ".join(
            f"""(SELECT '{c}' AS "column", {c} AS most_frequent, count(*) AS n FROM lineitem WHERE l_quantity <= 40
            GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)""" for c in ("l_returnflag", "l_linestatus")
        ),
    ),
    "numeric_fidelity": (numeric_fidelity, f'WITH {_SIDES} SELECT "column", type, {_round(_NUMERIC_OUT)} FROM ({_NUM_SQL})'),
    "categorical_tvd": (
        categorical_tvd,
        f'WITH {_SIDES} SELECT "column", type, num_levels, {_round(["total_variation_distance"])} FROM ({_CAT_SQL})',
    ),
    "crosstab": (crosstab, f"WITH {_SIDES} SELECT target, label, round(prob, 6) AS prob FROM ({_prob('real')})"),
    "cross_modal": (
        cross_modal,
        f'WITH {_SIDES} SELECT "column", type, target, sentiment, {_round(["real_prob", "synth_prob", "abs_diff"])} FROM ({_CROSS_SQL})',
    ),
    "fidelity_report": (
        fidelity_report,
        f'WITH {_REPORT} SELECT "column", type, num_levels, target, sentiment, {_round(_REPORT_DOUBLES)} FROM report',
    ),
    "fidelity_rollup": (
        fidelity_rollup,
        f"""WITH {_REPORT} SELECT round(avg(abs_mean_diff) FILTER (type = 'numeric'), 6) AS mean_numeric_abs_mean_diff,
          round(avg(abs_std_diff) FILTER (type = 'numeric'), 6) AS mean_numeric_abs_std_diff,
          round(avg(total_variation_distance) FILTER (type = 'categorical'), 6) AS mean_categorical_tvd,
          round(avg(abs_diff) FILTER (type = 'cross_modal'), 6) AS mean_cross_modal_abs_diff,
          round(avg(abs_diff) FILTER (type = 'cross_modal' AND target = '1'), 6) AS target1_cross_modal_abs_diff FROM report""",
    ),
    "worst_columns": (
        worst_columns,
        f"""WITH {_REPORT} SELECT "column", type, target, sentiment, round(difference, 6) AS difference FROM (
          SELECT *, coalesce(abs_mean_diff, total_variation_distance, abs_diff) AS difference,
            row_number() OVER (PARTITION BY type ORDER BY coalesce(abs_mean_diff, total_variation_distance, abs_diff) DESC, "column", target, sentiment) AS rn
          FROM report) WHERE rn <= CASE WHEN type = 'cross_modal' THEN 10 ELSE 5 END""",
    ),
    "auroc": (
        auroc,
        f"""WITH {_SCORED}, s AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1),
          c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
          SELECT round(sum(pos::DOUBLE * (below::DOUBLE + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS auroc FROM c""",
    ),
    "confusion_f1": (
        confusion_f1,
        f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp,
          count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 1 AND score < 0.5) AS fn FROM scored)
          SELECT tp, fp, tn, fn, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    ),
    "constant_classifier": (
        constant_classifier,
        """WITH c AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS tp, count(*) FILTER (o_orderstatus <> 'F') AS fp FROM orders)
          SELECT round(tp::DOUBLE / (tp + fp), 6) AS accuracy, round(2.0::DOUBLE * tp / (2 * tp + fp), 6) AS f1, 0.5::DOUBLE AS auroc FROM c""",
    ),
}
