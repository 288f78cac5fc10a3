"""Sampling and the generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import ORDERS_TARGET, aligned, draw_sql, independent_sql, orders_target, table, u_sql
from tabloom.functions.hashing import uniform
from tabloom.functions.numeric import half_even as half_even_column
from tabloom.functions.numeric import normal_cdf as normal_cdf_column
from tabloom.functions.numeric import weighted_class
from tabloom.operators.fidelity import level_report
from tabloom.operators import sampling as sp
from tabloom.operators.ranking import dense_index
from tabloom.operators.synthesis import copula as cp
from tabloom.operators.synthesis import gaussian_copula, independent, sequential
from tabloom.operators.synthesis.repair import cast_back, repair_domains
from tabloom.operators.synthesis.sequential import TreeSettings
from tabloom.session import cut_lineage

# --- sampling ---


def bootstrap_column(spark, sf):
    orders = table(spark, sf, "orders")
    return sp.bootstrap_column(orders, "o_totalprice", ["o_orderkey"], orders.count())


def cap_rows(spark, sf):
    return sp.cap_rows(table(spark, sf, "orders"), ["o_orderkey"], 1000).select("o_orderkey", "o_totalprice", "o_orderpriority")


def shuffle_key(spark, sf):
    return sp.shuffle_position(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


def stratified_split(spark, sf):
    marked = sp.stratified_split(orders_target(spark, sf), ["o_orderkey"])
    return marked.select("o_orderkey", "target", F.col("is_test").cast("int").alias("is_test"))


def dense_rank_rows(spark, sf):
    """Line items have no key; all columns order them, and equal rows are interchangeable."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    return dense_index(items, ["l_extendedprice", "l_orderkey", "l_linenumber", "l_quantity"], within=["l_returnflag"], name="position")


# --- independent and copula ---

_ORDER_COLUMNS = ["o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus"]


def independent_orders(spark, sf):
    return independent(table(spark, sf, "orders"), ["o_orderkey"], columns=_ORDER_COLUMNS)


_ITEM_COLUMNS = ["l_quantity", "l_discount", "l_returnflag", "l_linenumber", "l_extendedprice"]


def independent_lineitem(spark, sf):
    return independent(
        table(spark, sf, "lineitem"), ["l_extendedprice", "l_orderkey", "l_linenumber"], columns=_ITEM_COLUMNS
    )


_COPULA_COLUMNS = ["o_totalprice", "o_custkey", "o_orderdate", "o_orderpriority"]


def normal_scores(spark, sf):
    scores = cp.normal_scores(table(spark, sf, "orders"), _COPULA_COLUMNS, ["o_orderkey"])
    return scores.select(
        F.col("_key_0").alias("o_orderkey"),
        *[F.round(f"score_{i}", 6).alias(f"score_{c}") for i, c in enumerate(_COPULA_COLUMNS)],
    )


def copula_corr(spark, sf):
    items = table(spark, sf, "part")
    columns = ["p_size", "p_retailprice", "p_brand", "p_type"]
    scores = cp.normal_scores(items, columns, ["p_partkey"])
    matrix = cp.correlation_matrix(scores, [f"score_{i}" for i in range(len(columns))])
    rows = [(a, b, round(float(matrix[i, j]), 6)) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return spark.createDataFrame(rows, "col_a string, col_b string, corr double")


def copula_synth(spark, sf):
    return gaussian_copula(table(spark, sf, "orders"), ["o_orderkey"])


def copula_synth_aligned(spark, sf):
    real = cut_lineage(aligned(spark, sf).drop("o_custkey", "o_orderstatus", "text_doc_id"))
    return gaussian_copula(real, ["o_orderkey"])


def normal_cdf(spark, sf):
    """Normal distribution function of the standardised price of every line item."""
    z = (F.col("l_extendedprice") - F.lit(50000.0)) / F.lit(15000.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", z.alias("z"), normal_cdf_column(z).alias("p"))


# --- sequential ---

def sequential_table(spark, sf):
    """All columns of the aligned table."""
    return cut_lineage(aligned(spark, sf))


def seq_rf(spark, sf):
    return sequential(sequential_table(spark, sf), ["o_orderkey"], settings=TreeSettings("rf"))


def seq_gbt(spark, sf):
    return sequential(sequential_table(spark, sf), ["o_orderkey"], settings=TreeSettings("gbt"))


def copula_synth_levels(spark, sf):
    """Rows, missing values and unknown levels of the copula's categories and few-valued numbers."""
    real = table(spark, sf, "orders")
    return level_report(real, cut_lineage(gaussian_copula(real, ["o_orderkey"])), ["o_orderstatus", "o_orderpriority", "o_custkey"])


def seq_rf_levels(spark, sf):
    """The same for the categories of the forest on the aligned table."""
    real = sequential_table(spark, sf)
    synth = sequential(real, ["o_orderkey"], settings=TreeSettings("rf"))
    return level_report(real, cut_lineage(synth), SEQ_CATEGORIES)


SEQ_CATEGORIES = ["o_orderstatus", "o_orderpriority", "target", "text_sentiment", "text_sentiment_id"]


def _no_new_levels_sql(columns):
    return "SELECT c AS \"column\", count(*) AS n_rows, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_new_levels FROM orders, (VALUES {}) v(c) GROUP BY c".format(
        ", ".join(f"('{c}')" for c in columns)
    )


def class_draw(spark, sf):
    """Draw a class for every order from probabilities made of its own hash numbers."""
    key = F.col("o_orderkey")
    weights = F.array(*[uniform(7, f"weight:{k}", key) + F.lit(0.1) for k in range(3)])
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    df = table(spark, sf, "orders").select("o_orderkey", weights.alias("w"))
    shares = df.withColumn("p", F.transform("w", lambda x: x / total))
    return shares.select("o_orderkey", weighted_class(F.col("p"), uniform(7, "class", key), 3).alias("class_index"))


def residual_bootstrap(spark, sf):
    """Price residuals against the mean of their priority, redrawn for every order."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    means = orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("prediction"))
    predicted = orders.join(F.broadcast(means), "o_orderpriority")
    residuals = predicted.select("o_orderkey", (F.col("o_totalprice") - F.col("prediction")).alias("residual"))
    drawn = sp.bootstrap_column(residuals, "residual", ["o_orderkey"], orders.count())
    return drawn.withColumn("residual", F.round("residual", 4))


# --- repair ---

_NOISY = "CASE WHEN p_partkey % 5 = 0 THEN 'bad' WHEN p_partkey % 5 = 1 THEN NULL ELSE CAST({x} AS VARCHAR(30)) END"


def _real_part(spark, sf):
    return table(spark, sf, "part").selectExpr("p_size", "CAST(p_size % 7 AS INT) * 3 AS p_low", "p_retailprice", "p_type")


_REAL_PART = "real AS (SELECT p_size, CAST(p_size % 7 AS INTEGER) * 3 AS p_low, p_retailprice, p_type FROM part)"


def _synth_part(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS row_id", f"{_NOISY.format(x='p_size + 0.5')} AS p_size", f"{_NOISY.format(x='p_size / 2')} AS p_low",
        f"{_NOISY.format(x='p_retailprice')} AS p_retailprice", "p_type",
    )


def domain_repair(spark, sf):
    return repair_domains(_real_part(spark, sf), _synth_part(spark, sf))


def cast_back_types(spark, sf):
    real = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    loose = table(spark, sf, "part").selectExpr(
        "p_type", "CAST(p_size AS DOUBLE) AS p_size", "CAST(p_partkey AS STRING) AS p_partkey"
    )
    return cast_back(loose, real.schema)


def half_even(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", half_even_column(F.col("l_quantity") / 2, _int()).alias("half")
    )


def _int():
    from pyspark.sql.types import IntegerType

    return IntegerType()


def _score_sql(rank: str, n: str) -> str:
    x = f"(2.0::DOUBLE * (({rank}::DOUBLE + 0.5::DOUBLE) / {n}) - 1.0::DOUBLE)"
    log = f"ln(1.0::DOUBLE - {x} * {x})"
    half = f"(2.0::DOUBLE / (3.141592653589793::DOUBLE * 0.147::DOUBLE) + {log} / 2.0::DOUBLE)"
    size = f"sqrt(sqrt({half} * {half} - {log} / 0.147::DOUBLE) - {half})"
    return f"(sqrt(2.0::DOUBLE) * CASE WHEN {x} < 0 THEN -{size} ELSE {size} END)"


def _ranks_sql(columns, key: str, source: str) -> str:
    ranks = ", ".join(f"row_number() OVER (ORDER BY {c}, {key}) - 1 AS r{i}" for i, c in enumerate(columns))
    return f"ranked AS (SELECT {key}, {ranks}, count(*) OVER () AS n FROM {source})"


_CORR = ["p_size", "p_retailprice", "p_brand", "p_type"]
_NEAREST = "(SELECT arg_min(v, d) FROM (SELECT v, (abs(v - TRY_CAST(s.p_low AS DOUBLE)), v) AS d FROM (SELECT DISTINCT p_low AS v FROM real)))"

QUERIES = {
    "bootstrap_column": (
        bootstrap_column,
        f"""WITH s AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)
          SELECT r.idx AS row_id, s.o_totalprice FROM s r JOIN s ON s.idx = {draw_sql(42, 'bootstrap:o_totalprice', 'r.n', 'r.idx')}""",
    ),
    "cap_rows": (
        cap_rows,
        f"SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY {u_sql(42, 'cap', 'o_orderkey')}, o_orderkey LIMIT 1000",
    ),
    "shuffle_key": (
        shuffle_key,
        f"""SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY {u_sql(42, 'shuffle', 'o_orderkey')}, o_orderkey) - 1 AS position FROM orders""",
    ),
    "stratified_split": (
        stratified_split,
        f"""WITH {ORDERS_TARGET}, c AS (SELECT target, count(*) AS k FROM tab GROUP BY 1),
          s AS (SELECT target, k * ceil(sum(k) OVER () * 0.25) / sum(k) OVER () AS share, ceil(sum(k) OVER () * 0.25) AS wanted FROM c),
          q AS (SELECT *, floor(share) + CASE WHEN row_number() OVER (ORDER BY floor(share) - share, target) <= wanted - sum(floor(share)) OVER ()
            THEN 1 ELSE 0 END AS take FROM s)
          SELECT o_orderkey, target, CAST(row_number() OVER (PARTITION BY target ORDER BY {u_sql(42, 'split', 'o_orderkey')}, o_orderkey) <= take AS INTEGER) AS is_test
          FROM tab JOIN q USING (target)""",
    ),
    "dense_index": (
        dense_rank_rows,
        """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag,
          row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_quantity) - 1 AS position FROM lineitem""",
    ),
    "independent": (
        independent_orders,
        f"WITH {independent_sql('orders', _ORDER_COLUMNS, ['o_orderpriority', 'o_orderstatus'], 'o_orderkey')} SELECT * FROM synth",
    ),
    "independent_lineitem": (
        independent_lineitem,
        f"""WITH {independent_sql('lineitem', _ITEM_COLUMNS, _ITEM_COLUMNS[:4], 'l_extendedprice, l_orderkey, l_linenumber')}
          SELECT * FROM synth""",
    ),
    "normal_scores": (
        normal_scores,
        f"""WITH {_ranks_sql(_COPULA_COLUMNS, 'o_orderkey', 'orders')}
          SELECT o_orderkey, {', '.join(f'round({_score_sql(f"r{i}", "n")}, 6) AS score_{c}' for i, c in enumerate(_COPULA_COLUMNS))} FROM ranked""",
    ),
    "copula_corr": (
        copula_corr,
        f"""WITH {_ranks_sql(_CORR, 'p_partkey', 'part')}, z AS (
          SELECT {', '.join(f'{_score_sql(f"r{i}", "n")} AS z{i}' for i in range(4))} FROM ranked)
          {' UNION ALL '.join(
              f"SELECT '{a}' AS col_a, '{b}' AS col_b, " + ("1.0::DOUBLE" if i == j else f"round(corr(z{i}, z{j}), 6)") + " AS corr FROM z"
              + (" LIMIT 1" if False else " HAVING count(*) > 0" if i == j else "")
              for i, a in enumerate(_CORR) for j, b in enumerate(_CORR))}""",
    ),
    "copula_synth_levels": (copula_synth_levels, _no_new_levels_sql(["o_orderstatus", "o_orderpriority", "o_custkey"])),
    "seq_rf_levels": (seq_rf_levels, _no_new_levels_sql(SEQ_CATEGORIES)),
    "copula_synth": (copula_synth, None),
    "copula_synth_aligned": (copula_synth_aligned, None),
    "normal_cdf": (normal_cdf, None),
    "seq_rf": (seq_rf, None),
    "seq_gbt": (seq_gbt, None),
    "class_draw": (
        class_draw,
        f"""WITH w AS (SELECT o_orderkey, {', '.join(f"{u_sql(7, f'weight:{k}', 'o_orderkey')} + 0.1::DOUBLE AS w{k}" for k in range(3))},
          {u_sql(7, 'class', 'o_orderkey')} AS u FROM orders)
          SELECT o_orderkey, CASE WHEN u < w0 / (w0 + w1 + w2) THEN 0 WHEN u < w0 / (w0 + w1 + w2) + w1 / (w0 + w1 + w2) THEN 1 ELSE 2 END AS class_index FROM w""",
    ),
    "residual_bootstrap": (
        residual_bootstrap,
        f"""WITH s AS (SELECT o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS residual,
          row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)
          SELECT r.idx AS row_id, round(s.residual, 4) AS residual FROM s r JOIN s ON s.idx = {draw_sql(42, 'bootstrap:residual', 'r.n', 'r.idx')}""",
    ),
    "domain_repair": (
        domain_repair,
        f"""WITH {_REAL_PART}, s AS (SELECT p_partkey AS row_id, {_NOISY.format(x='p_size + 0.5')} AS p_size, {_NOISY.format(x='p_size / 2')} AS p_low,
          {_NOISY.format(x='p_retailprice')} AS p_retailprice, p_type FROM part)
          SELECT row_id, CAST(coalesce(round_even(TRY_CAST(s.p_size AS DOUBLE), 0), trunc((SELECT median(p_size) FROM real))) AS INTEGER) AS p_size,
          CASE WHEN TRY_CAST(s.p_low AS DOUBLE) IS NULL THEN (SELECT min(p_low) FROM real) ELSE {_NEAREST} END AS p_low,
          TRY_CAST(s.p_retailprice AS DOUBLE) AS p_retailprice, p_type FROM s""",
    ),
    "cast_back": (
        cast_back_types, "SELECT p_partkey, p_size, CAST(NULL AS DOUBLE) AS p_retailprice, p_type FROM part",
    ),
    "half_even": (
        half_even,
        "SELECT l_orderkey, l_linenumber, l_quantity, CAST(round_even(l_quantity / 2, 0) AS INTEGER) AS half FROM lineitem",
    ),
}
