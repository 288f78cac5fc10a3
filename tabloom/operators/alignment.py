"""Weak alignment: give every tabular row a text row that its target allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.hashing import draw_index
from tabloom.operators.cleaning import require_columns
from tabloom.operators.ranking import dense_index
from tabloom.session import BROADCAST_ROWS


def check_rules(tabular: DataFrame, rules: DataFrame, target_col: str = "target") -> None:
    """Raise if a target of the table has no rule; by default such rows are dropped."""
    missing = tabular.select(F.col(target_col).alias("target")).distinct().join(rules, "target", "left_anti")
    total = missing.count()
    if total:
        found = [r[0] for r in missing.orderBy("target").limit(20).collect()]
        raise ValueError(f"No rule for {total} target values, first: {found}")


def text_pools(text: DataFrame, rules: DataFrame, key: str, label_col: str = "sentiment") -> DataFrame:
    """Text rows per target with ``pool_idx`` 0..m-1 in key order; a label may serve several targets."""
    allowed = rules.select("target", F.col("label").alias(label_col)).distinct()
    return dense_index(text.join(F.broadcast(allowed), label_col), [key], within=["target"], name="pool_idx")


def weak_alignment(
    tabular: DataFrame, text: DataFrame, rules: DataFrame, tabular_key: str, text_key: str, seed: int = 42,
    target_col: str = "target", label_col: str = "sentiment", prefix: str = "text_",
    keep_text_key: bool = False, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Each tabular row draws one allowed text row with replacement; text columns get ``prefix``.

    Rows whose target has no rule are dropped. A ruled target without tabular rows is an error, as is one that
    has rows but no allowed text.
    Targets with a small pool meet it by broadcast, so that few text rows drawn by very many tabular rows
    make no hot join key; targets with a large pool are joined on (target, pool_idx).
    """
    require_columns(tabular, [target_col, tabular_key])
    require_columns(text, [label_col, text_key])
    present = {r[0] for r in tabular.join(F.broadcast(rules.select(F.col("target").alias(target_col)).distinct()), target_col)
               .select(target_col).distinct().collect()}
    pools = text_pools(text, rules, text_key, label_col)
    sizes = {r["target"]: r["count"] for r in pools.groupBy("target").count().collect()}
    ruled = [r[0] for r in rules.select("target").distinct().collect()]
    absent = sorted(t for t in ruled if t not in present)
    if absent:
        raise ValueError(f"Rules without rows in the table, for target values: {absent}")
    empty = sorted(t for t in ruled if t not in sizes)
    if empty:
        raise ValueError(f"No text row is allowed for target values: {empty}")
    if not sizes:
        raise ValueError("No text row is allowed for any target.")
    table = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    size_of = F.coalesce(F.element_at(table, F.col(target_col)), F.lit(0))
    drawn = tabular.filter(F.col(target_col).isin(list(sizes))).withColumn(
        "pool_idx", draw_index(seed, "align", size_of, F.col(tabular_key))
    )
    named = pools.select(
        F.col("target").alias("_target"), F.col("pool_idx").alias("_pool_idx"),
        *[F.col(c).alias(f"{prefix}{c}") for c in text.columns if keep_text_key or c != text_key],
    )
    small, total = [], 0
    for target, size in sorted(sizes.items(), key=lambda item: item[1]):
        if total + size <= broadcast_rows:
            small.append(target)
            total += size
    match = (F.col(target_col) == F.col("_target")) & (F.col("pool_idx") == F.col("_pool_idx"))
    parts = []
    if small:
        pool = F.broadcast(named.filter(F.col("_target").isin(small)))
        parts.append(drawn.filter(F.col(target_col).isin(small)).join(pool, match))
    if len(small) < len(sizes):
        pool = named.filter(~F.col("_target").isin(small))
        parts.append(drawn.filter(~F.col(target_col).isin(small)).join(pool, match))
    out = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    return out.drop("_target", "_pool_idx", "pool_idx")
