"""Columns with few distinct values: sorted positions map to values through a short table, without a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.sampling import _FIELDS, decode_cell, melt_cells

#: Above this many distinct values a column is gathered by join instead.
LEVEL_LIMIT = 256


def few_valued(df: DataFrame, limit: int = LEVEL_LIMIT) -> list[str]:
    """Columns that certainly have at most ``limit`` values, nulls counted, decided by a mergeable sketch first."""
    sketch = df.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in df.columns]).first()
    near = [c for c in df.columns if sketch[c] < limit]
    if not near:
        return []
    exact = df.agg(*[
        (F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in near
    ]).first()
    return [c for c in near if exact[c] is not None and exact[c] <= limit]


def level_tables(df: DataFrame, columns: Sequence[str]) -> dict[str, list[tuple[dict, int]]]:
    """For each few-valued column its distinct cells in sort order with their counts."""
    if not columns:
        return {}
    rows = (
        melt_cells(df, columns, [])
        .groupBy("col", *_FIELDS).agg(F.count("*").alias("n"))
        .orderBy("col", *_FIELDS)
        .collect()
    )
    tables: dict[str, list[tuple[dict, int]]] = {c: [] for c in columns}
    for r in rows:
        tables[columns[r["col"]]].append(({f: r[f] for f in _FIELDS}, r["n"]))
    return tables


def place_levels(draws: DataFrame, schema, tables: dict[str, list[tuple[dict, int]]]) -> DataFrame:
    """Replace each drawn sorted position ``_at_<column>`` of a few-valued column by its value."""
    splits, inputs = [], []
    for c, table in tables.items():
        if len(table) > 1:
            bounds = [0.0]
            for _, n in table:
                bounds.append(bounds[-1] + n)
            splits.append(bounds)
            inputs.append(c)
    if inputs:
        bucketed = Bucketizer(
            splitsArray=splits,
            inputCols=[f"_at_{c}" for c in inputs],
            outputCols=[f"_in_{c}" for c in inputs],
        )
        draws = bucketed.transform(draws.withColumns({f"_at_{c}": F.col(f"_at_{c}").cast("double") for c in inputs}))
    values = {}
    for c, table in tables.items():
        types = {"l": "bigint", "d": "double", "s": "string"}
        cells = [
            decode_cell({f: F.lit(cell[f]).cast(types[f]) for f in _FIELDS}, schema[c].dataType)
            for cell, _ in table
        ]
        at = F.col(f"_in_{c}").cast("int") + 1 if len(table) > 1 else F.lit(1)
        values[c] = F.element_at(F.array(*cells), at)
    return draws.withColumns(values).drop(*[f"_at_{c}" for c in tables], *[f"_in_{c}" for c in inputs])
