"""The table behind a method comparison figure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Display order and labels.
METHOD_LABELS = {
    "independent": "Ind.", "gaussian_copula": "Gauss.", "random_forest": "RF", "xgboost": "XGB",
    "ctgan": "CTGAN", "tvae": "TVAE",
}


def _label(column: str, labels: Mapping[str, object]):
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.try_element_at(table, F.col(column))


def comparison_table(
    summaries: Sequence[DataFrame], dataset_labels: Mapping[str, str],
    method_labels: Mapping[str, str] = METHOD_LABELS,
) -> DataFrame:
    """Union of summaries, limited to the datasets and methods that have a label, labelled, in display order."""
    combined = summaries[0]
    for s in summaries[1:]:
        combined = combined.unionByName(s, allowMissingColumns=True)
    order = {m: i for i, m in enumerate(method_labels)}
    return (
        combined.filter(F.col("dataset").isin(list(dataset_labels)) & F.col("method").isin(list(method_labels)))
        .withColumns({
            "benchmark": _label("dataset", dataset_labels),
            "method_label": _label("method", method_labels),
            "method_order": _label("method", order),
        })
        .orderBy("benchmark", "method_order")
    )


def missing_methods(table: DataFrame, method_labels: Mapping[str, str] = METHOD_LABELS) -> DataFrame:
    """``(benchmark, method)`` pairs that a complete comparison would also need."""
    wanted = table.select("benchmark").distinct().select(
        "benchmark", F.explode(F.array(*[F.lit(m) for m in method_labels])).alias("method")
    )
    return wanted.join(table, ["benchmark", "method"], "left_anti")


def require_complete(table: DataFrame, method_labels: Mapping[str, str] = METHOD_LABELS) -> None:
    missing = [f"{r['benchmark']}: {r['method']}" for r in missing_methods(table, method_labels).orderBy("benchmark", "method").collect()]
    if missing:
        raise ValueError(f"Missing methods: {missing}")
