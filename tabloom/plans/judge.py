"""Synthesise a table and judge it in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabloom.operators.cleaning import require_same_columns
from tabloom.operators.fidelity import fidelity_report
from tabloom.operators.utility import utility_report
from tabloom.plans.sweep import Dataset, Generator
from tabloom.session import cut_lineage


def synthesize_and_judge(
    dataset: Dataset, generator: Generator, n_rows: int, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(synthetic, fidelity, utility)``; schema and row count are checked in between."""
    body = dataset.table.drop(*dataset.key)
    synth = cut_lineage(generator(dataset, n_rows, seed).select(*body.columns))
    require_same_columns(body, synth)
    found = synth.count()
    if found != n_rows:
        raise ValueError(f"Expected {n_rows} synthetic rows, found {found}.")
    return (
        synth,
        fidelity_report(body, synth),
        utility_report(dataset.table, synth, dataset.key, dataset.target_col, seed=seed),
    )
