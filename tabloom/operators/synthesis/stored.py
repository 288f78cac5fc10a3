"""Fits kept in a folder: tables for what grows with the data, and a manifest, written last, for what is small."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabloom.operators.sampling import _FIELDS

_LEVELS = "column string, place int, l bigint, d double, s string, n bigint"


def write_manifest(spark: SparkSession, folder: str, held: dict) -> None:
    """The manifest of a fit; a folder without one holds no fit."""
    spark.createDataFrame([(json.dumps(held),)], "manifest string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.parquet(f"{folder}/manifest").head()["manifest"])


def write_levels(spark: SparkSession, folder: str, tables: dict[str, list[tuple[dict, int]]]) -> None:
    """The counted levels of few-valued columns in their order, a bounded number for each column."""
    rows = [(c, i, *(cell[f] for f in _FIELDS), n) for c, table in tables.items() for i, (cell, n) in enumerate(table)]
    spark.createDataFrame(rows, _LEVELS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/levels")


def read_levels(spark: SparkSession, folder: str) -> dict[str, list[tuple[dict, int]]]:
    tables: dict[str, list[tuple[dict, int]]] = {}
    for r in spark.read.schema(_LEVELS).parquet(f"{folder}/levels").orderBy("column", "place").collect():
        tables.setdefault(r["column"], []).append(({f: r[f] for f in _FIELDS}, r["n"]))
    return tables


def write_cells(folder: str, cells: DataFrame | None) -> None:
    """The sorted cells of many-valued columns, if there are any."""
    if cells is not None:
        cells.write.mode("overwrite").parquet(f"{folder}/cells")


def type_of(text: str) -> T.DataType:
    """A column type from its JSON."""
    return T.StructType.fromJson({"type": "struct", "fields": [
        {"name": "x", "type": json.loads(text), "nullable": True, "metadata": {}}
    ]})["x"].dataType


def load_stored(spark: SparkSession, folder: str):
    """The fit that any ``save`` of this package wrote to ``folder``, by the kind its manifest names."""
    from tabloom.operators.synthesis.copula import load_copula
    from tabloom.operators.synthesis.independent import load_independent
    from tabloom.operators.synthesis.sequential import load_fit

    loaders = {"independent": load_independent, "copula": load_copula, "sequential": load_fit}
    return loaders[read_manifest(spark, folder.rstrip("/")).get("kind", "sequential")](spark, folder)
