"""Cleaning of unbounded input. The reference results are defined on whole tables, so only row-local steps stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabloom.operators.cleaning import (
    TabularSpec,
    TextSpec,
    _lookup,
    clean_strings,
    normalize_text_rows,
    require_columns,
    standardize_columns,
    text_statistics,
)


def clean_tabular_stream(stream: DataFrame, spec: TabularSpec) -> DataFrame:
    """Names, strings and the mapped target. A value outside the mapping stops the query with an error."""
    if not spec.target_map:
        raise ValueError("A stream needs a target_map: a target domain cannot be read off unbounded input.")
    out = clean_strings(standardize_columns(stream), spec.missing_tokens)
    require_columns(out, [spec.target_col])
    bad = F.raise_error(F.concat(F.lit("Unexpected target value: "), F.coalesce(F.col(spec.target_col).cast("string"), F.lit("NULL"))))
    out = out.withColumn("target", F.coalesce(_lookup(F.col(spec.target_col), spec.target_map), bad).cast("int"))
    return out.drop(spec.target_col) if spec.drop_source_target else out


def clean_text_stream(stream: DataFrame, spec: TextSpec) -> DataFrame:
    """Normalised, filtered text with statistics; first-occurrence dedupe is left to the batch job."""
    return text_statistics(normalize_text_rows(standardize_columns(stream), spec), spec.text_col)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything available now to a Parquet table and stop."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
