"""Bring generated columns back into the domain of the real table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.numeric import as_number, half_even
from tabloom.operators.profile import MAX_LEVELS, exact_median, is_integer, level_counts


def nearest_valid(value: Column, valid: list[int], data_type: T.DataType) -> Column:
    """Closest of the sorted valid values, the lower one on a tie; a missing value becomes the smallest."""
    scored = F.array(*[F.struct(F.abs(value - F.lit(float(v))).alias("d"), F.lit(v).alias("v")) for v in valid])
    return F.when(value.isNull(), F.lit(valid[0])).otherwise(F.array_min(scored)["v"]).cast(data_type)


def cast_back(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the source types, in source column order; a column that was not generated becomes NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def repair_domains(
    real: DataFrame, synth: DataFrame, max_levels: int = MAX_LEVELS, keep: tuple[str, ...] = ("row_id",)
) -> DataFrame:
    """Integers go to a valid value (few levels) or are rounded (many; missing becomes the median), floats to
    number-or-NULL, the rest to text. Generated columns keep the source order; columns not generated are NULL."""
    integers = [f.name for f in real.schema if is_integer(f.dataType) and f.name in synth.columns]
    low = list(level_counts(real, integers, max_levels))
    high = [c for c in integers if c not in low]
    valid = real.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in low]).first() if low else {}
    parsed = {c: F.col(c).try_cast("double") for c in synth.columns}
    open_high = []
    if high:
        gaps = synth.agg(*[F.bool_or(as_number(parsed[c]).isNull()).alias(c) for c in high]).first()
        open_high = [c for c in high if gaps[c]]
    medians = {r["column"]: r["median"] for r in exact_median(real, open_high).collect()} if open_high else {}
    columns = []
    for f in real.schema:
        c = f.name
        if c not in synth.columns:
            value = F.lit(None).cast(f.dataType)
        elif c in low:
            value = nearest_valid(as_number(parsed[c]), list(valid[c]), f.dataType) if valid[c] else F.lit(None).cast(f.dataType)
        elif c in high:
            value = F.coalesce(half_even(as_number(parsed[c]), f.dataType), F.lit(medians.get(c)).cast(f.dataType))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            value = as_number(parsed[c]).cast(f.dataType)
        else:
            value = F.col(c).cast("string")
        columns.append(value.alias(c))
    return synth.select(*[c for c in keep if c in synth.columns and c not in real.columns], *columns)
