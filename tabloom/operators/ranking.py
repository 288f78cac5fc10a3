"""Dense positions and running totals over a whole table, without a single-task window.

Rows are range-partitioned on the sort columns (so one hot value is split as long as the sort columns
end in a key), written out once, and numbered from the sizes of the earlier partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import cut_lineage, inline_if_small

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number within a partition in its low 33 bits


def _offsets(df: DataFrame, part: str, weight: str) -> DataFrame:
    """Start of each partition: one row per partition, so its size is bounded by the partition count."""
    totals = sorted((r[0], r[1]) for r in df.groupBy(part).agg(F.sum(weight)).collect())
    starts, total = [], 0
    for _, weight_sum in totals:
        starts.append(total)
        total += weight_sum or 0
    table = pa.table({
        part: pa.array([t[0] for t in totals], pa.int64()),
        "_offset": pa.array(starts, pa.int64()),
    })
    return F.broadcast(df.sparkSession.createDataFrame(table))


def _within(df: DataFrame, within: Sequence[str], name: str) -> DataFrame:
    """Restart the position at each group: subtract the smallest position of the group."""
    if not within:
        return df
    starts = inline_if_small(df.groupBy(*within).agg(F.min(name).alias("_start")))
    return df.join(starts, list(within)).withColumn(name, F.col(name) - F.col("_start")).drop("_start")


def dense_index(
    df: DataFrame, order_by: Sequence[str], within: Sequence[str] = (), name: str = "_idx", parts: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row in the order ``within + order_by``, restarting per ``within`` group.

    ``order_by`` must end in columns that make rows distinct (or interchangeable). ``within`` must not be null. ``parts``
    is the number of ranges; without it Spark chooses by bytes after compression, of which sorted tasks need many times as much.
    """
    order = [*within, *order_by]
    numbered = cut_lineage(
        (df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)).sortWithinPartitions(*order)
        .withColumn("_position", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_position", _ROW_BITS))
    starts = _offsets(numbered.withColumn("_one", F.lit(1)), "_part", "_one")
    row = F.col("_position").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = (
        numbered.join(starts, "_part")
        .withColumn(name, F.col("_offset") + row)
        .drop("_part", "_position", "_offset")
    )
    return _within(placed, within, name)


def running_total(
    df: DataFrame, order_by: Sequence[str], weight: str, within: Sequence[str] = (), name: str = "_before"
) -> DataFrame:
    """Add the sum of an integer ``weight`` over all earlier rows, restarting per ``within`` group.

    Meant for pre-aggregated input, where the sort columns are already distinct.
    """
    order = [*within, *order_by]
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id().cast("bigint")))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(_offsets(ranged, "_part", weight), "_part")
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_part", "_offset", "_inside")
    )
    return _within(placed, within, name)
