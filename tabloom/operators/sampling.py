"""Seeded sampling: bootstrap, exact subsample, shuffle order, stratified split, and gather by position."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.hashing import draw_index, uniform
from tabloom.operators.profile import is_integer
from tabloom.operators.ranking import dense_index
from tabloom.session import BROADCAST_ROWS

# --- exact choice of the k rows with the smallest hash -------------------------------------------


def _smallest(df: DataFrame, u: Column, key: Sequence[str], n: int, k: int) -> Column:
    """Predicate that holds for exactly ``k`` of the ``n`` rows: those first by (u, key).

    The k-th value of n uniform numbers lies within a few standard deviations of k/n, so only that narrow
    band is sorted; the table itself is never shuffled. If the band misses, the whole range is used.
    """
    if k <= 0:
        return F.lit(False)
    if k >= n:
        return F.lit(True)
    narrow = df.select(u.alias("_u"), *key)
    share = k / n
    slack = 8.0 * math.sqrt(share * (1.0 - share) / n) + 32.0 / n
    for low, high in ((share - slack, share + slack), (0.0, 1.0)):
        seen = narrow.agg(
            F.sum((F.col("_u") < low).cast("bigint")).alias("below"),
            F.sum((F.col("_u") <= high).cast("bigint")).alias("upto"),
        ).first()
        if seen["below"] < k <= seen["upto"]:
            band = narrow.filter((F.col("_u") >= low) & (F.col("_u") <= high))
            edge = (
                band.orderBy("_u", *key).limit(k - seen["below"])
                .agg(F.max(F.struct("_u", *key)).alias("edge")).first()["edge"]
            )
            types = {c: narrow.schema[c].dataType for c in key}
            return F.struct(u.alias("_u"), *key) <= F.struct(
                F.lit(edge["_u"]).alias("_u"), *[F.lit(edge[c]).cast(types[c]).alias(c) for c in key]
            )
    raise AssertionError("unreachable: the full range always contains the k-th row")


def cap_rows(df: DataFrame, key: Sequence[str], cap: int, seed: int = 42, salt: str = "cap") -> DataFrame:
    """Exactly ``cap`` rows without replacement, or all rows when there are no more."""
    n = df.count()
    if n <= cap:
        return df
    u = uniform(seed, salt, *[F.col(c) for c in key])
    return df.filter(_smallest(df, u, key, n, cap))


def split_sizes(class_sizes: Mapping[int, int], test_size: float) -> dict[int, int]:
    """Test rows per class: proportional, rounded by largest remainder to ceil(n * test_size) in total."""
    n = sum(class_sizes.values())
    wanted = math.ceil(n * test_size)
    share = {c: size * wanted / n for c, size in class_sizes.items()}
    sizes = {c: math.floor(s) for c, s in share.items()}
    by_remainder = sorted(share, key=lambda c: (sizes[c] - share[c], c))
    for c in by_remainder[: wanted - sum(sizes.values())]:
        sizes[c] += 1
    return sizes


def stratified_split(
    df: DataFrame, key: Sequence[str], target_col: str = "target", test_size: float = 0.25, seed: int = 42,
    name: str = "is_test",
) -> DataFrame:
    """Mark an exact stratified test share; the classes are few (a binary target)."""
    sizes = {r[0]: r[1] for r in df.groupBy(target_col).count().collect()}
    u = uniform(seed, "split", *[F.col(c) for c in key])
    mark = F.lit(False)
    for label, k in split_sizes(sizes, test_size).items():
        member = F.col(target_col) == F.lit(label)
        mark = F.when(member, _smallest(df.filter(member), u, key, sizes[label], k)).otherwise(mark)
    return df.withColumn(name, mark)


def shuffle_position(df: DataFrame, key: Sequence[str], seed: int = 42, name: str = "position") -> DataFrame:
    """Add a random dense position; sort by it only when exporting."""
    keyed = df.withColumn("_u", uniform(seed, "shuffle", *[F.col(c) for c in key]))
    return dense_index(keyed, ["_u", *key], name=name).drop("_u")


# --- gather: (row, position) pairs to values -----------------------------------------------------

_FIELDS = ("l", "d", "s")


def _field(data_type: T.DataType) -> str:
    if is_integer(data_type) or isinstance(data_type, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "l"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "d"
    if isinstance(data_type, T.StringType):
        return "s"
    raise TypeError(f"Cast columns of type {data_type.simpleString()} to a number or a string first.")


def encode_cell(value: Column, data_type: T.DataType) -> dict[str, Column]:
    """A value of any column type as three sortable columns: integer, floating, text."""
    if isinstance(data_type, T.DateType):
        value = F.unix_date(value)
    elif isinstance(data_type, T.TimestampNTZType):
        value = F.unix_micros(value.cast("timestamp"))
    elif isinstance(data_type, T.TimestampType):
        value = F.unix_micros(value)
    kind = _field(data_type)
    types = {"l": "bigint", "d": "double", "s": "string"}
    return {f: (value if f == kind else F.lit(None)).cast(types[f]) for f in _FIELDS}


def decode_cell(cell: Mapping[str, Column], data_type: T.DataType) -> Column:
    value = cell[_field(data_type)]
    if isinstance(data_type, T.DateType):
        return F.date_from_unix_date(value.cast("int"))
    if isinstance(data_type, T.TimestampNTZType):
        return F.timestamp_micros(value).cast(data_type)
    if isinstance(data_type, T.TimestampType):
        return F.timestamp_micros(value)
    return value.cast(data_type)


def melt_cells(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long form ``(keep…, col, l, d, s)`` where ``col`` is the position in ``columns``."""
    types = {f.name: f.dataType for f in df.schema}
    cells = F.array(*[
        F.struct(F.lit(i).alias("col"), *[v.alias(f) for f, v in encode_cell(F.col(c), types[c]).items()])
        for i, c in enumerate(columns)
    ])
    return df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.*")


#: Cells that one task should sort or join.
CELLS_PER_TASK = 1_000_000


def cell_parts(spark: SparkSession, cells: int) -> int | None:
    """Tasks for a large number of cells, so that the memory of a task does not grow with them; None: few enough for Spark to choose."""
    parts = -(-cells // CELLS_PER_TASK)
    return parts if parts > spark.sparkContext.defaultParallelism else None


def gather(
    draws: DataFrame, source: DataFrame, columns: Mapping[str, tuple[int, T.DataType]], source_rows: int,
    row: str = "row_id", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Replace the drawn positions ``_at_<column>`` in ``draws`` by the values found there.

    ``source`` is long: ``(col, idx, l, d, s)`` with 0-based ``idx`` below ``source_rows``; ``columns`` gives the
    ``col`` number and type of each name. A source of checked small size is joined by broadcast, column by
    column and without any shuffle. A larger one is joined once for all columns on ``(col, idx)`` and
    brought back to rows by key. Both sides then have many more keys than a task has, and draws spread evenly. All other
    columns of ``draws`` travel with the first of its positions, so draws are made once; they are best numbers, which
    are brought back without a sort.
    """
    if not columns:
        return draws
    if source_rows <= broadcast_rows:
        for name, (number, data_type) in columns.items():
            values = source.filter(F.col("col") == number).select(
                F.col("idx").alias(f"_at_{name}"),
                decode_cell({f: F.col(f) for f in _FIELDS}, data_type).alias(name),
            )
            draws = draws.join(F.broadcast(values), f"_at_{name}").drop(f"_at_{name}")
        return draws
    others = [c for c in draws.columns if c != row and c not in {f"_at_{name}" for name in columns}]
    types = {c: draws.schema[c].dataType for c in others}
    wanted = F.array(*[
        F.struct(
            F.lit(number).alias("col"), F.col(f"_at_{name}").alias("idx"),
            *[(F.col(c) if k == 0 else F.lit(None).cast(types[c])).alias(f"_with_{i}") for i, c in enumerate(others)],
        )
        for k, (name, (number, _)) in enumerate(columns.items())
    ])
    asked = draws.select(row, F.explode(wanted).alias("want")).select(row, "want.*")
    cells = source.where(F.col("col").isin([number for number, _ in columns.values()])).select("col", "idx", *_FIELDS)
    parts = cell_parts(draws.sparkSession, source_rows * len(columns))
    if parts:
        asked, cells = asked.repartition(parts, "col", "idx"), cells.repartition(parts, "col", "idx")
    found = asked.join(cells, ["col", "idx"])

    def value(number: int, data_type: T.DataType) -> Column:
        mine, field = F.col("col") == number, _field(data_type)
        return decode_cell({field: F.max(F.when(mine, F.col(field)))}, data_type)

    return found.groupBy(row).agg(
        *[F.first(f"_with_{i}", ignorenulls=True).alias(c) for i, c in enumerate(others)],
        *[value(n, t).alias(name) for name, (n, t) in columns.items()],
    )


def bootstrap_column(df: DataFrame, column: str, order_by: Sequence[str], n_rows: int, seed: int = 42) -> DataFrame:
    """``n_rows`` values of one column drawn with replacement: ``(row_id, column)``."""
    data_type = df.schema[column].dataType
    indexed = dense_index(df.select(column, *[c for c in order_by if c != column]), list(order_by), name="idx")
    source = melt_cells(indexed, [column], ["idx"])
    size = indexed.count()
    draws = df.sparkSession.range(n_rows).select(
        F.col("id").alias("row_id"),
        draw_index(seed, f"bootstrap:{column}", size, F.col("id")).alias(f"_at_{column}"),
    )
    return gather(draws, source, {column: (0, data_type)}, size)
