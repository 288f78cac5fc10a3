"""Column types as the rest of the library sees them, and the order statistics used for imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.numeric import as_level, as_number
from tabloom.operators.ranking import running_total

_INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Integer columns with at most this many distinct values are categories.
MAX_LEVELS = 20


def is_integer(data_type: T.DataType) -> bool:
    return isinstance(data_type, _INTEGER)


def is_numeric(data_type: T.DataType) -> bool:
    """Numeric storage; booleans count as numeric."""
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def level_counts(df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, int]:
    """Exact number of distinct non-null values of the columns that have at most ``max_levels`` of them.

    A sketch first rules out the columns far above the bound, so the exact pass only shuffles a few
    hundred values per task and column.
    """
    if not columns:
        return {}
    sketch = df.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in columns]).first()
    near = [c for c in columns if sketch[c] <= 10 * max_levels]
    if not near:
        return {}
    exact = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in near]).first()
    return {c: exact[c] for c in near if exact[c] <= max_levels}


def semantic_types(df: DataFrame, max_levels: int = MAX_LEVELS) -> dict[str, str]:
    """``numeric`` for numeric storage except low-cardinality integers; everything else ``categorical``."""
    integers = [f.name for f in df.schema if is_integer(f.dataType)]
    low = level_counts(df, integers, max_levels)
    return {
        f.name: "numeric" if is_numeric(f.dataType) and f.name not in low else "categorical"
        for f in df.schema
    }


def physical_types(df: DataFrame) -> dict[str, str]:
    """``numeric`` or ``categorical`` by storage type alone."""
    return {f.name: "numeric" if is_numeric(f.dataType) else "categorical" for f in df.schema}


def profile_columns(df: DataFrame, max_levels: int = MAX_LEVELS) -> DataFrame:
    """One row per column: storage type, distinct values of low-cardinality integers, semantic type."""
    integers = [f.name for f in df.schema if is_integer(f.dataType)]
    low = level_counts(df, integers, max_levels)
    rows = [
        (
            f.name,
            f.dataType.simpleString(),
            low.get(f.name),
            "numeric" if is_numeric(f.dataType) and f.name not in low else "categorical",
        )
        for f in df.schema
    ]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, n_levels bigint, sdtype string")


def _kind(f: T.StructField, ids: Sequence[str]) -> str:
    """What the storage type of a column says about it; ``integer`` still depends on the number of its values."""
    if f.name in ids:
        return "id"
    if isinstance(f.dataType, T.BooleanType):
        return "boolean"
    if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "integer" if is_integer(f.dataType) else "numerical" if is_numeric(f.dataType) else "categorical"


def _named(name: str) -> Column:
    """A column by its whole name, points and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _sdtype(kind: Column, n: Column, max_levels: int) -> Column:
    return F.when(kind != "integer", kind).when(n <= max_levels, "categorical").otherwise("numerical")


def column_metadata(df: DataFrame, ids: Sequence[str] = (), max_levels: int = MAX_LEVELS) -> DataFrame:
    """One row per column: storage type, kind and exact number of distinct non-null values.

    Kinds: ``id`` for the named columns, ``boolean``, ``datetime``, ``categorical`` for text and for integers of at most
    ``max_levels`` values, ``numerical`` for all other numbers. Values are combined within tasks before one shuffle; where
    the exact numbers are not needed, ``sketched_metadata`` spares that.
    """
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f.name).cast("string").alias("value")) for f in df.schema])
    counts = df.select(F.explode(cells).alias("cell")).select("cell.*").where("value IS NOT NULL").distinct().groupBy("column").count()
    known = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString(), _kind(f, ids)) for f in df.schema], "column string, dtype string, kind string"
    )
    n = F.coalesce("count", F.lit(0))
    return known.join(counts, "column", "left").select(
        "column", "dtype", _sdtype(F.col("kind"), n, max_levels).alias("sdtype"), n.alias("n_distinct")
    )


def column_sketches(df: DataFrame) -> DataFrame:
    """``(column, dtype, n_rows, n_missing, sketch)``: one row per column, from one aggregate without a shuffle of values.

    ``sketch`` is a distinct-count sketch of a few kilobytes. Store it beside a part of a table; ``merged_sketches``
    adds parts up, so an append reads the new rows only.
    """
    cells = [
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.count("*").alias("n_rows"),
            F.count_if(_named(f.name).isNull()).alias("n_missing"),
            F.hll_sketch_agg(_named(f.name).cast("string")).alias("sketch"),
        ) for f in df.schema
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("cell")).select("cell.*")


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """The sketches of a table from those of its parts."""
    return sketches.groupBy("column", "dtype").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"), F.hll_union_agg("sketch").alias("sketch")
    ).select("column", "dtype", "n_rows", "n_missing", "sketch")


def sketched_metadata(
    df: DataFrame, sketches: DataFrame | None = None, ids: Sequence[str] = (), max_levels: int = MAX_LEVELS
) -> DataFrame:
    """As ``column_metadata`` with the kinds exact and the distinct counts estimated: (column, dtype, sdtype, n_rows,
    n_missing, n_distinct, exact).

    Only integer columns whose estimate is at most ten times ``max_levels``, far beyond the error of the sketch, are counted
    exactly (``exact``), since their kind depends on the count. ``sketches`` are stored ones of ``df``.
    """
    sketches = column_sketches(df) if sketches is None else sketches
    rows = sketches.select(
        "column", "n_rows", "n_missing", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("n")
    ).collect()
    about = {r["column"]: r for r in rows}
    near = [f.name for f in df.schema if _kind(f, ids) == "integer" and about[f.name]["n"] <= 10 * max_levels]
    counted = df.agg(*[F.count_distinct(_named(c)).alias(c) for c in near]).first() if near else {}
    known = df.sparkSession.createDataFrame(
        [
            (f.name, f.dataType.simpleString(), _kind(f, ids), about[f.name]["n_rows"], about[f.name]["n_missing"],
             counted[f.name] if f.name in near else about[f.name]["n"], f.name in near)
            for f in df.schema
        ],
        "column string, dtype string, kind string, n_rows long, n_missing long, n_distinct long, exact boolean",
    )
    sdtype = _sdtype(F.col("kind"), F.col("n_distinct"), max_levels)
    return known.select("column", "dtype", sdtype.alias("sdtype"), "n_rows", "n_missing", "n_distinct", "exact")


def metadata_document(metadata: DataFrame) -> DataFrame:
    """One row ``document``: metadata of a table as JSON, an object ``columns`` with one entry per column by name."""
    facts = [c for c in metadata.columns if c != "column"]
    entry = F.struct(F.col("column"), F.struct(*[F.col(c) for c in facts]).alias("facts"))
    columns = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    return metadata.agg(F.to_json(F.struct(columns.alias("columns"))).alias("document"))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of each value of one column."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def melt_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``(column, level)`` of categorical columns."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), as_level(F.col(c)).alias("level")) for c in columns
    ])
    return df.select(F.explode(cells).alias("cell")).select("cell.*")


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-null value of each column as text; a tie goes to the smallest."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns
    ])
    counts = (
        df.select(F.explode(cells).alias("cell")).select("cell.*")
        .filter(F.col("level").isNotNull())
        .groupBy("column", "level").agg(F.count("*").alias("n"))
    )
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("level"))).alias("best"))
    return best.select("column", F.col("best.level").alias("most_frequent"), (-F.col("best.n")).alias("n"))


#: Bins of a column in one pass of the selection, and passes after which what is left is counted value by value.
BINS = 4096
_PASSES = 8


def exact_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact, interpolated median of each numeric column; NaN is above all numbers, columns without values are left out.

    Selection by narrowing histograms: a pass counts the values of at most ``BINS`` equal bins between the bounds known so
    far and keeps the least and greatest of each bin, which bound the next pass. It ends where the middle lies between
    two bins or in one of a single value: two or three passes for most columns. No exchange and nothing on the driver is
    larger than the bins of the columns, and a hot value is one count per task. Values so uneven that the passes do not
    part them are counted one by one inside the bounds that are left.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), as_number(F.col(c)).cast("double").alias("value")) for c in columns
    ])
    values = df.select(F.explode(cells).alias("cell")).select("cell.*").filter(F.col("value").isNotNull())
    value, infinity = F.col("value"), float("inf")
    finite = F.when(~F.isnan(value) & (F.abs(value) != infinity), value)
    ranges = values.groupBy("column").agg(
        F.count("*").alias("n"), F.count(finite).alias("finite"), F.count_if(value == -infinity).alias("below"),
        F.count_if(F.isnan(value)).alias("nan"), F.min(finite).alias("low"), F.max(finite).alias("high"),
    ).collect()
    #: per column the two middle ranks, the values found for them, and (least, greatest, values before) still to be searched
    ranks, found, open_ = {}, {}, {}
    for r in ranges:
        ranks[r["column"]] = ((r["n"] - 1) // 2, r["n"] // 2)
        steps = [(r["below"], -infinity, -infinity), (r["finite"], r["low"], r["high"]),
                 (r["n"] - r["below"] - r["finite"] - r["nan"], infinity, infinity), (r["nan"], float("nan"), float("nan"))]
        _narrow(r["column"], steps, 0, ranks, found, open_)
    for _ in range(_PASSES):
        if not open_:
            break
        inside = _inside(values, open_)
        part = F.try_divide(value / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)
        place = F.least(F.floor(F.coalesce(part, F.lit(0.0)) * BINS), F.lit(BINS - 1))
        counted = inside.groupBy("column", place.alias("bin")).agg(
            F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        ).collect()
        steps = {}
        for r in sorted(counted, key=lambda r: r["bin"]):
            steps.setdefault(r["column"], []).append((r["n"], r["low"], r["high"]))
        before = {c: n for c, (_, _, n) in open_.items()}
        open_ = {}
        for c, own in steps.items():
            _narrow(c, own, before[c], ranks, found, open_)
    if open_:
        counts = _inside(values, open_).groupBy("column", "value", "before").agg(F.count("*").alias("n"))
        placed = running_total(counts, ["value"], "n", within=["column"]).withColumn("first", F.col("before") + F.col("_before"))
        wanted = df.sparkSession.createDataFrame([(c, rank) for c in open_ for rank in ranks[c]], "column string, rank long")
        hit = (F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("first") + F.col("n"))
        for r in placed.join(F.broadcast(wanted), "column").where(hit).select("column", "rank", "value").collect():
            low, high = ranks[r["column"]]
            pair = found.setdefault(r["column"], [None, None])
            pair[0] = r["value"] if r["rank"] == low else pair[0]
            pair[1] = r["value"] if r["rank"] == high else pair[1]
    medians = [(c, pair[0] / 2 + pair[1] / 2 if abs(pair[0]) > 1e300 else (pair[0] + pair[1]) / 2) for c, pair in found.items()]
    return df.sparkSession.createDataFrame(medians, "column string, median double")


def _narrow(column: str, steps: list, before: int, ranks: dict, found: dict, open_: dict) -> None:
    """Find the steps (count, least, greatest), in order, that hold the middle ranks of a column."""
    low, high = ranks[column]
    for n, least, greatest in steps:
        last = before + n - 1
        if n and before <= low <= last and high <= last:
            if least == greatest or least != least:
                found[column] = [least, least]
            elif n == 2:
                found[column] = [least if low == before else greatest, greatest if high == last else least]
            else:
                open_[column] = (least, greatest, before)
        elif n and before <= low <= last:
            found[column] = [greatest, None]
        elif n and before <= high <= last:
            found[column][1] = least
        before += n


def _inside(values: DataFrame, open_: dict) -> DataFrame:
    """The values between the bounds of their columns; one row of bounds a column is broadcast."""
    bounds = values.sparkSession.createDataFrame(
        [(c, *b) for c, b in open_.items()], "column string, low double, high double, before long"
    )
    return values.join(F.broadcast(bounds), "column").where(F.col("value").between(F.col("low"), F.col("high")))


def scale_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each column; a zero deviation is reported as 1."""
    row = df.agg(*[
        F.struct(
            F.avg(as_number(F.col(c))).alias("mean"), F.stddev_pop(as_number(F.col(c))).alias("scale")
        ).alias(c)
        for c in columns
    ])
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.col(c)["mean"].alias("mean"),
            F.when(F.col(c)["scale"] == 0.0, F.lit(1.0)).otherwise(F.col(c)["scale"]).alias("scale"),
        )
        for c in columns
    ])
    return row.select(F.explode(cells).alias("cell")).select("cell.*")
