"""Rank Gaussian copula: ranks to normal scores, correlated normal draws, back through sorted values."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.hashing import never_null, standard_normal
from tabloom.functions.numeric import normal_cdf, normal_score
from tabloom.operators.cleaning import require_rows
from tabloom.operators.ranking import dense_index
from tabloom.operators.sampling import _FIELDS, cell_parts, gather, melt_cells
from tabloom.operators.synthesis.levels import few_valued, level_tables, place_levels
from tabloom.operators.synthesis.stored import read_levels, read_manifest, write_cells, write_levels, write_manifest
from tabloom.session import BROADCAST_ROWS


@dataclass
class CopulaFit:
    """Sorted cells, counted levels and the factor of the rank correlation; any number of row sets cost one fit."""

    columns: list[str]
    size: int
    sorted_cells: DataFrame  # (col, idx, l, d, s)
    factor: np.ndarray  # of the rank correlation
    schema: T.StructType
    tables: dict[str, list[tuple[dict, int]]]  # of few-valued columns

    @property
    def many(self) -> dict[str, tuple[int, T.DataType]]:
        return {c: (i, self.schema[c].dataType) for i, c in enumerate(self.columns) if c not in self.tables}

    def generate(self, n_rows: int | None = None, seed: int = 42, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
        """Synthetic rows with a ``row_id``, as many as the table had unless ``n_rows`` says otherwise."""
        rows = self.sorted_cells.sparkSession.range(n_rows if n_rows is not None else self.size)
        normals = correlated_normals(rows.select(F.col("id").alias("row_id")), self.factor, seed)
        below_one = F.lit(1.0 - 2.0**-52)

        def position(i: int):
            drawn = F.least(normal_cdf(F.col(f"y_{i}")), below_one) * F.lit(float(self.size))
            return never_null(F.floor(drawn).cast("bigint"), 0)

        draws = normals.select("row_id", *[position(i).alias(f"_at_{c}") for i, c in enumerate(self.columns)])
        out = gather(draws, self.sorted_cells, self.many, self.size, broadcast_rows=broadcast_rows)
        return place_levels(out, self.schema, self.tables).select("row_id", *self.columns)

    def save(self, folder: str) -> None:
        """Write the cells of many-valued columns, the levels of all others and last the manifest below ``folder``."""
        spark, folder = self.sorted_cells.sparkSession, folder.rstrip("/")
        write_cells(folder, self.sorted_cells.where(F.col("col").isin([i for i, _ in self.many.values()])))
        write_levels(spark, folder, self.tables)
        write_manifest(spark, folder, {
            "kind": "copula", "schema": self.schema.json(), "columns": self.columns, "size": self.size,
            "factor": self.factor.tolist(),
        })


def load_copula(spark: SparkSession, folder: str) -> CopulaFit:
    """The fit that ``save`` wrote to ``folder``; it generates the same rows."""
    folder = folder.rstrip("/")
    held = read_manifest(spark, folder)
    return CopulaFit(
        held["columns"], held["size"], spark.read.parquet(f"{folder}/cells"), np.array(held["factor"]),
        T.StructType.fromJson(json.loads(held["schema"])), read_levels(spark, folder),
    )


def reject_missing(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise, naming the columns, if any value is NULL or NaN."""
    floats = {f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")}

    def missing(c):
        return F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()

    row = df.agg(*[F.bool_or(missing(c)).alias(c) for c in columns]).first()
    bad = [c for c in columns if row[c]]
    if bad:
        raise ValueError(f"Columns with missing values: {bad}")


def ranked_cells(df: DataFrame, columns: Sequence[str], key: Sequence[str], size: int | None = None) -> DataFrame:
    """Long form of the columns with the 0-based rank ``idx`` of each value, ties in key order; all columns in one sort.

    ``size`` is the number of rows, by which the sort is dealt out.
    """
    parts = cell_parts(df.sparkSession, size * len(columns)) if size is not None else None
    alias = {c: f"_key_{i}" for i, c in enumerate(key)}
    keyed = df.select(*[F.col(c).alias(a) for c, a in alias.items()], *columns)
    cells = melt_cells(keyed, columns, list(alias.values()))
    return dense_index(cells, [*_FIELDS, *alias.values()], within=["col"], name="idx", parts=parts)


def normal_scores(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The key (as ``_key_0`` …) and one normal-score column ``score_<i>`` per column."""
    size = df.count()
    return _scores(ranked_cells(df, columns, key, size), len(columns), len(key), size)


def _scores(cells: DataFrame, n_columns: int, n_keys: int, size: int) -> DataFrame:
    score = normal_score(F.col("idx"), size)
    return cells.groupBy(*[f"_key_{i}" for i in range(n_keys)]).agg(*[
        F.max(F.when(F.col("col") == i, score)).alias(f"score_{i}") for i in range(n_columns)
    ])


def correlation_matrix(scores: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson correlation of numeric columns; undefined entries are 0 and the diagonal is 1."""
    if len(columns) == 1:
        return np.ones((1, 1))
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(scores).select("v").persist()
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    vectors.unpersist()
    # a constant column has no correlation with any other
    return np.where(np.isfinite(matrix), matrix, np.eye(len(columns)))


def draw_factor(correlation: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """Rows that turn independent normals into correlated ones of unit variance; works on d x d numbers only.

    Each row of eigenvectors is stretched by the roots of the eigenvalues, none taken below ``floor``, and
    brought to length one, so any symmetric matrix gives a valid draw and no second factorisation is needed.
    """
    strength, directions = np.linalg.eigh((correlation + correlation.T) / 2)
    rows = directions * np.sqrt(np.clip(strength, floor, None))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit_copula(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> CopulaFit:
    """Ranks, sorted values, levels and the rank correlation of all columns; it draws nothing, so it needs no seed."""
    columns = list(columns or [c for c in df.columns if c not in key])
    require_rows(df)
    reject_missing(df, columns)
    size = df.count()
    cells = ranked_cells(df, columns, key, size)
    scores = _scores(cells, len(columns), len(key), size)
    raw = correlation_matrix(scores, [f"score_{i}" for i in range(len(columns))])
    source = df.select(*columns)
    tables = level_tables(source, few_valued(source))
    return CopulaFit(columns, size, cells.select("col", "idx", *_FIELDS), draw_factor(raw), source.schema, tables)


def correlated_normals(rows: DataFrame, factor: np.ndarray, seed: int, row: str = "row_id") -> DataFrame:
    """Add ``y_<i>``: standard normal columns mixed by the rows of ``factor``, as one product of arrays each."""
    d = len(factor)
    drawn = rows.withColumn("_z", F.array(*[standard_normal(seed, f"copula:{i}", F.col(row)) for i in range(d)]))

    def mixed(weights: np.ndarray):
        terms = F.zip_with("_z", F.array(*[F.lit(float(w)) for w in weights]), lambda z, w: z * w)
        return never_null(F.aggregate(terms, F.lit(0.0), lambda total, x: total + x), 0.0)

    return drawn.withColumns({f"y_{i}": mixed(factor[i]) for i in range(d)}).drop("_z")


def gaussian_copula(
    df: DataFrame, key: Sequence[str], n_rows: int | None = None, seed: int = 42,
    columns: Sequence[str] | None = None, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Synthetic rows with the marginals and the rank correlation of ``df``; adds ``row_id``."""
    return fit_copula(df, key, columns).generate(n_rows, seed, broadcast_rows)
