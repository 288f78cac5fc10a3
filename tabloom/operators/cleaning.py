"""Tabular and text cleaning, target derivation, and the checks that stop bad input early."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import text as tx
from tabloom.session import spread


@dataclass(frozen=True)
class TabularSpec:
    """How one table is cleaned."""

    target_col: str
    target_map: Mapping[str, int] | None = None
    drop_source_target: bool = False
    missing_tokens: Sequence[str] = ()


@dataclass(frozen=True)
class TextSpec:
    """How one labelled text table is cleaned and turned into features."""

    text_col: str = "text"
    label_col: str = "sentiment"
    valid_labels: Sequence[str] = ()
    dedupe_cols: Sequence[str] = ()
    label_to_id: Mapping[str, int] = field(default_factory=dict)
    positive_hints: Sequence[str] = ()
    negative_hints: Sequence[str] = ()


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def require_rows(df: DataFrame, what: str = "Input") -> None:
    if df.isEmpty():
        raise ValueError(f"{what} is empty.")


def require_same_columns(left: DataFrame, right: DataFrame) -> None:
    if left.columns != right.columns:
        raise ValueError(f"Both sides need identical columns; real: {left.columns}, synthetic: {right.columns}")


def reject_values(df: DataFrame, column: str, bad: Column, message: str, shown: int = 20) -> None:
    """Raise if any row is bad, with the number of distinct offending values and the first ``shown`` in order."""
    values = [r[0] for r in df.filter(bad).select(column).distinct().orderBy(column).limit(shown + 1).collect()]
    if values:
        total = len(values) if len(values) <= shown else df.filter(bad).select(column).distinct().count()
        raise ValueError(f"{message} ({total} distinct): {values[:shown]}{' ...' if total > shown else ''}")


def standardize_columns(df: DataFrame) -> DataFrame:
    """Lower-case, stripped column names with underscores for spaces and dashes."""
    names = [c.strip().lower().replace(" ", "_").replace("-", "_") for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"Column names collide after standardisation: {clash}")
    return df.toDF(*names)


def clean_strings(df: DataFrame, missing_tokens: Sequence[str] = ()) -> DataFrame:
    """Strip every string column and turn missing-value tokens into ``unknown``; NULL stays NULL."""
    strings = {
        f.name: tx.replace_tokens(tx.strip_text(F.col(f.name)), missing_tokens)
        for f in df.schema
        if isinstance(f.dataType, T.StringType)
    }
    return df.withColumns(strings) if strings else df


def _lookup(value: Column, mapping: Mapping[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(table, value.cast("string"))


def target_from_map(df: DataFrame, column: str, mapping: Mapping[str, int], name: str = "target") -> DataFrame:
    """Binary target by value mapping; any other value, NULL included, is an error."""
    mapped = _lookup(F.col(column), mapping)
    reject_values(df, column, mapped.isNull(), f"Unexpected target values in '{column}'")
    return df.withColumn(name, mapped.cast("int"))


def target_from_domain(df: DataFrame, column: str, name: str = "target") -> DataFrame:
    """Binary target from a column holding exactly {0, 1} (kept) or {1, 2} (2 is positive), both values present."""
    number = F.col(column).try_cast("double")
    seen = df.agg(
        F.bool_and(F.coalesce(number.isin(0.0, 1.0), F.lit(False))).alias("zero_one"),
        F.bool_and(F.coalesce(number.isin(1.0, 2.0), F.lit(False))).alias("one_two"),
        *[F.bool_or(number == v).alias(f"has_{i}") for i, v in enumerate((0.0, 1.0, 2.0))],
    ).first()
    if seen["zero_one"] and seen["has_0"] and seen["has_1"]:
        return df.withColumn(name, number.cast("int"))
    if seen["one_two"] and seen["has_1"] and seen["has_2"]:
        return df.withColumn(name, (number == 2.0).cast("int"))
    raise ValueError(f"'{column}' does not hold both values of {{0, 1}} or of {{1, 2}}; map its values with target_map.")


def clean_tabular(df: DataFrame, spec: TabularSpec) -> DataFrame:
    """Standard names, clean strings, binary ``target``."""
    out = clean_strings(standardize_columns(df), spec.missing_tokens)
    require_columns(out, [spec.target_col])
    if spec.target_map:
        out = target_from_map(out, spec.target_col, spec.target_map)
    else:
        out = target_from_domain(out, spec.target_col)
    return out.drop(spec.target_col) if spec.drop_source_target else out


def normalize_text_rows(df: DataFrame, spec: TextSpec) -> DataFrame:
    """Collapsed text, normalised label; rows without a valid label or any text are dropped. Works on streams."""
    require_columns(df, [spec.text_col, spec.label_col])
    out = df.withColumns({
        spec.text_col: tx.collapse_whitespace(F.col(spec.text_col)),
        spec.label_col: tx.normalize_label(F.col(spec.label_col)),
    })
    if spec.valid_labels:
        out = out.filter(F.col(spec.label_col).isin(list(spec.valid_labels)))
    return out.filter(F.char_length(spec.text_col) > 0)


def first_per_group(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Keep, of rows equal in ``columns``, the one with the smallest unique ``key``.

    The first pass combines (digest, key) pairs before its shuffle, so copies of one text cost one row per
    task; the second keeps the survivors by a semi-join on the key.
    """
    types = {f.name: f.dataType for f in df.schema}
    digests = [
        (F.sha2(F.col(c).cast("binary"), 256) if isinstance(types[c], T.StringType) else F.col(c)).alias(f"_g{i}")
        for i, c in enumerate(columns)
    ]
    survivors = (
        df.select(*digests, F.col(key))
        .groupBy(*[f"_g{i}" for i in range(len(columns))])
        .agg(F.min(key).alias(key))
        .select(key)
    )
    return df.join(survivors, key, "left_semi")


def text_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Length, words, digit share and capital share of a text column. Works on streams."""
    t = F.col(text_col)
    return spread(df).withColumns({
        "text_length": tx.text_length(t),
        "word_count": tx.word_count(t),
        "digit_ratio": tx.digit_ratio(t),
        "uppercase_ratio": tx.uppercase_ratio(t),
    })


def clean_text(df: DataFrame, spec: TextSpec, key: str) -> DataFrame:
    """Normalise, filter, keep first occurrences, add statistics."""
    out = normalize_text_rows(standardize_columns(spread(df)), spec)
    if spec.dedupe_cols:
        out = first_per_group(out, spec.dedupe_cols, key)
    return text_statistics(out, spec.text_col)


def label_ids(df: DataFrame, column: str, mapping: Mapping[str, int], name: str | None = None) -> DataFrame:
    """Label to id by mapping; a label outside the mapping is an error, a NULL label stays NULL."""
    mapped = _lookup(F.col(column), mapping)
    reject_values(df, column, mapped.isNull() & F.col(column).isNotNull(), f"Labels without an id in '{column}'")
    return df.withColumn(name or f"{column}_id", mapped.cast("int"))


def label_order_ids(df: DataFrame, column: str, key: str, name: str | None = None) -> DataFrame:
    """Label to id by first appearance in ``key`` order; a NULL label gets -1."""
    from tabloom.operators.ranking import dense_index
    from tabloom.session import broadcast_if_small

    name = name or f"{column}_id"
    first = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(key).alias("_first"))
    ids = dense_index(first, ["_first"], name=name).select(column, F.col(name).cast("int").alias(name))
    return df.join(broadcast_if_small(ids), column, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def drop_leakage(
    df: DataFrame, target_col: str = "target", leakage: Sequence[str] = ("y", "salary", "credit_risk")
) -> DataFrame:
    """Drop the target and, for a column named ``target``, the columns it was derived from."""
    require_columns(df, [target_col])
    extra = leakage if target_col == "target" else ()
    return df.drop(target_col, *[c for c in extra if c in df.columns])


def target_classes(df: DataFrame, target_col: str = "target", both: bool = True) -> list[int]:
    """The classes present, checked to be within {0, 1}; with ``both`` each must occur."""
    y = F.col(target_col).try_cast("double")
    row = df.agg(
        F.bool_and(F.coalesce(y.isin(0.0, 1.0), F.lit(False))).alias("valid"),
        F.bool_or(y == 0.0).alias("zero"),
        F.bool_or(y == 1.0).alias("one"),
    ).first()
    if row["valid"] is False:
        raise ValueError(f"'{target_col}' must lie within 0 and 1.")
    classes = [c for c, seen in ((0, row["zero"]), (1, row["one"])) if seen]
    if both and classes != [0, 1]:
        raise ValueError(f"'{target_col}' must hold both classes; present: {classes}")
    return classes
