"""Preparation of all tables in order: tabular, text, text features, one aligned table per rule set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tabloom.operators.alignment import weak_alignment
from tabloom.operators.cleaning import TabularSpec, TextSpec, clean_tabular, clean_text
from tabloom.operators.textfeatures import text_features
from tabloom.sources.delimited import read_delimited
from tabloom.sources.tables import DEFAULT_RULES, STRICT_RULES, rules_frame, write_table


@dataclass(frozen=True)
class TabularDataset:
    """A delimited tabular source and how it is cleaned."""

    path: str
    spec: TabularSpec
    sep: str = ","


@dataclass(frozen=True)
class TextDataset:
    """A delimited labelled text source and how it is cleaned."""

    path: str
    spec: TextSpec
    names: Sequence[str] | None = None
    encodings: Sequence[str] = ("utf-8-sig", "utf-8", "cp1252", "latin1", "iso-8859-1")


#: The label ids and the two lexicons of the finance text features.
FINANCE_TEXT = TextSpec(
    text_col="text",
    label_col="sentiment",
    valid_labels=("positive", "neutral", "negative"),
    dedupe_cols=("text", "sentiment"),
    label_to_id={"negative": 0, "neutral": 1, "positive": 2},
    positive_hints=("gain", "growth", "profit", "improve", "increase", "rose", "higher", "strong", "up"),
    negative_hints=("decline", "loss", "fell", "lower", "drop", "decrease", "down", "weak", "layoff"),
)
#: Targets and missing-value tokens of the three tabular sources.
BANK_SPEC = TabularSpec("y", {"no": 0, "yes": 1}, drop_source_target=False)
ADULT_SPEC = TabularSpec("salary", {"<=50K": 0, ">50K": 1}, drop_source_target=True, missing_tokens=("?", ""))
GERMAN_SPEC = TabularSpec("credit_risk", None, drop_source_target=True)


def prepare_tabular(spark: SparkSession, dataset: TabularDataset, out: str) -> DataFrame:
    """Read, clean and store one tabular source; ``row_id`` is the row number in the files."""
    raw = read_delimited(spark, dataset.path, sep=dataset.sep, row_id="row_id")
    write_table(clean_tabular(raw, dataset.spec), out)
    return spark.read.parquet(out)


def prepare_text(spark: SparkSession, dataset: TextDataset, out: str) -> DataFrame:
    raw = read_delimited(
        spark, dataset.path, header=dataset.names is None, names=dataset.names, encodings=dataset.encodings,
        schema=", ".join(f"{n} string" for n in dataset.names) if dataset.names else None, row_id="row_id",
    )
    write_table(clean_text(raw, dataset.spec, "row_id"), out)
    return spark.read.parquet(out)


def prepare_all(
    spark: SparkSession, tabular: Mapping[str, TabularDataset], text: TextDataset, aligned: str, folder: str,
    rule_sets: Mapping[str, Mapping[int, Sequence[str]]] | None = None, seed: int = 42, **feature_options,
) -> dict[str, DataFrame]:
    """Prepare every table below ``folder``; ``aligned`` names the tabular dataset that meets the text."""
    rule_sets = rule_sets or {"weak_multimodal": DEFAULT_RULES, "weak_multimodal_strict": STRICT_RULES}
    out = {name: prepare_tabular(spark, dataset, f"{folder}/{name}") for name, dataset in tabular.items()}
    out["text_clean"] = prepare_text(spark, text, f"{folder}/text_clean")
    write_table(text_features(out["text_clean"], text.spec, "row_id", **feature_options), f"{folder}/text_features")
    out["text_features"] = spark.read.parquet(f"{folder}/text_features")
    for name, rules in rule_sets.items():
        joined = weak_alignment(
            out[aligned], out["text_features"], rules_frame(spark, rules), "row_id", "row_id", seed,
            label_col=text.spec.label_col,
        )
        write_table(joined, f"{folder}/{name}")
        out[name] = spark.read.parquet(f"{folder}/{name}")
    return out
