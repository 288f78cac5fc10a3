"""Table sinks, row numbering, run artifacts and rule files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.profile import metadata_document
from tabloom.operators.ranking import dense_index


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Replace the table at ``path``; ``csv`` gets a header and no index."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def with_row_id(df: DataFrame, order_by: Sequence[str] = (), name: str = "row_id") -> DataFrame:
    """Add a dense row number in the order of ``order_by`` or, without it, of all columns."""
    return dense_index(df, list(order_by) or df.columns, name=name)


def write_artifact(df: DataFrame, path: str, dataset: str, method: str, seed: int) -> None:
    """Store one run in a table partitioned by dataset, method and seed; the same run is replaced."""
    tagged = df.withColumns({"dataset": F.lit(dataset), "method": F.lit(method), "seed": F.lit(seed)})
    (
        tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset", "method", "seed").parquet(path)
    )


def read_artifact(spark: SparkSession, path: str, dataset: str, method: str, seed: int) -> DataFrame:
    chosen = (F.col("dataset") == dataset) & (F.col("method") == method) & (F.col("seed") == seed)
    return spark.read.parquet(path).filter(chosen).drop("dataset", "method", "seed")


def write_metadata(metadata: DataFrame, path: str) -> None:
    """Metadata of a table as a JSON document in the folder ``path``, which is replaced."""
    metadata_document(metadata).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str, facts: str = "dtype string, sdtype string, n_distinct long") -> DataFrame:
    """Rows of a document of ``write_metadata``; ``facts`` names what is known of a column beside its name."""
    text = spark.read.text(path, wholetext=True)
    nested = text.select(F.from_json("value", f"columns map<string, struct<{_nested(facts)}>>").alias("d"))
    return nested.select(F.explode("d.columns").alias("column", "facts")).select("column", "facts.*")


def _nested(facts: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(facts))


#: Rule sets ``{target: labels}``; the strict one allows a single label for the positive target.
DEFAULT_RULES = {0: ("neutral", "negative"), 1: ("positive", "neutral")}
STRICT_RULES = {0: ("neutral", "negative"), 1: ("positive",)}

_RULE_FILE = "alignment_rules struct<target_to_text_sentiment: map<string, array<string>>>"


def rules_frame(spark: SparkSession, rules: Mapping[int, Sequence[str]] = DEFAULT_RULES) -> DataFrame:
    """Rules as ``(target, label)`` rows."""
    return spark.createDataFrame(
        [(t, label) for t in sorted(rules) for label in rules[t]], "target int, label string"
    )


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON file as ``(target, label)`` rows."""
    nested = spark.read.schema(_RULE_FILE).json(path, multiLine=True)
    mapping = nested.select(F.explode("alignment_rules.target_to_text_sentiment").alias("target", "labels"))
    return mapping.select(F.col("target").cast("int").alias("target"), F.explode("labels").alias("label"))


def write_rules(rules: DataFrame, path: str) -> None:
    """Export rules to the nested JSON form."""
    lists = rules.groupBy(F.col("target").cast("string").alias("target")).agg(F.array_sort(F.collect_list("label")).alias("labels"))
    entries = F.array_sort(F.collect_list(F.struct("target", "labels")))
    nested = lists.agg(F.map_from_entries(entries).alias("target_to_text_sentiment"))
    nested.select(F.struct("target_to_text_sentiment").alias("alignment_rules")).coalesce(1).write.mode("overwrite").json(path)


def labels_for(rules: DataFrame, target: int) -> list[str]:
    """Allowed labels of one target; an unknown target is an error."""
    found = [r["label"] for r in rules.filter(F.col("target") == target).orderBy("label").collect()]
    if not found:
        raise ValueError(f"No rule for target value {target}.")
    return found


def required_targets(rules: DataFrame) -> list[int]:
    return [r["target"] for r in rules.select("target").distinct().orderBy("target").collect()]


@dataclass(frozen=True)
class RuleBook:
    """All that a rule file says: the columns it is about, labels per target in their order, and what must hold."""

    rules: Mapping[int, Sequence[str]] = field(default_factory=lambda: dict(DEFAULT_RULES))
    target_column: str = "target"
    label_column: str = "sentiment"
    name: str = ""
    description: str = ""
    sources: Mapping[str, str] = field(default_factory=dict)
    constraints: Mapping[str, object] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        return rules_frame(spark, self.rules)

    def labels(self, target: int) -> list[str]:
        """Allowed labels of a target in the order of the file; an unknown target is an error."""
        if target not in self.rules:
            raise ValueError(f"No rule for target value {target}.")
        return list(self.rules[target])


def read_rule_book(spark: SparkSession, path: str) -> RuleBook:
    """A whole rule file, read through Spark so that any of its file systems serves."""
    file = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    schema = dict(file.get("schema", {}))
    rules = {int(t): tuple(labels) for t, labels in file["alignment_rules"]["target_to_text_sentiment"].items()}
    return RuleBook(
        rules, schema.pop("target_column", "target"), schema.pop("text_label_column", "sentiment"), file.get("name", ""),
        file.get("description", ""), schema, file.get("constraints", {}),
    )


def write_rule_book(spark: SparkSession, book: RuleBook, path: str) -> None:
    """Write the whole rule file; ``read_rule_book`` and ``read_rules`` read it."""
    file = {
        "name": book.name, "description": book.description,
        "schema": {**book.sources, "target_column": book.target_column, "text_label_column": book.label_column},
        "alignment_rules": {"target_to_text_sentiment": {str(t): list(v) for t, v in book.rules.items()}},
        "constraints": dict(book.constraints),
    }
    text = json.dumps(file, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
