"""Inputs that ordinary tables do not hold: mixed types, booleans, odd text, lone classes, numbers out of range."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabloom.operators.alignment import weak_alignment
from tabloom.operators.cleaning import target_from_domain
from tabloom.operators.fidelity import fidelity_report
from tabloom.operators.synthesis import independent, repair_domains, sequential
from tabloom.operators.synthesis.sequential import TreeSettings
from tabloom.operators.profile import column_metadata
from tabloom.sources.tables import RuleBook, read_rule_book, read_rules, rules_frame, write_rule_book

FOREST = TreeSettings("rf", trees=4, depth=4)


@pytest.mark.parametrize("level_limit", [0, 3, 10_000])
def test_any_level_limit_draws_the_same_rows(spark, level_limit):
    df = spark.range(300).select(
        "id", (F.col("id") % 5).alias("few"), (F.col("id") * 37 % 211).cast("double").alias("many"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("t"), F.col("id") % 7)).alias("text"),
    )
    expected = sorted(map(str, independent(df, ["id"], 100, seed=3).collect()))
    assert sorted(map(str, independent(df, ["id"], 100, seed=3, level_limit=level_limit).collect())) == expected


def test_fractions_of_a_synthetic_column_count(spark):
    real = spark.range(100).select(F.col("id").alias("n"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"))
    synth = spark.range(100).select((F.col("id") + 0.9).alias("n"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"))
    row = fidelity_report(real, synth).where("type = 'numeric'").first()
    assert row["synth_mean"] == pytest.approx(50.4) and row["abs_mean_diff"] == pytest.approx(0.9)


def test_text_in_an_integer_category_stays_a_level_of_its_own(spark):
    real = spark.range(40).select((F.col("id") % 2).cast("int").alias("k"))
    synth = spark.range(40).select(F.when(F.col("id") % 4 == 0, "odd one").otherwise((F.col("id") % 2).cast("string")).alias("k"))
    row = fidelity_report(real, synth).where("column = 'k'").first()
    assert row["num_levels"] == 3 and row["total_variation_distance"] == pytest.approx(0.25)


def test_booleans_and_the_word_nan_are_generated_as_they_are(spark):
    df = spark.range(400).select(
        "id", (F.col("id") * 13 % 97).cast("double").alias("x"), (F.col("id") % 10 == 0).alias("flag"),
        F.when(F.col("id") % 3 == 0, "nan").when(F.col("id") % 3 == 1, "word").alias("text"),
    )
    rows = sequential(df, ["id"], 400, settings=FOREST).collect()
    assert 10 <= sum(r["flag"] for r in rows) <= 90
    counts = {v: sum(r["text"] == v for r in rows) for v in ("nan", "word", None)}
    assert all(70 <= n <= 200 for n in counts.values())


def test_levels_outside_the_bounded_training_rows_are_generated(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("l"), F.col("id") % 60).alias("level"))
    first = sequential(df.select("id", "level", "x"), ["id"], 600, settings=FOREST, max_training_rows=20)
    assert first.select("level").distinct().count() > 40


@pytest.mark.parametrize("values", [[1], [0], [2], [1, 1, 3]])
def test_a_lone_class_is_no_binary_target(spark, values):
    with pytest.raises(ValueError, match="both values"):
        target_from_domain(spark.createDataFrame([(v,) for v in values], "t int"), "t")


def test_repair_survives_numbers_out_of_range(spark):
    real = spark.range(100).select(F.col("id").cast("int").alias("i"), F.col("id").alias("l"))
    synth = spark.createDataFrame([(1e30, 1e30), (-1e30, -1e30), (3.5, float("nan"))], "i double, l double")
    rows = [tuple(r) for r in repair_domains(real, synth).select("i", "l").collect()]
    assert rows[0][0] == 2**31 - 1 and rows[1][0] == -(2**31) and rows[2][0] == 4
    assert rows[0][1] > 9.2e18 and rows[1][1] == -(2**63) and 0 <= rows[2][1] <= 99


def test_alignment_checks_its_inputs(spark):
    text = spark.createDataFrame([(1, "positive"), (2, "neutral"), (3, "negative")], "doc_id long, sentiment string")
    ones = spark.range(5).select("id", F.lit(1).alias("target"))
    with pytest.raises(ValueError, match="without rows.*0"):
        weak_alignment(ones, text, rules_frame(spark), "id", "doc_id")
    with pytest.raises(ValueError, match="sentiment"):
        weak_alignment(ones, text.drop("sentiment"), rules_frame(spark), "id", "doc_id")


def test_rule_files_keep_all_they_say(spark, tmp_path):
    book = RuleBook({1: ("positive", "neutral"), 0: ("negative",)}, "outcome", "mood", "n", "d", {"text_source": "t"}, {"strict": True})
    path = str(tmp_path / "rules")
    write_rule_book(spark, book, path)
    assert read_rule_book(spark, path) == book
    assert book.labels(1) == ["positive", "neutral"]
    assert sorted(map(tuple, read_rules(spark, path).collect())) == [(0, "negative"), (1, "neutral"), (1, "positive")]
    with pytest.raises(ValueError, match="No rule"):
        book.labels(7)


def test_column_metadata_knows_all_kinds(spark):
    df = spark.range(50).selectExpr(
        "id", "id % 4 AS few", "id * 1.5 AS x", "id % 2 = 0 AS b", "date_add(date'2020-01-01', CAST(id AS INT)) AS d",
        "IF(id % 2 = 0, 'a', NULL) AS t", "CAST(NULL AS INT) AS nothing",
    )
    rows = {r["column"]: (r["sdtype"], r["n_distinct"]) for r in column_metadata(df, ids=["id"]).collect()}
    assert rows == {
        "id": ("id", 50), "few": ("categorical", 4), "x": ("numerical", 50), "b": ("boolean", 2), "d": ("datetime", 50),
        "t": ("categorical", 1), "nothing": ("categorical", 0),
    }
