from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.hashing import standard_normal, uniform
from tabloom.functions.numeric import normal_cdf, normal_score, weighted_class
from tabloom.operators.profile import exact_median, level_counts, most_frequent, semantic_types
from tabloom.operators.ranking import dense_index, running_total
from tabloom.operators.sampling import _smallest, bootstrap_column, cap_rows, gather, melt_cells, split_sizes, stratified_split


def hot_rows(spark, n=3000):
    """One value holds more than a third of all rows."""
    return spark.range(n).select("id", F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 97).cast("int").alias("v"))


@pytest.mark.parametrize("partitions", [1, 7])
def test_dense_index_matches_sorting(spark, partitions):
    rows = dense_index(hot_rows(spark).repartition(partitions), ["v", "id"]).collect()
    expected = sorted((r["v"], r["id"]) for r in rows)
    assert [(r["v"], r["id"]) for r in sorted(rows, key=lambda r: r["_idx"])] == expected
    assert sorted(r["_idx"] for r in rows) == list(range(len(rows)))


def test_dense_index_restarts_within_groups(spark):
    rows = dense_index(hot_rows(spark), ["id"], within=["v"], name="p").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["v"], []).append((r["id"], r["p"]))
    for members in groups.values():
        assert [p for _, p in sorted(members)] == list(range(len(members)))


def test_hot_value_is_split_over_partitions(spark):
    ranged = hot_rows(spark).repartitionByRange(4, "v", "id").withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in ranged.groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1100


def test_running_total(spark):
    rows = running_total(spark.range(500).withColumn("w", F.col("id") % 4), ["id"], "w").collect()
    total = 0
    for r in sorted(rows, key=lambda r: r["id"]):
        assert r["_before"] == total
        total += r["w"]


def test_exact_choice_of_rows(spark):
    df = spark.range(20000)
    u = uniform(1, "x", F.col("id"))
    expected = {r["id"] for r in df.withColumn("u", u).orderBy("u", "id").limit(777).collect()}
    assert {r["id"] for r in df.filter(_smallest(df, u, ["id"], 20000, 777)).collect()} == expected
    for k in (0, 1, 19999, 20000):
        assert df.filter(_smallest(df, u, ["id"], 20000, k)).count() == k


def test_exact_choice_falls_back_on_tied_hashes(spark):
    df = spark.range(1000)
    assert df.filter(_smallest(df, F.lit(0.9), ["id"], 1000, 10)).count() == 10


def test_cap_rows(spark):
    assert cap_rows(spark.range(50), ["id"], 100).count() == 50
    capped = cap_rows(spark.range(5000), ["id"], 100)
    again = cap_rows(spark.range(5000).repartition(9), ["id"], 100)
    assert capped.count() == 100
    assert sorted(capped.collect()) == sorted(again.collect())


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 5000), st.floats(0.05, 0.95))
def test_split_sizes_add_up(zeros, ones, share):
    sizes = split_sizes({0: zeros, 1: ones}, share)
    assert sum(sizes.values()) == math.ceil((zeros + ones) * share)
    assert all(abs(sizes[c] - n * sum(sizes.values()) / (zeros + ones)) < 1 for c, n in ((0, zeros), (1, ones)))


def test_stratified_split(spark):
    df = spark.range(1001).withColumn("target", (F.col("id") % 10 == 0).cast("int"))
    marked = stratified_split(df, ["id"])
    taken = {r["target"]: r["n"] for r in marked.filter("is_test").groupBy("target").agg(F.count("*").alias("n")).collect()}
    assert taken == split_sizes({0: 900, 1: 101}, 0.25)


def test_gather_by_join_equals_gather_by_broadcast(spark):
    types = {"a": (0, T.IntegerType()), "b": (1, T.StringType()), "c": (2, T.TimestampType())}
    source = melt_cells(
        spark.range(40).select(
            F.col("id").alias("idx"), F.col("id").cast("int").alias("a"), F.col("id").cast("string").alias("b"),
            F.timestamp_seconds("id").alias("c"),
        ), ["a", "b", "c"], ["idx"],
    )
    draws = spark.range(300).select(
        F.col("id").alias("row_id"), (F.col("id") * 2).alias("other"),
        *[(F.abs(F.hash("id", F.lit(c))) % 40).cast("bigint").alias(f"_at_{c}") for c in types],
    )
    small = gather(draws, source, types, 40)
    large = gather(draws, source, types, 40, broadcast_rows=0)
    assert sorted(small.collect()) == sorted(large.select(*small.columns).collect())
    assert small.count() == 300


def test_bootstrap_keeps_nulls_and_values(spark):
    df = spark.createDataFrame([(0, None), (1, "x"), (2, "y")], "id int, v string")
    drawn = bootstrap_column(df, "v", ["id"], 300, seed=3)
    counts = {r["v"]: r["count"] for r in drawn.groupBy("v").count().collect()}
    assert set(counts) == {None, "x", "y"} and all(60 < n < 140 for n in counts.values())


def test_normal_functions(spark):
    points = [-38.0, -9.0, -7.2, -3.0, -1.0, -0.1, 0.0, 0.3, 1.5, 6.9, 7.3, 9.0]
    df = spark.createDataFrame([(p,) for p in points], "z double").select("z", normal_cdf(F.col("z")).alias("p"))
    for z, p in df.collect():
        assert p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-13)
    drawn = np.array([r[0] for r in spark.range(20000).select(standard_normal(5, "n", F.col("id"))).collect()])
    assert abs(drawn.mean()) < 0.03 and abs(drawn.std() - 1) < 0.03
    scores = [r[0] for r in spark.range(101).select(normal_score(F.col("id"), 101)).collect()]
    assert scores == sorted(scores) and scores[50] == pytest.approx(0.0, abs=1e-9)
    assert scores[0] == pytest.approx(-scores[-1])


def test_class_draw_frequencies(spark):
    p = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))
    drawn = spark.range(20000).select(weighted_class(p, uniform(9, "c", F.col("id")), 3).alias("k"))
    shares = [r["count"] / 20000 for r in drawn.groupBy("k").count().orderBy("k").collect()]
    assert shares == pytest.approx([0.2, 0.5, 0.3], abs=0.015)


def test_median_and_mode(spark):
    values = [5.0, 1.0, None, 3.0, 3.0, float("nan"), 10.0, 3.0]
    df = spark.createDataFrame([(v, w) for v, w in zip(values, [1, 2, 3, 4, None, None, None, None])], "a double, b int")
    medians = {r["column"]: r["median"] for r in exact_median(df, ["a", "b"]).collect()}
    assert medians == {"a": 3.0, "b": 2.5}
    text = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,), (None,), (None,)], "c string")
    assert most_frequent(text, ["c"]).first()["most_frequent"] == "a"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60))
def test_median_matches_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "a int")
    assert exact_median(df, ["a"]).first()["median"] == np.median(values)


def test_semantic_types(spark):
    df = spark.range(100).select(
        (F.col("id") % 20).alias("few"), (F.col("id") % 21).alias("many"), (F.col("id") % 2).cast("double").alias("real"),
        (F.col("id") % 2 == 0).alias("flag"), F.col("id").cast("string").alias("text"),
    )
    assert semantic_types(df) == {
        "few": "categorical", "many": "numeric", "real": "numeric", "flag": "numeric", "text": "categorical",
    }
    assert level_counts(df, ["few", "many"]) == {"few": 20}
