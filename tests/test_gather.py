"""Draws are made once, and large sorts and joins are dealt out by cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import sampling
from tabloom.operators.synthesis import copula, gaussian_copula


def _real(spark, n=400):
    x = F.col("id")
    return spark.range(n).select(
        "id", ((x * 37) % 1000).alias("a"), ((x * 11) % 701 / 7.0).alias("b"), F.concat(F.lit("g"), x % 3).alias("g"),
    )


def test_draws_of_a_join_are_made_once(spark):
    rows = gaussian_copula(_real(spark), ["id"], broadcast_rows=0)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
    broadcast = gaussian_copula(_real(spark), ["id"])
    assert sorted(rows.collect()) == sorted(broadcast.collect())


def test_other_columns_travel_with_a_draw(spark):
    source = spark.createDataFrame([(0, i, 10 * i, None, None) for i in range(3)], "col int, idx long, l long, d double, s string")
    draws = spark.createDataFrame([(1, 2, "x", None), (2, 0, None, 5)], "row_id long, _at_v long, name string, n int")
    out = sampling.gather(draws, source, {"v": (0, source.schema["l"].dataType)}, 3, broadcast_rows=0)
    assert sorted(out.select("row_id", "v", "name", "n").collect()) == [(1, 20, "x", None), (2, 0, None, 5)]


def test_large_sorts_are_dealt_out_by_cells(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CELLS_PER_TASK", 100)
    real = _real(spark)
    cells = copula.ranked_cells(real, ["a", "b", "g"], ["id"], 400)
    sizes = [n for n in cells.rdd.glom().map(len).collect() if n]
    assert len(sizes) >= 10 and max(sizes) < 300
    rows = gaussian_copula(real, ["id"], broadcast_rows=0).collect()
    monkeypatch.undo()
    assert sorted(rows) == sorted(gaussian_copula(real, ["id"], broadcast_rows=0).collect())
