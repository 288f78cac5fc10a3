"""Metadata from sketches and as JSON documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators.profile import column_metadata, column_sketches, merged_sketches, metadata_document, sketched_metadata
from tabloom.sources.tables import read_metadata, write_metadata


def some_rows(spark):
    return spark.range(4_000).select(
        "id", (F.col("id") % 20).alias("few"), (F.col("id") % 21).alias("many"), (F.col("id") % 1_500).cast("int").alias("wide"),
        (F.col("id") % 3 == 0).alias("flag"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("ä\""), F.col("id") % 900)).alias("odd `name\""),
        F.lit(None).cast("int").alias("none"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 70).cast("int")).alias("day"),
    )


def test_metadata_comes_back_from_its_document(spark, tmp_path):
    known = column_metadata(some_rows(spark).withColumnRenamed("odd `name\"", "odd \"name"), ids=["id"])
    write_metadata(known, str(tmp_path / "m"))
    write_metadata(known, str(tmp_path / "m"))
    back = read_metadata(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, known.collect()))
    one = metadata_document(known.where("column = 'few'")).first()["document"]
    assert one == '{"columns":{"few":{"dtype":"bigint","sdtype":"categorical","n_distinct":20}}}'


def test_sketches_of_parts_merge_to_those_of_the_whole(spark):
    df = some_rows(spark)
    parts = [column_sketches(df.where(F.col("id") % 3 == k)) for k in range(3)] + [column_sketches(df.where("false"))]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    whole = {r["column"]: r for r in sketched_metadata(df, ids=["id"]).collect()}
    merged = {r["column"]: r for r in sketched_metadata(df, merged_sketches(union), ids=["id"]).collect()}
    assert set(merged) == set(whole) == set(df.columns)
    for c, row in whole.items():
        # an estimate depends a little on the order in which a sketch was filled
        assert abs(merged[c]["n_distinct"] - row["n_distinct"]) <= (0 if row["exact"] else 0.06 * row["n_distinct"])
        assert [v for k, v in merged[c].asDict().items() if k != "n_distinct"] == [v for k, v in row.asDict().items() if k != "n_distinct"]


def test_sketched_kinds_are_those_of_the_exact_counts(spark):
    df = some_rows(spark)
    got = {r["column"]: r for r in sketched_metadata(df, ids=["id"]).collect()}
    plain = df.withColumnRenamed("odd `name\"", "odd")
    for r in column_metadata(plain, ids=["id"]).collect():
        own = got["odd `name\"" if r["column"] == "odd" else r["column"]]
        assert own["sdtype"] == r["sdtype"] and own["dtype"] == r["dtype"] and own["n_rows"] == 4_000
        assert abs(own["n_distinct"] - r["n_distinct"]) <= 0.06 * r["n_distinct"]
        assert not own["exact"] or own["n_distinct"] == r["n_distinct"]
    assert got["few"]["exact"] and got["many"]["exact"] and not got["wide"]["exact"]
    assert got["none"]["n_missing"] == 4_000 and got["none"]["n_distinct"] == 0 and got["odd `name\""]["n_missing"] == 1_000
    empty = sketched_metadata(df.where("false"), ids=["id"]).collect()
    assert len(empty) == len(df.columns) and all(r["n_rows"] == r["n_distinct"] == 0 for r in empty)
