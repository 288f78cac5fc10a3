from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabloom.functions import text as tx
from tabloom.operators import cleaning as cl
from tabloom.operators.textfeatures import document_terms
from tabloom.plans.prepare import FINANCE_TEXT, TabularDataset, TextDataset, prepare_all
from tabloom.sources.delimited import choose_encoding, infer_types, read_delimited
from tabloom.sources.tables import (
    read_artifact, read_rules, rules_frame, with_row_id, write_artifact, write_rules, write_table,
)
from tabloom.streaming.cleaning import clean_tabular_stream, clean_text_stream, write_stream


def test_read_semicolons_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "bank.csv"
    path.write_text('age;job;score;gap;y\n30;"a;b";1.5;1;no\n41;NA;;nan;yes\n52;x;2e3;3;no\n')
    df = read_delimited(spark, str(path), sep=";", row_id="n")
    assert dict(df.dtypes) == {"age": "bigint", "job": "string", "score": "double", "gap": "double", "y": "string", "n": "bigint"}
    rows = [tuple(r) for r in df.orderBy("n").collect()]
    assert rows == [(30, "a;b", 1.5, 1.0, "no", 0), (41, None, None, None, "yes", 1), (52, "x", 2000.0, 3.0, "no", 2)]


def test_headerless_names_and_quoted_newlines(spark, tmp_path):
    path = tmp_path / "phrases.csv"
    path.write_text('positive,"said ""up""\nand rose"\nnegative,plain\n')
    df = read_delimited(spark, str(path), names=["sentiment", "text"])
    assert sorted(map(tuple, df.collect())) == [("negative", "plain"), ("positive", 'said "up"\nand rose')]


def test_encoding_is_chosen_per_file(spark, tmp_path):
    encodings = ["utf-8-sig", "utf-8", "cp1252", "latin1", "iso-8859-1"]
    (tmp_path / "a.csv").write_bytes("﻿neutral,é1\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes(b"neutral,\x93\xe9\x94\n")
    (tmp_path / "c.csv").write_bytes(b"neutral,\x81\xe9\n")
    df = read_delimited(spark, str(tmp_path), names=["sentiment", "text"], encodings=encodings)
    assert sorted(map(tuple, df.collect())) == sorted([("neutral", "é1"), ("neutral", "“é”"), ("neutral", "\x81é")])
    with pytest.raises(ValueError, match="None of the encodings"):
        choose_encoding(False, False, ["utf-8"])
    with pytest.raises(ValueError, match="Unsupported"):
        choose_encoding(False, False, ["utf-16"])


def test_bom_before_header(spark, tmp_path):
    (tmp_path / "h.csv").write_bytes("﻿a,b\n1,True\n2,False\n".encode("utf-8"))
    assert dict(read_delimited(spark, str(tmp_path)).dtypes) == {"a": "bigint", "b": "boolean"}


def test_infer_types_keeps_big_and_odd_text(spark):
    df = spark.createDataFrame([("99999999999999999999", "1d", "-3"), ("1", "2f", " 4 ")], "a string, b string, c string")
    assert dict(infer_types(df).dtypes) == {"a": "double", "b": "string", "c": "bigint"}


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2)], ["  My-Col", "Other Col "])
    assert cl.standardize_columns(df).columns == ["my_col", "other_col"]
    with pytest.raises(ValueError, match="collide"):
        cl.standardize_columns(spark.createDataFrame([(1, 2)], ["a b", "a-b"]))


def test_text_statistics_on_unicode(spark):
    df = spark.createDataFrame([("Ab ٣4",), ("",), (None,)], "text string")
    rows = cl.text_statistics(df).collect()
    assert tuple(rows[0])[1:] == (5, 2, 0.4, 0.2)
    assert tuple(rows[1])[1:] == (0, 0, 0.0, 0.0)
    messy = spark.createDataFrame([(" a  b\n\tc\x1d ",)], "t string")
    assert messy.select(tx.collapse_whitespace(F.col("t"))).first()[0] == "a b c"
    assert messy.select(tx.strip_text(F.col("t"))).first()[0] == "a  b\n\tc"


def test_hint_words(spark):
    df = spark.createDataFrame([('(Profit), "profit" profits; UP! up-beat',), (None,)], "t string")
    got = [r[0] for r in df.select(tx.hint_count(F.col("t"), ["profit", "up"])).collect()]
    assert got == [3, 0]


def test_index_terms(spark):
    df = spark.createDataFrame([("The É1t a b_c ünd",), ("x",), (None,)], "t string").coalesce(1)
    assert sorted((r["terms"] for r in document_terms(df, "t", ["the"], bigrams=False).collect()), reverse=True) == [["é1t", "b_c", "ünd"], [], []]
    pairs = document_terms(df, "t", ["the"]).collect()
    assert sorted((r["terms"] for r in pairs), reverse=True) == [["é1t", "b_c", "ünd", "é1t b_c", "b_c ünd"], [], []]


def test_targets(spark):
    df = spark.createDataFrame([("yes",), ("no",), ("maybe",), (None,)], "y string")
    with pytest.raises(ValueError, match="Unexpected target values.*maybe"):
        cl.target_from_map(df, "y", {"no": 0, "yes": 1})
    one_two = spark.createDataFrame([(1,), (2,)], "y int")
    assert [r["target"] for r in cl.target_from_domain(one_two, "y").orderBy("y").collect()] == [0, 1]
    zero_one = spark.createDataFrame([(0.0,), (1.0,)], "y double")
    assert [r["target"] for r in cl.target_from_domain(zero_one, "y").orderBy("y").collect()] == [0, 1]
    for bad in ([(1,), (3,)], [(1,), (None,)]):
        with pytest.raises(ValueError):
            cl.target_from_domain(spark.createDataFrame(bad, "y int"), "y")


def test_checks(spark):
    df = spark.createDataFrame([(1, 0)], "a int, target int")
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        cl.require_columns(df, ["c", "a", "b"])
    with pytest.raises(ValueError, match="empty"):
        cl.require_rows(df.limit(0))
    with pytest.raises(ValueError, match="identical columns"):
        cl.require_same_columns(df, df.select("target", "a"))
    with pytest.raises(ValueError, match="both"):
        cl.target_classes(df)
    assert cl.target_classes(df, both=False) == [0]
    with pytest.raises(ValueError, match="within"):
        cl.target_classes(spark.createDataFrame([(2,)], "target int"))
    with pytest.raises(ValueError, match="without an id"):
        cl.label_ids(spark.createDataFrame([("x",)], "s string"), "s", {"y": 1})


def test_first_occurrence_with_a_hot_text(spark):
    df = spark.range(900).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 == 1, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 100)).alias("text"),
        F.lit("pos").alias("label"),
    )
    kept = {r["text"]: r["k"] for r in cl.first_per_group(df, ["text", "label"], "k").collect()}
    first = {}
    for r in sorted(df.collect(), key=lambda r: r["k"]):
        first.setdefault(r["text"], r["k"])
    assert kept == first


def test_clean_text_drops_null_text_and_unknown_labels(spark):
    df = spark.createDataFrame(
        [(0, None, "positive"), (1, "  ", "positive"), (2, "a  b", " Positive"), (3, "a b", "POSITIVE"), (4, "c", "odd"), (5, "d", None)],
        "k int, text string, sentiment string",
    )
    out = cl.clean_text(df, FINANCE_TEXT, "k").collect()
    assert [(r["k"], r["text"], r["sentiment"], r["word_count"]) for r in out] == [(2, "a b", "positive", 2)]


def test_rules_round_trip(spark, tmp_path):
    path = str(tmp_path / "rules")
    write_rules(rules_frame(spark), path)
    assert sorted(map(tuple, read_rules(spark, path).collect())) == sorted(map(tuple, rules_frame(spark).collect()))


def test_artifacts_and_tables(spark, tmp_path):
    df = spark.range(3)
    write_artifact(df, str(tmp_path / "runs"), "d", "m", 1)
    write_artifact(df.filter("id > 0"), str(tmp_path / "runs"), "d", "m", 2)
    write_artifact(df.filter("id > 1"), str(tmp_path / "runs"), "d", "m", 2)
    assert read_artifact(spark, str(tmp_path / "runs"), "d", "m", 1).count() == 3
    assert read_artifact(spark, str(tmp_path / "runs"), "d", "m", 2).count() == 1
    write_table(df, str(tmp_path / "csv"), "csv")
    assert read_delimited(spark, str(tmp_path / "csv")).count() == 3
    assert [r["row_id"] for r in with_row_id(df, ["id"]).orderBy("id").collect()] == [0, 1, 2]


def test_prepare_all(spark, tmp_path):
    bank = tmp_path / "bank.csv"
    bank.write_text("age;job;y\n" + "".join(f"{20 + i};{'ab'[i % 2]};{'yes' if i % 4 == 0 else 'no'}\n" for i in range(40)))
    text = tmp_path / "text.csv"
    words = ["profit rose strong", "loss fell weak", "plain words here"]
    labels = ["positive", "negative", "neutral"]
    text.write_text("".join(f"{labels[i % 3]},{words[i % 3]} item{i % 5} number{i}\n" for i in range(30)))
    out = prepare_all(
        spark, {"bank": TabularDataset(str(bank), cl.TabularSpec("y", {"no": 0, "yes": 1}), sep=";")},
        TextDataset(str(text), FINANCE_TEXT, names=["sentiment", "text"]), "bank", str(tmp_path / "out"), components=3,
    )
    assert out["text_clean"].count() == 30
    features = out["text_features"]
    assert features.columns[:3] == ["row_id", "sentiment", "sentiment_id"] and "text_svd_3" in features.columns
    assert "text" not in features.columns
    joined = out["weak_multimodal_strict"]
    assert joined.count() == 40
    assert joined.filter("target = 1 AND text_sentiment <> 'positive'").count() == 0
    assert joined.filter("target = 0 AND text_sentiment = 'positive'").count() == 0
    assert {"age", "y", "target", "text_positive_hint_count", "text_text_svd_1"} <= set(joined.columns)


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, " x ", "yes"), (2, "?", "no")], "Id int, `Job-Name` string, y string").write.parquet(str(tmp_path / "in"))
    spec = cl.TabularSpec("y", {"no": 0, "yes": 1}, missing_tokens=("?",))
    stream = spark.readStream.schema("Id int, `Job-Name` string, y string").parquet(str(tmp_path / "in"))
    query = write_stream(clean_tabular_stream(stream, spec), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    batch = cl.clean_tabular(spark.read.parquet(str(tmp_path / "in")), spec)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect())
    with pytest.raises(ValueError, match="target_map"):
        clean_tabular_stream(stream, cl.TabularSpec("y"))
    spark.createDataFrame([(1, " a  b ", "Positive "), (2, "c", "odd")], "k int, text string, sentiment string").write.parquet(str(tmp_path / "tin"))
    texts = spark.readStream.schema("k int, text string, sentiment string").parquet(str(tmp_path / "tin"))
    query = write_stream(clean_text_stream(texts, FINANCE_TEXT), str(tmp_path / "tout"), str(tmp_path / "tstate"))
    query.awaitTermination(120)
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "tout")).collect()] == ["a b"]
