"""Inputs of the queries: what is moved and stored on the way."""

from __future__ import annotations

from contextlib import redirect_stdout
from io import StringIO

from catalog.inputs import labelled_text, light_features

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    out = StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_texts_are_moved_once_for_their_labels(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(labelled_text(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange") == 2, plan


def test_light_features_are_stored_without_texts(spark):
    features = light_features(spark, SF)
    plan = _plan(features)
    assert "Scan ExistingRDD" in plan and "Join" not in plan and "regexp" not in plan
    assert "text" not in features.columns and features.count() == labelled_text(spark, SF).count()
