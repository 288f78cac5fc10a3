from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import textfeatures


def test_only_terms_near_the_top_become_rows(spark, monkeypatch):
    """Rare terms are sorted out within documents, and vectors are built from what is left."""
    texts = spark.range(300).select("id", F.concat_ws(" ", *[F.lit(w) for w in ("alpha beta gamma", "beta")], *[
        F.concat(F.lit(f"rare{k}x"), F.col("id")) for k in range(20)
    ]).alias("text"))
    cells, plain = [], textfeatures.term_cells
    monkeypatch.setattr(textfeatures, "term_cells", lambda docs: cells.append(docs) or plain(docs))
    vectors, terms = textfeatures.tfidf(texts, "id", max_features=3, min_df=2, stop_words=())
    assert terms == ["alpha", "alpha beta", "beta"]
    held = cells[-1].agg(F.count("*").alias("n"), F.max(F.size("terms")).alias("most")).first()
    assert held["n"] == 300 and held["most"] < 20
    weights = textfeatures.tfidf_weights(vectors, terms, "id").groupBy("term").agg(F.avg("weight").alias("w"), F.count("*").alias("n"))
    got = {r["term"]: (round(r["w"], 9), r["n"]) for r in weights.collect()}
    assert got == {t: (round(w / 6**0.5, 9), 300) for t, w in (("alpha", 1), ("alpha beta", 1), ("beta", 2))}
