from __future__ import annotations

import importlib
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.functions.hashing import uniform
from tabloom.operators import alignment, fidelity, metrics, textfeatures, utility
from tabloom.operators.cleaning import TextSpec
from tabloom.operators.synthesis import gaussian_copula, independent, repair_domains, sequential
from tabloom.operators.synthesis.copula import correlated_normals, correlation_matrix, draw_factor, fit_copula
from tabloom.operators.synthesis.independent import fit_independent
from tabloom.operators.synthesis.stored import load_stored
from tabloom.operators.synthesis.levels import few_valued
from tabloom.operators.synthesis.repair import cast_back
from tabloom.operators.synthesis.sequential import TreeSettings
from tabloom.plans import compare, sweep
from tabloom.sources.tables import DEFAULT_RULES, STRICT_RULES, rules_frame


@pytest.fixture(scope="module")
def real(spark):
    """x drives y, the group and the target."""
    x = uniform(1, "x", F.col("id"))
    noise = uniform(1, "noise", F.col("id"))
    df = spark.range(1500).select(
        "id", (x * 100).alias("x"), (x * 50 + noise * 10).alias("y"), F.floor(x * 40 + noise * 3).cast("int").alias("size"),
        F.when(x + noise / 4 > 0.75, "high").when(x < 0.3, "low").otherwise("mid").alias("group"),
        (x + noise / 2 > 0.8).cast("int").alias("target"),
    )
    return df.persist()


def spearman(df, a, b):
    rows = np.array([(r[0], r[1]) for r in df.select(a, b).collect()], dtype=float)
    ranks = rows.argsort(axis=0).argsort(axis=0)
    return np.corrcoef(ranks.T)[0, 1]


# --- copula ---


def test_draw_factor():
    broken = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    factor = draw_factor(broken)
    fixed = factor @ factor.T
    assert np.allclose(np.diagonal(fixed), 1.0) and np.allclose(fixed, fixed.T)
    assert np.linalg.eigvalsh(fixed).min() > 0
    already = np.array([[1.0, 0.3], [0.3, 1.0]])
    assert np.allclose(draw_factor(already) @ draw_factor(already).T, already)


def test_correlated_normals(spark):
    wanted = np.array([[1.0, 0.6, 0.2], [0.6, 1.0, 0.3], [0.2, 0.3, 1.0]])
    rows = correlated_normals(spark.range(20000).withColumnRenamed("id", "row_id"), draw_factor(wanted), 42)
    got = correlation_matrix(rows, ["y_0", "y_1", "y_2"])
    assert np.abs(got - wanted).max() < 0.02


def test_constant_column_has_zero_correlation(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    assert correlation_matrix(df, ["a", "b"]).tolist() == [[1.0, 0.0], [0.0, 1.0]]


def test_copula_keeps_marginals_and_dependence(spark, real):
    synth = gaussian_copula(real, ["id"], seed=5).persist()
    again = gaussian_copula(real.repartition(3), ["id"], seed=5)
    assert synth.columns == ["row_id", "x", "y", "size", "group", "target"]
    assert [f.dataType for f in synth.schema][1:] == [f.dataType for f in real.schema][1:]
    assert sorted(synth.collect()) == sorted(again.collect())
    assert spearman(synth, "x", "y") == pytest.approx(spearman(real, "x", "y"), abs=0.05)
    assert abs(spearman(independent(real, ["id"]), "x", "y")) < 0.1
    assert synth.join(real, "x", "left_anti").count() == 0
    rollup = fidelity.fidelity_rollup(fidelity.fidelity_report(real.drop("id"), synth.drop("row_id"))).first()
    assert rollup["mean_categorical_tvd"] < 0.06


def test_copula_join_path_equals_broadcast_path(spark, real):
    small = gaussian_copula(real, ["id"], 200)
    large = gaussian_copula(real, ["id"], 200, broadcast_rows=0)
    assert sorted(small.collect()) == sorted(large.collect())


def test_copula_sorted_values_and_levels(spark, real):
    fit = fit_copula(real, ["id"])
    cells = fit.sorted_cells.filter("col = 1").orderBy("idx").collect()
    values = sorted(r["y"] for r in real.collect())
    assert [c["d"] for c in cells] == values and [c["idx"] for c in cells] == list(range(1500))
    assert set(few_valued(real)) == {"size", "group", "target"}


def test_copula_names_columns_with_gaps(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, float("nan"), "b"), (3, 2.0, None)], "id int, v double, s string")
    with pytest.raises(ValueError, match=r"\['v', 's'\]"):
        gaussian_copula(df, ["id"])


def test_independent_join_path_and_dates(spark, real):
    dated = real.withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))).withColumn("at", F.timestamp_seconds("id"))
    small = independent(dated, ["id"], 300)
    large = independent(dated, ["id"], 300, broadcast_rows=0)
    assert sorted(small.collect()) == sorted(large.collect())
    assert small.schema["day"].dataType.simpleString() == "date"


# --- repair ---


def test_repair(spark):
    real = spark.createDataFrame(
        [(k * 2 % 8, k, k / 2, "t") for k in range(40)], "low int, high bigint, real double, text string"
    )
    synth = spark.createDataFrame(
        [("3", "2.5", "1e1", "x"), ("bad", None, "nan", None), ("99", "3.5", "oops", "7")], "low string, high string, real string, text string"
    )
    rows = [tuple(r) for r in repair_domains(real, synth).collect()]
    assert rows == [(2, 2, 10.0, "x"), (0, 19, None, None), (6, 4, None, "7")]
    assert cast_back(synth.select("text"), real.schema).dtypes == real.dtypes


# --- sequential ---


@pytest.mark.parametrize("learner", ["rf", "gbt"])
def test_sequential(spark, real, learner):
    settings = TreeSettings(learner, trees=8, rounds=8, depth=5)
    synth = sequential(real, ["id"], seed=3, settings=settings).persist()
    assert synth.count() == 1500
    assert synth.dtypes[1:] == real.dtypes[1:]
    assert spearman(synth, "x", "y") > 0.8
    assert {r[0] for r in synth.select("group").distinct().collect()} <= {"low", "mid", "high"}
    means = {r["target"]: r["m"] for r in synth.groupBy("target").agg(F.avg("x").alias("m")).collect()}
    assert means[1] > means[0] + 20
    repeated = sequential(real, ["id"], seed=3, settings=settings)
    assert sorted(repeated.collect()) == sorted(synth.collect())


def test_sequential_join_path_cap_and_constant(spark, real):
    df = real.select("id", "group", F.lit("only").alias("constant"), "x", "target")
    settings = TreeSettings("rf", trees=3, depth=3)
    small = sequential(df, ["id"], 200, settings=settings, max_training_rows=500, max_condition_cols=2)
    large = sequential(df, ["id"], 200, settings=settings, max_training_rows=500, max_condition_cols=2, broadcast_rows=0)
    assert sorted(small.collect()) == sorted(large.collect())
    assert small.select("constant").distinct().collect()[0][0] == "only"
    with pytest.raises(ValueError, match="x"):
        sequential(df.withColumn("x", F.when(F.col("id") > 5, F.col("x"))), ["id"], settings=settings)


def test_sequential_missing_category_is_a_level(spark, real):
    df = real.select("id", "x", F.when(F.col("x") > 50, F.col("group")).alias("group"))
    synth = sequential(df, ["id"], settings=TreeSettings("rf", trees=5, depth=4))
    share = synth.filter("group IS NULL").count() / 1500
    assert share == pytest.approx(df.filter("group IS NULL").count() / 1500, abs=0.07)


# --- metrics and utility ---


def test_auroc_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(300)]
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    df = spark.createDataFrame(rows, "label int, score double")
    assert metrics.auroc(df).first()["auroc"] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
    assert metrics.auroc(df.filter("label = 1")).first()["auroc"] is None


def test_confusion_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    row = metrics.confusion(df).first()
    assert (row["accuracy"], row["f1"]) == (1.0, 0.0)


def test_logistic_regression_reaches_the_penalised_optimum(spark, real):
    train = real.select("x", "y", "group", "target")
    prep = utility.fit_preprocessor(train, ["x", "y", "group"])
    data = prep.transform(train, ["target"]).withColumn("target", F.col("target").cast("double"))
    model = utility.fit_logistic(data, "target", 1500)
    rows = data.select("target", vector_to_array("features").alias("f")).collect()
    features, y = np.array([r["f"] for r in rows]), np.array([r["target"] for r in rows])
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(features @ w + b)))
    assert features.shape[1] == 5
    assert np.abs(features.T @ (p - y) + w).max() < 0.05
    assert abs((p - y).sum()) < 0.05


def test_preprocessing_imputes_scales_and_ignores_unseen(spark):
    train = spark.createDataFrame([(1.0, "a"), (None, "a"), (3.0, None), (5.0, "b")], "n double, s string")
    prep = utility.fit_preprocessor(train, ["n", "s"])
    assert prep.fill == {"n": 3.0, "s": "a"}
    assert prep.scaling["n"] == pytest.approx((3.0, math.sqrt(2.0)))
    test = spark.createDataFrame([(3.0, "zzz"), (None, "b")], "n double, s string")
    assert [list(r["features"].toArray()) for r in prep.transform(test).collect()] == [[0.0, 0.0, 0.0], [0.0, 1.0, 0.0]]


def test_utility_orders_generators(spark, real):
    copula = utility.utility_report(real, gaussian_copula(real, ["id"]).drop("row_id"), ["id"])
    scores = {r["setting"]: r["auroc"] for r in copula.collect()}
    shuffled = utility.utility_report(real, independent(real, ["id"]).drop("row_id"), ["id"])
    chance = {r["setting"]: r["auroc"] for r in shuffled.collect()}
    assert scores["train_real_test_real"] > 0.9
    # Independent columns carry no signal, so that model points in a random direction: anything below the copula's.
    assert scores["train_synthetic_test_real"] > 0.9
    assert scores["train_synthetic_test_real"] > chance["train_synthetic_test_real"]


def test_single_class_synthetic_target(spark, real):
    synth = real.drop("id").withColumn("target", F.lit(1))
    rows = {r["setting"]: r for r in utility.utility_report(real, synth, ["id"]).collect()}
    assert rows["train_synthetic_test_real"]["auroc"] == 0.5


# --- fidelity ---


def test_fidelity_edges(spark):
    real = spark.createDataFrame([(1.0, "a", 0, "p"), (float("nan"), None, 1, "q"), (3.0, "b", 1, None)], "v double, g string, target int, text_sentiment string")
    synth = spark.createDataFrame([(2.0, "a", 0, "q")], "v double, g string, target int, text_sentiment string")
    rows = {(r["column"], r["target"], r["sentiment"]): r for r in fidelity.fidelity_report(real, synth).collect()}
    numeric = rows[("v", None, None)]
    assert (numeric["real_mean"], numeric["synth_std"], numeric["abs_std_diff"]) == (2.0, None, None)
    group = rows[("g", None, None)]
    assert (group["num_levels"], group["total_variation_distance"]) == (3, pytest.approx(2 / 3))
    cross = {k[1:]: (r["real_prob"], r["synth_prob"]) for k, r in rows.items() if r["type"] == "cross_modal"}
    assert cross == {("0", "p"): (1.0, 0.0), ("0", "q"): (0.0, 1.0), ("1", "p"): (0.0, 0.0), ("1", "q"): (1.0, 0.0)}


def test_total_variation_is_a_bounded_distance(spark, real):
    columns = ["group", "size"]
    a, b = fidelity.level_shares(real.filter("x > 50"), columns), fidelity.level_shares(real.filter("x <= 50"), columns)
    for r, s in zip(*(fidelity.categorical_summary(*p).orderBy("column").collect() for p in ((a, b), (b, a)))):
        assert 0.0 <= r["total_variation_distance"] <= 1.0 + 1e-12
        assert r["total_variation_distance"] == pytest.approx(s["total_variation_distance"])


# --- text ---


def corpus(spark):
    rng = random.Random(3)
    words = ["profit", "loss", "market", "growth", "price", "share", "sales", "unit", "plan", "result"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(3, 12)))) for i in range(60)]
    return spark.createDataFrame([*rows, (60, ""), (61, "zebra")], "doc_id int, text string"), rows


def test_tfidf_and_svd_against_numpy(spark):
    df, _ = corpus(spark)
    vectors, terms = textfeatures.tfidf(df, "doc_id", max_features=25, stop_words=())
    rows = {r["doc_id"]: r["v"] for r in vectors.select("doc_id", vector_to_array("tfidf").alias("v")).collect()}
    matrix = np.array([rows[i] for i in range(62)])
    assert len(terms) == 25 and terms == sorted(terms)
    assert np.allclose(np.linalg.norm(matrix[:60], axis=1), 1.0) and not matrix[60:].any()
    scores = textfeatures.svd_features(vectors, len(terms), "doc_id", 24).orderBy("doc_id").drop("doc_id").collect()
    got = np.array(scores)
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(matrix @ vt[:24].T), atol=1e-8)
    full = textfeatures.right_singular_vectors(vectors, 25)
    assert np.allclose(full.T @ full, np.eye(25), atol=1e-8)
    assert np.isclose((s**2).sum(), (matrix**2).sum())


def test_single_term_vocabulary_is_used_as_is(spark):
    df = spark.createDataFrame([(1, "gold"), (2, "gold gold"), (3, "tin")], "doc_id int, text string")
    vectors, terms = textfeatures.tfidf(df, "doc_id", stop_words=())
    assert terms == ["gold"]
    got = textfeatures.svd_features(vectors, 1, "doc_id").orderBy("doc_id").collect()
    assert [r["text_svd_1"] for r in got] == [1.0, 1.0, 0.0]
    with pytest.raises(ValueError, match="Empty vocabulary"):
        textfeatures.tfidf(df.filter("doc_id = 3"), "doc_id", stop_words=())


def test_label_ids_by_first_appearance(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, None), (5, "c"), (4, "a")], "k int, s string")
    from tabloom.operators.cleaning import label_order_ids

    assert {r["k"]: r["s_id"] for r in label_order_ids(df, "s", "k").collect()} == {1: 0, 2: -1, 3: 1, 4: 2, 5: 0}


# --- alignment ---


def test_alignment_obeys_rules_on_both_join_paths(spark):
    tabular = spark.range(600).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("target"))
    text = spark.createDataFrame([(i, ["negative", "neutral", "positive"][i % 3], i * 1.5) for i in range(31)], "doc int, sentiment string, len double")
    for rules in (DEFAULT_RULES, STRICT_RULES):
        frame = rules_frame(spark, rules)
        small = alignment.weak_alignment(tabular, text, frame, "k", "doc")
        large = alignment.weak_alignment(tabular.repartition(5), text, frame, "k", "doc", broadcast_rows=0)
        mixed = alignment.weak_alignment(tabular, text, frame, "k", "doc", broadcast_rows=15)
        assert small.columns == ["k", "target", "text_sentiment", "text_len"]
        rows = small.collect()
        assert len(rows) == 400 and all(r["text_sentiment"] in rules[r["target"]] for r in rows)
        assert sorted(rows) == sorted(large.collect()) == sorted(mixed.collect())
    with pytest.raises(ValueError, match="No rule"):
        alignment.check_rules(tabular, rules_frame(spark))
    with pytest.raises(ValueError, match="No text row"):
        alignment.weak_alignment(tabular, text.filter("sentiment = 'positive'"), rules_frame(spark), "k", "doc")


# --- sweeps ---


def test_sweep_summary_and_artifacts(spark, real, tmp_path):
    dataset = sweep.Dataset(real, ["id"])
    methods = {m: g for m, g in sweep.generators().items() if m in ("independent", "gaussian_copula")}
    results = sweep.sweep({"d": dataset}, methods, [1, 2], 400, artifacts=str(tmp_path / "runs"))
    assert results.count() == 4
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 1600
    summary = sweep.summarize_seeds(results).collect()
    assert [r["method"] for r in summary] == ["gaussian_copula", "independent"]
    assert summary[0]["trtr_auroc_std"] is not None and summary[0]["mean_cross_modal_abs_diff"] is None
    one = sweep.summarize_seeds(results.filter("seed = 1")).first()
    assert one["tstr_auroc_std"] is None
    assert sweep.best_method(sweep.summarize_seeds(results)).first()["method"] == "gaussian_copula"


def test_the_generators_of_a_sweep_fit_on_every_row(spark, monkeypatch):
    """The rows of the fits of a sweep are not bounded, unless the caller asks for it."""
    seen, fits = {}, importlib.import_module("tabloom.operators.synthesis.sequential")
    few = TreeSettings("rf", trees=1, depth=2), TreeSettings("gbt", rounds=1, depth=2)
    for name in ("_forests", "_boosters"):
        own = getattr(fits, name)
        monkeypatch.setattr(fits, name, lambda p, every, labelled, *a, n=name, f=own: seen.update({n: labelled.count()}) or f(p, every, labelled, *a))
    table = spark.range(9_000).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("target"))
    for bounds, rows in ({}, 9_000), ({"forest_rows": 600, "boosting_rows": 600}, 600):
        for method in ("random_forest", "xgboost"):
            assert sweep.generators(*few, **bounds)[method](sweep.Dataset(table, ["id"]), 20, 1).count() == 20
        assert seen == {"_forests": rows, "_boosters": rows}


def test_ablation_and_tuning(spark, real):
    dataset = sweep.Dataset(real.select("id", "x", "group", "target"), ["id"])
    settings = [sweep.Setting("a", 300, 1, 1, 2), sweep.Setting("b", None, 2, 2, 2)]
    rows = sweep.ablation({"d": dataset}, [7], 200, settings).orderBy("ablation").collect()
    assert [(r["ablation"], r["max_training_rows"], r["max_condition_cols"]) for r in rows] == [("a", 300, 1), ("b", None, 2)]
    ranked = sweep.tuning(dataset, 200, settings).collect()
    assert [r["tstr_auroc"] for r in ranked] == sorted((r["tstr_auroc"] for r in ranked), reverse=True)
    assert {"rounds", "depth"} <= set(ranked[0].asDict())


LABELS = {"weak_multimodal": "Manual", "weak_multimodal_strict": "Strict"}


def test_comparison_is_ordered_and_checked(spark):
    rows = [(d, m, 0.5) for d in ("weak_multimodal", "other") for m in ("xgboost", "independent", "mystery")]
    table = compare.comparison_table([spark.createDataFrame(rows, "dataset string, method string, tstr_auroc_mean double")], LABELS)
    assert [(r["benchmark"], r["method_label"]) for r in table.collect()] == [("Manual", "Ind."), ("Manual", "XGB")]
    with pytest.raises(ValueError, match="Manual: ctgan"):
        compare.require_complete(table)


def test_registered_runs_are_the_published_ones(spark, monkeypatch):
    import bench
    from catalog import runs

    seen = {}
    monkeypatch.setattr(runs, "sequential_table", lambda *_: spark.range(1).withColumnRenamed("id", "o_orderkey"))
    monkeypatch.setattr(sweep, "generators", lambda *args, **options: seen.update(generators=(args, options)) or {})
    monkeypatch.setattr(sweep, "sweep", lambda datasets, methods, seeds, **options: seen.update(sweep=(list(seeds), options)))
    monkeypatch.setattr(sweep, "ablation", lambda datasets, seeds, **options: seen.update(ablation=(list(seeds), options)))
    monkeypatch.setattr(sweep, "tuning", lambda dataset, **options: seen.update(tuning=options))
    for query in (runs.sweep, runs.ablation, runs.tuning):
        query(spark, "")
    assert seen == {
        "generators": ((), {}), "sweep": ([42, 123, 2024], {}), "ablation": ([42, 123, 2024], {"settings": sweep.ABLATION}),
        "tuning": {"settings": sweep.TUNING},
    }
    assert {"seq_rf", "seq_gbt"} <= set(bench.HEADLINE)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables are not here")
def test_sequential_table_has_all_aligned_columns(spark):
    from catalog.inputs import aligned
    from catalog.synthesis import sequential_table

    assert sequential_table(spark, "/root/testdata/sf0.001").columns == aligned(spark, "/root/testdata/sf0.001").columns


# --- stored fits and the run log ---

sequential_module = importlib.import_module("tabloom.operators.synthesis.sequential")

def test_dates_are_generated_as_numbers(spark):
    df = spark.range(400).select(
        "id", F.expr("date_add(DATE'2001-03-01', cast(id % 37 as int))").alias("day"),
        F.expr("timestamp_seconds(1000000 + id * 977)").alias("at"), F.expr("if(id % 5 = 0, null, date'2000-01-01')").alias("gap"),
        F.expr("cast(timestamp_seconds(id * 3600) as timestamp_ntz)").alias("local"), (F.col("id") % 2).cast("int").alias("target"),
    )
    fit = sequential_module.fit_sequential(df, ["id"], settings=TreeSettings("rf", trees=3, depth=3))
    assert fit.types == {"day": "numeric", "at": "numeric", "gap": "categorical", "local": "numeric", "target": "categorical"}
    out = fit.generate(500, 5)
    assert out.drop("row_id").dtypes == df.drop("id").dtypes
    got = out.agg(
        F.count("day").alias("days"), F.count("at").alias("ats"), F.count_if(F.col("gap").isNull()).alias("gaps"),
        F.min("day").cast("string").alias("low"), F.max("day").cast("string").alias("high"),
    ).first()
    assert (got["days"], got["ats"]) == (500, 500) and 40 < got["gaps"] < 180
    assert got["low"] >= "2001-01-01" and got["high"] <= "2001-06-01"


@pytest.mark.parametrize("learner", ["rf", "gbt"])
def test_a_stored_fit_generates_the_same_rows(spark, real, tmp_path, learner):
    settings, real = TreeSettings(learner, trees=3, rounds=2, depth=2), real.select("id", "x", "group", "target")
    fit = sequential_module.fit_sequential(real, ["id"], 3, settings=settings)
    fit.save(str(tmp_path / "fit"))
    loaded = sequential_module.load_fit(spark, str(tmp_path / "fit"))
    for seed in (3, 4):
        assert loaded.generate(200, seed).collect() == fit.generate(200, seed).collect()
    assert fit.generate(200, 3).collect() == sequential(real, ["id"], 200, 3, settings=settings).collect()
    assert fit.generate(200, 3).collect() != fit.generate(200, 4).collect()


@pytest.mark.parametrize("kind", ["independent", "copula", "few"])
def test_stored_orders_generate_the_same_rows(spark, real, tmp_path, kind):
    real = real.withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")))
    if kind == "few":
        real = real.select("id", "group", "target")
    fit = (fit_copula if kind == "copula" else fit_independent)(real, ["id"])
    fit.save(str(tmp_path / "fit"))
    loaded = load_stored(spark, str(tmp_path / "fit"))
    assert type(loaded) is type(fit) and loaded.schema == fit.schema
    rows = sorted(loaded.generate(200, 4).collect())
    assert rows == sorted(fit.generate(200, 4).collect())
    plain = (gaussian_copula if kind == "copula" else independent)(real, ["id"], 200, 4)
    assert rows == sorted(plain.collect()) != sorted(loaded.generate(200, 5).collect())


def test_a_sweep_stores_the_fit_of_sorted_columns(spark, real, tmp_path, monkeypatch):
    fits = []
    monkeypatch.setattr(sweep.OrderGenerator, "fit", lambda self, d, s, own=sweep.OrderGenerator.fit: fits.append(self.make) or own(self, d, s))
    dataset = {"d": sweep.Dataset(real.select("id", "x", "target"), ["id"])}
    methods, log = {"independent": sweep.generators()["independent"]}, str(tmp_path / "log")
    assert sweep.sweep(dataset, methods, [1], 200, log=log, split_seed=7).count() == 1
    assert sweep.sweep(dataset, methods, [1, 2], 200, log=log, split_seed=7).count() == 2
    assert fits == [fit_independent]  # the new seed generates from the stored fit


def test_a_sweep_goes_on_where_it_stopped(spark, real, tmp_path, monkeypatch):
    dataset = {"d": sweep.Dataset(real.select("id", "x", "group", "target"), ["id"])}
    trees = sweep.TreeGenerator(TreeSettings("gbt", rounds=1, depth=2), 300)
    fits = []
    monkeypatch.setattr(sweep.TreeGenerator, "fit", lambda self, d, s, own=sweep.TreeGenerator.fit: fits.append(s) or own(self, d, s))
    methods = {"independent": sweep.generators()["independent"], "xgboost": trees}
    log = str(tmp_path / "log")
    whole = sweep.sweep(dataset, methods, [1, 2], 200)
    assert fits == [1]

    finish, done = sweep.RunLog.finish, []

    def ended(self, *args):
        if len(done) == 2:
            raise RuntimeError("ended")
        finish(self, *args)
        done.append(args[-2:])

    monkeypatch.setattr(sweep.RunLog, "finish", ended)
    with pytest.raises(RuntimeError, match="ended"):
        sweep.sweep(dataset, methods, [1, 2], 200, log=log, parallel=1)
    assert len(done) == 2
    again = []
    monkeypatch.setattr(sweep.RunLog, "finish", lambda self, *args: again.append(args[-2:]) or finish(self, *args))
    results = sweep.sweep(dataset, methods, [1, 2], 200, log=log, parallel=1)
    assert len(again) == 2 and not set(again) & set(done)
    rounded = [[tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()] for df in (results, whole)]
    assert sorted(rounded[0]) == sorted(rounded[1])
    assert fits == [1, 1]  # the logged sweep made one fit of its own and kept it
    assert spark.read.parquet(f"{log}/runs/d/xgboost/2/utility").count() == 3
    assert spark.read.parquet(f"{log}/runs/d/xgboost/2/synthetic").count() == 200
    assert spark.read.parquet(f"{log}/runs/d/xgboost/2/fidelity").count() > 0


def test_level_report(spark):
    real = spark.createDataFrame([("a", 1), ("b", None), ("a", 2)], "x string, y int")
    synth = spark.createDataFrame([("a", 1), ("c", None), (None, 7), ("a", 1)], "x string, y int")
    got = {r["column"]: tuple(r)[1:] for r in fidelity.level_report(real, synth, ["x", "y"]).collect()}
    assert got == {"x": (4, 1, 2), "y": (4, 1, 1)}
    assert fidelity.level_report(real, synth.limit(0), ["x"]).collect() == []
