"""Preparation, training and search on small frames with small settings."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import features as FE
from tablewright.operators import models as M
from tablewright.operators.ml_stages import validate_numeric

ROWS = [(i, float(i % 7) if i % 9 else float("nan"), str(i % 5) if i % 6 else "n/a", [" 'a'", "b", None, "c"][i % 4],
         "some words here" if i % 2 else "other words there", ["x", "'y'", " z ", None][(i % 7) % 4]) for i in range(120)]
TYPES = [{"column_name": c, "col_type": t, "n_unique": 4} for c, t in
         (("num", "numeric"), ("txt", "numeric"), ("cat", "categorical"), ("words", "text"))]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "id long, num double, txt string, cat string, words string, y string").cache()


@pytest.fixture(scope="module")
def prepared(frame):
    stages = M.build_preparation(TYPES, "y", "classification")
    prep = Pipeline(stages=[M.label_stage("y", "classification", True)] + stages).fit(frame)
    return prep, M.labelled(prep.transform(frame)).select("features", "label").cache()


def test_preparation_names_every_slot(frame, prepared):
    prep, ready = prepared
    names = M.feature_names(prep)
    assert len(names) == len(ready.first()["features"])
    assert {"num__num", "num__txt", "cat__cat_a", "cat__cat_b", "cat__cat_c", "text__words_words"} <= set(names)
    assert ready.where(F.exists(vector_to_array("features"), lambda x: F.isnan(x))).isEmpty()


def test_missing_classes_are_not_trained(frame, prepared):
    _, ready = prepared
    known = frame.where("y IS NOT NULL").count()
    assert ready.count() == known
    assert sorted(r[0] for r in ready.select("label").distinct().collect()) == [0.0, 1.0, 2.0]


def test_new_rows_may_lack_and_add_columns(frame, prepared):
    prep, _ = prepared
    out = prep.transform(frame.drop("num", "y").withColumn("more", F.lit(1)))
    assert out.count() == frame.count() and "more" in out.columns


def test_boosting_trials_reach_the_estimator(prepared):
    _, ready = prepared
    base = M.make_estimator("XGBoost", "classification", n_classes=3, trees=2)
    depths = []
    for depth in (1, 4):
        model = M.with_params(base, {"maxDepth": depth, "stepSize": 0.2, "regAlpha": 0.0, "colsample": 1.0}, 100).fit(ready)
        depths.append(max(len(t.feature) for round_ in model.trees() for t in round_))
        assert len(model.trees()) == 2 and all(len(round_) == 3 for round_ in model.trees())
    assert depths[0] == 3 and depths[1] > 3
    with pytest.raises(ValueError):
        M.with_params(base, {"numTrees": 3}, 100)


def test_spaces_and_defaults_fit_the_estimators():
    sizes = dict(n_classes=3, n_features=4, n_rows=100, label_std=2.0)
    for name, space in M.SEARCH_SPACES.items():
        task = "regression" if name == "Ridge" else "classification"
        for draw in M.sample_params(space, 5):
            M.with_params(M.make_estimator(name, task, **sizes), draw, 100, 2.0)
    boosted = {n: M.make_estimator(n, "regression", **sizes).settings() for n in ("XGBoost", "LightGBM", "CatBoost")}
    assert len({(p["stepSize"], p["numLeaves"], p["regLambda"]) for p in boosted.values()}) == 3
    forest = M.make_estimator("RandomForest", "regression", **sizes)
    assert (forest.getFeatureSubsetStrategy(), forest.getMaxDepth()) == ("all", M.FOREST_DEPTH)
    assert M.make_estimator("ExtraTrees", "regression", forest_depth=30, **sizes).getMaxDepth() == 30
    assert M.make_estimator("LinearSVC", "classification", n_classes=2, n_rows=50).getRegParam() == 0.02


def test_forest_grows_below_depth_five_and_ridge_equals_the_closed_form(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1000, 3)) * [1.0, 2.0, 3.0]
    y = x @ [30.0, -20.0, 10.0] + rng.normal(size=1000) * 5 + 100
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, label double"))
    for alpha in (1.0, 50.0):
        sizes = M._sizes(df, "regression")
        ridge = M.with_params(M.make_estimator("Ridge", "regression", **sizes), {"alpha": alpha}, 1000, sizes["label_std"])
        centred = x - x.mean(0)
        want = np.linalg.solve(centred.T @ centred + alpha * np.eye(3), centred.T @ (y - y.mean()))
        assert np.allclose(ridge.fit(df).coefficients, want, rtol=1e-5)
    forest = M.make_estimator("RandomForest", "regression", trees=3, **sizes).fit(df)
    assert max(t.depth for t in forest.trees) > 5


def test_search_refits_and_measures_the_best(prepared):
    _, ready = prepared
    board, model = M.search(ready, ready, "classification", ["LogisticRegression", "Unknown"], trials=3, folds=2, seconds=None)
    rows = board.collect()
    assert [(r["model"], r["trials"], r["failed"], r["is_best"]) for r in rows] == [
        ("LogisticRegression", 3, 0, True), ("Unknown", 0, 1, False)]
    assert "Unknown" in rows[1]["error"] and rows[1]["cv_metric"] is None and not rows[0]["budget_reached"]
    assert 0 <= rows[0]["test_metric"] <= 1
    assert model.transform(ready).select("prediction").count() == ready.count()


def test_search_falls_back(prepared, monkeypatch):
    _, ready = prepared
    monkeypatch.setattr(M, "FALLBACK_FAMILY", "RandomForest")
    board, model = M.search(ready, ready, "classification", ["Unknown"], trials=1, folds=2, trees=3)
    lost, row = board.collect()
    assert lost["model"] == "Unknown" and lost["error"] and not lost["is_best"]
    assert (row["model"], row["trials"], row["cv_metric"], row["is_best"]) == ("RandomForest", 0, None, True)


def test_perceptron_and_search_time_limit(prepared):
    _, ready = prepared
    board, _ = M.search(ready, ready, "classification", ["MLP", "LogisticRegression"], trials=5, folds=2, seconds=0,
                        hidden=(4,), max_iter=5)
    assert {r["model"]: r["trials"] for r in board.collect()} == {"MLP": 1, "LogisticRegression": 1}
    assert all(r["budget_reached"] for r in board.collect())


def test_search_ends_running_fits_with_its_budget(prepared, monkeypatch):
    import time

    from pyspark.sql.functions import udf
    _, ready = prepared

    class Slow(LogisticRegression):
        """One job that would take minutes, but for the first draw."""

        def _fit(self, dataset):
            if self.getRegParam() > 0:
                dataset.select(udf(lambda _: time.sleep(2))("label")).collect()
            return super()._fit(dataset)

    monkeypatch.setattr(M, "make_estimator", lambda *a, **k: Slow(maxIter=2))
    spaces = {"Slow": {"regParam": ("choice", [0.5]), "maxIter": ("choice", [3])}}
    draws = M.sample_params(spaces["Slow"], 4)
    draws[0]["regParam"] = 0.0
    monkeypatch.setattr(M, "sample_params", lambda *a, **k: draws)
    began = time.monotonic()
    board, _ = M.search(ready, ready, "classification", ["Slow"], trials=4, folds=2, seconds=15, spaces=spaces)
    row = board.first()
    assert time.monotonic() - began < 60
    assert (row["trials"], row["failed"], row["budget_reached"], row["is_best"]) == (1, 0, True, True)


def test_search_folds_equal_plain_cross_validation(prepared):
    _, ready = prepared
    board, _ = M.search(ready, ready, "classification", ["LogisticRegression"], trials=1, folds=3, seconds=None, spaces={})
    sizes = M._sizes(ready, "classification")
    fold = F.pmod(F.xxhash64("features", "label", F.lit(M.SEED)), F.lit(3))
    est, measure = M.make_estimator("LogisticRegression", "classification", **sizes), M.evaluator("classification")
    got = [measure.evaluate(est.fit(ready.where(fold != k)).transform(ready.where(fold == k))) for k in range(3)]
    assert abs(board.first()["cv_metric"] - sum(got) / 3) < 1e-6


def test_numeric_validation(frame):
    validate_numeric(frame, ["id", "num"])
    with pytest.raises(TypeError, match="txt"):
        validate_numeric(frame, ["num", "txt"])


def test_wide_columns_are_not_cut(frame):
    with pytest.raises(ValueError, match="id"):
        FE.fit_categories(frame, ["id", "cat"], limit=50)


def test_names_decide_the_target_without_a_job(spark):
    from tablewright.operators.coltypes import detect_target
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, price double, label string")
    assert detect_target(df).first()["target"] in ("label", "price")


def test_ordinal_dictionary_survives_saving(spark, frame):
    from pyspark.ml import PipelineModel

    from tablewright.operators.ml_stages import OrdinalEncoder
    from tablewright.session import scratch_path
    wide = frame.select("id", F.when(F.col("id") % 10 != 0, F.concat(F.lit(" 'v"), F.lpad(F.col("id").cast("string"), 3, "0"))).alias("v"))
    model = Pipeline(stages=[OrdinalEncoder(inputCol="v", outputCol="code")]).fit(wide)
    path = scratch_path(spark, "ordinal")
    model.save(path)
    new = wide.unionByName(spark.createDataFrame([(999, "unseen")], "id long, v string"))
    got = {r["id"]: r["code"] for r in PipelineModel.load(path).transform(new).collect()}
    values = sorted(i for i in range(120) if i % 10)
    assert got[999] == -1.0 and all(got[i] == values.index(i) for i in values)
    assert got[0] == 0.0        # NULL takes the mode; on ties the smallest value


SMALL_BOOST = {"maxIter": ("int", 1, 2), "maxDepth": ("int", 1, 2)}
SMALL_FOREST = {"numTrees": ("int", 2, 3), "maxDepth": ("int", 1, 2)}


def test_search_runs_all_families_of_the_reference(prepared):
    _, ready = prepared
    spaces = M.AUTOML_SPACES | dict.fromkeys(["XGBoost", "LightGBM"], SMALL_BOOST) | dict.fromkeys(["RandomForest", "ExtraTrees"], SMALL_FOREST)
    board, _ = M.search(ready, ready, "classification", M.AUTOML_FAMILIES["classification"], trials=2, folds=2,
                        seconds=None, spaces=spaces, max_iter=5)
    assert {r["model"]: r["trials"] for r in board.collect()} == dict.fromkeys(
        ["LightGBM", "XGBoost", "RandomForest", "LRL1", "ExtraTrees"], 2)
    lasso, plain = (M.with_params(M.make_estimator(n, "classification", n_classes=3, max_iter=20), {"C": 0.05}, 100).fit(ready)
                    for n in ("LRL1", "LogisticRegression"))
    assert (lasso.coefficientMatrix.toArray() == 0).sum() > (plain.coefficientMatrix.toArray() == 0).sum()


@pytest.fixture
def searched(spark, monkeypatch):
    """Runs a registered search without its fits; returns the arguments of each call."""
    import __spark_entry__ as entry
    from conftest import SF_SMALL

    def run(name):
        calls = []

        def search(train, test, task, names, **limits):
            calls.append((task, sorted(names), limits))
            rows = [(n, 0, None, None, "{}", False) for n in names]
            return spark.createDataFrame(rows, "model string, trials int, cv_metric double, test_metric double, params string, is_best boolean"), None
        monkeypatch.setattr(M, "search", search)
        return entry.queries()[name](spark, SF_SMALL).collect(), calls
    return run


def test_registered_searches_leave_no_family_out(searched):
    rows, calls = searched("model_tune")
    assert sorted(r["model"] for r in rows) == sorted(M.SEARCH_SPACES)
    assert [(task, "Ridge" in names) for task, names, _ in calls] == [("classification", False), ("regression", True)]
    rows, calls = searched("model_automl_search")
    assert sorted(r["model"] for r in rows) == ["ExtraTrees", "LRL1", "LightGBM", "RandomForest", "XGBoost"]
    assert all(r["model"] in calls[0][2]["spaces"] for r in rows)


def test_only_the_search_has_a_time_limit(searched):
    _, calls = searched("model_tune")
    assert calls and all(limits["seconds"] is None for _, _, limits in calls)
    _, calls = searched("model_automl_search")
    assert calls[0][2].get("seconds", M.SEARCH_SECONDS) == M.SEARCH_SECONDS == 120


def test_all_classifiers_and_multiclass_boosting_are_registered(spark, monkeypatch):
    import __spark_entry__ as entry
    from conftest import SF_SMALL
    make, kinds = M.make_estimator, []

    def small(name, task, **sizes):
        made = make(name, task, **sizes, trees=2, max_iter=3, hidden=(4,))
        kinds.append((name, task, type(made).__name__))
        return made
    monkeypatch.setattr(M, "make_estimator", small)
    board = entry.queries()["model_train_all"](spark, SF_SMALL).collect()
    assert {r["model"] for r in board} == {"RandomForest", "XGBoost", "LogisticRegression", "ExtraTrees", "SVM", "MLP"}
    assert ("XGBoost", "classification", "GradientBoosting") in kinds and all(0 <= r["f1_score"] <= 1 for r in board)
    boosted = entry.queries()["model_gbt"](spark, SF_SMALL)
    assert {"o_orderstatus", "prediction"} <= set(boosted.columns)
    assert kinds[-1] == ("XGBoost", "classification", "GradientBoosting")
    kinds.clear()
    assert "r2" in entry.queries()["model_train_all_regression"](spark, SF_SMALL).columns
    assert "model_gbt_regression" in entry.queries()
    assert {(n, t) for n, t, _ in kinds} == {(n, "regression") for n in ("RandomForest", "XGBoost", "LinearRegression", "Ridge", "ExtraTrees", "SVR")}


def test_the_bench_times_model_fits():
    import __spark_entry__ as entry
    import bench
    assert {"model_logistic", "model_train_all"} <= set(bench.HEADLINE) <= set(entry.queries())
