"""Model families, strategy rules, training, search and scoring (MOD1-MOD14, FEAT8/11).

Estimators are MLlib's; names of the reference's families map to the nearest Spark-native
estimator and the mapping is reported (``ESTIMATOR_FOR``).  Strategy and recommendation
rules are column expressions over profile rows, so many tables are decided in one job.
"""

from __future__ import annotations

import contextlib
import itertools
import logging
import math
import random
import threading
import time
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from contextlib import nullcontext

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .boosting import GradientBoosting
from .forest import HistogramForest
from .kernel import KernelSVC, KernelSVR
from .neural import BatchNormMlp
from .perceptron import SigmoidMlp
from .random_trees import ExtraTrees

log = logging.getLogger(__name__)

# ---- fixed values -------------------------------------------------------------------------
SEED = 42
N_TREES = 200
MAX_ITER_LR = 2000
CV_FOLDS = 3
TUNE_TRIALS = 30

# task -> size bucket -> candidate names (preference order)
MODEL_CANDIDATES = {
    "classification": {
        "small": ["RandomForest", "XGBoost", "LightGBM", "LogisticRegression", "CatBoost", "ExtraTrees", "SVM"],
        "medium": ["LightGBM", "XGBoost", "RandomForest", "CatBoost", "LogisticRegression", "ExtraTrees"],
        "large": ["LightGBM", "XGBoost", "CatBoost", "RandomForest"],
    },
    "regression": {
        "small": ["RandomForest", "XGBoost", "LightGBM", "LinearRegression", "CatBoost", "ExtraTrees", "Ridge"],
        "medium": ["LightGBM", "XGBoost", "RandomForest", "CatBoost", "ExtraTrees"],
        "large": ["LightGBM", "XGBoost", "CatBoost", "RandomForest"],
    },
    "time_series": {"small": ["ARIMA", "Prophet", "LSTM"], "medium": ["LSTM", "Prophet"], "large": ["LSTM", "GRU"]},
    "nlp": {"small": ["BERT", "DistilBERT"], "medium": ["BERT", "RoBERTa"], "large": ["RoBERTa", "GPT"]},
    "computer_vision": {"small": ["ResNet18", "MobileNet"], "medium": ["ResNet50", "EfficientNet"],
                        "large": ["EfficientNetB7", "ViT"]},
    "clustering": {"small": ["KMeans", "DBSCAN", "AgglomerativeClustering"], "medium": ["KMeans", "MiniBatchKMeans"],
                   "large": ["MiniBatchKMeans"]},
}
RECOMMEND_FALLBACK = ["LightGBM", "XGBoost", "RandomForest"]

# strategy thresholds
LARGE_ROWS = 100_000
MEDIUM_ROWS = 10_000
CATEGORICAL_SHARE = 0.4
MIN_CATEGORICAL_COLUMNS = 3

# model families that do not fit a task, and the tasks a deep family is made for
INCOMPATIBLE = {
    "time_series": ["LogisticRegression", "SVM", "SVR", "LinearRegression", "Ridge"],
    "nlp": ["RandomForest", "XGBoost", "LightGBM", "CatBoost", "LogisticRegression", "SVM", "SVR",
            "LinearRegression", "Ridge"],
    "computer_vision": ["RandomForest", "XGBoost", "LightGBM", "CatBoost", "LogisticRegression", "SVM", "SVR",
                        "LinearRegression", "Ridge"],
}
DEEP_TASKS = {
    "LSTM": ["time_series", "classification", "regression"], "GRU": ["time_series", "classification", "regression"],
    "MLP": ["classification", "regression"], "CNN1D": ["time_series", "classification"],
    "BERT": ["nlp", "classification"], "DistilBERT": ["nlp", "classification"], "RoBERTa": ["nlp", "classification"],
    "ResNet18": ["computer_vision"], "ResNet50": ["computer_vision"], "EfficientNet": ["computer_vision"],
    "ViT": ["computer_vision"], "MobileNet": ["computer_vision"],
}
DEEP_MODELS = ["LSTM", "GRU", "MLP", "BERT", "DistilBERT", "RoBERTa", "ResNet18", "ResNet50", "EfficientNet", "ViT",
               "MobileNet", "ARIMA", "Prophet"]
NO_CHOICE = ["auto", "all", ""]

# random-search bounds: family -> parameter -> (kind, low, high[, step])
SEARCH_SPACES = {
    "RandomForest": {"numTrees": ("int_step", 50, 500, 50), "maxDepth": ("int", 3, 30),
                     "minInstancesPerSplit": ("int", 2, 20), "minInstancesPerNode": ("int", 1, 10),
                     "featureSubsetStrategy": ("choice", ["sqrt", "log2", "all"])},
    "XGBoost": {"maxIter": ("int_step", 50, 500, 50), "stepSize": ("log", 1e-3, 0.3), "maxDepth": ("int", 3, 12),
                "subsamplingRate": ("float", 0.5, 1.0), "colsample": ("float", 0.5, 1.0),
                "regAlpha": ("log", 1e-8, 10.0), "regLambda": ("log", 1e-8, 10.0)},
    "LightGBM": {"maxIter": ("int_step", 50, 500, 50), "stepSize": ("log", 1e-3, 0.3), "numLeaves": ("int", 20, 300),
                 "maxDepth": ("int", 3, 15), "minInstancesPerNode": ("int", 5, 100),
                 "subsamplingRate": ("float", 0.5, 1.0), "colsample": ("float", 0.5, 1.0)},
    "CatBoost": {"maxIter": ("int_step", 50, 500, 50), "stepSize": ("log", 1e-3, 0.3), "maxDepth": ("int", 3, 10),
                 "regLambda": ("log", 1e-3, 10.0)},
    "LogisticRegression": {"C": ("log", 1e-4, 1e2)},
    "Ridge": {"alpha": ("log", 1e-4, 1e3)},
}
# defaults of the three boosting libraries that the reference leaves as they are
BOOSTING_DEFAULTS = {
    "XGBoost": {"stepSize": 0.3, "maxDepth": 6, "regLambda": 1.0, "minChildWeight": 1.0},
    "LightGBM": {"stepSize": 0.1, "maxDepth": 15, "numLeaves": 31, "minInstancesPerNode": 20, "regLambda": 0.0},
    "CatBoost": {"stepSize": 0.03, "maxDepth": 6, "regLambda": 3.0},
}
# levels of a forest's trees unless told otherwise: the reference has no limit and MLlib's is 30, but
# a forest's nodes, up to 2 ** depth a tree, live in the driver
FOREST_DEPTH = 12
FOREST_ROWS = 100_000   # most training rows of MLlib's forests, a pass of which costs more per row and tree
MLP_ROWS = 100_000     # most training rows of MLlib's perceptron, a pass of which costs more per row
DEEP_FITS_AT_ONCE = 2   # of forests beyond that depth
# estimators of the search by task (lrl1: logistic regression with an L1 penalty); the two families
# without a tuning space of their own take the nearest one's
AUTOML_FAMILIES = {
    "classification": ["LightGBM", "XGBoost", "RandomForest", "LRL1", "ExtraTrees"],
    "regression": ["LightGBM", "XGBoost", "RandomForest", "ExtraTrees"],
}
AUTOML_SPACES = SEARCH_SPACES | {"LRL1": SEARCH_SPACES["LogisticRegression"], "ExtraTrees": SEARCH_SPACES["RandomForest"]}
HIDDEN_LAYERS = (256, 128, 64)
MLP_ITERATIONS = 100
MLP_EPOCHS = 50
SVC_ITERATIONS = 100
SVR_ITERATIONS = 200
SEARCH_SECONDS = 120
FIT_PARTITION_BYTES = 16 << 20
LEAST_PARTITION_BYTES = 128 << 10
FITS_AT_ONCE = 8
LARGE_FITS = ("RandomForest", "ExtraTrees", "SVM", "SVR")    # hold trees or use all task slots: one after another
FALLBACK_FAMILY = "LightGBM"
# -------------------------------------------------------------------------------------------

# Spark-native estimator used for each family name (boosting libraries -> histogram boosting with
# each library's defaults; SVM and SVR -> random Fourier features of the RBF kernel and a linear machine).
ESTIMATOR_FOR = {
    "RandomForest": "RandomForest", "ExtraTrees": "ExtraTrees",
    "XGBoost": "GradientBoosting", "LightGBM": "GradientBoosting", "CatBoost": "GradientBoosting",
    "LogisticRegression": "LogisticRegression", "LRL1": "LogisticRegression(L1)",
    "SVM": "RandomFourier+LinearSVC", "LinearSVC": "LinearSVC", "SVR": "RandomFourier+LinearSVR",
    "LinearRegression": "LinearRegression", "Ridge": "LinearRegression(ridge)", "MLP": "MultilayerPerceptron",
}


def make_estimator(name: str, task: str, features: str = "features", label: str = "label",
                   n_classes: int = 2, n_features: int | None = None, n_rows: int | None = None,
                   label_std: float | None = None, trees: int = N_TREES, max_iter: int | None = None,
                   forest_depth: int = FOREST_DEPTH, hidden: tuple[int, ...] = HIDDEN_LAYERS):
    """MOD1-MOD7: estimator for a family name.

    ``trees``: trees or boosting rounds (200); ``forest_depth``: most levels of a forest's trees;
    ``max_iter``: iterations of the linear and neural families (their own defaults if None);
    ``hidden``: hidden layer sizes of the MLP.  MLlib divides a loss by the rows, so the penalty
    C = 1 of the logistic regression and of the SVM is 1 / ``n_rows``; it also divides a
    regression's penalty by the label's deviation, so alpha = 1 of the ridge is
    ``label_std`` / ``n_rows``.  Forests of a regression see all features at a split.
    """
    kw = dict(featuresCol=features, labelCol=label)
    fam = ESTIMATOR_FOR.get(name, name)
    if fam == "GradientBoosting" and task in ("classification", "regression"):
        return GradientBoosting(task=task, maxIter=trees, seed=SEED, **BOOSTING_DEFAULTS.get(name, {}), **kw)
    if fam == "ExtraTrees" and task in ("classification", "regression"):
        return ExtraTrees(task=task, numTrees=trees, seed=SEED, maxDepth=forest_depth,
                          featureSubsetStrategy="sqrt" if task == "classification" else "all", **kw)
    if task == "classification":
        if fam == "RandomForest":
            if (n_rows or 0) > FOREST_ROWS:
                return HistogramForest(numTrees=trees, seed=SEED, maxDepth=forest_depth, featureSubsetStrategy="sqrt", **kw)
            return RandomForestClassifier(numTrees=trees, seed=SEED, maxDepth=forest_depth, cacheNodeIds=True,
                                          featureSubsetStrategy="sqrt", **kw)
        if fam.startswith("LogisticRegression"):
            return LogisticRegression(maxIter=max_iter or MAX_ITER_LR, regParam=1.0 / n_rows if n_rows else 0.0,
                                      standardization=False, elasticNetParam=1.0 if "L1" in fam else 0.0,
                                      family="multinomial", **kw)
        if fam == "RandomFourier+LinearSVC":
            return Pipeline(stages=[KernelSVC(maxIter=max_iter or SVC_ITERATIONS, seed=SEED, **kw)])
        if fam == "LinearSVC":
            svc = LinearSVC(maxIter=max_iter or SVC_ITERATIONS, regParam=1.0 / n_rows if n_rows else 0.0,
                            standardization=False, **kw)
            return OneVsRest(classifier=svc, parallelism=n_classes, **kw) if n_classes > 2 else svc
        if fam == "MultilayerPerceptron":
            if n_features is None:
                raise ValueError("MLP needs n_features")
            made = SigmoidMlp if (n_rows or 0) > MLP_ROWS else MultilayerPerceptronClassifier
            return made(layers=[n_features, *hidden, n_classes], seed=SEED, maxIter=max_iter or MLP_ITERATIONS, **kw)
    if task == "regression":
        if fam == "MultilayerPerceptron":
            return BatchNormMlp(task=task, hidden=list(hidden), seed=SEED, epochs=max_iter or MLP_EPOCHS, **kw)
        if fam == "RandomForest":
            if (n_rows or 0) > FOREST_ROWS:
                return HistogramForest(task=task, numTrees=trees, seed=SEED, maxDepth=forest_depth, featureSubsetStrategy="all", **kw)
            return RandomForestRegressor(numTrees=trees, seed=SEED, maxDepth=forest_depth, cacheNodeIds=True,
                                         featureSubsetStrategy="all", **kw)
        if fam == "RandomFourier+LinearSVR":
            return Pipeline(stages=[KernelSVR(maxIter=max_iter or SVR_ITERATIONS, seed=SEED, **kw)])
        if fam == "LinearRegression":
            return LinearRegression(solver="normal", regParam=0.0, **kw)
        if fam == "LinearRegression(ridge)":
            return LinearRegression(solver="normal", regParam=ridge_penalty(1.0, n_rows, label_std), elasticNetParam=0.0,
                                    standardization=False, **kw)
    raise ValueError(f"model {name!r} not available for task {task!r}")


def ridge_penalty(alpha: float, n_rows: int | None, label_std: float | None) -> float:
    """MLlib's regParam for the penalty alpha * |w|^2 on the sum of squared errors."""
    return alpha * label_std / n_rows if n_rows and label_std else 0.0


def available_models(task: str) -> list[str]:
    if task == "classification":
        return ["RandomForest", "XGBoost", "LightGBM", "CatBoost", "LogisticRegression", "ExtraTrees", "SVM"]
    if task == "regression":
        return ["RandomForest", "XGBoost", "LightGBM", "CatBoost", "LinearRegression", "Ridge", "ExtraTrees", "SVR"]
    raise ValueError(f"unsupported task {task!r}")


# ---- MOD10 / MOD11: rules over profile rows -------------------------------------------------

def _joined(names: list[str]) -> Column:
    return F.lit(",".join(names))


def strategy(profiles: DataFrame, choice: str | None = None) -> DataFrame:
    """MOD10: per profile row (task_type, num_rows, n_numeric, n_categorical, n_text,
    n_datetime) -> rule, models, use_automl, use_deep_learning, automl_time_budget.

    ``choice`` names a column with the user's model; where it holds one (not NULL, empty,
    'auto' or 'all'), that model alone is taken before any other rule."""
    chosen = F.lit(None).cast("string") if choice is None else F.col(choice)
    explicit = F.coalesce(~F.lower(chosen).isin(*NO_CHOICE), F.lit(False))
    total = F.greatest(F.col("n_categorical") + F.col("n_numeric") + F.col("n_text"), F.lit(1))
    cat_ratio = F.col("n_categorical") / total
    reg = F.col("task_type") == "regression"
    ts = (F.col("task_type") == "time_series") | (F.col("n_datetime") > 0)
    rule = (F.when(explicit, "explicit").when(ts, "time_series").when(F.col("n_text") > 0, "text")
            .when((cat_ratio > CATEGORICAL_SHARE) & (F.col("n_categorical") > MIN_CATEGORICAL_COLUMNS), "categorical")
            .when(F.col("num_rows") > LARGE_ROWS, "large").when(F.col("num_rows") > MEDIUM_ROWS, "medium")
            .otherwise("small"))
    models = (F.when(rule == "explicit", chosen).when(rule == "time_series", _joined(["LSTM", "GRU"]))
              .when(rule == "text", _joined(["DistilBERT", "BERT"]))
              .when(rule == "categorical", F.when(reg, _joined(["CatBoost", "LightGBM", "XGBoost"]))
                    .otherwise(_joined(["CatBoost", "LightGBM", "XGBoost", "RandomForest"])))
              .when(rule == "large", F.when(reg, _joined(["LightGBM", "XGBoost"]))
                    .otherwise(_joined(["LightGBM", "XGBoost", "RandomForest"])))
              .when(rule == "medium", F.when(reg, _joined(["LightGBM", "XGBoost", "RandomForest", "ExtraTrees", "Ridge"]))
                    .otherwise(_joined(["LightGBM", "XGBoost", "RandomForest", "ExtraTrees", "LogisticRegression"])))
              .otherwise(F.when(reg, _joined(["RandomForest", "XGBoost", "LightGBM", "Ridge", "LinearRegression", "ExtraTrees"]))
                         .otherwise(_joined(["RandomForest", "XGBoost", "LightGBM", "LogisticRegression", "ExtraTrees", "SVM"]))))
    return profiles.select(
        "*", rule.alias("rule"), models.alias("models"),
        rule.isin("large", "medium", "small").alias("use_automl"),
        (rule.isin("time_series", "text") | ((rule == "explicit") & chosen.isin(*DEEP_MODELS))).alias("use_deep_learning"),
        F.when(rule == "categorical", 60).when(rule == "large", 90).otherwise(120).alias("automl_time_budget"))


def recommend(profiles: DataFrame) -> DataFrame:
    """MOD11: candidates by (task_type, size_bucket); unknown pairs -> fallback list."""
    out = _joined(RECOMMEND_FALLBACK)
    for task, buckets in MODEL_CANDIDATES.items():
        for bucket, names in buckets.items():
            out = F.when((F.coalesce(F.col("task_type"), F.lit("classification")) == task)
                         & (F.col("size_bucket") == bucket), _joined(names)).otherwise(out)
    return profiles.select("*", out.alias("models"))


def compatibility(pairs: DataFrame, model: str = "model", task: str = "task_type") -> DataFrame:
    """EVAL6: ``compatible`` and ``warning`` of (model, task) rows.  A deep family fits the tasks
    it is made for, other families all tasks but those they are listed against; an unknown
    model is let through."""
    deep = F.create_map(*[x for m, tasks in DEEP_TASKS.items() for x in (F.lit(m), F.array(*map(F.lit, tasks)))])
    barred = F.create_map(*[x for t, models in INCOMPATIBLE.items() for x in (F.lit(t), F.array(*map(F.lit, models)))])
    made_for = F.element_at(deep, F.col(model))
    fits = (F.when(made_for.isNotNull(), F.coalesce(F.array_contains(made_for, F.col(task)), F.lit(False)))
            .otherwise(~F.coalesce(F.array_contains(F.element_at(barred, F.col(task)), F.col(model)), F.lit(False))))
    warning = F.concat_ws(" ", F.col(model), F.lit("is not designed for"), F.col(task), F.lit("tasks"))
    return pairs.select("*", fits.alias("compatible"), F.when(~fits, warning).alias("warning"))


# ---- FEAT8: preparation pipeline ------------------------------------------------------------

def build_preparation(type_rows: list, target: str, task: str, max_ohe: int = 50,
                      max_features: int = 500, select: bool = True):
    """Stages from the column classification (rows of ``classify_columns``): column recall,
    datetime parts, numeric coercion, exact scaler, category encoders (label stripping and
    mode imputation; one-hot <= 50 categories, else ordinal), TF-IDF per text column,
    assembler, non-finite -> 0, optional F-score selector."""
    from .ml_stages import (CategoryEncoder, DatetimeParts, ExactScaler, FiniteVector, FScoreSelector, KnownColumns,
                            NumericCoerce, OrdinalEncoder, QuoteStrip, SmoothTfidf)
    num = [r["column_name"] for r in type_rows if r["col_type"] == "numeric"]
    dts = [r["column_name"] for r in type_rows if r["col_type"] == "datetime"]
    cats = [r for r in type_rows if r["col_type"] == "categorical"]
    texts = [r["column_name"] for r in type_rows if r["col_type"] == "text"]
    known = num + dts + [r["column_name"] for r in cats] + texts
    if not known:
        raise ValueError("no usable feature columns remain")
    stages, vec_inputs = [KnownColumns(inputCols=known)], []
    if dts:
        stages.append(DatetimeParts(inputCols=dts))
        num += [f"{c}_{p}" for c in dts for p in ("year", "month", "day", "hour")]
    if num:
        stages.append(NumericCoerce(inputCols=num, outputCols=[f"{c}__double" for c in num]))
        stages.append(ExactScaler(inputCols=[f"{c}__double" for c in num], outputCols=[f"{c}__num" for c in num]))
        vec_inputs += [f"{c}__num" for c in num]
    if texts:
        stages.append(QuoteStrip(inputCols=texts))
    for r in cats:
        c = r["column_name"]
        encoder = CategoryEncoder if r["n_unique"] <= max_ohe else OrdinalEncoder
        stages.append(encoder(inputCol=c, outputCol=f"{c}__cat"))
        vec_inputs.append(f"{c}__cat")
    for c in texts:
        stages.append(SmoothTfidf(inputCol=c, outputCol=f"{c}__tfidf"))
        vec_inputs.append(f"{c}__tfidf")
    # every input is NULL-free by construction (imputing scaler and encoders)
    stages.append(VectorAssembler(inputCols=vec_inputs, outputCol="features_assembled"))
    stages.append(FiniteVector(inputCol="features_assembled", outputCol="features_raw" if select else "features"))
    if select:
        stages.append(FScoreSelector(inputCol="features_raw", outputCol="features", labelCol="label",
                                     k=max_features, task=task))
    return stages


def feature_names(prep: PipelineModel) -> list[str]:
    """FEAT13: a ``branch__column`` name (with the category or term, where there is one) for
    every slot of ``features``, after assembling and selecting."""
    from .ml_stages import CategoryEncoderModel, FScoreSelectorModel, OrdinalEncoderModel, SmoothTfidfModel
    slots, names = {}, []
    for stage in prep.stages:
        if isinstance(stage, CategoryEncoderModel):
            c = stage.getInputCol()
            slots[stage.getOutputCol()] = [f"cat__{c}_{v}" for v in stage.getOrDefault(stage.labels)]
        elif isinstance(stage, OrdinalEncoderModel):
            slots[stage.getOutputCol()] = [f"cat__{stage.getInputCol()}"]
        elif isinstance(stage, SmoothTfidfModel):
            slots[stage.getOutputCol()] = [f"text__{stage.getInputCol()}_{t}" for t in stage.getOrDefault(stage.vocabulary)]
        elif isinstance(stage, VectorAssembler):
            for c in stage.getInputCols():
                names += slots.get(c, [f"num__{c.removesuffix('__num')}"])
        elif isinstance(stage, FScoreSelectorModel):
            names = [names[i] for i in stage.getOrDefault(stage.indices)]
    return names


def label_stage(target: str, task: str, string_target: bool):
    """Stage (or stages) that add ``label``; a missing or unseen class gets the code after the
    last one, which training leaves out."""
    if task == "classification" and string_target:
        from .ml_stages import LabelText
        return Pipeline(stages=[
            LabelText(inputCol=target, outputCol="__label_text"),
            StringIndexer(inputCol="__label_text", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep")])
    from pyspark.ml.feature import SQLTransformer
    cast = "DOUBLE" if task == "regression" else "BIGINT"
    return SQLTransformer(statement=f"SELECT *, CAST(CAST(coalesce(`{target}`, 0) AS {cast}) AS DOUBLE) AS label FROM __THIS__")


def labelled(prepared: DataFrame) -> DataFrame:
    """Rows with a known class of a prepared training frame."""
    return prepared.where(F.col("__label_text").isNotNull()) if "__label_text" in prepared.columns else prepared


def _sizes(prepared: DataFrame, task: str) -> dict:
    """Arguments of ``make_estimator`` that depend on the training frame."""
    row = prepared.agg(F.max("label"), F.count("*"), F.stddev_pop("label")).first()
    first = prepared.select("features").first()
    return {"n_classes": int(row[0] or 0) + 1 if task == "classification" else 0, "n_rows": row[1],
            "n_features": len(first["features"]) if first else 0, "label_std": row[2]}


def packed_frame(prepared: DataFrame, sizes: dict, fits: int) -> DataFrame:
    """The frame that many fits read: checkpointed once, in as many partitions as its bytes ask
    for or as ``fits`` fits at a time need to use all task slots - a fit is hundreds of short
    jobs, and an empty task costs as much as a full one."""
    checkpoint_dir(prepared.sparkSession)
    slots = -(-2 * prepared.sparkSession.sparkContext.defaultParallelism // max(1, fits))
    size = sizes["n_rows"] * sizes["n_features"] * 8
    parts = max(1, size // FIT_PARTITION_BYTES, min(slots, size // LEAST_PARTITION_BYTES))
    return prepared.repartition(parts).checkpoint()


# ---- MOD9: train every candidate ------------------------------------------------------------

def train_all(train: DataFrame, prep_stages: list, names: list[str], task: str, label_st,
              at_once: int = FITS_AT_ONCE, errors: dict | None = None, **settings) -> dict:
    """Fit one pipeline per candidate on the frame prepared once, several at a time, but one of
    ``LARGE_FITS`` at a time: together they pass a heap that each fits into.  A family that fails
    does not stop the others; its message goes to ``errors``.  ``settings`` go to ``make_estimator``.  Returns name -> fitted PipelineModel, in the order of ``names``."""
    prep = Pipeline(stages=[label_st] + prep_stages).fit(train)
    prepared = labelled(prep.transform(train)).select("features", "label")
    # the prepared rows are written before they are counted: the preparation runs over them once
    first = prepared.first()
    ready = packed_frame(prepared, {"n_rows": train.count(), "n_features": len(first["features"]) if first else 0},
                         min(at_once, len(names)))
    sizes = _sizes(ready, task)

    large = threading.Lock()

    def fit(name):
        estimator = make_estimator(name, task, **sizes, **settings)
        with large if name in LARGE_FITS else nullcontext():
            return PipelineModel(stages=[prep, estimator.fit(ready)])

    fitted = {}
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        running = {name: pool.submit(inheritable_thread_target(train.sparkSession)(fit), name) for name in names}
        for name, future in running.items():
            try:
                fitted[name] = future.result()
            except Exception as e:  # noqa: BLE001 - one family failing must not stop the rest
                log.warning("training %s failed: %s", name, e)
                if errors is not None:
                    errors[name] = _message(e)
    return fitted


def _message(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300]


# ---- MOD12 / MOD13: search ----------------------------------------------------------------

def evaluator(task: str):
    if task == "classification":
        return MulticlassClassificationEvaluator(metricName="weightedFMeasure", labelCol="label")
    return RegressionEvaluator(metricName="r2", labelCol="label")


def sample_params(space: dict, n: int, seed: int = SEED) -> list[dict]:
    """Seeded random draws from the bounds of a search space."""
    draw = random.Random(seed)
    kinds = {
        "int": lambda low, high: draw.randint(low, high),
        "int_step": lambda low, high, step: draw.randrange(low, high + 1, step),
        "float": lambda low, high: draw.uniform(low, high),
        "log": lambda low, high: math.exp(draw.uniform(math.log(low), math.log(high))),
        "choice": lambda values: draw.choice(values),
    }
    return [{name: kinds[kind](*bounds) for name, (kind, *bounds) in space.items()} for _ in range(n)]


def with_params(estimator, params: dict, n_rows: int, label_std: float | None = None):
    """A copy of the estimator with the drawn parameters, set on the inner classifier of a
    one-vs-rest estimator; ``C`` is 1 / (rows * regParam), ``alpha`` the ridge's penalty, and a
    node of ``minInstancesPerSplit`` rows is split if each half keeps half of them or
    ``minInstancesPerNode``, whichever is more (MLlib bounds children only)."""
    values = dict(params)
    if "C" in values:
        values["regParam"] = 1.0 / (values.pop("C") * n_rows)
    if "alpha" in values:
        values["regParam"] = ridge_penalty(values.pop("alpha"), n_rows, label_std)
    if "minInstancesPerSplit" in values:
        least = values.pop("minInstancesPerSplit") // 2
        values["minInstancesPerNode"] = max(values.get("minInstancesPerNode", 1), least)
    inner = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    unknown = [p for p in values if not inner.hasParam(p)]
    if unknown:
        raise ValueError(f"{type(inner).__name__} has no parameter {unknown}")
    changed = inner.copy({inner.getParam(p): v for p, v in values.items()})
    if isinstance(estimator, OneVsRest):
        return estimator.copy().setClassifier(changed)
    return changed


def draw_cost(params: dict) -> float:
    """How long a draw's fit takes compared with others of its family: trees times levels."""
    return params.get("numTrees", params.get("maxIter", 1)) * params.get("maxDepth", 1)


class _Trials:
    """The fits of a search: draws of each family, each over all folds, run by a bounded pool."""

    def __init__(self, frame: DataFrame, task: str, sizes: dict, folds: int, fits: int, settings: dict):
        self.spark, self.task, self.sizes, self.settings = frame.sparkSession, task, sizes, settings
        self.measure = evaluator(task)
        checkpoint_dir(self.spark)
        place = F.pmod(F.xxhash64("features", "label", F.lit(SEED)), F.lit(folds))
        # drawn once: every fit reads the same folds
        whole = packed_frame(frame.select("features", "label").withColumn("fold", place), sizes, fits)
        self.folds = [(whole.where(F.col("fold") != k), whole.where(F.col("fold") == k)) for k in range(folds)]
        self.names = itertools.count()
        self.groups: set[str] = set()
        self.lock, self.over = threading.Lock(), False
        self.deep = threading.Semaphore(DEEP_FITS_AT_ONCE)

    def metric(self, name: str, params: dict, fold: int, may_stop: bool) -> float:
        """Fit a draw without one fold and measure it there, as one job group; fits that
        ``may_stop`` are cancelled with the budget."""
        context, group = self.spark.sparkContext, f"search-{id(self)}-{next(self.names)}"
        with self.lock:
            if may_stop and self.over:
                raise TimeoutError("budget reached")
            if may_stop:
                self.groups.add(group)
        context.setJobGroup(group, f"{name} {params} without fold {fold}", interruptOnCancel=True)
        try:
            train, test = self.folds[fold]
            estimator = with_params(make_estimator(name, self.task, **self.sizes, **self.settings), params,
                                    self.sizes["n_rows"], self.sizes["label_std"])
            deep = "numTrees" in params and params.get("maxDepth", 0) > FOREST_DEPTH
            with self.deep if deep else contextlib.nullcontext():
                return float(self.measure.evaluate(estimator.fit(train).transform(test)))
        finally:
            with self.lock:
                self.groups.discard(group)

    def stop(self) -> None:
        """End the running fits that may be stopped, and start no more of them."""
        with self.lock:
            self.over, running = True, list(self.groups)
        for group in running:
            self.spark.sparkContext.cancelJobGroup(group)


def search(train: DataFrame, test: DataFrame, task: str, names: list[str], trials: int = TUNE_TRIALS,
           folds: int = CV_FOLDS, seconds: float | None = SEARCH_SECONDS, parallelism: int = FITS_AT_ONCE,
           spaces: dict = SEARCH_SPACES, **settings) -> tuple[DataFrame, object]:
    """MOD12/MOD13 over prepared (features, label) frames: up to ``trials`` seeded draws per
    family, cross-validated over folds that are drawn once; ``parallelism`` fits run at a time.

    ``seconds`` is the search's budget.  Draws then go from the cheapest to the dearest, families
    take turns, and when the time is up the running fits are cancelled; only the first draw of
    each family always ends, so that none is left out, and the best draw of all is refitted.  How
    many draws end depends on the machine: ``budget_reached`` and ``trials`` say it.  With None,
    as for tuning, all draws run and the best of every family is refitted.

    Returns (leaderboard of model, trials, failed, budget_reached, cv_metric, test_metric, params,
    is_best, error; best fitted model by cross-validation).  A family all of whose draws fail is
    a row with its error.  If every family fails, the fallback family is fitted with its defaults
    and has no cv_metric.
    """
    began = time.monotonic()
    sizes = _sizes(train, task)
    run = _Trials(train, task, sizes, folds, 2 * parallelism, settings)
    draws = {name: sample_params(spaces.get(name, {}), trials if name in spaces else 1) for name in names}
    if seconds is not None:
        draws = {name: sorted(of, key=draw_cost) for name, of in draws.items()}
    waiting = [(turn, name, fold) for turn in range(trials) for name in names if turn < len(draws[name]) for fold in range(folds)]
    got: dict[tuple[str, int], list[float]] = {}
    failed: dict[tuple[str, int], str] = {}
    cut = False
    def threaded(fn):
        # for each call anew: the threads of one wrapper would share one set of local properties
        return inheritable_thread_target(run.spark)(fn)

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        running: dict = {}
        while waiting or running:
            late = seconds is not None and time.monotonic() - began > seconds
            if late and not run.over:
                run.stop()
                cut = any(turn for turn, *_ in [*waiting, *running.values()])
                waiting = [w for w in waiting if not w[0]]
            while waiting and len(running) < parallelism:
                turn, name, fold = waiting.pop(0)
                if (name, turn) not in failed:
                    running[pool.submit(threaded(run.metric), name, draws[name][turn], fold, turn > 0)] = (turn, name, fold)
            left = None if seconds is None or run.over else max(0.05, seconds - (time.monotonic() - began))
            done, _ = wait(running, timeout=left, return_when=FIRST_COMPLETED)
            for future in done:
                turn, name, fold = running.pop(future)
                try:
                    got.setdefault((name, turn), []).append(future.result())
                except Exception as e:  # noqa: BLE001 - one family failing must not stop the rest
                    if not (run.over and turn):
                        log.warning("trial %d of %s failed: %s", turn, name, e)
                        failed[name, turn] = _message(e)
    # a draw counts when all its folds are measured; ties go to the draw first tried
    score = {key: sum(m) / folds for key, m in got.items() if len(m) == folds}
    best = {name: max(((m, -turn) for (n, turn), m in score.items() if n == name), default=None) for name in names}
    found = [name for name in names if best[name]]
    winner = max(found, key=lambda name: best[name][0]) if found else FALLBACK_FAMILY

    def refit(name):
        estimator = make_estimator(name, task, **sizes, **settings)
        if best.get(name):
            estimator = with_params(estimator, draws[name][-best[name][1]], sizes["n_rows"], sizes["label_std"])
        model = estimator.fit(train)
        return model, float(run.measure.evaluate(model.transform(test)))

    refitted = (found or [winner]) if seconds is None else [winner]
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        fits = {name: pool.submit(threaded(refit), name) for name in refitted}
        models = {name: future.result() for name, future in fits.items()}
    rows = []
    for name in [*names, *([] if found else [winner])]:
        of = best.get(name)
        errors = [m for (n, _), m in sorted(failed.items()) if n == name]
        rows.append((name, sum(n == name for n, _ in score), len(errors), cut, of[0] if of else None,
                     models[name][1] if name in models else None, str(draws[name][-of[1]]) if of else "{}",
                     name == winner, errors[0] if errors else None))
    board = train.sparkSession.createDataFrame(
        rows, "model string, trials int, failed int, budget_reached boolean, cv_metric double, test_metric double, "
              "params string, is_best boolean, error string")
    return board, models[winner][0]


# ---- MOD14: batch scoring -------------------------------------------------------------------

def batch_score(model: PipelineModel, df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Predicted label, its probability and per-class probabilities (classification)."""
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")
        out = out.withColumn("probabilities", p).withColumn("confidence", F.array_max(p))
    if labels:
        lab = F.array(*[F.lit(x) for x in labels])
        out = out.withColumn("predicted_label", F.element_at(lab, F.col("prediction").cast("int") + 1))
    return out
