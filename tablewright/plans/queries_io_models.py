"""Checked queries for sources/sinks (SRC*, SNK*) and models (MOD*, FEAT8/11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coltypes as TY
from ..operators import evaluate as EV
from ..operators import models as M
from ..operators import profile as P
from ..operators import split as SP
from ..session import scratch_path
from ..sources import readers as R
from ..sources import sinks as S
from ..functions.columns import sql_guarded_double, sql_strip_label
from ..operators.ml_stages import validate_numeric
from .derived import DIRTY_FEATURES_SQL, dirty_features, table
from . import queries_eval, queries_features, queries_profile  # noqa: F401 (their SQL is reused below)
from .registry import ORACLE, query
from .sqlgen import TABLE_COLUMNS, families_sql

TS_FMT_SPARK, TS_FMT_SQL = "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"


# ---- sources ---------------------------------------------------------------------------------

@query("src_parquet_scan", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '{TS_FMT_SQL}') AS o_orderdate,
       o_orderpriority FROM orders""")
def src_parquet_scan(spark, d):
    df = R.read_any(spark, f"{d.rstrip('/')}/orders.parquet")
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", TS_FMT_SPARK))


_SEPS = [("comma", ","), ("tab", "\t"), ("semicolon", ";"), ("pipe", "|")]


@query("src_csv_sniff_roundtrip", "\nUNION ALL\n".join(
    f"SELECT '{lab}' AS sep, n_nationkey, n_name, n_regionkey FROM nation" for lab, _ in _SEPS))
def src_csv_sniff_roundtrip(spark, d):
    nation = table(spark, d, "nation")
    out = None
    for lab, sep in _SEPS:
        path = scratch_path(spark, f"nation_{lab}") + ".csv"
        nation.write.mode("overwrite").csv(path, sep=sep, header=True)
        back = R.read_any(spark, path).select(F.lit(lab).alias("sep"), "n_nationkey", "n_name", "n_regionkey")
        out = back if out is None else out.unionByName(back)
    return out


@query("src_json_roundtrip", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def src_json_roundtrip(spark, d):
    path = scratch_path(spark, "region") + ".json"
    table(spark, d, "region").write.mode("overwrite").json(path)
    return R.read_any(spark, path).select("r_regionkey", "r_name")


@query("src_headerless_data", """
SELECT s_suppkey AS col_0, s_name AS col_1, s_nationkey AS col_2, s_acctbal AS "class" FROM supplier""")
def src_headerless_data(spark, d):
    path = scratch_path(spark, "supplier") + ".data"
    table(spark, d, "supplier").write.mode("overwrite").csv(path, header=False)
    return R.read_any(spark, path)


def _write_arff(spark, part, path):
    header = "\n".join([
        "% synthetic ARFF written from the part table",
        "@relation part",
        "",
        "@attribute p_partkey numeric",
        "@attribute 'p_name' string",
        "@attribute p_brand string",
        "@attribute p_type {ECONOMY,STANDARD,LARGE,SMALL,MEDIUM,PROMO}",
        "@attribute \"p_size\" numeric",
        "@attribute p_retailprice real",
        "% data follows",
        "@data",
    ])
    spark.range(1).select(F.lit(header).alias("value")).write.mode("overwrite").text(f"{path}/0_header")
    size = F.when(F.col("p_partkey") % 9 == 0, F.lit("?")).otherwise(F.col("p_size").cast("string"))
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit("'"), "p_name", F.lit("'")),
                       "p_brand", "p_type", size, F.col("p_retailprice").cast("string"))
    part.select(line.alias("value")).write.mode("overwrite").text(f"{path}/1_data")


@query("src_arff", """
SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, p_name, p_brand, p_type,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS p_size,
       CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part""")
def src_arff(spark, d):
    path = scratch_path(spark, "part") + ".arff"
    _write_arff(spark, table(spark, d, "part"), path)
    return R.read_any(spark, path)


def _lines(spark, lines, path):
    """Write (order, value) rows as one text file, in order."""
    lines.coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)


@query("src_csv_quoted", """
SELECT n_nationkey AS k, n_name || ', "x"' || chr(10) || 'second line' AS name FROM nation""")
def src_csv_quoted(spark, d):
    """A separator inside a quoted header and fields, doubled quotes, line breaks in fields."""
    nation = table(spark, d, "nation")
    value = F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit('";"'), "n_name", F.lit(', ""x""\nsecond line"'))
    head = nation.limit(1).select(F.lit(-1).cast("long").alias("o"), F.lit('"key, k";"the name"').alias("value"))
    path = scratch_path(spark, "quoted") + ".csv"
    _lines(spark, head.unionByName(nation.select(F.col("n_nationkey").cast("long").alias("o"), value.alias("value"))), path)
    out = R.read_any(spark, path)
    if out.columns != ["key, k", "the name"]:
        raise ValueError(f"header was read as {out.columns}")
    return out.toDF("k", "name")


@query("src_csv_other_separator", "SELECT r_regionkey AS key, r_name AS name FROM region")
def src_csv_other_separator(spark, d):
    region = table(spark, d, "region")
    path = scratch_path(spark, "colon") + ".csv"
    head = region.limit(1).select(F.lit(-1).cast("long").alias("o"), F.lit("key:name").alias("value"))
    rows = region.select(F.col("r_regionkey").cast("long").alias("o"),
                         F.concat_ws(":", F.col("r_regionkey").cast("string"), "r_name").alias("value"))
    _lines(spark, head.unionByName(rows), path)
    return R.read_any(spark, path)


@query("src_data_whitespace", """
SELECT CAST(s_suppkey AS DOUBLE) AS "0", s_name AS "1", CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_nationkey AS DOUBLE) END AS "2"
FROM supplier""")
def src_data_whitespace(spark, d):
    """Ragged rows: every third has no last field."""
    supplier = table(spark, d, "supplier")
    line = F.concat(F.lit("  "), F.col("s_suppkey").cast("string"), F.lit("\t "), "s_name",
                    F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("   "), F.col("s_nationkey").cast("string"))).otherwise(""))
    path = scratch_path(spark, "ragged") + ".data"
    supplier.select(line.alias("value")).write.mode("overwrite").text(path)
    return R.read_any(spark, path)


@query("src_arff_sections", """
SELECT CAST(p_partkey AS DOUBLE) AS "part key", CASE WHEN p_partkey % 5 = 0 THEN '@data ' ELSE '' END || p_name || ', x' AS name,
       p_brand AS brand FROM part""")
def src_arff_sections(spark, d):
    """Free text before '@data', data rows that start with '@', commas in either kind of quotes."""
    part = table(spark, d, "part")
    head = ["a free line", "@RELATION parts", "% a comment", "@attribute 'part key' numeric", "@Attribute name string",
            '@attribute "brand" string', "", "@DATA"]
    at = F.when(F.col("p_partkey") % 5 == 0, "@data ").otherwise("")
    quoted = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("'"), at, "p_name", F.lit(", x'"))).otherwise(
        F.concat(F.lit('"'), at, "p_name", F.lit(', x"')))
    rows = part.select(F.col("p_partkey").cast("long").alias("o"),
                       F.concat(F.col("p_partkey").cast("string"), F.lit(" , "), quoted, F.lit(","), "p_brand").alias("value"))
    lines = part.limit(1).select(F.posexplode(F.array(*map(F.lit, head))).alias("o", "value")).withColumn("o", F.col("o") - 100)
    path = scratch_path(spark, "sections") + ".arff"
    _lines(spark, lines.withColumn("o", F.col("o").cast("long")).unionByName(rows), path)
    return R.read_any(spark, path)


@query("sample_exact_n", """
SELECT o_orderkey FROM orders ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')) LIMIT 1000""")
def sample_exact_n(spark, d):
    return SP.sample_exact(table(spark, d, "orders").select("o_orderkey"), 1000, ["o_orderkey"])


# ---- sinks -----------------------------------------------------------------------------------

_IDEA = "predict the return flag"
_FILES = {"model_path": "models/best", "pipeline_path": "models/prep"}
_RANKED = "rank, model, round(f1_score, 4) AS f1_score, round(accuracy, 4) AS accuracy"
_PROFILE_COLUMNS = ["num_rows", "num_features", "numeric_columns", "categorical_columns", "datetime_columns", "text_columns",
                    "missing_value_ratio", "duplicate_row_ratio", "size_bucket"]


def _report_sql() -> str:
    parts = [f"SELECT 'idea' AS section, 'text' AS key, '{_IDEA}' AS value"]
    parts += [f"SELECT 'exported files', '{k}', '{v}'" for k, v in _FILES.items()]
    parts += [f"SELECT 'dataset profile', '{c}', CAST({c} AS VARCHAR) FROM p" for c in _PROFILE_COLUMNS]
    parts += [f"SELECT 'leaderboard', rank || '. ' || model || ': {m}', CAST({m} AS VARCHAR) FROM l" for m in ("f1_score", "accuracy")]
    parts.append("SELECT 'best model', model, CAST(f1_score AS VARCHAR) FROM l WHERE rank = 1")
    return _run_tables_sql() + "\nUNION ALL ".join(parts)


def _run_tables_sql() -> str:
    return f"WITH p AS ({ORACLE['profile_dataset']}), l AS (SELECT {_RANKED} FROM ({ORACLE['eval_leaderboard']})) "


def _run_tables(spark, d):
    board = queries_eval.eval_leaderboard(spark, d).select(
        "rank", "model", F.round("f1_score", 4).alias("f1_score"), F.round("accuracy", 4).alias("accuracy"))
    return queries_profile.profile_dataset(spark, d), board


@query("snk_report", _report_sql())
def snk_report(spark, d):
    profile, board = _run_tables(spark, d)
    path = scratch_path(spark, "report")
    S.write_report(S.training_report(_IDEA, profile, board, _FILES), path)
    return spark.read.json(path)


@query("snk_run_record", _run_tables_sql() + f"""
SELECT model AS best_model_name, to_json({{'f1_score': f1_score, 'accuracy': accuracy}}) AS metrics,
       (SELECT quality_score FROM ({ORACLE['quality_report']})) AS quality_score, (SELECT num_rows FROM p) AS rows_trained_on,
       'train' AS mode_used, 'lineitem' AS dataset_used, 'classification' AS task_type, 'l_returnflag' AS target_column,
       '{_FILES["model_path"]}' AS model_path, '{_FILES["pipeline_path"]}' AS pipeline_path, 'l_quantity' AS feature_columns
FROM l WHERE rank = 1""")
def snk_run_record(spark, d):
    profile, board = _run_tables(spark, d)
    row = S.run_record(queries_profile.quality_report(spark, d), profile, board, _FILES, "train", "lineitem",
                       "classification", "l_returnflag", ["l_quantity"])
    return row.withColumn("feature_columns", F.array_join("feature_columns", ","))


# ---- models ----------------------------------------------------------------------------------

def _prepared_orders(spark, d, target="o_orderstatus", task="classification"):
    orders = table(spark, d, "orders")
    from ..session import checkpoint_dir
    checkpoint_dir(spark)
    split = SP.train_test_split(orders, ["o_orderkey"], label="o_orderstatus").checkpoint()
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    types = TY.classify_columns(train.drop("split"), target).collect()
    stages = M.build_preparation(types, target, task)
    lab = M.label_stage(target, task, string_target=task == "classification")
    return train, test, stages, lab


def _fit_one(spark, d, name):
    train, test, stages, lab = _prepared_orders(spark, d)
    fitted = M.train_all(train, stages, [name], "classification", lab)
    model = fitted[name]
    return model.transform(test).select("o_orderkey", "o_orderstatus", "label", "prediction")


for _name, _key in [("RandomForest", "model_random_forest"), ("ExtraTrees", "model_extra_trees_like"),
                    ("XGBoost", "model_gbt"), ("LogisticRegression", "model_logistic"),
                    ("LinearSVC", "model_linear_svc"), ("SVM", "model_svm_rbf"), ("MLP", "model_mlp")]:
    def _mk(name):
        def build(spark, d):
            return _fit_one(spark, d, name)
        build.__name__ = f"build_{name}"
        return build
    query(_key)(_mk(_name))


@query("model_linear_regression", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def model_linear_regression(spark, d):
    from pyspark.ml.feature import VectorAssembler
    li = table(spark, d, "lineitem")
    data = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        li.withColumn("label", F.col("l_extendedprice")))
    m = M.make_estimator("LinearRegression", "regression").fit(data)
    return spark.range(1).select(F.round(F.lit(float(m.coefficients[0])), 4).alias("slope"),
                                 F.round(F.lit(float(m.intercept)), 4).alias("intercept"))


def _train_board(spark, d, names, target="o_orderstatus", task="classification"):
    """Metrics of each family's model on the test rows, ranked; a family that failed is a row
    with its error."""
    from pyspark.ml import PipelineModel
    train, test, stages, lab = _prepared_orders(spark, d, target, task)
    errors = {}
    fitted = M.train_all(train, stages, names, task, lab, errors=errors)
    measure, by = (EV.classification_metrics, "f1_score") if task == "classification" else (EV.regression_metrics, "r2")
    # the preparation is the same for all: the test rows pass it once
    held = None
    res = None
    for i, (name, model) in enumerate(fitted.items()):
        if held is None:
            held = M.labelled(model.stages[0].transform(test)).select("features", "label").checkpoint()
        m = measure(PipelineModel(stages=model.stages[1:]).transform(held), "label", "prediction").select(
            F.lit(name).alias("model"), F.lit(i).alias("model_order"), "*")
        res = m if res is None else res.unionByName(m)
    if res is None:
        raise ValueError(f"no family could be trained: {errors}")
    board = EV.leaderboard(res, by).withColumn("error", F.lit(None).cast("string"))
    lost = spark.createDataFrame(list(errors.items()), "model string, error string")
    return board.unionByName(lost, allowMissingColumns=True)


@query("model_gbt_regression")
def model_gbt_regression(spark, d):
    """200 boosting rounds on the order price."""
    train, test, stages, lab = _prepared_orders(spark, d, "o_totalprice", "regression")
    fitted = M.train_all(train, stages, ["XGBoost"], "regression", lab)
    return fitted["XGBoost"].transform(test).select("o_orderkey", "label", "prediction")


@query("model_svr")
def model_svr(spark, d):
    """Support vector regression with the RBF kernel on the order price."""
    train, test, stages, lab = _prepared_orders(spark, d, "o_totalprice", "regression")
    fitted = M.train_all(train, stages, ["SVR"], "regression", lab)
    return fitted["SVR"].transform(test).select("o_orderkey", "label", "prediction")


@query("model_mlp_regression")
def model_mlp_regression(spark, d):
    """Perceptron with batch normalisation and GELU on the order price."""
    train, test, stages, lab = _prepared_orders(spark, d, "o_totalprice", "regression")
    fitted = M.train_all(train, stages, ["MLP"], "regression", lab)
    return fitted["MLP"].transform(test).select("o_orderkey", "label", "prediction")


@query("model_train_all")
def model_train_all(spark, d):
    """Every distinct classification estimator (the three boosting names share one), ranked."""
    return _train_board(spark, d, ["RandomForest", "XGBoost", "LogisticRegression", "ExtraTrees", "SVM", "MLP"])


@query("model_train_all_regression")
def model_train_all_regression(spark, d):
    """Every distinct regression estimator (the three boosting names share one), ranked."""
    names = ["RandomForest", "XGBoost", "LinearRegression", "Ridge", "ExtraTrees", "SVR"]
    return _train_board(spark, d, names, "o_totalprice", "regression")


_STRAT_TABLES = [("orders", "o_orderstatus"), ("lineitem", "l_extendedprice"), ("documents", "lang"),
                 ("events", "event_type"), ("customer", "c_mktsegment"), ("part", "p_size")]


def _profile_rows(spark, d):
    out = None
    for t, target in _STRAT_TABLES:
        df = table(spark, d, t)
        fam = P.analyzer_family(P.column_profile(df, distinct=False))
        task = TY.detect_task(df, target).select("task_type")
        agg = fam.agg(F.max("n_rows").alias("num_rows"),
                      F.count_if(F.col("family") == "numeric").alias("n_numeric"),
                      F.count_if(F.col("family") == "categorical").alias("n_categorical"),
                      F.count_if(F.col("family") == "text").alias("n_text"),
                      F.count_if(F.col("family") == "datetime").alias("n_datetime"))
        row = P.attach(agg, task).select(F.lit(t).alias("table_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def _profile_rows_sql() -> str:
    parts = []
    for t, target in _STRAT_TABLES:
        base = dict(TABLE_COLUMNS[t])[target]
        task = ("'time_series'" if base == "datetime" else
                f"(SELECT CASE WHEN count(DISTINCT {target}) > 20 THEN 'regression' ELSE 'classification' END FROM {t})"
                if base == "numeric" else "'classification'")
        parts.append(f"""
SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS num_rows,
  count(*) FILTER (WHERE family = 'numeric') AS n_numeric, count(*) FILTER (WHERE family = 'categorical') AS n_categorical,
  count(*) FILTER (WHERE family = 'text') AS n_text, count(*) FILTER (WHERE family = 'datetime') AS n_datetime,
  {task} AS task_type
FROM ({families_sql(t, TABLE_COLUMNS[t])})""")
    return "\nUNION ALL\n".join(parts)


def _strategy_sql() -> str:
    def j(xs):
        return "'" + ",".join(xs) + "'"
    return f"""
WITH p AS ({_profile_rows_sql()}),
r AS (SELECT *, CASE WHEN task_type = 'time_series' OR n_datetime > 0 THEN 'time_series'
        WHEN n_text > 0 THEN 'text'
        WHEN n_categorical / greatest(n_categorical + n_numeric + n_text, 1) > 0.4 AND n_categorical > 3 THEN 'categorical'
        WHEN num_rows > 100000 THEN 'large' WHEN num_rows > 10000 THEN 'medium' ELSE 'small' END AS rule FROM p)
SELECT table_name, task_type, rule,
  CASE rule WHEN 'time_series' THEN {j(['LSTM', 'GRU'])} WHEN 'text' THEN {j(['DistilBERT', 'BERT'])}
    WHEN 'categorical' THEN CASE WHEN task_type = 'regression' THEN {j(['CatBoost', 'LightGBM', 'XGBoost'])}
                                 ELSE {j(['CatBoost', 'LightGBM', 'XGBoost', 'RandomForest'])} END
    WHEN 'large' THEN CASE WHEN task_type = 'regression' THEN {j(['LightGBM', 'XGBoost'])}
                           ELSE {j(['LightGBM', 'XGBoost', 'RandomForest'])} END
    WHEN 'medium' THEN CASE WHEN task_type = 'regression' THEN {j(['LightGBM', 'XGBoost', 'RandomForest', 'ExtraTrees', 'Ridge'])}
                            ELSE {j(['LightGBM', 'XGBoost', 'RandomForest', 'ExtraTrees', 'LogisticRegression'])} END
    ELSE CASE WHEN task_type = 'regression' THEN {j(['RandomForest', 'XGBoost', 'LightGBM', 'Ridge', 'LinearRegression', 'ExtraTrees'])}
              ELSE {j(['RandomForest', 'XGBoost', 'LightGBM', 'LogisticRegression', 'ExtraTrees', 'SVM'])} END END AS models,
  rule IN ('large', 'medium', 'small') AS use_automl, rule IN ('time_series', 'text') AS use_deep_learning,
  CASE rule WHEN 'categorical' THEN 60 WHEN 'large' THEN 90 ELSE 120 END AS automl_time_budget
FROM r"""


@query("model_strategy", _strategy_sql())
def model_strategy(spark, d):
    return M.strategy(_profile_rows(spark, d)).select(
        "table_name", "task_type", "rule", "models", "use_automl", "use_deep_learning", "automl_time_budget")


def _recommend_sql() -> str:
    cases = " ".join(f"WHEN task_type = '{t}' AND size_bucket = '{b}' THEN '{','.join(ns)}'"
                     for t, bs in M.MODEL_CANDIDATES.items() for b, ns in bs.items())
    return f"""
WITH p AS ({_profile_rows_sql()})
SELECT table_name, task_type,
  CASE WHEN num_rows < 50000 THEN 'small' WHEN num_rows < 500000 THEN 'medium' ELSE 'large' END AS size_bucket,
  CASE {cases.replace('size_bucket', "CASE WHEN num_rows < 50000 THEN 'small' WHEN num_rows < 500000 THEN 'medium' ELSE 'large' END")}
       ELSE '{','.join(M.RECOMMEND_FALLBACK)}' END AS models
FROM p"""


@query("model_recommend", _recommend_sql())
def model_recommend(spark, d):
    rows = _profile_rows(spark, d).withColumn("size_bucket", P.size_bucket(F.col("num_rows")))
    return M.recommend(rows).select("table_name", "task_type", "size_bucket", "models")


def _search(spark, d, names, target="o_orderstatus", task="classification", **limits):
    from pyspark.ml import Pipeline
    train, test, stages, lab = _prepared_orders(spark, d, target, task)
    prep = Pipeline(stages=[lab] + stages).fit(train)
    ready, held = (M.labelled(prep.transform(x)).select("features", "label").checkpoint() for x in (train, test))
    board, _ = M.search(ready, held, task, names, **limits)
    return board.select(F.lit(task).alias("task_type"), "*")


@query("model_automl_search")
def model_automl_search(spark, d):
    """The reference's five classification estimators within its time budget."""
    return _search(spark, d, M.AUTOML_FAMILIES["classification"], spaces=M.AUTOML_SPACES)


@query("model_tune")
def model_tune(spark, d):
    """All six search spaces: the classifiers' on the order status, Ridge's on the order price;
    every draw runs, however long it takes, so a seed gives the same trials at any size."""
    names = [n for n in M.SEARCH_SPACES if n in M.available_models("classification")]
    rest = [n for n in M.SEARCH_SPACES if n not in names]
    return _search(spark, d, names, seconds=None).unionByName(
        _search(spark, d, rest, "o_totalprice", "regression", seconds=None))


_PAIR_MODELS = list(dict.fromkeys([*M.DEEP_TASKS, *[m for ms in M.INCOMPATIBLE.values() for m in ms], "ExtraTrees"]))


def _compatibility_sql() -> str:
    deep = ", ".join(f"('{m}', '{t}')" for m, ts in M.DEEP_TASKS.items() for t in ts)
    barred = ", ".join(f"('{m}', '{t}')" for t, ms in M.INCOMPATIBLE.items() for m in ms)
    models = ", ".join(f"('{m}')" for m in _PAIR_MODELS)
    return f"""
WITH t AS (SELECT DISTINCT task_type FROM ({_profile_rows_sql()}) UNION SELECT unnest(['nlp', 'time_series', 'computer_vision'])),
deep AS (SELECT * FROM (VALUES {deep}) AS v(m, t)), barred AS (SELECT * FROM (VALUES {barred}) AS v(m, t)),
p AS (SELECT m.model, t.task_type,
        CASE WHEN model IN (SELECT m FROM deep) THEN EXISTS (SELECT 1 FROM deep d WHERE d.m = model AND d.t = task_type)
             ELSE NOT EXISTS (SELECT 1 FROM barred b WHERE b.m = model AND b.t = task_type) END AS compatible
      FROM (VALUES {models}) AS m(model), t)
SELECT model, task_type, compatible,
       CASE WHEN NOT compatible THEN model || ' is not designed for ' || task_type || ' tasks' END AS warning FROM p"""


@query("eval_compatibility", _compatibility_sql())
def eval_compatibility(spark, d):
    """Every model name against the tasks found in the tables and the three that need other data."""
    found = _profile_rows(spark, d).select("task_type")
    more = found.limit(1).select(F.explode(F.array(*map(F.lit, ["nlp", "time_series", "computer_vision"]))).alias("task_type"))
    tasks = found.unionByName(more).distinct()
    return M.compatibility(tasks.select(F.explode(F.array(*map(F.lit, _PAIR_MODELS))).alias("model"), "task_type"))


@query("model_strategy_choice", f"""
WITH p AS ({_profile_rows_sql()})
SELECT table_name, CASE table_name WHEN 'orders' THEN 'SVM' WHEN 'lineitem' THEN 'GRU' END AS models,
       table_name = 'lineitem' AS use_deep_learning, false AS use_automl
FROM p WHERE table_name IN ('orders', 'lineitem')""")
def model_strategy_choice(spark, d):
    """MOD10 with the user's choice: a named model wins over every other rule, 'Auto' does not."""
    chosen = F.when(F.col("table_name") == "orders", "SVM").when(F.col("table_name") == "lineitem", "GRU").otherwise("Auto")
    out = M.strategy(_profile_rows(spark, d).withColumn("choice", chosen), "choice")
    return out.where(F.col("rule") == "explicit").select("table_name", "models", "use_deep_learning", "use_automl")


_TEST_ROWS_SQL = f"(SELECT * FROM ({ORACLE['feat_split_stratified']}) WHERE split = 'test')"


@query("model_batch_score", f"SELECT o_orderkey, true AS known_label, true AS sums_to_one, true AS confident FROM {_TEST_ROWS_SQL}")
def model_batch_score(spark, d):
    """Facts of the scored rows that hold for any model: the label is one of the classes, the
    probabilities sum to one, and the confidence is the largest of them."""
    train, test, stages, lab = _prepared_orders(spark, d)
    fitted = M.train_all(train, stages, ["RandomForest"], "classification", lab)
    labels = sorted(r[0] for r in train.select("o_orderstatus").distinct().collect())
    scored = M.batch_score(fitted["RandomForest"], test, labels)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    return scored.select("o_orderkey", F.col("predicted_label").isin(*labels).alias("known_label"),
                         (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
                         (F.col("confidence") == F.array_max("probabilities")).alias("confident"))


@query("feat_pipeline_fit_transform", f"""
SELECT t.o_orderkey, c.label, true AS has_features FROM {_TEST_ROWS_SQL} t
JOIN (SELECT o_orderstatus, CAST(row_number() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS label
      FROM (SELECT DISTINCT o_orderstatus FROM orders)) c USING (o_orderstatus)""")
def feat_pipeline_fit_transform(spark, d):
    train, test, stages, lab = _prepared_orders(spark, d)
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    model = Pipeline(stages=[lab] + stages).fit(train)
    return model.transform(test).select("o_orderkey", "label", (F.size(vector_to_array("features")) > 0).alias("has_features"))


def _dirty_sql(rows: str, custkey: str) -> str:
    """Long-form features of the dirty orders: statistics of the training rows, the given rows
    transformed, with the customer number as ``custkey`` has it."""
    return f"""
WITH n AS (SELECT o_orderkey, {sql_guarded_double('price')} AS p, CASE WHEN isfinite(custkey) THEN custkey END AS c,
                  {sql_strip_label('priority')} AS pr FROM {DIRTY_FEATURES_SQL}),
tr AS (SELECT * FROM n WHERE o_orderkey % 4 <> 0),
f AS (SELECT median(p) AS mp, median(c) AS mc, (SELECT pr FROM tr WHERE pr IS NOT NULL GROUP BY pr
             ORDER BY count(*) DESC, pr LIMIT 1) AS fill FROM tr),
z AS (SELECT avg(coalesce(p, mp)) AS ap, stddev_pop(coalesce(p, mp)) AS sp,
             avg(coalesce(c, mc)) AS ac, stddev_pop(coalesce(c, mc)) AS sc FROM tr, f),
lab AS (SELECT DISTINCT coalesce(pr, fill) AS v FROM tr, f),
x AS (SELECT o_orderkey, coalesce(p, mp) AS p, coalesce({custkey}, mc) AS c, coalesce(pr, fill) AS pr FROM n, f WHERE {rows})
SELECT o_orderkey, 'num__price' AS feature, round((p - ap) / sp, 6) AS value FROM x, z
UNION ALL SELECT o_orderkey, 'num__custkey', round((c - ac) / sc, 6) FROM x, z
UNION ALL SELECT o_orderkey, 'cat__priority_' || v, CASE WHEN pr = v THEN 1.0 ELSE 0.0 END FROM x, lab"""


def _dirty_pipeline(spark, d):
    from pyspark.ml import Pipeline
    rows = dirty_features(table(spark, d, "orders"))
    types = [{"column_name": c, "col_type": t, "n_unique": n} for c, t, n in
             (("price", "numeric", 0), ("custkey", "numeric", 0), ("priority", "categorical", 6))]
    prep = Pipeline(stages=M.build_preparation(types, "o_orderkey", "regression", select=False))
    return prep.fit(rows.where("o_orderkey % 4 <> 0")), rows


def _long_features(model, rows):
    from pyspark.ml.functions import vector_to_array
    out = model.transform(rows)
    validate_numeric(out, ["features"])
    slots = F.arrays_zip(F.array(*map(F.lit, M.feature_names(model))).alias("feature"), vector_to_array("features").alias("value"))
    return out.select("o_orderkey", F.inline(slots)).withColumn("value", F.round("value", 6))


@query("feat_pipeline_dirty_orders", _dirty_sql("o_orderkey % 4 <> 0", "c"))
def feat_pipeline_dirty_orders(spark, d):
    """The fitted preparation over its own training rows: 'n/a', NaN, infinity, quotes, NULLs."""
    model, rows = _dirty_pipeline(spark, d)
    return _long_features(model, rows.where("o_orderkey % 4 <> 0"))


@query("feat_inference_dirty", _dirty_sql("o_orderkey % 4 = 0", "NULL"))
def feat_inference_dirty(spark, d):
    """The saved and reloaded preparation over new rows: an unseen category, a column that is
    missing (imputed) and one it does not know (left alone)."""
    model, rows = _dirty_pipeline(spark, d)
    path = scratch_path(spark, "prep")
    S.save_pipeline(model, path)
    new = rows.where("o_orderkey % 4 = 0").drop("custkey").withColumn("extra", F.lit("x"))
    return _long_features(S.load_pipeline(path), new)


@query("snk_pipeline_roundtrip", f"SELECT o_orderkey, true AS same FROM {_TEST_ROWS_SQL}")
def snk_pipeline_roundtrip(spark, d):
    train, test, stages, lab = _prepared_orders(spark, d)
    fitted = M.train_all(train, stages, ["LogisticRegression"], "classification", lab)
    model = fitted["LogisticRegression"]
    path = scratch_path(spark, "pipeline")
    S.save_pipeline(model, path)
    loaded = S.load_pipeline(path)
    a = model.transform(test).select("o_orderkey", F.col("prediction").alias("before"))
    b = loaded.transform(test).select("o_orderkey", F.col("prediction").alias("after"))
    return a.join(b, "o_orderkey").select("o_orderkey", (F.col("before") == F.col("after")).alias("same"))


@query("feat_inference_transform", f"SELECT o_orderkey, true AS has_features FROM {_TEST_ROWS_SQL}")
def feat_inference_transform(spark, d):
    """The saved and reloaded preparation over rows without the target column."""
    train, test, stages, lab = _prepared_orders(spark, d)
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    prep = Pipeline(stages=[lab] + stages).fit(train)
    path = scratch_path(spark, "prep")
    S.save_pipeline(prep, path)
    out = S.load_pipeline(path).transform(test.drop("o_orderstatus", "split"))
    return out.select("o_orderkey", (F.size(vector_to_array("features")) > 0).alias("has_features"))
