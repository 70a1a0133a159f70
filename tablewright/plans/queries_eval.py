"""Checked queries for evaluation (EVAL1-5) with rule-based predictions (exact oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from .derived import table
from .registry import query

# Rule-based predictions (FIXTURES.md): quantity threshold against the return flag and
# quantity x 1500 against the extended price.
_RULE_SQL = "CASE WHEN l_quantity > 25 THEN 'A' ELSE 'N' END"


def _rule_preds(li, threshold=25):
    return li.withColumn("pred", F.when(F.col("l_quantity") > threshold, "A").otherwise("N"))


def _cls_sql(pred_sql: str) -> str:
    return f"""
WITH p AS (SELECT l_returnflag AS a, {pred_sql} AS b FROM lineitem),
lab AS (SELECT a AS l FROM p UNION SELECT b FROM p),
per AS (SELECT l, (SELECT count(*) FROM p WHERE a = l) AS support, (SELECT count(*) FROM p WHERE b = l) AS n_pred,
               (SELECT count(*) FROM p WHERE a = l AND b = l) AS tp FROM lab),
m AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS pr,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM per),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m)
SELECT round_even(sum(tp) / sum(support), 4) AS accuracy, round_even(sum(support * pr) / sum(support), 4) AS precision,
       round_even(sum(support * rc) / sum(support), 4) AS recall, round_even(sum(support * f1) / sum(support), 4) AS f1_score
FROM f"""


@query("eval_classification", _cls_sql(_RULE_SQL))
def eval_classification(spark, d):
    return EV.classification_metrics(_rule_preds(table(spark, d, "lineitem")), "l_returnflag", "pred")


@query("eval_regression", """
SELECT round_even(sqrt(avg((l_extendedprice - l_quantity * 1500) ^ 2)), 4) AS rmse,
       round_even(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae,
       round_even(CASE WHEN var_pop(l_extendedprice) = 0 THEN CASE WHEN sum((l_extendedprice - l_quantity * 1500) ^ 2) = 0 THEN 1.0 ELSE 0.0 END
                  ELSE 1 - sum((l_extendedprice - l_quantity * 1500) ^ 2) / (var_pop(l_extendedprice) * count(*)) END, 4) AS r2
FROM lineitem""")
def eval_regression(spark, d):
    li = table(spark, d, "lineitem").withColumn("pred", F.col("l_quantity") * 1500)
    return EV.regression_metrics(li, "l_extendedprice", "pred")


@query("eval_confusion_matrix", f"""
WITH p AS (SELECT l_returnflag AS a, {_RULE_SQL} AS b FROM lineitem),
lab AS (SELECT a AS l FROM p UNION SELECT b FROM p)
SELECT x.l AS actual, y.l AS predicted, (SELECT count(*) FROM p WHERE a = x.l AND b = y.l) AS n
FROM lab x, lab y""")
def eval_confusion_matrix(spark, d):
    return EV.confusion_matrix(_rule_preds(table(spark, d, "lineitem")), "l_returnflag", "pred")


_THRESHOLDS = [10, 25, 40]


@query("eval_leaderboard", "WITH r AS (" + "\nUNION ALL\n".join(
    f"SELECT 'rule_q{t}' AS model, {i} AS model_order, * FROM ({_cls_sql(f'CASE WHEN l_quantity > {t} THEN {chr(39)}A{chr(39)} ELSE {chr(39)}N{chr(39)} END')})"
    for i, t in enumerate(_THRESHOLDS)) + """)
SELECT model, accuracy, f1_score, row_number() OVER (ORDER BY f1_score DESC, model_order) AS rank,
       row_number() OVER (ORDER BY f1_score DESC, model_order) = 1 AS is_best FROM r""")
def eval_leaderboard(spark, d):
    li = table(spark, d, "lineitem")
    res = None
    for i, t in enumerate(_THRESHOLDS):
        m = EV.classification_metrics(_rule_preds(li, t), "l_returnflag", "pred").select(
            F.lit(f"rule_q{t}").alias("model"), F.lit(i).alias("model_order"), "accuracy", "f1_score")
        res = m if res is None else res.unionByName(m)
    return EV.leaderboard(res, "f1_score").select("model", "accuracy", "f1_score", "rank", "is_best")


@query("eval_residuals", """
WITH r AS (SELECT l_extendedprice - l_quantity * 1500 AS residual FROM lineitem),
mm AS (SELECT min(residual) AS lo, max(residual) AS hi FROM r),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((residual - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bin, lo, hi FROM r, mm)
SELECT CAST(i AS INTEGER) AS bin, round(lo + i * (hi - lo) / 20, 4) AS bin_start, round(lo + (i + 1) * (hi - lo) / 20, 4) AS bin_end,
       (SELECT count(*) FROM b WHERE b.bin = i) AS n
FROM mm, range(20) AS v(i)""")
def eval_residuals(spark, d):
    li = table(spark, d, "lineitem").withColumn("pred", F.col("l_quantity") * 1500)
    h = EV.residuals(li, "l_extendedprice", "pred")
    return h.select("bin", F.round("bin_start", 4).alias("bin_start"), F.round("bin_end", 4).alias("bin_end"), "n")
