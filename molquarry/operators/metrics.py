"""Classification and regression metrics, rank statistics, losses and label statistics as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.operators.skew import running_sum


def class_histogram(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, percent)."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def confusion(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """tn, fp, fn, tp and the scores from them; not both classes among truth and predictions: zeros in the matrix."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    a = rows.agg(
        F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"),
        F.greatest(F.max(truth), F.max(pred)).alias("hi"), F.least(F.min(truth), F.min(pred)).alias("lo"), F.count(F.lit(1)).alias("n"),
    )
    z = lambda num, den: F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0))
    a = a.withColumn("accuracy", z(F.col("tp") + F.col("tn"), F.col("n"))).withColumn("precision", z(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", z(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = F.coalesce(2.0 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    square = F.col("hi") > F.col("lo")
    zero = lambda c: F.when(square, F.col(c)).otherwise(F.lit(0)).alias(c)
    return a.select(zero("tn"), zero("fp"), zero("fn"), zero("tp"), "accuracy", "precision", "recall", f1.alias("f1"))


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the average rank (ties share it): running sums over distinct values, in ranges of them."""
    per = rows.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_sum(per, [F.col("__v")], F.col("__n"), "__b").withColumn(name, F.col("__b") + (F.col("__n") + 1) / F.lit(2.0)).drop("__n", "__b")
    return rows.join(ranked, F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def roc_auc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Mann-Whitney area with average ranks; 0.5 if there is one class only."""
    r = average_ranks(rows.select(truth, score), score, "r")
    a = r.agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("q"), F.sum(F.when(F.col(truth) == 1, F.col("r"))).alias("s"))
    auc = (F.col("s") - F.col("p") * (F.col("p") + 1) / F.lit(2.0)) / F.nullif((F.col("p") * F.col("q")).cast("double"), F.lit(0.0))
    return a.select(F.coalesce(auc, F.lit(0.5)).alias("auc"))


def regression(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """mse, rmse, mae, r2 (-999 if undefined), mean / std (population) / largest error, mape (-1 if a truth is 0)."""
    e = F.col(pred) - F.col(truth)
    a = rows.agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("mean_error"), F.stddev_pop(e).alias("std_error"), F.max(F.abs(e)).alias("max_error"),
        F.var_pop(truth).alias("v"), F.bool_or(F.col(truth) == 0).alias("zero"), F.avg(F.abs(e / F.nullif(F.col(truth), F.lit(0.0)))).alias("ape"),
    )
    r2 = F.coalesce(1 - F.col("mse") / F.nullif(F.col("v"), F.lit(0.0)), F.lit(-999.0))
    mape = F.when(F.col("zero"), F.lit(-1.0)).otherwise(F.col("ape") * 100)
    return a.select("mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), "mean_error", "std_error", "max_error", mape.alias("mape"))


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz scheme."""
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def correlation_p(r: float | None, n: int) -> float:
    """Two-sided p-value of a correlation by Student's t with n - 2 degrees of freedom; 1 if undefined."""
    if r is None or math.isnan(r) or n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    v = n - 2
    x = v / (v + r * r * v / (1 - r * r))
    a, b = v / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(pearson, pearson_p, spearman, spearman_p, n); undefined: 0 and 1. P-values are of one row."""
    r = average_ranks(average_ranks(rows.select(x, y), x, "rx"), y, "ry")
    a = r.agg(F.corr(x, y).alias("p"), F.corr("rx", "ry").alias("s"), F.count(F.lit(1)).alias("n"))
    p_of = F.udf(lambda c, n: float(correlation_p(c, n)), "double")
    val = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    return a.select(val("p").alias("pearson"), p_of("p", "n").alias("pearson_p"), val("s").alias("spearman"), p_of("s", "n").alias("spearman_p"), "n")


def positive_weight(rows: DataFrame, truth: str) -> DataFrame:
    """n_neg / n_pos, 1 without positives."""
    a = rows.agg(F.count_if(F.col(truth) == 0).alias("q"), F.count_if(F.col(truth) == 1).alias("p"))
    return a.select(F.coalesce(F.col("q") / F.nullif(F.col("p"), F.lit(0)), F.lit(1.0)).alias("pos_weight"))


def bce_with_logits(rows: DataFrame, truth: str, logit: str, pos_weight: float) -> DataFrame:
    """Mean stable binary cross entropy with a weight on positives."""
    x, y = F.col(logit), F.col(truth)
    soft = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))  # log(1 + exp(-x))
    return rows.agg(F.avg((1 - y) * x + (1 + (F.lit(pos_weight) - 1) * y) * soft).alias("bce"))


def regression_losses(rows: DataFrame, truth: str, pred: str, delta: float = 1.0) -> DataFrame:
    e = F.abs(F.col(pred) - F.col(truth))
    huber = F.when(e <= delta, 0.5 * e * e).otherwise(F.lit(delta) * (e - F.lit(0.5 * delta)))
    return rows.agg(F.avg(e * e).alias("mse"), F.avg(e).alias("mae"), F.avg(huber).alias("huber"))
