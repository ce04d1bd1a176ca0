"""Evaluation of predictions ``(status, prediction[, score])``; the positive label is Scam.

Rows without label or prediction take no part; a ratio with nothing below it is 0; ties in scores
count half; an empty table gives zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paigham.operators import ranks
from paigham.storage import cut

POSITIVE, NEGATIVE = "Scam", "Genuine"


def _judged(df: DataFrame) -> DataFrame:
    return df.where(F.col("status").isin(POSITIVE, NEGATIVE) & F.col("prediction").isin(POSITIVE, NEGATIVE))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame) -> DataFrame:
    """One row: true and false, positive and negative."""
    at = lambda s, p: F.count_if((F.col("status") == s) & (F.col("prediction") == p))
    return _judged(df).agg(at(POSITIVE, POSITIVE).alias("tp"), at(NEGATIVE, POSITIVE).alias("fp"), at(POSITIVE, NEGATIVE).alias("fn"), at(NEGATIVE, NEGATIVE).alias("tn"))


def scores(df: DataFrame) -> DataFrame:
    """One row: accuracy, precision, recall and F1 of the positive label."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return confusion(df).select(_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def classification_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label, their macro and weighted means, and accuracy."""
    c = confusion(df)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    row = lambda name, p, r, f, n: F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), n.cast("bigint").alias("support"))
    pp, pr, pf, pn = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn), tp + fn
    np_, nr, nf, nn = _ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fp + fn), tn + fp
    n = pn + nn
    mean = lambda a, b: (a + b) / 2
    weighted = lambda a, b: _ratio(a * pn + b * nn, n)
    accuracy = _ratio(tp + tn, n)
    rows = F.array(row("Genuine", np_, nr, nf, nn), row("Scam", pp, pr, pf, pn), row("accuracy", accuracy, accuracy, accuracy, n), row("macro avg", mean(pp, np_), mean(pr, nr), mean(pf, nf), n), row("weighted avg", weighted(pp, np_), weighted(pr, nr), weighted(pf, nf), n))
    return c.select(F.explode(rows).alias("r")).select("r.*")


def weighted_f1(df: DataFrame) -> DataFrame:
    return classification_report(df).where("label = 'weighted avg'").select("f1")


def _per_score(df: DataFrame) -> DataFrame:
    """Positives and negatives of each distinct score: ties are one step."""
    return df.where(F.col("status").isin(POSITIVE, NEGATIVE) & F.col("score").isNotNull()).groupBy("score").agg(F.count_if(F.col("status") == POSITIVE).alias("p"), F.count_if(F.col("status") == NEGATIVE).alias("n"))


def _steps(df: DataFrame, one_window: int) -> DataFrame:
    """The steps of the curve, highest score first, with what lies ahead of each and what comes after."""
    return ranks.running(_per_score(df), F.desc("score"), ("p", "n"), one_window)


def roc_points(df: DataFrame, one_window: int = ranks.ONE_WINDOW) -> DataFrame:
    """``(fpr, tpr, threshold)`` from (0, 0) on; points on a straight line between their neighbours are left out.

    One step per distinct score; no task gets more than ``one_window`` of them.
    """
    steps = cut(_steps(df, one_window))
    totals = steps.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    corner = F.col("next_p").isNull() | (F.col("p") * F.col("next_n") != F.col("next_p") * F.col("n"))
    run = steps.where(corner).select("score", (F.col("before_p") + F.col("p")).alias("tp"), (F.col("before_n") + F.col("n")).alias("fp"))
    zero = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("score"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"))
    return zero.unionByName(run).crossJoin(F.broadcast(totals)).select(_ratio(F.col("fp"), F.col("all_n")).alias("fpr"), _ratio(F.col("tp"), F.col("all_p")).alias("tpr"), F.col("score").alias("threshold"))


def auc_by_rank(df: DataFrame, one_window: int = ranks.ONE_WINDOW) -> DataFrame:
    """One row: the area under the ROC curve from ranks - how often a positive is above a negative - ties at half."""
    lost = F.sum(F.col("p") * (F.col("before_n") + F.col("n") / 2))
    pairs = F.sum("p") * F.sum("n")
    return _steps(df, one_window).agg(_ratio(pairs - lost, pairs).alias("auc"))


def auc_by_trapezoid(df: DataFrame, one_window: int = ranks.ONE_WINDOW) -> DataFrame:
    """One row: the same area from the trapezoids under the curve's steps."""
    under = F.sum(F.col("n") * (F.col("before_p") + F.col("p") / 2))
    return _steps(df, one_window).agg(_ratio(under, F.sum("p") * F.sum("n")).alias("auc"))


def mean_over_models(compared: DataFrame, metric: str = "f1") -> DataFrame:
    """One row: the mean of a metric over the models of a comparison, and how many there are."""
    return compared.agg(F.avg(metric).alias(f"mean_{metric}"), F.count(metric).alias("n_models"))


def by_scenario(df: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Cases, correct ones and accuracy per scenario."""
    hit = (F.col("prediction") == F.col("status")).cast("int")
    return _judged(df).groupBy(scenario).agg(F.count("*").alias("n"), F.sum(hit).cast("bigint").alias("correct"), F.avg(hit).alias("accuracy"))


def comparison(named: dict[str, DataFrame]) -> DataFrame:
    """The scores of several models, best F1 first; of equal ones the first named."""
    out = None
    for k, (name, df) in enumerate(named.items()):
        one = scores(df).select(F.lit(name).alias("model"), F.lit(k).alias("place"), "*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.desc("f1"), "place"))).drop("place")
