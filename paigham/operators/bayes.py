"""Multinomial naive Bayes as relations: smoothed term probabilities, empirical priors, scores.

Labels are Genuine and Scam; rows without label do not train; ties go to Genuine; a row without a
known term is scored by the priors alone and marked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paigham.config import Settings
from paigham.operators import features, metrics, split
from paigham.storage import cut

LABELS = ("Genuine", "Scam")


def priors(train: DataFrame) -> DataFrame:
    """One row: logarithms of the shares of both labels."""
    n = F.count_if(F.col("status").isin(*LABELS))
    return train.agg(*[F.log(F.try_divide(F.count_if(F.col("status") == x), n)).alias(f"prior_{x.lower()}") for x in LABELS])


def term_probabilities(train: DataFrame, vocab: DataFrame, settings: Settings = Settings(), alpha: float = 1.0) -> DataFrame:
    """``(term, theta_genuine, theta_scam)``: logarithms of the smoothed shares of each term of the vocabulary."""
    weighted = features.weights(train, vocab, settings, carry=("status",))
    sums = cut(weighted.groupBy("term").agg(*[F.sum(F.when(F.col("status") == x, F.col("weight")).otherwise(0.0)).alias(x.lower()) for x in LABELS]))
    totals = sums.agg(F.count("*").alias("v"), *[F.sum(x.lower()).alias(f"all_{x.lower()}") for x in LABELS])
    each = [F.log((F.col(x.lower()) + alpha) / (F.col(f"all_{x.lower()}") + alpha * F.col("v"))).alias(f"theta_{x.lower()}") for x in LABELS]
    return sums.crossJoin(F.broadcast(totals)).select("term", *each)


@dataclass(frozen=True)
class Model:
    """A vocabulary with the probabilities of its terms - written once, however often it is read - and the priors."""

    vocab: DataFrame
    prior: DataFrame
    theta: DataFrame
    settings: Settings = Settings()

    @cached_property
    def terms(self) -> DataFrame:
        """``(term, idf, theta_genuine, theta_scam)``."""
        return cut(self.vocab.select("term", "idf").join(self.theta, "term"))


def fit(train: DataFrame, settings: Settings = Settings()) -> Model:
    vocab = cut(features.vocabulary(train, settings))
    return Model(vocab, cut(priors(train)), cut(term_probabilities(train, vocab, settings)), settings)


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """``(row_id, prediction, confidence, known_terms)`` of every row; confidence is the likelier label's percent.

    One join with the model's terms; the norm of a row is taken from the same sums as its scores.
    """
    raw = features.raw_weights(rows, model.terms, model.settings)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
    sums = raw.groupBy("row_id").agg(F.count("*").alias("k"), *[(F.sum(F.col("w") * F.col(f"theta_{x.lower()}")) / norm).alias(f"s_{x.lower()}") for x in LABELS])
    joined = rows.select("row_id").join(sums, "row_id", "left").crossJoin(F.broadcast(model.prior))
    score = {x: F.coalesce(F.col(f"s_{x.lower()}"), F.lit(0.0)) + F.col(f"prior_{x.lower()}") for x in LABELS}
    gap = score["Scam"] - score["Genuine"]
    share = 1 / (1 + F.exp(-F.abs(gap)))
    return joined.select("row_id", F.when(gap > 0, "Scam").otherwise("Genuine").alias("prediction"), F.bround(share * 100, 1).alias("confidence"), F.coalesce("k", F.lit(0)).alias("known_terms"))


def check_model(model: Model) -> None:
    """A stored model must have priors of both labels and probabilities of just the vocabulary's terms."""
    row = model.prior.first()
    if row is None or any(row[f"prior_{x.lower()}"] is None for x in LABELS):
        raise ValueError("the model lacks a label")
    missing = model.vocab.join(model.theta, "term", "left_anti").count() + model.theta.join(model.vocab, "term", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} terms are not in both the vocabulary and the model")


def cross_validate(df: DataFrame, k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """``(fold, f1)``: weighted F1 of each unshuffled stratified fold, its vocabulary fitted on the others."""
    folded = cut(df.select("row_id", "cleaned_msg", "status").where(F.col("status").isin(*LABELS)).join(split.folds(df, k).select("row_id", "fold"), "row_id"))
    out = None
    for fold in range(k):
        train, test = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        judged = predict(test, fit(train, settings)).join(test.select("row_id", "status"), "row_id")
        one = metrics.weighted_f1(judged).select(F.lit(fold).alias("fold"), "f1")
        out = one if out is None else out.unionByName(one)
    return out


def fold_summary(scores: DataFrame) -> DataFrame:
    """One row: smallest, largest, mean and spread of the folds' scores."""
    return scores.agg(F.min("f1").alias("low"), F.max("f1").alias("high"), F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("spread"))
