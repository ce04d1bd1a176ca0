"""The preparation pipeline from raw messages to features, and scoring of new messages, as plans.

Stages keep their order: validation sees raw labels, duplicates go by normalised labels before
cleaning, texts that clean to nothing go before the strict step, overlap is measured on the split used.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paigham.config import Settings
from paigham.functions.text import preprocess
from paigham.operators import bayes, dedup, features, quality, rules, split, stats
from paigham.storage import cut


class EmptyDatasetError(Exception):
    """No row is left to prepare."""


@dataclass
class Pipeline:
    """Lazy stages over one table ``(row_id, msg, status, source)``; the prepared table is written once."""

    raw: DataFrame
    settings: Settings = Settings()

    @cached_property
    def valid(self) -> DataFrame:
        return quality.remove_invalid(quality.normalize_labels(self.raw.select(*quality.COLUMNS)))

    @cached_property
    def distinct(self) -> DataFrame:
        return dedup.remove_duplicates(self.valid, self.settings.conflicts)

    @cached_property
    def cleaned(self) -> DataFrame:
        done = cut(self.distinct.withColumn("cleaned_msg", preprocess(F.col("msg"), self.settings)).where("cleaned_msg <> ''"))
        if done.isEmpty():
            raise EmptyDatasetError("no message with text and label is left")
        return dedup.remove_duplicates(done, self.settings.conflicts, F.col("cleaned_msg")) if self.settings.strict else done

    @cached_property
    def split(self) -> DataFrame:
        parts = split.train_test(self.cleaned, self.settings.test_size, self.settings.seed).select("row_id", "split")
        return cut(self.cleaned.join(parts, "row_id"))

    @cached_property
    def train(self) -> DataFrame:
        return self.split.where("split = 'train'")

    @cached_property
    def vocabulary(self) -> DataFrame:
        return cut(features.vocabulary(self.train, self.settings))

    @cached_property
    def model(self) -> bayes.Model:
        return bayes.fit(self.train, self.settings)

    def weights(self, rows: DataFrame) -> DataFrame:
        return features.weights(rows, self.vocabulary, self.settings)

    def report(self) -> DataFrame:
        """One row with the counters of all stages, nested by stage."""
        one = lambda df: F.struct(*df.columns)
        stages = {
            "validation": quality.report(self.raw, self.settings.conflicts),
            "invalid": quality.removal_counts(quality.normalize_labels(self.raw)),
            "duplicates": dedup.duplicate_report(self.valid, self.settings.conflicts),
            "templates": dedup.template_groups(self.cleaned),
            "statistics": stats.statistics(self.cleaned),
            "overlap": split.overlap(self.split),
            "features": self.vocabulary.agg(F.count("*").alias("n_features")),
        }
        out: DataFrame | None = None
        for name, df in stages.items():
            part = df.select(one(df).alias(name))
            out = part if out is None else out.crossJoin(F.broadcast(part))
        return out


    def examples(self, n: int = 5) -> list[tuple[str, str]]:
        """A few messages before and after."""
        return [(r["msg"], r["cleaned_msg"]) for r in self.cleaned.orderBy("row_id").limit(n).collect()]

    def save(self, folder: str) -> dict[str, str]:
        """The prepared table, its parts, the vocabulary, the model and the report; where each is."""
        from paigham.sources import sinks, stored

        spark = self.raw.sparkSession
        sinks.write_csv(self.cleaned.select(*sinks.PREPARED), f"{folder}/cleaned.csv")
        paths = {"cleaned": f"{folder}/cleaned.csv", **sinks.write_split_csv(self.split, folder), "vocabulary": f"{folder}/vocabulary", "model": f"{folder}/model", "report": f"{folder}/report.json"}
        stored.save_vocabulary(self.vocabulary, paths["vocabulary"])
        stored.save_model(self.model, paths["model"])
        sinks.write_json(spark, paths["report"], self.report().first().asDict(recursive=True) | {"files": paths})
        return paths


def score(messages: DataFrame, model: bayes.Model) -> DataFrame:
    """``(row_id, status, error, prediction, confidence)`` of every message; refused ones have no prediction."""
    rows = messages.select("row_id", "msg").withColumn("cleaned_msg", preprocess(F.col("msg"), model.settings))
    scored = bayes.predict(rows, model)
    joined = rows.join(scored, "row_id")
    status, error = rules.admission(F.col("msg"), F.col("cleaned_msg"), F.col("known_terms"))
    good = F.col("status") == 200
    return joined.select("row_id", status.alias("status"), error.alias("error"), "prediction", "confidence").select("row_id", "status", "error", F.when(good, F.col("prediction")).alias("prediction"), F.when(good, F.col("confidence")).alias("confidence"))
