"""Fitted vocabularies and models on storage: saved whole, and checked when they are loaded.

A model is a folder of tables and a description, written last: a folder without one is no model. The
description holds the settings, the version of the form, the number of terms, and what the model said
of a probe message when it was saved; a loaded model must say the same.
"""

from __future__ import annotations

import json
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession

from paigham.config import Settings
from paigham.operators import bayes
from paigham.plans.pipeline import score
from paigham.sources.sinks import write_json

VERSION = 1
PROBE = "mubarak aap ka bank account inam jeet gaya"


class ModelError(Exception):
    """A folder holds no model that can be used."""


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(term, df, idf)``."""
    try:
        vocab = spark.read.parquet(path)
    except Exception as e:
        raise ModelError(f"no vocabulary at {path}") from e
    missing = {"term", "df", "idf"} - set(vocab.columns)
    if missing:
        raise ModelError(f"{path} lacks {', '.join(sorted(missing))}")
    return vocab


def _plain(settings: Settings) -> dict:
    return {k: sorted(v) if isinstance(v, frozenset) else v for k, v in asdict(settings).items()}


def _settings(stored: dict) -> Settings:
    kinds = {f.name: f.type for f in fields(Settings)}
    unknown = set(stored) - set(kinds)
    if unknown:
        raise ModelError(f"unknown settings: {', '.join(sorted(unknown))}")
    turned = {"stopwords": frozenset, "short_codes": tuple}
    return Settings(**{k: turned.get(k, lambda x: x)(v) for k, v in stored.items()})


def _probe(spark: SparkSession, model: bayes.Model) -> dict:
    row = score(spark.createDataFrame([(1, PROBE)], "row_id bigint, msg string"), model).first()
    return {k: row[k] for k in ("status", "prediction", "confidence")}


def save_model(model: bayes.Model, path: str) -> None:
    spark = model.theta.sparkSession
    bayes.check_model(model)
    save_vocabulary(model.vocab, f"{path}/vocabulary")
    model.prior.write.mode("overwrite").parquet(f"{path}/prior")
    model.theta.write.mode("overwrite").parquet(f"{path}/theta")
    write_json(spark, f"{path}/model.json", {"version": VERSION, "labels": list(bayes.LABELS), "terms": model.theta.count(), "settings": _plain(model.settings), "probe": _probe(spark, load_tables(spark, path, model.settings))})


def load_tables(spark: SparkSession, path: str, settings: Settings) -> bayes.Model:
    return bayes.Model(load_vocabulary(spark, f"{path}/vocabulary"), spark.read.parquet(f"{path}/prior"), spark.read.parquet(f"{path}/theta"), settings)


def load_model(spark: SparkSession, path: str) -> bayes.Model:
    """A saved model; checked are its version, labels, terms, settings and what it says of the probe."""
    try:
        text = spark.read.text(f"{path}/model.json", wholetext=True).first()[0]
        described = json.loads(text)
    except Exception as e:
        raise ModelError(f"no model at {path}") from e
    if described.get("version") != VERSION:
        raise ModelError(f"{path} has version {described.get('version')}, not {VERSION}")
    if described.get("labels") != list(bayes.LABELS):
        raise ModelError(f"{path} knows the labels {described.get('labels')}")
    try:
        model = load_tables(spark, path, _settings(described["settings"]))
        bayes.check_model(model)
    except ValueError as e:
        raise ModelError(f"{path}: {e}") from e
    if model.theta.count() != described["terms"]:
        raise ModelError(f"{path} has another number of terms than when it was saved")
    if _probe(spark, model) != described["probe"]:
        raise ModelError(f"{path} does not say of the probe what it said when it was saved")
    return model
