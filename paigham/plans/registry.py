"""The registered queries of the core operators, over whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paigham.config import Settings
from paigham.functions import labels as L
from paigham.functions import text as X
from paigham.operators import bayes, dedup, features, metrics, models, quality, rules, scanlog, split, stats
from paigham.plans import oracle
from paigham.plans.pipeline import Pipeline
from paigham.plans.pipeline import score as score_messages
from paigham.storage import cut, shared_dir, spread, table

Query = Callable[[SparkSession, str], DataFrame]
PRUNED = Settings(min_df=2, max_df=0.95, max_features=1500)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "raw_messages").select(F.col("raw_id").alias("row_id"), "msg", "status", "source"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return quality.normalize_labels(_raw(spark, d))


def _valid(spark: SparkSession, d: str) -> DataFrame:
    return quality.remove_invalid(_labelled(spark, d))


def _processed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed").select("row_id", "msg", "cleaned_msg", "status", "source", "split")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(_processed(spark, d))


def _train(spark: SparkSession, d: str) -> DataFrame:
    return _processed(spark, d).where("split = 'train' and cleaned_msg is not null")


def _test(spark: SparkSession, d: str) -> DataFrame:
    return _processed(spark, d).where("split = 'test' and cleaned_msg is not null")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scan_log")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Scans with the label of their message; the score is the percent for Scam."""
    log = _log(spark, d).select("id", "row_id", "prediction", "confidence").distinct()
    score = F.when(F.col("prediction") == "Scam", F.col("confidence")).otherwise(100 - F.col("confidence"))
    return log.withColumn("score", score).join(table(spark, d, "processed").select("row_id", "status"), "row_id")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """The ad-hoc cases with three simple predictions: keyword risk, expected words, links."""
    say = lambda c: F.when(c, "Scam").otherwise("Genuine")
    low = F.lower("message")
    return table(spark, d, "adhoc_cases").withColumns({"by_risk": say(rules.risk_score(F.col("message")) >= 40), "by_words": rules.expected_label(F.col("message")), "by_links": say(low.contains("http") | low.contains("www"))})


def _over(source: Query, operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, d: operator(source(spark, d), *args, **kwargs)


def _text(name: str, column: Callable) -> Query:
    return lambda spark, d: spread(table(spark, d, "processed").select("row_id", "msg")).select("row_id", column(F.col("msg")).alias(name))


def _weights(of: Query) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        vocab = cut(features.vocabulary(_train(spark, d)))
        return features.weights(of(spark, d), vocab).select("row_id", "term", F.round("weight", 6).alias("weight"))

    return run


def _theta(spark: SparkSession, d: str) -> DataFrame:
    train = _train(spark, d)
    theta = bayes.term_probabilities(train, cut(features.vocabulary(train)))
    return theta.select("term", F.round("theta_genuine", 6).alias("theta_genuine"), F.round("theta_scam", 6).alias("theta_scam"))


def _predict(spark: SparkSession, d: str) -> DataFrame:
    return bayes.predict(_test(spark, d), bayes.fit(_train(spark, d)))


def _score(spark: SparkSession, d: str) -> DataFrame:
    return score_messages(table(spark, d, "tracker").select(F.col("track_id").alias("row_id"), F.col("sms").alias("msg")), bayes.fit(_train(spark, d)))


def _admission(spark: SparkSession, d: str) -> DataFrame:
    status, error = rules.admission(F.col("msg"), F.col("cleaned_msg"))
    return _processed(spark, d).select("row_id", status.alias("code"), error.alias("error"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    hits = _processed(spark, d).where("msg is not null").select("row_id", F.explode(rules.keyword_hits(F.col("msg"))).alias("category", "words"))
    return hits.select("row_id", "category", F.array_join("words", ",").alias("words"))


def _risk(spark: SparkSession, d: str) -> DataFrame:
    score = rules.risk_score(F.col("msg"))
    return _processed(spark, d).select("row_id", F.least(score, F.lit(100)).alias("risk_score"), rules.risk_level(score).alias("risk_level"))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    score = rules.risk_score(F.col("message"))
    return rules.ensemble(_cases(spark, d), "by_risk", "by_words", "by_links").select("case_id", rules.verdict(F.col("prediction"), score).alias("verdict"))


def _batch(spark: SparkSession, d: str) -> DataFrame:
    return rules.batch(_cases(spark, d), "message", "by_risk", "by_words", "by_links").select("case_id", "sms", "prediction", F.col("confidence_text").alias("confidence"), "scam_votes", "risk_level", "risk_score")


def _scenarios(spark: SparkSession, d: str) -> DataFrame:
    voted = rules.ensemble(_cases(spark, d), "by_risk", "by_words", "by_links")
    return metrics.by_scenario(voted.withColumn("status", F.col("expected")))


def _comparison(spark: SparkSession, d: str) -> DataFrame:
    cases = _cases(spark, d).withColumn("status", F.col("expected"))
    return metrics.comparison({c: cases.withColumn("prediction", F.col(c)) for c in ("by_risk", "by_words", "by_links")})


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return scanlog.next_ids(_log(spark, d), table(spark, d, "tracker").select("track_id", "prediction"), "track_id").select("track_id", "prediction", "id")


def _pipeline_report(spark: SparkSession, d: str) -> DataFrame:
    report = Pipeline(_raw(spark, d)).report()
    return report.select(*[F.col(f"{stage.name}.{c}").alias(f"{stage.name}_{c}") for stage in report.schema for c in stage.dataType.names])


def _tuned(spark: SparkSession, d: str, kind: str) -> tuple[models.Tuned, DataFrame]:
    """The whole grid of the reference with five folds, and the vectors of the test rows."""
    train, test = _train(spark, d).where("status in ('Scam', 'Genuine')"), _test(spark, d).where("status in ('Scam', 'Genuine')")
    vocab = cut(features.vocabulary(train, PRUNED, index=True))
    folded = train.select("row_id", "status", "cleaned_msg").join(split.folds(train, 5).select("row_id", "fold"), "row_id")
    data = models.vectors(folded, features.weights(train, vocab, PRUNED), vocab, "fold")
    tuned = models.tune(data, vocab.count(), models.GRID if kind == "logistic" else models.SVM_GRID, kind=kind)
    return tuned, models.vectors(test, features.weights(test, vocab, PRUNED), vocab)


def _linear(kind: str) -> Query:
    return lambda spark, d: models.predictions(*_tuned(spark, d, kind))


def _stream_totals(spark: SparkSession, d: str) -> DataFrame:
    from paigham.streaming import scan

    # A file stream reads folders; the table is one file or a folder of parts.
    name = f"scan_{uuid.uuid4().hex}"
    static = table(spark, d, "scan_log")
    feed = f"{shared_dir(spark)}/{name}"
    static.write.parquet(feed)
    stream = scan.read_log(spark, feed, static.schema.simpleString()[len("struct<") : -1].replace(":", " "))
    scan.run_once(scan.totals(stream), name, "complete", tempfile.mkdtemp(prefix="paigham-stream-") if feed.startswith("file:") else f"{feed}-state")
    return spark.table(name)


def queries() -> dict[str, Query]:
    labels = lambda spark, d: _raw(spark, d).select("row_id", L.canonical_label(F.col("status")).alias("status"))
    sources = lambda spark, d: _raw(spark, d).select("row_id", L.canonical_source(F.col("source")).alias("source"))
    ids = lambda operator, *args, **kw: lambda spark, d: operator(_valid(spark, d), *args, **kw).select("row_id", "status")
    return {
        "label_normalize": labels,
        "source_normalize": sources,
        "missing_and_invalid_flags": _over(_raw, quality.flags),
        "quality_report": _over(_raw, quality.report),
        "quality_report_first": _over(_raw, quality.report, "first"),
        "remove_invalid": lambda spark, d: _valid(spark, d).select("row_id", "status", "source"),
        "removal_counts": _over(_labelled, quality.removal_counts),
        "respelled_labels": _over(_raw, quality.respelled),
        "respelled_sources": _over(_raw, quality.respelled, "source"),
        "unknown_labels": _over(_raw, quality.unknown_labels),
        "describe": _over(_raw, quality.describe),
        "duplicate_key": lambda spark, d: _raw(spark, d).select("row_id", X.duplicate_key(F.col("msg")).alias("key")),
        "flag_duplicates": _over(_raw, dedup.flag_duplicates),
        "dedup_keep_first": ids(dedup.keep_first),
        "dedup_conflict_drop": ids(dedup.remove_duplicates, "drop"),
        "dedup_conflict_first": ids(dedup.remove_duplicates, "first"),
        "duplicate_report_drop": _over(_valid, dedup.duplicate_report, "drop"),
        "duplicate_report_first": _over(_valid, dedup.duplicate_report, "first"),
        "conflict_examples": _over(_valid, dedup.conflict_examples),
        "conflicting_rows": ids(dedup.conflicting_rows),
        "raw_conflicts": lambda spark, d: dedup.raw_conflicts(_raw(spark, d)).select("row_id", "status"),
        "blank_rows": lambda spark, d: dedup.blank_rows(_raw(spark, d)).select("row_id"),
        "template_groups": _over(_processed, dedup.template_groups),
        "largest_template": _over(_processed, dedup.largest_template),
        "clean_url": _text("cleaned", lambda c: X.replace_urls(F.lower(c))),
        "clean_numbers": _text("cleaned", lambda c: X.replace_numbers(F.lower(c))),
        "clean_numbers_removed": _text("cleaned", lambda c: X.replace_numbers(F.lower(c), "remove", phones=False, service_codes=False)),
        "clean_text": _text("cleaned", X.clean),
        "spelling_normalize": lambda spark, d: _processed(spark, d).select("row_id", X.normalize_spelling(F.col("cleaned_msg")).alias("cleaned")),
        "stopword_filter": lambda spark, d: _processed(spark, d).select("row_id", F.array_join(X.remove_stopwords(X.tokens(X.clean(F.col("msg"))), Settings().stopwords), " ").alias("cleaned")),
        "preprocess_text": _text("cleaned", X.preprocess),
        "empty_after_clean": lambda spark, d: _processed(spark, d).where(X.preprocess(F.col("msg")) == "").select("row_id"),
        "shorten_text": _text("short", lambda c: X.shorten(c, 90)),
        "ngrams": lambda spark, d: _processed(spark, d).where("cleaned_msg is not null").select("row_id", F.array_join(X.ngrams(X.tokens(F.col("cleaned_msg"))), "|").alias("terms")),
        "label_stats": _over(_processed, stats.statistics),
        "label_shares": _over(_processed, stats.shares, "status"),
        "source_stats": _over(_processed, stats.value_counts, "source", nulls=True),
        "label_source_sets": _over(_processed, stats.label_source_sets),
        "words_by_label": _over(_texts, stats.words_by_label),
        "top_words_by_class": _over(_texts, stats.top_words),
        "top_words_zip": _over(_texts, stats.top_words_side_by_side),
        "distinctive_words": _over(_texts, stats.distinctive_words),
        "word_count_histogram": _over(_texts, stats.word_count_histogram),
        "word_count_quartiles": _over(_texts, stats.quartiles),
        "summary_unpivot": _over(_processed, stats.summary_rows),
        "seeded_sample": lambda spark, d: stats.sample(_processed(spark, d), 25).select("row_id"),
        "split_quota": _over(_processed, split.quotas),
        "stratified_split": _over(_processed, split.stratified),
        "cv_folds": _over(_processed, split.folds),
        "train_test_split": _over(_processed, split.train_test),
        "golden_differences": lambda spark, d: quality.differences(_text("cleaned_msg", X.preprocess)(spark, d), _processed(spark, d), "cleaned_msg"),
        "train_test_overlap": _over(_processed, split.overlap),
        "term_frequency": _over(_train, features.terms),
        "document_frequency": lambda spark, d: features.document_frequency(features.terms(_train(spark, d))),
        "idf": lambda spark, d: features.vocabulary(_train(spark, d)).select("term", "df", F.round("idf", 6).alias("idf")),
        "vocab_pruned": lambda spark, d: features.vocabulary(_train(spark, d), PRUNED, index=True).select("term", "df", "idx"),
        "tfidf_train": _weights(_train),
        "tfidf_test": _weights(_test),
        "sparsity": lambda spark, d: features.sparsity(_test(spark, d), features.vocabulary(_train(spark, d))),
        "nb_prior": _over(_train, bayes.priors),
        "nb_theta": _theta,
        "nb_predict": _predict,
        "nb_cv": lambda spark, d: bayes.fold_summary(bayes.cross_validate(_train(spark, d), 5)),
        "score_messages": _score,
        "score_admission": _admission,
        "keyword_risk": _risk,
        "keyword_hits": _hits,
        "expected_label": lambda spark, d: _processed(spark, d).select("row_id", rules.expected_label(F.col("msg")).alias("label")),
        "ensemble_vote": lambda spark, d: rules.ensemble(_cases(spark, d), "by_risk", "by_words", "by_links").select("case_id", "scam_votes", "prediction", "confidence"),
        "vote_map": lambda spark, d: _cases(spark, d).select("case_id", F.explode(rules.vote_map({"NB": "by_risk", "LR": "by_words", "SVM": "by_links"})).alias("model", "prediction")),
        "display_formats": lambda spark, d: table(spark, d, "tracker").select("track_id", X.sentence_case(F.lower("risk_level")).alias("level"), X.thousands(F.col("row_id")).alias("number"), F.upper("prediction").alias("label")),
        "final_verdict": _verdicts,
        "batch_detect": _batch,
        "batch_totals": lambda spark, d: rules.batch_totals(rules.ensemble(_cases(spark, d), "by_risk", "by_words", "by_links")),
        "console_safe": lambda spark, d: _processed(spark, d).select("row_id", X.console_safe(F.col("msg"), 60).alias("shown")),
        "confusion": _over(_judged, metrics.confusion),
        "prf": _over(_judged, metrics.scores),
        "classification_report": _over(_judged, metrics.classification_report),
        "weighted_f1": _over(_judged, metrics.weighted_f1),
        "roc_points": _over(_judged, metrics.roc_points),
        "auc_rank": _over(_judged, metrics.auc_by_rank),
        "auc_trapezoid": _over(_judged, metrics.auc_by_trapezoid),
        "accuracy_by_scenario": _scenarios,
        "model_comparison": _comparison,
        "scan_validate": _over(_log, scanlog.validate),
        "scan_summary": _over(_log, scanlog.summary),
        "scan_recent20": _over(_log, scanlog.recent),
        "scan_display": _over(_log, scanlog.display),
        "donut_arcs": _over(_log, scanlog.donut),
        "scan_ids": _ids,
        "scan_append": lambda spark, d: scanlog.append_scans(_log(spark, d), table(spark, d, "tracker").select("track_id", "prediction", F.col("confidence").cast("double").alias("confidence")), "track_id", datetime(2024, 3, 1, tzinfo=UTC)),
        "scan_local_time": lambda spark, d: _log(spark, d).select("id", scanlog.in_zone(F.col("scanned_at"), "Asia/Karachi").alias("shown")),
        "mean_over_models": lambda spark, d: metrics.mean_over_models(_comparison(spark, d)),
        "export_parts": _over(_log, scanlog.export_rows),
        "tracker_summary": lambda spark, d: scanlog.tracker_summary(table(spark, d, "tracker")),
        "tracker_tail": lambda spark, d: scanlog.tracker_tail(table(spark, d, "tracker")),
        "pipeline_report": _pipeline_report,
        "lr_cv": _linear("logistic"),
        "svm_linear": _linear("hinge"),
        "stream_scan_totals": _stream_totals,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
