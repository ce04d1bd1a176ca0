"""Core operators on small tables with nulls, blanks, ties, repeats, clashing columns and no rows."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from paigham.config import Settings
from paigham.operators import bayes, dedup, features, metrics, models, quality, ranks, rules, scanlog, split, stats
from paigham.plans.pipeline import Pipeline, score

ROWS = [
    ("You won a prize", "Scam", "Real"),
    ("you  WON a prize ", "scam", "Real"),
    ("Class is at two", "genuine", "generated"),
    ("Class is at two", "Scam", None),
    ("", "ham", "x"),
    (None, "fraud", ""),
    ("bank account block", "maybe", "real"),
    ("bill due today", None, "Synthetic"),
    ("bill due today", "normal", "Synthetic"),
    ("   ", "nan", None),
]


def ids(df):
    return sorted(r["row_id"] for r in df.select("row_id").collect())


def test_quality_report(messages):
    df = messages(ROWS)
    r = quality.report(df).first().asDict()
    assert r == {"total_rows": 10, "missing_messages": 1, "empty_messages": 2, "missing_labels": 2, "invalid_labels": 1, "duplicate_rows": 4, "conflicting_keys": 1, "surviving_rows": 2}
    assert quality.report(df, "first").first()["surviving_rows"] == 3
    assert quality.report(df.limit(0)).first()["total_rows"] == 0
    assert ids(quality.remove_invalid(quality.normalize_labels(df))) == [1, 2, 3, 4, 9]


def test_dedup_policies(messages):
    valid = quality.remove_invalid(quality.normalize_labels(messages(ROWS)))
    assert ids(dedup.keep_first(valid)) == [1, 3, 9]
    assert ids(dedup.remove_duplicates(valid, "drop")) == [1, 9]
    assert ids(dedup.remove_duplicates(valid, "first")) == [1, 3, 9]
    assert ids(dedup.conflicting_rows(valid)) == [3, 4]
    assert dedup.conflict_examples(valid).first().asDict() == {"first_row_id": 3, "text": "Class is at two", "labels": "Genuine,Scam", "copies": 2}
    assert dedup.duplicate_report(valid, "drop").first().asDict() == {"duplicates_removed": 1, "conflicting_keys": 1, "conflicting_rows_removed": 2, "rows_left": 2}
    assert dedup.duplicate_report(valid, "first").first()["duplicates_removed"] == 2
    assert set(dedup.keep_first(valid).columns) == set(valid.columns)
    assert dedup.keep_first(valid.limit(0)).count() == 0


def test_flag_duplicates_counts_missing(messages):
    flagged = {r["row_id"]: r["is_duplicate"] for r in dedup.flag_duplicates(messages([(None, None, None), (None, None, None), ("a", None, None)])).collect()}
    assert flagged == {1: False, 2: True, 3: False}


@pytest.fixture()
def corpus(spark):
    texts = ["free prize win", "prize claim free", "win win lottery", "class exam today", "exam bill due", "class meeting today", "bill paid today", "lottery claim now"]
    rows = [(i, t, "Scam" if i in (1, 2, 3, 8) else "Genuine", "train" if i < 7 else "test") for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "row_id bigint, cleaned_msg string, status string, split string")


def test_tfidf_formulas(corpus):
    train, test = corpus.where("split = 'train'"), corpus.where("split = 'test'")
    vocab = features.vocabulary(train)
    idf = {r["term"]: r["idf"] for r in vocab.collect()}
    assert math.isclose(idf["prize"], math.log(7 / 3) + 1)
    assert "win win" in idf and "paid" not in idf
    weights = features.weights(test, vocab).collect()
    for row_id in {r["row_id"] for r in weights}:
        assert math.isclose(sum(r["weight"] ** 2 for r in weights if r["row_id"] == row_id), 1)
    single = features.weights(train.where("row_id = 3"), vocab, Settings(ngrams=1)).collect()
    raw = {"win": (1 + math.log(2)) * idf["win"], "lottery": idf["lottery"]}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert {r["term"]: round(r["weight"], 9) for r in single} == {k: round(x / norm, 9) for k, x in raw.items()}
    index = [r["term"] for r in features.vocabulary(train, index=True).orderBy("idx").collect()]
    assert index == sorted(index)
    assert features.vocabulary(train, Settings(min_df=2)).where("df < 2").count() == 0
    assert features.weights(test, vocab.limit(0)).count() == 0


def test_naive_bayes(corpus):
    train, test = corpus.where("split = 'train'"), corpus.where("split = 'test'")
    model = bayes.fit(train)
    theta = model.theta
    sums = theta.agg(F.sum(F.exp("theta_scam")), F.sum(F.exp("theta_genuine"))).first()
    assert math.isclose(sums[0], 1) and math.isclose(sums[1], 1)
    got = {r["row_id"]: r["prediction"] for r in bayes.predict(test, model).collect()}
    assert got == {7: "Genuine", 8: "Scam"}
    fresh = test.sparkSession.createDataFrame([(1, "claim your prize"), (2, "zqxvjk"), (3, None), (4, ""), (5, "x" * 2001), (6, "!!!")], "row_id bigint, msg string")
    out = {r["row_id"]: (r["status"], r["prediction"]) for r in score(fresh, model).collect()}
    assert out == {1: (200, "Scam"), 2: (422, None), 3: (400, None), 4: (400, None), 5: (400, None), 6: (400, None)}


def test_model_checks_and_folds(corpus):
    model = bayes.fit(corpus)
    bayes.check_model(model)
    with pytest.raises(ValueError, match="terms"):
        bayes.check_model(replace(model, theta=model.theta.limit(2)))
    with pytest.raises(ValueError, match="label"):
        bayes.check_model(replace(model, prior=bayes.priors(corpus.limit(0))))
    scores = bayes.cross_validate(corpus, 2)
    assert scores.count() == 2
    summary = bayes.fold_summary(scores).first()
    assert summary["low"] <= summary["mean"] <= summary["high"]


def test_written_labels_conflict(messages):
    df = messages([("A b", "scam", None), ("a b ", "Scam", None), ("a  b", "ham", None), (None, "x", None), (None, "y", None), (" ", None, None)])
    assert ids(dedup.raw_conflicts(df)) == [1, 2, 4, 5]
    assert ids(dedup.blank_rows(df)) == [4, 5, 6]


def test_split_is_exact_and_seeded(spark):
    df = spark.range(1, 101).select(F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "Scam").otherwise("Genuine").alias("status"))
    got = split.stratified(df).groupBy("status", "split").count().collect()
    assert {(r["status"], r["split"]): r["count"] for r in got} == {("Scam", "train"): 40, ("Scam", "test"): 10, ("Genuine", "train"): 40, ("Genuine", "test"): 10}
    assert split.stratified(df).exceptAll(split.stratified(df.repartition(7))).isEmpty()
    assert not split.stratified(df).exceptAll(split.stratified(df, seed=7)).isEmpty()
    one = spark.range(1, 239).select(F.col("id").alias("row_id"), F.when(F.col("id") <= 131, "Genuine").otherwise("Scam").alias("status"))
    assert {(r["status"], r["n_train"], r["n_test"]) for r in split.quotas(one).collect()} == {("Genuine", 105, 26), ("Scam", 85, 22)}
    assert split.stratified(df.limit(0)).count() == 0


def test_folds(spark):
    df = spark.range(1, 24).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "Scam").otherwise("Genuine").alias("status"))
    got = split.folds(df, 5)
    assert got.count() == 23 and got.select("row_id").distinct().count() == 23
    sizes = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_overlap(corpus, spark):
    df = spark.createDataFrame([(1, "a", "train"), (2, "a", "test"), (3, "b", "test"), (4, None, "test"), (5, None, "train")], "row_id bigint, cleaned_msg string, split string")
    assert split.overlap(df).first().asDict() == {"n_test": 3, "n_overlap": 1, "percent": 33.33}
    assert split.overlap(df.limit(0)).first().asDict() == {"n_test": 0, "n_overlap": 0, "percent": 0.0}


def test_rules(spark):
    df = spark.createDataFrame([(1, "URGENT: verify otp, winner! bank click payment"), (2, "hello"), (3, None), (4, "bankrupt")], "row_id int, msg string")
    s = rules.risk_score(F.col("msg"))
    assert [tuple(r) for r in df.orderBy("row_id").select(s, rules.risk_level(s)).collect()] == [(120, "CRITICAL"), (0, "LOW"), (0, "LOW"), (20, "LOW")]
    assert df.where("row_id = 4").select(rules.keyword_hits(F.col("msg"))).first()[0] == {"bank": ["bank"]}
    v = spark.createDataFrame([("Scam", "Scam", "Genuine"), ("Genuine", None, "Scam")], "a string, b string, c string")
    assert [(r["scam_votes"], r["prediction"], round(r["confidence"])) for r in rules.ensemble(v, "a", "b", "c").collect()] == [(2, "Scam", 67), (1, "Genuine", 67)]


@pytest.mark.parametrize(("body", "want"), [('{"message": "hi"}', "hi"), ('{"message": 5}', None), ('["message"]', None), ("not json", None), ('{"other": "x"}', None), (None, None)])
def test_request_bodies(spark, body, want):
    df = spark.createDataFrame([(body,)], "body string")
    assert df.select(rules.parse_body(F.col("body"))).first()[0] == want


def test_metrics(spark):
    rows = [("Scam", "Scam", 0.9), ("Scam", "Genuine", 0.4), ("Genuine", "Genuine", 0.4), ("Genuine", "Genuine", 0.1), (None, "Scam", 0.5), ("Scam", None, None)]
    df = spark.createDataFrame(rows, "status string, prediction string, score double")
    assert metrics.confusion(df).first().asDict() == {"tp": 1, "fp": 0, "fn": 1, "tn": 2}
    assert metrics.scores(df).first().asDict() == {"accuracy": 0.75, "precision": 1.0, "recall": 0.5, "f1": 2 / 3}
    assert metrics.auc_by_rank(df).first()["auc"] == 0.875
    assert math.isclose(metrics.auc_by_trapezoid(df).first()["auc"], 0.875)
    assert metrics.scores(df.limit(0)).first().asDict() == {"accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    assert metrics.comparison({"a": df, "b": df}).orderBy("rank").first()["model"] == "a"


def test_scan_log(spark):
    rows = [(1, "Scam", 80.0, "2024-03-01T07:56:00+05:00"), (1, "Scam", 80.0, "2024-03-01T07:56:00+05:00"), (2, "Genuine", None, "2024-03-01T01:00:00.5"), (0, "Odd", 120.0, "soon")]
    log = spark.createDataFrame(rows, "id bigint, prediction string, confidence double, scanned_at string")
    assert scanlog.validate(log).first().asDict() == {"n": 4, "bad_id": 1, "repeated_id": 1, "bad_prediction": 1, "bad_confidence": 1, "bad_time": 1}
    good = log.where("id > 0")
    assert scanlog.summary(good).first().asDict() == {"total": 2, "scam": 1, "authentic": 1, "scam_percent": 50.0, "authentic_percent": 50.0}
    assert [r["id"] for r in scanlog.recent(good).orderBy("place").collect()] == [2, 1]
    assert {r["id"]: r["shown"] for r in scanlog.display(good).collect()} == {1: "80.0%", 2: "Unavailable"}
    assert scanlog.summary(log.limit(0)).first().asDict() == {"total": 0, "scam": 0, "authentic": 0, "scam_percent": 0.0, "authentic_percent": 0.0}
    new = spark.createDataFrame([(7, "b"), (3, "a")], "k bigint, v string")
    assert {r["v"]: r["id"] for r in scanlog.next_ids(good, new, "k").collect()} == {"a": 3, "b": 4}
    assert {r["v"]: r["id"] for r in scanlog.next_ids(log.limit(0), new, "k").collect()} == {"a": 1, "b": 2}


def test_statistics_of_empty(messages):
    empty = messages([]).withColumn("cleaned_msg", F.lit(None).cast("string"))
    assert stats.statistics(empty).first()["total"] == 0
    assert stats.word_count_histogram(empty).count() == 0
    assert stats.top_words(empty).count() == 0
    assert dedup.template_groups(empty).first().asDict() == {"unique_texts": 0, "duplicate_rows": 0, "groups": 0, "largest": 0}


def test_pipeline(messages):
    rows = [(f"win prize number {i} now", "Scam", "Real") for i in range(20)] + [(f"class exam room {i} today {i % 7}", "ham", "generated") for i in range(20)] + ROWS
    p = Pipeline(messages(rows), Settings(strict=False))
    report = p.report().first().asDict(recursive=True)
    assert report["validation"]["total_rows"] == 50
    assert report["statistics"]["total"] == p.cleaned.count()
    assert p.split.count() == p.cleaned.count()
    strict = Pipeline(messages(rows), Settings(strict=True))
    assert strict.report().first()["templates"]["duplicate_rows"] == 0
    assert strict.report().first()["overlap"]["n_overlap"] == 0


@pytest.mark.parametrize(("name", "costs"), [("lr_cv", (0.001, 0.01, 0.1, 1.0, 10.0)), ("svm_linear", (0.1, 1.0, 10.0))])
def test_registered_models_search_the_whole_grid(spark, sf, monkeypatch, name, costs):
    from paigham.plans import registry

    class Seen(Exception):
        pass

    def tuned(data, size, searched=None, k=5, kind="logistic", iterations=1000):
        raise Seen(searched, k, iterations, data.select("fold").distinct().count(), size)

    monkeypatch.setattr(models, "tune", tuned)
    with pytest.raises(Seen) as seen:
        registry.queries()[name](spark, sf)
    searched, k, iterations, n_folds, size = seen.value.args
    assert searched == costs and k == n_folds == 5 and iterations == 1000 and size > 10


@pytest.fixture()
def points(spark):
    """Rows of six features, two of them telling, and a row without any."""
    import random

    r = random.Random(2)
    rows = []
    for i in range(240):
        x = {k: r.random() for k in range(6) if r.random() < 0.6}
        rows.append((i, float(x.get(0, 0) - x.get(1, 0) + r.gauss(0, 0.3) > 0), i % 3, sorted(x), [x[k] for k in sorted(x)]))
    return spark.createDataFrame([*rows, (999, 1.0, 0, [], [])], "row_id bigint, label double, fold int, i array<int>, v array<double>").repartition(5)


@pytest.mark.parametrize("kind", ["logistic", "hinge"])
def test_models_in_step_are_each_at_their_minimum(points, kind):
    import numpy as np

    costs, fold = np.array([0.1, 0.1, 5.0]), np.array([-1, 1, 2])
    weights = models.minimized(points, 6, costs, fold, kind, tolerance=1e-5)
    rows = points.collect()
    x = np.zeros((len(rows), 7))
    for at, r in enumerate(rows):
        x[at, r.i], x[at, 6] = r.v, 1
    side, folds = np.array([2 * r.label - 1 for r in rows]), np.array([r.fold for r in rows])

    def objective(w, c, f):
        loss, _ = models._loss((x @ w * side)[folds != f], kind)
        return (w[:6] @ w[:6]) / 2 / c + loss.sum()

    random = np.random.default_rng(1)
    for w, c, f in zip(weights, costs, fold, strict=True):
        least = objective(w, c, f)
        assert all(objective(w + random.normal(0, s, 7), c, f) >= least - 1e-3 for s in (0.5, 0.05, 0.01) for _ in range(50))


def test_tuned_models(points):
    tuned = models.tune(points, 6, k=3)
    assert tuned.cost in models.GRID and {c: len(s) for c, s in tuned.scores.items()} == dict.fromkeys(models.GRID, 3)
    got = models.predictions(tuned, points).collect()
    assert sum(r.status == r.prediction for r in got) / len(got) > 0.8 and all((r.score > 0.5) == (r.prediction == "Scam") for r in got)
    empty = models.tune(points.limit(0), 6, costs=(1.0,), k=2)
    assert not empty.weights.any()
    with pytest.raises(ValueError, match="max_features"):
        models.tune(points, models.MOST_WEIGHTS)


def test_vectors_keep_rows_without_terms(corpus):
    vocab = features.vocabulary(corpus, index=True)
    got = models.vectors(corpus.unionByName(corpus.limit(1).withColumns({"row_id": F.lit(99).cast("bigint"), "cleaned_msg": F.lit(None).cast("string")})), features.weights(corpus, vocab), vocab, "split").collect()
    assert len(got) == 9 and all(list(r.i) == sorted(r.i) and len(r.i) == len(r.v) for r in got)
    assert next(r for r in got if r.row_id == 99).i == [] and {r.label for r in got} == {0.0, 1.0}


def test_ranges_give_what_one_window_gives(spark):
    import random

    r = random.Random(4)
    rows = [(r.choice(["Scam", "Genuine"]), "Scam", r.choice([round(r.random(), 2), r.random()])) for _ in range(700)]
    df = spark.createDataFrame(rows, "status string, prediction string, score double")
    assert sorted(map(tuple, metrics.roc_points(df).collect()), key=repr) == sorted(map(tuple, metrics.roc_points(df, 0).collect()), key=repr)
    assert math.isclose(metrics.auc_by_rank(df).first()[0], metrics.auc_by_rank(df, 0).first()[0])
    better = sum((a > b) + (a == b) / 2 for s, _, a in rows if s == "Scam" for t, _, b in rows if t == "Genuine")
    want = better / (sum(s == "Scam" for s, *_ in rows) * sum(s == "Genuine" for s, *_ in rows))
    assert math.isclose(metrics.auc_by_rank(df, 0).first()[0], want) and math.isclose(metrics.auc_by_trapezoid(df, 0).first()[0], want)
    assert metrics.roc_points(df.limit(0)).count() == 1 and metrics.auc_by_rank(df.limit(0)).first()[0] == 0.0


def test_ranks_in_levels(spark):
    ids = [i * i * 7 % 100_003 for i in range(900)]
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in set(ids)], "row_id bigint, __m string")
    for bucket in (4096, 10, 2):
        got = ranks.ranked(df, "row_id", bucket=bucket).collect()
        assert [x.rank for x in sorted(got, key=lambda x: x.row_id)] == list(range(len(set(ids)))) and got[0].asDict().keys() == {"row_id", "__m", "rank"}
        within = ranks.ranked(df.withColumnRenamed("__m", "status"), "row_id", ("status",), "r", bucket).collect()
        for s in "ab":
            assert [x.r for x in sorted((x for x in within if x.status == s), key=lambda x: x.row_id)] == list(range(sum(x.status == s for x in within)))


def test_split_falls_back_and_is_checked(spark):
    data = [(i, "Scam" if i else "Genuine") for i in range(20)]
    df = spark.createDataFrame(data, "row_id bigint, status string")
    got = split.train_test(df)
    split.check_split(got)
    assert {x["split"]: x["count"] for x in got.groupBy("split").count().collect()} == {"train": 16, "test": 4}
    even = df.withColumn("status", F.when(F.col("row_id") % 2 == 0, "Scam").otherwise("Genuine"))
    assert split.train_test(even).exceptAll(split.stratified(even)).isEmpty()
    for bad in (got.where("split = 'train'"), got.unionByName(got.withColumn("split", F.lit("test"))), got.withColumn("split", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="not a split"):
            split.check_split(bad)
    assert split.train_test(df.limit(0)).count() == 0


def test_scans_are_appended_with_ids_and_a_stamp(spark):
    from datetime import datetime, timedelta, timezone

    log = spark.createDataFrame([(5, "Scam", 1.0, "x")], "id bigint, prediction string, confidence double, scanned_at string")
    new = spark.createDataFrame([(9, "Scam", 80.0, "z"), (2, "Genuine", None, "z")], "k bigint, prediction string, confidence double, more string")
    now = datetime(2024, 3, 1, 5, 0, 0, 250, timezone(timedelta(hours=5)))
    got = scanlog.append_scans(log, new, "k", now).orderBy("id").collect()
    assert [tuple(x) for x in got] == [(6, "Genuine", None, "2024-03-01T00:00:00.000250+00:00"), (7, "Scam", 80.0, "2024-03-01T00:00:00.000250+00:00")]
    shown = spark.createDataFrame([("2024-03-01T00:00:00Z",), ("soon",)], "t string").select(scanlog.in_zone(F.col("t"), "Asia/Karachi")).collect()
    assert [x[0] for x in shown] == ["2024-03-01 05:00", None]


def test_mean_over_models(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 1.0), ("c", None)], "model string, f1 double")
    assert metrics.mean_over_models(rows).first().asDict() == {"mean_f1": 0.75, "n_models": 2}
