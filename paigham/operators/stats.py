"""Counts and distributions over message tables.

Nulls are groups of their own unless said otherwise; ties in ranks go to the word or value itself;
an empty table gives no rows, or one row of zeros where one row is promised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paigham.functions.text import tokens

GENUINE, SCAM = "Genuine", "Scam"


def value_counts(df: DataFrame, column: str, nulls: bool = False) -> DataFrame:
    """Values with their counts and the row they first appear in."""
    kept = df if nulls else df.where(F.col(column).isNotNull())
    return kept.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row_id"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Values with their counts and percent of all."""
    return value_counts(df, column).select("value", "n", (F.col("n") * 100.0 / F.sum("n").over(W.partitionBy())).alias("percent"))


def statistics(df: DataFrame) -> DataFrame:
    """One row: rows, rows of each label and of each source."""
    at = lambda column, value: F.count_if(F.col(column) == value)
    return df.agg(F.count("*").alias("total"), at("status", SCAM).alias("scam"), at("status", GENUINE).alias("genuine"), at("source", "Authentic").alias("authentic"), at("source", "Synthetic").alias("synthetic"))


def label_source_sets(df: DataFrame) -> DataFrame:
    """Counts by label, by source and in all, in one pass over grouping sets."""
    return df.groupingSets([["status"], ["source"], []], "status", "source").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")).select("status", "source", "level", "n")


def words_by_label(df: DataFrame) -> DataFrame:
    """``(status, word, n)`` of the cleaned texts."""
    return df.where("status is not null and cleaned_msg is not null").select("status", F.explode(tokens(F.col("cleaned_msg"))).alias("word")).groupBy("status", "word").agg(F.count("*").alias("n"))


def top_words(df: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent words of each label, most frequent first."""
    ranked = words_by_label(df).withColumn("rank", F.row_number().over(W.partitionBy("status").orderBy(F.desc("n"), "word")))
    return ranked.where(F.col("rank") <= k)


def top_words_side_by_side(df: DataFrame, k: int = 15) -> DataFrame:
    """The ranked words of both labels, joined by rank."""
    top = top_words(df, k)
    side = lambda label, name: top.where(F.col("status") == label).select("rank", F.col("word").alias(f"{name}_word"), F.col("n").alias(f"{name}_n"))
    return side(SCAM, "scam").join(side(GENUINE, "genuine"), "rank", "full")


def distinctive_words(df: DataFrame, of: int = 200, times: int = 4) -> DataFrame:
    """Of the most frequent words of a label those that the other label has less than a ``times``-th as often."""
    counts = words_by_label(df)
    both = counts.groupBy("word").agg(F.sum(F.when(F.col("status") == SCAM, F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(F.col("status") == GENUINE, F.col("n")).otherwise(0)).alias("g"))
    ranked = top_words(df, of).where(F.col("status").isin(SCAM, GENUINE))
    other = F.when(F.col("status") == SCAM, F.col("g")).otherwise(F.col("s"))
    return ranked.join(both, "word").where(other * times < F.col("n")).select("status", "word", "n", other.alias("n_other"), "rank")


def word_count_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """Rows per bin of the number of words, for raw and cleaned texts; bins are of equal width, the last is closed."""
    counted = df.select(F.explode(F.array(*[F.struct(F.lit(name).alias("text"), F.size(tokens(F.col(column))).alias("x")) for name, column in (("raw", "msg"), ("cleaned", "cleaned_msg"))])).alias("t")).select("t.*").where("x >= 0")
    per_size = counted.groupBy("text", "x").agg(F.count("*").alias("n"))
    ends = per_size.groupBy("text").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("x") - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1))).otherwise(F.lit(0))
    return per_size.join(F.broadcast(ends), "text").groupBy("text", at.cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def quartiles(df: DataFrame) -> DataFrame:
    """Exact quartiles of the number of words of the cleaned texts, by label."""
    counted = df.where("cleaned_msg is not null and status is not null").select("status", F.size(tokens(F.col("cleaned_msg"))).alias("x"))
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return counted.groupBy("status").agg(q.alias("q"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread")).select("status", F.element_at("q", 1).alias("q1"), F.element_at("q", 2).alias("q2"), F.element_at("q", 3).alias("q3"), "low", "high", "mean", "spread")


def summary_rows(df: DataFrame) -> DataFrame:
    """The statistics as ``(metric, value)`` rows."""
    one = statistics(df)
    return one.unpivot([], [F.col(c) for c in one.columns], "metric", "value").withColumn("value", F.col("value").cast("string"))


def sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in a seeded order of their ids: the same rows on any cluster."""
    return df.orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col("row_id"))), "row_id").limit(n)
