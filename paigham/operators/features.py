"""TF-IDF as relations: ``(row_id, term, weight)``, a vocabulary, and its use on new texts.

Fitted on the train rows only; the norm is taken after terms outside the vocabulary are gone, and a
row without known terms has no entries. Null and empty texts have no terms; repeated rows each have
their own. Sizes of the corpus are one-row relations, so nothing is collected.

Texts are placed by row before they are taken apart, so that counting a row's terms, and taking its
norm where the vocabulary is small enough to be sent to the tasks, shuffles no postings: those are
many times the size of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paigham.config import Settings
from paigham.functions.text import runs, tokens
from paigham.storage import by_row


def terms(df: DataFrame, column: str = "cleaned_msg", n: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(row_id, term, tf)`` and the columns to carry: one- to ``n``-word terms of each text, counted where the row lies."""
    rows = by_row(df.where(F.col(column).isNotNull()).select("row_id", *carry, F.col(column).alias("_text")))
    split = rows.select("row_id", *carry, F.filter(tokens(F.col("_text")), lambda t: F.length(t) >= 2).alias("_words"))
    return split.select("row_id", *carry, F.explode(runs(F.col("_words"), n)).alias("term")).groupBy("row_id", *carry, "term").agg(F.count("*").alias("tf"))


def document_frequency(found: DataFrame) -> DataFrame:
    """``(term, df, total)``: rows and occurrences of each term."""
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def vocabulary(train: DataFrame, settings: Settings = Settings(), column: str = "cleaned_msg", index: bool = False) -> DataFrame:
    """``(term, df, idf)`` of the terms kept; with ``index``, their place in alphabetical order."""
    size = train.agg(F.count("*").alias("n_docs"))
    counted = document_frequency(terms(train, column, settings.ngrams)).crossJoin(F.broadcast(size))
    kept = counted.where((F.col("df") >= settings.min_df) & (F.col("df") <= settings.max_df * F.col("n_docs")))
    if settings.max_features:
        kept = kept.orderBy(F.desc("total"), "term").limit(settings.max_features)
    out = kept.select("term", "df", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    return out.withColumn("idx", F.row_number().over(W.partitionBy().orderBy("term")) - 1) if index else out


def raw_weights(df: DataFrame, vocab: DataFrame, settings: Settings = Settings(), column: str = "cleaned_msg", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(row_id, term, w)``, the columns to carry and those of the vocabulary: weights before they are divided by the row's norm."""
    known = terms(df, column, settings.ngrams, carry).join(vocab, "term")
    tf = F.log(F.col("tf")) + 1 if settings.sublinear_tf else F.col("tf")
    return known.withColumn("w", tf * F.col("idf")).drop("tf")


def weights(df: DataFrame, vocab: DataFrame, settings: Settings = Settings(), column: str = "cleaned_msg", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(row_id, term, weight)`` and the columns to carry: normalised weights of the known terms of each row."""
    raw = raw_weights(df, vocab.select("term", "idf"), settings, column, carry)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("row_id")))
    return raw.select("row_id", *carry, "term", (F.col("w") / norm).alias("weight"))


def sparsity(df: DataFrame, vocab: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row: rows, features, entries that are not zero, and the share of those that are."""
    rows = df.agg(F.count("*").alias("n_rows"))
    features = vocab.agg(F.count("*").alias("n_features"))
    entries = terms(df, n=settings.ngrams).join(vocab.select("term"), "term", "left_semi").agg(F.count("*").alias("n_entries"))
    joined = rows.crossJoin(F.broadcast(features)).crossJoin(F.broadcast(entries))
    return joined.withColumn("sparsity", 1 - F.try_divide(F.col("n_entries"), F.col("n_rows") * F.col("n_features")))
