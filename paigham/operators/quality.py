"""Validation of a message table: one pass for all counters, one more for the keys.

Every function takes ``(row_id, msg, status, source)`` and ignores further columns. Nulls, empty
and blank texts are counted as TESTDATA-like inputs define them; an empty table gives zero counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paigham.functions import labels as L
from paigham.functions.text import duplicate_key, strip

COLUMNS = ("row_id", "msg", "status", "source")


def normalize_labels(df: DataFrame) -> DataFrame:
    """Label and source in their canonical spelling; unknown labels become null, unknown sources stay."""
    return df.withColumns({"status": L.canonical_label(F.col("status")), "source": L.canonical_source(F.col("source"))})


def flags(df: DataFrame) -> DataFrame:
    """Of each row: is the message missing or empty, the label missing or invalid."""
    msg, status = F.col("msg"), F.col("status")
    return df.select("row_id", L.is_missing_text(msg).alias("missing_msg"), L.is_empty_text(msg).alias("empty_msg"), L.is_missing_label(status).alias("missing_label"), L.is_invalid_label(status).alias("invalid_label"))


def report(df: DataFrame, conflicts: str = "drop") -> DataFrame:
    """One row: rows, missing and empty messages, missing and invalid labels, duplicates, conflicting keys, what would survive.

    Two levels: counts per duplicate key with partial sums, then their sums. Only rows with text and
    a known label count for conflicts and survivors.
    """
    msg, status = F.col("msg"), F.col("status")
    label = L.canonical_label(status)
    bad = L.is_missing_text(msg) | L.is_empty_text(msg)
    keyed = df.select(
        duplicate_key(msg).alias("key"),
        L.is_missing_text(msg).alias("m"), L.is_empty_text(msg).alias("e"), L.is_missing_label(status).alias("ml"), L.is_invalid_label(status).alias("il"),
        F.when(~bad, label).alias("label"),
    )
    per_key = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.count_if("m").alias("m"), F.count_if("e").alias("e"), F.count_if("ml").alias("ml"), F.count_if("il").alias("il"),
        F.count("label").alias("valid"), (F.coalesce(F.min("label") != F.max("label"), F.lit(False))).alias("conflict"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    survivors = F.count_if(F.col("valid") > 0) - (F.count_if("conflict") if conflicts == "drop" else F.lit(0))
    return per_key.agg(
        total("n").alias("total_rows"), total("m").alias("missing_messages"), total("e").alias("empty_messages"), total("ml").alias("missing_labels"), total("il").alias("invalid_labels"),
        (total("n") - F.count("*")).alias("duplicate_rows"), F.count_if("conflict").alias("conflicting_keys"), survivors.alias("surviving_rows"),
    )


def remove_invalid(df: DataFrame) -> DataFrame:
    """Rows of normalised labels without text or label are left out."""
    return df.where(~(L.is_missing_text(F.col("msg")) | L.is_empty_text(F.col("msg")) | L.is_bad_label(F.col("status"))))


def removal_counts(df: DataFrame) -> DataFrame:
    """One row: rows lost for each reason, counted independently, and rows left."""
    msg = F.col("msg")
    m, e, b = L.is_missing_text(msg), L.is_empty_text(msg), L.is_bad_label(F.col("status"))
    return df.agg(F.count_if(m).alias("missing"), F.count_if(e).alias("empty"), F.count_if(b).alias("bad_label"), F.count_if(~(m | e | b)).alias("kept"))


def respelled(df: DataFrame, column: str = "status") -> DataFrame:
    """Raw spellings that stood for a label in another spelling, with counts."""
    raw = F.col(column)
    label = L.canonical_label(raw) if column == "status" else L.canonical_source(raw)
    return df.where(label.isNotNull() & (label != raw)).groupBy(raw.alias("spelling"), label.alias("meaning")).agg(F.count("*").alias("n"))


def unknown_labels(df: DataFrame) -> DataFrame:
    """Raw spellings that stand for no label, with counts."""
    return df.where(L.is_invalid_label(F.col("status"))).groupBy(F.col("status").alias("spelling")).agg(F.count("*").alias("n"))


def describe(df: DataFrame) -> DataFrame:
    """Counts of labels and sources as they are written, only stripped; missing is ``nan``."""
    written = F.explode(F.array(F.struct(F.lit("status").alias("field"), F.coalesce(strip(F.col("status")), F.lit("nan")).alias("value")), F.struct(F.lit("source").alias("field"), F.coalesce(strip(F.col("source")), F.lit("nan")).alias("value"))))
    return df.select(written.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def differences(df: DataFrame, golden: DataFrame, column: str, key: str = "row_id") -> DataFrame:
    """``(key, found, wanted)`` of rows whose column differs from the golden one's, or that only one table has; nulls are equal."""
    ours = df.select(key, F.col(column).alias("found"), F.lit(True).alias("_here"))
    theirs = golden.select(key, F.col(column).alias("wanted"), F.lit(True).alias("_there"))
    joined = ours.join(theirs, key, "full")
    return joined.where(F.col("_here").isNull() | F.col("_there").isNull() | ~F.col("found").eqNullSafe(F.col("wanted"))).select(key, "found", "wanted")
