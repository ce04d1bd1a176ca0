"""Duplicates of messages: keep first, policies for conflicting labels, templates.

A group's first row and its labels come from aggregates with partial sums, and rows find their
group by a join that adaptive execution can split: no task has to sort a hot group. Ties go to the
smallest ``row_id``; texts equal as keys are one group whatever else differs; nulls form the group
of the text ``nan``; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paigham.functions.text import duplicate_key, strip


def _groups(df: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    keyed = df.select("row_id", "status", key.alias("_key"))
    groups = keyed.groupBy("_key").agg(F.min("row_id").alias("_first"), F.count("*").alias("_n"), F.coalesce(F.min("status") != F.max("status"), F.lit(False)).alias("_conflict"))
    return keyed, groups


def keep_first(df: DataFrame, key: Column | None = None) -> DataFrame:
    """One row per key, the one with the smallest ``row_id``."""
    _, groups = _groups(df, duplicate_key(F.col("msg")) if key is None else key)
    return df.join(groups.select(F.col("_first").alias("row_id")), "row_id", "left_semi")


def remove_duplicates(df: DataFrame, policy: str = "drop", key: Column | None = None) -> DataFrame:
    """One row per key. ``drop``: no row of keys with two labels; ``first``: their first row stays."""
    _, groups = _groups(df, duplicate_key(F.col("msg")) if key is None else key)
    kept = groups if policy == "first" else groups.where(~F.col("_conflict"))
    return df.join(kept.select(F.col("_first").alias("row_id")), "row_id", "left_semi")


def duplicate_report(df: DataFrame, policy: str = "drop", key: Column | None = None) -> DataFrame:
    """One row: duplicates removed, conflicting keys, their rows removed, rows left."""
    _, groups = _groups(df, duplicate_key(F.col("msg")) if key is None else key)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    clash = F.col("_conflict")
    removed = F.col("_n") - 1 if policy == "first" else F.when(clash, 0).otherwise(F.col("_n") - 1)
    return groups.agg(
        total(removed).alias("duplicates_removed"), F.count_if(clash).alias("conflicting_keys"),
        (F.lit(0).cast("bigint") if policy == "first" else total(F.when(clash, F.col("_n")).otherwise(0))).alias("conflicting_rows_removed"),
        (F.count("*") if policy == "first" else F.count_if(~clash)).alias("rows_left"),
    )


def flag_duplicates(df: DataFrame, key: Column | None = None) -> DataFrame:
    """``(row_id, is_duplicate)``: all rows of a key but its first."""
    keyed, groups = _groups(df, duplicate_key(F.col("msg")) if key is None else key)
    firsts = groups.select(F.col("_first").alias("row_id"), F.lit(True).alias("_is_first"))
    return keyed.select("row_id").join(firsts, "row_id", "left").select("row_id", F.col("_is_first").isNull().alias("is_duplicate"))


def conflict_examples(df: DataFrame, most: int = 10, length: int = 160) -> DataFrame:
    """The first conflicting keys: their first text, their labels and copies."""
    keyed = df.select("row_id", "msg", "status", duplicate_key(F.col("msg")).alias("_key"))
    groups = keyed.groupBy("_key").agg(F.min("row_id").alias("first_row_id"), F.min_by(F.substring("msg", 1, length), "row_id").alias("text"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("labels"), F.count_distinct("status").alias("k"), F.count("*").alias("copies"))
    return groups.where("k > 1").orderBy("first_row_id").limit(most).select("first_row_id", "text", "labels", "copies")


def conflicting_rows(df: DataFrame) -> DataFrame:
    """All rows of keys with two labels."""
    keyed, groups = _groups(df, duplicate_key(F.col("msg")))
    return df.join(keyed.join(groups.where("_conflict").select("_key"), "_key", "left_semi").select("row_id"), "row_id", "left_semi")


def template_groups(df: DataFrame) -> DataFrame:
    """One row on equal cleaned texts: unique texts, rows beyond the first, groups of several, the largest."""
    groups = df.groupBy("cleaned_msg").agg(F.count("*").alias("n"))
    return groups.agg(F.count("*").alias("unique_texts"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.max(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("largest"))


def largest_template(df: DataFrame, members: int = 5) -> DataFrame:
    """The first members of the largest group of equal cleaned texts."""
    top = df.where("cleaned_msg is not null").groupBy("cleaned_msg").agg(F.count("*").alias("copies"), F.min("row_id").alias("f")).orderBy(F.desc("copies"), "f").limit(1)
    return df.join(F.broadcast(top), "cleaned_msg").orderBy("row_id").limit(members).select("row_id", "cleaned_msg", "copies")


def raw_conflicts(df: DataFrame) -> DataFrame:
    """Rows of texts, stripped and lower-cased only, that carry two labels as they are written."""
    key = F.lower(strip(F.coalesce(F.col("msg"), F.lit("nan"))))
    keyed = df.select("row_id", "status", key.alias("_key"))
    clash = keyed.groupBy("_key").agg(F.coalesce(F.min("status") != F.max("status"), F.lit(False)).alias("_c")).where("_c").select("_key")
    return df.join(keyed.join(clash, "_key", "left_semi").select("row_id"), "row_id", "left_semi")


def blank_rows(df: DataFrame) -> DataFrame:
    """Rows whose message is missing or blank."""
    return df.where(F.col("msg").isNull() | (strip(F.col("msg")) == ""))
