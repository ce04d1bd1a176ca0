"""Sinks: prepared tables, vocabularies, models and logs.

Appends are seen whole or not at all, and so are files written by :func:`write_json`, which takes the
place of the old file in one step. Overwriting a table deletes the old one first, and while
:func:`compact` swaps folders the log is absent for the moment between two renames; if the second
fails the old log is put back.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paigham.sources.readers import TRACKER


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


#: Columns of the prepared table and of its parts, in the order in which they are written.
PREPARED, PARTS = ("msg", "cleaned_msg", "status", "source"), ("msg", "cleaned_msg", "status")


def write_splits(df: DataFrame, path: str) -> None:
    """Train and test rows in folders of their own."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_split_csv(df: DataFrame, folder: str) -> dict[str, str]:
    """Train and test rows as CSV, with the message as it was."""
    paths = {part: f"{folder}/{part}.csv" for part in ("train", "test")}
    for part, path in paths.items():
        write_csv(df.where(F.col("split") == part).select(*PARTS), path)
    return paths


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A JSON file: written beside its place, then put there in one step; numbers must be finite."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    content = json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False).encode()
    context, fs = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), conf), beside.getFileSystem(conf)
    try:
        out = fs.create(beside, True)
        out.write(bytearray(content))
        out.hsync()
        out.close()
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(beside, target, options)
    finally:
        fs.delete(beside, False)


def reset_tracker(spark: SparkSession, path: str) -> None:
    """The tracker's state of before the first entry."""
    spark.createDataFrame([], TRACKER).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Records are appended by the commit protocol: readers see all of them or none."""
    df.write.mode("append").parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def compact(spark: SparkSession, path: str, files: int = 1) -> None:
    """A log in few files: written beside it, then put in its place; the old one stays if that fails."""
    new, old = f"{path}-new-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    spark.read.parquet(path).coalesce(files).write.parquet(new)
    here, fs = _fs(spark, path)
    there = _fs(spark, new)[0]
    aside = _fs(spark, old)[0]
    if not fs.rename(here, aside):
        fs.delete(there, True)
        raise OSError(f"cannot move {path}")
    if not fs.rename(there, here):
        fs.rename(aside, here)
        raise OSError(f"cannot replace {path}")
    fs.delete(aside, True)


def report_json(report: DataFrame) -> str:
    """A one-row report as JSON; letters of any script stay as they are."""
    return json.dumps(json.loads(report.select(F.to_json(F.struct("*"))).first()[0]), ensure_ascii=False, indent=2)


def export_csv(df: DataFrame, folder: str, now: datetime | None = None) -> str | None:
    """A CSV export named after the time; nothing is written for an empty table."""
    if df.isEmpty():
        return None
    path = f"{folder}/stats_export_{(now or datetime.now(UTC)):%Y%m%d_%H%M%S}.csv"
    write_csv(df, path, "errorifexists")
    return path
