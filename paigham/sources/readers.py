"""Sources: message tables, scan logs and states from files, with their checks.

A load that fails raises :class:`DatasetError` or :class:`ScanLogError` and changes no file.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paigham.operators import scanlog
from paigham.sources import worksheets

REQUIRED = ("msg", "status", "source")
SUFFIXES = (".csv", ".parquet", ".json", ".xlsx", ".xlsm")
SCAN_LOG = T.StructType([T.StructField("id", T.LongType()), T.StructField("prediction", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("timestamp", T.StringType())])
TRACKER = "track_id bigint, sms string, prediction string, confidence int, risk_level string"


class DatasetError(Exception):
    """A message table cannot be loaded."""


class ScanLogError(Exception):
    """A scan log cannot be read or breaks its rules."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with header; cells may be quoted and hold line breaks."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def _excel(spark: SparkSession, path: str, sheet: str | None) -> DataFrame:
    """A worksheet as text columns named by its first row. Worksheets have 1,048,576 rows at most, by their format."""
    rows = worksheets.read(bytes(spark.sparkContext.binaryFiles(path, 1).values().first()), sheet)
    header, body = ([str(c or "") for c in rows[0]], rows[1:]) if rows else ([], [])
    if not header:
        raise DatasetError(f"{path} has no header")
    width = len(header)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.createDataFrame([tuple((r + [None] * width)[:width]) for r in body], schema)


def load_messages(spark: SparkSession, path: str, sheet: str | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """The required columns of a message table, in order; checked are path, kind of file, readability and columns."""
    if not _exists(spark, path):
        raise DatasetError(f"no such file: {path}")
    suffix = Path(path).suffix.lower()
    if suffix not in SUFFIXES:
        raise DatasetError(f"not a kind of file that can be read: {suffix}")
    try:
        if suffix == ".csv":
            df = read_csv(spark, path)
        elif suffix == ".parquet":
            df = spark.read.parquet(path)
        elif suffix == ".json":
            df = spark.read.option("multiLine", True).json(path)
        else:
            df = _excel(spark, path, sheet)
    except DatasetError:
        raise
    except worksheets.NoSheet as e:
        raise DatasetError(f"no worksheet {e} in {path}") from e
    except Exception as e:
        raise DatasetError(f"cannot read {path}: {e}") from e
    for old, new in (rename or {}).items():
        df = df.withColumnRenamed(old, new)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise DatasetError(f"missing columns: {', '.join(missing)}")
    return df.select(*(["row_id"] if "row_id" in df.columns else []), *REQUIRED)


def from_rows(spark: SparkSession, messages: list[str] | str) -> DataFrame:
    """Messages of a list, or one message, as a table."""
    listed = [messages] if isinstance(messages, str) else list(messages)
    return spark.createDataFrame(list(enumerate(listed, 1)), "row_id bigint, msg string")


def load_scan_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, each exactly ``id, prediction, confidence, timestamp``; none for a missing or blank file."""
    empty = spark.createDataFrame([], SCAN_LOG)
    if not _exists(spark, path):
        return empty
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\x{feff}", "").alias("value"))
    if text.where(F.trim("value") != "").isEmpty():
        return empty
    if not text.where(F.try_parse_json("value").isNull() | ~F.rtrim("value").endswith("]")).isEmpty():
        raise ScanLogError(f"{path} is not one JSON array")
    try:
        records = text.select(F.explode(F.from_json("value", "array<map<string,variant>>", {"mode": "FAILFAST"})).alias("r"))
        kind = lambda k: F.schema_of_variant(F.col("r")[k])
        number = ("BIGINT", "DOUBLE")
        get = lambda k, t: F.try_variant_get(F.col("r")[k], "$", t)
        right = (
            (F.array_sort(F.map_keys("r")) == F.array(*map(F.lit, ("confidence", "id", "prediction", "timestamp"))))
            & (kind("id") == "BIGINT") & (get("id", "bigint") >= 1)
            & (kind("prediction") == "STRING") & get("prediction", "string").isin("Scam", "Genuine")
            & (get("confidence", "string").isNull() | ((kind("confidence").isin(*number) | kind("confidence").startswith("DECIMAL")) & get("confidence", "double").between(0, 100)))
            & (kind("timestamp") == "STRING") & scanlog.micros(get("timestamp", "string")).isNotNull()
        )
        bad = records.agg(F.count_if(~F.coalesce(right, F.lit(False))).alias("bad"), (F.count("*") - F.count_distinct(get("id", "bigint"))).alias("again")).first()
    except Exception as e:
        raise ScanLogError(f"cannot read {path}") from e
    if bad["bad"] or bad["again"]:
        raise ScanLogError(f"{path}: {bad['bad']} records break the rules, {bad['again']} ids are repeated")
    return records.select(get("id", "bigint").alias("id"), get("prediction", "string").alias("prediction"), get("confidence", "double").alias("confidence"), get("timestamp", "string").alias("timestamp"))


def load_tracker(spark: SparkSession, path: str) -> DataFrame:
    """The tracker's entries; none where there is no state yet."""
    return spark.read.schema(TRACKER).json(path) if _exists(spark, path) else spark.createDataFrame([], TRACKER)
