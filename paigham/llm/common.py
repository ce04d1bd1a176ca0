"""What several of the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Maximal runs of letters and digits, the words of TESTDATA.md (after lower-casing).
WORD = r"[\p{L}\p{N}]+"


def width(spark: SparkSession, times: int = 1) -> int:
    """Partitions for work keyed on hashed groups: a multiple of the session's shuffle partitions."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) * times)


def has_text(c: Column) -> Column:
    """Not null, empty or blank (any Unicode white space)."""
    return F.coalesce(c.rlike(r"(?U)[^\s\x1c-\x1f\x{200b}\x{feff}]"), F.lit(False))


def words(c: Column) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def word_hashes(c: Column) -> Column:
    """64-bit hashes of the words in order."""
    return F.transform(words(c), lambda w: F.xxhash64(w))


def key128(c: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text: equal texts, equal keys; others differ but with chance 2^-128."""
    return F.xxhash64(c), F.xxhash64(F.lit(0x5EED), c)
