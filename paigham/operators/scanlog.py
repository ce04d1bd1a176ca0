"""The scan log: validation, ids, summaries and what a dashboard shows.

``(id, prediction, confidence, scanned_at)``; times without offset mean UTC; whole rows that were
written twice count once in summaries; unparseable times sort first; an empty log gives zeros.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paigham.operators import ranks

SCAM, GENUINE = "Scam", "Genuine"
RECENT = 20


def micros(c: Column) -> Column:
    """Microseconds since 1970 of an ISO time; naive is UTC whatever the session's zone; null if it is none."""
    zoned = c.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$")
    return F.unix_micros(F.try_to_timestamp(F.when(zoned, c).otherwise(F.concat(c, F.lit("+00:00")))))


def once(log: DataFrame) -> DataFrame:
    return log.select("id", "prediction", "confidence", "scanned_at").distinct()


def validate(log: DataFrame) -> DataFrame:
    """One row: how many records break each rule."""
    c = F.col("confidence")
    return log.agg(
        F.count("*").alias("n"), F.count_if(F.col("id").isNull() | (F.col("id") < 1)).alias("bad_id"), (F.count("id") - F.count_distinct("id")).alias("repeated_id"),
        F.count_if(~F.coalesce(F.col("prediction").isin(SCAM, GENUINE), F.lit(False))).alias("bad_prediction"),
        F.count_if(c.isNotNull() & (F.isnan(c) | ~c.between(0, 100))).alias("bad_confidence"), F.count_if(micros(F.col("scanned_at")).isNull()).alias("bad_time"),
    )


def summary(log: DataFrame, digits: int | None = 1) -> DataFrame:
    """One row: records, of each label, and their percents (rounded half to even, or not at all)."""
    n, scam = F.count("*"), F.count_if(F.col("prediction") == SCAM)
    percent = lambda part: F.when(n > 0, part / n * 100).otherwise(0.0)
    shown = lambda c: c if digits is None else F.bround(c, digits)
    return once(log).agg(n.alias("total"), scam.alias("scam"), (n - scam).alias("authentic"), shown(percent(scam)).alias("scam_percent"), shown(percent(n - scam)).alias("authentic_percent"))


def recent(log: DataFrame, n: int = RECENT) -> DataFrame:
    """The ``n`` latest records by time and id, with their place from the oldest of them."""
    timed = once(log).withColumn("at", micros(F.col("scanned_at")))
    last = timed.orderBy(F.desc("at"), F.desc("id")).limit(n)
    return last.withColumn("place", F.row_number().over(W.partitionBy().orderBy("at", "id"))).select("place", "id", "prediction", "confidence", "at")


def display(log: DataFrame, n: int = RECENT) -> DataFrame:
    """What the dashboard shows of the latest records, newest first: label, percent, place on the chart."""
    last = recent(log, n)
    count = F.count("*").over(W.partitionBy())
    x = F.when(count == 1, 310.0).otherwise(55 + (F.col("place") - 1) * 505.0 / (count - 1))
    label = F.when(F.col("prediction") == GENUINE, "Authentic").otherwise(F.col("prediction"))
    shown = F.when(F.col("confidence").isNull(), "Unavailable").otherwise(F.format_string("%.1f%%", F.col("confidence")))
    return last.select("id", label.alias("label"), shown.alias("shown"), x.alias("x"), (195 - F.col("confidence") * 1.65).alias("y"), (count - F.col("place") + 1).alias("row"))


def donut(log: DataFrame) -> DataFrame:
    """Arcs of the shares: offset and length in percent, Scam first."""
    per = once(log).groupBy(F.when(F.col("prediction") == SCAM, SCAM).otherwise("Authentic").alias("label")).agg(F.count("*").alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(W.partitionBy())
    sized = per.select("label", "n", share.alias("length"), F.when(F.col("label") == SCAM, 0).otherwise(1).alias("o"))
    return sized.select("label", "n", "length", F.coalesce(F.sum("length").over(W.partitionBy().orderBy("o").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("offset"))


def next_ids(log: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New records with ids after the largest there is, in order of ``order``, a column of whole numbers.

    A single writer is assumed, as concurrent ones would need a transactional sink.
    """
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__next_id_top"))
    placed = ranks.ranked(new, order, name="__next_id_rank")
    return placed.crossJoin(F.broadcast(top)).withColumn("id", F.col("__next_id_top") + F.col("__next_id_rank") + 1).drop("__next_id_rank", "__next_id_top")


def append_scans(log: DataFrame, scans: DataFrame, order: str, now: datetime | None = None) -> DataFrame:
    """Records ready to be appended: the next ids and one UTC stamp with microseconds, ``(id, prediction, confidence, scanned_at)``."""
    stamp = (now or datetime.now(UTC)).astimezone(UTC).isoformat(timespec="microseconds")
    return next_ids(log, scans.select(order, "prediction", "confidence"), order).select("id", "prediction", "confidence", F.lit(stamp).alias("scanned_at"))


def in_zone(c: Column, zone: str, form: str = "yyyy-MM-dd HH:mm") -> Column:
    """An ISO time as it is shown in another zone."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_micros(micros(c)).cast("timestamp_ntz")), form)


def export_rows(log: DataFrame) -> DataFrame:
    """Date and time of day of each record apart, as they are exported."""
    at = F.timestamp_micros(micros(F.col("scanned_at")))
    return once(log).select("id", F.date_format(at, "yyyy-MM-dd").alias("day"), F.date_format(at, "HH:mm:ss.SSSSSS").alias("time"), F.date_format(at, "HH:mm").alias("short_time"), "prediction", "confidence")


def tracker_summary(tracker: DataFrame) -> DataFrame:
    """One row: checked messages, of each label, unrounded percents."""
    n, scam = F.count("*"), F.count_if(F.col("prediction") == SCAM)
    percent = lambda part: F.when(n > 0, part / n * 100).otherwise(0.0)
    return tracker.agg(n.alias("total_checked"), scam.alias("scam_count"), (n - scam).alias("genuine_count"), percent(scam).alias("scam_percent"), percent(n - scam).alias("genuine_percent"))


def tracker_tail(tracker: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` entries in order of entry."""
    last = tracker.orderBy(F.desc("track_id")).limit(n)
    return last.select("track_id", F.substring("sms", 1, 40).alias("sms"), "prediction", "confidence", "risk_level")
