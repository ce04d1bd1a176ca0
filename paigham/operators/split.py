"""Stratified splits, folds and leakage between splits.

Ranks within a label come in levels - salts of salts, salts, rows of a salt - so that a label with any
share of the rows is many tasks' work. Ties are broken by ``row_id``; rows without label take no
part; quotas follow the largest remainders, ties by label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paigham.operators import ranks

#: Hexadecimal digits of the seeded hash that make a salt, and a salt of salts.
SALT_DIGITS, FEW_DIGITS = 4, 2


def _seeded(seed: int):
    return F.md5(F.concat_ws("-", F.lit(seed), F.col("row_id")))


def quotas(df: DataFrame, test_size: float = 0.2) -> DataFrame:
    """``(status, n, n_train, n_test)``: exact numbers per label."""
    per = df.where("status is not null").groupBy("status").agg(F.count("*").alias("n"))
    whole = W.partitionBy()
    total = F.sum("n").over(whole)
    train = total - F.ceil(total * F.lit(str(test_size)).cast("decimal(10,6)")).cast("bigint")
    sized = per.select("status", "n", total.alias("total"), train.alias("train"))
    floor = F.expr("n * train div total")
    parts = sized.select("status", "n", "train", floor.alias("base"), F.expr("n * train % total").alias("rest"))
    left = F.col("train") - F.sum("base").over(whole)
    rank = F.row_number().over(whole.orderBy(F.desc("rest"), "status"))
    got = F.col("base") + F.when(rank <= left, 1).otherwise(0)
    return parts.select("status", "n", got.alias("n_train"), (F.col("n") - got).alias("n_test"))


def stratified(df: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``(row_id, status, split)``: exact shares of each label, by seeded rank."""
    rows = df.where("status is not null").select("row_id", "status", _seeded(seed).alias("h")).withColumn("salt", F.substring("h", 1, SALT_DIGITS))
    ahead = lambda c, window: F.coalesce(F.sum(c).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # Three levels: rows of a salt (a 65,536th of a label), salts of a salt of salts, and those.
    sizes = rows.groupBy("status", "salt").agg(F.count("*").alias("m")).withColumn("few", F.substring("salt", 1, FEW_DIGITS))
    few = sizes.groupBy("status", "few").agg(F.sum("m").alias("m")).select("status", "few", ahead("m", W.partitionBy("status").orderBy("few")).alias("base"))
    offsets = sizes.join(few, ["status", "few"]).select("status", "salt", (F.col("base") + ahead("m", W.partitionBy("status", "few").orderBy("salt"))).alias("before"))
    ranked = rows.join(offsets, ["status", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("status", "salt").orderBy("h", "row_id")))
    table = quotas(df, test_size).select("status", "n_train")
    return ranked.join(table, "status").select("row_id", "status", F.when(F.col("rank") <= F.col("n_train"), "train").otherwise("test").alias("split"))


def plain(df: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """The same without regard to labels: exact shares of all rows with a label."""
    one = stratified(df.where("status is not null").select("row_id", F.lit("all").alias("status")), test_size, seed)
    return df.select("row_id", "status").join(one.select("row_id", "split"), "row_id")


def train_test(df: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """A stratified split where every label has two rows at least, and both parts one of each; else one without regard to labels."""
    per = quotas(df, test_size).agg(F.count("*").alias("labels"), F.min("n").alias("least"), F.sum("n_train").alias("train"), F.sum("n_test").alias("test")).first()
    fits = per["labels"] and per["least"] >= 2 and min(per["train"], per["test"]) >= per["labels"]
    return stratified(df, test_size, seed) if fits else plain(df, test_size, seed)


def check_split(df: DataFrame, key: str = "row_id") -> None:
    """Both parts of a split must be there, share no row and lose none."""
    sides = df.groupBy(key).agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("shared"), F.count_if(F.col("k") == 0).alias("lost")).first()
    parts = {r["split"] for r in df.where(F.col("split").isin("train", "test")).select("split").distinct().collect()}
    if sides["shared"] or sides["lost"] or parts != {"train", "test"}:
        raise ValueError(f"not a split: {sides['shared']} rows in both parts, {sides['lost']} in none, parts {sorted(parts)}")


def folds(df: DataFrame, k: int = 5) -> DataFrame:
    """``(row_id, status, fold)``: unshuffled stratified folds, contiguous within a label in order of rows.

    Labels lie end to end in order of first appearance; fold ``i`` gets as many rows of a label as
    positions of it leave remainder ``i``.
    """
    rows = df.where("status is not null").select("row_id", "status")
    per = rows.groupBy("status").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    per = per.select("status", "n", F.coalesce(F.sum("n").over(W.partitionBy().orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    grid = per.select("status", "n", "start", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    # Positions p in [start, start + n) with p mod k = fold.
    upto = lambda end: F.floor((end - 1 - F.col("fold") + k) / k)
    size = (upto(F.col("start") + F.col("n")) - upto(F.col("start"))).cast("bigint")
    ends = grid.select("status", "fold", size.alias("size")).withColumn("high", F.sum("size").over(W.partitionBy("status").orderBy("fold"))).withColumn("low", F.col("high") - F.col("size"))
    ranked = ranks.ranked(rows, "row_id", ("status",), "r")
    cond = (ranked["status"] == ends["status"]) & (F.col("r") >= F.col("low")) & (F.col("r") < F.col("high"))
    return ranked.join(ends, cond).select("row_id", ranked["status"], F.col("fold").cast("int"))


def overlap(df: DataFrame, column: str = "cleaned_msg") -> DataFrame:
    """One row: test rows, those whose text is also in train, and their percent."""
    key = F.col(column)
    train = df.where((F.col("split") == "train") & key.isNotNull()).select(key.alias("k")).distinct().withColumn("seen", F.lit(True))
    test = df.where(F.col("split") == "test").select(key.alias("k"))
    flagged = test.join(train, "k", "left")
    n, hits = F.count("*"), F.count("seen")
    return flagged.agg(n.alias("n_test"), hits.alias("n_overlap"), F.when(n > 0, F.bround(hits / n * 100, 2)).otherwise(0.0).alias("percent"))
