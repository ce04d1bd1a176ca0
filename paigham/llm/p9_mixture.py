"""Problem 9: a mixture of sources at target token shares.

Sainte-Laguë apportionment: blocks of equal token counts go one after the other to the source with
the highest quotient ``share / (2 k + 1)``, ``k`` the blocks it has, as long as its documents allow
(each at most ``max_repeats`` times). The same rule gives each source's blocks to groups of its
shards and each group's blocks to its shards, whole numbers per shard; in a shard documents are
taken in seeded order, those whose middle token lies within the quota. Shards are hashed and hold
about ``SHARD_ROWS`` documents of the largest source, however many there are, so a source with a
third of all documents is many tasks' work.

Only counts of sources and groups go to the driver: at most ``MOST_SOURCES`` sources, each with as many
groups as a group has shards, the square root of their number. Shards and their quotas are a table.

Defined results: documents without source, of a source without target, or without text stay out; a
source without documents gets nothing and its share goes to the others in proportion; a total is
the largest at which every other source reaches its share, unless one is given; ties go to the
smallest ``doc_id`` and, between sources, to the first name; further columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paigham.llm.common import has_text
from paigham.storage import cut, spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_SOURCES = 10_000
SHARD_ROWS = 20_000
#: Blocks the whole mixture is divided into.
BLOCKS = 10_000


@cache
def encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("paigham", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of the documents with source and text."""
    path = f"{tokenizers}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(path)
        for batch in batches:
            counts = [len(tokens.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(counts, pa.int64())], ["doc_id", "source", "n_tokens"])

    return spread(documents.select("doc_id", "source", "text").where(has_text(F.col("text")) & has_text(F.col("source")))).mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def sainte_lague(weights: dict, blocks: int, limits: dict) -> dict:
    """Blocks per name by highest quotients ``weight / (2 k + 1)``, none beyond its limit."""
    given = dict.fromkeys(weights, 0)
    heap = [(-w, name) for name, w in weights.items() if w > 0 and limits[name] > 0]
    heapq.heapify(heap)
    for _ in range(blocks):
        if not heap:
            break
        _, name = heapq.heappop(heap)
        given[name] += 1
        if given[name] < limits[name]:
            heapq.heappush(heap, (-weights[name] / (2 * given[name] + 1), name))
    return given


def parted(sizes: dict, blocks: int, size: int, repeats: int) -> dict:
    """Blocks of ``size`` tokens per part of a source; the last of a part may be a piece of one, so that a source can be used up."""
    return sainte_lague(sizes, blocks, {k: n * repeats // size + 1 for k, n in sizes.items()})


def plan(groups: list[tuple[str, int, int]], targets: dict[str, tuple[float, int]], total: int | None = None, blocks: int = BLOCKS) -> tuple[dict[tuple[str, int], int], int, int]:
    """Blocks of each (source, group), the tokens of a block, and the total aimed at."""
    tokens: dict[str, int] = {}
    own: dict[str, dict[int, int]] = {}
    for source, group, n in groups:
        tokens[source] = tokens.get(source, 0) + n
        own.setdefault(source, {})[group] = n
    share = {s: targets[s][0] for s in tokens if s in targets and targets[s][0] > 0 and targets[s][1] > 0 and tokens[s] > 0}
    if not share:
        return {}, 1, 0
    share = {s: x / sum(share.values()) for s, x in share.items()}
    capacity = {s: tokens[s] * targets[s][1] for s in share}
    if total is None:
        total = int(min(capacity[s] / share[s] for s in share))
    size = max(1, total // blocks)
    of_source = sainte_lague(share, total // size, {s: capacity[s] // size + 1 for s in share})
    return {(s, g): b for s, n in of_source.items() for g, b in parted(own[s], n, size, targets[s][1]).items()}, size, total


def _quotas(size: int, repeats: dict[str, int]):
    """Of each group the tokens that each of its shards gives."""

    def run(shards: pd.DataFrame) -> pd.DataFrame:
        most = repeats[shards["source"].iloc[0]]
        sizes = dict(zip(shards["shard"].tolist(), shards["tokens"].tolist(), strict=True))
        given = parted(sizes, int(shards["blocks"].iloc[0]), size, most)
        return shards.assign(quota=[min(given[k] * size, sizes[k] * most) for k in shards["shard"].tolist()])[["source", "shard", "tokens", "quota"]]

    return run


def mixture(documents: DataFrame, mix_targets: DataFrame, total: int | None = None, seed: int = 42, tokenizers: str = TOKENIZERS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(doc_id, source, n_tokens, repeats)`` of the documents in the mixture."""
    spark = documents.sparkSession
    rows = mix_targets.where("source is not null and target_share is not null").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError("too many sources for a plan on the driver")
    targets = {r["source"]: (float(r["target_share"]), int(r["max_repeats"] if r["max_repeats"] is not None else 1)) for r in rows}
    counted = cut(token_counts(documents, tokenizers=tokenizers))
    counted = counted.where(F.col("source").isin(list(targets)))
    most = counted.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    n_shards = max(1, most // shard_rows)
    n_groups = max(1, round(n_shards**0.5))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    counted = counted.withColumn("order", order).withColumn("shard", F.pmod("order", F.lit(n_shards)))
    shards = cut(counted.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens")).withColumn("grp", F.col("shard") % n_groups))
    groups = [(r["source"], r["grp"], r["t"]) for r in shards.groupBy("source", "grp").agg(F.sum("tokens").alias("t")).orderBy("source", "grp").collect()]
    given, size, _ = plan(groups, targets, total, max(BLOCKS, 100 * n_shards))
    planned = spark.createDataFrame([(s, g, b) for (s, g), b in given.items() if b > 0], "source string, grp bigint, blocks bigint")
    repeated = {s: r for s, (_, r) in targets.items()}
    quotas = shards.join(planned, ["source", "grp"]).groupBy("source", "grp").applyInPandas(_quotas(size, repeated), "source string, shard bigint, tokens bigint, quota bigint").where("quota > 0")
    before = F.coalesce(F.sum("n_tokens").over(W.partitionBy("source", "shard").orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chosen = counted.withColumn("before", before).join(quotas, ["source", "shard"])
    # Whole passes over the shard, then the documents whose middle lies within what is left of its quota.
    whole = F.expr("quota div greatest(tokens, 1)")
    left = F.expr("quota % greatest(tokens, 1)")
    repeats = whole + F.when(F.col("before") * 2 + F.col("n_tokens") <= left * 2, 1).otherwise(0)
    return chosen.select("doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")


def shares(documents: DataFrame, mix_targets: DataFrame, total: int | None = None, seed: int = 42, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Per source of the targets: documents, tokens, the share reached and the share aimed at."""
    used = mixture(documents, mix_targets, total, seed, tokenizers).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats"))
    joined = mix_targets.select("source", "target_share", "max_repeats").join(used, "source", "left").na.fill(0, ["n_docs", "n_tokens", "most_repeats"])
    return joined.select("source", "n_docs", "n_tokens", "most_repeats", "max_repeats", F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(W.partitionBy())).alias("actual_share"), "target_share")
