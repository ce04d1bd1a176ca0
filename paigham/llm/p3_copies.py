"""Problem 3: copies hidden by formatting.

Canonical bytes: the lower-cased words in order; where a message is an opening with labelled
fields, the opening and then the fields in sorted order, each with its own value. Rows are split by
the leading bytes (radix), oversized buckets by twice as many bytes and so on until each fits; every
bucket is then counted in a trie whose terminals hold the number of copies and the first row. A
bucket of one text alone cannot be split by bytes: its rows are counted by partial sums.

The radix directory is a written table per level, of the oversized prefixes only; rows find theirs by
joins, which Spark broadcasts where a level is small and shuffles where it is not. The number of
tasks follows the rows and bytes, so a task's tries stay of one size, whatever the input.

Defined results: null, empty and blank messages are no messages and come out nowhere; messages
without a word are copies if equal; ties go to the smallest ``row_id``; an empty table gives an
empty result; columns other than ``row_id`` and ``msg`` are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paigham.llm.common import has_text, key128, width
from paigham.storage import cut, spread

WORD = re.compile(r"[^\W_]+")
FIELD = re.compile(r"([^\W\d_]\w*)\s*[:=](?!//)")
#: Bytes by which rows are split at first; oversized buckets are split by twice as many, and so on.
DEPTH = 8
#: Rows that fit into a bucket, and rows and bytes of the buckets of one task.
FITS = 20_000
TASK_ROWS, TASK_BYTES = 100_000, 64 << 20


def canonical(msg: str) -> bytes:
    """The bytes that are equal for copies and differ for other messages."""
    low = msg.lower()
    fields = [(m.start(1), m.end()) for m in FIELD.finditer(low)] if ":" in low or "=" in low else []
    if len(fields) >= 2:
        ends = [start for start, _ in fields[1:]] + [len(low)]
        named = [(start, end, WORD.findall(low[start:end])) for (start, after), end in zip(fields, ends, strict=True) if WORD.search(low, after, end)]
        if len(named) >= 2:
            # A label without a value belongs to the text before it.
            starts = [start for start, _, _ in named] + [len(low)]
            values = sorted(" ".join(WORD.findall(low[a:b])) for a, b in zip(starts, starts[1:], strict=False))
            return "\x1e".join([" ".join(WORD.findall(low[: starts[0]])), *values]).encode()
    words = WORD.findall(low)
    return (" ".join(words) if words else "\x1d" + msg).encode("utf-8", "surrogatepass")


class CountingTrie:
    """A trie over eight-byte edges; a branch with one text is kept as that text's rest."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.terminals = 0

    def terminal(self, key: bytes) -> int:
        """The number of the terminal of ``key``, which is made if need be."""
        node, at = self.root, 0
        while True:
            edge = key[at : at + 8]
            at += 8
            below = node.get(edge)
            if below is None:
                node[edge] = (key[at:], self.terminals)
                self.terminals += 1
                return self.terminals - 1
            if type(below) is tuple:
                rest, terminal = below
                if rest == key[at:]:
                    return terminal
                below = node[edge] = {rest[:8]: (rest[8:], terminal)}
            node = below


def _canonicals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [canonical(m) for m in batch.column("msg").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(keys, pa.binary())], ["row_id", "canon"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of one task: a trie, counters at its terminals, and every row with its group."""
    trie, ids, at = CountingTrie(), [], []
    for batch in batches:
        ids.append(batch.column("row_id").to_numpy(zero_copy_only=False))
        at.append(np.fromiter((trie.terminal(k) for k in batch.column("canon").to_pylist()), np.int64, batch.num_rows))
    if not ids:
        return
    rows, terminals = np.concatenate(ids), np.concatenate(at)
    counts = np.bincount(terminals, minlength=trie.terminals)
    first = np.full(trie.terminals, np.iinfo(np.int64).max)
    np.minimum.at(first, terminals, rows)
    for i in range(0, len(rows), 50_000):
        t = terminals[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(rows[i : i + 50_000]), pa.array(first[t]), pa.array(counts[t])], ["row_id", "first_row_id", "n_copies"])


def directory(rows: DataFrame, fits: int = FITS) -> tuple[list[tuple[int, DataFrame]], list[DataFrame]]:
    """Levels ``(depth, oversized prefixes)`` of the radix directory, and the oversized buckets of one text: ``(x, y, n_copies, first_row_id)``."""
    levels, alone, left, depth = [], [], rows, DEPTH
    while True:
        ends = [F.min(c).alias(f"{c}0") for c in "xy"] + [F.max(c).alias(f"{c}1") for c in "xy"]
        counted = left.groupBy(F.substring("canon", 1, depth).alias("prefix")).agg(F.count("*").alias("n"), F.min("row_id").alias("first"), *ends).where(F.col("n") > fits)
        oversized = cut(counted.withColumn("one", (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))))
        many = oversized.where("not one").select("prefix")
        alone.append(oversized.where("one").select(F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("n").alias("n_copies"), F.col("first").alias("first_row_id")))
        if many.isEmpty():
            return levels, alone
        levels.append((depth, many))
        left = left.withColumn("prefix", F.substring("canon", 1, depth)).join(many, "prefix", "left_semi").drop("prefix")
        depth *= 2


def grouped(df: DataFrame, fits: int = FITS) -> DataFrame:
    """``(row_id, first_row_id, n_copies)`` of every row with text."""
    spark = df.sparkSession
    canon = spread(df.select("row_id", "msg")).where(has_text(F.col("msg"))).mapInArrow(_canonicals, "row_id bigint, canon binary")
    x, y = key128(F.col("canon"))
    rows = cut(canon.withColumns({"x": x, "y": y}))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("canon")), F.lit(0)).alias("bytes")).first()
    levels, alone = directory(rows, fits) if size["n"] > fits else ([], [])
    # The leaf of a row: the shortest prefix whose bucket fits.
    placed = rows.withColumn("leaf", F.substring("canon", 1, DEPTH))
    for at, many in levels:
        seen = many.select(F.col("prefix").alias("leaf"), F.lit(True).alias("deeper"))
        placed = placed.join(seen, "leaf", "left").withColumn("leaf", F.when(F.col("deeper"), F.substring("canon", 1, at * 2)).otherwise(F.col("leaf"))).drop("deeper")
    out = None
    if alone:
        single = reduce(DataFrame.unionByName, alone)
        out = rows.join(single, ["x", "y"]).select("row_id", "first_row_id", "n_copies")
        placed = placed.join(single.select("x", "y"), ["x", "y"], "left_anti")
    tasks = max(width(spark), -(-size["n"] // min(TASK_ROWS, 5 * fits)), -(-size["bytes"] // TASK_BYTES))
    counted = placed.select("row_id", "canon", F.xxhash64("leaf").alias("leaf")).repartition(tasks, "leaf").select("row_id", "canon").mapInArrow(_count, "row_id bigint, first_row_id bigint, n_copies bigint")
    return counted.unionByName(out) if out is not None else counted


def collapsed(df: DataFrame, fits: int = FITS) -> DataFrame:
    """``(row_id, n_copies)``: one row per message, its first, with the number of its copies."""
    return grouped(df, fits).where(F.col("row_id") == F.col("first_row_id")).select("row_id", "n_copies")


def found(df: DataFrame, fits: int = FITS) -> DataFrame:
    """``(first_row_id, row_id)``: each row that repeats an earlier one."""
    return grouped(df, fits).where(F.col("row_id") != F.col("first_row_id")).select("first_row_id", "row_id")
