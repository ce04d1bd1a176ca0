"""Problem 5: occurrences and records of every term, with a mark on rare and common ones.

External sort: each task sorts its pairs of term and record and scans the runs, which gives sorted
runs of (term, occurrences, records) - a record's pairs never leave its batch, so counts of distinct
records add up. The runs are range-partitioned by term, sorted, and scanned once more. What is
shuffled is one entry per term and task, however common the term is.

Defined results: null, empty and blank texts have no terms; a term repeated in a record counts once
as a record; an empty table gives an empty result; columns other than the named one are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paigham.llm.common import width
from paigham.storage import cut, spread

#: A task merges its runs when they hold this many entries.
MERGE_AT = 1_000_000
RUN = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _scan(batch: pa.RecordBatch) -> pa.Table:
    """One sorted run of a batch. The entry without a term counts the records that have one."""
    split = pc.utf8_split_whitespace(batch.column(0).cast(pa.large_string()))
    terms, record = pc.list_flatten(split), pc.list_parent_indices(split)
    kept = pc.not_equal(terms, "")
    terms, record = terms.filter(kept).dictionary_encode(), record.filter(kept).to_numpy()
    names = terms.dictionary.cast(pa.string())
    n = max(1, batch.num_rows)
    pairs = np.sort(terms.indices.to_numpy().astype(np.int64) * n + record)
    run_starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    occurrences = np.bincount(pairs // n, minlength=len(names))
    records = np.bincount(pairs[run_starts] // n, minlength=len(names))
    with_terms = len(np.unique(record))
    return pa.table([pa.concat_arrays([names, pa.array([None], pa.string())]), np.append(occurrences, len(pairs)).astype(np.int64), np.append(records, with_terms).astype(np.int64)], schema=RUN)


def _merge(runs: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(runs).group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")])
    return summed.select(["term", "occurrences_sum", "records_sum"]).rename_columns(RUN.names).cast(RUN).sort_by("term")


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs, held = [], 0
    for batch in batches:
        run = _scan(batch)
        runs.append(run)
        held += run.num_rows
        if held > MERGE_AT:
            merged = _merge(runs)
            runs, held = [merged], merged.num_rows
            if held > MERGE_AT // 2:
                yield from merged.to_batches(100_000)
                runs, held = [], 0
    if runs:
        yield from _merge(runs).to_batches(100_000)


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the runs of equal terms of a sorted partition; the last run of a batch may go on in the next."""
    open_run: tuple[str, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        sums = [np.add.reduceat(batch.column(k).to_numpy(), starts) for k in (1, 2)]
        terms = batch.column(0).take(pa.array(starts))
        first = terms[0].as_py()
        if open_run and open_run[0] == first:
            sums[0][0] += open_run[1]
            sums[1][0] += open_run[2]
        elif open_run:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(open_run, RUN.types, strict=True)], schema=RUN)
        open_run = (terms[-1].as_py(), int(sums[0][-1]), int(sums[1][-1]))
        if len(terms) > 1:
            yield pa.RecordBatch.from_arrays([terms[:-1], pa.array(sums[0][:-1]), pa.array(sums[1][:-1])], schema=RUN)
    if open_run:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(open_run, RUN.types, strict=True)], schema=RUN)


def counted(df: DataFrame, column: str = "cleaned_msg", rare_below: int = 3, common_percent: int = 15) -> DataFrame:
    """``(term, occurrences, records, mark)`` of every term; mark is ``rare``, ``common`` or null."""
    schema = "term string, occurrences bigint, records bigint"
    runs = cut(spread(df.select(column).where(F.col(column).isNotNull())).mapInArrow(_sorted_runs, schema))
    total = runs.where("term is null").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    spark = df.sparkSession
    terms = runs.where("term is not null").repartitionByRange(width(spark), "term").sortWithinPartitions("term").mapInArrow(_scan_runs, schema)
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * 100 > F.lit(common_percent * total), "common")
    return terms.withColumn("mark", mark)


def found(df: DataFrame) -> DataFrame:
    """``(term, mark)`` of the terms too rare or too common."""
    return counted(df).where("mark is not null").select("term", "mark")
