"""Prepares a message table: ``python -m paigham.prepare --file messages.xlsx --out prepared``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import functions as F

from paigham.config import Settings
from paigham.plans.pipeline import EmptyDatasetError, Pipeline
from paigham.session import local_session, ship
from paigham.sources.readers import DatasetError, load_messages
from paigham.sources.sinks import report_json


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="paigham.prepare", description=__doc__)
    parser.add_argument("--file", required=True, help="a worksheet, CSV, JSON or Parquet file with msg, status and source")
    parser.add_argument("--sheet", help="the worksheet, the first if none is named")
    parser.add_argument("--out", default="prepared", help="the folder for what is written")
    parser.add_argument("--strict", action="store_true", help="also one row per cleaned text")
    parser.add_argument("--unigrams", action="store_true", help="terms of one word only")
    parser.add_argument("--no-save", action="store_true", help="write nothing")
    parser.add_argument("--quiet", action="store_true", help="show no messages before and after")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> int:
    """0 when done, 1 when the table cannot be prepared."""
    args = arguments(given)
    spark = local_session()
    ship(spark)
    settings = replace(Settings(), strict=args.strict, ngrams=1 if args.unigrams else 2)
    try:
        raw = load_messages(spark, args.file, args.sheet)
        raw = raw if "row_id" in raw.columns else raw.withColumn("row_id", F.monotonically_increasing_id() + 1)
        pipeline = Pipeline(raw, settings)
        print(report_json(pipeline.report()))
        for before, after in () if args.quiet else pipeline.examples():
            print(f"- {before}\n  {after}")
        for name, path in () if args.no_save else pipeline.save(args.out).items():
            print(f"{name}: {path}")
    except (DatasetError, EmptyDatasetError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
