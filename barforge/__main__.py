"""python -m barforge BARS.csv OUT [--format csv|parquet]: the 108 technical features of a file of daily bars."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.technical import build_all_features
from .sources.bars import BARS
from .sources.files import lowered, read_csv, write_projected


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="barforge", description=__doc__)
    parser.add_argument("bars", help="a CSV with date, instrument, open, high, low, close, volume and open_interest")
    parser.add_argument("out", help="the folder to write")
    parser.add_argument("--format", choices=("csv", "parquet"), default="csv")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    out = build_all_features(lowered(read_csv(spark, given.bars, BARS)))
    write_projected(out, given.out, out.columns, given.format)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
