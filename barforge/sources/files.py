"""File sources and sinks: CSV and Parquet with schemas, file-name metadata, fallbacks, JSON summaries, checked projections."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a file's name may give its horizon in days; the first that matches counts.
HORIZONS = (r"_(\d+)d_tp", r"num_days_(\d+)", r"_(\d+)d(?:_|\.|$)")


#: Where tables go that only pass through files, in local mode without a named folder.
LOCAL = "/tmp/barforge"


def passing_folder(spark: SparkSession) -> str:
    """A new folder for tables that pass through files: below ``spark.checkpoint.dir``, which all executors share; in local mode a local one will do."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return f"{(named or LOCAL).rstrip('/')}/files-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, dates: tuple[str, ...] = ("date",)) -> DataFrame:
    """A CSV with a header. With a schema nothing is inferred; without one all columns are read as text and ``dates`` are parsed."""
    if schema:
        return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    df = spark.read.csv(path, header=True)
    return df.withColumns({c: F.to_date(c) for c in dates if c in df.columns})


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV; only its first line is read."""
    return spark.read.csv(path, header=True).columns


def lowered(df: DataFrame, *values: str) -> DataFrame:
    """Column names in lower case, and the values of the named columns too."""
    out = df.toDF(*[c.lower() for c in df.columns])
    return out.withColumns({c: F.lower(c) for c in values})


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists; FileNotFoundError if none does."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {paths}")


def horizon_of(path: Column) -> Column:
    """Days in a file's name by the first pattern that matches; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in HORIZONS]).cast("int")


def read_named(spark: SparkSession, folder: str, prefix: str, schema: str, glob: str = "*.csv", up: int = 0) -> DataFrame:
    """All files of a folder whose names begin with ``prefix``, with config (the rest of the name) and its horizon.

    ``up``: how many folders above the files the name stands, as where each table is a folder of part files.
    """
    df = spark.read.csv(f"{folder}/{prefix}{glob}", header=True, schema=schema)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1 - up)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    return df.withColumns({"config": F.regexp_replace(stem, f"^{prefix}_?", ""), "file_num_days": horizon_of(name)})


def build_or_load(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at ``path``; made by ``build()`` and written there first if it isn't there."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def write_projected(df: DataFrame, path: str, columns: list[str], fmt: str = "parquet") -> None:
    """Some columns of ``df``; ValueError for one that it doesn't have."""
    if missing := set(columns) - set(df.columns):
        raise ValueError(f"unknown columns {sorted(missing)}")
    out = df.select(*columns).write.mode("overwrite")
    out.csv(path, header=True) if fmt == "csv" else out.format(fmt).save(path)


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """One folder for each value of the keys; rows of a value are spread over tasks by size, not sent to one."""
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def fan_out(df: DataFrame, folder: str, tables: dict[str, list[str]]) -> None:
    """Several projections of one frame, which is computed once."""
    df = df.persist()
    try:
        for name, columns in tables.items():
            write_projected(df, f"{folder}/{name}", columns)
    finally:
        df.unpersist()


def dated(df: DataFrame, column: str = "date", pattern: str = "yyyy-MM-dd") -> DataFrame:
    """A date column as text."""
    return df.withColumn(column, F.date_format(column, pattern))


def json_rows(df: DataFrame, *keys: str, name: str = "settings") -> DataFrame:
    """keys and the other columns as one JSON text, for the export of configurations."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias(name))


def summary_json(row: DataFrame) -> str:
    """The only row of a frame as a JSON text."""
    rows = row.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a summary has one row")
    return json.dumps(json.loads(rows[0]), sort_keys=True)


def with_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A text column parsed as JSON; texts that aren't give nulls."""
    return df.withColumn(column, F.from_json(column, schema))


def composite_key(*parts: str) -> Column:
    return F.concat_ws("__", *parts)


def joined(a: DataFrame, b: DataFrame, *keys: str, suffix: str = "_tb", how: str = "left") -> DataFrame:
    """A join in which columns that both have, the keys aside, come from ``b`` under a suffix."""
    twice = {c: f"{c}{suffix}" for c in b.columns if c in a.columns and c not in keys}
    return a.join(b.withColumnsRenamed(twice), list(keys), how)


def coalesced(df: DataFrame, suffix: str = "_tb") -> DataFrame:
    """Columns that come twice, once with a suffix, as one: the plain one where it isn't null."""
    twice = [c for c in df.columns if f"{c}{suffix}" in df.columns]
    return df.withColumns({c: F.coalesce(c, f"{c}{suffix}") for c in twice}).drop(*[f"{c}{suffix}" for c in twice])
