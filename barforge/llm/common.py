"""Helpers shared by the operators of this package: scratch tables, unused column names, byte-bounded batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch folder of local mode, where neither the session nor its context names one.
LOCAL_SCRATCH = "/tmp/checkpoints/barforge"

#: A word, as the contracts of this package count them.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, else the context's; in local mode, where all is one machine, else a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return (named or LOCAL_SCRATCH).rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of files, not a rerun of what made them.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` made and nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def col(df: DataFrame, name: str) -> Column:
    """A column of ``df`` whose name may hold dots or backticks."""
    return df["`" + name.replace("`", "``") + "`"]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def slices(texts: list, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of ``texts`` of about ``limit`` characters each; one long text makes a range of its own."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def text_chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut into chunks of bounded text size, each with its texts as strings (null: empty)."""
    for batch in batches:
        where = batch.schema.get_field_index(text)
        a, size = 0, 0
        sizes = pc.binary_length(batch.column(where)).to_pylist()
        for i, n in enumerate([*sizes, None]):
            if i == batch.num_rows or i > a and size + (n or 0) > limit:
                if i > a:
                    part = batch.slice(a, i - a)
                    yield part, [t or "" for t in part.column(where).to_pylist()]
                a, size = i, 0
            size += n or 0


def map_rows(df: DataFrame, run, text: str) -> DataFrame:
    """mapInArrow over all columns of ``df``, whatever their names: ``run`` gets the batches and the name and place of the text."""
    names = [f"c{i}" for i in range(len(df.columns))]
    at = df.columns.index(text)
    plain = df.toDF(*names)
    return plain.mapInArrow(lambda batches: run(batches, names[at], at), plain.schema).toDF(*df.columns)


_memo_of: list = [None]


def claim_memo(owner) -> None:
    """Lets only one object of a worker keep what it has learned in its ``memo``: workers outlive queries and their broadcasts."""
    if _memo_of[0] is not owner:
        if _memo_of[0] is not None:
            _memo_of[0].memo.clear()
        _memo_of[0] = owner
