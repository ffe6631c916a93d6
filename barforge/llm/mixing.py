"""Mixing sources to target weights by repetition rates and one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, col, fresh, materialize

#: Weights by rank of the source's name, repeating.
WEIGHTS = (3, 1, 2)
#: What all targets add up to, as a share of all sizes.
SHARE = 1.5
#: A target is this many times its source's size at most.
MOST = 2
SEED = "mix-1"


def _same(doc_id: Column, source: Column, text: Column) -> Column:
    """A hash that rows share if they agree in id, source and text; nulls are values of their own."""
    part = lambda x: F.coalesce(F.concat(F.lit("s"), x), F.lit("n"))
    return F.md5(F.concat_ws("|", part(doc_id.cast("string")), part(source.cast("string")), part(F.md5(text.cast("binary")))).cast("binary"))


def repeated(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The ids, null among them, that more than one row has."""
    n_id, n_times = fresh(rows, "id", "times")
    times = rows.groupBy(col(rows, doc_id).alias(n_id)).agg(F.count("*").alias(n_times)).where(F.col(n_times) > 1)
    return materialize(times.select(n_id), "shared_ids")


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", same: bool = False) -> DataFrame:
    """doc_id, source and size (words of the text; null and empty texts have none); if ``same``, also that: a hash of id, source and text."""
    words = F.coalesce(F.regexp_count(col(docs, text), F.lit(WORD)), F.lit(0)).cast("long")
    key = [_same(col(docs, doc_id), col(docs, source), col(docs, text)).alias("same")] if same else []
    return docs.select(col(docs, doc_id).alias("doc_id"), col(docs, source).alias("source"), words.alias("size"), *key)


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target of every source, a null source included.

    Sources are ranked by code point, null last; the rank picks the weight. All targets add up to ``share``
    of all sizes; one that would pass ``most`` times its source's size stops there and the excess goes to
    the others by weight, until none is above. Sources of size 0 get target 0.

    The rank is counted by range partitions with offsets, and each reshare is one aggregate of the table of
    sources, so the number of sources isn't bound by a task's memory.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    by = materialize(by, "sources")
    before = by.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("at", rank).join(before, "part").withColumn("at", F.col("at") + F.col("before"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("long")
    by = materialize(by.select("source", "source_size", weight.alias("weight")), "weights")
    total = by.agg(F.sum("source_size")).first()[0] or 0
    # A source is capped once weight * unit passes most * size; the unit grows as sources are capped.
    unit, capped = 0.0, None
    above = lambda x: F.col("weight") * F.lit(x) > most * F.col("source_size")
    while True:
        row = by.agg(F.count(F.when(above(unit), 1)), F.sum(F.when(above(unit), F.col("source_size"))), F.sum(F.when(~above(unit), F.col("weight")))).first()
        if row[0] == capped or not row[2]:
            break
        capped, unit = row[0], (share * total - most * (row[1] or 0)) / row[2]
    target = F.when(above(unit), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(unit))
    return by.select("source", "source_size", target.alias("target"))


def _copies(rate: Column, drawn_by: Column, seed: str) -> Column:
    """floor(rate), and one more where a hash of the seed and what a row draws by, in [0, 1), is below the fraction."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), drawn_by).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def _drawn_by(rows: DataFrame, doc_id: str, same: Column | None, name: str) -> DataFrame:
    """``rows`` with ``name``, what a row draws by: its id where no other row has it, else ``same`` and its number among the rows that agree in that.

    Only rows of shared ids are moved. Their numbers are places in each part of the table, after those of the parts before; rows that
    agree in ``same`` are interchangeable, so reruns give the same rows.
    """
    n_times, n_same, n_part, n_place, n_before = fresh(rows, "times", "same_row", "part", "place", "before")
    id_text = F.coalesce(col(rows, doc_id).cast("string"), F.lit(""))
    shared = repeated(rows, doc_id)
    if shared.isEmpty():
        return rows.withColumn(name, id_text)
    if same is None:
        raise ValueError("ids repeat: sizes needs same=True to tell their rows apart")
    same_id = col(rows, doc_id).eqNullSafe(shared[shared.columns[0]])
    many = materialize(rows.withColumn(n_same, same).join(shared, same_id, "left_semi").withColumn(n_part, F.spark_partition_id()), "shared")  # the parts stay as they were
    counts = many.groupBy(n_same, n_part).agg(F.count("*").alias(n_times))
    before = F.coalesce(F.sum(n_times).over(Window.partitionBy(n_same).orderBy(n_part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(n_same, n_part).orderBy(F.lit(0))) - 1
    numbered = many.withColumn(n_place, place).join(counts.select(n_same, n_part, before.alias(n_before)), [n_same, n_part])
    numbered = numbered.withColumn(name, F.concat_ws(":", n_same, (F.col(n_place) + F.col(n_before)).cast("string"))).drop(n_same, n_part, n_place, n_before)
    return rows.join(shared, same_id, "left_anti").withColumn(name, id_text).unionByName(numbered)


def copies(sized: DataFrame, by_source: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and ``copies``: floor(rate), and one more with probability rate - floor(rate).

    The draw is a hash of the seed and the id, so reruns agree. Rows that share an id, or have none, draw by it, source, text and, where
    these agree too, their number: a source comes near its target whatever its ids. Only the table of sources is joined; Spark
    broadcasts it while it's small and else splits hot sources.
    """
    b = by_source.withColumnRenamed("source", "b_source")
    rows = _drawn_by(sized, "doc_id", F.col("same") if "same" in sized.columns else None, "drawn_by")
    joined = rows.join(b, rows["source"].eqNullSafe(b["b_source"])).drop("b_source")
    return joined.withColumn("copies", _copies(_rate(), F.col("drawn_by"), seed)).drop("drawn_by", "same")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it, with its columns only.

    Rows draw as in ``copies``. Null sources are one source; a document without words, in a source whose rate is below 1, stays
    or goes by the same draw. An empty table gives an empty one. Columns of other names pass through.
    """
    name_n, name_key, name_take, name_by = fresh(docs, "size", "key", "copies", "drawn_by")
    by = materialize(targets(materialize(sizes(docs, doc_id, text, source), "sizes")), "targets")
    rows = _drawn_by(docs, doc_id, _same(col(docs, doc_id), col(docs, source), col(docs, text)), name_by)
    b = by.select(F.col("source").alias(name_key), _rate().alias(name_n))
    joined = rows.join(b, col(rows, source).eqNullSafe(b[name_key])).drop(name_key)
    taken = joined.withColumn(name_take, _copies(F.col(name_n), F.col(name_by), seed)).where(F.col(name_take) > 0)
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return taken.withColumn(name_take, F.explode(F.sequence(F.lit(1), F.col(name_take)))).select(*columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = materialize(sizes(docs, same=not repeated(docs).isEmpty()), "sizes")
    drawn = copies(sized, materialize(targets(sized), "targets"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         count(*) OVER (PARTITION BY doc_id) AS times,
         md5(concat_ws('|', coalesce('s' || CAST(doc_id AS VARCHAR), 'n'), coalesce('s' || source, 'n'), coalesce('s' || md5(text), 'n'))) AS same
  FROM documents
), k AS (  -- rows of one id, or of none, are told apart
  SELECT *, CASE WHEN times = 1 THEN coalesce(CAST(doc_id AS VARCHAR), '')
                 ELSE same || ':' || CAST(row_number() OVER (PARTITION BY same) - 1 AS VARCHAR) END AS drawn_by FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][1 + CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS INTEGER)] AS weight FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, encode(source) NULLS LAST) AS nth FROM w
), p AS (  -- the unit if the sources before this one are capped, and whether this one is then not above
  SELECT o.*, (1.5 * (SELECT sum(source_size) FROM s)
              - 2 * coalesce(sum(source_size) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM o
), u AS (
  SELECT unit FROM p WHERE weight * unit <= 2 * source_size ORDER BY nth LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN weight * unit > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE weight * unit END AS target
  FROM w, u
), f AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('mix-1:' || drawn_by), 1, 13)) AS BIGINT) / 4503599627370496.0 AS draw
  FROM k AS d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM f
"""
