"""A saved definition index, and look-ups of whole tables of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import hits, named
from ..session import cut
from .extraction import extract

BUCKETS = 32  # folders of an index, by name, unless more are asked for


def _bucket(name: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(name), buckets).cast("int")


def save_index(definitions: DataFrame, path: str, buckets: int = BUCKETS, partitions: int | None = None, rows_per_file: int = 0) -> None:
    """One row per name and definition, in folders by name, each file in name order.

    Placed by hash, so the extraction runs once; a placement by range would run it a second
    time for its sample. ``partitions`` (``spark.sql.shuffle.partitions`` unless given) is the number of
    writing tasks: a name is spread over as many as its files need, so a name that a third of all files
    define is no hot spot. ``rows_per_file`` splits files further. The number of buckets is kept with the schema.
    """
    rows = named(definitions).select("name", "file_id", "unit", "language", "rule_id", "kind", "start_line", "end_line", "ranges")
    rows = rows.withColumn("name", F.col("name").alias("name", metadata={"buckets": buckets})).withColumn("bucket", _bucket(F.col("name"), F.lit(buckets)))
    tasks = partitions or int(definitions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64("file_id"), F.lit(max(8, -(-4 * tasks // buckets))))
    placed = rows.repartition(tasks, "bucket", spread).sortWithinPartitions("bucket", "name", "file_id")
    placed.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup_word(index: DataFrame, name: str) -> DataFrame:
    """Ranges of one literal name: reads one folder, and of it the row groups with the name."""
    buckets = index.schema["name"].metadata.get("buckets")
    if buckets is None:
        raise ValueError("no index as save_index writes it")
    found = index.where((F.col("bucket") == _bucket(F.lit(name), F.lit(buckets))) & (F.col("name") == name))
    return found.select("file_id", F.explode("ranges").alias("r")).select("file_id", "r.start_line", "r.end_line")


def lookup(files: DataFrame, terms: DataFrame, languages: tuple[str, ...] | None = None, gap: int = 0) -> DataFrame:
    """Merged ranges per term and file, without a saved index.

    Terms meet distinct names first and rows second, so the names are written out once between:
    the extraction does not run twice.
    """
    return hits(cut(named(extract(files, languages)).select("name", "file_id", "ranges")), terms, gap)
