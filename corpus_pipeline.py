"""A corpus pipeline of five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whereabouts.llm import line_dedup, packing, quality, simhash, toxicity
from whereabouts.llm.common import saved
from whereabouts.llm.queries import _read, _tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.toxic(docs, _read(spark, sf_dir, "labels"), keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    return quality.quality(docs, _read(spark, sf_dir, "labels"), keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; a document of which nothing is left goes, and ``n_chars``
    follows a text that changed."""
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS)).where("lines_removed = 0 OR trim(text) <> ''")
    return cut.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.packed(docs, _tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", not_toxic), ("quality", good), ("line_dedup", without_repeats), ("simhash", one_of_each), ("packing", packed)]
ORACLE_SQL = None  # SQL can't express the models


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = saved(docs)
    return docs
