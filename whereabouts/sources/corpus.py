"""The table of files, and why a file is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detection import with_language
from ..operators.language import language_of_path, language_of_shebang


def read_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Text files below ``root``; files with a NUL byte are taken as binary and left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root).select("path", F.col("content").alias("bytes"))
    text = files.where(F.position(F.lit(b"\x00"), F.col("bytes")) == 0)
    readable = F.is_valid_utf8("bytes")
    return text.select(
        "path",
        F.when(readable, F.decode("bytes", "UTF-8")).alias("content"),
        F.when(~readable, F.lit("unreadable")).alias("read_error"),
    )


def source_files(
    table: DataFrame,
    path: str | None = "path",
    content: str = "content",
    ruled: tuple[str, ...] | None = None,
    unique: bool = True,
    languages: DataFrame | None = None,
) -> DataFrame:
    """One row per file: ``file_id, path, recipe, language, status, status_detail, content``.

    With ``unique=False`` the table may repeat paths: the key then holds a hash of the content,
    so that different contents of one path spread out, and equal copies fold into one row.
    ``path=None`` is for texts that have no path; their language comes from the content. With ``languages``, a table of languages of
    any size, all evidence on a language is weighed (see ``detection``) and kept, and ``ambiguous_language`` is one more status.
    """
    text = F.col(content)
    where = F.col(path) if path else F.lit(None).cast("string")
    digest = F.sha2(F.concat_ws("\u0001", where, text), 256)
    key = where if (path and unique) else F.concat_ws("@", where, digest)
    language = F.coalesce(language_of_path(where), language_of_shebang(text)) if path else language_of_shebang(text)
    error = F.col("read_error") if "read_error" in table.columns else F.lit(None).cast("string")
    known = F.lit(True) if ruled is None else F.col("language").isin(*ruled, "Jupyter Notebook")
    files = table.select(
        key.alias("file_id"),
        where.alias("path"),
        F.array(F.concat(F.lit("cat "), where)).alias("recipe") if path else F.array().cast("array<string>").alias("recipe"),
        language.alias("language"),
        error.alias("_error"),
        text.alias("content"),
    )
    if languages is not None:
        files = with_language(files, languages, None if ruled is None else (*ruled, "Jupyter Notebook"))
        known = F.col("language_status") != "unsupported_language"
    status = status_of(F.col("_error"), F.col("language"), known, F.length("content"))
    if languages is not None:
        status = F.when(status == "unknown_language", F.col("language_status")).otherwise(status)
    files = files.withColumn("status", status).drop("_error", "language_status")
    return files if unique and path else files.dropDuplicates(["file_id"])


def status_of(error: Column, language: Column, known: Column, size: Column) -> Column:
    return (
        F.when(error.isNotNull(), error)
        .when(size == 0, "empty_input")
        .when(language.isNull(), "unknown_language")
        .when(~known, "unsupported_language")
        .otherwise("ok")
    )


def quarantine(files: DataFrame) -> DataFrame:
    """How many files were left out, and why."""
    return files.groupBy("status").agg(F.count("*").alias("n_files"))


def duplicate_keys(files: DataFrame) -> DataFrame:
    """Keys that several rows share; must be empty before a corpus is read as unique."""
    return files.groupBy("file_id").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
