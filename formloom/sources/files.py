"""Intake files: discovery, sniffing, fingerprints and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = r"\.(pdf|docx)$"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _intake(files: DataFrame) -> DataFrame:
    """Keep supported files; the extension is compared without case.

    The content stays in its task: only the fingerprint and the sniffed kind
    are derived, and a plan that does not ask for the content can drop it.
    """
    return files.where(F.lower("path").rlike(SUPPORTED)).select(
        "path",
        F.regexp_extract("path", "([^/]+)$", 1).alias("source_filename"),
        "modificationTime", "length", "content",
        F.sha2("content", 256).alias("file_hash"),
        (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"),
        F.when(F.lower("path").endswith(".docx"), "docx").otherwise("pdf").alias("route"),
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return _intake(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def stream_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New files as they arrive."""
    r = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return _intake(r.load(path))


def route(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word documents, everything else), by extension."""
    return files.where("route = 'docx'"), files.where("route <> 'docx'")
