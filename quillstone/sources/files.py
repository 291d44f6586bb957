"""Raw documents from files: text and binary, with format, hash and rejects."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.sources import markup

BINARY = tuple(markup.BINARY_FORMATS)


def expanded(path: str) -> str:
    return os.path.expanduser(path)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, title, format, text, import_hash and error (null, UNSUPPORTED_FORMAT or EMPTY_DOCUMENT)."""
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(expanded(folder))
    return prepare(rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def read_files(spark: SparkSession, place: str) -> DataFrame:
    """path, title, format, content (bytes), import_hash of the bytes and error, for files of any format, changes included."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(expanded(place))
    return described(rows.select("path", "content"))


def described(files: DataFrame, explicit: Column | None = None) -> DataFrame:
    """What is known of files (path, content) before they are parsed."""
    kind = T.detect_format(F.col("path"), explicit)
    blank = F.when(kind.isin(*BINARY), F.length("content") == 0).otherwise(T.trim_white(F.col("content").cast("string")) == "")
    error = F.when(kind.isNull(), "UNSUPPORTED_FORMAT").when(blank, "EMPTY_DOCUMENT")
    return files.select("path", title(F.col("path")).alias("title"), kind.alias("format"), "content", F.sha2("content", 256).alias("import_hash"), error.alias("error"))


def title(path: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def prepare(rows: DataFrame) -> DataFrame:
    kind = T.detect_format(F.col("path"))
    error = F.when(kind.isNull(), "UNSUPPORTED_FORMAT").when(T.trim_white(F.col("text")) == "", "EMPTY_DOCUMENT")
    return rows.select("path", title(F.col("path")).alias("title"), kind.alias("format"), T.normalize_text(F.col("text")).alias("text"), F.sha2("text", 256).alias("import_hash"), error.alias("error"))
