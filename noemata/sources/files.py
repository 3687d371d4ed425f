"""Files of a source tree or of a text folder, read by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import SKIPPED_FOLDERS


def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = (".py", ".js", ".jsx", ".ts", ".tsx"), since: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of the files of these extensions below root; none in hidden or skipped folders. since: only files modified later (incremental ingestion)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    below = F.split(F.expr("substring(path, instr(path, '" + base.replace("'", "''") + "') + " + str(len(base)) + ")"), "/")
    parts = F.filter(below, lambda p: p != "")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED_FOLDERS))
    found = files.where(~hidden & F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*extensions))
    return found.where(F.col("modificationTime") > F.lit(since).cast("timestamp")) if since else found


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """path and text of the .txt and .md files below root."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def stem(path: F.Column) -> F.Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)
