"""Result files: digests of inputs, JSON lines of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each file under a path; each file is hashed where it is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_json(df: DataFrame, path: str, digest: str | None = None) -> None:
    """The rows as JSON lines, nulls included, with the digest of what they were made from."""
    stamped = df if digest is None else df.withColumn("input_sha256", F.lit(digest))
    stamped.write.mode("overwrite").option("ignoreNullFields", False).json(path)
