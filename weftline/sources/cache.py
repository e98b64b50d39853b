"""Scans kept between runs: rows of packages as Parquet, used again while no file has changed."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.packages import read_packages


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*.dtsx") -> dict[str, str]:
    """SHA-256 of every package below a folder, by path. The files of a project are few."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return {r["path"]: r["digest"] for r in files.select("path", F.sha2("content", 256).alias("digest")).collect()}


def cached_scan(spark: SparkSession, folder: str, cache: str) -> tuple[DataFrame, bool]:
    """The rows of a folder's packages, and whether they were taken from the cache.

    The cache holds for all files together, so a change in a child package counts too.
    """
    now = file_hashes(spark, folder)
    manifest = Path(cache) / "manifest.json"
    if manifest.exists() and json.loads(manifest.read_text()) == now:
        return spark.read.parquet(f"{cache}/rows.parquet"), True
    read_packages(spark, folder).write.mode("overwrite").parquet(f"{cache}/rows.parquet")
    manifest.write_text(json.dumps(now))
    return spark.read.parquet(f"{cache}/rows.parquet"), False
