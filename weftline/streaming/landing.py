"""Package files as a stream: a landing folder is watched and each batch of files is scanned."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.sources.packages import SCHEMA, parse_package

FILES = "path string, modificationTime timestamp, length long, content binary"


def package_stream(spark: SparkSession, folder: str, pattern: str = "*.dtsx") -> DataFrame:
    """The rows of packages as they land in a folder; files that come again are scanned again."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [row for path, content in zip(frame["path"], frame["content"], strict=True) for row in parse_package(bytes(content), path)]
            yield pd.DataFrame(out, columns=["kind", "package_id", "id", "name", "type", "parent_id", "fields"])

    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(parse, SCHEMA)


def start(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch of rows to handle(rows, batch id); what is done is kept in checkpoint."""
    return package_stream(spark, folder).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def operation_counts(maps: DataFrame, time: str = "scanned_at", late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Maps of a stream by operation and time window; rows later than late are left out."""
    return maps.withWatermark(time, late).groupBy(F.window(time, window), "operation_type").agg(F.count("*").alias("n"))
