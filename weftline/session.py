"""Session helpers: a local session for tests, table loading and reliable checkpoints."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine is tuned for; extra settings win."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("WEFTLINE_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("weftline")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    share_code(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a directory of files) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_code(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package.

    On one machine they get its folder; to other machines a zip of it is sent once.
    """
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if str(root) not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([str(root), *filter(None, paths)])
        if not context.master.startswith("local"):
            made = shutil.make_archive(f"{tempfile.mkdtemp()}/weftline", "zip", root, "weftline")
            context.addPyFile(made)


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the session's shared folder.

    spark.checkpoint.dir names the folder. Only a local master may go without that setting; it
    then gets a temporary folder. On a cluster a missing setting is an error, as a folder of one
    machine would not survive it. Spark deletes a checkpoint that nothing refers to any more where
    spark.cleaner.referenceTracking.cleanCheckpoints is set, as local_session does.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="weftline-checkpoint-")
        context.setCheckpointDir(shared)
    return df.checkpoint()
