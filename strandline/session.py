"""Sessions as tests, bench and examples use them; library code takes whatever session it is given."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("strandline")
    for key, value in {
        "spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("STRANDLINE_MEMORY", "8g"), "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "8m", "spark.sql.files.openCostInBytes": "1m",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once for several uses: a reliable checkpoint where a shared folder is set, else kept by Spark."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None and (where := spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()
