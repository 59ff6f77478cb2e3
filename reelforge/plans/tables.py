"""The test tables, and views of them in the shapes the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.functions.progress import epoch_ms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TASK_ROWS = 20_000  # of a task that works out costly columns


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt, by keys if any, to as many tasks as its costly columns want: a small file is one split, however long its rows take."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS)), *keys)


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as playback progress: a profile, a title, a stamp and a percent."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("profile"), F.col("event_type").alias("title"), epoch_ms(F.col("ts")).alias("stamp"), F.col("value").alias("percent"))
