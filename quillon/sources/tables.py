"""Parquet tables by folder and name, and what is in force of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files_in_force(files: DataFrame, *columns: str) -> DataFrame:
    """path and columns of the latest row of each path. Only the columns asked for are shuffled."""
    latest = F.max_by(F.struct(*columns), F.coalesce("indexed_at", F.lit("1970-01-01").cast("timestamp_ntz"))).alias("_row")
    return files.where(F.col("path").isNotNull()).groupBy("path").agg(latest).select("path", "_row.*")


def versioned(files: DataFrame) -> DataFrame:
    """files with _at, the row's time as a number; no time is earlier than any."""
    return files.where(F.col("path").isNotNull()).withColumn("_at", F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(-(1 << 62))))


def latest(derived: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Rows that were derived from versioned(files), of the states in force only, distinct and without _at.

    What is derived is made per state and then told apart by time, so that contents stay where they are read: only times and results move.
    """
    last = versioned(files).groupBy(F.col("path").alias(path)).agg(F.max("_at").alias("_at"))
    return derived.join(last, [path, "_at"]).drop("_at").distinct()


def chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Distinct chunks, cut down to the columns asked for."""
    return table(spark, folder, "chunks").select(*dict.fromkeys(["id", *columns])).distinct()
