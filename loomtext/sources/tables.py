"""Parquet tables, spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table in at least as many partitions as the cluster has cores.

    A table that its files leave in fewer (one file, one row group) is dealt
    round; any larger one is read where it lies, without a shuffle.
    """
    table = read_table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
