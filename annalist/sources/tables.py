"""The given parquet tables, spread over the cores when a file is too small to split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame, heavy: bool = True) -> DataFrame:
    """Give CPU-bound expressions all cores.

    A scan with fewer splits than cores (one small file) is redistributed once. A large
    scan already has more splits than cores and is returned as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not heavy or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
