"""Scan layout."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Give every core a part of an input that is read in fewer parts than there are cores.

    A file of one row group is one task however long its texts take. Larger inputs are read in
    more parts than that and pass through unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
