"""Readers that keep small inputs parallel."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clauselake.sources.corpus import shared_dir


def keep(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes a frame to the shared folder and reads it again: what is read more than once is computed once."""

    def store(df: DataFrame) -> DataFrame:
        path = f"{shared_dir(spark)}/clauselake/kept-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return store


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over the cores when the scan has fewer splits than cores.

    A large input has many splits, even in few files, and passes through untouched; a small one costs one cheap
    exchange.  Only the number of splits is planned here, nothing runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Chosen columns of one of the given parquet tables."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Chosen columns of the documents, spread over the cores."""
    return spread(read_table(spark, sf_dir, "documents", "doc_id", *columns), "doc_id")
