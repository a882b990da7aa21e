"""Saving and loading mixtures as Parquet tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mixweave.functions.params import Mixture


def save(spark: SparkSession, mixture: Mixture, path: str, mode: str = "error") -> None:
    mixture.to_frame(spark).withColumn("covariance_type", F.lit(mixture.kind)).coalesce(1).write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> Mixture:
    frame = spark.read.parquet(path)
    return Mixture.from_frame(frame, frame.select("covariance_type").first()[0])
