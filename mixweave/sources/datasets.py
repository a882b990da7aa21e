"""Synthetic mixtures, made on the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: How much the noise of anisotropic blobs is stretched along the first and the last axis (fixed values).
SCALES = (0.25, 3.0)


def centres_of(seed: int, k: int, d: int, spread: float) -> np.ndarray:
    """The centres of blobs: the first draws of the seed."""
    return np.random.default_rng(seed).normal(size=(k, d)) * spread


def _noise(spark: SparkSession, n: int, d: int, k: int, seed: int) -> DataFrame:
    noise = F.array(*[F.randn(seed + 1 + i) for i in range(d)])
    return spark.range(n).select(F.col("id").alias("row_id"), F.pmod(F.col("id"), F.lit(k)).cast("int").alias("component"), noise.alias("noise"))


def _placed(rows: DataFrame, centres: np.ndarray, noise) -> DataFrame:
    table = F.array(*[F.array(*map(F.lit, map(float, c))) for c in centres])
    return rows.select("row_id", "component", F.zip_with(F.get(table, F.col("component")), noise, lambda c, e: c + e).alias("features"))


def blobs(spark: SparkSession, n: int, d: int, k: int, seed: int = 0, spread: float = 5.0, noise: float = 1.0) -> DataFrame:
    """(row_id, component, features): k isotropic Gaussians around centres spread apart."""
    centres = centres_of(seed, k, d, spread)
    return _placed(_noise(spark, n, d, k, seed), centres, F.transform("noise", lambda e: e * noise))


def anisotropic_blobs(spark: SparkSession, n: int, d: int, k: int, seed: int = 0, spread: float = 5.0, scales: tuple[float, float] = SCALES) -> DataFrame:
    """Blobs whose noise is stretched by scales along the axes of one random rotation."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d)) * spread
    rotation, _ = np.linalg.qr(rng.normal(size=(d, d)))
    mixing = rotation * np.linspace(*scales, d)
    rows = F.array(*[F.array(*map(F.lit, map(float, r))) for r in mixing])
    stretched = F.transform(rows, lambda r: F.aggregate(F.zip_with(r, F.col("noise"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    return _placed(_noise(spark, n, d, k, seed), centres, stretched)
