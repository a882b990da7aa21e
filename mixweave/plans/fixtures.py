"""Feature tables that the registered queries work on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixweave.functions.params import Mixture
from mixweave.operators import initialize, stats
from mixweave.sources.features import doubles, vector

LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
REG = 1e-6


@dataclass(frozen=True)
class Fixture:
    table: str
    keys: tuple[str, ...]
    d: int
    k: int
    batch: str | None = None


FIXTURES = {
    "emb64": Fixture("embeddings", ("vec_id",), 64, 10),
    "li4": Fixture("lineitem", LINE_KEYS, 4, 5),
    "li2": Fixture("lineitem", LINE_KEYS, 2, 3),
    "li4b": Fixture("lineitem", LINE_KEYS, 4, 2, "l_returnflag"),
    "ev1": Fixture("events", ("event_id",), 1, 3),
    "ev1u": Fixture("events", ("event_id",), 1, 2, "user_id"),
    "ord1y": Fixture("orders", ("o_orderkey",), 1, 2, "o_orderdate"),
}


def data(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Key columns, batch_id for a batched fixture, and features."""
    f = FIXTURES[name]
    rows = spark.read.parquet(f"{sf_dir}/{f.table}.parquet")
    if f.table == "embeddings":
        features = doubles("embedding")
    elif f.table == "events":
        features = vector("value")
    elif f.table == "orders":  # batches are the years of the orders
        features = vector(F.col("o_totalprice") / 100000)
        return rows.select(*f.keys, F.col("o_orderdate").alias("at"), F.year("o_orderdate").alias("batch_id"), features.alias("features"))
    else:
        scaled = [F.col("l_quantity") / 10, F.col("l_extendedprice") / 10000, F.col("l_discount") * 10, F.col("l_tax") * 10]
        features = vector(*scaled[: f.d])
    return rows.select(*f.keys, *([F.col(f.batch).alias("batch_id")] if f.batch else []), features.alias("features"))


def first_rows(rows: DataFrame, f: Fixture) -> tuple[list, np.ndarray]:
    """Batch keys, and the features of the k rows that come first by key in each: a top-k per batch, not a sort."""
    first = F.row_number().over(Window.partitionBy(*(["batch_id"] if f.batch else [F.lit(0)])).orderBy(*f.keys))
    found = rows.withColumn("place", first).where(F.col("place") <= f.k).orderBy("place").collect()
    keys = sorted({r.batch_id for r in found}) if f.batch else [None]
    means = [[r.features for r in found if not f.batch or r.batch_id == key] for key in keys]
    return keys, np.array(means, float)


def user_start(rows: DataFrame, name: str, kind: str) -> Mixture:
    """First rows as means, equal weights, global covariance."""
    f = FIXTURES[name]
    keys, means = first_rows(rows, f)
    moments = stats.moments(rows, f.d, "batch_id" if f.batch else None, kind)
    return initialize.given(kind, means, [moments[key] for key in keys], REG, keys)
