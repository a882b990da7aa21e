"""Scoring a stream: predictions are stateless projections, so they apply to a streaming DataFrame as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mixweave.functions.params import Mixture
from mixweave.operators import density


def scored(stream: DataFrame, mixture: Mixture, batch: str | None = None, strategy: str = "auto") -> DataFrame:
    """The stream with label and log_prob."""
    return density.score_samples(density.assign(stream, mixture, batch, strategy), mixture, batch, strategy)


def write_scored(stream: DataFrame, mixture: Mixture, path: str, checkpoint: str, batch: str | None = None, **trigger) -> StreamingQuery:
    """Appends the scored rows to a Parquet table, each input row exactly once."""
    return scored(stream, mixture, batch).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
