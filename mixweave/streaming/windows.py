"""How well a mixture fits a stream, window by window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mixweave.functions.params import Mixture
from mixweave.operators import density


def window_fit(rows: DataFrame, mixture: Mixture, at: str, length: str, late: str | None = None, slide: str | None = None, by: tuple[str, ...] = (), strategy: str = "auto") -> DataFrame:
    """(by..., window_start, window_end, n, log_likelihood, mean_score, label_counts) for each window of event time and each value of by.

    On a stream, late says how far behind the latest time a row may come: the state of a window is kept so long, after which it is final and later rows don't count. Rows with a
    null time or a bad vector count in no window. The sums are mergeable, so a hot window or key is summed in the tasks that read it.
    """
    k = mixture.shape[1]
    scored = density.with_logits(rows.withWatermark(at, late) if late else rows, mixture, strategy=strategy, column="_logits").where("_logits IS NOT NULL")
    label = density.label(F.col("_logits"))
    counts = [F.count_if(label == i) for i in range(k)]
    grouped = scored.groupBy(*by, F.window(at, length, slide).alias("_window"))
    found = grouped.agg(F.count("*").alias("n"), F.sum(density.log_prob(F.col("_logits"))).alias("log_likelihood"), *[c.alias(f"_n{i}") for i, c in enumerate(counts)])
    return found.select(*by, F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), "n", "log_likelihood", (F.col("log_likelihood") / F.col("n")).alias("mean_score"), F.array(*[F.col(f"_n{i}") for i in range(k)]).alias("label_counts"))


def write_windows(stream: DataFrame, mixture: Mixture, at: str, length: str, late: str, path: str, checkpoint: str, slide: str | None = None, by: tuple[str, ...] = (), **trigger) -> StreamingQuery:
    """Appends each window to a Parquet table once it is final, exactly once."""
    found = window_fit(stream, mixture, at, length, late, slide, by)
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
