"""Runs of one label over time for each key, and how the score changes from run to run.

A key's rows are looked at in order of time. The rows of a hot key (more than SLICE_ROWS) are first cut into slices of time at
quantiles, so that no task sorts an unbounded group: runs are found in each slice, and only the first and the last run of a slice go
through a window over the whole key, which joins those that continue. Run numbers and previous runs come from one row for each slice in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 1 << 20
SLICES = 256  # of a hot key


def sliced(rows: DataFrame, key: str, at: str) -> DataFrame:
    """rows with _slice, 0 for keys that aren't hot; later times never have a smaller slice."""
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > SLICE_ROWS).select(F.col(key).alias("_hot"))  # at most one in SLICE_ROWS rows
    cuts = rows.join(hot, rows[key].eqNullSafe(hot["_hot"]), "left_semi").groupBy(key).agg(F.percentile_approx(F.unix_micros(at), [(i + 1) / SLICES for i in range(SLICES - 1)], 10_000).alias("_cuts"))
    cuts = cuts.withColumnRenamed(key, "_hot")
    micros = F.unix_micros(at)
    place = F.aggregate("_cuts", F.lit(0), lambda n, c: n + (c < micros).cast("int"))
    return rows.join(cuts, rows[key].eqNullSafe(cuts["_hot"]), "left").withColumn("_slice", F.coalesce(place, F.lit(0))).drop("_hot", "_cuts")


def label_runs(rows: DataFrame, key: str, at: str, tie: str, label: str = "label", score: str = "log_prob") -> DataFrame:
    """(key, run, label, first, last, n, micros, mean_score, change) for each run, a stretch of a key's rows by (at, tie) with one label that no neighbour continues.

    run counts from 1 for each key; first and last are the tie values of its first and last row, micros the time between them; mean_score is the mean of score
    over the rows that have one, and change its difference from the run before (null for the first run, or without a score). A null label is a label
    of its own, a null key a key of its own; rows with a null time are left out. (at, tie) should tell a key's rows apart.
    """
    cut = sliced(rows.where(F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).cast("timestamp").alias("_at"), F.col(tie).alias("_tie"), F.col(label).alias("_label"), F.col(score).alias("_score")), "_key", "_at")
    place = F.struct("_at", "_tie")
    inside = Window.partitionBy("_key", "_slice").orderBy("_at", "_tie")
    starts = F.when(F.row_number().over(inside) == 1, 1).otherwise((~F.col("_label").eqNullSafe(F.lag("_label").over(inside))).cast("int"))
    numbered = cut.withColumn("_starts", starts).withColumn("_piece", F.sum("_starts").over(inside))
    pieces = numbered.groupBy("_key", "_slice", "_piece").agg(F.first("_label").alias("_label"), F.min(place).alias("_first"), F.max(place).alias("_last"), F.count("*").alias("n"), F.count("_score").alias("_scored"), F.sum("_score").alias("_sum"))
    edges = pieces.withColumn("_most", F.max("_piece").over(Window.partitionBy("_key", "_slice")))
    border = (F.col("_piece") == 1) | (F.col("_piece") == F.col("_most"))
    over_key = Window.partitionBy("_key").orderBy("_slice", "_piece")
    # of two border pieces of a slice with others between them, the second never continues the first: those between have other labels next to it
    follows = (F.lag("_slice").over(over_key) != F.col("_slice")) & F.lag("_label").over(over_key).eqNullSafe(F.col("_label"))
    chained = edges.where(border).withColumn("_chain", F.sum((~F.coalesce(follows, F.lit(False))).cast("int")).over(over_key))
    sums = [F.sum(c).alias(c) for c in ("n", "_scored", "_sum")]
    joined = chained.groupBy("_key", "_chain").agg(F.min("_slice").alias("_slice"), F.first("_label").alias("_label"), F.min("_first").alias("_first"), F.max("_last").alias("_last"), *sums).drop("_chain")
    columns = ["_key", "_slice", "_label", "_first", "_last", "n", "_scored", "_sum"]
    runs = joined.select(*columns).unionByName(edges.where(~border).select(*columns)).withColumn("_mean", F.try_divide("_sum", "_scored"))
    ordered = Window.partitionBy("_key", "_slice").orderBy("_first")
    runs = runs.withColumn("_place", F.row_number().over(ordered)).withColumn("_before", F.lag(F.struct("_mean")).over(ordered))
    slices = runs.groupBy("_key", "_slice").agg(F.count("*").alias("_runs"), F.max_by(F.struct("_mean"), "_first").alias("_end"))
    by_slice = Window.partitionBy("_key").orderBy("_slice")
    slices = slices.select(F.col("_key").alias("_k"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_runs").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"), F.lag("_end").over(by_slice).alias("_previous"))
    found = runs.join(slices, runs["_key"].eqNullSafe(slices["_k"]) & (runs["_slice"] == slices["_s"]))
    before = F.when(F.col("_place") == 1, F.col("_previous")).otherwise(F.col("_before"))
    return found.select(
        F.col("_key").alias(key),
        (F.col("_earlier") + F.col("_place")).cast("long").alias("run"),
        F.col("_label").alias("label"),
        F.col("_first._tie").alias("first"),
        F.col("_last._tie").alias("last"),
        "n",
        (F.unix_micros("_last._at") - F.unix_micros("_first._at")).alias("micros"),
        F.col("_mean").alias("mean_score"),
        (F.col("_mean") - before["_mean"]).alias("change"),
    )
