"""A mixture's fit at every level of grouping columns, from one pass over the rows.

Rows are scored and summed by all columns together first; counts, log-likelihoods and responsibilities are mergeable, so the levels of the
cube (or rollup) are sums over those few partial rows, not over copies of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixweave.functions.params import Mixture
from mixweave.operators import density


def fit_by_level(data: DataFrame, mixture: Mixture, by: list[str], rollup: bool = False, strategy: str = "auto") -> DataFrame:
    """(by..., level, n, log_likelihood, aic, bic, shares) for each group of each level of by; level is the grouping id, in which a bit is set for each column that is summed over.

    shares has the part of each component among the group's rows. Rows with a bad vector count at no level, and a null in by is a group of its own, told from a summed column by level.
    """
    k, p = mixture.shape[1], mixture.free_parameters()
    rows = density.with_logits(data, mixture, strategy=strategy, column="_logits").where("_logits IS NOT NULL")
    rows = rows.select(*by, density.log_prob(F.col("_logits")).alias("_ll"), density.proba(F.col("_logits")).alias("_proba"))
    sums = [F.count("*").alias("n"), F.sum("_ll").alias("log_likelihood"), *[F.sum(F.get("_proba", F.lit(i))).alias(f"_r{i}") for i in range(k)]]
    partial = rows.groupBy(*by).agg(*sums)
    grouped = partial.rollup(*by) if rollup else partial.cube(*by)
    levels = grouped.agg(F.grouping_id().cast("int").alias("level"), *[F.sum(c).alias(c) for c in ("n", "log_likelihood", *[f"_r{i}" for i in range(k)])])
    ll, n = F.col("log_likelihood"), F.col("n")
    levels = levels.where("n > 0")  # the total of an empty table
    return levels.select(*by, "level", "n", "log_likelihood", (-2.0 * ll + 2.0 * p).alias("aic"), (-2.0 * ll + p * F.log(n)).alias("bic"), F.array(*[F.col(f"_r{i}") / n for i in range(k)]).alias("shares"))
