"""Feature columns: assembly, validity and standard scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector(*columns: str | Column) -> Column:
    """One array<double> from scalar columns."""
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])


def doubles(column: str | Column) -> Column:
    """An array column with elements cast to double."""
    return F.transform(F.col(column) if isinstance(column, str) else column, lambda x: x.cast("double"))


def valid(features: Column, d: int) -> Column:
    """Whether a feature vector has d elements, none of them null, NaN or infinite; null counts as not."""
    return F.coalesce((F.size(features) == d) & F.forall(features, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def standard_scaled(data: DataFrame, columns: list[str]) -> DataFrame:
    """The columns less their mean, over their population deviation (a constant column becomes 0). One aggregate, two numbers per column."""
    moments = data.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("dev", F.stddev_pop))]).first()
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.lit(moments[f"mean_{c}"]), F.lit(moments[f"dev_{c}"])), F.lit(0.0))
    return data.select(*[c for c in data.columns if c not in columns], *[scaled(c).alias(c) for c in columns])
