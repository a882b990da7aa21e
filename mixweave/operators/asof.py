"""As-of joins: each row meets the version that is valid at its time; and scores by dated mixtures.

Rows and versions are put in one order by time, and the last version before a row is its own: one sort, no range join. A key (or, without keys, the table)
with more than SALT_ROWS rows is dealt out to several parts, each of which gets all its versions, so no task sorts an unbounded group.

A version counts from its own time on, that time included. Of versions with one key and time, the one with the greatest values counts. Rows before the first version,
with a null time, or with a key that has no version, meet null. Null keys are a key like any other; versions with a null time never count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixweave.operators import keyed

SALT_ROWS = 1 << 20


def _same(a: str, b: str, keys: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys], F.lit(True))


def as_of(rows: DataFrame, versions: DataFrame, at: str, since: str, keys: tuple[str, ...] = (), into: str = "version") -> DataFrame:
    """rows with a column of that name: a struct of the columns of versions beside keys and since, of the last version with since <= at."""
    if into in rows.columns:
        raise ValueError(f"rows have a column {into} already")
    values = [c for c in versions.columns if c not in keys]
    named = [F.col(f"`{k}`") for k in keys]
    once = versions.where(F.col(f"`{since}`").isNotNull()).groupBy(*named, F.col(f"`{since}`").alias("_at")).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in values])).alias("_version"))
    # keys that need parts are at most one in SALT_ROWS rows
    busy = rows.groupBy(*named).agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("_parts")).where("_parts > 1")
    begun = once.alias("v").join(busy.alias("b"), _same("v", "b", keys), "left").select("v.*", F.explode(F.sequence(F.lit(0), F.coalesce("b._parts", F.lit(1)) - 1)).alias("_part"))
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    asked = rows.select(*named, F.col(f"`{at}`").alias("_at"), whole.alias("_row"))
    asked = asked.alias("r").join(busy.alias("b"), _same("r", "b", keys), "left").select("r.*", F.pmod(F.xxhash64("r._row"), F.coalesce("b._parts", F.lit(1))).cast("int").alias("_part"))
    union = begun.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).withColumn("_side", F.lit(0)).unionByName(
        asked.withColumn("_version", F.lit(None).cast(once.schema["_version"].dataType)).withColumn("_side", F.lit(1))
    )
    order = Window.partitionBy(*named, "_part").orderBy(F.asc_nulls_first("_at"), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = union.withColumn("_last", F.last("_version", ignorenulls=True).over(order)).where("_side = 1")
    return met.select("_row.*", F.col("_last").alias(into))


def score_dated(rows: DataFrame, fitted: keyed.KeyedFit, versions: DataFrame, at: str, what: tuple[str, ...] = ("label", "log_prob"), into: str = "version") -> DataFrame:
    """rows scored by the mixture that is valid at their time. fitted has a mixture for each batch key, versions (batch, since) say from when on each counts; a row without one has nulls."""
    met = as_of(rows, versions.select(F.col("batch").cast("string").alias("batch"), "since"), at, "since", into=into)
    return keyed.predict(met.withColumn(into, F.col(f"{into}.batch")), fitted, into, what, missing=True)
