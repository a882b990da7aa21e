"""Log-densities, labels, responsibilities and scores as columns.

Two strategies give the same numbers. "columns" writes each component out as an expression, which stays inside generated
code; it suits small models. "arrow" sends batches of vectors through numpy, in tiles of rows and components: labels, scores and
best components come from running results that tile after tile is merged into, so K of any size needs no K numbers for each row. "auto" chooses by the number of terms.
All are projections: nothing runs before an action, nothing is shuffled, and a streaming DataFrame works as well.

A null feature vector, one of another length or with a value that isn't finite has null results; so has a batch key the model lacks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixweave.functions import numeric
from mixweave.functions.numeric import Terms
from mixweave.functions.params import Mixture
from mixweave.sources.features import valid

STRATEGIES = ("auto", "columns", "arrow")
WIDEST = 64  # terms up to which expressions are written out
ROWS = 2048  # whose logits are held at once
MOST_VALUES = 1 << 20  # numbers in a record batch of whole rows of logits


def choose(strategy: str, terms: int) -> str:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    return strategy if strategy != "auto" else "columns" if terms <= WIDEST else "arrow"


def terms_of(mixture: Mixture) -> int:
    b, k, d = mixture.shape
    return b * k * (d * d if mixture.kind == "full" else d)


def _written_out(features: Column, terms: Terms) -> Column:
    """The array of joint log-densities as one expression; differences are taken before squaring."""
    x = [F.get(features, F.lit(i)) - float(s) for i, s in enumerate(terms.shift)]

    def projected(matrix: np.ndarray) -> list[Column]:
        return [sum((float(matrix[i, j]) * x[i] for i in range(1, len(x))), float(matrix[0, j]) * x[0]) for j in range(len(x))]

    shared = projected(terms.project) if terms.kind == "tied" else x
    found = []
    for k, (centre, scale, constant) in enumerate(zip(terms.centres, terms.scale, terms.constant, strict=True)):
        mine = projected(terms.project[k]) if terms.kind == "full" else shared
        square = None
        for value, c, s in zip(mine, centre, scale, strict=True):
            term = (value - float(c)) * (value - float(c)) * float(s)
            square = term if square is None else square + term
        found.append(float(constant) - 0.5 * square)
    return F.array(*found)


def logits(mixture: Mixture, features: Column | str = "features", batch: Column | str | None = None, strategy: str = "auto") -> Column:
    """The array of a row's joint log-densities, one for each component."""
    features = F.col(features) if isinstance(features, str) else features
    batch = F.col(batch) if isinstance(batch, str) else batch
    terms = [Terms(mixture, b) for b in range(mixture.shape[0])]
    d = mixture.shape[2]
    if choose(strategy, terms_of(mixture)) == "columns":
        if batch is None:
            found = _written_out(features, terms[0])
        else:
            found = F.lit(None).cast("array<double>")
            for key, t in zip(mixture.keys, terms, strict=True):
                found = F.when(batch.cast("string") == str(key), _written_out(features, t)).otherwise(found)
        return F.when(valid(features, d), found)

    return _by_arrow(mixture, features, batch, "array<double>", lambda t, x: lists(t.logits(x)))


def lists(values: np.ndarray, inner: pa.Array | None = None) -> pa.ListArray:
    """The rows of a matrix as lists (of the values of inner, if given)."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()) if inner is None else inner)


def _by_arrow(mixture: Mixture, features: Column, batch: Column | None, kind: str, finish: Callable[[Terms, np.ndarray], pa.Array]) -> Column:
    """finish(terms, row matrix) for the rows with a valid vector and a known batch key, in tiles of ROWS rows; null for the others."""
    terms, d = [Terms(mixture, b) for b in range(mixture.shape[0])], mixture.shape[2]
    keys = {str(key): b for b, key in enumerate(mixture.keys)} if batch is not None else {}

    @F.arrow_udf(kind)
    def dense(x: pa.Array, key: pa.Array) -> pa.Array:
        at = np.array([keys.get(name, -1) for name in key.to_pylist()]) if keys else np.zeros(len(x), int)
        known = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False) & (at >= 0))
        rows = np.asarray(x.take(pa.array(known)).flatten()).reshape(-1, d)
        found, places = [], []
        for b in np.unique(at[known]):
            mine = np.flatnonzero(at[known] == b)
            for lo in range(0, len(mine), ROWS):
                some = mine[lo : lo + ROWS]
                found.append(finish(terms[b], rows[some]))
                places.append(known[some])
        if not found:
            return pa.nulls(len(x), finish(terms[0], np.zeros((1, d))).type)
        back = np.full(len(x), -1)
        back[np.concatenate(places)] = np.arange(len(known))
        return pa.concat_arrays(found).take(pa.array(back, mask=back < 0))

    return dense(F.when(valid(features, d), features), F.lit("") if batch is None else batch.cast("string"))


def label(logit: Column) -> Column:
    """The first of the most likely components."""
    return (F.array_position(logit, F.array_max(logit)) - 1).cast("int")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row even where a lambda refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_prob(logit: Column) -> Column:
    """The log-density: a log-sum-exp around the largest term."""
    return let(F.array_max(logit), lambda top: top + F.log(F.aggregate(logit, F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def proba(logit: Column) -> Column:
    return let(log_prob(logit), lambda total: F.transform(logit, lambda x: F.exp(x - total)))


def top_components(logit: Column, top_k: int) -> Column:
    """The top_k components of a row, best first, as structs of component and logit; of equal ones, the lower first."""
    if top_k < 1:
        raise ValueError("top_k must be positive")
    ordered = F.array_sort(F.transform(logit, lambda x, i: F.struct((-x).alias("cost"), i.alias("k"))))
    return F.transform(F.slice(ordered, 1, top_k), lambda s: F.struct(s["k"].alias("k"), (-s["cost"]).alias("logit")))


def _wide(data: DataFrame, mixture: Mixture, batch: str | None, column: str, finish: Callable[[Terms, np.ndarray], np.ndarray]) -> DataFrame:
    """data with K numbers for each row, passed on in record batches of MOST_VALUES at most."""
    terms, d, k = [Terms(mixture, b) for b in range(mixture.shape[0])], mixture.shape[2], mixture.shape[1]
    keys = {str(key): b for b, key in enumerate(mixture.keys)} if batch else {}
    at = len(data.columns)
    rows = data.select("*", F.when(valid(F.col("features"), d), F.col("features")).alias("_x"), (F.col(batch).cast("string") if batch else F.lit("")).alias("_key"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, max(1, MOST_VALUES // k)):
                part = whole.slice(lo, max(1, MOST_VALUES // k))
                b = np.array([keys.get(name, -1) for name in part.column(at + 1).to_pylist()]) if batch else np.zeros(part.num_rows, int)
                known = part.column(at).is_valid().to_numpy(zero_copy_only=False) & (b >= 0)
                x = np.asarray(part.column(at).filter(pa.array(known)).flatten()).reshape(-1, d)
                out = np.empty((len(x), k))
                for j in np.unique(b[known]):
                    out[b[known] == j] = finish(terms[j], x[b[known] == j])
                back = np.where(known, np.cumsum(known) - 1, -1)
                made = lists(out).take(pa.array(back, mask=~known))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], made], names=[*part.schema.names[:at], column])

    return rows.mapInArrow(task, T.StructType([*data.schema.fields, T.StructField(column, T.ArrayType(T.DoubleType()))]))


def with_logits(data: DataFrame, mixture: Mixture, batch: str | None = None, strategy: str = "auto", column: str = "logits") -> DataFrame:
    if mixture.shape[1] > numeric.TILE and choose(strategy, terms_of(mixture)) == "arrow":
        return _wide(data, mixture, batch, column, Terms.logits)
    return data.withColumn(column, logits(mixture, "features", batch, strategy))


def _reduced(data: DataFrame, mixture: Mixture, batch: str | None, strategy: str, column: str, kind: str, finish: Callable[[Terms, np.ndarray], pa.Array], written: Callable[[Column], Column]) -> DataFrame:
    """data with a column made of each row's logits: written(logits) as an expression, or finish(terms, rows) in Arrow."""
    if choose(strategy, terms_of(mixture)) == "arrow":
        return data.withColumn(column, _by_arrow(mixture, F.col("features"), F.col(batch) if batch else None, kind, finish))
    return with_logits(data, mixture, batch, strategy, "_logits").withColumn(column, written(F.col("_logits"))).drop("_logits")


def assign(data: DataFrame, mixture: Mixture, batch: str | None = None, strategy: str = "auto") -> DataFrame:
    return _reduced(data, mixture, batch, strategy, "label", "int", lambda t, x: pa.array(numeric.labels(t.tiles(x)), pa.int32()), label)


def score_samples(data: DataFrame, mixture: Mixture, batch: str | None = None, strategy: str = "auto") -> DataFrame:
    return _reduced(data, mixture, batch, strategy, "log_prob", "double", lambda t, x: pa.array(numeric.log_probs(t.tiles(x))), log_prob)


def best_components(data: DataFrame, mixture: Mixture, top_k: int, batch: str | None = None, strategy: str = "auto", column: str = "top") -> DataFrame:
    """data with the top_k components of each row, as top_components has them."""
    if top_k < 1:
        raise ValueError("top_k must be positive")

    def finish(terms: Terms, x: np.ndarray) -> pa.Array:
        at, kept = numeric.top_components(terms.tiles(x), top_k)
        order = np.argsort(-kept, axis=1, kind="stable")
        at, kept = np.take_along_axis(at, order, axis=1), np.take_along_axis(kept, order, axis=1)
        return lists(kept, pa.StructArray.from_arrays([pa.array(at.ravel(), pa.int32()), pa.array(kept.ravel())], ["k", "logit"]))

    return _reduced(data, mixture, batch, strategy, column, "array<struct<k: int, logit: double>>", finish, lambda logit: top_components(logit, top_k))


def predict_proba(data: DataFrame, mixture: Mixture, batch: str | None = None, strategy: str = "auto") -> DataFrame:
    if choose(strategy, terms_of(mixture)) == "arrow":

        def shares(terms: Terms, x: np.ndarray) -> np.ndarray:
            found = terms.logits(x)
            found -= numeric.logsumexp(found)[:, None]
            return np.exp(found, out=found)

        if mixture.shape[1] > numeric.TILE:
            return _wide(data, mixture, batch, "proba", shares)
        return data.withColumn("proba", _by_arrow(mixture, F.col("features"), F.col(batch) if batch else None, "array<double>", lambda t, x: lists(shares(t, x))))
    return with_logits(data, mixture, batch, strategy, "_logits").withColumn("proba", proba(F.col("_logits"))).drop("_logits")


def bic(score: float, n: int, parameters: int) -> float:
    return -2.0 * score + parameters * float(np.log(n))


def aic(score: float, parameters: int) -> float:
    return -2.0 * score + 2.0 * parameters
