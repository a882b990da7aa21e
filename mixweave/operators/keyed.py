"""Mixtures for very many batch keys: parameters are a table with a row for each key, and both halves of an EM step run on the executors.

Rows are dealt out by key, sorted and packed into blocks once; the rows of a hot key (over SALT_ROWS, or a 4096th of all) are dealt to several
salts. The blocks are cached in the partitioning of (key, salt). An iteration joins the parameters to them, which moves
parameters only, adds up statistics in each partition, sums these by key, and updates each key's parameters where its sums meet. The new table is
written to the shared folder, so lineage doesn't grow. The driver sees three numbers for each iteration and nothing for each key.

Batches are independent mixtures that stop together, on the lower bound averaged over all rows, as in operators.em. Starts come from a sample of each key's rows: the least of
uniform draws, at most START_ROWS of them, all rows of a smaller key. k-means++ and Lloyd steps run on the sample, where the key's rows meet. A key with fewer rows
than components draws its centres with replacement. Null keys, and null, NaN, infinite or differently long vectors, are errors; so is an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixweave.functions import numeric
from mixweave.functions.params import MODEL_SCHEMA, Mixture, covariance_type
from mixweave.operators import density, finalize, initialize
from mixweave.operators import stats as st
from mixweave.sources.features import valid
from mixweave.sources.tables import written

SALT_ROWS, MOST_HOT = 1 << 17, 4096
START_ROWS = 1024
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
PARAMS = "batch string, n long, salts int, log_likelihood double, params binary"


def pack_numbers(m: Mixture, shift: np.ndarray) -> bytes:
    """Shift, weights, means (less the shift) and covariances of the one batch of a mixture."""
    return np.concatenate([shift, m.weights.ravel(), m.means.ravel(), m.covariances.ravel()]).tobytes()


def unpack_numbers(data, kind: str, k: int, d: int, key: str | None = None) -> tuple[Mixture, np.ndarray]:
    v = np.frombuffer(data)
    shape = {"spherical": (1, k), "diag": (1, k, d), "tied": (1, d, d), "full": (1, k, d, d)}[kind]
    return Mixture(kind, v[d : d + k][None], v[d + k : d + k + k * d].reshape(1, k, d), v[d + k + k * d :].reshape(shape), [key]), v[:d]


@dataclass
class KeyedFit:
    """What a keyed fit did; params has a row for each key (PARAMS)."""

    params: DataFrame
    kind: str
    k: int
    d: int
    n_rows: int
    n_keys: int
    lower_bound_history: list[float]

    @property
    def n_iter(self) -> int:
        return len(self.lower_bound_history)

    @property
    def model(self) -> DataFrame:
        """One row for each key and component (MODEL_SCHEMA), like Mixture.to_frame."""
        kind, k, d = self.kind, self.k, self.d
        some = max(1, BATCH_BYTES // (8 * k * d * (d if kind in ("tied", "full") else 1)))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for lo in range(0, rows.num_rows, some):
                    part = rows.slice(lo, some)
                    found = [unpack_numbers(data.as_buffer(), kind, k, d) for data in part.column(1)]
                    means, cov = np.concatenate([m.means[0] + shift for m, shift in found]), np.concatenate([m.component_covariances()[0].reshape(k, -1) for m, _ in found])
                    keys = [key for key in part.column(0).to_pylist() for _ in range(k)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.tile(np.arange(k), len(found)), pa.int32()), pa.array(np.concatenate([m.weights[0] for m, _ in found])), density.lists(means), density.lists(cov)], names=["batch_id", "k", "weight", "mean", "cov"])

        return self.params.select("batch", "params").mapInArrow(task, MODEL_SCHEMA)


def _records(rows: Iterator[tuple], schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of up to BATCH_ROWS rows and about BATCH_BYTES; the last value of a row is its bytes."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*held, strict=True), schema, strict=True)], names=[n for n, _ in schema])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) == BATCH_ROWS or size > BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def packed_by_key(rows: DataFrame, sizes: DataFrame, n_rows: int) -> DataFrame:
    """(batch, salt, n, block), cached in the partitioning of batch and salt."""
    most = max(SALT_ROWS, -(-n_rows // MOST_HOT))
    hot = sizes.where(F.col("n") > most).select("batch", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))  # MOST_HOT rows at most
    salt = F.pmod(F.xxhash64("features") + F.spark_partition_id(), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    dealt = rows.join(F.broadcast(hot), "batch", "left").select("batch", salt, "features")
    fields = [("batch", pa.string()), ("salt", pa.int32()), ("n", pa.int64()), ("block", pa.binary())]

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, at = [], None

        def block() -> tuple:
            x = np.concatenate(held)
            return (*at, len(x), x.tobytes())

        for b in batches:
            key = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            x, lo = st.matrix(b.column(2)).astype(float), 0
            while lo < len(key):
                hi = lo + 1
                while hi < len(key) and key[hi] == key[lo]:
                    hi += 1
                for start in range(lo, hi, st.PACK_ROWS):
                    some = x[start : min(hi, start + st.PACK_ROWS)]
                    if held and (at != key[lo] or sum(map(len, held)) + len(some) > st.PACK_ROWS):
                        yield block()
                        held = []
                    at = key[lo]
                    held.append(some)
                lo = hi
        if held:
            yield block()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _records(blocks_of(batches), fields)

    size = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = dealt.repartition(size, "batch", "salt").sortWithinPartitions("batch", "salt").mapInArrow(task, "batch string, salt int, n long, block binary")
    return blocks.repartition(size, "batch", "salt").persist(StorageLevel.MEMORY_AND_DISK)


def sums(blocks: DataFrame, width: int, measure: Callable, salted: DataFrame | None = None) -> DataFrame:
    """(batch, params, stats): measure(total, params, matrix) adds to a vector of width numbers for each key; a row for each key and partition. salted has batch, salt and params."""
    rows = blocks.select("batch", "n", "block", F.lit(None).cast("binary").alias("params")) if salted is None else blocks.join(salted.hint("shuffle_hash"), ["batch", "salt"]).select("batch", "n", "block", "params")
    fields = [("batch", pa.string()), ("params", pa.binary()), ("stats", pa.binary())]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict[str, tuple] = {}
        for b in batches:
            for key, n, block, params in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if key not in held:
                    if (len(held) + 1) * width > st.HELD:
                        yield from ((name, p, v.tobytes()) for name, (p, v) in held.items())
                        held.clear()
                    held[key] = (params.as_py(), np.zeros(width))
                measure(held[key][1], held[key][0], np.frombuffer(block.as_buffer()).reshape(n, -1))
        yield from ((name, p, v.tobytes()) for name, (p, v) in held.items())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _records(added(batches), fields)

    return rows.mapInArrow(task, "batch string, params binary, stats binary")


def _total(table: pa.Table) -> np.ndarray:
    return sum(np.frombuffer(v.as_buffer()) for chunk in table["stats"].chunks for v in chunk)


def moment_width(kind: str, d: int) -> int:
    return 1 + d + (d * d if kind in ("tied", "full") else d)


def moments_by_key(blocks: DataFrame, kind: str, d: int) -> DataFrame:
    """(batch, stats): rows, sums, and squares (or x xᵀ for tied and full) of each key."""

    def measure(total: np.ndarray, _, x: np.ndarray) -> None:
        total[0] += len(x)
        total[1 : 1 + d] += x.sum(axis=0)
        total[1 + d :] += (x.T @ x).ravel() if kind in ("tied", "full") else (x * x).sum(axis=0)

    def together(table: pa.Table) -> pa.Table:
        return pa.table({"batch": table["batch"][:1], "stats": pa.array([_total(table).tobytes()], pa.binary())})

    return sums(blocks, moment_width(kind, d), measure).select("batch", "stats").groupBy("batch").applyInArrow(together, "batch string, stats binary")


def sampled_by_key(rows: DataFrame, sizes: DataFrame, size: int, seed: int) -> DataFrame:
    """(batch, h, n, least, below, features): vectors of each key whose least draw is under the limit for size rows, with how often they occur."""
    hashed = initialize.hashed(rows.withColumnRenamed("batch", "_batch"), seed, "_batch")
    found = initialize.least_draws(hashed, seed, F.array_min(F.collect_set("features")).alias("features"))
    root = 6.0 * math.sqrt(size) + 12.0
    large = sizes.where(F.col("n") > size).select(F.col("batch").alias("key"), F.least(F.lit(1.0), (F.lit(float(size)) + root) / F.col("n")).alias("below"))
    kept = found.join(large, "key", "left").withColumn("below", F.coalesce("below", F.lit(1.0))).where((F.col("least") < F.col("below")) | (F.col("below") >= 1.0))
    return kept.select(F.col("key").alias("batch"), "h", "n", "least", "below", "features")


def _moments(table: pa.Table, kind: str, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    v = np.frombuffer(table["stats"][0].as_buffer())
    n, mean, second = float(v[0]), v[1 : 1 + d] / v[0], v[1 + d :] / v[0]
    return n, mean, second.reshape(d, d) - np.outer(mean, mean) if kind in ("tied", "full") else np.maximum(second - mean * mean, 0.0)


def lloyd_on(x: np.ndarray, centres: np.ndarray, iterations: int, tol: float) -> np.ndarray:
    for _ in range(iterations):
        total = np.zeros(st.Stats.width("tied", *centres.shape))
        st.add_labelled(total, x, initialize.nearest(x, centres), len(centres), "tied")
        s = st.Stats.unpack(total, "tied", *centres.shape)
        moved = np.where(s.nk[:, None] > 0, s.sum_x / np.maximum(s.nk, 1.0)[:, None], centres)
        shift, centres = np.sqrt(((moved - centres) ** 2).sum(axis=1)).max(), moved
        if shift < tol:
            break
    return centres


def started(moments: DataFrame, kind: str, k: int, d: int, seed: int, how: str, reg_covar: float, iterations: int, tol: float, sample: DataFrame | None, means: DataFrame | None) -> DataFrame:
    """(batch, n, params): each key's start, from its sample or from given means (batch, k, mean), around the key's mean."""

    def row(table: pa.Table, m: Mixture, n: float, shift: np.ndarray) -> pa.Table:
        return pa.table({"batch": table["batch"][:1], "n": pa.array([int(n)]), "params": pa.array([pack_numbers(m, shift)], pa.binary())})

    def from_means(known: pa.Table, table: pa.Table) -> pa.Table:
        if not known.num_rows:
            raise ValueError(f"init_means has batch {table['batch'][0]}, which the data lack")
        n, shift, cov = _moments(known, kind, d)
        x = np.array(table.sort_by("k")["mean"].to_pylist(), float)
        if x.shape != (k, d):
            raise ValueError(f"batch {known['batch'][0]} needs {k} means of length {d}, not {x.shape}")
        return row(known, initialize.given(kind, (x - shift)[None], [(n, np.zeros(d), cov)], reg_covar, [None]), n, shift)

    def from_sample(known: pa.Table, table: pa.Table) -> pa.Table:
        n, shift, cov = _moments(known, kind, d)
        below = table["below"][0].as_py()
        at = initialize.cut(list(zip(table["h"].to_pylist(), table["n"].to_pylist(), table["least"].to_pylist(), strict=True)), START_ROWS, below, seed)
        x = st.matrix(table["features"].combine_chunks()).astype(float)[at] - shift
        rng = np.random.default_rng([seed, int(n)])
        centres = initialize.best_plus_plus(x, k, rng) if how == "kmeans" else None
        if centres is None:
            return row(known, initialize.given(kind, initialize.random_means(x, k, rng)[None], [(n, np.zeros(d), cov)], reg_covar, [None]), n, shift)
        centres = lloyd_on(x, centres, iterations, tol)
        total = np.zeros(st.Stats.width(kind, k, d))
        st.add_labelled(total, x, initialize.nearest(x, centres), k, kind)
        weights, spread = initialize.label_parameters(kind, st.Stats.unpack(total, kind, k, d), centres, cov, reg_covar, x.T @ x)
        return row(known, Mixture(kind, finalize.floored(weights)[None], centres[None], spread[None]), n, shift)

    other, make = (sample, from_sample) if means is None else (means, from_means)
    return moments.groupBy("batch").cogroup(other.groupBy("batch")).applyInArrow(make, "batch string, n long, params binary")


def step(blocks: DataFrame, params: DataFrame, kind: str, k: int, d: int, reg_covar: float, em_mode: str, top_k: int | None) -> DataFrame:
    """The parameters after one EM iteration, with each key's log-likelihood before it."""
    width = st.Stats.width(kind, k, d) + (d * d if kind == "tied" else 0)
    plain = st.Stats.width(kind, k, d)

    def measure(total: np.ndarray, data: bytes, x: np.ndarray) -> None:
        m, shift = unpack_numbers(data, kind, k, d)
        terms, x = numeric.Terms(m), x - shift
        for lo in range(0, len(x), density.ROWS):
            some = x[lo : lo + density.ROWS]
            tiles, likelihood = numeric.tiled_responsibilities(terms, some, em_mode, top_k)
            st.add_tiles(total[:plain], some, tiles, k, likelihood, kind)
        if kind == "tied":
            total[plain:] += (x.T @ x).ravel()

    def update(table: pa.Table) -> pa.Table:
        m, shift = unpack_numbers(table["params"][0].as_buffer(), kind, k, d)
        total = _total(table)
        s = st.Stats.unpack(total[:plain], kind, k, d)
        weights, means, cov = finalize.component_update(kind, s, m.means[0], m.covariances[0], reg_covar, total[plain:].reshape(d, d) if kind == "tied" else None)
        cov = np.maximum(cov, reg_covar) if kind in ("spherical", "diag") else cov
        after = Mixture(kind, finalize.floored(weights)[None], means[None], cov[None])
        return pa.table({"batch": table["batch"][:1], "n": pa.array([int(s.n)]), "log_likelihood": pa.array([s.log_likelihood]), "params": pa.array([pack_numbers(after, shift)], pa.binary())})

    salted = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("batch", "salt", "params")
    new = sums(blocks, width, measure, salted).groupBy("batch").applyInArrow(update, "batch string, n long, log_likelihood double, params binary")
    return with_salts(new)


def with_salts(params: DataFrame) -> DataFrame:
    """How many salts a key has: those without more than one have salt 0 alone, and a key that isn't hot joins its further salts to nothing."""
    return params.select("batch", "n", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"), "log_likelihood", "params")


def fit(
    data: DataFrame,
    k: int,
    kind: str = "spherical",
    batch: str = "batch_id",
    max_iter: int = 100,
    tol: float = 1e-4,
    seed: int = 0,
    init: str = "kmeans",
    reg_covar: float = 1e-6,
    init_means: DataFrame | None = None,
    top_k: int | None = None,
    em_mode: str = "soft",
    kmeans_iters: int = 10,
    kmeans_tol: float = 1e-4,
) -> KeyedFit:
    """Fits a mixture to the column features for each value of batch. init_means may give starts, as rows of batch (string), k and mean."""
    kind = covariance_type(kind)
    if init not in ("kmeans", "random"):
        raise ValueError("init must be 'kmeans' or 'random'")
    rows = data.select(F.col(batch).cast("string").alias("batch"), "features")
    width = F.size("features")
    sizes = rows.groupBy("batch").agg(F.count("*").alias("n"), F.min(width).alias("lo"), F.max(width).alias("hi"), F.sum((~valid(F.col("features"), width)).cast("long")).alias("bad"))
    sizes = written(sizes, "sizes")
    n, n_keys, lo, hi, bad, nulls = sizes.agg(F.sum("n"), F.count("*"), F.min("lo"), F.max("hi"), F.sum("bad"), F.count_if(F.col("batch").isNull())).first()
    if not n:
        raise ValueError("no rows to fit")
    if lo != hi or bad or nulls:
        raise ValueError(f"features must be finite arrays of one length and {batch} not null; found lengths {lo} to {hi}, {bad} bad vectors and {nulls} null keys")
    d, kept_top = lo, top_k if top_k and top_k < k else None
    blocks = packed_by_key(rows, sizes, n)
    try:
        moments = moments_by_key(blocks, kind, d)
        sample = sampled_by_key(rows, sizes, START_ROWS, seed) if init_means is None else None
        means = None if init_means is None else init_means.select(F.col("batch").cast("string").alias("batch"), "k", "mean")
        params = started(moments, kind, k, d, seed, init, reg_covar, kmeans_iters, kmeans_tol, sample, means)
        params = written(with_salts(params.withColumn("log_likelihood", F.lit(None).cast("double"))), "params")
        history: list[float] = []
        while len(history) < max_iter:
            params = written(step(blocks, params, kind, k, d, reg_covar, em_mode, kept_top), "params")
            history.append(params.agg(F.sum("log_likelihood")).first()[0] / n)
            if len(history) > 1 and tol > 0 and abs(history[-1] - history[-2]) < tol:
                break
    finally:
        blocks.unpersist()
    return KeyedFit(params, kind, k, d, n, n_keys, history)


def predict(data: DataFrame, fitted: KeyedFit, batch: str, what: tuple[str, ...] = ("label", "log_prob"), missing: bool = False) -> DataFrame:
    """data with label (int), log_prob (double) or proba (array<double>), by the mixture of each row's key, which is joined to it. A bad vector has nulls; a row whose key the model lacks raises an error, or with missing has nulls too."""
    kind, k, d, at = fitted.kind, fitted.k, fitted.d, len(data.columns)
    types = {"label": (T.IntegerType(), pa.int32()), "log_prob": (T.DoubleType(), pa.float64()), "proba": (T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))}
    if unknown := [w for w in what if w not in types]:
        raise ValueError(f"what may have {', '.join(types)}, not {unknown}")
    rows = data.withColumns({"_key": F.col(batch).cast("string"), "_x": F.when(valid(F.col("features"), d), F.col("features"))})
    joined = rows.join(fitted.params.select(F.col("batch").alias("_key"), F.col("params").alias("_params")), "_key", "left").select(*data.columns, "_key", "_x", "_params")

    def found(data_of_key: bytes, x: np.ndarray) -> dict[str, list]:
        m, shift = unpack_numbers(data_of_key, kind, k, d)
        terms, x = numeric.Terms(m), x - shift
        out = {}
        if "label" in what:
            out["label"] = numeric.labels(terms.tiles(x)).tolist()
        if "log_prob" in what:
            out["log_prob"] = numeric.log_probs(terms.tiles(x)).tolist()
        if "proba" in what:
            logits = terms.logits(x)
            out["proba"] = np.exp(logits - numeric.logsumexp(logits)[:, None]).tolist()
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, max(1, density.MOST_VALUES // k)):
                part = whole.slice(lo, max(1, density.MOST_VALUES // k))
                params, ok = part.column(at + 2), part.column(at + 1).is_valid().to_numpy(zero_copy_only=False)
                if missing:
                    ok = ok & params.is_valid().to_numpy(zero_copy_only=False)
                elif params.null_count:
                    raise ValueError(f"the model lacks a batch key of the data, {part.column(at).filter(params.is_null())[0].as_py()!r}")
                places: dict[str, list[int]] = {}
                for i, key in enumerate(part.column(at).to_pylist()):
                    if ok[i]:
                        places.setdefault(key, []).append(i)
                out: dict[str, list] = {w: [None] * part.num_rows for w in what}
                for mine in places.values():
                    x = st.matrix(part.column(at + 1).take(pa.array(mine))).astype(float)
                    for w, values in found(params[mine[0]].as_buffer(), x).items():
                        for i, v in zip(mine, values, strict=True):
                            out[w][i] = v
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *[pa.array(out[w], types[w][1]) for w in what]], names=[*part.schema.names[:at], *what])

    return joined.mapInArrow(task, T.StructType([*data.schema.fields, *[T.StructField(w, types[w][0]) for w in what]]))


def first_means(data: DataFrame, batch: str, k: int, order: list[str]) -> DataFrame:
    """(batch, k, mean): for each key its k rows that come first in the given order; a start that needs no draw."""
    place = F.row_number().over(Window.partitionBy(batch).orderBy(*order))
    return data.withColumn("_place", place).where(F.col("_place") <= k).select(F.col(batch).cast("string").alias("batch"), (F.col("_place") - 1).alias("k"), F.col("features").alias("mean"))
