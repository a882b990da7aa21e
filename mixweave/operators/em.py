"""Expectation-maximisation: one Spark job per iteration, parameters on the driver.

Soft EM by default; em_mode="hard" is classification EM, and top_k keeps each row's best components in training only.
All batches of a table are independent mixtures, but they stop together, on one lower bound averaged over all rows. The
lower bound is the mean log-likelihood under the parameters before the iteration's update, so it isn't the score of the
parameters that are returned. Iterations end when it changes by less than tol; the first never does.

Parameters are numbers in the tasks' closures, not DataFrames, so lineage doesn't grow; a lost executor only recomputes
the partitions of the cached blocks that it held. Sums are centred on the global mean, which costs nothing and keeps digits.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixweave.functions.params import Mixture, covariance_type
from mixweave.operators import density, finalize, initialize
from mixweave.operators import stats as st

MODES = ("soft", "hard")
DRIVER_SUMS = 1 << 24  # numbers for all batch keys together; beyond it, operators.keyed fits them on the executors
log = logging.getLogger("mixweave")


class TooManyKeys(ValueError):
    """More batch keys than the driver holds parameters for."""


@dataclass
class FitReport:
    """What a fit did."""

    mixture: Mixture
    n_iter: int
    lower_bound: float
    lower_bound_history: list[float]
    init_source: str
    strategy: str
    approx_top_k: int | None = None
    em_mode: str = "soft"
    n_rows: int = 0
    breakdown: dict = field(default_factory=dict)


def moved(mixture: Mixture, shift: np.ndarray) -> Mixture:
    return Mixture(mixture.kind, mixture.weights, mixture.means + shift, mixture.covariances, mixture.keys)


def clamped(mixture: Mixture, reg_covar: float) -> Mixture:
    cov = np.maximum(mixture.covariances, reg_covar) if mixture.kind in ("spherical", "diag") else mixture.covariances
    return Mixture(mixture.kind, finalize.floored(mixture.weights), mixture.means, cov, mixture.keys)


def fit(
    data: DataFrame,
    k: int,
    kind: str = "spherical",
    max_iter: int = 100,
    tol: float = 1e-4,
    seed: int = 0,
    init: str = "kmeans",
    reg_covar: float = 1e-6,
    batch: str | None = None,
    init_means=None,
    init_weights=None,
    init_covariances=None,
    top_k: int | None = None,
    em_mode: str = "soft",
    strategy: str = "auto",
    kmeans_iters: int = 10,
    kmeans_tol: float = 1e-4,
    d: int | None = None,
    verbose: bool = False,
) -> FitReport:
    """Fits a mixture to the column features (array<double>), one for each value of batch if given."""
    kind = covariance_type(kind)
    if init not in ("kmeans", "random"):
        raise ValueError("init_params must be 'kmeans' or 'random'")
    if em_mode not in MODES:
        raise ValueError(f"em_mode must be one of {MODES}")
    if top_k is not None and top_k < 1:
        raise ValueError("approx_top_k must be positive")
    rows = data.select("features", *([F.col(batch).cast("string").alias("batch")] if batch else []))
    by = "batch" if batch else None
    packed = st.pack(rows, by)
    try:
        d = st.features_of(packed, d)
        n_keys = packed.frame.select("batch").distinct().count() if batch else 1
        if n_keys * st.Stats.width(kind, k, d) > DRIVER_SUMS and batch:
            raise TooManyKeys(f"{n_keys} batch keys with {st.Stats.width(kind, k, d)} sums each are more than the driver takes; use keyed.fit")
        chosen = "arrow" if strategy == "auto" else density.choose(strategy, 0)
        moments = st.moments(packed, d, by, kind, n_keys)
        if None in moments and batch:
            raise ValueError(f"{batch} must not be null")
        n, keys = int(sum(m[0] for m in moments.values())), sorted(moments) if batch else [None]
        shift = sum(moments[key][0] * moments[key][1] for key in moments) / n
        centred = packed.moved(shift)
        if chosen == "columns":
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        source_of = centred if chosen == "arrow" else rows.withColumn("features", F.transform("features", lambda x, i: x - F.get(F.lit(shift.tolist()), i)))
        known = {key: (m[0], m[1] - shift, m[2]) for key, m in moments.items()}
        xx = {key: m[0] * (m[2] + np.outer(m[1], m[1])) for key, m in known.items()} if kind == "tied" else None
        kept_top = top_k if top_k and top_k < k else None
        if init_means is not None:
            means = np.asarray(init_means, float)
            means = means[None] if means.ndim == 2 else means
            if means.shape != (len(keys), k, d):
                raise ValueError(f"init_means must have shape {(len(keys), k, d)}, not {means.shape}")
            lift = lambda a, n: None if a is None else (np.asarray(a, float)[None] if np.ndim(a) == n else a)
            flat = {"spherical": 1, "diag": 2, "tied": 2, "full": 3}[kind]
            mixture = initialize.given(kind, means - shift, [known[key] for key in keys], reg_covar, keys, lift(init_weights, 1), lift(init_covariances, flat))
            source = "user"
        else:
            mixture, source = initialize.start(rows, kind, k, known, keys, init, seed, reg_covar, by, kmeans_iters, kmeans_tol, centred)
        history: list[float] = []
        while len(history) < max_iter:
            mixture = clamped(mixture, reg_covar)
            found = st.soft(source_of, mixture, by, em_mode, kept_top, chosen)
            history.append(float(sum(s.log_likelihood for s in found)) / n)
            after = finalize.update(mixture, found, reg_covar, xx)
            if verbose:
                log.info("iteration %d: lower bound %.6f, mean shift %.3g", len(history), history[-1], float(np.abs(after.means - mixture.means).max()))
            mixture = after
            if len(history) > 1 and tol > 0 and abs(history[-1] - history[-2]) < tol:
                break
    finally:
        packed.frame.unpersist()
        rows.unpersist()
    return FitReport(moved(mixture, shift), len(history), history[-1], history, source, chosen, kept_top, em_mode, n, {chosen: len(history)})
