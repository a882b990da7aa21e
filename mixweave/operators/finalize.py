"""The driver's half of an M-step: parameters from statistics.

A component with no more than MIN_WEIGHT rows keeps its mean and covariance. Weights are floored at MIN_WEIGHT and sum to
one again. Spherical and diag variances are clamped from below by reg_covar; tied and full covariances get it added to their diagonal.
A tied or full covariance that can't be factored keeps the old one.
"""

from __future__ import annotations

import numpy as np

from mixweave.functions.numeric import precision, regularized
from mixweave.functions.params import MIN_WEIGHT, Mixture
from mixweave.operators.stats import Stats


def floored(weights: np.ndarray) -> np.ndarray:
    weights = np.maximum(weights, MIN_WEIGHT)
    return weights / weights.sum(axis=-1, keepdims=True)


def component_update(kind: str, stats: Stats, means: np.ndarray, covariances: np.ndarray, reg_covar: float, xx: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, covariances) of one batch; weights are nk / n as they are. xx is the total of x xᵀ, for tied."""
    active = stats.nk > MIN_WEIGHT
    nk = np.where(active, stats.nk, 1.0)
    new = np.where(active[:, None], stats.sum_x / nk[:, None], means)
    d = means.shape[1]
    if kind == "spherical":
        spread = np.maximum(stats.second - stats.nk * (new**2).sum(axis=1), 0.0) / (nk * d)
        cov = np.where(active, np.maximum(spread, reg_covar), covariances)
    elif kind == "diag":
        cov = np.where(active[:, None], np.maximum(stats.second / nk[:, None] - new**2, reg_covar), covariances)
    elif kind == "full":
        outer = new[:, :, None] * new[:, None, :]
        made = regularized(stats.second / nk[:, None, None] - outer, reg_covar)
        cov = np.where(active[:, None, None], made, covariances)
        for k in np.flatnonzero(active):
            try:
                precision(cov[k])
            except ValueError:
                cov[k] = covariances[k]
    else:
        within = xx - np.einsum("k,kd,ke->de", np.where(active, stats.nk, 0.0), new, new)
        cov = regularized(within / stats.n, reg_covar)
        try:
            precision(cov)
        except ValueError:
            cov = covariances
    return stats.nk / stats.n, new, cov


def update(mixture: Mixture, stats: list[Stats], reg_covar: float, xx: dict | None = None) -> Mixture:
    found = [component_update(mixture.kind, s, mixture.means[b], mixture.covariances[b], reg_covar, xx and xx[None if key is None else str(key)]) for b, (key, s) in enumerate(zip(mixture.keys, stats, strict=True))]
    weights, means, cov = map(np.stack, zip(*found, strict=True))
    return Mixture(mixture.kind, floored(weights), means, cov, mixture.keys)
