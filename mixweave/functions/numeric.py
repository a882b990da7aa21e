"""Small dense linear algebra for the driver, and log-densities of row matrices for the tasks, tile after tile of components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from mixweave.functions.params import LOG_2PI, Mixture

JITTER, JITTER_TRIES = 1e-6, 6
MIN_VARIANCE = 1e-30
TILE = 1024  # components whose logits are held at once


def symmetric(matrix: np.ndarray) -> np.ndarray:
    return 0.5 * (matrix + np.swapaxes(matrix, -1, -2))


def regularized(matrix: np.ndarray, reg_covar: float) -> np.ndarray:
    return symmetric(matrix) + reg_covar * np.eye(matrix.shape[-1])


def precision(covariance: np.ndarray) -> tuple[np.ndarray, float]:
    """A factor W with W Wᵀ the inverse of the covariance, and the covariance's log-determinant. A matrix that isn't positive definite gets a growing jitter; ValueError if none helps."""
    matrix, eye = symmetric(covariance), np.eye(len(covariance))
    for attempt in range(-1, JITTER_TRIES):
        try:
            lower = np.linalg.cholesky(matrix if attempt < 0 else matrix + JITTER * 10.0**attempt * eye)
        except np.linalg.LinAlgError:
            continue
        return np.linalg.solve(lower, eye).T, 2.0 * float(np.log(np.diag(lower)).sum())
    raise ValueError("covariance is not positive definite")


class Terms:
    """What one batch's log-densities need, computed once on the driver.

    Rows are shifted by the mean of the means, so that expanding the squares costs no digits when data lie far from 0.
    Tied and full covariances become unit ones by projecting rows on a precision factor.
    """

    def __init__(self, mixture: Mixture, b: int = 0):
        _, k, d = mixture.shape
        self.kind, self.shift = mixture.kind, mixture.means[b].mean(axis=0)
        means, cov = mixture.means[b] - self.shift, mixture.covariances[b]
        constant = np.log(mixture.weights[b]) - 0.5 * d * LOG_2PI
        if self.kind in ("spherical", "diag"):
            var = np.maximum(np.repeat(cov[:, None], d, axis=1) if self.kind == "spherical" else cov, MIN_VARIANCE)
            self.centres, self.scale = means, 1.0 / var
            self.constant = constant - 0.5 * np.log(var).sum(axis=1)
        elif self.kind == "tied":
            self.project, logdet = precision(cov)
            self.centres, self.scale = means @ self.project, np.ones((k, d))
            self.constant = constant - 0.5 * logdet
        else:
            found = [precision(c) for c in cov]
            self.project = np.stack([w for w, _ in found])
            self.centres, self.scale = np.einsum("kd,kde->ke", means, self.project), np.ones((k, d))
            self.constant = constant - 0.5 * np.array([x for _, x in found])

    def moved(self, x: np.ndarray) -> np.ndarray:
        """Rows in the coordinates that logits takes: shifted, and projected where all components share a factor."""
        x = x - self.shift
        return x @ self.project if self.kind == "tied" else x

    def logits_of(self, x: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """(rows, hi - lo) joint log-densities of moved rows, for some components."""
        centres, scale = self.centres[lo:hi], self.scale[lo:hi]
        if self.kind == "full":
            square = np.stack([((x @ w - c) ** 2).sum(axis=1) for w, c in zip(self.project[lo:hi], centres, strict=True)], axis=1)
        else:
            scaled = centres * scale
            square = (x * x) @ scale.T - 2.0 * (x @ scaled.T) + (centres * scaled).sum(axis=1)
        return self.constant[lo:hi] - 0.5 * np.maximum(square, 0.0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(rows, K) joint log-densities of a row matrix."""
        return self.logits_of(self.moved(x), 0, len(self.constant))

    def tiles(self, x: np.ndarray, tile: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(first component, joint log-densities) for tile after tile of components; rows are moved once."""
        moved, k, tile = self.moved(x), len(self.constant), tile or TILE
        for lo in range(0, k, tile):
            yield lo, self.logits_of(moved, lo, min(k, lo + tile))


def logsumexp(logits: np.ndarray) -> np.ndarray:
    top = logits.max(axis=1)
    return top + np.log(np.exp(logits - top[:, None]).sum(axis=1))


def log_probs(tiles: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """The log-sum-exp of each row over all tiles, by a running largest term and sum."""
    top = total = None
    for _, logits in tiles:
        here = logits.max(axis=1)
        if top is None:
            top, total = here, np.exp(logits - here[:, None]).sum(axis=1)
        else:
            most = np.maximum(top, here)
            total = total * np.exp(top - most) + np.exp(logits - most[:, None]).sum(axis=1)
            top = most
    return top + np.log(total)


def labels(tiles: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """The first of each row's most likely components."""
    best = at = None
    for lo, logits in tiles:
        here = logits.argmax(axis=1)
        value = logits[np.arange(len(logits)), here]
        if best is None:
            best, at = value, here
        else:
            better = value > best
            best, at = np.where(better, value, best), np.where(better, here + lo, at)
    return at


def top_mask(logits: np.ndarray, top_k: int) -> np.ndarray:
    """Which top_k logits of each row are its largest; of equal ones, those further left. No row is sorted."""
    if top_k >= logits.shape[1]:
        return np.ones(logits.shape, bool)
    least = np.partition(logits, -top_k, axis=1)[:, -top_k, None]
    above, level = logits > least, logits == least
    return above | level & (np.cumsum(level, axis=1) <= top_k - above.sum(axis=1, keepdims=True))


def top_components(tiles: Iterable[tuple[int, np.ndarray]], top_k: int) -> tuple[np.ndarray, np.ndarray]:
    """(components, logits) of each row's top_k, by component: a running selection that takes in tile after tile."""
    at = kept = None
    for lo, logits in tiles:
        here = np.broadcast_to(np.arange(lo, lo + logits.shape[1]), logits.shape)
        both, who = (logits, here) if at is None else (np.concatenate([kept, logits], axis=1), np.concatenate([at, here], axis=1))
        mask = top_mask(both, top_k)
        at, kept = who[mask].reshape(len(both), -1), both[mask].reshape(len(both), -1)
    return at, kept


def kept_top(logits: np.ndarray, top_k: int) -> np.ndarray:
    """Logits with all but each row's top_k largest at minus infinity; of equal ones, the lower component stays."""
    return np.where(top_mask(logits, top_k), logits, -np.inf)


def responsibilities(logits: np.ndarray, mode: str, top_k: int | None) -> tuple[np.ndarray, float]:
    """(rows, K) responsibilities and the sum of the log-likelihoods; mode "hard" gives each row to its first best component."""
    if mode == "hard":
        resp = np.zeros_like(logits)
        resp[np.arange(len(logits)), logits.argmax(axis=1)] = 1.0
        return resp, float(logsumexp(logits).sum())
    kept = kept_top(logits, top_k) if top_k else logits
    norm = logsumexp(kept)
    return np.exp(kept - norm[:, None]), float(norm.sum())


def tiled_responsibilities(terms: Terms, x: np.ndarray, mode: str, top_k: int | None, tile: int | None = None) -> tuple[Iterator[tuple[int, np.ndarray]], float]:
    """((first component, responsibilities) for tile after tile, sum of the log-likelihoods). Each row's scale and choice are found in a first pass over the tiles, so no more than a tile is held."""
    k, tile = len(terms.constant), tile or TILE
    if k <= tile:
        resp, total = responsibilities(terms.logits(x), mode, top_k)
        return iter([(0, resp)]), total
    if mode == "hard":
        best, total = labels(terms.tiles(x, tile)), float(log_probs(terms.tiles(x, tile)).sum())
        sizes = ((lo, min(k, lo + tile)) for lo in range(0, k, tile))
        return ((lo, (best[:, None] == np.arange(lo, hi)).astype(float)) for lo, hi in sizes), total
    if top_k:
        at, kept = top_components(terms.tiles(x, tile), top_k)
        norm = logsumexp(kept)
        share = np.exp(kept - norm[:, None])

        def spread() -> Iterator[tuple[int, np.ndarray]]:
            for lo in range(0, k, tile):
                out = np.zeros((len(x), min(k, lo + tile) - lo))
                row, place = np.nonzero((at >= lo) & (at < lo + out.shape[1]))
                out[row, at[row, place] - lo] = share[row, place]
                yield lo, out

        return spread(), float(norm.sum())
    norm = log_probs(terms.tiles(x, tile))
    return ((lo, np.exp(logits - norm[:, None])) for lo, logits in terms.tiles(x, tile)), float(norm.sum())
