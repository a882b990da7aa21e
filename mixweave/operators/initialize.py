"""Starting parameters: given ones, random rows, or k-means from k-means++ or k-means|| centres.

What reaches the driver has a fixed largest size, whatever the data. Samples come from the seed and from hashes of
the features and their multiplicities, not from partition or row order, so a repartitioned table draws the same rows. A table (or batch) that a sample holds
whole starts from greedy k-means++; a larger one from k-means||, rounds over all rows, whose draws follow the blocks of rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixweave.functions.numeric import TILE, regularized
from mixweave.functions.params import Mixture
from mixweave.operators import stats as st
from mixweave.operators.density import ROWS
from mixweave.operators.finalize import floored

SAMPLE_MIN, SAMPLE_PER_COMPONENT, SAMPLE_MAX = 4096, 64, 65_536
STARTS = 3  # of greedy k-means++ on a sample; the one with the least potential counts
FEW_CENTRES = 16  # that are compared one by one
ROUNDS, OVERSAMPLING = 5, 2  # of k-means||: each round draws so many candidates for each component


def sample_size(n: int, k: int) -> int:
    return min(n, max(k, min(SAMPLE_MAX, max(SAMPLE_MIN, SAMPLE_PER_COMPONENT * k))))


def limit_for(n, size):
    """Below it lie at least size of n uniform draws, but for a chance of about 1e-8, and little more than size."""
    return np.where(np.asarray(n) <= size, 1.0, np.minimum(1.0, (size + 6.0 * np.sqrt(size) + 12.0) / n))


def hashed(data: DataFrame, seed: int, batch: str | None) -> DataFrame:
    key = F.col(batch).cast("string") if batch else F.lit("")
    return data.select("features", key.alias("key"), F.xxhash64(F.lit(seed), "features").alias("h"))


def least_draws(rows: DataFrame, seed: int, *more: Column) -> DataFrame:
    """(key, h, n, least): for each vector of hashed rows how often it occurs, and the least of its n uniform draws, made directly: 1 - (1 - u)^(1/n). Hashes and counts are what is shuffled (and more, aggregates by vector)."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("draw"), "h"), 11) + 0.5) * 2.0**-53
    return rows.groupBy("key", "h").agg(F.count("*").alias("n"), *more).withColumn("least", -F.expm1(F.log1p(-u) / F.col("n")))


def further_draws(h: int, n: int, least: float, limit: float, most: int, seed: int) -> np.ndarray:
    """The draws of a vector that lie below limit, in order, at most most of them: from the least on, each is the least of those that are left."""
    if n == 1:
        return np.array([least])
    more = np.random.default_rng([seed, h & (2**64 - 1)]).random(min(n, most) - 1)
    draws = -np.expm1(np.cumsum(np.concatenate([[math.log1p(-least)], np.log1p(-more) / (n - 1 - np.arange(len(more)))])))
    return draws[(draws < limit) | (limit >= 1.0)]


def cut(rows: list, size: int, limit: float, seed: int) -> list[int]:
    """Which row of (h, n, least) each of the size least draws belongs to; a row with several draws comes up several times."""
    draws = [further_draws(h, n, least, limit, size, seed) for h, n, least in rows]
    at = np.repeat(np.arange(len(rows)), [len(x) for x in draws])
    order = np.lexsort((np.array([r[0] for r in rows], np.int64)[at], np.concatenate([*draws, []])))
    return at[order[:size]].tolist()


def samples(data: DataFrame, sizes: dict, seed: int, batch: str | None = None, rows: dict | None = None) -> dict:
    """For each batch key at most sizes[key] rows, drawn uniformly: each occurrence of a vector has a draw of its own, and the least draws count.

    One pass counts vectors by their hashes and keeps those whose least draw lies under a limit, which follows from the number of rows (counted, if rows
    doesn't have it); a second one fetches the vectors that were drawn. Nothing is sorted, no task sees more than its share.
    """
    found = hashed(data, seed, batch)
    name = lambda key: str(key) if batch else ""
    if rows is None:
        rows = {r.key: r["count"] for r in found.groupBy("key").count().collect()}
    limits = {name(key): float(limit_for(max(1, rows.get(name(key) if batch else "", 0)), size)) for key, size in sizes.items()}
    if batch:
        table = data.sparkSession.createDataFrame([*limits.items()], "key string, below double")  # as many rows as keys that the caller holds
        kept = least_draws(found, seed).join(F.broadcast(table), "key").where(F.col("least") < F.col("below"))
    else:
        kept = least_draws(found, seed).where(F.col("least") < limits[""])
    by_key: dict[str, list] = {}
    for r in kept.select("key", "h", "n", "least").collect():
        by_key.setdefault(r.key, []).append((r.h, r.n, r.least))
    chosen = {key: [by_key[name(key)][i][0] for i in cut(by_key.get(name(key), []), size, limits[name(key)], seed)] for key, size in sizes.items()}
    met = [*{(name(key), h) for key, hs in chosen.items() for h in hs}]
    if not met:
        return {key: np.array([], float) for key in sizes}
    wanted = data.sparkSession.createDataFrame(met, "key string, h long")  # at most the sum of sizes
    vectors = {(r.key, r.h): r.features for r in found.join(F.broadcast(wanted), ["key", "h"]).groupBy("key", "h").agg(F.array_min(F.collect_set("features")).alias("features")).collect()}
    return {key: np.array([vectors[name(key), h] for h in hs], float) for key, hs in chosen.items()}


def sample(data: DataFrame, size: int, seed: int) -> np.ndarray:
    """At most size rows of a table without batches."""
    return samples(data, {None: size}, seed)[None]


def random_means(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of a sample, drawn with replacement."""
    return rows[rng.integers(0, len(rows), k)]


def plus_plus(rows: np.ndarray, k: int, rng: np.random.Generator, weights: np.ndarray | None = None) -> np.ndarray | None:
    """Greedy k-means++: each centre is the best of 2 + ⌊ln k⌋ rows drawn by squared distance (times weight). None for more components than rows."""
    if k > len(rows):
        return None
    rows_norm = (rows**2).sum(axis=1)
    w = np.ones(len(rows)) if weights is None else np.asarray(weights, float)
    centres = [rows[rng.integers(len(rows)) if weights is None else rng.choice(len(rows), p=w / w.sum())]]
    nearest = ((rows - centres[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = (w * nearest).cumsum()
        drawn = np.searchsorted(total, rng.random(2 + int(math.log(k))) * total[-1]).clip(max=len(rows) - 1) if total[-1] > 0 else np.array([0])
        away = rows_norm[:, None] - 2.0 * rows @ rows[drawn].T + rows_norm[drawn]
        left = np.minimum(nearest[:, None], np.maximum(away, 0.0))
        best = (w @ left).argmin()
        centres.append(rows[drawn[best]])
        nearest = np.minimum(nearest, ((rows - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def best_plus_plus(rows: np.ndarray, k: int, rng: np.random.Generator, weights: np.ndarray | None = None) -> np.ndarray | None:
    """The best of STARTS runs of plus_plus by the sum of (weighted) squared distances; None for more components than rows."""
    if k > len(rows):
        return None
    w = np.ones(len(rows)) if weights is None else weights
    found = [plus_plus(rows, k, rng, weights) for _ in range(STARTS)]
    return min(found, key=lambda c: float(w @ np.minimum.reduce([d.min(axis=1) for _, d in distances(rows, c)])))


def distances(x: np.ndarray, centres: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first centre, squared distances) for tile after tile of centres, by one matrix product each: near the true ones."""
    norm = (x * x).sum(axis=1)[:, None]
    for lo in range(0, len(centres), TILE):
        c = centres[lo : lo + TILE]
        yield lo, np.maximum(norm - 2.0 * (x @ c.T) + (c * c).sum(axis=1), 0.0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; of equal distances, the lower one. Of many centres, only those that might be nearest by a matrix product are compared. Differences are squared, so ties are true ones."""
    at = np.zeros(len(x), int)
    if len(centres) <= FEW_CENTRES:
        least = np.full(len(x), np.inf)
        for k, c in enumerate(centres):
            away = ((x - c) ** 2).sum(axis=1)
            closer = away < least
            at[closer] = k
            least = np.where(closer, away, least)
        return at
    for start in range(0, len(x), ROWS):
        some = x[start : start + ROWS]
        least = np.full(len(some), np.inf)
        for _, away in distances(some, centres):
            least = np.minimum(least, away.min(axis=1))
        reach = least + 1e-9 * ((some * some).sum(axis=1) + (centres * centres).sum(axis=1).max())
        near = [(row, centre + lo) for lo, away in distances(some, centres) for row, centre in [np.nonzero(away <= reach[:, None])]]
        row, centre = (np.concatenate(v) for v in zip(*near, strict=True))
        exact = ((some[row] - centres[centre]) ** 2).sum(axis=1)
        order = np.lexsort((centre, exact, row))
        first = order[np.append(True, np.diff(row[order]) != 0)]
        at[start + row[first]] = centre[first]
    return at


def candidates(blocks: st.Packed, centres: dict | None, size: int, seed: int, batch: str | None) -> dict:
    """For each batch key size rows, drawn without replacement with odds in proportion to their squared distance from its centres (without centres, all alike): the least of -ln(u) / distance.

    Each task keeps the size least of its rows, and these are merged in a tree. A draw follows from the seed, the block's content and the row's place in it.
    """
    shift, names = blocks.shift, ["part", "batch", "odds", "stats"]

    def least(odds: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.argsort(odds, kind="stable")[:size]
        return odds[best], x[best]

    def row(part: int, key: str | None, odds: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([key], pa.string()), pa.array([odds.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict = {}
        for rows in batches:
            for key, n, block in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
                x = np.frombuffer(block.as_buffer(), float).reshape(n, -1)
                x = x if shift is None else x - shift
                if centres is None:
                    away = np.ones(n)
                else:
                    known = centres[key if batch else None]
                    away = np.concatenate([np.minimum.reduce([d.min(axis=1) for _, d in distances(x[lo : lo + ROWS], known)]) for lo in range(0, n, ROWS)])
                u = np.random.default_rng([seed, zlib.crc32(block.as_buffer())]).random(n)
                far = np.flatnonzero(away > 1e-12 * ((x * x).sum(axis=1) + 1e-300))
                odds = -np.log1p(-u[far]) / away[far]
                old = held.get(key, (np.zeros(0), np.zeros((0, x.shape[1]))))
                held[key] = least(np.concatenate([old[0], odds]), np.concatenate([old[1], x[far]]))
        for key, (odds, x) in held.items():
            if len(odds):
                yield row(TaskContext.get().partitionId(), key, odds, x)

    def together(table: pa.Table) -> pa.Table:
        odds = [np.frombuffer(v.as_buffer()) for c in table["odds"].chunks for v in c]
        x = [np.frombuffer(v.as_buffer()).reshape(len(o), -1) for o, v in zip(odds, (v for c in table["stats"].chunks for v in c), strict=True)]
        return pa.Table.from_batches([row(table["part"][0].as_py(), table["batch"][0].as_py(), *least(np.concatenate(odds), np.concatenate(x)))])

    parts = blocks.frame.select("batch", "n", "block").mapInArrow(task, "part long, batch string, odds binary, stats binary")
    found: dict = {}
    for r in st.merged(parts, ["batch"], st.levels(blocks.parts, 0), together).collect():
        odds = np.frombuffer(r.odds)
        found[r.batch if batch else None] = np.frombuffer(r.stats).reshape(len(odds), -1)
    return found


def parallel_centres(blocks: st.Packed, k: int, seed: int, batch: str | None = None, rounds: int = ROUNDS, oversampling: int = OVERSAMPLING) -> dict:
    """k-means||: from one row for each batch key on, rounds of candidates drawn from all rows by squared distance; each counts for the rows nearest to it, and greedy k-means++ chooses k among them. None for a key with fewer distinct ones than k."""
    centres = candidates(blocks, None, 1, seed, batch)
    for r in range(rounds):
        more = candidates(blocks, centres, oversampling * k, seed + r + 1, batch)
        centres = {key: np.unique(np.concatenate([c, more[key]]), axis=0) if key in more else c for key, c in centres.items()}
    most = max(len(c) for c in centres.values())
    padded = {key: np.concatenate([c, np.full((most - len(c), c.shape[1]), c[0])]) for key, c in centres.items()}  # of equal centres the first counts all rows
    counts = nearest_stats(blocks, padded, batch, "tied")
    return {key: best_plus_plus(c, k, np.random.default_rng([seed, i]), counts[key].nk[: len(c)]) for i, (key, c) in enumerate(centres.items())}


def nearest_stats(data: DataFrame | st.Packed, centres: dict, batch: str | None = None, kind: str = "full", around: bool = False) -> dict:
    """For each batch: the statistics (second moments by kind) of the rows nearest to each centre; with around those of the rows' differences from it, which lose no digits."""
    k, d = next(iter(centres.values())).shape

    def measure(total, key, x, _):
        at = nearest(x, centres[key])
        st.add_labelled(total, x - centres[key][at] if around else x, at, k, kind)

    found = st.map_stats(data, measure, st.Stats.width(kind, k, d), batch, n_keys=len(centres))
    return {key: st.Stats.unpack(v, kind, k, d) for key, v in found.items()}


def lloyd(data: DataFrame | st.Packed, centres: dict, iterations: int = 10, tol: float = 1e-4, batch: str | None = None) -> dict:
    """Lloyd's steps from given centres {batch key: (K, D)}. A centre without rows stays. Ends when no centre moves by tol or more."""
    for _ in range(iterations):
        found = nearest_stats(data, centres, batch, "tied")  # counts and sums alone
        moved = {}
        for key, c in centres.items():
            s = found[key]
            moved[key] = np.where(s.nk[:, None] > 0, s.sum_x / np.maximum(s.nk, 1.0)[:, None], c)
        shift = max(float(np.sqrt(((moved[key] - c) ** 2).sum(axis=1)).max()) for key, c in centres.items())
        centres = moved
        if shift < tol:
            break
    return centres


def global_covariance(kind: str, cov: np.ndarray, k: int, reg_covar: float) -> np.ndarray:
    """The biased global moment (a matrix, or for spherical and diag its diagonal) in the shape of one batch's covariances."""
    if kind in ("spherical", "diag"):
        variances = np.diag(cov) if cov.ndim == 2 else cov
        return np.full(k, max(float(variances.mean()), reg_covar)) if kind == "spherical" else np.tile(np.maximum(variances, reg_covar), (k, 1))
    made = regularized(cov, reg_covar)
    return made if kind == "tied" else np.tile(made, (k, 1, 1))


def label_parameters(kind: str, s: st.Stats, means: np.ndarray, cov: np.ndarray, reg_covar: float, xx: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights, covariances) from the statistics of hard labels around given means; an empty component has the global covariance. For tied, xx may give the total of x xᵀ instead of second moments."""
    counts = np.maximum(s.nk, 1.0)
    every = global_covariance(kind, cov, len(counts), reg_covar)
    if kind == "spherical":  # sums of (x - m)² from those of x and x²
        spread = s.second - 2.0 * (s.sum_x * means).sum(axis=1) + s.nk * (means**2).sum(axis=1)
        made = np.maximum(spread / (counts * means.shape[1]), reg_covar)
    elif kind == "diag":
        made = np.maximum((s.second - 2.0 * s.sum_x * means + s.nk[:, None] * means**2) / counts[:, None], reg_covar)
    elif kind == "tied" and s.second is None:
        cross = s.sum_x.T @ means
        return counts / counts.sum(), regularized((xx - cross - cross.T + (means * s.nk[:, None]).T @ means) / s.n, reg_covar)
    else:
        spread = s.second - s.sum_x[:, :, None] * means[:, None, :] - means[:, :, None] * s.sum_x[:, None, :] + s.nk[:, None, None] * means[:, :, None] * means[:, None, :]
        if kind == "tied":
            return counts / counts.sum(), regularized(spread.sum(axis=0) / s.n, reg_covar)
        made = regularized(spread / counts[:, None, None], reg_covar)
    return counts / counts.sum(), np.where((s.nk > 0).reshape(-1, *[1] * (made.ndim - 1)), made, every)


def given(kind: str, means: np.ndarray, moments: list, reg_covar: float, keys: list, weights: np.ndarray | None = None, covariances: np.ndarray | None = None) -> Mixture:
    """From means (B, K, D); missing weights are equal, missing covariances the global ones."""
    means = np.asarray(means, float)
    b, k, d = means.shape
    if len(keys) != b or any(m[1].shape != (d,) for m in moments):
        raise ValueError("init_means must have shape (B, K, D) like the data")
    weights = np.full((b, k), 1.0 / k) if weights is None else np.asarray(weights, float)
    if covariances is None:
        covariances = np.stack([global_covariance(kind, m[2], k, reg_covar) for m in moments])
    return Mixture(kind, floored(weights), means, covariances, keys)


def start(data: DataFrame, kind: str, k: int, moments: dict, keys: list, how: str, seed: int, reg_covar: float, batch: str | None = None, iterations: int = 10, tol: float = 1e-4, packed: st.Packed | None = None) -> tuple[Mixture, str]:
    """Starting parameters without given ones, and their source: random (random_sampled if the sample didn't hold all rows), or kmeans (kmeans_random if a batch has fewer distinct rows than components, so that centres were drawn with replacement; _parallel if the centres are those of k-means||).

    packed holds the same rows in blocks; the start is moved by its shift.
    """
    names = {key: None if key is None else str(key) for key in keys}
    known = [moments[names[key]] for key in keys]
    counts = {"" if key is None else str(key): int(m[0]) for key, m in zip(keys, known, strict=True)}
    sizes = {key: sample_size(int(m[0]), k) for key, m in zip(keys, known, strict=True)}
    whole = all(sizes[key] == m[0] for key, m in zip(keys, known, strict=True))
    parallel = how == "kmeans" and not whole
    drawn = {} if parallel else samples(data, sizes, seed, batch, counts)
    if packed is not None and packed.shift is not None:
        drawn = {key: rows - packed.shift for key, rows in drawn.items()}
    rngs = {key: np.random.default_rng((seed, i)) for i, key in enumerate(keys)}
    if how == "kmeans":
        blocks = packed if packed is not None else st.pack(data, batch)
        if parallel:
            centres = parallel_centres(blocks, k, seed, batch)
        else:
            centres = {names[key]: best_plus_plus(drawn[key], k, rngs[key]) for key in keys}
        few = [key for key in keys if centres[names[key]] is None]
        if few:
            drawn = samples(data, sizes, seed, batch, counts) if parallel else drawn
            moved = packed.shift if parallel and packed is not None and packed.shift is not None else 0.0
            centres |= {names[key]: random_means(drawn[key] - moved, k, rngs[key]) for key in few}
        centres = lloyd(blocks, centres, iterations, tol, batch)
        found = nearest_stats(blocks, centres, batch, kind)
        if packed is None:
            blocks.frame.unpersist()
        xx = [m[0] * (m[2] + np.outer(m[1], m[1])) if kind == "tied" else None for m in known]
        parts = [label_parameters(kind, found[names[key]], centres[names[key]], m[2], reg_covar, x) for key, m, x in zip(keys, known, xx, strict=True)]
        source = ("kmeans_random" if few else "kmeans") + ("_parallel" if parallel else "")
        return Mixture(kind, floored(np.stack([p[0] for p in parts])), np.stack([centres[names[key]] for key in keys]), np.stack([p[1] for p in parts]), keys), source
    means = np.stack([random_means(drawn[key], k, rngs[key]) for key in keys])
    return given(kind, means, known, reg_covar, keys), "random" + ("" if whole else "_sampled")
