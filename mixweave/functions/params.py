"""Mixture parameters as small driver-side arrays, and the tables they become."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("spherical", "diag", "tied", "full")
MIN_WEIGHT = 1e-8
LOG_2PI = math.log(2.0 * math.pi)

MODEL_SCHEMA = "batch_id string, k int, weight double, mean array<double>, cov array<double>"


def covariance_type(name: str) -> str:
    name = {"diagonal": "diag"}.get(name, name)
    if name not in TYPES:
        raise ValueError(f"covariance_type must be one of {TYPES}, not {name!r}")
    return name


def free_parameters(kind: str, k: int, d: int) -> int:
    """How many numbers of one mixture are free."""
    return k * d + {"spherical": k, "diag": k * d, "tied": d * (d + 1) // 2, "full": k * d * (d + 1) // 2}[kind] + k - 1


@dataclass
class Mixture:
    """Parameters of B independent mixtures: weights (B, K), means (B, K, D), and covariances of shape (B, K), (B, K, D), (B, D, D) or (B, K, D, D).

    keys names the batches; an unbatched mixture has the one key None.
    """

    kind: str
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    keys: list = field(default_factory=lambda: [None])

    def __post_init__(self):
        self.kind = covariance_type(self.kind)
        self.weights, self.means, self.covariances = (np.asarray(x, float) for x in (self.weights, self.means, self.covariances))
        if self.means.ndim != 3:
            raise ValueError("means must have shape (B, K, D)")
        b, k, d = self.means.shape
        want = {"spherical": (b, k), "diag": (b, k, d), "tied": (b, d, d), "full": (b, k, d, d)}[self.kind]
        if self.weights.shape != (b, k) or self.covariances.shape != want or len(self.keys) != b:
            raise ValueError(f"weights must have shape {(b, k)} and covariances {want}, for {b} keys")

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.means.shape

    def free_parameters(self) -> int:
        b, k, d = self.shape
        return b * free_parameters(self.kind, k, d)

    def component_covariances(self) -> np.ndarray:
        """Covariances by component, the shared one of tied repeated: (B, K, ...)."""
        b, k, d = self.shape
        return np.broadcast_to(self.covariances[:, None], (b, k, d, d)) if self.kind == "tied" else self.covariances

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row per batch and component; cov is row-major, of length 1, D or D x D."""
        cov = self.component_covariances()
        rows = [(None if key is None else str(key), k, float(self.weights[b, k]), self.means[b, k].tolist(), np.ravel(cov[b, k]).tolist()) for b, key in enumerate(self.keys) for k in range(self.shape[1])]
        return spark.createDataFrame(rows, MODEL_SCHEMA)

    @classmethod
    def from_frame(cls, frame: DataFrame, kind: str) -> Mixture:
        kind = covariance_type(kind)
        rows = sorted(frame.collect(), key=lambda r: (r.batch_id is not None, r.batch_id or "", r.k))
        keys = list(dict.fromkeys(r.batch_id for r in rows))
        groups = [[r for r in rows if r.batch_id == key] for key in keys]
        means = np.array([[r.mean for r in g] for g in groups])
        b, k, d = means.shape
        cov = np.array([[r.cov for r in g] for g in groups])
        shaped = {"spherical": lambda: cov[:, :, 0], "diag": lambda: cov, "tied": lambda: cov[:, 0].reshape(b, d, d), "full": lambda: cov.reshape(b, k, d, d)}[kind]()
        return cls(kind, np.array([[r.weight for r in g] for g in groups]), means, shaped, keys)

    def to_long(self, spark: SparkSession, digits: int | None = None) -> DataFrame:
        """Every number in a row of its own: part is weight, mean or cov; a tied covariance has k = -1."""
        return long_frame(spark, self.keys, {"weight": self.weights, "mean": self.means, "cov": self.covariances}, {"cov"} if self.kind == "tied" else set(), digits)


def long_frame(spark: SparkSession, keys: list, parts: dict[str, np.ndarray], shared: set[str] = frozenset(), digits: int | None = None) -> DataFrame:
    """A row (batch_id, part, k, i, j, value) for each number of arrays by batch; parts in shared have no component, places that an array lacks are -1."""
    columns: list[list] = [[], [], [], [], [], []]
    for part, values in parts.items():
        b, *rest = (at.ravel() for at in np.indices(values.shape))
        none = np.full(values.size, -1)
        k, i, j = ([none, *rest] if part in shared else rest) + [none] * (3 - len(rest) - (part in shared))
        for column, v in zip(columns, (np.array([None if key is None else str(key) for key in keys], object)[b], np.full(values.size, part, object), k, i, j, np.ravel(values)), strict=True):
            column.append(v)
    types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    table = pa.table([pa.array(np.concatenate(v), t) for v, t in zip(columns, types, strict=True)], names=["batch_id", "part", "k", "i", "j", "value"])
    frame = spark.createDataFrame(table)
    return frame if digits is None else frame.withColumn("value", F.round("value", digits) + 0.0)
