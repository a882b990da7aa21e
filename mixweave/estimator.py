"""A scikit-learn-like estimator over DataFrames with a column features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixweave.functions.params import covariance_type, free_parameters
from mixweave.operators import density, em, keyed

DEFAULTS = {
    "d": None, "k": None, "niter": 100, "tol": 1e-4, "seed": 0, "covariance_type": "spherical", "init_params": "kmeans", "reg_covar": 1e-6,
    "init_kmeans_iters": 10, "init_kmeans_tol": 1e-4, "approx_top_k": None, "compute_labels_on_fit": True, "verbose": False,
    "batch_col": None, "strategy": "auto", "em_mode": "soft",
}
ALIASES = {"n_components": "k", "n_features": "d", "max_iter": "niter", "random_state": "seed"}
LEARNED = ("means_", "weights_", "covariances_", "labels_", "lower_bound_", "lower_bound_history_", "n_iter_", "init_source_", "fit_info_", "means_b", "weights_b", "covariances_b", "mixture_", "keyed_")


class GaussianMixture:
    """Gaussian mixture with spherical, diag, tied or full covariance, for one table or for each value of batch_col.

    k (or n_components) is required. d sticks once it is known. labels_ is a lazy DataFrame: the fitted rows with a column label.
    With more batch keys than the driver should hold parameters for, they are fitted as a table on the executors: keyed_ then has the fit (keyed_.model its
    table), and the attributes with arrays stay None. Predictions for a batch key that the model lacks raise an error when they are read.
    """

    def __init__(self, **params):
        for name in LEARNED:
            setattr(self, name, None)
        self._params = dict(DEFAULTS)
        self._take(params)

    def _take(self, params: dict) -> None:
        given: dict = {}
        for name, value in params.items():
            to = ALIASES.get(name, name)
            if to not in DEFAULTS:
                raise ValueError(f"unknown parameter {name!r}")
            if to in given and value is not None and given[to] is not None and given[to] != value:
                raise ValueError(f"conflicting values for {to} and its alias")
            given[to] = value if given.get(to) is None else given[to]
        p = self._params | {n: (DEFAULTS[n] if v is None else v) for n, v in given.items()}
        if p["k"] is None:
            raise ValueError("k or n_components is required")
        for name in ("k", "niter", "init_kmeans_iters", *[n for n in ("d", "approx_top_k") if p[n] is not None]):
            p[name] = int(p[name])
            if p[name] <= 0:
                raise ValueError(f"{name} must be positive")
        for name in ("tol", "reg_covar", "init_kmeans_tol"):
            p[name] = float(p[name])
            if not p[name] >= 0:
                raise ValueError(f"{name} must be non-negative")
        p["covariance_type"] = covariance_type(p["covariance_type"])
        if p["init_params"] not in ("kmeans", "random"):
            raise ValueError("init_params must be 'kmeans' or 'random'")
        if p["em_mode"] not in em.MODES:
            raise ValueError(f"em_mode must be one of {em.MODES}")
        density.choose(p["strategy"], 1)
        self._params = p

    def __getattr__(self, name):
        params = self.__dict__.get("_params", {})
        if name in params:
            return params[name]
        raise AttributeError(name)

    def get_params(self, deep: bool = True) -> dict:
        return dict(self._params) | {a: self._params[n] for a, n in ALIASES.items()}

    def set_params(self, **params) -> GaussianMixture:
        """Validates again and forgets what was learned."""
        self._take(params)
        for name in LEARNED:
            setattr(self, name, None)
        return self

    def fit(self, data: DataFrame, y=None, init_means=None, init_weights=None, init_covariances=None) -> GaussianMixture:
        p = self._params
        try:
            report = em.fit(data, p["k"], p["covariance_type"], p["niter"], p["tol"], p["seed"], p["init_params"], p["reg_covar"], p["batch_col"], init_means, init_weights, init_covariances, p["approx_top_k"], p["em_mode"], p["strategy"], p["init_kmeans_iters"], p["init_kmeans_tol"], p["d"], p["verbose"])
        except em.TooManyKeys:
            if init_means is not None or init_weights is not None or init_covariances is not None:
                raise
            return self._fit_keyed(data)
        m = report.mixture
        p["d"] = m.shape[2]
        self.mixture_, self.means_b, self.weights_b, self.covariances_b = m, m.means, m.weights, m.covariances
        squeeze = (lambda a: a) if p["batch_col"] else (lambda a: a[0])
        self.means_, self.weights_, self.covariances_ = squeeze(m.means), squeeze(m.weights), squeeze(m.covariances)
        self.lower_bound_, self.lower_bound_history_, self.n_iter_, self.init_source_ = report.lower_bound, report.lower_bound_history, report.n_iter, report.init_source
        self.fit_info_ = {n: getattr(report, n) for n in ("n_iter", "lower_bound", "lower_bound_history", "init_source", "strategy", "approx_top_k", "em_mode", "n_rows")}
        self.labels_ = self.predict(data) if p["compute_labels_on_fit"] else None
        return self

    def _fit_keyed(self, data: DataFrame) -> GaussianMixture:
        p = self._params
        self.keyed_ = fitted = keyed.fit(data, p["k"], p["covariance_type"], p["batch_col"], p["niter"], p["tol"], p["seed"], p["init_params"], p["reg_covar"], None, p["approx_top_k"], p["em_mode"], p["init_kmeans_iters"], p["init_kmeans_tol"])
        p["d"], history = fitted.d, fitted.lower_bound_history
        self.lower_bound_, self.lower_bound_history_, self.n_iter_, self.init_source_ = history[-1], history, fitted.n_iter, p["init_params"] + "_keyed"
        self.fit_info_ = {"n_iter": fitted.n_iter, "lower_bound": history[-1], "lower_bound_history": history, "init_source": self.init_source_, "strategy": "keyed", "approx_top_k": p["approx_top_k"], "em_mode": p["em_mode"], "n_rows": fitted.n_rows}
        self.labels_ = self.predict(data) if p["compute_labels_on_fit"] else None
        return self

    def train(self, data: DataFrame) -> None:
        self.fit(data)

    def _known(self, data: DataFrame) -> None:
        if self.mixture_ is None and self.keyed_ is None:
            raise RuntimeError("the mixture isn't trained; call fit first")
        if self.batch_col and self.batch_col not in data.columns:
            raise ValueError(f"the model was trained by {self.batch_col}, which the data lack")

    def _fitting(self, data: DataFrame) -> DataFrame:
        """data, whose vectors raise an error when they are read if they have another length than the model's, or a batch key that it lacks; null ones stay null."""
        self._known(data)
        d, size = self._params["d"], F.size("features")
        told = F.raise_error(F.concat(F.lit(f"the model has {d} features, not "), size.cast("string")))
        fits = F.when(F.col("features").isNull() | (size == d), F.col("features")).otherwise(told)
        if self.batch_col and self.mixture_ is not None:
            key = F.col(self.batch_col).cast("string")
            lacks = F.raise_error(F.concat(F.lit("the model lacks the batch key "), F.coalesce(key, F.lit("null"))))
            fits = F.when(F.coalesce(key.isin([str(k) for k in self.mixture_.keys]), F.lit(False)), fits).otherwise(lacks)
        return data.withColumn("features", fits)

    def _predict(self, data: DataFrame, what: str, plain) -> DataFrame:
        rows = self._fitting(data)
        return keyed.predict(rows, self.keyed_, self.batch_col, (what,)) if self.keyed_ else plain(rows, self.mixture_, self.batch_col, self.strategy)

    def predict(self, data: DataFrame) -> DataFrame:
        """data with a column label."""
        return self._predict(data, "label", density.assign)

    def predict_proba(self, data: DataFrame) -> DataFrame:
        """data with a column proba, an array of K."""
        return self._predict(data, "proba", density.predict_proba)

    def score_samples(self, data: DataFrame) -> DataFrame:
        """data with a column log_prob."""
        return self._predict(data, "log_prob", density.score_samples)

    def fit_predict(self, data: DataFrame, y=None) -> DataFrame:
        self.fit(data)
        return self.labels_ if self.labels_ is not None else self.predict(data)

    def _total(self, data: DataFrame) -> tuple[float, int]:
        row = self.score_samples(data).agg(F.sum("log_prob"), F.count("log_prob")).first()
        return float(row[0] or 0.0), int(row[1])

    def _parameters(self) -> int:
        return self.keyed_.n_keys * free_parameters(self.covariance_type, self.k, self._params["d"]) if self.keyed_ else self.mixture_.free_parameters()

    def score(self, data: DataFrame, y=None) -> float:
        total, n = self._total(data)
        return total / n

    def bic(self, data: DataFrame) -> float:
        total, n = self._total(data)
        return density.bic(total, n, self._parameters())

    def aic(self, data: DataFrame) -> float:
        return density.aic(self._total(data)[0], self._parameters())
