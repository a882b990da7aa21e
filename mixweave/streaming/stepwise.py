"""Stepwise EM: a mixture that follows a stream, from statistics that forget.

Each micro-batch is one step. Its rows give the mean statistics under the current parameters (one distributed pass); the state moves towards
them, S <- (1 - rate) S + rate s, and the parameters follow from the state. The first batch is taken as it is. State and parameters
are a few numbers for each component, kept on the driver and written to the shared folder under the number of their batch before the batch
counts as done, so a restarted stream goes on from its last step and no batch counts twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mixweave.functions.params import Mixture
from mixweave.operators import finalize
from mixweave.operators import stats as st
from mixweave.sources.features import valid

SCHEMA = "step long, n long, log_likelihood double, state array<double>, params array<double>"


class StepwiseEM:
    """Steps from start on, with the state in the Parquet tables path/step=<number of the micro-batch>. Batches without a good row change nothing; spherical and diag mixtures."""

    def __init__(self, start: Mixture, path: str, rate: float = 0.5, reg_covar: float = 1e-6):
        if not 0 < rate <= 1:
            raise ValueError("rate must lie in (0, 1]")
        if start.kind not in ("spherical", "diag") or start.shape[0] != 1:
            raise ValueError("stepwise EM takes one spherical or diag mixture")
        self.mixture, self.path, self.rate, self.reg_covar = start, path.rstrip("/"), rate, reg_covar
        self.step, self.state = -1, None

    def restore(self, spark: SparkSession) -> None:
        """Takes up the last step that was written, if any."""
        from pyspark.errors import AnalysisException

        try:
            row = spark.read.schema(SCHEMA).parquet(f"{self.path}/step=*").orderBy("step", ascending=False).first()
        except AnalysisException as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return
        if row and row.step > self.step:
            _, k, d = self.mixture.shape
            v = np.array(row.params)
            shape = (1, k) if self.mixture.kind == "spherical" else (1, k, d)
            self.mixture = Mixture(self.mixture.kind, v[:k][None], v[k : k + k * d].reshape(1, k, d), v[k + k * d :].reshape(shape))
            self.step, self.state = row.step, np.array(row.state)

    def update(self, rows: DataFrame, step: int) -> None:
        """One step with the rows of a micro-batch; a step that was taken already is left out."""
        if step <= self.step:
            return
        _, k, d = self.mixture.shape
        found = st.soft(rows.where(valid(rows["features"], d)), self.mixture)[0]
        if found.n:
            flat = np.concatenate([found.nk, found.sum_x.ravel(), found.second.ravel()]) / found.n
            self.state = flat if self.state is None else (1 - self.rate) * self.state + self.rate * flat
            kept = st.Stats.unpack(np.concatenate([[1.0, 0.0], self.state]), self.mixture.kind, k, d)
            self.mixture = finalize.update(self.mixture, [kept], self.reg_covar)
        self.step = step
        m = self.mixture
        params = np.concatenate([m.weights.ravel(), m.means.ravel(), m.covariances.ravel()]).tolist()
        done = [(step, int(found.n), float(found.log_likelihood), [] if self.state is None else self.state.tolist(), params)]
        rows.sparkSession.createDataFrame(done, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/step={step}")

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts to follow a stream with a column features."""
        self.restore(stream.sparkSession)
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
