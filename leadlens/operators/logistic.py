"""Weighted logistic regression with an L2 penalty, fitted by Newton steps.

The objective is ``sum of weight * loss + |b|^2 / (2 C)``, the intercept without penalty.  A
step takes one pass over the rows: gradient and Hessian are sums of products, added up in the
tasks (see ``moments``), and the system of the few coefficients is solved on the driver.  The
objective at the current point comes with the same pass; a step that raised it is halved.

The rule to stop is fixed: a step of at most ``tol`` in every coefficient.  Steps shrink
quadratically, so the result does not depend on how rows are partitioned, beyond the rounding
of sums (well below 1e-9).  Rows of one class alone have no finite optimum: all coefficients
are 0 and the intercept is infinite, so the score is that class.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import sigmoid
from ..session import cut_lineage
from .arrow import matrix
from .moments import summed, tasks


@dataclass
class LogisticModel:
    """Coefficients over the slots, the intercept, and the passes that the fit took."""
    coefficients: DenseVector
    intercept: float
    passes: int = 0

    def margin(self, features: Column) -> Column:
        """Log-odds of an array<double> column of slots."""
        z = F.lit(float(self.intercept))
        for k, b in enumerate(self.coefficients.toArray().tolist()):
            z = z + F.lit(b) * features[k]
        return z

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with the vector ``probability`` of both classes, as Spark ML's models give it."""
        kind = df.schema[features].dataType.simpleString()
        p = sigmoid(self.margin(F.col("_slots")))
        slots = F.col(features) if kind == "array<double>" else vector_to_array(features)
        return df.withColumn("_slots", slots).withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("_slots")

    def to_json(self) -> str:
        return json.dumps({"coefficients": self.coefficients.toArray().tolist(), "intercept": self.intercept, "passes": self.passes})

    @classmethod
    def from_json(cls, text: str) -> "LogisticModel":
        d = json.loads(text)
        return cls(Vectors.dense(d["coefficients"]), d["intercept"], d["passes"])


@dataclass
class NewtonLogistic:
    """The estimator: ``fit`` reads a vector (or array) column of features, a 0/1 label and a weight."""
    features: str = "features"
    label: str = "converteu"
    weight: str = "weight"
    c: float = 1.0
    max_iter: int = 100
    tol: float = 1e-10

    def fit(self, df: DataFrame) -> LogisticModel:
        kind = df.schema[self.features].dataType.simpleString()
        x = F.col(self.features) if kind == "array<double>" else vector_to_array(self.features)
        rows = cut_lineage(df.select(x.alias("x"), F.col(self.label).cast("double").alias("y"),
                                     F.col(self.weight).cast("double").alias("w")))   # read once a step
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("no rows to fit")
        d, n_tasks = first[0], tasks(rows)
        penalty = np.append(np.full(d, 1.0 / self.c), 0.0)
        beta, step, before = np.zeros(d + 1), np.zeros(d + 1), np.inf
        for passes in range(1, self.max_iter + 1):
            sums = summed(rows, _normal_equations(beta), (d + 3, d + 1), n_tasks)
            if passes == 1 and abs(sums[d + 1, d]) >= 2 * sums[d, d] * (1 - 1e-12):
                return LogisticModel(Vectors.dense(np.zeros(d)), float(np.copysign(np.inf, sums[d + 1, d])), 1)
            loss = sums[d + 2, 0] + 0.5 * float(penalty @ beta ** 2)
            if loss > before + 1e-9 * abs(before):   # too far: half of the step instead
                step /= 2
                beta = beta - step
                continue
            before = loss
            step = np.linalg.solve(sums[:d + 1] + np.diag(penalty), sums[d + 1] - penalty * beta)
            beta = beta + step
            if np.abs(step).max() <= self.tol:
                break
        return LogisticModel(Vectors.dense(beta[:d]), float(beta[d]), passes)


def _normal_equations(beta: np.ndarray):
    """For a batch: the Hessian's rows, the gradient, and the loss in the first place of the last row."""
    def part(batch: pa.RecordBatch) -> np.ndarray:
        x = np.column_stack([matrix(batch.column("x"), len(beta) - 1), np.ones(batch.num_rows)])
        y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
        z = x @ beta
        p = 1.0 / (1.0 + np.exp(-z))
        out = np.zeros((len(beta) + 2, len(beta)))
        out[:len(beta)] = x.T @ (x * (w * p * (1.0 - p))[:, None])
        out[len(beta)] = x.T @ (w * (y - p))
        out[-1, 0] = float(np.sum(w * (np.logaddexp(0.0, z) - y * z)))
        return out
    return part
