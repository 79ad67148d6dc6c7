"""Ridge regression from one Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram_matrix(vectors: DataFrame, label: str, width: int) -> np.ndarray:
    """Z'Z of the rows Z = (1, features, label), in one pass.

    Each task adds up its outer products; one number for each pair of columns leaves a task and
    one comes back, so the size is the model's, whatever the number of rows.
    """
    size = width + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, width)
            z = np.column_stack([np.ones(len(x)), x, batch.column(1).to_numpy()])
            total += z.T @ z
        i, j = np.triu_indices(size)
        columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "value"])

    rows = vectors.select(vector_to_array("features").alias("x"), F.col(label).cast("double"))
    sums = rows.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    found = np.zeros((size, size))
    for row in sums.collect():
        found[row["i"], row["j"]] = found[row["j"], row["i"]] = row["value"]
    return found


@dataclass
class RidgeModel:
    """An intercept and a coefficient for each feature."""

    intercept: float
    coefficients: list[float]

    def value(self, columns: list[str]) -> Column:
        total = F.lit(self.intercept)
        for coefficient, column in zip(self.coefficients, columns):
            total = total + F.lit(coefficient) * F.col(column)
        return total


def fit_ridge(vectors: DataFrame, label: str, width: int, alpha: float = 1.0) -> RidgeModel:
    """Coefficients of least squared error plus ``alpha`` times their squares; the intercept is free.

    Without rows all are zero. A feature that never varies gets zero.
    """
    gram = gram_matrix(vectors, label, width)
    rows = gram[0, 0]
    if not rows:
        return RidgeModel(0.0, [0.0] * width)
    means = gram[0] / rows
    centred = gram - rows * np.outer(means, means)
    x = centred[1:-1, 1:-1] + alpha * np.eye(width)
    found = np.linalg.lstsq(x, centred[1:-1, -1], rcond=None)[0]
    return RidgeModel(float(means[-1] - means[1:-1] @ found), found.tolist())
