"""Principal directions, ordering and clustering of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of a vector column. Each task sends one matrix of its own
    sums; the driver sees a matrix of the vector's width squared, however many rows."""

    def run(batches):
        n, s, q = 0, None, None
        for b in batches:
            x = np.array([v for v in b.column(0).to_pylist() if v is not None], float)
            if len(x):
                n, s, q = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if q is None else q)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], ["n", "s", "q"])

    parts = df.select(column).mapInArrow(run, "n long, s array<double>, q array<double>")
    total, s, q = 0, 0.0, 0.0
    for r in parts.toLocalIterator():  # one row a task
        total, s, q = total + r["n"], s + np.array(r["s"]), q + np.array(r["q"])
    if not total:
        return 0, np.zeros(0), np.zeros((0, 0))
    mean = s / total
    return total, mean, q.reshape(len(mean), -1) / total - np.outer(mean, mean)


def principal(df: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the k leading directions (rows) and their variances."""
    _, mean, cov = moments(df, column)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    rows = vectors[:, order].T
    # the sign is fixed: the entry of the largest size is positive
    rows = rows * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])[:, None]
    return mean, rows, values[order]


def contract(a: np.ndarray, b: np.ndarray, axes: tuple[int, int]) -> np.ndarray:
    """Product of two tensors summed over one axis of each."""
    return np.tensordot(a, b, axes=([axes[0]], [axes[1]]))


def determinant(a: np.ndarray) -> float:
    return float(np.linalg.det(np.asarray(a, float)))


def inverse(a: np.ndarray) -> np.ndarray | None:
    """The inverse of a square matrix; None if it has none."""
    a = np.asarray(a, float)
    return None if np.linalg.matrix_rank(a) < len(a) else np.linalg.inv(a)


def project(df: DataFrame, column: str, mean: np.ndarray, directions: np.ndarray, out: str = "projection") -> DataFrame:
    """Coordinates of each vector along the directions, as built-in expressions."""
    centre = F.array(*[F.lit(float(m)) for m in mean])
    shifted = F.zip_with(F.col(column), centre, lambda a, b: a.cast("double") - b)
    dots = [F.aggregate(F.zip_with(shifted, F.array(*[F.lit(float(x)) for x in d]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for d in directions]
    return df.withColumn(out, F.array(*dots))


def seriate(matrix: pd.DataFrame) -> tuple[list, list]:
    """Orders of the rows and columns of a small matrix that put like ones side by side:
    reciprocal averaging until it is steady."""
    x = matrix.to_numpy(float)
    x = x - x.min() + 1e-9
    r = np.arange(len(x), dtype=float)
    c = np.zeros(x.shape[1])
    for _ in range(200):
        c = (x * r[:, None]).sum(0) / x.sum(0)
        new = (x * c[None, :]).sum(1) / x.sum(1)
        new = (new - new.mean()) / (new.std() or 1)
        if np.abs(new - r).max() < 1e-9:
            break
        r = new
    return [matrix.index[i] for i in np.argsort(r, kind="stable")], [matrix.columns[i] for i in np.argsort(c, kind="stable")]


def merge_closest(groups: DataFrame, key: str, ident: str, value: str, reach: float) -> DataFrame:
    """Within each small group, points of one number are merged, closest first, while their
    centres are within `reach`: (key, id, cluster)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        clusters = [[float(v), 1, [i]] for i, v in sorted(zip(pdf[ident], pdf[value]), key=lambda x: x[1])]
        while len(clusters) > 1:
            gaps = [b[0] - a[0] for a, b in zip(clusters, clusters[1:])]
            k = int(np.argmin(gaps))
            if gaps[k] > reach:
                break
            a, b = clusters[k], clusters.pop(k + 1)
            clusters[k] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
        rows = [(pdf[key].iloc[0], i, n) for n, c in enumerate(clusters) for i in c[2]]
        return pd.DataFrame(rows, columns=[key, ident, "cluster"])

    t = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    return groups.select(key, ident, value).groupBy(key).applyInPandas(run, f"{key} {t[key]}, {ident} {t[ident]}, cluster int")
