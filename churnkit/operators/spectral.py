"""Spectral clustering of all rows from landmark affinities (Fowlkes et al. 2004).

The affinity of all rows is taken as B A^-1 B', where B holds the RBF values of every row
against m landmark rows (by hash order) and A those among the landmarks. One pass sums B,
which gives every row's degree; a second sums the degree-normalised products, an m x m
matrix whose eigenvectors give each row its coordinates. These, scaled to length 1, go to
k-means (kmeans_many). Every row gets the label of its own coordinates; nothing is sampled
but the landmarks, whose number is a parameter.

Cases: fewer rows than landmarks use all; rows that no landmark is near have degree 0
and coordinates 0; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import inverse_root, kernel_values, landmarks
from .kmeans_many import _nearest, kmeans_many
from .vector_blocks import pack


def spectral(df: DataFrame, k: int, gamma: float = 1.0, m: int = 200, restarts: int = 10, seed: int = 42, vec: str = "features") -> DataFrame:
    """(row_id, cluster) of every row of ``df`` (row_id, split, ``vec``)."""
    from pyspark.sql import functions as F
    blocks = pack(df, ["row_id"], vec)
    d = blocks.width - 1
    if not blocks.rows:
        blocks.close()
        return df.sparkSession.createDataFrame([], "row_id long, cluster int")
    z = landmarks(df.withColumn("split", F.lit("train")), m, vec, seed)
    size = len(z)
    values = lambda x: kernel_values(x[:, :d], z, "rbf", gamma)     # noqa: E731
    root = inverse_root(kernel_values(z, z, "rbf", gamma))
    total = blocks.sums(lambda x: values(x).sum(axis=0), size)
    toward = root @ (root @ total)                                  # A^-1 (sum of B)

    def normalised(x: np.ndarray) -> np.ndarray:
        b = values(x)
        degree = b @ toward
        return np.divide(b, np.sqrt(np.maximum(degree, 1e-12))[:, None], out=np.zeros_like(b), where=degree[:, None] > 1e-12)

    def products(x: np.ndarray) -> np.ndarray:
        v = normalised(x) @ root
        return (v.T @ v).ravel()

    gram = blocks.sums(products, size * size).reshape(size, size)
    eigen, vectors = np.linalg.eigh((gram + gram.T) / 2)
    top = root @ (vectors[:, ::-1][:, :k] / np.sqrt(np.maximum(eigen[::-1][:k], 1e-12)))

    def coordinates(x: np.ndarray) -> np.ndarray:
        u = normalised(x) @ top
        return u / np.maximum(np.linalg.norm(u, axis=1), 1e-12)[:, None]

    def embedded(x: np.ndarray) -> pa.RecordBatch:
        u = coordinates(x)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * k, pa.int32()), pa.array(u.ravel()))
        return pa.RecordBatch.from_pydict({"row_id": pa.array(x[:, d].astype(np.int64)), "u": lists})

    points = pack(blocks.rows_of(embedded, "row_id long, u array<double>"), ["row_id"], F.col("u"))
    centers = kmeans_many(points, [k], restarts, seed)[k].centers

    def label(x: np.ndarray) -> pa.RecordBatch:
        at, _ = _nearest(coordinates(x), centers)
        return pa.RecordBatch.from_pydict({"row_id": pa.array(x[:, d].astype(np.int64)), "cluster": pa.array(at, pa.int32())})

    points.close()
    return blocks.rows_of(label, "row_id long, cluster int")       # the blocks stay for the lazy result
