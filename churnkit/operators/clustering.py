"""Clustering fits.

Fits run on Spark ML over all rows. Only fixed-size summaries reach the
driver: centroids (k x D) and mixture parameters.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmeans_best_of(df: DataFrame, k: int, n_init: int = 10, seed: int = 42, vec: str = "features",
                   max_iter: int = 300):
    """K-means|| restarts with seeds seed..seed+n_init-1; keep the lowest cost."""
    best = None
    for i in range(n_init):
        m = KMeans(k=k, seed=seed + i, featuresCol=vec, maxIter=max_iter, initMode="k-means||").fit(df)
        cost = m.summary.trainingCost
        if best is None or cost < best[1]:
            best = (m, cost)
    m, cost = best
    return m, cost, m.transform(df).withColumnRenamed("prediction", "cluster")


def gaussian_mixture(df: DataFrame, k: int, seed: int = 42, vec: str = "features", max_iter: int = 100):
    """C4 + M19: full-covariance mixture, BIC and AIC.

    p = K*D*(D+1)/2 + K*D + K - 1 free parameters. The log-likelihood is that of
    the returned weights, means and covariances (the fit summary's belongs to
    the step before). k = 1 is not accepted by Spark.
    """
    m = GaussianMixture(k=k, seed=seed, featuresCol=vec, maxIter=max_iter).fit(df)
    d = len(df.select(vec).first()[0])
    n = df.count()
    p = k * d * (d + 1) / 2 + k * d + k - 1
    ll = mixture_log_likelihood(df, m, vec)
    info = {"log_likelihood": ll, "bic": -2 * ll + p * math.log(n), "aic": -2 * ll + 2 * p, "n_params": p}
    return m, info, m.transform(df).withColumnRenamed("prediction", "cluster")


def mixture_log_likelihood(df: DataFrame, model, vec: str = "features") -> float:
    """sum over rows of log sum_k w_k N(x; mu_k, S_k), as column expressions over the k x D parameters."""
    x = vector_to_array(vec)
    parts = []
    for w, g in zip(model.weights, model.gaussians, strict=True):
        mu, cov = g.mean.toArray(), g.cov.toArray()
        inv, (_, logdet) = np.linalg.inv(cov), np.linalg.slogdet(cov)
        d = [x[i] - float(mu[i]) for i in range(len(mu))]
        square = sum((d[i] * d[j] * float(inv[i, j]) for i in range(len(mu)) for j in range(len(mu))), F.lit(0.0))
        parts.append(F.lit(float(math.log(max(w, 1e-300)) - 0.5 * (logdet + len(mu) * math.log(2 * math.pi)))) - 0.5 * square)
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    total = sum((F.exp(p - F.col("_top")) for p in parts), F.lit(0.0))
    return df.withColumn("_top", top).agg(F.sum(F.col("_top") + F.log(total))).first()[0]


def pca(df: DataFrame, k: int, vec: str = "features", out: str = "pca"):
    """Centre, project on k components; signs fixed so the largest |loading| is positive."""
    c = StandardScaler(inputCol=vec, outputCol="_c", withMean=True, withStd=False).fit(df).transform(df)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(c)
    pc = model.pc.toArray()
    signs = [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(k)]
    arr = vector_to_array("_p")
    proj = model.transform(c).withColumn(out, array_to_vector(F.array(*[arr[j] * signs[j] for j in range(k)])))
    return model, list(model.explainedVariance), proj.drop("_c", "_p")


def hierarchical(df: DataFrame, k: int, seed: int = 42, vec: str = "features", max_iter: int = 100):
    """Divisive hierarchical clustering (bisecting k-means) of all rows into k clusters.

    The agglomerative form merges all pairs on one machine; this one splits the
    largest cluster again and again, every step of a split one pass over all packed rows (bisecting).
    """
    from .bisecting import bisect
    from .vector_blocks import pack
    blocks = pack(df, vec=vec)
    m = bisect(blocks, k, seed, max_iter)
    blocks.close()
    return m, m.transform(df, vec, "cluster")


def k_search(df: DataFrame, k_range=range(2, 15), seed: int = 42, vec: str = "features", n_init: int = 10, key: str = "row_id"):
    """H6: per k the least k-means cost of ``n_init`` restarts and the quality measures, best k by silhouette flagged
    (ties: the smaller); rows for a table. All k and restarts share their passes (kmeans_many)."""
    from .kmeans_many import kmeans_many, quality_many
    from .vector_blocks import pack
    blocks = pack(df, [key], vec)
    found = kmeans_many(blocks, list(k_range), n_init, seed)
    quality = quality_many(blocks, {k: c.centers for k, c in found.items()}) if found else {}
    blocks.close()
    rows = [(k, found[k].cost, *(float(quality[k][m]) for m in ("silhouette_sq", "davies_bouldin", "calinski_harabasz"))) for k in sorted(found)]
    best = max(rows, key=lambda r: (r[2], -r[0]), default=(None,))[0]
    return [(*r, int(r[0] == best)) for r in rows]
