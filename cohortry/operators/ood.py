"""Out-of-distribution scores by squared Mahalanobis distance to class centroids."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.vectors import col
from cohortry.operators.moments import gram
from cohortry.operators.quantiles import exact_quantiles


@dataclass
class Mahalanobis:
    """Whitened centroids and per-class thresholds; scoring is a pure expression and works on streams."""

    classes: list[int]
    whitener: np.ndarray
    centroids: np.ndarray
    thresholds: list[float]

    def _distances(self, x) -> tuple[Column, Column]:
        """Squared distances by class as |Wx - Wm|^2 with W'W the inverse covariance, and the array Wx they read."""
        v = F.transform(col(x), lambda e: e.cast("double"))
        rows = F.array(*[F.array(*[F.lit(float(w)) for w in r]) for r in self.whitener])
        white = F.transform(rows, lambda r: F.aggregate(F.zip_with(r, v, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e))
        targets = F.array(*[F.array(*[F.lit(float(w)) for w in m @ self.whitener.T]) for m in self.centroids])
        return F.transform(targets, lambda m: F.aggregate(
            F.zip_with(F.col("_white"), m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e)), white

    def score(self, df: DataFrame, x: str = "x") -> DataFrame:
        """Adds nearest_class (lowest id on ties), distance, threshold and is_ood."""
        distances, white = self._distances(x)
        rows = df.withColumn("_white", white).withColumn("_d", distances)
        rows = rows.withColumn("distance", F.array_min("_d")).withColumn("_k", F.array_position("_d", F.col("distance")).cast("int"))
        ids = F.array(*[F.lit(int(c)) for c in self.classes])
        limits = F.array(*[F.lit(float(t)) for t in self.thresholds])
        return (rows.withColumn("nearest_class", F.element_at(ids, F.col("_k"))).withColumn("threshold", F.element_at(limits, F.col("_k")))
                .withColumn("is_ood", F.col("distance") > F.col("threshold")).drop("_white", "_d", "_k"))


def fit_mahalanobis(df: DataFrame, width: int, *, x: str = "x", label: str = "label", percentile: float = 99.0,
                    ridge: float = 1e-6) -> Mahalanobis:
    """Shared sample covariance with a ridge, class centroids, and the class percentile of own squared distances."""
    mass, first, second = gram(df, x, width)
    mean = first / mass
    covariance = (second - mass * np.outer(mean, mean)) / (mass - 1.0) + ridge * np.eye(width)
    values, vectors = np.linalg.eigh(np.linalg.pinv(covariance))
    whitener = np.diag(np.sqrt(np.clip(values, 0.0, None))) @ vectors.T
    v = F.col(x)
    centres = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        *[F.avg(v[i].cast("double")).alias(f"m{i}") for i in range(width)]).collect()
    centres = sorted(centres, key=lambda r: r[0])
    classes = [int(r[0]) for r in centres]
    centroids = np.array([[r[f"m{i}"] for i in range(width)] for r in centres])
    model = Mahalanobis(classes, whitener, centroids, [0.0] * len(classes))
    distances, white = model._distances(x)
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("int")).cast("int")
    own = (df.where(F.col(label).isNotNull()).withColumn("_white", white).withColumn("_d", distances)
           .select(F.col(label).cast("int").alias("c"), F.element_at("_d", place).alias("d")))
    found = {r["c"]: r["value"] for r in exact_quantiles(own, ["d"], [percentile / 100.0], keys=["c"]).collect()}
    model.thresholds = [float(found[c]) for c in classes]
    return model
