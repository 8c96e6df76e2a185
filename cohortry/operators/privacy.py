"""Gradient clipping and Gaussian noise for federated rounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.fixed import CLIP_NORM, NOISE_MULTIPLIER
from cohortry.functions.hashing import hash_uniform
from cohortry.functions.vectors import items, total


def clipped(gradient, width: int, norm: float = CLIP_NORM) -> Column:
    g = items(gradient, width)
    size = F.sqrt(total(v.cast("double") * v.cast("double") for v in g))
    scale = F.least(F.lit(1.0), F.lit(norm) / F.greatest(size, F.lit(1e-12)))
    return F.array(*[v.cast("double") * scale for v in g])


def gaussian(*parts) -> Column:
    """Standard normal draw fixed by its key, so a retried task adds the same noise."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - hash_uniform("r", *parts)))
    return radius * F.cos(F.lit(2.0 * math.pi) * hash_uniform("a", *parts))


def noisy_gradients(df: DataFrame, *, gradient: str, width: int, row_id: str, secret: str, round_id: str | None = None,
                    norm: float = CLIP_NORM, multiplier: float = NOISE_MULTIPLIER) -> DataFrame:
    """Adds the clipped gradient and the noisy one, per site.

    ``secret`` keys the noise: a retried task adds the same draw, and nobody without the key can subtract it.  It has no
    default and should be new for every run.
    """
    if not secret:
        raise ValueError("a secret key is needed for the noise")
    keys = [secret, *([F.col(round_id)] if round_id else []), F.col(row_id)]
    rows = df.withColumn("clipped", clipped(gradient, width, norm))
    noise = [gaussian(*keys, i) * F.lit(multiplier * norm) for i in range(width)]
    return rows.withColumn("noisy", F.array(*[F.col("clipped")[i] + n for i, n in enumerate(noise)]))


def round_sum(noisy: DataFrame, *, width: int, round_id: str) -> DataFrame:
    return noisy.groupBy(round_id).agg(F.count(F.lit(1)).alias("sites"), F.array(*[F.sum(F.col("noisy")[i]) for i in range(width)]).alias("total"))
