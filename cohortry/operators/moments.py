"""Exact first and second moments as single aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scale_stats(df: DataFrame, columns) -> tuple[list[float], list[float]]:
    """Mean and population deviation per column; a zero deviation counts as 1.  Nulls count as absent.

    A task merges its batches into one row of counts, means and squared distances from the mean; these rows meet pair by pair.
    """
    columns = list(columns)
    k = len(columns)

    def partial(batches):
        held = None
        for batch in batches:
            found = _spread([c.drop_null().to_numpy(zero_copy_only=False) for c in batch.columns])
            held = found if held is None else _merged(held, found)
        if held is not None:
            yield pa.RecordBatch.from_pydict({"v": [held.ravel().tolist()]}, schema=pa.schema([("v", pa.list_(pa.float64()))]))

    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(partial, "v array<double>")
    held = np.zeros((3, k))
    for r in rows.collect():
        held = _merged(held, np.array(r["v"]).reshape(3, k))
    mean = [float(v) for v in held[1]]
    scale = [float(v) for v in np.sqrt(held[2] / np.maximum(held[0], 1.0))]
    # deviations that are only rounding noise of the mean count as constant
    return mean, [s if s > 10 * np.finfo(float).eps * max(1.0, abs(m)) else 1.0 for m, s in zip(mean, scale)]


def _spread(columns: list[np.ndarray]) -> np.ndarray:
    """Counts, means and sums of squared distances from the mean."""
    out = np.zeros((3, len(columns)))
    for i, values in enumerate(columns):
        if len(values):
            mean = values.mean()
            out[:, i] = len(values), mean, ((values - mean) ** 2).sum()
    return out


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1.0)
    apart = b[1] - a[1]
    return np.stack((n, a[1] + apart * share, a[2] + b[2] + apart**2 * a[0] * share))


def gram(df: DataFrame, vector: str, width: int, weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of weights, weighted sum and weighted second moment of an array column; one small matrix per task."""
    def partial(batches):
        mass, first, second = 0.0, np.zeros(width), np.zeros((width, width))
        for pdf in batches:
            x = np.vstack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, width))
            w = pdf["w"].to_numpy(dtype=float)
            mass += w.sum()
            first += w @ x
            second += (x * w[:, None]).T @ x
        yield pd.DataFrame({"i": np.arange(width + 1),
                            "values": [np.r_[mass, first].tolist(), *[second[i].tolist() + [0.0] for i in range(width)]]})

    source = df.select(F.col(vector).cast("array<double>").alias("v"),
                       (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))
    parts = source.mapInPandas(partial, "i int, values array<double>")
    summed = parts.select("i", F.posexplode("values").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    table = np.zeros((width + 1, width + 1))
    for r in summed:
        table[r["i"], r["j"]] = r["x"]
    return table[0, 0], table[0, 1:], table[1:, :width]
