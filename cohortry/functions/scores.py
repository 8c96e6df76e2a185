"""Per-row scores of class probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.fixed import FOCAL_CLASS_WEIGHTS, FOCAL_GAMMA, N_CLASSES, RESIDUAL_MIX
from cohortry.functions.vectors import col, entry, floats, items, total


def ordinal_risk(p, width: int = N_CLASSES) -> Column:
    """Minus the expected class."""
    return -total(v * F.lit(float(i)) for i, v in enumerate(items(p, width)))


def entropy(p, width: int = N_CLASSES) -> Column:
    q = [F.least(F.greatest(v, F.lit(1e-12)), F.lit(1.0)) for v in items(p, width)]
    return -total(v * F.ln(v) for v in q)


def square_errors(p, truth, width: int = N_CLASSES) -> list[Column]:
    y = col(truth)
    diffs = [v - (y == i).cast("double") for i, v in enumerate(items(p, width))]
    return [d * d for d in diffs]


def truth_rank(p, truth, width: int = N_CLASSES) -> Column:
    """One-based rank of the true class; among equal probabilities the lower class comes first."""
    y, own = col(truth), entry(p, col(truth))
    return F.lit(1) + total(((v > own) | ((v == own) & (F.lit(i) < y))).cast("int") for i, v in enumerate(items(p, width)))


def residual(p, truth, *, mix: float = RESIDUAL_MIX, width: int = N_CLASSES) -> Column:
    """Confidence error plus a share of the summed squared error."""
    return F.lit(1.0) - entry(p, col(truth)) + F.lit(float(mix)) * total(square_errors(p, truth, width))


def residual_input_fault(p, truth, width: int = N_CLASSES) -> Column:
    """True where a row breaks the residual's contract: class range, sign, or unit sum."""
    y, v = col(truth), items(p, width)
    negative = F.least(*v) < 0
    off = F.abs(total(v) - F.lit(1.0)) > F.lit(1e-6 + 1e-5)
    return y.isNull() | (y < 0) | (y >= width) | negative | off


def focal(logits, truth, *, gamma: float = FOCAL_GAMMA, class_weights=FOCAL_CLASS_WEIGHTS, width: int = N_CLASSES) -> Column:
    """Class-weighted focal term of each row from logits."""
    z = items(logits, width)
    top = F.greatest(*z)
    log_p = entry(logits, col(truth)) - top - F.ln(total(F.exp(v - top) for v in z))
    weight = F.lit(1.0) if class_weights is None else entry(floats(class_weights), col(truth))
    return F.pow(F.greatest(F.lit(1.0) - F.exp(log_p), F.lit(1e-8)), F.lit(float(gamma))) * (-log_p) * weight
