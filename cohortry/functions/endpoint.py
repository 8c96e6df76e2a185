"""Endpoint expressions: classes, horizons and maturity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.fixed import CUTPOINTS, HORIZON
from cohortry.functions.vectors import col, total


def months_to_class(time, cutpoints=CUTPOINTS) -> Column:
    """Number of boundaries at or below the time: a boundary opens the later class."""
    t = col(time)
    return total((t >= F.lit(c)).cast("int") for c in cutpoints)


def immature(time, event, horizon: float = HORIZON) -> Column:
    """Censored before the last boundary, so the class is unknown."""
    return (col(event) == 0) & (col(time) < F.lit(horizon))


def horizon_observed(time, event, horizon: float) -> Column:
    t = col(time)
    return ((col(event) == 1) & (t <= F.lit(horizon))) | (t >= F.lit(horizon))


def horizon_outcome(time, horizon: float) -> Column:
    """1 when follow-up passes the horizon; a row censored exactly there counts as 0."""
    return (col(time) > F.lit(horizon)).cast("int")
