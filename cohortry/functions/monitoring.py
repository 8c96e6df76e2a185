"""Monitor decisions and the proximal weight step as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.fixed import ENTROPY_HARD, ENTROPY_SOFT, ERROR_HARD, ERROR_SOFT, ONLINE_RATE, PROXIMAL_RATE
from cohortry.functions.vectors import bind, col, items, total


def update_action(error, soft: float = ERROR_SOFT, hard: float = ERROR_HARD) -> Column:
    e = col(error)
    return F.when(e > hard, F.lit("full_retrain")).when(e > soft, F.lit("soft_update")).otherwise(F.lit("no_update"))


def abstain_decision(entropy, soft: float = ENTROPY_SOFT, hard: float = ENTROPY_HARD) -> Column:
    h = col(entropy)
    return F.when(h >= hard, F.lit("hard_abstain")).when(h >= soft, F.lit("soft_abstain")).otherwise(F.lit("serve"))


def proximal_step(weights, gradient, anchor, width: int, *, rate: float = ONLINE_RATE, proximal: float = PROXIMAL_RATE) -> Column:
    """Gradient step pulled to the anchor, clipped at zero and renormalised; uniform when nothing is left."""
    moved = [F.greatest(w - F.lit(rate) * g - F.lit(proximal) * (w - a), F.lit(0.0))
             for w, g, a in zip(items(weights, width), items(gradient, width), items(anchor, width))]
    uniform = F.array(*[F.lit(1.0 / width)] * width)
    scaled = lambda a: bind(total(items(a, width)), lambda mass: F.when(mass > 0, F.transform(a, lambda m: m / mass)).otherwise(uniform))
    return bind(F.array(*moved), scaled)
