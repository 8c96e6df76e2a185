"""Post-hoc attribution diagnostics."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.fixed import LAMBDA_CAL, LAMBDA_CLIN, LAMBDA_EXP, RISK_FEATURES, TANH_KAPPA
from cohortry.functions.hashing import hash_uniform
from cohortry.functions.tails import t_two_sided
from cohortry.functions.vectors import argmax_first, entry, total
from cohortry.operators.metrics import brier, ipcw_brier
from cohortry.operators.ordered import ROWS_PER_RANGE, row_numbers
from cohortry.session import durable

#: rows of all trials that a task takes
TASK_ROWS = 500_000


def permutation_attributions(df: DataFrame, features, score: Callable[[Callable[[str], Column]], Column], *, row_id: str = "row_id",
                             repeats: int = 5, seed: int = 42, rows_per_range: int | None = None) -> DataFrame:
    """Mean drop of the predicted-class probability when one feature is shuffled.

    ``score`` maps a column accessor to the probability array.  A shuffle pairs each row with the row whose place in a
    hash order equals its own place in the id order.  A row isn't repeated per trial (feature, repeat): what travels is a row's place and
    value, once to the bucket of its hash, where it gets its place in the trial's order, and once to the row of that place.
    """
    features = list(features)
    trials = [(f, r) for f in features for r in range(repeats)]
    held = df.select(row_id, *features, score(F.col).alias("_p")).withColumn("_class", argmax_first("_p"))
    held = held.withColumn("_base", entry("_p", F.col("_class"))).drop("_p")
    placed = durable(row_numbers(held, [], [row_id], "_place", rows_per_range=rows_per_range))
    n = placed.count()
    # hashes are uniform, so buckets of equal width are ranges of about equal size
    buckets = max(1, -(-n // (rows_per_range or ROWS_PER_RANGE)))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n * len(trials) // TASK_ROWS))
    drawn = F.explode(F.array(*[F.struct(F.lit(i).alias("_trial"), hash_uniform("perm", seed, f, r, F.col(row_id)).alias("_u"), F.col(f).cast("double").alias("_swap"))
                                for i, (f, r) in enumerate(trials)])).alias("_t")
    donors = placed.select(F.col("_place").alias("_own"), drawn).select("_own", "_t.*").withColumn("_bucket", F.floor(F.col("_u") * buckets).cast("int"))
    sizes = donors.groupBy("_trial", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    lower = Window.partitionBy("_trial").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = durable(sizes.select("_trial", "_bucket", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before")))
    # places order rows with one hash as their ids do
    within = Window.partitionBy("_trial", "_bucket").orderBy("_u", "_own")
    ranked = donors.repartition(max(tasks, buckets * len(trials)), "_trial", "_bucket").withColumn("_rank", F.row_number().over(within))
    ranked = ranked.join(F.broadcast(before), ["_trial", "_bucket"]).select((F.col("_before") + F.col("_rank")).alias("_place"), "_trial", "_swap")
    swaps = ranked.repartition(tasks, "_place").groupBy("_place").agg(*[F.max(F.when(F.col("_trial") == i, F.col("_swap"))).alias(f"_s{i}") for i in range(len(trials))])
    of_feature = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"_s{k * repeats + r}").alias(f"_swap{r}") for r in range(repeats)])
                                     for k, f in enumerate(features)])).alias("_t")
    swapped = placed.repartition(tasks, "_place").join(swaps, "_place").select(row_id, *features, "_class", "_base", of_feature).select("*", "_t.*").drop("_t")
    drops = [F.col("_base") - entry(score(lambda name: F.when(F.col("feature") == name, F.col(f"_swap{r}")).otherwise(F.col(name))), F.col("_class"))
             for r in range(repeats)]
    told = swapped.select(row_id, "feature", *[d.alias(f"_d{r}") for r, d in enumerate(drops)]).select(
        row_id, "feature", total(F.coalesce(F.col(f"_d{r}"), F.lit(0.0)) for r in range(repeats)).alias("_sum"),
        total(F.col(f"_d{r}").isNotNull().cast("int") for r in range(repeats)).alias("_n"))
    return told.groupBy(row_id, "feature").agg((F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("attribution"))


def _mean_abs(df: DataFrame, attributions: str, width: int) -> DataFrame:
    row = F.array(*[F.avg(F.abs(F.col(attributions)[i])) for i in range(width)])
    return df.agg(row.alias("m")).select(F.posexplode("m").alias("feature", "importance"))


def attribution_alignment(df: DataFrame, beta, *, attributions: str = "attr", true_ranks: bool = False) -> dict:
    """Spearman correlation of the two argsort index vectors, or of the ranks when ``true_ranks``.

    The second stage has one row per feature.
    """
    width = len(beta)
    strengths = F.array(*[F.lit(abs(float(b))) for b in beta])
    table = _mean_abs(df, attributions, width).withColumn("strength", strengths[F.col("feature")])
    whole = Window.partitionBy(F.lit(0))
    ranked = table.select("feature", *[F.row_number().over(whole.orderBy(c, "feature")).alias(f"{c}_place") for c in ("importance", "strength")])
    if true_ranks:
        pairs = ranked.select(F.col("importance_place").alias("x"), F.col("strength_place").alias("y"))
    else:
        left = ranked.select(F.col("importance_place").alias("place"), F.col("feature").alias("x"))
        right = ranked.select(F.col("strength_place").alias("place"), F.col("feature").alias("y"))
        pairs = left.join(right, "place")
    rho = pairs.agg(F.corr("x", "y")).first()[0]
    if rho is None or math.isnan(rho):
        return {"spearman_rho": float("nan"), "spearman_p": float("nan")}
    rho = max(-1.0, min(1.0, rho))
    stat = math.inf if abs(rho) >= 1 else rho * math.sqrt((width - 2) / ((1 - rho) * (1 + rho)))
    return {"spearman_rho": rho, "spearman_p": t_two_sided(stat, width - 2)}


def consistency_loss(df: DataFrame, beta, *, attributions: str = "attr", x: str = "x", kappa: float = TANH_KAPPA) -> DataFrame:
    """Mean gap between the squashed attribution and the squashed linear effect over all cells."""
    k = F.lit(float(kappa))
    cells = [F.abs(F.tanh(k * F.col(attributions)[i]) - F.tanh(k * F.col(x)[i] * F.lit(float(b)))) for i, b in enumerate(beta)]
    return df.agg((F.avg(total(cells)) / len(beta)).alias("consistency_loss"))


def rule_violation_loss(df: DataFrame, names, *, attributions: str = "attr") -> DataFrame:
    """Mean negative part of the global mean attribution over the known risk features."""
    penalties = [F.greatest(F.lit(0.0), -F.avg(F.col(attributions)[i])) for i, n in enumerate(names) if n in RISK_FEATURES]
    if not penalties:
        return df.sparkSession.range(1).select(F.lit(0.0).alias("rule_violation_loss"))
    return df.agg((total(penalties) / len(penalties)).alias("rule_violation_loss"))


def explanation_report(df: DataFrame, beta, names, *, truth: str = "label", proba: str = "p", attributions: str = "attr",
                       x: str = "x", time: str | None = None, event: str | None = None, lambda_cal: float = LAMBDA_CAL,
                       lambda_exp: float = LAMBDA_EXP, lambda_clin: float = LAMBDA_CLIN, kappa: float = TANH_KAPPA) -> DataFrame:
    """Prediction, calibration, consistency and rule terms with their weighted total, as one row."""
    own = F.least(F.greatest(entry(proba, F.col(truth)), F.lit(1e-12)), F.lit(1.0))
    pred = df.agg((-F.avg(F.ln(own))).alias("loss_pred"))
    if time is not None and event is not None:
        cal = ipcw_brier(df, truth=truth, proba=proba, time=time, event=event).select(F.col("ipcw_brier").alias("loss_cal"))
    else:
        cal = brier(df, truth=truth, proba=proba).select(F.col("brier").alias("loss_cal"))
    exp = consistency_loss(df, beta, attributions=attributions, x=x, kappa=kappa).toDF("loss_exp")
    clin = rule_violation_loss(df, names, attributions=attributions).toDF("loss_clin")
    # four one-row tables
    return pred.crossJoin(cal).crossJoin(exp).crossJoin(clin).withColumn(
        "loss_total", F.col("loss_pred") + F.lit(lambda_cal) * F.col("loss_cal") + F.lit(lambda_exp) * F.col("loss_exp")
        + F.lit(lambda_clin) * F.col("loss_clin"))
