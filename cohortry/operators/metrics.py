"""Classification, calibration and decision metrics; each is one pass of partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.fixed import CUTPOINTS, N_CLASSES, RESIDUAL_MIX
from cohortry.functions import scores
from cohortry.functions.vectors import argmax_first, col, total
from cohortry.operators.concordance import concordance
from cohortry.operators.lifetable import censoring_curve, curve_at
from cohortry.operators.ordered import enrich


def top_k_accuracy(df: DataFrame, *, truth: str = "label", proba: str = "p", ks=(1, 2, 3), keys=()) -> DataFrame:
    rank = scores.truth_rank(proba, truth)
    return df.groupBy(*keys).agg(*[F.avg((rank <= k).cast("double")).alias(f"top{k}_accuracy") for k in ks])


def confusion(df: DataFrame, *, truth: str = "label", proba: str = "p", keys=()) -> DataFrame:
    return df.groupBy(*keys, F.col(truth).cast("int").alias("truth"), argmax_first(proba).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def f1_summary(matrix: DataFrame, keys=()) -> DataFrame:
    """Accuracy and averaged precision, recall and F1 from a confusion table (at most 64 rows per key)."""
    keys = list(keys)
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    sides = matrix.select(*keys, F.explode(F.array(
        F.struct(F.col("truth").alias("cls"), F.col("n").alias("true_n"), F.lit(0).cast("bigint").alias("pred_n"), hit.alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("true_n"), F.col("n").alias("pred_n"),
                 F.lit(0).cast("bigint").alias("tp")))).alias("s")).select(*keys, "s.*")
    per_class = sides.groupBy(*keys, "cls").agg(F.sum("true_n").alias("true_n"), F.sum("pred_n").alias("pred_n"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    precision, recall = ratio(F.col("tp"), F.col("pred_n")), ratio(F.col("tp"), F.col("true_n"))
    f1 = ratio(F.lit(2) * F.col("tp"), F.col("true_n") + F.col("pred_n"))
    return per_class.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("true_n")).alias("accuracy"), F.avg(f1).alias("macro_f1"),
        (F.sum(f1 * F.col("true_n")) / F.sum("true_n")).alias("weighted_f1"),
        F.avg(precision).alias("macro_precision"), F.avg(recall).alias("macro_recall"),
        F.sum("true_n").cast("bigint").alias("rows"))


def classification_report(df: DataFrame, *, truth: str = "label", proba: str = "p", time: str | None = "t",
                          event: str | None = "event", keys=()) -> DataFrame:
    """All classification metrics per key; concordance of the ordinal risk when times are given."""
    keys = list(keys)
    labelled = df.where(F.col(truth).isNotNull())
    pieces = [f1_summary(confusion(labelled, truth=truth, proba=proba, keys=keys), keys),
              top_k_accuracy(labelled, truth=truth, proba=proba, ks=(2, 3), keys=keys)]
    if time is not None and event is not None:
        # equal probabilities summed in another order differ in the last bits; twelve places keep them tied
        c = concordance(labelled, time=time, event=event, risk=F.round(scores.ordinal_risk(proba), 12), keys=keys)
        pieces.append(c.select(*keys, F.col("ipcw_c_index").alias("c_index"),
                               F.col("harrell_c_index").alias("harrell_c_index_unweighted")))
    out = pieces[0]
    for piece in pieces[1:]:
        # one row per key on both sides
        out = out.join(piece, keys) if keys else out.crossJoin(piece)
    return out


def brier(df: DataFrame, *, truth: str = "label", proba: str = "p", keys=()) -> DataFrame:
    """Mean squared error over rows and classes."""
    return df.groupBy(*keys).agg((F.avg(total(scores.square_errors(proba, truth))) / N_CLASSES).alias("brier"))


def ipcw_brier(df: DataFrame, *, truth: str = "label", proba: str = "p", time: str = "t", event: str = "event",
               cutpoints=CUTPOINTS, floor: float = 1e-3) -> DataFrame:
    """Censoring-weighted Brier score; the plain score where any used weight falls under the floor."""
    plain_row = total(scores.square_errors(proba, truth)) / N_CLASSES
    if len(cutpoints) != N_CLASSES - 1:
        return df.agg(F.avg(plain_row).alias("ipcw_brier"), F.lit(True).alias("fell_back"))
    curve = censoring_curve(df, time=time, event=event)
    bounds = [0.0, *cutpoints]
    g_bound = curve_at(curve, bounds)
    g_bound[0] = curve_at(curve, [0.0])[0]
    rows = enrich(df, curve.select(F.col("t").alias(time), F.col("g_at").alias("_g"), F.col("n").alias("_n")), time,
                  size_column="_n").drop("_n")
    t, errors = F.col(time), scores.square_errors(proba, truth)
    weighted, weight, lowest = [], [], []
    for c, bound in enumerate(bounds):
        include = (F.col(event) == 1) | (t >= F.lit(float(bound)))
        g = F.when(t < F.lit(float(bound)), F.col("_g")).otherwise(F.lit(g_bound[c])) if c else F.lit(g_bound[0])
        weighted.append(F.when(include, errors[c] / g).otherwise(F.lit(0.0)))
        weight.append(F.when(include, F.lit(1.0) / g).otherwise(F.lit(0.0)))
        lowest.append(F.when(include, g).otherwise(F.lit(1.0)))
    sums = rows.agg(F.sum(total(weighted)).alias("loss"), F.sum(total(weight)).alias("weight"),
                    F.min(F.least(*lowest)).alias("low"), F.avg(plain_row).alias("plain"))
    fallback = (F.col("low") < floor) | (F.col("weight") <= 0) | F.col("weight").isNull()
    return sums.select(F.when(fallback, F.col("plain")).otherwise(F.col("loss") / F.col("weight")).alias("ipcw_brier"),
                       fallback.alias("fell_back"))


def focal_loss(df: DataFrame, *, logits: str, truth: str = "label", reduction: str = "mean", **options) -> DataFrame:
    term = scores.focal(logits, truth, **options)
    if reduction == "none":
        return df.withColumn("focal", term)
    if reduction not in ("mean", "sum"):
        raise ValueError("reduction must be none, mean or sum")
    return df.agg((F.avg(term) if reduction == "mean" else F.sum(term)).alias("focal"))


def with_residual(df: DataFrame, *, truth: str = "label", proba: str = "p", mix: float = RESIDUAL_MIX,
                  check: bool = True) -> DataFrame:
    if check:
        faults = df.agg(F.sum(scores.residual_input_fault(proba, truth).cast("bigint"))).first()[0]
        if faults:
            raise ValueError(f"{faults} rows break the residual contract: class range, sign or unit sum")
    return df.withColumn("residual", scores.residual(proba, truth, mix=mix))


def selection_score(df: DataFrame, *, truth: str = "label", proba: str = "p", keys=(), penalty: float = 0.1) -> DataFrame:
    """Macro F1 less a share of the mean residual, per key."""
    keys = list(keys)
    f1 = f1_summary(confusion(df, truth=truth, proba=proba, keys=keys), keys).select(*keys, "macro_f1")
    res = df.groupBy(*keys).agg(F.avg(scores.residual(proba, truth)).alias("mean_residual"))
    both = f1.join(res, keys) if keys else f1.crossJoin(res)
    return both.withColumn("selection_score", F.col("macro_f1") - F.lit(penalty) * F.col("mean_residual"))


def net_benefit(df: DataFrame, *, outcome: str | Column, risk: str | Column, thresholds) -> DataFrame:
    """Decision curve: true and false positives at each threshold and their net benefit, in one pass."""
    thresholds = [float(x) for x in thresholds]
    if any(not 0 < x < 1 for x in thresholds):
        raise ValueError("thresholds must lie strictly between zero and one")
    y, r = col(outcome), col(risk)
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.sum((~y.isin(0, 1)).cast("int")).alias("bad"), *[
        F.sum(((r >= x) & (y == v)).cast("bigint")).alias(f"{n}{i}")
        for i, x in enumerate(thresholds) for n, v in (("tp", 1), ("fp", 0))])
    rows = F.explode(F.array(*[F.struct(
        F.lit(x).alias("threshold"), F.col(f"tp{i}").alias("true_positive"), F.col(f"fp{i}").alias("false_positive"),
        (F.col(f"tp{i}") / F.col("n") - F.col(f"fp{i}") / F.col("n") * F.lit(x / (1.0 - x))).alias("net_benefit"))
        for i, x in enumerate(thresholds)])).alias("r")
    guard = F.when(F.col("bad") > 0, F.raise_error(F.lit("outcome must be binary")).cast("double")).otherwise(F.lit(0.0))
    return sums.select(rows, guard.alias("_ok")).select(
        "r.threshold", "r.true_positive", "r.false_positive", (F.col("r.net_benefit") + F.col("_ok")).alias("net_benefit"))


