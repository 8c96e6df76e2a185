"""Paired comparisons of models."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions import tails
from cohortry.functions.vectors import argmax_first
from cohortry.operators.concordance import concordance
from cohortry.operators.replicates import paired_replicates
from cohortry.session import durable


@F.pandas_udf(T.DoubleType())
def _t_tail(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([tails.t_two_sided(abs(s), d) for s, d in zip(statistic, df)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _sign_tail(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([tails.sign_test_two_sided(int(x), int(y)) for x, y in zip(a, b)], dtype=float)


def corrected_t_test(folds: DataFrame, *, test_fraction: float, by=("metric",), variant: str = "variant", value: str = "value",
                     on=("seed", "fold")) -> DataFrame:
    """Corrected resampled t-test for every metric and ordered pair of variants of a fold-metric table."""
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must lie in (0, 1)")
    keys = [*by, *on]
    a = folds.select(*keys, F.col(variant).alias("variant_a"), F.col(value).alias("_a"))
    b = folds.select(*keys, F.col(variant).alias("variant_b"), F.col(value).alias("_b"))
    paired = a.join(b, keys).where(F.col("variant_a") < F.col("variant_b"))
    d = F.col("_a") - F.col("_b")
    sums = paired.groupBy(*by, "variant_a", "variant_b").agg(
        F.avg(d).alias("mean_difference"), F.var_samp(d).alias("_var"), F.count(F.lit(1)).alias("runs"))
    factor = F.lit(1.0) / F.col("runs") + F.lit(test_fraction / (1.0 - test_fraction))
    error = F.sqrt(F.greatest(factor * F.col("_var"), F.lit(0.0)))
    sign = F.when(F.col("mean_difference") < 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    stat = F.when(F.col("standard_error") > 0, F.col("mean_difference") / F.col("standard_error")).otherwise(sign)
    return (sums.where(F.col("runs") >= 2).withColumn("correction_factor", factor).withColumn("standard_error", error)
            .withColumn("t_statistic", stat).withColumn("degrees_of_freedom", F.col("runs") - 1).drop("_var")
            .withColumn("p_value_two_sided", _t_tail("t_statistic", F.col("degrees_of_freedom").cast("double"))))


def discordance_test(df: DataFrame, *, truth: str = "label", a: str | Column = "pred_a", b: str | Column = "pred_b", keys=()) -> DataFrame:
    """Exact test on the rows where exactly one of two predictions is right, per key."""
    right = lambda c: (F.col(c) if isinstance(c, str) else c) == F.col(truth)
    sums = df.groupBy(*keys).agg(F.count_if(right(a) & ~right(b)).alias("a_correct_b_wrong"),
                                 F.count_if(~right(a) & right(b)).alias("a_wrong_b_correct"))
    return sums.withColumn("discordant", F.col("a_correct_b_wrong") + F.col("a_wrong_b_correct")).withColumn(
        "p_value_two_sided_exact", _sign_tail("a_correct_b_wrong", "a_wrong_b_correct"))


def paired_concordance_test(df: DataFrame, *, unit: str = "row_id", time: str = "t", event: str = "event", model_risk: str,
                            comparator_risk: str, replicates: int = 1000, seed: int = 42,
                            rows_per_range: int | None = None) -> DataFrame:
    """Difference of two weighted concordance indices with a bootstrap standard error, as one row."""
    n = df.count()
    if n < 3 or replicates < 2:
        raise ValueError("at least three rows and two replicates are required")
    sides = F.explode(F.array(F.struct(F.lit("model").alias("side"), F.col(model_risk).cast("double").alias("risk")),
                              F.struct(F.lit("comparator").alias("side"), F.col(comparator_risk).cast("double").alias("risk")))).alias("s")
    slim = df.select(unit, F.col(time).alias("t"), F.col(event).alias("event"), model_risk, comparator_risk)
    whole = concordance(slim.select("t", "event", sides).select("t", "event", "s.*"), keys=["side"], rows_per_range=rows_per_range)
    point = {r["side"]: r["ipcw_c_index"] for r in whole.collect()}
    drawn = paired_replicates(slim, unit=unit, time="t", event="event", risks=[model_risk, comparator_risk], replicates=replicates, seed=seed, limit=rows_per_range)
    diffs = durable(drawn.select("rep", (F.col("c0") - F.col("c1")).alias("d")))
    error, valid = diffs.agg(F.stddev_samp("d"), F.count("d")).first()
    if valid < 2:
        raise ValueError("bootstrap draws contain too few comparable event pairs")
    difference = float(point["model"] - point["comparator"])
    z = difference / error if error > 0 else math.copysign(math.inf, difference)
    return df.sparkSession.createDataFrame(
        [(float(point["model"]), float(point["comparator"]), difference, float(error), z, tails.normal_two_sided(z), replicates, int(valid))],
        "model_ipcw_c_index double, comparator_ipcw_c_index double, difference double, standard_error double, z_statistic double, "
        "p_value_two_sided double, replicates_requested int, replicates_valid int")
