"""Longitudinal back-test of the tumour and fibrosis rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.fixed import DYNAMICS, LONGITUDINAL_COLUMNS, MAX_DIAMETER_CM
from cohortry.functions.vectors import clip
from cohortry.operators.resample import bootstrap_interval


def check_intervals(df: DataFrame) -> DataFrame:
    """Numeric interval columns after one counting pass over the contract."""
    missing = sorted(set(LONGITUDINAL_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"longitudinal table is missing columns: {missing}")
    numeric = [c for c in LONGITUDINAL_COLUMNS if c != "patient_id"]
    typed = df
    for c in numeric:
        typed = typed.withColumn(c, F.col(c).try_cast("double"))
    unreadable = F.lit(False)
    for c in numeric:
        unreadable = unreadable | (F.col(c).isNotNull() & F.col(c).try_cast("double").isNull())
    bad_text = df.agg(F.count_if(unreadable)).first()[0]
    row = typed.agg(F.count_if(~(F.col("end_month") > F.col("start_month"))).alias("order"),
                    F.count_if(~(F.col("tumor_diameter_start_cm") > 0)).alias("size"),
                    F.min("patient_id").alias("low"), F.max("patient_id").alias("high")).first()
    if bad_text:
        raise ValueError("longitudinal columns must be numeric")
    if row["low"] == row["high"]:
        raise ValueError("subject-level uncertainty needs at least two subjects")
    if row["order"]:
        raise ValueError("every interval needs end_month after start_month")
    if row["size"]:
        raise ValueError("diameters must be positive")
    return typed


def grown_diameter(limit: float = MAX_DIAMETER_CM) -> Column:
    d, dt = F.col("tumor_diameter_start_cm"), F.col("end_month") - F.col("start_month")
    grown = d * F.exp(F.col("growth_rate_per_month") * F.ln(F.lit(limit) / d) * dt)
    return clip(grown - F.col("treatment_shrinkage_rate_per_month") * d * dt, 0.0, limit)


def moved_fibrosis() -> Column:
    dt = F.col("end_month") - F.col("start_month")
    rate = (F.col("kappa_age_per_month") + F.col("kappa_treatment_per_month") * F.col("loco_regional_action")
            - F.col("kappa_recovery_per_month") * F.col("recovery_score"))
    return clip(F.col("fibrosis_start") + rate * dt, 0.0, 1.0)


def predict_intervals(df: DataFrame, variant: str = "full_dynamics") -> DataFrame:
    tumour, fibrosis = DYNAMICS[variant]
    out = df.withColumn("tumor_diameter_predicted_cm", grown_diameter() if tumour else F.col("tumor_diameter_start_cm"))
    out = out.withColumn("fibrosis_predicted", moved_fibrosis() if fibrosis else F.col("fibrosis_start"))
    return (out.withColumn("tumor_diameter_error_cm", F.col("tumor_diameter_predicted_cm") - F.col("tumor_diameter_observed_cm"))
            .withColumn("fibrosis_error", F.col("fibrosis_predicted") - F.col("fibrosis_observed")))


def predict_variants(df: DataFrame) -> DataFrame:
    """All four variants in one projection and an explode."""
    base = df.withColumn("_d", grown_diameter()).withColumn("_f", moved_fibrosis())
    cells = F.explode(F.array(*[F.struct(
        F.lit(name).alias("variant"),
        ((F.col("_d") if tumour else F.col("tumor_diameter_start_cm")) - F.col("tumor_diameter_observed_cm")).alias("tumor_diameter_error_cm"),
        ((F.col("_f") if fibrosis else F.col("fibrosis_start")) - F.col("fibrosis_observed")).alias("fibrosis_error"))
        for name, (tumour, fibrosis) in DYNAMICS.items()])).alias("v")
    return base.select(*df.columns, cells).select(*df.columns, "v.*")


def agreement(errors: DataFrame, keys=("variant",)) -> DataFrame:
    """Bias, mean absolute error and limits of agreement with the sample deviation."""
    e = F.col("tumor_diameter_error_cm")
    spread = F.lit(1.96) * F.stddev_samp(e)
    return errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_intervals"), F.avg(e).alias("tumor_bias_cm"), F.avg(F.abs(e)).alias("tumor_mae_cm"),
        (F.avg(e) - spread).alias("tumor_loa_low_cm"), (F.avg(e) + spread).alias("tumor_loa_high_cm"),
        F.avg("fibrosis_error").alias("fibrosis_bias"), F.avg(F.abs("fibrosis_error")).alias("fibrosis_mae"))


def subject_error_interval(errors: DataFrame, *, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Bootstrap interval of the mean of per-subject mean absolute tumour errors."""
    per_subject = errors.groupBy("patient_id").agg(F.avg(F.abs("tumor_diameter_error_cm")).alias("mae"))
    return bootstrap_interval(per_subject, "mae", unit="patient_id", replicates=replicates, seed=seed)
