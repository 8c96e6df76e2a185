"""Life tables and product-limit estimators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.fixed import CUTPOINTS
from cohortry.functions.vectors import col, total
from cohortry.operators.ordered import RANGE, accumulate, cut_ranges, enrich
from cohortry.session import durable


def life_table(df: DataFrame, *, time: str = "t", event: str = "event", keys=(), weight: str | Column | None = None,
               rows_per_range: int | None = None):
    """Per distinct time: leaving mass ``n``, ``deaths``, ``censored`` and mass ``at_risk``, as ranged rows.

    One pre-aggregated pass over the input; everything after works on distinct times.
    """
    w = F.lit(1).cast("bigint") if weight is None else col(weight)
    steps = df.groupBy(*keys, F.col(time).alias("t")).agg(
        F.sum(w).alias("n"),
        F.sum(F.when(F.col(event) == 1, w).otherwise(F.lit(0))).alias("deaths"),
        F.sum(F.when(F.col(event) == 0, w).otherwise(F.lit(0))).alias("censored"))
    ranged = cut_ranges(steps, keys, ["t"], rows_per_range=rows_per_range)
    return accumulate(ranged, {"at_risk": ("sum", F.col("n"))}, descending=True)


def product_limit(ranged, numerator: str, name: str, *, before: bool = False):
    """Running product of 1 - numerator/at_risk, through the time or up to just before it."""
    factor = F.when(F.col("at_risk") > 0, F.greatest(F.lit(1.0) - F.col(numerator) / F.col("at_risk"), F.lit(0.0)))
    return accumulate(ranged, {name: ("product", F.coalesce(factor, F.lit(1.0)))}, exclusive=before)


def kaplan_meier(df: DataFrame, *, time: str = "t", event: str = "event", keys=(), weight=None,
                 rows_per_range: int | None = None) -> DataFrame:
    """Survival curve: one row per distinct time (and key)."""
    ranged = life_table(df, time=time, event=event, keys=keys, weight=weight, rows_per_range=rows_per_range)
    return product_limit(ranged, "deaths", "survival").rows.drop(RANGE)


def censoring_curve(df: DataFrame, *, time: str = "t", event: str = "event", keys=(), weight=None,
                    rows_per_range: int | None = None) -> DataFrame:
    """Censoring survival at each distinct time: ``g_at`` includes censorings there, ``g_before`` does not."""
    ranged = life_table(df, time=time, event=event, keys=keys, weight=weight, rows_per_range=rows_per_range)
    ranged = product_limit(ranged, "censored", "g_at")
    ranged = product_limit(ranged, "censored", "g_before", before=True)
    return durable(ranged.rows.drop(RANGE))


def with_origin(curve: DataFrame, value: str = "g_at") -> DataFrame:
    """Curve preceded by the point (0, 1); a step observed at 0 replaces it."""
    origin = curve.sparkSession.range(1).select(F.lit(0.0).alias("t"), F.lit(1.0).alias(value))
    return curve.where(F.col("t") == 0).select("t", value).unionByName(
        origin.join(curve.where(F.col("t") == 0).select(F.lit(1).alias("_hit")).limit(1), how="left")
        .where(F.col("_hit").isNull()).select("t", value)).unionByName(curve.where(F.col("t") != 0).select("t", value))


def curve_at(curve: DataFrame, points, value: str = "g_at", *, before: bool = False, default: float = 1.0) -> list[float]:
    """Step values at a short list of times in one aggregate: no ordering of the curve is needed."""
    t = F.col("t")
    row = curve.agg(*[
        F.max_by(value, F.when((t < p) if before else (t <= p), t)).alias(f"v{i}") for i, p in enumerate(points)]).first()
    return [default if v is None else float(v) for v in row]


def censoring_at(rows: DataFrame, curve: DataFrame, *, time: str = "t", floor: float | None = None,
                 value: str = "g_at", alias: str | None = None) -> DataFrame:
    """Curve value at each row's own time (times of the rows must be times of the curve)."""
    name = alias or value
    table = curve.select(F.col("t").alias(time), F.col(value).alias(name), F.col("n").alias("_n"))
    joined = enrich(rows, table, time, size_column="_n").drop("_n")
    if floor is None:
        return joined
    return joined.withColumn(name, F.least(F.greatest(F.col(name), F.lit(floor)), F.lit(1.0)))


def risk_table(df: DataFrame, *, time: str = "t", event: str = "event", cutpoints=CUTPOINTS) -> DataFrame:
    """Risk set, events and censorings per interval, with an administrative tail row."""
    t, e = F.col(time), F.col(event)
    interval = total((t >= F.lit(c)).cast("int") for c in cutpoints)
    k = len(cutpoints)
    # one row per interval of arrival; a risk set is the suffix sum over at most k + 1 of them
    cells = df.groupBy(interval.alias("interval")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((e == 1).cast("bigint")).alias("d"), F.sum((e == 0).cast("bigint")).alias("c"))
    starts = [0.0, *cutpoints]
    frame = df.sparkSession.range(k + 1).select(F.col("id").cast("int").alias("interval"))
    start = F.element_at(F.array(*[F.lit(s) for s in starts]), F.col("interval") + 1)
    stop = F.when(F.col("interval") < k, F.try_element_at(F.array(*[F.lit(s) for s in cutpoints]), F.col("interval") + 1))
    pairs = frame.alias("f").join(F.broadcast(cells).alias("x"), F.col("x.interval") >= F.col("f.interval"), "left")
    here = F.col("x.interval") == F.col("f.interval")
    counted = pairs.groupBy(F.col("f.interval").alias("interval")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("risk_set"),
        F.coalesce(F.sum(F.when(here, F.col("d"))), F.lit(0)).alias("own_events"),
        F.coalesce(F.sum(F.when(here, F.col("c"))), F.lit(0)).alias("own_censored"))
    tail = F.col("interval") == k
    return counted.select(
        "interval", start.alias("start_month"), stop.alias("stop_month"), "risk_set",
        F.when(tail, F.lit(0)).otherwise(F.col("own_events")).cast("bigint").alias("events"),
        F.when(tail, F.col("risk_set")).otherwise(F.col("own_censored")).cast("bigint").alias("censored"),
        F.when(tail, F.col("risk_set")).alias("administrative_censoring_at_horizon"),
        F.when(tail, F.col("own_events")).alias("observed_events_after_horizon"))


def restricted_mean(df: DataFrame, *, tau: float, time: str = "t", event: str = "event", keys=(), weight=None,
                    rows_per_range: int | None = None) -> DataFrame:
    """Area under the (weighted) survival curve up to ``tau``, per key."""
    keys = list(keys)
    ranged = product_limit(
        life_table(df, time=time, event=event, keys=keys, weight=weight, rows_per_range=rows_per_range),
        "deaths", "survival")
    # A step of height drop at t <= tau removes drop * (tau - t) from the full rectangle.
    before = accumulate(ranged, {"_previous": ("last", F.col("survival"))}, exclusive=True)
    drop = F.coalesce(F.col("_previous"), F.lit(1.0)) - F.col("survival")
    lost = F.when(F.col("t") <= tau, drop * (F.lit(float(tau)) - F.col("t"))).otherwise(F.lit(0.0))
    return before.rows.groupBy(*keys).agg((F.lit(float(tau)) - F.sum(lost)).alias("rmst"), F.sum("n").alias("mass"))
