"""Cohort-shaped views over the given tables, the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.fixed import ARMS, N_CLASSES
from cohortry.functions.endpoint import immature, months_to_class
from cohortry.functions.hashing import hash_below, hash_uniform
from cohortry.functions.vectors import normalised
from cohortry.operators.ordered import next_values


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an index encounter, the customer's next order the event, the last order censored at the data end."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    count = orders.count()
    followed = next_values(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"next_date": F.col("o_orderdate")}, rows=count)
    last = orders.agg(F.max("o_orderdate").alias("last_date"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    rows = followed.crossJoin(F.broadcast(last)).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    days = F.datediff(F.coalesce("next_date", "last_date"), F.col("o_orderdate"))
    return rows.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("patient_id"), (days / F.lit(7.0)).alias("t"),
        F.col("next_date").isNotNull().cast("int").alias("event"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("arm"),
        (F.col("o_totalprice") / F.lit(100000.0)).alias("x1"), (F.col("c_acctbal") / F.lit(10000.0)).alias("x2"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort with the class by time (``cls``) and the usable label (null when immature)."""
    rows = cohort(spark, sf_dir).withColumn("cls", months_to_class("t"))
    return rows.withColumn("label", F.when(~immature("t", "event"), F.col("cls")))


def _bumps(a: float, b: float, salt: str) -> Column:
    z = F.lit(8.0) * (F.lit(a) * F.least(F.col("t"), F.lit(90.0)) / F.lit(90.0) + F.lit(b) * hash_uniform(salt, F.col("row_id")))
    return normalised([F.exp(-F.abs(F.lit(k + 0.5) - z)) for k in range(N_CLASSES)], flat=True)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled cohort with the probabilities of two models, ``p`` and ``q``."""
    return labelled(spark, sf_dir).withColumn("p", _bumps(0.6, 0.4, "p")).withColumn("q", _bumps(0.3, 0.7, "q"))


# name, kind, low, span: num = low + span*u; int = floor(low + span*u); bin = u < low
CLINICAL = [
    ("age", "num", 28, 64), ("sex_male", "bin", 0.8, 0), ("year_of_diagnosis", "int", 2004, 18), ("diabetes", "bin", 0.25, 0),
    ("comorbidity_count", "int", 0, 5), ("hbv_positive", "bin", 0.6, 0), ("hcv_positive", "bin", 0.2, 0), ("cirrhosis", "bin", 0.7, 0),
    ("alcohol_use", "bin", 0.3, 0), ("antiviral_therapy", "bin", 0.4, 0), ("afp", "num", 1, 900), ("albumin", "num", 2, 3),
    ("bilirubin", "num", 0.2, 4), ("inr", "num", 0.8, 1.5), ("platelet", "num", 40, 300), ("meld", "int", 6, 30),
    ("albi_grade", "int", 1, 3), ("child_pugh_b_or_c", "bin", 0.3, 0), ("alt", "num", 10, 200), ("ast", "num", 10, 250),
    ("creatinine", "num", 0.5, 2), ("sodium", "num", 125, 20), ("hemoglobin", "num", 8, 8), ("nlr", "num", 1, 9),
    ("tumor_size_cm", "num", 0.5, 14), ("lesion_count", "int", 1, 6), ("multifocal", "bin", 0.4, 0), ("vascular_invasion", "bin", 0.3, 0),
    ("extrahepatic_spread", "bin", 0.15, 0), ("ajcc_stage", "int", 1, 4), ("radiotherapy", "bin", 0.1, 0), ("chemotherapy", "bin", 0.2, 0),
    ("palliative_care", "bin", 0.1, 0), ("anticipated_margin_risk", "bin", 0.2, 0), ("transplant", "bin", 0.05, 0),
    ("ecog", "int", 0, 4), ("portal_hypertension", "bin", 0.35, 0), ("ascites", "bin", 0.25, 0), ("encephalopathy", "bin", 0.1, 0),
]
RACES = ["Asian", "White", "Black", "Other", "Unknown"]
BCLC = ["a", "B ", "C", "d"]
# legacy strategy and flag entries that agree with each arm
STRATEGY_OF_ARM = ["none", "resection", "none", "rfa", "no resection", "combo"]


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw clinical columns as hashes of the row id, a tenth of the cells missing; one narrow projection per row."""
    rows = cohort(spark, sf_dir).select("row_id", "patient_id", "t", "event")
    rid = F.col("row_id")
    columns = []
    for name, kind, low, span in CLINICAL:
        u = hash_uniform(name, rid)
        value = (F.lit(float(low)) + F.lit(float(span)) * u) if kind == "num" else \
            F.floor(F.lit(float(low)) + F.lit(float(span)) * u).cast("double") if kind == "int" else hash_below(low, name, rid).cast("double")
        columns.append(F.when(~hash_below(0.1, f"na_{name}", rid), value).alias(name))
    pick = lambda values, u: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))
    action = F.floor(hash_uniform("action", rid) * 6).cast("int")
    rows = rows.select("*", *columns, F.when(~hash_below(0.1, "na_race", rid), pick(RACES, hash_uniform("race", rid))).alias("race"),
                       F.when(~hash_below(0.1, "na_bclc", rid), pick(BCLC, hash_uniform("bclc", rid))).alias("bclc_stage"), action.alias("_action"))
    named = F.element_at(F.array(*[F.lit(a) for a in ARMS]), F.col("_action") + 1)
    rows = rows.withColumn("index_treatment_action", F.when(rid % 2 == 1, F.concat(F.lit(" "), F.upper(named))).otherwise(named))
    strategy = F.element_at(F.array(*[F.lit(s) for s in STRATEGY_OF_ARM]), F.col("_action") + 1)
    rows = rows.withColumn("surgical_strategy", F.when(~hash_below(0.2, "na_strategy", rid), strategy).otherwise(F.lit("unknown")))
    flags = {"treatment_resection": 1, "treatment_tace": 2, "treatment_rfa": 3, "treatment_sorafenib": 4, "treatment_combo": 5}
    for name, arm in flags.items():
        rows = rows.withColumn(name, F.when(~hash_below(0.1, f"na_{name}", rid), (F.col("_action") == arm).cast("double")))
    return rows.drop("_action")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with attributions: each coordinate times a uniform of the vector and coordinate."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    return rows.withColumn("attr", F.array(*[F.col("x")[i] * hash_uniform(f"attr{i}", F.col("vec_id")) for i in range(64)]))


def monitor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") / F.lit(250.0)).alias("residual"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of a user as longitudinal intervals in the fourteen contract columns."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    count = events.count()
    pairs = next_values(events, ["user_id"], ["ts", "event_id"], {"next_ts": F.col("ts"), "next_value": F.col("value")}, rows=count)
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)
    dt = (seconds("next_ts") - seconds("ts")) / F.lit(86400.0)
    rid = F.col("event_id")
    u = lambda name: hash_uniform(name, rid)
    diameter = lambda c: F.least(F.lit(0.5) + F.col(c) / F.lit(25.0), F.lit(19.9))
    fibrosis = lambda c: F.least(F.col(c) / F.lit(400.0), F.lit(1.0))
    return pairs.where(F.col("next_ts").isNotNull()).withColumn("dt", dt).where(F.col("dt") > 0).select(
        rid, F.col("user_id").alias("patient_id"), F.lit(0.0).alias("start_month"), F.col("dt").alias("end_month"),
        diameter("value").alias("tumor_diameter_start_cm"), diameter("next_value").alias("tumor_diameter_observed_cm"),
        (F.lit(0.05) * u("g")).alias("growth_rate_per_month"), (F.lit(0.02) * u("s")).alias("treatment_shrinkage_rate_per_month"),
        fibrosis("value").alias("fibrosis_start"), fibrosis("next_value").alias("fibrosis_observed"),
        (F.lit(0.01) * u("ka")).alias("kappa_age_per_month"), (F.lit(0.01) * u("kt")).alias("kappa_treatment_per_month"),
        (F.lit(0.01) * u("kr")).alias("kappa_recovery_per_month"), u("rec").alias("recovery_score"),
        (u("act") < F.lit(0.5)).cast("int").alias("loco_regional_action"))


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as log entries: one chain per conversation, payload = role and digest of role and text."""
    return as_log(table(spark, sf_dir, "conversations"))


def as_log(rows: DataFrame) -> DataFrame:
    digest = F.sha2(F.concat_ws("|", "role", "text"), 256)
    return rows.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("chain_id"), F.col("turn").alias("seq"), F.col("turn").alias("ts"),
                       F.struct(digest.alias("digest"), F.col("role").alias("role")).alias("payload"))


def fixed_propensity(arms: int = 5) -> Column:
    """A known softmax propensity over the arms, so contrasts can be checked against SQL."""
    return normalised([F.exp(F.lit(0.1 * k) * F.col("x1") - F.lit(0.05 * k) * F.col("x2")) for k in range(arms)], flat=True)


def fixed_outcome(arms: int = 5) -> Column:
    return F.array(*[F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(-1.0 + 0.2 * k) + F.lit(0.3) * F.col("x1")))) for k in range(arms)])
