"""Whole analyses composed from the operators."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.fixed import ARTIFACT_STATUS, ARTIFACT_VERSION, AUDIT_SECTIONS, CUTPOINTS, HORIZON, N_CLASSES, SEEDS, STATE_WIDTH, TREATMENT_COORDS
from cohortry.functions.endpoint import immature, months_to_class
from cohortry.functions.vectors import total
from cohortry.operators import contrasts, cox, features, fusion, learners, longitudinal, metrics, moments, networks, paired, person_period, resample, scenarios
from cohortry.operators.lifetable import censoring_curve
from cohortry.operators.resample import repeated_splits
from cohortry.plans import paths, views
from cohortry.session import checkpoint_dir, durable
from cohortry.sources import artifacts, sinks
from cohortry.sources.cohort import validate_cohort
from cohortry.streaming import chain, monitor


# discrete-time hazard model

@dataclass
class DiscreteModel:
    """Pooled logistic hazards: an offset and slopes per interval on standardised features."""

    names: list[str]
    mean: list[float]
    scale: list[float]
    offsets: list[float]
    slopes: list[list[float]]
    curve: DataFrame

    def logits(self) -> Column:
        x = [(F.col(n) - F.lit(m)) / F.lit(s) for n, m, s in zip(self.names, self.mean, self.scale)]
        return F.array(*[F.lit(a) + total(v * F.lit(b) for v, b in zip(x, slope)) for a, slope in zip(self.offsets, self.slopes)])

    def hazards(self) -> Column:
        return F.transform(self.logits(), lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        return df.withColumn("_z", self.logits()).withColumn(out, person_period.hazards_to_probabilities("_z")).drop("_z")


def fit_discrete(train: DataFrame, names, *, time: str = "t", event: str = "event", cutpoints=CUTPOINTS, interactions: bool = True) -> DiscreteModel:
    """Weighted person-period likelihood as one pooled logistic regression over the observed cells."""
    names, k = list(names), len(cutpoints)
    mean, scale = moments.scale_stats(train, names)
    x = [(F.col(n) - F.lit(m)) / F.lit(s) for n, m, s in zip(names, mean, scale)]
    curve = censoring_curve(train, time=time, event=event)
    rows = person_period.with_cell_weights(person_period.with_targets(train.withColumn("_x", F.array(*x)), time=time, event=event, cutpoints=cutpoints), curve, time=time, cutpoints=cutpoints)
    observed = [F.when(F.col("in_lik")[i] == 1, F.col("cell_weight")[i]).otherwise(F.lit(0.0)) for i in range(k)]
    offsets, slopes = person_period.fit_pooled(rows.select("_x", "event_interval", F.array(*observed).alias("_w")), "_x", "_w", inputs=len(names), intervals=k, interactions=interactions)
    return DiscreteModel(names, mean, scale, offsets, slopes, curve)


@dataclass
class DiscreteNetwork:
    """Hazards of a trained network on standardised features."""

    names: list[str]
    mean: list[float]
    scale: list[float]
    trained: networks.Trained
    curve: DataFrame

    def logits(self) -> Column:
        return self.trained.outputs(F.array(*[(F.col(n) - F.lit(m)) / F.lit(s) for n, m, s in zip(self.names, self.mean, self.scale)]), "hazard")

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        return df.withColumn("_z", self.logits()).withColumn(out, person_period.hazards_to_probabilities("_z")).drop("_z")


def fit_discrete_network(train: DataFrame, valid: DataFrame, names, *, time: str = "t", event: str = "event", cutpoints=CUTPOINTS, hidden=(256, 128, 64),
                         epochs: int = 100, patience: int = 15, rate: float = 1e-2, seed: int = 42) -> DiscreteNetwork:
    """Discrete-time network on the weighted person-period likelihood; early stopping on the validation rows, weighted by the training curve."""
    names = list(names)
    mean, scale = moments.scale_stats(train, names)
    x = F.array(*[(F.col(n) - F.lit(m)) / F.lit(s) for n, m, s in zip(names, mean, scale)])
    curve = censoring_curve(train, time=time, event=event)

    def cells(df: DataFrame, same_rows: bool) -> DataFrame:
        rows = person_period.with_targets(df.withColumn("_x", x), time=time, event=event, cutpoints=cutpoints)
        return person_period.with_cell_weights(rows, curve, time=time, cutpoints=cutpoints, same_rows=same_rows)

    trained = networks.fit_hazard_network(cells(train, True), cells(valid, False), "_x", inputs=len(names), hidden=hidden, intervals=len(cutpoints),
                                          epochs=epochs, patience=patience, rate=rate, seed=seed)
    return DiscreteNetwork(names, mean, scale, trained, curve)


def evaluate_discrete(model: DiscreteModel | DiscreteNetwork, df: DataFrame, *, time: str = "t", event: str = "event", label: str = "label", cutpoints=CUTPOINTS) -> DataFrame:
    """Likelihood with the training weights, weight range, maturity counts and class metrics, as one row."""
    scored = durable(model.score(df).withColumn("_z", model.logits()))
    targets = person_period.with_cell_weights(person_period.with_targets(scored, time=time, event=event, cutpoints=cutpoints), model.curve, time=time, cutpoints=cutpoints, same_rows=False)
    targets = durable(targets)
    nll = person_period.discrete_nll(targets, "_z", weights="cell_weight").toDF("discrete_time_nll")
    positive = F.filter("cell_weight", lambda w: w > 0)
    counts = targets.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(immature(time, event)).alias("n_immature_censored"),
                         F.count_if(F.col(label).isNotNull()).alias("n_hard_label_auditable"), F.count_if(F.col(label).isNull()).alias("n_hard_label_excluded"),
                         F.min(F.array_min(positive)).alias("ipcw_weight_min"), F.max(F.array_max(positive)).alias("ipcw_weight_max"))
    return nll.crossJoin(counts).crossJoin(metrics.classification_report(scored, truth=label, time=time, event=event))


# candidate search

def search_summary(scored: DataFrame) -> DataFrame:
    """Mean scores per candidate over the folds; the best keeps the earliest on ties."""
    means = scored.groupBy("candidate").agg(F.avg("selection_score").alias("selection_score"), F.avg("macro_f1").alias("macro_f1"), F.avg("mean_residual").alias("phase_p_residual"))
    best = means.agg(F.min_by("candidate", F.struct(-F.col("selection_score"), F.col("candidate"))).alias("_best"))
    return means.crossJoin(F.broadcast(best)).withColumn("best", F.col("candidate") == F.col("_best")).drop("_best")


def inner_search(df: DataFrame, candidates: list[dict], *, columns=None, folds: int = 4, seed: int = 42, limit: int | None = None, label: str = "label") -> tuple[dict, DataFrame]:
    """Score any list of setting overrides on stratified inner folds."""
    dealt = durable(resample.stratified_folds(df.where(F.col(label).isNotNull()), seed=seed, folds=folds, stratum=label))
    tables = []
    for i, override in enumerate(candidates[:limit]):
        for f in range(folds):
            settings = replace(paths.FULL, **{"seed": seed + f, **override})
            val = dealt.where(F.col("fold") == f)
            path = paths.fit_path(dealt.where(F.col("fold") != f), val, settings, columns=columns, label=label)
            scored = path.score(val, keep=("row_id", label))
            weight = 0.1 if settings.monitor and settings.residual_selection else 0.0
            tables.append(durable(metrics.selection_score(scored, truth=label, penalty=weight).withColumn("candidate", F.lit(i)).withColumn("fold", F.lit(f))))
    summary = durable(search_summary(reduce(DataFrame.unionByName, tables)))
    return candidates[summary.where("best").first()["candidate"]], summary


# repeated cross-validation

def repeated_validation(df: DataFrame, columns=None, *, seeds=SEEDS, folds: int = 5, variants=("full",), overrides: dict | None = None,
                        output: str | None = None, time: str = "t", event: str = "event", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Fit and score every (variant, seed, fold); predictions and long metrics, written when ``output`` is given.

    The models are those of the variant's settings; ``overrides`` replaces single settings by name.

    Fits run one after another from the driver, each as a distributed job; splits are joined by row id.
    """
    paths.check_variants(variants)
    splits = durable(repeated_splits(df, seeds=seeds, folds=folds, strata=(label, event)))
    joined = durable(df.join(splits, "row_id"))
    predictions, results = [], []
    for variant in variants:
        base = paths.VARIANTS[variant]
        settings = replace(base, **{k: v for k, v in (overrides or {}).items() if k != "learners" or base.learners})
        for seed in seeds:
            for fold in range(folds):
                run = joined.where((F.col("seed") == seed) & (F.col("fold") == fold))
                parts = {r: run.where(F.col("role") == r).drop("seed", "fold", "role") for r in ("train", "val", "test")}
                keep = [c for c in ("row_id", "patient_id", time, event, label) if c in df.columns]
                if settings.cox_only:
                    scored, extra = score_cox(parts["train"], parts["test"], columns, keep, time=time, event=event), {}
                else:
                    path = paths.fit_path(parts["train"], parts["val"], replace(settings, seed=seed), columns=columns, time=time, event=event, label=label)
                    scored, extra = path.score(parts["test"], keep=keep), path.diagnostics
                stamp = [F.lit(variant).alias("variant"), F.lit(seed).alias("seed"), F.lit(fold).alias("fold")]
                scored = durable(scored.select("*", *stamp))
                predictions.append(scored)
                report = metrics.classification_report(scored, truth=label, time=time, event=event)
                wide = report.select(*stamp, *[F.col(c).alias(f"test_{c}") for c in report.columns])
                if "validation_residual" in extra:
                    wide = wide.withColumn("validation_residual", F.lit(extra["validation_residual"]))
                results.append(durable(sinks.long_metrics(wide)))
    table = reduce(DataFrame.unionByName, predictions)
    long = reduce(DataFrame.unionByName, results)
    if output:
        sinks.write_predictions(sinks.prediction_table(table, truth=label, event=event, time=time, extra=("variant",)), f"{output}/predictions", whole=True)
        sinks.write_metrics(long, f"{output}/metrics")
        sinks.write_metrics(sinks.metric_summary(long, keys=("variant",)), f"{output}/metrics_summary")
    return table, long


def evaluate_split(scored: DataFrame, splits: DataFrame, *, seed: int, fold: int, role: str = "test", label: str = "label") -> DataFrame:
    chosen = splits.where((F.col("seed") == seed) & (F.col("fold") == fold) & (F.col("role") == role)).select("row_id")
    return metrics.classification_report(durable(scored.join(chosen, "row_id", "left_semi")), truth=label)


# locked external validation

def assert_disjoint(anchor: DataFrame, evaluation: DataFrame, unit: str = "patient_id") -> None:
    shared = anchor.select(F.col(unit).cast("string").alias("u")).distinct().join(evaluation.select(F.col(unit).cast("string").alias("u")), "u", "left_semi").limit(5).collect()
    if shared:
        raise ValueError(f"anchor and evaluation subjects overlap: {sorted(r['u'] for r in shared)}")


def locked_run(path: paths.FittedPath, manifest: dict, external: DataFrame, *, trusted: bool, time: str = "t", event: str = "event", label: str = "label",
               row_id: str = "row_id", anchor: DataFrame | None = None) -> DataFrame:
    """Score a frozen path on an external cohort and report strict (and optionally anchored) metrics.

    Digests are verified before scoring and again after; probabilities are made durable from a frame without outcomes
    before any outcome is read.
    """
    if not trusted:
        raise ValueError("a serialised model is code: pass trusted=True after checking its origin")
    before = artifacts.verify_freeze(manifest, path.contracts(), path.digest())
    probabilities = durable(path.score(features.inference_frame(external, time=time, event=event, label=label), keep=(row_id,)))
    supplied = external.withColumn("_label", F.col(label) if label in external.columns else months_to_class(time))
    mature = ~immature(time, event, HORIZON)
    ends = supplied.select(row_id, *(["patient_id"] if "patient_id" in external.columns else []), F.col(time).alias("t"), F.col(event).alias("event"),
                           F.when(mature, F.col("_label")).alias("label"))
    joined = durable(ends.join(probabilities, row_id))

    def report(rows: DataFrame, mode: str) -> DataFrame:
        counts = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count("label").alias("n_hard_endpoint_rows"), F.count_if(F.col("label").isNull()).alias("n_immature_excluded"))
        strict = mode == "strict_locked"
        return metrics.classification_report(rows).crossJoin(counts).withColumn("evaluation_mode", F.lit(mode)).withColumn(
            "strict_locked_result", F.lit(strict)).withColumn("target_label_fit_performed", F.lit(not strict))

    out = report(joined, "strict_locked")
    if anchor is not None:
        assert_disjoint(anchor, external)
        scored_anchor = path.score(features.inference_frame(anchor, time=time, event=event, label=label), keep=(row_id,)).join(anchor.select(row_id, label), row_id)
        platt, _ = fusion.fit_anchor_platt(durable(scored_anchor), "p", label)
        out = out.unionByName(report(joined.withColumn("p", platt.proba("p")), "anchor_recalibrated"))
    after = artifacts.verify_freeze(manifest, path.contracts(), path.digest())
    if before != after:
        raise ValueError("the frozen model changed during the run")
    return out


def locked_validation(rows: DataFrame, settings: paths.Settings = paths.FULL) -> DataFrame:
    """Internal folds fit and freeze a path; the last fold, without two features, is the external cohort."""
    dealt = durable(resample.grouped_folds(rows.withColumn("label", F.when(~immature("t", "event"), months_to_class("t"))), seed=42))
    path = paths.fit_path(dealt.where("fold < 3").drop("fold"), dealt.where("fold = 3").drop("fold"), settings)
    manifest = artifacts.freeze_manifest(path.contracts(), path.digest())
    external = dealt.where("fold = 4").drop("fold", "afp", "child_pugh_b_or_c")
    return locked_run(path, manifest, external, trusted=True)


# scenario report

def fit_scenarios(path: paths.FittedPath, train: DataFrame, *, row_id: str = "row_id") -> tuple[scenarios.Sweep, learners.LinearModel]:
    """Templates per arm and arm propensities from the coordinates before treatment, on the training rows' states."""
    if path.representation.width != STATE_WIDTH:
        raise ValueError("scenarios need a path on the state")
    states = durable(path.representation.apply(features.observed_actions(train), [row_id, "arm"]))
    before = states.withColumn("_before", F.slice("x", 1, TREATMENT_COORDS.start))
    return scenarios.fit_sweep(states, state="x"), learners.fit_propensity(before, "_before", "arm")


def scenario_report(path: paths.FittedPath, df: DataFrame, sweep: scenarios.Sweep, propensity: learners.LinearModel, *, draws: DataFrame | None = None,
                    guidelines: DataFrame | None = None, clinical_only: bool = True, row_id: str = "row_id") -> DataFrame:
    """Ranked scenarios of every subject from a fitted path: each arm's forced state goes through base models, fusion and calibration.

    The recorded action is the factual arm and is never inferred; the phenotype is that of the unchanged state.  ``draws`` (row_id, arm, array)
    gives intervals, ``guidelines`` confidences; without them the clinical view, which asks for both, is empty.
    """
    states = path.representation.apply(features.observed_actions(df), [row_id, "arm"]).withColumnRenamed("arm", "factual")
    if path.phenotypes is not None:
        states = path.phenotypes.assign(states, "_cluster")
    before = [F.col("x")[i] for i in range(TREATMENT_COORDS.start)]
    states = durable(states.withColumn("propensity", propensity.proba(before)))
    keep = [c for c in (row_id, "factual", "propensity", "_cluster") if c in states.columns]
    scored = path.score_states(scenarios.arm_states(states, sweep, state="x", keep=keep))
    rows = scenarios.scored_scenarios(scored, sweep, row_id=row_id)
    limits = None if draws is None else scenarios.array_intervals(draws, states.select(row_id, "factual"), sweep, row_id=row_id)
    return scenarios.sweep_report(rows, sweep, intervals=limits, guidelines=guidelines, row_id=row_id, clinical_only=clinical_only)


# acceptance of written runs

def write_runs(predictions: DataFrame, root: str, *, label: str = "label") -> dict:
    """Write predictions, metrics and a model contract of every (seed, fold) as named files below ``root``; returns their manifest.

    Runs are written in parallel, a task per run and kind; the driver only names files and lists digests.
    """
    spark = predictions.sparkSession
    table = sinks.prediction_table(predictions, truth=label).withColumn("run", F.concat_ws("_", F.lit("run"), "seed", "fold"))
    table.repartition("run").write.partitionBy("run").option("header", True).csv(f"{root}/outputs/predictions")
    f1 = metrics.f1_summary(metrics.confusion(predictions, truth=label, proba="p", keys=("seed", "fold")), keys=("seed", "fold"))
    scores = f1.select("seed", "fold", "macro_f1").withColumn("run", F.concat_ws("_", F.lit("run"), "seed", "fold"))
    scores.repartition("run").write.partitionBy("run").json(f"{root}/outputs/metrics")
    means = [F.avg(F.col("p")[k]).alias(f"p{k}") for k in range(N_CLASSES)]
    models = predictions.groupBy("seed", "fold").agg(*means).withColumn("run", F.concat_ws("_", F.lit("run"), "seed", "fold"))
    models.select("run", F.to_json(F.struct(*[f"p{k}" for k in range(N_CLASSES)])).alias("value")).repartition("run").write.partitionBy("run").text(f"{root}/outputs/model")
    names = {"predictions": "predictions.csv", "metrics": "metrics.json", "model": "model.joblib"}
    for kind, name in names.items():
        artifacts.name_parts(spark, f"{root}/outputs/{kind}", name)
    digests = {tuple(r["path"].rsplit("/", 3)[1:3]): r["sha256"] for r in artifacts.file_digests(spark, f"{root}/outputs").collect()}
    runs = []
    for r in scores.select("seed", "fold", "run").orderBy("seed", "fold").collect():
        entry = {"seed": r["seed"], "fold": r["fold"]}
        for kind, name in names.items():
            entry |= {kind: f"outputs/{kind}/run={r['run']}/{name}", f"{kind}_sha256": digests[kind, f"run={r['run']}"]}
        runs.append(entry)
    return {"schema_version": ARTIFACT_VERSION, "evidentiary_status": ARTIFACT_STATUS, "fold_runs": runs, **{name: ["listed"] for name in AUDIT_SECTIONS}}


# observational, statistical and longitudinal reports

def observational_report(df: DataFrame, covariates, *, reference: int, horizon: float, folds: int = 5, trim: float = 0.05, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """One row per compared arm: estimates with intervals, E-values, balance, support and restricted means."""
    frame = durable(contrasts.analysis_frame(df, covariates, horizon=horizon))
    observed = frame.where("observed")
    scored, arms = contrasts.cross_fit(observed, folds=folds, seed=seed)
    rows = durable(contrasts.spread_arms(scored, arms, reference, trim=trim))
    empty = [r["action"] for r in rows.groupBy("action").agg(F.count_if("support").alias("n")).where("n = 0").collect()]
    if empty:
        raise ValueError(f"no overlap remains for arms {empty} against {reference}")
    support = rows.groupBy("action").agg(F.count_if("support").alias("on_support_n"), F.avg(F.col("support").cast("double")).alias("on_support_fraction"))
    kept = contrasts.retention(rows).groupBy("action").agg(
        F.max(F.when(F.col("arm") == F.col("action"), F.col("fraction"))).alias("retained_action"), F.max(F.when(F.col("arm") == reference, F.col("fraction"))).alias("retained_reference"))
    rmst = contrasts.rmst_contrasts(frame, reference=reference, tau=horizon, trim=trim, folds=folds, replicates=replicates, seed=seed).select(
        "action", "rmst_difference", F.col("ci_low").alias("rmst_ci_low"), F.col("ci_high").alias("rmst_ci_high"))
    out = contrasts.bootstrap_contrasts(rows, replicates=replicates, seed=seed)
    for piece in (contrasts.worst_balance(rows, len(list(covariates))), support, kept, rmst):
        out = out.join(piece, "action")
    return out


def statistical_report(fold_metrics: DataFrame, pairs: DataFrame, *, pred_a: Column, pred_b: Column, test_fraction: float = 0.2, model_risk: str | None = None,
                       comparator_risk: str | None = None, replicates: int = 1000) -> DataFrame:
    """All paired tests in long form (test, comparison, quantity, value)."""
    def long(df: DataFrame, test: str, ids) -> DataFrame:
        values = [c for c in df.columns if c not in ids]
        typed = df.select(F.lit(test).alias("test"), F.concat_ws("/", *[F.lit(test)] if not ids else ids).alias("comparison"), *[F.col(c).cast("double").alias(c) for c in values])
        return typed.unpivot(["test", "comparison"], values, "quantity", "value")

    out = long(paired.corrected_t_test(fold_metrics, test_fraction=test_fraction), "corrected_t", ["metric", "variant_a", "variant_b"])
    out = out.unionByName(long(paired.discordance_test(pairs, a=pred_a, b=pred_b), "discordance", []))
    if bool(model_risk) != bool(comparator_risk):
        raise ValueError("model and comparator risk columns go together")
    if model_risk:
        out = out.unionByName(long(paired.paired_concordance_test(pairs, model_risk=model_risk, comparator_risk=comparator_risk, replicates=replicates), "paired_concordance", []))
    return out


def backtest(df: DataFrame, variant: str, *, replicates: int = 1000, seed: int = 42, output: str | None = None) -> DataFrame:
    errors = durable(longitudinal.predict_intervals(longitudinal.check_intervals(df), variant))
    if output:
        errors.write.mode("overwrite").parquet(f"{output}/longitudinal_predictions")
    summary = longitudinal.agreement(errors.withColumn("variant", F.lit(variant)))
    interval = longitudinal.subject_error_interval(errors, replicates=replicates, seed=seed)
    return summary.crossJoin(interval.select(*[F.col(c).alias(f"subject_{c}") for c in interval.columns]))


# Cox baseline

def score_cox(train: DataFrame, test: DataFrame, columns, keep, *, time: str = "t", event: str = "event", epochs: int = 300) -> DataFrame:
    representation = paths.fit_representation(train, replace(paths.FULL, state=False), columns)
    spread = lambda df, k: representation.preprocessor.scaled(representation.curated(df, k), k)
    fitted = cox.fit_cox(spread(train, [time, event]), representation.preprocessor.names, time=time, event=event, epochs=epochs)
    return spread(test, keep).select(*keep, fitted.probabilities().alias("p"))


def cox_baseline(train: DataFrame, test: DataFrame, *, columns=None, time: str = "t", event: str = "event", label: str = "label") -> DataFrame:
    """Survival-mode contract, curated features, proportional hazards, class metrics on the mature test rows."""
    checked = [validate_cohort(df, time=time, event=event, label=label, hard_labels=False) for df in (train, test)]
    keep = [c for c in ("row_id", time, event, label) if c in checked[1].columns]
    scored = durable(score_cox(checked[0], checked[1], columns, keep, time=time, event=event))
    counts = scored.agg(F.count(F.lit(1)).alias("n_rows"), F.count(label).alias("n_hard_endpoint_rows"))
    return counts.crossJoin(metrics.classification_report(scored, truth=label, time=time, event=event))



# streams drained into tables

def _drained(watched: DataFrame, spark: SparkSession, schema: str) -> DataFrame:
    place = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    run = (watched.writeStream.format("parquet").option("path", f"{place}/table").option("checkpointLocation", f"{place}/progress")
           .outputMode("append").trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{place}/table")


def run_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drain the conversations table through the streaming log append into a table and read it back."""
    place = f"{sf_dir}/conversations.parquet"
    found = spark.read.parquet(place)
    single = {f.rstrip("/").rsplit("/", 1)[-1] for f in found.inputFiles()} == {"conversations.parquet"}
    reader = spark.readStream.schema(found.schema)
    stream = reader.option("pathGlobFilter", "conversations.parquet").parquet(sf_dir) if single else reader.parquet(place)
    return _drained(chain.append_stream(views.as_log(stream)), spark, chain.OUTPUT)


def run_monitor_stream(spark: SparkSession, sf_dir: str, *, files_per_batch: int = 64, gradient: Column | None = None) -> DataFrame:
    """Drain the events table, a file or a folder of files, through the streaming monitor into a table and read it back."""
    place = f"{sf_dir}/events.parquet"
    found = spark.read.parquet(place)
    if not found.inputFiles():
        raise ValueError(f"no file of the events table under {place}")
    reader = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", files_per_batch)
    if {f.rstrip("/").rsplit("/", 1)[-1] for f in found.inputFiles()} == {"events.parquet"}:
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        stream = reader.parquet(place)
    rows = stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") / F.lit(250.0)).alias("residual"))
    if gradient is not None:
        rows = rows.withColumn("gradient", gradient)
    watched = monitor.monitor_stream(rows, key="event_type", anchor=[0.4, 0.3, 0.3], gradient=None if gradient is None else "gradient")
    return _drained(watched, spark, monitor.OUTPUT)
