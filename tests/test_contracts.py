"""Error contracts, audit and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from cohortry.fixed import CURATED, EXPLICIT, FREEZE_CONTRACTS
from cohortry.operators import contrasts, features, fusion, longitudinal
from cohortry.plans import jobs, paths, views
from cohortry.sources import artifacts, cohort, sinks
from cohortry.streaming import chain, monitor, shadow


def test_immature_rows(spark):
    df = spark.createDataFrame([("a", 10.0, 0), ("b", 80.0, 0)], "patient_id string, t double, event int")
    with pytest.raises(ValueError, match="undefined for 1 rows"):
        cohort.validate_cohort(df, time="t", event="event", label="label")
    out = cohort.validate_cohort(df, time="t", event="event", label="label", hard_labels=False).orderBy("patient_id").collect()
    assert [r["label"] for r in out] == [None, 7] and out[0]["surgical_strategy"] == "unknown"


def test_bad_columns(spark):
    df = spark.createDataFrame([("x", 2)], "t string, event int")
    with pytest.raises(ValueError, match="0/1"):
        cohort.validate_cohort(df, time="t", event="event", label="label")
    with pytest.raises(ValueError, match="missing required"):
        cohort.validate_cohort(df.drop("t"), time="t", event="event", label="label")
    with pytest.raises(ValueError, match="suffix"):
        cohort.load_table(spark, "/tmp/x.json")


def test_label_spellings(spark):
    good = cohort.normalise_label(spark.createDataFrame([("C1",), (" c8",), ("0",), ("8",)], "l string"), "l")
    assert [r[0] for r in good.collect()] == [0, 7, 0, 7]
    with pytest.raises(ValueError, match="invalid"):
        cohort.normalise_label(spark.createDataFrame([("C9",)], "l string"), "l")


def test_csv_keeps_the_none_arm(spark, tmp_path):
    path = str(tmp_path / "arms.csv")
    spark.createDataFrame([(1, "None"), (2, "TACE")], "row_id int, index_treatment_action string").write.option("header", True).csv(path)
    out = features.observed_actions(cohort.load_table(spark, path)).orderBy("row_id").collect()
    assert [r["arm"] for r in out] == [0, 2]


@pytest.mark.parametrize("row, fault", [
    (("surgery?", "unknown", 0.0), "unrecognised"), (("TACE", "resection", 0.0), "contradicted"), (("TACE", "none", 1.0), "contradicted")])
def test_action_conflicts(spark, row, fault):
    df = spark.createDataFrame([(1, *row)], "row_id int, index_treatment_action string, surgical_strategy string, treatment_resection double")
    with pytest.raises(ValueError, match=fault):
        features.observed_actions(df)


def test_feature_quirks(spark):
    df = spark.createDataFrame([(1, None, 0.0, None, "unknown", "IV")], "row_id int, age double, hbv_positive double, afp double, surgical_strategy string, ajcc_stage string")
    out = features.curate(df).first()
    assert (out["age_ge_65"], out["stage_iv"], out["afp_gt400"], out["nbnc"], out["treatment_no_resection"]) == (0.0, 1.0, None, 1.0, 1.0)
    assert out["liver_recovery_score"] is None and out["lesion_count"] == 1.0 and out["race_asian"] is None


def test_explicit_features(spark):
    df = spark.createDataFrame([tuple(str(i) for i in range(67))], ", ".join(f"{c} string" for c in EXPLICIT))
    assert list(features.curate(df).first()) == [float(i) for i in range(67)]


def test_later_columns_have_no_influence(spark, sf_dir):
    rows = views.clinical(spark, sf_dir).limit(20)
    plain = features.curate(rows).toPandas()
    extra = features.curate(rows.withColumn("surgical_margin_positive", F.lit(1)).withColumn("post_op_afp", F.lit(9))).toPandas()
    assert plain.sort_values("row_id").equals(extra.sort_values("row_id")) and len(CURATED) == 67


def test_assignment_columns_are_rejected():
    with pytest.raises(ValueError, match="antiviral_therapy"):
        contrasts.check_pretreatment(["age", "antiviral_therapy"])


def test_freeze_tampering():
    contracts = {c: {"curated_dimension": 67, "strategy": "median", "fit_scope": "s"} for c in FREEZE_CONTRACTS}
    manifest = artifacts.freeze_manifest(contracts, "d" * 64)
    assert artifacts.verify_freeze(manifest, contracts, "d" * 64)["model_sha256"] == "d" * 64
    with pytest.raises(ValueError, match="decision_contract_sha256"):
        artifacts.verify_freeze(manifest, {**contracts, "decision": {"x": 1}}, "d" * 64)
    with pytest.raises(ValueError, match="imputation_frozen"):
        artifacts.verify_freeze({**manifest, "imputation_frozen": False}, contracts, "d" * 64)
    with pytest.raises(ValueError):
        artifacts.contract_digest({"x": float("nan")})


def test_anchor_limits(spark):
    df = spark.createDataFrame([(i % 2, [1 / 8] * 8) for i in range(31)], "label int, p array<double>")
    with pytest.raises(ValueError, match="31 rows"):
        fusion.fit_anchor_platt(df, "p")
    with pytest.raises(ValueError, match="two observed"):
        fusion.fit_anchor_platt(df.where("label = 0"), "p")
    with pytest.raises(ValueError, match="overlap"):
        jobs.assert_disjoint(spark.createDataFrame([("a",)], "patient_id string"), spark.createDataFrame([("a",)], "patient_id string"))


def test_audit_manifest(spark, tmp_path):
    run = tmp_path / "run"
    run.mkdir()
    (run / "metrics.json").write_text(json.dumps({"seed": 42, "fold": 0, "macro_f1": 0.5}))
    (run / "predictions.csv").write_text("patient_id,seed\na,42\n")
    (run / "model.bin").write_bytes(b"model")
    digests = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in artifacts.file_digests(spark, str(tmp_path)).collect()}
    entry = {"seed": 42, "fold": 0, "metrics": "run/metrics.json", "metrics_sha256": digests["metrics.json"], "predictions": "run/predictions.csv",
             "predictions_sha256": digests["predictions.csv"], "model": "run/model.bin", "model_sha256": "0" * 64}
    manifest = {"schema_version": 1, "evidentiary_status": "real_experiment_outputs", "fold_runs": [entry], "censoring_audit": ["x"]}
    found = {(r["scope"], r["fault"][:15]) for r in artifacts.audit_manifest(spark, manifest, str(tmp_path)).collect()}
    assert ("run/model.bin", "digest_mismatch") in found
    assert any(s == "run/predictions.csv" and f.startswith("lacks") for s, f in found)
    assert sum(f == "run missing" for _, f in found) == 24 and ("figure_inputs", "found False, wa") in found


def test_interval_contract(spark, sf_dir):
    rows = views.intervals(spark, sf_dir)
    with pytest.raises(ValueError, match="end_month"):
        longitudinal.check_intervals(rows.withColumn("end_month", F.lit(0.0)))
    with pytest.raises(ValueError, match="missing columns"):
        longitudinal.check_intervals(rows.drop("recovery_score"))


def test_variants():
    assert len(paths.VARIANTS) == 24 and paths.VARIANTS["A1"].cox_only and not paths.VARIANTS["A6"].platt
    assert features.block_mask(("tumor",))[12:18] == [0] * 6


def test_prediction_header(spark, sf_dir, tmp_path):
    rows = views.predictions(spark, sf_dir).withColumn("seed", F.lit(42)).withColumn("fold", (F.col("row_id") % 2).cast("int"))
    sinks.write_predictions(sinks.prediction_table(rows), str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert artifacts.header_faults(back.columns) == [] and back.where("fold = 1").count() == rows.where("fold = 1").count()


def test_monitor_stream_weights(spark, tmp_path):
    source = str(tmp_path / "in")
    batches = [[(1, 10, 0.1), (2, 20, 0.9)], [(3, 30, 0.05), (4, 40, 0.02)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "event_id bigint, s int, residual double").select(
            "event_id", F.timestamp_seconds("s").alias("ts"), F.lit("k").alias("stream"), "residual", F.array(F.lit(1.0), F.lit(-1.0)).alias("g")).coalesce(1).write.parquet(f"{source}/{i}")
    schema = spark.read.parquet(f"{source}/0").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(source)
    out = monitor.monitor_stream(stream, key="stream", anchor=[0.5, 0.5], gradient="g", window=2, rate=0.1, proximal=0.0)
    run = out.writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.table("watched").orderBy("event_id").collect()
    assert [r["action"] for r in rows] == ["no_update", "full_retrain", "full_retrain", "no_update"]
    assert [r["streaming_error"] for r in rows] == pytest.approx([0.1, 0.5, 0.475, 0.035])


def test_chain_stream_equals_batch(spark, sf_dir, tmp_path):
    entries = views.log_entries(spark, sf_dir)
    source = str(tmp_path / "entries")
    entries.repartition(1).write.parquet(source)
    run = chain.append_stream(spark.readStream.schema(entries.schema).parquet(source)).writeStream.format("memory").queryName("chained").trigger(availableNow=True).start()
    run.awaitTermination()
    batch = {(r["chain_id"], r["seq"]): r["hash"] for r in chain.append(entries).collect()}
    assert {(r["chain_id"], r["seq"]): r["hash"] for r in spark.table("chained").collect()} == batch
    checked = chain.verify(chain.append(entries), rows_per_range=10)
    assert checked.where("not intact").count() == 0


def test_shadow_router(spark, tmp_path):
    rows = spark.createDataFrame([(1, "serve")], "row_id int, decision string")
    for gate, served in ((shadow.ShadowGate(None, True), False), (shadow.ShadowGate("A", True), True)):
        base = tmp_path / gate.mode
        gate.router(str(base / "log"), str(base / "out"))(rows, 0)
        assert (base / "log").exists() and (base / "out").exists() == served
