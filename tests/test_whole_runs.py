"""Draws without expansion, monitors that lose nothing, digests over every fitted part, wide score spans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import contrasts, cox, learners, phenotypes, privacy, resample
from cohortry.plans import jobs, paths, views
from cohortry.streaming import monitor


def test_replicate_sums_equal_expanded_rows(spark):
    rows = spark.range(900).select((F.col("id") % 130).alias("u"), (F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") * 1.5).alias("v"))
    got = {(r.k, r.rep): (r.s, r.n) for r in resample.replicate_sums(rows, {"s": F.col("v"), "n": F.lit(1)}, unit="u", keys=["k"], replicates=37).collect()}
    wide = resample.replicate_rows(rows, unit="u", replicates=37)
    want = {(r.k, r.rep): (r.s, r.n) for r in wide.groupBy("k", "rep").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").cast("double").alias("n")).collect()}
    assert set(want) <= set(got)
    for key, (s, n) in got.items():
        assert (s, n) == pytest.approx(want.get(key, (0.0, 0.0)))


def stream_of(spark, tmp_path, batches):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "event_id bigint, s int, residual double").select(
            "event_id", F.timestamp_seconds("s").alias("ts"), F.lit("k").alias("stream"), "residual", F.array(F.lit(0.2), F.lit(-0.1), F.lit(-0.1)).alias("g")
        ).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_monitor_keeps_rows_that_come_late(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[(1, 900_000, 0.1)], [(2, 10, 0.2), (3, 950_000, 0.3)], [(4, 5, 0.4)]])
    run = monitor.monitor_stream(stream, key="stream", anchor=[0.4, 0.35, 0.25]).writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["event_id"] for r in spark.table("late").collect()) == [1, 2, 3, 4]


def test_monitor_moves_weights_on_a_soft_step(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[(1, 10, 0.1)], [(2, 20, 0.4)]])
    out = monitor.monitor_stream(stream, key="stream", anchor=[0.4, 0.35, 0.25], gradient="g", window=30, rate=0.2, proximal=0.1)
    run = out.writeStream.format("memory").queryName("soft").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.table("soft").orderBy("event_id").collect()
    assert [r["action"] for r in rows] == ["no_update", "soft_update"]
    moved = np.maximum(np.array([0.4, 0.35, 0.25]) - 0.2 * np.array([0.2, -0.1, -0.1]), 0)
    assert rows[0]["weights"] == [0.4, 0.35, 0.25] and rows[1]["weights"] == pytest.approx((moved / moved.sum()).tolist())


def test_monitor_reads_a_folder_of_files(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    got = jobs.run_monitor_stream(spark, str(tmp_path))
    assert got.count() == events.count()
    assert jobs.run_monitor_stream(spark, sf_dir).count() == events.count()


def test_noise_needs_a_key(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0])], "i int, g array<double>")
    with pytest.raises(ValueError, match="secret"):
        privacy.noisy_gradients(rows, gradient="g", width=2, row_id="i", secret="")
    a, b = (privacy.noisy_gradients(rows, gradient="g", width=2, row_id="i", secret=k).first()["noisy"] for k in ("a", "b"))
    assert a != b


def test_every_fitted_part_is_in_the_digest(spark, sf_dir):
    rows = views.labelled(spark, sf_dir).drop("cls").where("row_id % 4 = 0")
    settings = paths.Settings(**{**paths.SMALL, "trees": 3})
    path = paths.fit_path(rows.where("row_id % 3 > 0"), rows.where("row_id % 3 = 0"), settings, columns=["x1", "x2"])
    before = path.digest()
    assert path.digest() == before
    forest = path.base["forest"]
    kept = forest.calibrator
    forest.calibrator = learners.LinearModel(kept.classes, [[v + 1e-9 for v in row] for row in kept.coefficients], kept.intercepts, kept.width)
    assert path.digest() != before
    forest.calibrator = kept
    found = path.phenotypes
    path.phenotypes = phenotypes.Phenotypes([m + 1.0 for m in found.mean], found.pca, found.kept, found.kmeans, found.features)
    assert path.digest() != before
    path.phenotypes = found
    path.representation.disabled_blocks = ("tumor",)
    assert path.digest() != before
    path.representation.disabled_blocks = ()
    assert path.digest() == before


def test_variants_that_fit_the_same_are_refused(spark, sf_dir):
    paths.check_variants(["full", "A6", "A2", "PhasePNoIPCW"])
    for names in (["A5"], ["NoCal"], ["A4", "A6"], ["nothing"]):
        with pytest.raises(ValueError):
            paths.check_variants(names)


def test_covariates_have_to_be_finite(spark):
    rows = spark.createDataFrame([(1, 5.0, 1, 0, 1.0), (2, 9.0, 0, 1, None)], "row_id int, t double, event int, arm int, x1 double")
    with pytest.raises(Exception, match="finite covariates"):
        contrasts.analysis_frame(rows, ["x1"], horizon=6.0).collect()


@pytest.mark.parametrize("beta", [0.5, 2.5, 6.0])
def test_cox_gradient_over_a_wide_span(spark, beta):
    pick = np.random.default_rng(4)
    x = np.where(np.arange(60) == 7, 300.0, pick.normal(size=60))
    t, d = pick.permutation(60) + 1.0, (pick.random(60) < 0.7).astype(int)
    rows = spark.createDataFrame([(float(a), int(b), [float(c)]) for a, b, c in zip(t, d, x)], "t double, event int, x array<double>")
    value, slope = cox._Gradient(rows, 1, None)(np.array([beta]))
    s = beta * x
    want, grad = 0.0, 0.0
    for i in np.flatnonzero(d):
        risk = t >= t[i]
        top = s[risk].max()
        w = np.exp(s[risk] - top)
        want += top + np.log(w.sum()) - s[i]
        grad += (w * x[risk]).sum() / w.sum() - x[i]
    assert value == pytest.approx(want, rel=1e-9) and slope[0] == pytest.approx(grad, rel=1e-6, abs=1e-6)
