"""Hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions import endpoint, monitoring, scores, tails
from cohortry.functions.vectors import floats
from cohortry.operators import cox, fusion, lifetable, paired, person_period, weights


def rows_of(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_months_to_class(spark):
    df = rows_of(spark, [(x,) for x in (0.5, 6.0, 11.9, 12.0, 24.0, 72.0, 90.0)], "t double")
    assert [r[0] for r in df.select(endpoint.months_to_class("t")).collect()] == [0, 1, 1, 2, 3, 7, 7]


def test_person_period_masks(spark):
    df = rows_of(spark, [(0, 4.0, 1), (1, 10.0, 0), (2, 12.0, 1), (3, 80.0, 0)], "row_id int, t double, event int")
    out = person_period.with_targets(df).orderBy("row_id").collect()
    assert [r["event_interval"] for r in out] == [0, -1, 2, -1]
    assert list(out[1]["in_lik"]) == [1, 0, 0, 0, 0, 0, 0]
    assert list(out[3]["in_lik"]) == [1] * 7


def test_risk_table_tail(spark):
    df = rows_of(spark, [(5.0, 1), (12.0, 1), (75.0, 1), (90.0, 0)], "t double, event int")
    out = lifetable.risk_table(df, cutpoints=[6.0, 12.0, 24.0, 72.0]).orderBy("interval").collect()
    assert len(out) == 5
    assert (out[4]["administrative_censoring_at_horizon"], out[4]["events"], out[4]["observed_events_after_horizon"]) == (2, 0, 1)


def test_cell_weights_grow_after_censoring(spark):
    df = rows_of(spark, [(0, 4.0, 1), (1, 10.0, 0), (2, 20.0, 1), (3, 80.0, 0)], "row_id int, t double, event int")
    cuts = [6.0, 12.0, 24.0]
    curve = lifetable.censoring_curve(df)
    out = person_period.with_cell_weights(person_period.with_targets(df, cutpoints=cuts), curve, cutpoints=cuts).orderBy("row_id").collect()
    w = np.array([r["cell_weight"] for r in out])
    lik = np.array([r["in_lik"] for r in out])
    assert np.all(w[lik == 0] == 0) and w[2, 2] > w[0, 0] and w[3, 1] > w[3, 0]


def test_horizon_outcome(spark):
    df = rows_of(spark, [(5.0, 1), (8.0, 0), (12.0, 0), (20.0, 0)], "t double, event int")
    out = df.select(endpoint.horizon_observed("t", "event", 12.0), endpoint.horizon_outcome("t", 12.0)).collect()
    assert [r[0] for r in out] == [True, False, True, True]
    assert [r[1] for r in out] == [0, 0, 0, 1]


def test_breslow_ties(spark):
    df = rows_of(spark, [(5.0, 1, math.log(2)), (5.0, 1, math.log(3)), (4.0, 1, math.log(5))], "t double, event int, s double")
    want = -(math.log(2) + math.log(3) - 2 * math.log(5) + math.log(5) - math.log(10))
    assert cox.partial_likelihood(df, "s").first()[0] == pytest.approx(want, abs=1e-12)


def test_breslow_increments(spark):
    df = rows_of(spark, [(5.0, 1, 0.0), (5.0, 1, 0.0), (4.0, 1, 0.0)], "t double, event int, s double")
    hazard = cox.baseline_hazard(df, "s").orderBy("t")
    assert [r["increment"] for r in hazard.collect()] == pytest.approx([1 / 3, 1.0])
    assert lifetable.curve_at(hazard, [3.0, 4.0, 5.0], "cumulative_hazard", default=0.0) == pytest.approx([0.0, 1 / 3, 4 / 3])


def test_breslow_log_scale(spark):
    df = rows_of(spark, [(5.0, 1, 80.0), (4.0, 1, 0.0)], "t double, event int, s double")
    out = [r["increment"] for r in cox.baseline_hazard(df, "s").orderBy("t").collect()]
    assert out == pytest.approx([math.exp(-80) / (1 + math.exp(-80)), math.exp(-80)], rel=1e-12)


def test_breslow_span_wider_than_doubles(spark):
    df = rows_of(spark, [(5.0, 1, -700.0), (4.0, 1, 900.0), (3.0, 1, 0.0)], "t double, event int, s double")
    total = cox.partial_likelihood(df, "s").first()[0]
    assert total == pytest.approx(900.0, rel=1e-12)


def test_discordance(spark):
    df = rows_of(spark, [(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 1)], "label int, pred_a int, pred_b int")
    out = paired.discordance_test(df).first()
    assert (out["a_correct_b_wrong"], out["a_wrong_b_correct"], out["discordant"]) == (1, 2, 3)
    assert out["p_value_two_sided_exact"] == pytest.approx(1.0)


def test_corrected_t(spark):
    diffs = [0.03, 0.02, 0.01, 0.04, 0.02]
    values = [("m", "a", 1, i, d) for i, d in enumerate(diffs)] + [("m", "b", 1, i, 0.0) for i in range(5)]
    out = paired.corrected_t_test(rows_of(spark, values, "metric string, variant string, seed int, fold int, value double"), test_fraction=0.2).first()
    se = math.sqrt((1 / 5 + 0.25) * np.var(diffs, ddof=1))
    assert out["t_statistic"] == pytest.approx(np.mean(diffs) / se)
    assert 0 < out["p_value_two_sided"] < 0.05


def test_tails():
    assert tails.t_two_sided(2.776445105, 4) == pytest.approx(0.05, abs=1e-8)
    assert tails.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-8)
    assert tails.sign_test_two_sided(2, 10) == pytest.approx(2 * sum(math.comb(12, k) for k in range(3)) / 2 ** 12)
    assert tails.sign_test_two_sided(0, 0) == 1.0


def test_residual(spark):
    df = rows_of(spark, [([0.1, 0.6, 0.3], 1), ([0.7, 0.2, 0.1], 0)], "p array<double>, label int")
    out = [r[0] for r in df.select(scores.residual("p", "label", width=3)).collect()]
    assert out == pytest.approx([0.4 + 0.5 * 0.26, 0.3 + 0.5 * 0.14])


def test_proximal_step(spark):
    df = rows_of(spark, [([0.55, 0.30, 0.15], [0.2, -0.1, -0.1])], "w array<double>, g array<double>")
    out = df.select(monitoring.proximal_step("w", "g", floats([0.4, 0.35, 0.25]), 3, rate=0.2, proximal=0.1)).first()[0]
    w, g, a = np.array([0.55, 0.3, 0.15]), np.array([0.2, -0.1, -0.1]), np.array([0.4, 0.35, 0.25])
    moved = np.maximum(w - 0.2 * g - 0.1 * (w - a), 0)
    assert list(out) == pytest.approx(list(moved / moved.sum()))


def test_training_weights(spark):
    times, events = [4, 8, 13, 20, 28, 40, 55, 80] * 2, [1, 1, 1, 0, 1, 0, 1, 0] * 2
    p = [[1 / 8] * 8]
    df = rows_of(spark, [(i, float(t), e, i % 8, p[0]) for i, (t, e) in enumerate(zip(times, events))], "row_id int, t double, event int, label int, p array<double>")
    out, info = weights.residual_weights(df, df)
    assert info["mean"] == pytest.approx(1.0) and info["early_censored_fraction"] > 0
    assert out.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


def test_simplex_projection():
    assert fusion.onto_simplex(np.array([0.5, 0.5])) == pytest.approx([0.5, 0.5])
    assert fusion.onto_simplex(np.array([2.0, 0.0, -1.0])) == pytest.approx([1.0, 0.0, 0.0])
    assert fusion.onto_simplex(np.array([0.4, 0.3, 0.5])).sum() == pytest.approx(1.0)
