"""The paths taken by large inputs give the results of brute force on small ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import concordance, contrasts, cox, lifetable, ordered, phenotypes, quantiles, resample
from cohortry.session import durable
from cohortry.streaming import monitor


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 150
    t = rng.integers(0, 18, n) / 2.0
    t[:50] = 4.0  # a third of all rows share one time
    event = rng.integers(0, 2, n)
    risk = rng.integers(0, 9, n) / 4.0
    risk[60:110] = 1.0
    key = (rng.random(n) < 0.6).astype(int)
    return t, event, risk, key


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(i, float(a), int(b), float(c), int(k)) for i, (a, b, c, k) in enumerate(zip(*data))]
    return durable(spark.createDataFrame(rows, "row_id bigint, t double, event int, risk double, k int"))


def brute_pairs(t, e, r):
    g, s = {}, 1.0
    for u in np.unique(t):
        g[u] = s
        s *= 1 - ((t == u) & (e == 0)).sum() / (t >= u).sum()
    top = bottom = wtop = wbottom = 0.0
    for i in np.flatnonzero(e == 1):
        later = t > t[i]
        good = (r[i] > r[later]).sum() + 0.5 * (r[i] == r[later]).sum()
        top, bottom = top + good, bottom + later.sum()
        w = g[t[i]] ** -2
        wtop, wbottom = wtop + w * good, wbottom + w * later.sum()
    return bottom, top / bottom, wtop / wbottom


@pytest.mark.parametrize("rows_per_range", [None, 11])
def test_concordance(frame, data, rows_per_range):
    t, e, r, k = data
    got = concordance.concordance(frame, rows_per_range=rows_per_range).first()
    assert tuple(got) == pytest.approx(brute_pairs(t, e, r))
    by_key = {x["k"]: tuple(x)[1:] for x in concordance.concordance(frame, keys=["k"], rows_per_range=rows_per_range).collect()}
    for key in (0, 1):
        assert by_key[key] == pytest.approx(brute_pairs(t[k == key], e[k == key], r[k == key]))


def test_harrell_equals_weighted_without_censoring(frame):
    got = concordance.concordance(frame.withColumn("event", F.lit(1))).first()
    assert got["harrell_c_index"] == pytest.approx(got["ipcw_c_index"])


@pytest.mark.parametrize("rows_per_range", [None, 5])
def test_survival_and_lookup(frame, data, spark, rows_per_range):
    t, e, _, _ = data
    curve = {r["t"]: r["survival"] for r in lifetable.kaplan_meier(frame, rows_per_range=rows_per_range).collect()}
    s = 1.0
    for u in np.unique(t):
        s *= 1 - ((t == u) & (e == 1)).sum() / (t >= u).sum()
        assert curve[u] == pytest.approx(s)
    censor = lifetable.censoring_curve(frame, rows_per_range=rows_per_range)
    asked = spark.createDataFrame([(x / 3,) for x in range(40)], "t double")
    steps = {r["t"]: r["g_at"] for r in censor.collect()}
    for before in (False, True):
        got = ordered.step_lookup(asked, censor, time="t", value="g_at", before=before, default=1.0, rows_per_range=rows_per_range).collect()
        for row in got:
            known = [u for u in steps if (u < row["t"] if before else u <= row["t"])]
            assert row["g_at"] == pytest.approx(steps[max(known)] if known else 1.0)


def test_unit_weights_change_nothing(frame):
    plain = lifetable.restricted_mean(frame, tau=6.0, keys=["k"]).orderBy("k").collect()
    weighted = lifetable.restricted_mean(frame.withColumn("w", F.lit(1.0)), tau=6.0, keys=["k"], weight="w", rows_per_range=7).orderBy("k").collect()
    assert [r["rmst"] for r in plain] == pytest.approx([r["rmst"] for r in weighted])


def test_next_and_numbers_across_ranges(frame):
    values = {"nt": F.col("t")}
    one = {r["row_id"]: r["nt"] for r in ordered.next_values(frame, ["k"], ["t", "row_id"], values).collect()}
    many = {r["row_id"]: r["nt"] for r in ordered.next_values(frame, ["k"], ["t", "row_id"], values, rows_per_range=13).collect()}
    assert one == many
    a = {r["row_id"]: r["seq"] for r in ordered.row_numbers(frame, ["k"], ["t", "row_id"]).collect()}
    b = {r["row_id"]: r["seq"] for r in ordered.row_numbers(frame, ["k"], ["t", "row_id"], rows_per_range=13).collect()}
    assert a == b


def test_salted_join(frame):
    table = durable(frame.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg("risk").alias("m")))
    wide = ordered.enrich(frame, table, "t", size_column="n", broadcast_rows=1)
    assert wide.count() == frame.count()
    assert wide.agg(F.sum("m")).first()[0] == pytest.approx(frame.join(table, "t").agg(F.sum("m")).first()[0])


def test_quantiles_by_bracket(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(60_000) < 0.4, 2.5, rng.normal(size=60_000) * 3)
    df = durable(spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(x)], "v double, k int"))
    got = quantiles.exact_quantiles(df, ["v"], [0.025, 0.5, 0.99], keys=["k"], gather_cells=10).collect()
    for row in got:
        assert row["value"] == pytest.approx(np.quantile(x[row["k"]::2], row["q"]))
    small = quantiles.exact_quantiles(df.limit(101), ["v"], [0.1], gather_cells=10).first()
    assert small["value"] == pytest.approx(np.quantile([r["v"] for r in df.limit(101).collect()], 0.1))


def test_cox_matches_direct_optimum(frame, data):
    t, e, r, k = data
    x = np.column_stack([r, k]).astype(float)
    x = (x - x.mean(0)) / x.std(0)
    beta, m, v = np.zeros(2), np.zeros(2), np.zeros(2)
    for step in range(1, 6):
        g = 1e-3 * np.sign(beta) + 2e-3 * beta
        for u in np.unique(t[e == 1]):
            risk, dead = t >= u, (t == u) & (e == 1)
            w = np.exp(x[risk] @ beta)
            g = g + dead.sum() * (w @ x[risk]) / w.sum() - x[dead].sum(0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        beta = beta - 0.03 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    fitted = cox.fit_cox(frame, ["risk", "k"], solver="adam", epochs=5)
    assert fitted.beta == pytest.approx(beta.tolist(), abs=1e-9)
    ranged = cox.fit_cox(frame, ["risk", "k"], solver="adam", epochs=2, rows_per_range=6)
    assert ranged.beta == pytest.approx(cox.fit_cox(frame, ["risk", "k"], solver="adam", epochs=2).beta, abs=1e-9)


def test_silhouette_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(a), float(b)], int(i % 3)) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))]
    df = durable(spark.createDataFrame(rows, "row_id bigint, z array<double>, cluster int"))
    whole = phenotypes.silhouette(df).first()[0]
    assert phenotypes.silhouette(df, block_rows=7).first()[0] == pytest.approx(whole)


def test_replay_blocks(frame):
    rows = frame.withColumn("residual", F.col("risk"))
    plain = {r["row_id"]: r["streaming_error"] for r in monitor.replay(rows, key="k", order=["t", "row_id"], window=5).collect()}
    cut = {r["row_id"]: r["streaming_error"] for r in monitor.replay(rows, key="k", order=["t", "row_id"], window=5, block_rows=9, rows_per_range=20).collect()}
    assert plain.keys() == cut.keys()
    assert [cut[i] for i in plain] == pytest.approx(list(plain.values()))


def test_splits_cover_and_separate(frame):
    rows = frame.withColumn("label", (F.col("row_id") % 4).cast("int")).withColumn("patient_id", F.floor(F.col("row_id") / 2))
    for limit in (None, 31):
        out = resample.repeated_splits(rows, seeds=[1], folds=3, rows_per_range=limit).toPandas()
        assert out[out.role == "test"].groupby("row_id").size().eq(1).all()
        assert out.groupby("fold").row_id.nunique().eq(150).all()
        out["patient"] = out.row_id // 2
        assert out.groupby(["fold", "patient"]).role.nunique().eq(1).all()


def test_batched_refits_match_single_fits(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(a), [float(x), float(y)]) for i, (a, x, y) in enumerate(zip(rng.integers(0, 3, 300), rng.normal(size=300), rng.normal(size=300)))]
    df = durable(spark.createDataFrame(rows, "row_id bigint, arm int, x array<double>"))
    thetas = contrasts.replicate_propensities(df, [0, 1, 2], replicates=3)
    drawn = resample.replicate_rows(df, unit="row_id", replicates=3).where("rep = 2").toPandas()
    x = np.column_stack([np.vstack(drawn["x"]), np.ones(len(drawn))])
    z = np.exp(x @ thetas[2].T)
    p = z / z.sum(1, keepdims=True)
    gradient = ((p - np.eye(3)[drawn["arm"]]) * drawn["w"].to_numpy()[:, None]).T @ x + thetas[2] * [1, 1, 0]
    assert np.abs(gradient).max() < 1e-3


def test_focal_losses_read_the_orders_once(spark, sf_dir):
    from cohortry.plans.queries import QUERIES

    plan = QUERIES["focal_loss"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Window [" in line and "lead" in line for line in plan.splitlines()) == 1, plan
