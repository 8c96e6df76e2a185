"""Statistics of all replicates at once against rows repeated per replicate."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions.hashing import multiplicities
from cohortry.operators.concordance import concordance
from cohortry.operators.lifetable import restricted_mean
from cohortry.operators.paired import paired_concordance_test
from cohortry.operators.replicates import Quantile, bucketed, dominance, dominated, paired_replicates, quantile_draws, replicate_restricted_means
from cohortry.operators.resample import bootstrap_interval, replicate_rows

REPS = 24


def rows_of(n, seed=3, hot=0.3):
    """Half the units have two rows; a third of the rows share one time, value and risk."""
    pick = random.Random(seed)
    out = []
    for i in range(n):
        same = pick.random() < hot
        t = 5.0 if same else round(pick.expovariate(0.1), pick.choice([0, 2]))
        out.append((f"u{i if i % 3 else i // 2}", t, int(pick.random() < 0.6), 0.5 if same else round(pick.random(), pick.choice([1, 3])), round(pick.random(), 2),
                    1.0 if same else round(pick.gauss(0, 1), 2), pick.choice([0, 0, 1, 2])))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(420), "unit string, t double, event int, a double, b double, v double, arm int").persist()


def by_rep(df, *names):
    return {r["rep"]: tuple(r[n] for n in names) for r in df.collect()}


def close(got, want):
    assert set(got) == set(want)
    for rep in want:
        for x, y in zip(got[rep], want[rep]):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-6)), (rep, got[rep], want[rep])


@pytest.mark.parametrize("limit", [None, 17, 100])
@pytest.mark.parametrize("q", [0.5, 0.13])
def test_quantiles(table, limit, q):
    drawn = replicate_rows(table.select("unit", "v"), unit="unit", replicates=REPS)
    want = by_rep(drawn.groupBy("rep").agg(F.percentile("v", F.lit(q), F.col("w")).alias("draw")), "draw")
    close(by_rep(quantile_draws(table, "v", q, unit="unit", replicates=REPS, limit=limit), "draw"), want)


def test_quantile_interval_without_rows_of_replicates(table):
    a = bootstrap_interval(table, "v", unit="unit", replicates=REPS, statistic=Quantile(0.5)).first()
    b = bootstrap_interval(table, "v", unit="unit", replicates=REPS, statistic=lambda v, w: F.percentile(v, F.lit(0.5), w)).first()
    assert [round(x, 9) for x in a] == [round(x, 9) for x in b]


def test_quantiles_of_missing_values(spark):
    rows = spark.createDataFrame([("a", None), ("b", float("nan")), ("c", 2.0), ("d", 4.0)], "unit string, v double")
    draws = {round(r["draw"], 6) for r in quantile_draws(rows, "v", 0.5, unit="unit", replicates=50).collect()}
    assert draws <= {2.0, 4.0, 3.0, 2.666667, 3.333333} | {round(2 + 2 * k / n, 6) for n in range(1, 12) for k in range(n + 1)} and len(draws) > 1
    assert quantile_draws(rows.where("v is null"), "v", 0.5, unit="unit", replicates=5).collect() == []


@pytest.mark.parametrize("limit, fan", [(None, None), (25, 2), (25, 64), (60, 3), (400, 64)])
def test_paired_concordance_of_replicates(table, limit, fan):
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("risk")), F.struct(F.lit(1).alias("side"), F.col("b").alias("risk")))).alias("s")
    drawn = replicate_rows(table.select("unit", "t", "event", "a", "b"), unit="unit", replicates=REPS).select("t", "event", "rep", "w", sides).select("t", "event", "rep", "w", "s.*")
    per = concordance(drawn, keys=["rep", "side"], weight="w")
    want = by_rep(per.groupBy("rep").agg(F.max(F.when(F.col("side") == 0, F.col("ipcw_c_index"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("ipcw_c_index"))).alias("y")), "x", "y")
    got = paired_replicates(table, unit="unit", time="t", event="event", risks=["a", "b"], replicates=REPS, limit=limit, fan=fan)
    close(by_rep(got, "c0", "c1"), want)


def test_long_chunks_of_one_risk(table, monkeypatch):
    from cohortry.operators import replicates

    monkeypatch.setattr(replicates, "CHUNK", 3)
    monkeypatch.setattr(replicates, "SLICE", 7)
    flat = table.withColumn("a", F.lit(0.25)).withColumn("b", F.round("b", 1))
    got = by_rep(paired_replicates(flat, unit="unit", time="t", event="event", risks=["a", "b"], replicates=REPS, limit=10, fan=4), "c0", "c1")
    whole = by_rep(paired_replicates(flat, unit="unit", time="t", event="event", risks=["a", "b"], replicates=REPS), "c0", "c1")
    assert all(c[0] == pytest.approx(0.5) for c in got.values())
    close(got, whole)


def test_dominance_by_pairs():
    pick = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        points = np.unique(pick.integers(0, 6, (n, 2)), axis=0).astype(float)
        mass, weight = pick.integers(0, 3, (len(points), 5)).astype(float), pick.random((len(points), 5))
        want = np.zeros(5)
        for i, (x, y) in enumerate(points):
            for j, (u, v) in enumerate(points):
                if u > x and v <= y:
                    want += weight[i] * mass[j] * (1.0 if v < y else 0.5)
        assert dominated(dominance(points[:, 0], points[:, 1], np.ones(len(points), bool)), mass, weight) == pytest.approx(want)


@pytest.mark.parametrize("limit", [None, 20, 150])
def test_restricted_means_of_replicates(table, limit):
    def mass(rows, drawn):
        arm = rows["arm"].to_numpy()
        for cell in range(4):
            of = np.flatnonzero(arm == cell)
            yield cell, of, drawn[of] * (1.0 + rows["b"].to_numpy()[of][:, None])

    drawn = replicate_rows(table, unit="unit", replicates=REPS).withColumn("m", F.col("w") * (1 + F.col("b")))
    want = {(r["rep"], r["arm"]): (r["rmst"],) for r in restricted_mean(drawn, tau=12.0, keys=["rep", "arm"], weight="m").collect()}
    got = replicate_restricted_means(table, mass, 4, tau=12.0, columns=("arm", "b"), replicates=REPS, limit=limit)
    got = {(r["rep"], r["cell"]): (r["rmst"],) for r in got.collect()}
    assert all(got[rep, 3] == (None,) for rep in range(REPS))
    close({k: v for k, v in got.items() if k[1] != 3}, want)


def test_buckets_hold_bounded_groups(table):
    rows = bucketed(table, "t", limit=20)
    sizes = rows.groupBy("_bucket", "_part", "_lone").agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).orderBy("_bucket").collect()
    assert any(r["_lone"] for r in sizes) and all(r["low"] == r["high"] if r["_lone"] else r["n"] <= 40 for r in sizes)
    assert all(a["high"] < b["low"] for a, b in zip(sizes, sizes[1:]) if a["_bucket"] != b["_bucket"])
    assert sum(r["n"] for r in sizes) == table.count()


def test_same_draws_as_columns(table):
    want = {(r["unit"], r["rep"]): r["w"] for r in replicate_rows(table.select("unit").distinct(), unit="unit", replicates=REPS).collect()}
    units = [r["unit"] for r in table.select("unit").distinct().collect()]
    got = multiplicities(units, REPS, 42)
    assert {(u, k): int(got[i, k]) for i, u in enumerate(units) for k in range(REPS) if got[i, k]} == want


def test_paired_test_in_buckets(table):
    whole = paired_concordance_test(table, unit="unit", model_risk="a", comparator_risk="b", replicates=REPS).first()
    cut = paired_concordance_test(table, unit="unit", model_risk="a", comparator_risk="b", replicates=REPS, rows_per_range=40).first()
    assert [pytest.approx(x, abs=1e-6) for x in whole] == list(cut)


@pytest.mark.parametrize("rows_per_range", [7, 20, 90])
def test_concordance_with_tied_risks_across_ranges(table, rows_per_range):
    whole = concordance(table.withColumn("risk", F.col("a"))).first()
    cut = concordance(table.withColumn("risk", F.col("a")), rows_per_range=rows_per_range).first()
    assert list(cut) == [pytest.approx(x, abs=1e-9) for x in whole]


def test_digests_of_whole_arrays_are_md5():
    from hashlib import md5

    from cohortry.functions import hashing

    units = ["", "7", "12345", "é" * 9, "x" * 70, "a b"]
    found, real = [], hashing._rounds
    hashing._rounds = lambda words, shape: found.append(shape) or real(words, shape)
    try:
        got = multiplicities(units, 50, 3)
    finally:
        hashing._rounds = real
    assert found and got.dtype == np.uint8
    for i, unit in enumerate(units):
        for k in range(50):
            u = int.from_bytes(md5(f"boot|3|{k // 4}|{unit}".encode()).digest()[4 * (k % 4):4 * (k % 4) + 4], "big") / 2 ** 32
            assert got[i, k] == sum(u >= bound for bound in hashing.POISSON_ONE)


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_rows_cross_buckets_without_vectors(table, monkeypatch, small):
    """Rows carry unit and time to the levels; the weights come by time, from a small table or a large one."""
    from cohortry.operators import replicates

    seen = []
    real = replicates._ordered
    monkeypatch.setattr(replicates, "SMALL_BYTES", small)
    monkeypatch.setattr(replicates, "_ordered", lambda rows, *rest: seen.append(rows.dtypes) or real(rows, *rest))
    got = by_rep(paired_replicates(table, unit="unit", time="t", event="event", risks=["a", "b"], replicates=REPS, limit=25, fan=4), "c0", "c1")
    whole = by_rep(paired_replicates(table, unit="unit", time="t", event="event", risks=["a", "b"], replicates=REPS), "c0", "c1")
    close(got, whole)
    assert len(seen) > 1 and not any(kind == "binary" for dtypes in seen for _, kind in dtypes)


def test_blocks_and_merge_levels_agree(monkeypatch):
    from cohortry.operators import replicates

    pick = np.random.default_rng(4)
    points = np.unique(pick.integers(0, 60, (700, 2)), axis=0).astype(float)
    mass, weight, anchors = pick.integers(0, 3, (len(points), 5)).astype(float), pick.random((len(points), 5)), pick.random(len(points)) < 0.6
    weight *= anchors[:, None]
    found = []
    for bits in (0, 3, 8, 12):
        monkeypatch.setattr(replicates, "BLOCK_BITS", bits)
        found.append(dominated(dominance(points[:, 0], points[:, 1], anchors), mass, weight))
    assert all(f == pytest.approx(found[0]) for f in found)
