"""Whole jobs in the registered queries, and paths for large inputs against plain ones."""

import inspect
from hashlib import md5, sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.fixed import SEEDS
from cohortry.functions.hashing import POISSON_ONE
from cohortry.operators import attribution, contrasts, learners, person_period, phenotypes
from cohortry.plans import jobs, paths, queries, views
from cohortry.sources import artifacts


def test_repeated_validation_job_is_whole(spark, sf_dir, monkeypatch):
    defaults = {k: v.default for k, v in inspect.signature(jobs.repeated_validation).parameters.items()}
    asked = {}

    def told(df, columns=None, **options):
        asked.update(options, rows=df.count())
        return df, df

    monkeypatch.setattr(queries.jobs, "repeated_validation", told)
    queries.repeated_validation_job(spark, sf_dir)
    given = {**defaults, **asked}
    assert given["rows"] == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert (list(given["seeds"]), given["folds"], given["overrides"], given["variants"]) == (list(SEEDS), 5, None, ("full", "A6"))
    assert (paths.FULL.trees, paths.FULL.rounds, paths.FULL.iterations, paths.FULL.starts) == (500, 500, 100, 20)


def _fitted(x, a, w, k):
    """Chances of a weighted softmax fit with penalised slopes, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    width, theta = x.shape[1], np.zeros((k, x.shape[1]))
    for _ in range(40):
        z = np.exp(x @ theta.T)
        p = z / z.sum(1, keepdims=True)
        penalty = np.tile(np.r_[np.ones(width - 1), 0.0], k)
        g = (((p - np.eye(k)[a]) * w[:, None]).T @ x).ravel() + penalty * theta.ravel()
        h = np.diag(penalty)
        for i in range(k):
            for j in range(k):
                h[i * width:(i + 1) * width, j * width:(j + 1) * width] += (x * (w * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x
        theta -= (np.linalg.pinv(h, rcond=1e-10) @ g).reshape(k, width)
    z = np.exp(x @ theta.T)
    return z / z.sum(1, keepdims=True)


@pytest.mark.parametrize("k", [2, 3])
@pytest.mark.parametrize("own", [True, False])
def test_replicates_propensities_settle_in_few_passes(spark, monkeypatch, k, own):
    """Every replicate's fit is the plain weighted one; all replicates share a pass, those that settled leave it."""
    draw = np.random.default_rng(3)
    x, a = draw.normal(size=(240, 2)), draw.integers(0, k, 240)
    units = [None if i < 2 else i // 2 for i in range(240)]
    frame = spark.createDataFrame([(u, [float(v) for v in r], int(b)) for u, r, b in zip(units, x, a)], "row_id int, x array<double>, arm int")
    sizes, sums = [], contrasts.task_sums
    monkeypatch.setattr(contrasts, "task_sums", lambda rows, partial, length, **o: sizes.append(length) or sums(rows, partial, length, **o))
    monkeypatch.setattr(contrasts, "OWN_CURVATURES", 4_000_000 if own else 0)
    thetas = contrasts.replicate_propensities(frame, list(range(k)), replicates=10)
    assert len(sizes) < (25 if own else 60) and sizes[-1] <= sizes[1]
    for b in range(10):
        heads = [f"boot|42|{b // 4}" + ("" if u is None else f"|{u}") for u in units]
        u = [int.from_bytes(md5(t.encode()).digest()[4 * (b % 4):4 * (b % 4) + 4], "big") / 2**32 for t in heads]
        w = np.searchsorted(np.array(POISSON_ONE), u, side="right").astype(float)
        z = np.column_stack([x, np.ones(240)]) @ thetas[b].T
        p = 1 / (1 + np.exp(-z[:, 0])) if k == 2 else (np.exp(z) / np.exp(z).sum(1, keepdims=True))[:, 0]
        assert p == pytest.approx(_two(x, a, w) if k == 2 else _fitted(x, a, w, k)[:, 0], abs=1e-6)


def _two(x, a, w):
    x, theta = np.column_stack([x, np.ones(len(x))]), np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ theta))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([1.0, 1.0, 0.0])
        theta -= np.linalg.solve(h, x.T @ (w * (p - a)) + np.array([1.0, 1.0, 0.0]) * theta)
    return 1 / (1 + np.exp(-x @ theta))


@pytest.mark.parametrize("held", [False, True])
def test_digests_shuffle_no_bytes(spark, tmp_path, monkeypatch, held):
    """A file streams through the task that reads it; where splits can't be set, pieces are still put in order."""
    files = {"a": b"x\n" * 400_000, "b": b"y" * 700_000 + b"\n\nz"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    if held:
        monkeypatch.setattr(artifacts, "_whole_splits", lambda *_: None)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        found = artifacts.file_digests(spark, str(tmp_path))
        assert ("RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()) == held
        got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in found.collect()}
        assert got == {n: sha256(d).hexdigest() for n, d in files.items()} and spark.conf.get("spark.sql.files.maxPartitionBytes") == "100000"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("rows_per_range", [None, 40])
def test_permutations_send_no_whole_rows(spark, rows_per_range):
    """What is dealt out by trial or place twice is a place and a value; one id is null, one value is missing."""
    draw = np.random.default_rng(5)
    rows = [(None if i == 0 else 3 * i, float(a), None if i == 7 else float(b)) for i, (a, b) in enumerate(draw.normal(size=(300, 2)))]
    score = lambda get: F.array(F.lit(1.0) / (F.lit(1.0) + F.exp(get("a") + F.lit(2.0) * F.coalesce(get("b"), F.lit(0.5)))), F.lit(0.4))
    df = spark.createDataFrame(rows, "row_id int, a double, b double")
    found = attribution.permutation_attributions(df, ["a", "b"], score, repeats=3, rows_per_range=rows_per_range)
    dealt = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line]
    assert len(dealt) == 3 and sum("_trial" in line for line in dealt) == 1
    want: dict = {}
    chances = lambda a, b: (1 / (1 + np.exp(a + 2 * (0.5 if b is None else b))), 0.4)
    for f in range(2):
        for r in range(3):
            u = lambda i: int(md5("|".join(["perm", "42", "ab"[f], str(r), *([] if i is None else [str(i)])]).encode()).hexdigest()[:8], 16)
            donors = sorted(range(300), key=lambda k: (u(rows[k][0]), k))
            for row, d in zip(rows, donors):
                plain, swapped = chances(*row[1:]), chances(*(rows[d][j + 1] if j == f else row[j + 1] for j in range(2)))
                top = int(plain[0] < 0.4)
                want.setdefault((row[0], "ab"[f]), []).append(plain[top] - swapped[top])
    assert {(r["row_id"], r["feature"]): r["attribution"] for r in found.collect()} == {k: pytest.approx(np.mean(v), abs=1e-9) for k, v in want.items()}


@pytest.mark.parametrize("block_rows", [9, 32_000])
def test_silhouette_sends_a_row_once_per_block(spark, monkeypatch, block_rows):
    """Against all pairs at once: far from the origin, with equal points, near points and a cluster of one."""
    monkeypatch.setattr(phenotypes, "TILE_ROWS", 4)
    draw = np.random.default_rng(4)
    z = draw.normal(size=(60, 3)) + 1e5
    z[7], z[9] = z[8], z[8] + 1e-7
    c = np.r_[np.arange(59) % 3, 5]
    df = spark.createDataFrame([(i, int(k), [float(v) for v in row]) for i, (k, row) in enumerate(zip(c, z))], "row_id long, cluster int, z array<double>")
    found = phenotypes.silhouette(df, block_rows=block_rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "CoGroup" not in plan
    apart = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    value = []
    for i in range(60):
        own = c == c[i]
        a = apart[i, own].sum() / max(own.sum() - 1, 1)
        b = min(apart[i, c == k].mean() for k in set(c) - {c[i]})
        value.append(0.0 if own.sum() == 1 else (b - a) / max(a, b))
    assert found.first()[0] == pytest.approx(np.mean(value), abs=1e-9)


@pytest.mark.parametrize("interactions", [True, False])
def test_pooled_hazards_hold_no_cells(spark, sf_dir, monkeypatch, interactions):
    """The fit over subjects equals the logistic regression over written-out cells; nothing is cached, and no cell is written."""
    train = views.labelled(spark, sf_dir)
    monkeypatch.setattr(learners, "fit_logistic", lambda *_, **__: pytest.fail("cells are fitted as rows"))
    fitted = jobs.fit_discrete(train, ["x1", "x2"], interactions=interactions)
    monkeypatch.undo()
    assert not list(spark.sparkContext._jsc.getPersistentRDDs())
    x = F.array(*[(F.col(n) - F.lit(m)) / F.lit(s) for n, m, s in zip(fitted.names, fitted.mean, fitted.scale)])
    rows = person_period.with_cell_weights(person_period.with_targets(train.withColumn("_x", x)), fitted.curve)
    cells = person_period.person_period(rows, keep=("_x",), extra=("cell_weight",)).where("in_lik = 1")
    here = [(F.col("interval") == i).cast("double") for i in range(7)]
    design = F.array(*here, *[h * F.col("_x")[j] for h in (here if interactions else [F.lit(1.0)]) for j in range(2)])
    plain = learners.fit_logistic(cells.select("target", "cell_weight", design.alias("v")), "v", "target", weight="cell_weight", c=1e6, width=2)
    beta, base = plain.coefficients[0], plain.intercepts[0]
    assert fitted.offsets == pytest.approx([base + b for b in beta[:7]], abs=2e-3)
    assert np.array(fitted.slopes) == pytest.approx(np.array(beta[7:]).reshape(-1, 2) * np.ones((7, 1)), abs=2e-3)


def test_pooled_hazards_refuse_missing_features(spark):
    """A missing feature of an observed cell is a fault; rows without an observed cell take no part."""
    rows = lambda x: spark.createDataFrame([([0.5], 0, [1.0, 0.0]), ([-0.5], 1, [1.0, 2.0]), ([1.0], 1, [1.0, 1.5]), ([0.2], -1, [1.0, 1.0]),
                                            ([0.1], 0, [1.0, 0.0]), (x, -1, [0.0, 0.0] if x == [None] else [1.0, 1.0])], "x array<double>, event_interval int, w array<double>")
    plain = person_period.fit_pooled(rows([0.3]).where("w[0] > 0").limit(5), "x", "w", inputs=1, intervals=2, c=1.0)
    assert person_period.fit_pooled(rows([None]), "x", "w", inputs=1, intervals=2, c=1.0)[0] == pytest.approx(plain[0])
    with pytest.raises(ValueError, match="finite"):
        person_period.fit_pooled(rows([None]).withColumn("w", F.array(F.lit(1.0), F.lit(1.0))), "x", "w", inputs=1, intervals=2)
