"""Wide rows: small compiled methods, moments and quantiles by columns, hashed choices without numbers."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortry.functions import hashing
from cohortry.operators.moments import scale_stats
from cohortry.operators.quantiles import exact_quantiles
from cohortry.plans.queries import QUERIES


def test_queries_keep_compiled_methods_small(spark, sf_dir):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    QUERIES["survival_class"](spark, sf_dir)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_hash_below_is_the_comparison_of_the_draw(spark):
    for bound in (0.1, 0.5, 0.8, 1.0):
        rows = spark.range(3000).select(hashing.hash_below(bound, "k", F.col("id")).alias("a"), (hashing.hash_uniform("k", F.col("id")) < bound).alias("b"))
        assert rows.where("a != b").count() == 0


def test_moments_and_quantiles_of_columns_with_nulls(spark):
    rng = np.random.default_rng(3)
    values = pd.DataFrame({"a": 1e6 + rng.normal(size=20_000), "b": rng.integers(0, 3, 20_000).astype(float), "c": np.full(20_000, np.nan)})
    values.loc[::7, "a"] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in values.to_numpy()], "a double, b double, c double").repartition(5)
    mean, scale = scale_stats(df, ["a", "b", "c"])
    assert np.allclose(mean, [values["a"].mean(), values["b"].mean(), 0.0]) and np.allclose(scale, [values["a"].std(ddof=0), values["b"].std(ddof=0), 1.0])
    found = {(r["name"], r["q"]): r["value"] for r in exact_quantiles(df, ["a", "b", "c"], [0.0, 0.5, 0.93], gather_cells=0).collect()}
    for name in "ab":
        for q in (0.0, 0.5, 0.93):
            assert abs(found[name, q] - values[name].quantile(q)) < 1e-9
    assert found["c", 0.5] is None
