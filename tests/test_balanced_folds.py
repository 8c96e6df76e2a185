"""Balanced folds stay even however many parts the groups are dealt in."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortry.operators import resample


def _spreads(spark, parts_of):
    rng = np.random.default_rng(5)
    sizes = rng.integers(3, 16, 6000)
    unit = np.repeat(np.arange(6000) + 2**60, sizes)
    label = rng.choice(8, len(unit), p=[0.3, 0.2, 0.15, 0.12, 0.1, 0.08, 0.04, 0.01])
    last = np.append(unit[1:] != unit[:-1], True)
    rows = spark.createDataFrame(pd.DataFrame({"patient_id": unit, "label": np.where(last, 9, label), "event": np.where(last, 0, 1)}))
    dealt = resample.balanced_group_folds(rows, seeds=[42, 123], units_per_part=parts_of)
    assert dealt.groupBy("seed", "patient_id").count().where("count > 1").count() == 0
    pdf = dealt.join(rows, "patient_id").groupBy("seed", "label", "fold").count().toPandas()
    assert pdf.groupby("seed")["count"].sum().tolist() == [len(unit)] * 2
    wide = pdf.pivot_table(index=["seed", "label"], columns="fold", values="count", fill_value=0)
    largest = rows.groupBy("patient_id", "label").count().groupBy("label").agg(F.max("count").alias("n")).toPandas().set_index("label")["n"]
    return {k: (row.max() - row.min(), largest[k[1]]) for k, row in wide.iterrows()}


def test_no_two_folds_differ_by_more_than_two_largest_groups(spark):
    assert not {k: v for k, v in _spreads(spark, 100_000).items() if v[0] > 2 * v[1]}


def test_parts_are_evened_out_together(spark, monkeypatch):
    monkeypatch.setattr(resample, "LAST_GROUPS", 500, raising=False)
    assert not {k: v for k, v in _spreads(spark, 300).items() if v[0] > 2 * v[1]}
