"""Means of residuals that equal a limit."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortry.streaming import monitor
from test_whole_runs import stream_of


def test_a_mean_at_the_limit_is_not_beyond_it(spark, tmp_path):
    pick = random.Random(3)
    values = []
    for _ in range(300):  # pairs around 0.18: after every second row the mean of all so far is 0.18, in decimals
        v = pick.randrange(18) / 100
        values += [round(0.18 + v, 2), round(0.18 - v, 2)]
    assert any(sum(values[k : k + 30]) / 30 > 0.18 for k in range(0, 571, 2))  # doubles go beyond it
    rows = [(i, 10 * i, v) for i, v in enumerate(values)]
    stream = stream_of(spark, tmp_path, [rows[:250], rows[250:]])
    run = monitor.monitor_stream(stream, key="stream", anchor=[0.4, 0.35, 0.25]).writeStream.format("memory").queryName("limit").trigger(availableNow=True).start()
    run.awaitTermination()
    streamed = {r["event_id"]: (r["streaming_error"], r["action"]) for r in spark.table("limit").collect()}
    table = spark.createDataFrame(rows, "event_id bigint, ts bigint, residual double").withColumn("stream", F.lit("k"))
    replayed = {r["event_id"]: (r["streaming_error"], r["action"]) for r in monitor.replay(table, key="stream", order=["ts"]).collect()}
    assert replayed == streamed
    assert all(streamed[i] == (0.18, "no_update") for i in range(1, 600, 2))


def test_residuals_that_are_no_decimals(spark):
    rows = [(0, 0.25), (1, None), (2, float("inf")), (3, 1e300)]
    table = spark.createDataFrame(rows, "ts int, residual double").withColumn("stream", F.lit("k"))
    got = [r["streaming_error"] for r in monitor.replay(table, key="stream", order=["ts"], window=1).orderBy("ts").collect()]
    assert got == [0.25, None, float("inf"), 1e300]


def test_a_long_stream_is_held_as_flat_arrays():
    import tracemalloc

    def frames(n):
        for k in range(n):
            i = np.arange(5_000) + 5_000 * k
            yield pd.DataFrame({"key": "k", "event_id": i, "ts": pd.to_datetime(i, unit="s"), "residual": i / 7.0,
                                "gradient": [None if j % 5 == 0 else np.array([j, 1.0, 2.0]) for j in i.tolist()]})

    tracemalloc.start()
    ts, ids, residuals, slopes = monitor._columns(frames(40), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000 * 90  # held as objects, a row takes over 200 bytes
    assert ids.tolist() == list(range(200_000)) and residuals[7] == 1.0 and slopes.shape == (200_000, 3)
    assert np.isnan(slopes[0]).all() and slopes[6].tolist() == [6.0, 1.0, 2.0] and ts[1] - ts[0] == np.timedelta64(1, "s")
