"""Residual monitor: batch replay by windows and the same rule on a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cohortry.fixed import ERROR_HARD, ERROR_SOFT, MONITOR_WINDOW, ONLINE_RATE, PROXIMAL_RATE
from cohortry.functions.monitoring import abstain_decision, update_action
from cohortry.functions.scores import entropy
from cohortry.operators.ordered import ROWS_PER_RANGE, row_numbers


#: decimals of a residual that count in a mean
DECIMALS = 18
PLACES = Decimal(1).scaleb(-DECIMALS)
WIDE = Context(prec=60)


def _exact(value: float) -> Decimal | None:
    """A residual as the decimal that it prints as; None if it doesn't fit into ``decimal(38, 18)``."""
    if not abs(value) < 1e18:
        return None
    return Decimal(repr(value)).quantize(PLACES, ROUND_HALF_UP, WIDE)


def _mean(errors) -> float:
    """Mean of (residual, its decimal) pairs: the decimals' sum doesn't depend on their order."""
    if any(d is None for _, d in errors):
        return sum(e for e, _ in errors) / len(errors)
    return float(WIDE.divide(sum(d for _, d in errors), Decimal(len(errors))).quantize(PLACES, ROUND_HALF_UP, WIDE))


def _columns(batches: Iterator[pd.DataFrame], width: int) -> tuple[np.ndarray, ...]:
    """Times, ids, residuals and slopes of all frames as flat arrays: no frame and no object per row is kept."""
    parts = [[], [], [], []]
    for pdf in batches:
        slopes = np.full((len(pdf), width), np.nan)
        for i, slope in enumerate(pdf["gradient"]):
            if slope is not None:
                slopes[i] = slope
        for values, name in zip(parts, ("ts", "event_id", "residual")):
            values.append(np.array(pdf[name].to_numpy()))
        parts[3].append(slopes)
    out = []
    while parts:
        out.append(np.concatenate(parts.pop(0)))
    return tuple(out)


def replay(df: DataFrame, *, key: str, order, residual: str = "residual", window: int = MONITOR_WINDOW,
           block_rows: int = ROWS_PER_RANGE, rows_per_range: int | None = None) -> DataFrame:
    """Rolling mean of the last residuals per stream with the action it triggers.

    Residuals are summed as decimals: a mean that equals a limit isn't beyond it, in whatever order its terms are added, and replay
    and stream agree.  Streams are cut into blocks by row number and each block also receives the few rows before it, so one busy stream
    is spread over many tasks.
    """
    numbered = row_numbers(df, [key], list(order), "seq", rows_per_range=rows_per_range)
    block = F.floor((F.col("seq") - 1) / F.lit(block_rows))
    near_end = (F.col("seq") - 1) % block_rows >= block_rows - (window - 1)
    homes = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    placed = numbered.withColumn("_own", block).withColumn("_block", F.explode(homes))
    recent = Window.partitionBy(key, "_block").orderBy("seq").rowsBetween(-(window - 1), 0)
    fits = F.abs(F.col(residual).cast("double")) < 1e18
    placed = placed.withColumn("_exact", F.when(fits, F.col(residual).cast("double").cast(f"decimal(38,{DECIMALS})")))
    n, known = F.count(residual).over(recent), F.count("_exact").over(recent)
    mean = (F.sum("_exact").over(recent) / F.nullif(known, F.lit(0)).cast("decimal(10,0)")).cast("double")
    scored = placed.withColumn("streaming_error", F.when(n == known, mean).otherwise(F.avg(residual).over(recent))).where(F.col("_own") == F.col("_block"))
    return scored.drop("_own", "_block", "_exact").withColumn("action", update_action("streaming_error"))


def abstain(df: DataFrame, proba: str = "p") -> DataFrame:
    """Entropy band of each prediction; stateless, the same on batch and stream."""
    return df.withColumn("entropy", entropy(proba)).withColumn("decision", abstain_decision("entropy")).withColumn(
        "abstain", F.col("decision") != "serve")


OUTPUT = "key string, event_id bigint, ts timestamp, residual double, streaming_error double, action string, weights array<double>"
STATE = "errors array<double>, weights array<double>"


def monitor_stream(stream: DataFrame, *, key: str, anchor: list[float], ts: str = "ts", event_id: str = "event_id",
                   residual: str = "residual", gradient: str | None = None, delay: str | None = None, window: int = MONITOR_WINDOW,
                   soft: float = ERROR_SOFT, hard: float = ERROR_HARD, rate: float = ONLINE_RATE,
                   proximal: float = PROXIMAL_RATE) -> DataFrame:
    """Stateful monitor on a stream.

    State per stream id: the last residuals and the current fusion weights.  Within a micro-batch rows are taken by
    event time, then id; a row that comes in a later batch than its successors counts when it comes.  No row is dropped
    unless ``delay`` asks for it: then rows later than that behind the newest are.  Weights move only on a soft update.
    The order within a stream id is the operator's meaning, so one id's rows of one batch are one task's work; bound them
    by the source's batch size.
    """
    start = np.asarray(anchor, dtype=float)

    def step(ident, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            return
        held, weights = ([], start) if not state.exists else (state.get[0], np.asarray(state.get[1], dtype=float))
        errors = deque(((e, _exact(e)) for e in held), maxlen=window)
        # results leave in frames of bounded size
        ts, ids, residuals, slopes = _columns(batches, len(start))
        order = np.lexsort((ids, ts))
        for low in range(0, len(order), 10_000):
            means, actions, moved_to, part = [], [], [], order[low:low + 10_000]
            for i in part:
                error = float(residuals[i])
                errors.append((error, _exact(error)))
                mean = _mean(errors)
                action = "full_retrain" if mean > hard else "soft_update" if mean > soft else "no_update"
                if action == "soft_update":
                    moved = np.maximum(weights - rate * slopes[i] - proximal * (weights - start), 0.0)
                    weights = moved / moved.sum() if moved.sum() > 0 else np.full(len(moved), 1.0 / len(moved))
                means.append(mean)
                actions.append(action)
                moved_to.append(weights.tolist())
            yield pd.DataFrame({"key": ident[0], "event_id": ids[part], "ts": ts[part], "residual": residuals[part], "streaming_error": means,
                                "action": actions, "weights": moved_to})
        state.update(([e for e, _ in errors], weights.tolist()))

    slope = F.col(gradient) if gradient else F.array(*[F.lit(0.0) for _ in anchor])
    slim = stream.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("bigint").alias("event_id"),
                         F.col(ts).cast("timestamp").alias("ts"), F.col(residual).cast("double").alias("residual"), slope.alias("gradient"))
    timed = slim.withWatermark("ts", delay) if delay else slim
    return timed.groupBy("key").applyInPandasWithState(
        step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout if delay else GroupStateTimeout.NoTimeout)
