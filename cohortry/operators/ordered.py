"""Ordered computations over whole tables without sending one group to one task.

A window ordered over a hot key (or over no key) runs in a single task.  Here rows are first cut into contiguous
ranges of the full ordering; each range is a window partition of bounded size, and only one small total per range
travels between them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.session import durable

ROWS_PER_RANGE = 500_000
BROADCAST_ROWS = 500_000
HOT_SHARE = 200

RANGE = "_range"


@dataclass
class Ranged:
    """Rows with a range number that grows along (keys, order)."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    ranges: int


def cut_ranges(df: DataFrame, keys, order, *, rows_per_range: int | None = None, durable_input: bool = False,
               rows: int | None = None) -> Ranged:
    """Cut rows into contiguous ranges of (keys, order); one range when the count shows it is small.

    ``rows`` is a known row count (a table scan answers it from file footers); otherwise the input is made durable and
    counted, so an expensive input is computed once.
    """
    keys, order = list(keys), list(order)
    limit = rows_per_range or ROWS_PER_RANGE
    source = df if durable_input or rows is not None else durable(df)
    ranges = max(1, math.ceil((source.count() if rows is None else rows) / limit))
    if ranges == 1:
        return Ranged(source.withColumn(RANGE, F.lit(0)), keys, order, 1)
    cut = source.repartitionByRange(ranges, *keys, *order).withColumn(RANGE, F.spark_partition_id())
    return Ranged(durable(cut), keys, order, ranges)


def _combine(op: str, carried: Column, local: Column) -> Column:
    if op == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if op == "product":
        return F.coalesce(carried, F.lit(1.0)) * F.coalesce(local, F.lit(1.0))
    return F.coalesce(local, carried)


def _aggregate(op: str, c: Column) -> Column:
    return {"sum": F.sum, "product": F.product, "last": lambda x: F.last(x, ignorenulls=True)}[op](c)


def accumulate(ranged: Ranged, measures: dict[str, tuple[str, Column]], *, descending: bool = False,
               exclusive: bool = False) -> Ranged:
    """Cumulative sum, product or last non-null value along the order within the keys.

    The order must be unique within the keys.  Only a key that crosses a range border needs a carried value, so the
    carried table has at most two rows per range and is safe to broadcast.
    """
    direction = [F.desc(c) if descending else F.asc(c) for c in ranged.order]
    span = Window.partitionBy(*ranged.keys, RANGE).orderBy(*direction)
    span = span.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    if ranged.ranges == 1:
        out = ranged.rows.select("*", *[
            _combine(op, F.lit(None), _aggregate(op, c).over(span)).alias(name) for name, (op, c) in measures.items()])
        return Ranged(out, ranged.keys, ranged.order, 1)

    edge_rows = ranged.rows
    if ranged.keys:
        key = F.struct(*ranged.keys)
        borders = ranged.rows.groupBy(RANGE).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
        edge_rows = (ranged.rows.join(F.broadcast(borders), RANGE)
                     .where((key == F.col("_first")) | (key == F.col("_last"))))
    group = [*ranged.keys, RANGE]
    inner_order = F.struct(*ranged.order)
    outermost = F.min_by if descending else F.max_by
    partial = edge_rows.groupBy(*group).agg(*[
        (_aggregate(op, c) if op != "last" else outermost(c, F.when(c.isNotNull(), inner_order))).alias(f"_p_{name}")
        for name, (op, c) in measures.items()])
    before = (Window.partitionBy(*ranged.keys).orderBy(F.desc(RANGE) if descending else F.asc(RANGE))
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = partial.select(*group, *[
        _aggregate(op, F.col(f"_p_{name}")).over(before).alias(f"_c_{name}") for name, (op, _) in measures.items()])
    local = ranged.rows.select("*", *[
        _aggregate(op, c).over(span).alias(f"_l_{name}") for name, (op, c) in measures.items()])
    joined = local.join(F.broadcast(carried), group, "left")
    kept = [c for c in ranged.rows.columns]
    out = joined.select(*kept, *[
        _combine(op, F.col(f"_c_{name}"), F.col(f"_l_{name}")).alias(name) for name, (op, _) in measures.items()])
    return Ranged(out, ranged.keys, ranged.order, ranged.ranges)


def row_numbers(df: DataFrame, keys, order, name: str = "seq", *, rows_per_range: int | None = None,
                rows: int | None = None) -> DataFrame:
    """One-based position of each row within its keys."""
    ranged = cut_ranges(df, keys, order, rows_per_range=rows_per_range, rows=rows)
    return accumulate(ranged, {name: ("sum", F.lit(1).cast("bigint"))}).rows.drop(RANGE)


def next_values(df: DataFrame, keys, order, values: dict[str, Column], *, rows_per_range: int | None = None,
                rows: int | None = None) -> DataFrame:
    """Values of the following row within the keys, null on the last row."""
    ranged = cut_ranges(df, keys, order, rows_per_range=rows_per_range, rows=rows)
    packed = F.struct(*[c.alias(n) for n, c in values.items()])
    if ranged.ranges == 1:
        ordered = Window.partitionBy(*ranged.keys).orderBy(*ranged.order)
        return ranged.rows.select(*df.columns, *[F.lead(c).over(ordered).alias(n) for n, c in values.items()])
    whole = ranged.rows.withColumn("_packed", packed)
    nearest = {"_ahead": ("last", F.col("_packed"))}
    ahead = accumulate(Ranged(whole, ranged.keys, ranged.order, ranged.ranges), nearest, descending=True, exclusive=True)
    return ahead.rows.select(*df.columns, *[F.col(f"_ahead.{n}").alias(n) for n in values])


def step_lookup(queries: DataFrame, steps: DataFrame, *, time: str, value: str, keys=(), before: bool = False,
                default: float | None = None, rows_per_range: int | None = None) -> DataFrame:
    """Value of a step function at each distinct query time (per key).

    ``before`` takes the limit from the left.  Query times are made distinct first, so a time shared by many rows is
    looked up once; join the result back with :func:`enrich`.
    """
    keys = list(keys)
    # a step sorts ahead of a query at the same time unless the left limit is wanted
    asked = queries.select(*keys, time).distinct().withColumn("_side", F.lit(0 if before else 1)) \
        .withColumn("_v", F.lit(None).cast("double"))
    known = steps.select(*keys, time, F.lit(1 if before else 0).alias("_side"), F.col(value).cast("double").alias("_v"))
    ranged = cut_ranges(known.unionByName(asked), keys, [time, "_side"], rows_per_range=rows_per_range)
    found = accumulate(ranged, {"_found": ("last", F.col("_v"))}).rows
    result = F.col("_found") if default is None else F.coalesce("_found", F.lit(float(default)))
    return found.where(F.col("_side") == (0 if before else 1)).select(*keys, time, result.alias(value))


def enrich(rows: DataFrame, table: DataFrame, on, *, size_column: str | None = None, how: str = "left",
           broadcast_rows: int | None = None) -> DataFrame:
    """Join a durable table with unique keys to rows.

    A table counted as small is broadcast.  A larger one is shuffled; keys that ``size_column`` shows to hold more
    than 1/200 of all rows (so at most 200 keys) are salted on the row side and repeated on the table side.
    """
    on = [on] if isinstance(on, str) else list(on)
    if table.count() <= (BROADCAST_ROWS if broadcast_rows is None else broadcast_rows):
        return rows.join(F.broadcast(table), on, how)
    if size_column is None:
        return rows.join(table, on, how)
    whole = table.agg(F.sum(size_column)).first()[0] or 0
    hot = table.where(F.col(size_column) > whole / HOT_SHARE).select(*on).collect()
    if not hot:
        return rows.join(table, on, how)
    is_hot = F.coalesce(F.col(on[0]).isin([key[0] for key in hot]), F.lit(False)) if len(on) == 1 else F.lit(False)
    for key in hot if len(on) > 1 else []:
        match = F.lit(True)
        for name in on:
            match = match & F.col(name).eqNullSafe(F.lit(key[name]))
        is_hot = is_hot | match
    salted_rows = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(HOT_SHARE))).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_SHARE - 1))).otherwise(F.array(F.lit(0)))
    salted_table = table.withColumn("_salt", F.explode(copies)).withColumn("_salt", F.col("_salt").cast("bigint"))
    return salted_rows.join(salted_table, [*on, "_salt"], how).drop("_salt")
