"""Mixing sources to target weights: block quotas split among output shards by a multivariate-hypergeometric tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.session import durable

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)


def _small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Marked for broadcast if it was counted to hold few rows; else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, most: float = 2.0) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size), sources by code point with null last.

    Targets are the weighted shares of `share` times all sizes, held to `most` times a source's size; what is cut goes to the others
    by weight until none is above. In closed form: in order of cap over weight, a source is at its cap as long as the rest,
    shared by the remaining weights, would exceed it. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    listed = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("at", F.row_number().over(by_name) - 1)
    listed = listed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * float(most)
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "at")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * float(share)
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    listed = listed.withColumn("level", level).withColumn("capped", level * F.col("weight") >= cap)
    # levels fall until the first source under its cap; from there on the level is that source's
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), "at", "level"))).over(Window.partitionBy())["level"]
    return listed.select(
        "source", "source_size", F.least(cap, F.coalesce(free, F.col("level")) * F.col("weight")).cast("double").alias("target")
    )


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of every source (columns) for every shard (rows): each tree node draws its left part without replacement."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def divide(lo: int, hi: int, counts: np.ndarray, node: int) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        left = int(counts.sum()) * (mid - lo) // (hi - lo)
        draw = np.random.Generator(np.random.Philox(key=[seed, node])).multivariate_hypergeometric(counts, left, method="marginals")
        divide(lo, mid, draw, 2 * node)
        divide(mid, hi, counts - draw, 2 * node + 1)

    divide(0, shards, np.asarray(quotas, dtype=np.int64), 1)
    return out


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5,
    weights: tuple[float, ...] = WEIGHTS, most: int = 2, shards: int = 16, blocks: int = 256, seed: int = 7,
) -> DataFrame:
    """One row per row of `docs`: `row` (a struct of its own columns), size, source_size, target, taken, copies, and `draws`:
    for each copy the output `shard` and its `place` there (the rows of a shard in order of place are shuffled).

    The rows of a source are dealt to `blocks` hashed blocks, permuted by a keyed order. Going through them `most` times, as many
    whole blocks are drawn as the target holds; the block at the edge is drawn row by row, up to the sum nearest the target. A
    source's drawn blocks are its quota; a tree of multivariate-hypergeometric draws splits the quotas into shards, which take
    disjoint runs of the permuted blocks. Only sums per (source, block) and quotas are gathered: `blocks` rows per source.

    A row is drawn once per pass at most, so no row exceeds `most` times its size. Equal rows stay in one block, in any order (the
    result is the same). Null texts have size 0 and no word to take; null sources are a source of their own, after all others;
    null ids are dealt by their text. Other columns may have any name. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.when(F.col(id_col).isNull(), text))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(source_col).cast("string").alias("_source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"), key.alias("_key"),
    ).withColumn("_block", F.pmod(F.xxhash64(F.lit("block"), "_key"), F.lit(blocks)).cast("int"))
    light = durable(rows.select("_source", "_block", "_key", "_size"))
    goal = targets(light.select(F.col("_source").alias("source"), F.col("_size").alias("size")), share, weights, most)

    order = F.xxhash64(F.lit("order"), F.lit(seed), "source", "_block")
    permuted = Window.partitionBy("source").orderBy(order, "_block")
    sums = light.groupBy(F.col("_source").alias("source"), "_block").agg(F.sum("_size").alias("block_size"))
    goal = goal.withColumnRenamed("source", "s0")
    sums = durable(sums.join(goal, F.col("source").eqNullSafe(F.col("s0"))).drop("s0"))
    plan = (
        sums.withColumn("place", F.row_number().over(permuted) - 1)
        .withColumn("end", F.sum("block_size").over(permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .withColumn("stop", F.col("pass") * F.col("source_size") + F.col("end"))
        .withColumn("start", F.col("stop") - F.col("block_size"))
    )
    # left: the words still to take when the block begins; whole blocks have at least their size
    plan = plan.withColumn("left", F.col("target") - F.col("start")).where("left > 0 or (block_size = 0 and left >= 0)")
    plan = durable(plan.select("source", "_block", "pass", "place", "left", "block_size", "source_size", "target"))

    counted = plan.groupBy("source").count().orderBy(F.col("source").isNull(), F.col("source").cast("binary")).collect()
    quotas = split_quotas(np.array([r["count"] for r in counted], dtype=np.int64), shards, seed) if counted else np.zeros((shards, 0), np.int64)
    ends = np.cumsum(quotas, axis=0)
    deal = docs.sparkSession.createDataFrame(
        [(r["source"], int(k), int(ends[k, j] - quotas[k, j]), int(ends[k, j])) for j, r in enumerate(counted) for k in range(shards) if quotas[k, j]],
        "s3 string, shard int, first int, last int",
    )
    turn = Window.partitionBy("source").orderBy("pass", "place")
    numbered = plan.withColumn("n", F.row_number().over(turn) - 1)
    dealt = numbered.join(_small(deal), F.col("source").eqNullSafe(F.col("s3")) & (F.col("n") >= F.col("first")) & (F.col("n") < F.col("last")))
    # one row per (source, block): its whole draws, and at most one draw cut within the block
    draws = dealt.groupBy(F.col("source").alias("s1"), F.col("_block").alias("b1")).agg(
        F.array_sort(F.collect_list(F.struct("pass", "shard", F.when(F.col("left") < F.col("block_size"), F.col("left")).alias("cut")))).alias("draws"),
    )
    cut = draws.select("s1", "b1", F.expr("get(filter(draws, d -> d.cut is not null), 0)").alias("d")).where("d is not null")
    edge = light.join(_small(cut), F.col("_source").eqNullSafe(F.col("s1")) & (F.col("_block") == F.col("b1")))
    within = Window.partitionBy("_source", "_block").orderBy("_key", "_size")
    edge = edge.withColumn("upto", F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a row goes in when most of it lies before the edge
    last = edge.where(F.col("upto") - F.col("_size") / 2 <= F.col("d.cut")).groupBy(F.col("_source").alias("s2"), F.col("_block").alias("b2")).agg(
        F.max(F.struct("_key", "_size")).alias("last")
    )
    final = sums.join(draws, F.col("source").eqNullSafe(F.col("s1")) & (F.col("_block") == F.col("b1")), "left")
    final = final.join(last, F.col("source").eqNullSafe(F.col("s2")) & (F.col("_block") == F.col("b2")), "left")
    final = _small(durable(final.select(F.col("source").alias("_s"), F.col("_block").alias("_b"), "source_size", "target", "draws", "last")))
    out = rows.join(final, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    mine = F.struct("_key", "_size")
    taken = F.filter(
        F.coalesce(F.col("draws"), F.array().cast("array<struct<pass:int,shard:int,cut:double>>")),
        lambda d: d["cut"].isNull() | F.coalesce(mine <= F.col("last"), F.lit(False)),
    )
    places = F.transform(taken, lambda d: F.struct(d["shard"].alias("shard"), F.xxhash64(F.lit("place"), "_key", d["pass"]).alias("place")))
    out = out.select("row", F.col("_size").alias("size"), "source_size", "target", places.alias("draws"))
    return out.select("row", "size", "source_size", "target", (F.size("draws") * F.col("size")).alias("taken"), F.size("draws").alias("copies"), "draws")


def output_shards(mixed: DataFrame) -> DataFrame:
    """The mix itself, one row per copy: `row`, shard and place; order by place within a shard to read it shuffled."""
    return mixed.select("row", F.explode("draws").alias("d")).select("row", F.col("d.shard").alias("shard"), F.col("d.place").alias("place"))
