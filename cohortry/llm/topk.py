"""Exact top-k by inner product: a KD-tree per shard, searched best box first by blocks of queries."""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.session import durable


#: stands for no score; its negative is a long as well
LEAST = -(2**63) + 1


@dataclass(frozen=True)
class SearchSettings:
    """`shard_rows`: vectors of a shard, about; `leaf`: of a tree leaf; `block`: queries that walk a tree together; `wave`: blocks of a
    task."""

    k: int = 20
    scale: float = 64.0
    shard_rows: int = 16_384
    leaf: int = 512
    block: int = 512
    wave: int = 64


class BoxTree:
    """Median splits on the widest side, down to `leaf` rows; every node has the tight box of its rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int):
        self.nodes: list[tuple] = []  # low, high, left, right, from, to
        self.order = np.arange(len(ids))
        self.rows, self.ids = rows, ids
        self._split(0, len(ids), leaf)
        self.rows, self.ids = rows[self.order], ids[self.order]

    def _split(self, a: int, b: int, leaf: int) -> int:
        part = self.rows[self.order[a:b]]
        low, high = part.min(axis=0), part.max(axis=0)
        at = len(self.nodes)
        self.nodes.append(())
        left = right = -1
        if b - a > leaf and (high > low).any():
            side = int((high - low).argmax())
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, side], mid, kind="introselect")]
            left, right = self._split(a, a + mid, leaf), self._split(a + mid, b, leaf)
        self.nodes[at] = (low, high, left, right, a, b)
        return at

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows per query: higher score, then smaller id; -1 and the least integer where there are fewer.

        No row of a box scores above the sum of the larger products with its sides, so the box with the highest bound among the
        queries that can still gain from it comes first; a query is left out of boxes under its k-th score so far, which
        begins at `floor`.
        """
        best_id = np.full((len(ids), k), -1, dtype=np.int64)
        best = np.full((len(ids), k), LEAST, dtype=np.int64)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        floor = floor.copy()

        def bound(node: int, who: np.ndarray) -> np.ndarray:
            low, high = self.nodes[node][:2]
            return up[who] @ high + down[who] @ low

        everyone = np.arange(len(ids))
        first = bound(0, everyone)
        heap = [(-first.max(), 0, everyone, first)]
        while heap:
            _, node, who, limits = heapq.heappop(heap)
            who = who[limits >= floor[who]]
            if not len(who):
                continue
            _, _, left, right, a, b = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    limits = bound(child, who)
                    open_ = limits >= floor[who]
                    if open_.any():
                        heapq.heappush(heap, (-limits[open_].max(), child, who[open_], limits[open_]))
                continue
            scores = (queries[who] @ self.rows[a:b].T).astype(np.int64)
            there = np.broadcast_to(self.ids[a:b], scores.shape)
            scores = np.where((there == ids[who, None]) | (scores < floor[who, None]), LEAST, scores)
            gains = np.flatnonzero(scores.max(axis=1) > LEAST)
            who, scores, there = who[gains], scores[gains], there[gains]
            all_scores, all_ids = np.hstack((best[who], scores)), np.hstack((best_id[who], there))
            top = _top(all_scores, all_ids, k)
            best[who] = np.take_along_axis(all_scores, top, axis=1)
            best_id[who] = np.take_along_axis(all_ids, top, axis=1)
            floor[who] = np.maximum(floor[who], best[who, -1])
        best_id[best == LEAST] = -1
        return best_id, best


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores per row, ties to smaller ids, in order."""
    edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(scores), k), dtype=np.int64)
    for r in range(len(scores)):
        may = np.flatnonzero(scores[r] >= edge[r])
        out[r] = may[np.lexsort((ids[r, may], -scores[r, may]))][:k]
    return out


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Rows (id, v): floor(scale * component) as whole doubles. Null ids, null or empty vectors and such with a null, NaN or infinite
    component are left out."""
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return given.where(F.col("id").isNotNull() & (F.size("v") > 0) & sound).select(
        "id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("v")
    )


def _dump(frame: pd.DataFrame) -> bytes:
    """Ids and components, as the smallest integers that hold them."""
    values = np.stack([np.asarray(v, dtype=np.float64) for v in frame["v"]]).astype(np.int64)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.abs(values).max(initial=0) <= np.iinfo(t).max)
    return pickle.dumps((frame["id"].to_numpy(np.int64), values.astype(kind)), protocol=5)


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """Doubles where no product sum can pass 2**53; else longs: slower, and exact as long as a score fits into one."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return np.float64 if most < 2.0**53 else np.int64


def _packed(rows: DataFrame, by: str, size: int) -> DataFrame:
    """Groups of about `size` rows as one row each: (number, dims, ids, matrix)."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        return pd.DataFrame({
            by: [frame[by].iloc[0]], "dims": [frame["dims"].iloc[0]],
            "packed": [_dump(frame)],
        })

    per_dims = {r["dims"]: r["count"] for r in rows.groupBy(F.size("v").alias("dims")).count().collect()}
    groups = F.lit(1)
    for dims, n in per_dims.items():  # one entry per vector length
        groups = F.when(F.col("dims") == dims, F.lit(max(1, -(-n // size)))).otherwise(groups)
    numbered = rows.withColumn("dims", F.size("v")).withColumn(by, F.pmod(F.xxhash64(F.lit(by), "id"), groups).cast("long"))
    return numbered.groupBy("dims", by).applyInPandas(pack, f"{by} long, dims int, packed binary")


def top_k(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: SearchSettings = SearchSettings()
) -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score): the k vectors with the highest integer inner product with every query.

    Ties go to the smaller vec_id; a query never meets rows of its own id; fewer rows than k are all returned. Rows that `quantised`
    leaves out take no part. Vectors meet those of their own length. Repeated query rows count once; vectors that share an id are
    candidates each. Other columns aren't read. Empty tables give an empty result.

    Vectors are hashed to shards and queries to blocks of bounded size. Every block first searches one shard, which gives each query
    a k-th score to start from; with it the blocks go to all other shards, whose boxes under that score are passed over. Each
    shard's tree is built once per task and keeps no more than k rows per query; shards' results are merged by rank.
    """
    s = settings
    shards = durable(_packed(quantised(vectors, id_col, vector_col, s.scale), "shard", s.shard_rows))
    asked = durable(_packed(quantised(queries, id_col, vector_col, s.scale).distinct(), "block", s.block))
    homes = shards.groupBy("dims").agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    pairs = durable(asked.select("dims", "block").join(homes, "dims").select(
        "dims", "block", F.posexplode("shards").alias("at", "shard"), F.pmod("block", F.size("shards")).alias("home")
    ))
    pairs = pairs.withColumn("wave", F.floor(F.col("block") / s.wave))
    none = F.lit(None).cast("binary")
    first = pairs.where("at = home").join(asked, ["dims", "block"]).withColumn("floors", none)
    home = durable(_searched(first, shards, s))
    floors = home.groupBy("dims", "block").agg(F.max("floors").alias("floors"))
    rest = pairs.where("at != home").join(asked, ["dims", "block"]).join(floors, ["dims", "block"])
    found = home.unionByName(_searched(rest, shards, s))

    def rows(batches):
        for batch in batches:
            for dims, packed in zip(batch["dims"], batch["found"]):
                query, number, ids, scores = pickle.loads(packed)
                at, place = np.nonzero(scores != LEAST)
                yield pd.DataFrame({"dims": dims, "query_id": query[at], "number": number[at], "vec_id": ids[at, place], "score": scores[at, place]})

    flat = found.select("dims", "found").mapInPandas(rows, "dims int, query_id long, number long, vec_id long, score long")
    order = Window.partitionBy("query_id", "dims", "number").orderBy(F.desc("score"), "vec_id")
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searched(asked: DataFrame, shards: DataFrame, s: SearchSettings) -> DataFrame:
    """Blocks against the shards they are paired with, a wave of blocks at a time: (dims, block, floors, found)."""

    def run(key, shard: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(blocks):
            ids, rows = pickle.loads(shard["packed"].iloc[0])
            blocks = [(b, *pickle.loads(p), f) for b, p, f in zip(blocks["block"], blocks["packed"], blocks["floors"])]
            kinds = {kind: BoxTree(ids, rows.astype(kind), s.leaf) for kind in {_exact(rows, w) for _, _, w, _ in blocks}}
            for block, query, wanted, floors in blocks:
                kind = _exact(rows, wanted)
                start = np.full(len(query), LEAST, dtype=np.int64) if floors is None else np.frombuffer(floors, dtype=np.int64)
                found, scores = kinds[kind].search(query, wanted.astype(kind), start, s.k)
                # query rows that share an id are told apart by their place in the block
                result = pickle.dumps((query, block * (1 << 20) + np.arange(len(query)), found, scores), protocol=5)
                out.append((key[0], block, scores[:, -1].tobytes(), result))
        return pd.DataFrame(out, columns=["dims", "block", "floors", "found"])

    waves = asked.select(F.col("dims").alias("d"), F.col("shard").alias("s"), F.col("wave").alias("w")).distinct()
    sent = shards.join(waves, (F.col("dims") == F.col("d")) & (F.col("shard") == F.col("s"))).select("d", "s", "w", "packed")
    left = sent.groupBy("d", "s", "w")
    right = asked.select("dims", "shard", "wave", "block", "packed", "floors").groupBy("dims", "shard", "wave")
    return left.cogroup(right).applyInPandas(run, "dims int, block long, floors binary, found binary")
