"""Top-k against all scores."""

import random

import numpy as np

from cohortry.llm.topk import LEAST, BoxTree, SearchSettings, top_k


def brute(rows, k):
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in whole:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_all_scores(spark):
    pick = random.Random(1)
    rows = [(i, [pick.uniform(-1, 1) for _ in range(6)]) for i in range(700)]
    rows += [(i, [float(pick.randint(-1, 1))] * 6) for i in range(700, 800)]  # ties
    rows += [(800, None), (801, []), (802, [None] * 6), (803, [float("nan")] * 6), (820, [float("inf")] + [0.0] * 5), (None, [0.5] * 6)]
    rows += [(840, [1.0, 2.0]), (841, [3.0, -1.0]), (860, [1e7, 3e7]), (880, [0.0] * 9)]
    table = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, score int")
    for settings in (SearchSettings(), SearchSettings(k=3, shard_rows=90, leaf=16, block=7, wave=2)):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(table, table.where("vec_id % 20 = 0"), settings=settings).collect())
        assert got == brute(rows, settings.k)


def test_repeated_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(table, table.where("vec_id = 0")).collect())
    assert got == [(0, 1, 1, 8192), (0, 2, 1, 8192), (0, 3, 2, 0)]
    assert top_k(table.where("false"), table).collect() == []
    assert top_k(table, table.where("false")).collect() == []


def test_tree_boxes_hold_their_rows_and_prune():
    pick = np.random.default_rng(3)
    rows = pick.integers(-64, 64, (3000, 3)).astype(float)
    tree = BoxTree(np.arange(3000), rows, 64)
    for low, high, left, _, a, b in tree.nodes:
        assert (tree.rows[a:b] >= low).all() and (tree.rows[a:b] <= high).all()
        assert left >= 0 or b - a <= 64
    floor = np.full(1, LEAST)
    ids, scores = tree.search(np.array([-1]), rows[:1], floor, 5)
    best = sorted(zip(-(rows @ rows[0]), range(3000)))[:5]
    assert ids[0].tolist() == [i for _, i in best] and scores[0].tolist() == [int(-s) for s, _ in best]
