"""Source mix: targets against water filling by steps, exact quotas, limits per document."""

import random

import numpy as np
import pytest

from cohortry.llm.mixing import mix, output_shards, split_quotas, targets


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: [3.0, 1.0, 2.0][i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= 2.0 * sizes[s]
        free -= over
    return out


def rows(seed, n=3000):
    pick = random.Random(seed)
    names = ["b", "a", "Z", "é", "", "mid", None, "tiny"]
    out = []
    for i in range(n):
        source = pick.choices(names, weights=[300, 100, 50, 80, 20, 200, 60, 1])[0]
        out.append((i, " ".join(["w"] * int(pick.expovariate(0.02))), source))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    data = rows(seed) + [(5000, None, "b"), (5001, "", None), (None, "x y z", "b"), (7, "same words", "a"), (7, "same words", "a")]
    table = spark.createDataFrame([(*r, 9, "s") for r in data], "doc_id long, text string, source string, size int, shard string")
    mixed = mix(table)
    got = mixed.collect()
    assert len(got) == len(data)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["row"]["source"]] = sizes.get(r["row"]["source"], 0) + r["size"]
        taken[r["row"]["source"]] = taken.get(r["row"]["source"], 0) + r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["size"] == len((r["row"]["text"] or "").split()) and r["row"]["size"] == 9
    goal = brute_targets(sizes)
    for r in got:
        s = r["row"]["source"]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(goal[s])
    longest = max(r["size"] for r in got)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= longest
    again = sorted((str(r["row"]), r["taken"], str(r["draws"])) for r in mix(table.repartition(7)).collect())
    assert again == sorted((str(r["row"]), r["taken"], str(r["draws"])) for r in got)
    out = output_shards(mixed)
    assert out.count() == sum(r["copies"] for r in got)


def test_targets_with_one_source_and_none(spark):
    one = spark.createDataFrame([("a", 10)], "source string, size long")
    assert [tuple(r) for r in targets(one).collect()] == [("a", 10, 15.0)]
    assert targets(one.where("false")).collect() == []
    zero = spark.createDataFrame([("a", 0), ("b", 4)], "source string, size long")
    assert sorted(tuple(r) for r in targets(zero).collect()) == [("a", 0, 0.0), ("b", 4, 6.0)]


def test_quotas_are_split_exactly():
    quotas = np.array([10, 0, 300, 7])
    for shards in (1, 3, 16):
        parts = split_quotas(quotas, shards, seed=5)
        assert parts.shape == (shards, 4) and (parts.sum(axis=0) == quotas).all() and (parts >= 0).all()
        assert np.ptp(parts.sum(axis=1)) <= np.ceil(np.log2(shards)) + 1
        assert (parts == split_quotas(quotas, shards, seed=5)).all()


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
