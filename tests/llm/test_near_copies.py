"""Candidates of the near-duplicate stage."""

import random

from pyspark.sql import functions as F

from cohortry.llm.simhash import CopySettings, _common_runs, _print, _print_pairs, _signatures, near_copy_pairs, one_of_each_group
from cohortry.session import durable


def test_simhash_links_are_candidates(spark):
    """Near copies of one template: SimHash proposes at most a pair a text, and those that are similar are links."""
    pick = random.Random(4)
    template = [f"t{i}" for i in range(400)]
    rows = []
    for k in range(1200):
        words = list(template)
        for at in pick.sample(range(400), 3):
            words[at] = f"x{k}-{at}"
        rows.append((k, " ".join(words)))
    s = CopySettings()
    raw = spark.createDataFrame(rows, "id long, text string").select("id", F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("raw"))
    nodes = durable(raw.select("id", "tag", _print("raw").alias("print"), _signatures(_common_runs(raw, s), s)("raw").alias("of")).select("id", "tag", "print", "of.*"))
    by_print = {(r.a, r.b) for r in _print_pairs(nodes.select("tag", "print"), s.radius, s.crowded).collect()}
    assert 100 < len(by_print) < 1200
    near = {(r.a, r.b) for r in near_copy_pairs(raw, nodes, s).collect()}
    sets = {r.tag: {tuple(w[i : i + 5]) for i in range(396) for w in [r.words]} for r in raw.select("tag", F.split(F.col("raw").cast("string"), " ").alias("words")).collect()}
    assert {(a, b) for a, b in by_print if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} <= near
    assert [r.id for r in one_of_each_group(spark.createDataFrame(rows, "id long, text string"), "id").select("id").collect()] == [0]


def test_family_of_short_texts_that_are_too_different(spark):
    """One edit each in texts of 50 words: pairs stay under 0.8, but for those to the template and to the longer text."""
    pick = random.Random(5)
    template = [f"t{i}" for i in range(50)]
    texts = []
    for k in range(600):
        words = list(template)
        words[8 + k % 37] = f"x{k}"
        texts.append(" ".join(words))
    texts += [" ".join(template), texts[7] + " tail"]
    found = [r.id for r in one_of_each_group(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").select("id").collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if like(sets[a], sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(found) == sorted({find(k) for k in range(len(texts))})
