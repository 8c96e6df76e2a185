"""Class-based scores: exact counts, a proper distribution, clustering that improves."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from cohortry.llm.brown import BrownSettings, brown_scores, exchange, fit_brown


def rows(seed, n=120):
    pick = random.Random(seed)
    nouns, verbs = [f"noun{i}ab" for i in range(30)], [f"verb{i}cd" for i in range(30)]
    return [(i, " ".join(f"{pick.choice(nouns)} {pick.choice(verbs)}" for _ in range(pick.randint(0, 12))).upper() + (f" only{i}" if i % 7 == 0 else "")) for i in range(n)]


def test_base_is_exact_and_model_is_better(spark):
    data = rows(1) + [(500, None), (501, ""), (None, "noun1ab new"), (7, "same row"), (7, "same row"), (502, " \t one\n")]
    table = spark.createDataFrame([(i, t, 0.0) for i, t in data], "doc_id long, text string, score double")
    got = brown_scores(table, settings=BrownSettings(frequent=20, endings=5, classes=6, near=30)).collect()
    fold = lambda i: crc32(str(i).encode() if i is not None else b"") % 10
    tokens = lambda t: (t or "").lower().split() + ["\n"]
    c = Counter(w for i, t in data if fold(i) for w in tokens(t))
    total, types = sum(c.values()), len(c)
    want = Counter()
    for i, t in data:
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (types + 1))) for w in tokens(t))
        want[(i, fold(i) == 0, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), total, round(base, 8))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up(spark):
    data = [(t.encode(),) for _, t in rows(2)]
    table = spark.createDataFrame(data, "raw binary")
    model, counts, _ = fit_brown(table, BrownSettings(frequent=10, endings=3, classes=5, near=25))
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    for k in range(int(model.of.max()) + 1):
        assert np.isclose((10 ** model.emission[model.of == k]).sum(), 1)
    mass = np.zeros(len(model.of))
    for r in counts.collect():
        mass[model.items.codes([bytes(r.word)])[0] & 0xFFFF] += r.c + 0.1
    for item in np.flatnonzero(~model.single):
        assert np.isclose((mass[item] + 0.1) / 10 ** model.spread[item], 1)


def test_exchange_raises_likelihood_and_finds_two_kinds():
    pick = random.Random(4)
    n = 21
    pairs = np.zeros((n, n), dtype=np.int64)
    for _ in range(4000):
        a, b = pick.randrange(1, 11), pick.randrange(11, 21)
        pairs[a, b] += 1
        pairs[b, pick.randrange(1, 11)] += 1
    pairs[0, 1:11] += 5
    of = exchange(pairs, 3, 10)
    assert of[0] == 0 and len(set(of[1:11])) == 1 and len(set(of[11:21])) == 1 and of[1] != of[11]


def test_no_training_rows_and_empty(spark):
    held = next(i for i in range(100) if crc32(str(i).encode()) % 10 == 0)
    table = spark.createDataFrame([(held, "some words")], "doc_id long, text string")
    (r,) = brown_scores(table).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(0) and math.isfinite(r.score)
    assert brown_scores(table.where("false")).collect() == []
