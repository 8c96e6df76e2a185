"""Leaks against every window of every text."""

import random
from collections import Counter

from cohortry.llm.decontaminate import LeakSettings, leaks, without_leaks


def shingles(words, width):
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def brute(docs, items):
    out = {}
    for d, text in docs:
        words = (text or "").lower().split()
        for k, item in items:
            want = (item or "").lower().split()
            width = min(5, len(want))
            if not width:
                continue
            need, have = shingles(want, width), shingles(words, width)
            size = min(len(need), len(have))
            best = 0.0
            for i in range(len(have) - size + 1 if size else 0):
                a, b = Counter(need), Counter(have[i : i + size])
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                out[(d, k)] = round(best, 9)
    return out


def made(seed):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(pick.choices(vocabulary, k=pick.randint(6, 60)))) for k in range(30)] + [(40, "one two"), (41, ""), (42, None), (43, "w1 " * 30)]
    docs = []
    for d in range(80):
        words = pick.choices(vocabulary, k=pick.randint(0, 200))
        if d % 2:
            part = (pick.choice(items)[1] or "").split()
            for _ in range(pick.randint(0, 2)):
                if len(part) > 3:
                    part[pick.randrange(len(part))] = "changed"
            if d % 5 == 0:
                part = part[: len(part) // 2]
            at = pick.randint(0, len(words))
            words[at:at] = part
        docs.append((d, " \n".join(words).upper() if d % 3 else " ".join(words)))
    return docs + [(90, None), (91, ""), (92, "w1 " * 50), (93, "one two"), (94, items[0][1]), (95, " ".join(items[1][1].split()[:-1]))], items


def test_leaks_match_every_window(spark):
    docs, items = made(1)
    d = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, similarity double")
    b = spark.createDataFrame(items, "item_id long, text string")
    for at_once in (20_000, 7):
        got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in leaks(d, b, settings=LeakSettings(items_at_once=at_once)).collect()}
        assert got == brute(docs, items)
        kept = {r.doc_id for r in without_leaks(d, b, settings=LeakSettings(items_at_once=at_once)).collect()}
        assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_empty_tables_and_repeats(spark):
    docs, items = made(2)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert leaks(d, b.where("false")).collect() == []
    assert leaks(d.where("false"), b).collect() == []
    assert without_leaks(d, b.where("false")).count() == len(docs)
    twice = spark.createDataFrame([(None, items[0][1]), (5, items[0][1]), (5, items[0][1])], "doc_id long, text string")
    assert sorted([(r.doc_id, r.item_id) for r in leaks(twice, b).collect()], key=str) == sorted([(None, 0), (5, 0), (5, 0)], key=str)


def test_leaks_of_texts_with_repeated_words(spark):
    """Similarity 0.8 by counts, though the fingerprints lie far apart: repeats in the item, in the text, in both."""
    pick = random.Random(4)
    words = lambda n, stem: [f"{stem}{pick.randrange(10**6)}" for _ in range(n)]
    docs, items = [], []
    for k in range(2):
        own = words(804, "a")
        items.append((k, " ".join(own + ["pad"] * 100)))
        docs.append((k, " ".join(words(30, "b") + own + words(130, "c"))))  # 800 of 900 shingles
        own = words(904, "d")
        items.append((10 + k, " ".join(own)))
        docs.append((10 + k, " ".join(words(50, "e") + own[:804] + ["rule"] * 120 + words(50, "f"))))
        own = words(300, "g")
        items.append((20 + k, " ".join(own + ["x"] * 60)))
        docs.append((20 + k, " ".join(own + ["x"] * 45 + words(50, "h"))))
    want = brute(docs, items)
    assert {d for d, _ in want} >= {0, 10, 20}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in leaks(d, b).collect()} == want


def test_very_long_text(spark):
    pick = random.Random(6)
    item = [f"w{pick.randrange(5000)}" for _ in range(70)]
    long = [f"w{pick.randrange(5000)}" for _ in range(120_000)]
    long[90_000:90_000] = item
    found = leaks(spark.createDataFrame([(1, " ".join(long))], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.similarity, r.first_word) for r in found] == [(1, 7, 1.0, 90_000)]
