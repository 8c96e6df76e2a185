"""SimHash groups against all pairs by brute force."""

import random

import pytest
from xxhash import xxh64_intdigest

from cohortry.llm.simhash import CopySettings, near_pairs, one_of_each_group, simhash_groups


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    codes = [xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_groups(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 3:
                root[find(a)] = find(b)
    out = []
    for k, (i, p) in enumerate(prints):
        ids = [prints[j][0] for j in range(len(rows)) if find(j) == find(k) and prints[j][0] is not None]
        out.append((i, f"{p:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def test_groups_match_all_pairs(spark):
    pick = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [" ".join(pick.choices(vocabulary, k=pick.randint(0, 40))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60, 140):
        words = pick.choice(base).split()
        if words:
            words[pick.randrange(len(words))] = pick.choice(vocabulary)
        rows.append((i, "  ".join(words).upper()))
    rows += [(140, None), (141, ""), (142, " \t\n"), (7, base[3]), (7, base[3]), (None, base[4]), (None, "only this one"), (143, "é " * 5000)]
    table = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, fingerprint string, code long")
    got = sorted([tuple(r) for r in simhash_groups(table).collect()], key=str)
    assert got == brute_groups(rows)


@pytest.mark.parametrize("crowded", [1, 256])
@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_pairs_match_all_pairs_within_radius(spark, radius, crowded):
    pick = random.Random(radius)
    codes = [pick.getrandbits(64) for _ in range(20)]
    for c in list(codes):
        for _ in range(6):
            flips = pick.sample(range(64), pick.randint(0, 7))
            codes.append(c ^ sum(1 << b for b in flips))
    signed = sorted({c - (1 << 64) if c >> 63 else c for c in codes})
    table = spark.createDataFrame([(c,) for c in signed] + [(None,)], "print long")
    got = sorted((r.a, r.b) for r in near_pairs(table, radius=radius, crowded=crowded).collect())
    mask = (1 << 64) - 1
    want = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & mask).count("1") <= radius]
    assert got == sorted(want)


def test_empty_table(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def runs_of(text):
    words = (text or "").lower().split()
    width = max(1, min(5, len(words)))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


@pytest.mark.parametrize("paired", [2, 32])
def test_one_of_each_group_of_near_copies(spark, paired):
    pick = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for family in range(12):
        base = pick.choices(vocabulary, k=pick.randint(150, 400))
        rows.append((len(rows), " ".join(base)))
        for _ in range(8 if family else 40):
            words = list(base)
            for _ in range(pick.randint(0, 2)):
                words[pick.randrange(len(words))] = pick.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
        half = base[: len(base) // 2] + pick.choices(vocabulary, k=len(base) // 2)
        rows.append((len(rows), " ".join(half)))  # shares half: stays
    rows += [(900, ""), (901, None), (902, "short one"), (903, "short one"), (904, "short two"), (None, rows[0][1]), (None, "null id alone"), (5, rows[5][1])]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [runs_of(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] or sets[b] else 1.0
            if same >= 0.8:
                root[find(a)] = find(b)
    want = {}
    for k, (i, _) in enumerate(rows):
        want.setdefault(find(k), []).append(i)
    table = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, tag int")
    kept = one_of_each_group(table, settings=CopySettings(paired=paired))
    assert kept.columns == table.columns
    got = sorted((r.doc_id for r in kept.collect()), key=str)
    assert got == sorted((min((x for x in ids if x is not None), default=None) for ids in want.values()), key=str)


def linked_groups(texts):
    """Position of the first text of every group over pairs of a Jaccard index of 0.8 or more, by all pairs."""
    sets = [runs_of(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {find(k) for k in range(len(texts))}


@pytest.mark.parametrize("common", [0, 65536])
def test_near_copies_with_a_block_appended_or_inserted(spark, common):
    pick = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for family in range(60):
        base = pick.choices(vocabulary, k=(200, 400, 1000)[family % 3])
        block = pick.choices(vocabulary, k=int(len(base) * (0.09, 0.15, 0.235)[family // 3 % 3]))
        at = len(base) if family % 2 else pick.randrange(len(base))
        texts += [" ".join(base), " ".join(base[:at] + block + base[at:])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in one_of_each_group(table, settings=CopySettings(common=common)).collect()}
    assert kept == linked_groups(texts)
    assert len(kept) < 70  # most pairs are near copies; an inserted 0.235 of 200 words is not


@pytest.mark.parametrize("paired", [2, 8])
def test_family_whose_members_reach_only_some_others(spark, paired):
    pick = random.Random(9)
    template = [f"t{i}" for i in range(300)]
    texts = []
    for _ in range(25):  # pairs of texts at 0.85 and more, but below 0.8 to the other pairs
        words = list(template)
        for at in pick.sample(range(300), 9):
            words[at] = f"x{pick.random()}"
        texts.append(" ".join(words))
        words[pick.randrange(300)] = f"x{pick.random()}"
        texts.append(" ".join(words))
    pick.shuffle(texts)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in one_of_each_group(table, settings=CopySettings(paired=paired)).collect()}
    assert kept == linked_groups(texts)
    assert 10 < len(kept) < 50


@pytest.mark.parametrize("paired", [2, 32])
def test_common_line_in_many_short_texts(spark, paired):
    """Texts that share little but one line meet in its runs; only those alike beyond it are copies."""
    pick = random.Random(21)
    line = [f"common{i}" for i in range(14)]
    texts = []
    for k in range(1200):
        own = [f"own{pick.randrange(60)}" for _ in range(pick.choice([1, 2, 3, 5, 8]))]
        texts.append(" ".join(own + line if k % 2 else line + own))
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for t in texts)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    kept = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"), settings=CopySettings(paired=paired))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(rows))})
