"""Repeated bytes against a window-by-window answer."""

import hashlib
import random

import numpy as np
import pytest

from cohortry.llm.suffixes import RepeatSettings, intervals, maximal_repeats, without_repeats


def brute(rows, length):
    """(id, bytes, removed, spans, digest) of rows (id, text), in order of id."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, alphabet, n=40):
    pick = random.Random(seed)
    base = ["".join(pick.choices(alphabet, k=pick.randint(0, 500))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(pick.randint(0, 3)):
            b = pick.choice(base)
            at = pick.randint(0, len(b))
            parts += [b[at : at + pick.randint(0, 400)], "".join(pick.choices(alphabet, k=pick.randint(0, 4)))]
        out.append("".join(parts))
    return out


def run(spark, rows, **settings):
    table = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, kept string, start int, row int")
    got = without_repeats(table, settings=RepeatSettings(**settings)).selectExpr(
        "doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) as digest", "row.kept as k", "row.row as r"
    ).collect()
    assert all(r.k == "x" and r.r == 2 for r in got)
    return sorted(tuple(r)[:5] for r in got)


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefghij é"])
@pytest.mark.parametrize("crowded", [0, 3, 50_000])
def test_removed_bytes_match_windows(spark, alphabet, crowded):
    made = texts(len(alphabet), alphabet)
    rows = [(i, t) for i, t in enumerate(made)] + [(100 + i, made[i]) for i in range(0, 40, 3)] + [(-5, made[7]), (300, None), (301, "")]
    rows.append((302, "ab" * 4000))
    assert run(spark, rows, crowded=crowded) == brute(rows, 100)


def test_other_length(spark):
    rows = list(enumerate(texts(9, "abcdef", 25)))
    assert run(spark, rows, length=40) == brute(rows, 40)


def test_repeated_ids_and_null_ids(spark):
    pick = random.Random(8)
    a, b = ("".join(pick.choices("abcdefgh ", k=n)) for n in (200, 300))
    rows = [(1, a), (1, a), (2, b), (2, b + "!"), (None, b), (3, b)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in without_repeats(table).collect()]
    assert len(got) == 6
    assert {n for i, _, n in got if i is None} == {0}
    assert {n for i, _, n in got if i == 1} == {0}
    assert {n for i, _, n in got if i == 3} == {len(b)}
    # of two texts of one id, the one with the smaller hash is earlier
    assert sorted(n > 0 for i, _, n in got if i == 2) == [False, True]


def test_whole_characters_as_text(spark):
    shared = "".join(chr(0x400 + i) for i in range(80))
    # both letters before it end in the same byte, which repeats as well
    table = spark.createDataFrame([(1, "é" + shared), (2, "aĩ" + shared)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in without_repeats(table, as_text=True).collect()}
    assert got == {1: "é" + shared, 2: "a"}


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_interval_tree():
    # banana: a, ana, anana, banana, na, nana
    assert sorted(intervals([0, 1, 3, 0, 0, 2])) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_maximal_repeats_have_all_occurrences():
    made = [(i, t.encode()) for i, t in enumerate(texts(4, "abc", 12))]
    for string, places in maximal_repeats(made, 60):
        every = sorted((d, i) for d, raw in made for i in range(len(raw) - len(string) + 1) if raw[i : i + len(string)] == string)
        assert places == every and len(places) > 1
        sides = {(raw[i - 1 : i] if i else (d, "start")) for d, i in places for raw in [dict(made)[d]]}
        ends = {raw[i + len(string) : i + len(string) + 1] or (d, "end") for d, i in places for raw in [dict(made)[d]]}
        assert len(string) >= 60
        assert len(sides) > 1 and len(ends) > 1
