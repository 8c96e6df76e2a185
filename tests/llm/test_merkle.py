"""Manifest, multiproofs and folding against a plain tree in Python; odd rows; the octopus by brute force."""

import hashlib
import random
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cohortry.llm import registry
from cohortry.llm.merkle import fold, folded, interiors, manifest, member_proofs, missing, parent, siblings
from cohortry.llm.text import read

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    return hashlib.sha256("".join(told(v) for v in row).encode()).hexdigest()


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([hashlib.sha256("".join(out[-1][i:i + 2]).encode()).hexdigest() for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    out = []
    for level in levels[:-1]:
        if i ^ 1 < len(level):
            out.append(level[i ^ 1])
        i >>= 1
    return out


def brute(rows):
    """Sorted (id, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, members = [], []
    for lang in langs:
        mine = sorted(((r[0], leaf_of(r)) for r in rows if r[2] == lang), key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        members.append(mine)
        trees.append(levels_of([m[1] for m in mine]))
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for g, (tree, mine) in enumerate(zip(trees, members)):
        out += [(i, leaf, tree[-1][0], top[-1][0], tuple(path(tree, k) + path(top, g))) for k, (i, leaf) in enumerate(mine)]
    return sorted(out, key=str)


def rows_of(found):
    keep = found.withColumn("end", folded("leaf", "idx", "n", "place", "groups", "proof")).collect()
    assert all(r["end"] == r["root"] for r in keep)
    return sorted(((r["id"], r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), tuple(p.hex() for p in r["proof"])) for r in keep), key=str)


def table(spark, rows):
    kind = "doc_id long, source string, lang string, n_chars long, text string, key int, idx string, n string, leaf string"
    return spark.createDataFrame([(*r, 5, "x", None, "") for r in rows], kind)


def data(n, seed):
    pick = random.Random(seed)
    langs = ["en"] * 40 + ["de"] * 9 + [None, "", "é", "Z"] * 2 + ["one"]
    rows = [(i, pick.choice([None, "", "s1"]), pick.choice(langs), pick.choice([None, i]), pick.choice([None, "", "1:a", "é\n" * i])) for i in range(n)]
    return rows + [(None, "s", "en", 1, "null id"), (None, "s", "en", 1, "null id"), (3, None, "en", None, "same id"), (3, None, "en", None, "same id"),
                   (n, "s", "lonely", 1, "one leaf"), (n + 1, None, None, None, None)]


@pytest.mark.parametrize("n, bits", [(300, 2), (300, 12), (61, 1), (0, 3)])
def test_against_plain_trees(spark, n, bits):
    rows = data(n, n)
    found = member_proofs(manifest(table(spark, rows), FIELDS, bits=bits), bits=bits)
    assert rows_of(found) == brute(rows)


def test_proofs_of_some_leaves_and_tampering(spark):
    rows = data(400, 9)
    made = manifest(table(spark, rows), FIELDS, bits=3, carry={"length": F.length("text")})
    some = made.leaves.where("id % 37 = 5 or id = 8")
    found = member_proofs(made, some, bits=3)
    want = [r for r in brute(rows) if r[0] is not None and (r[0] % 37 == 5 or r[0] == 8)]
    assert rows_of(found) == want and len(want) > 5
    assert {r["id"]: r["length"] for r in found.collect()} == {r[0]: (None if r[4] is None else len(r[4])) for r in rows if r[0] in {w[0] for w in want}}
    other = folded(F.unhex(F.sha2("leaf", 256)), "idx", "n", "place", "groups", "proof")
    moved = folded("leaf", F.when(F.col("idx") > 0, F.col("idx") - 1).otherwise(F.col("idx") + 1), "n", "place", "groups", "proof")
    short = folded("leaf", "idx", "n", "place", "groups", F.slice("proof", 1, 2))
    for r in found.select((other == F.col("root")).alias("a"), (moved == F.col("root")).alias("b"), short.alias("c")).collect():
        assert r["a"] is False and r["b"] in (False, None) and r["c"] is None


def test_copies_of_upper_nodes(spark, monkeypatch):
    from cohortry.llm import merkle

    monkeypatch.setattr(merkle, "REQUESTS", 2)
    monkeypatch.setattr(merkle, "UPPER_ROWS", 0)
    rows = [(i, "s", "en" if i % 5 else "de", i, str(i)) for i in range(500)]
    assert rows_of(member_proofs(manifest(table(spark, rows), FIELDS, bits=2), bits=2)) == brute(rows)


def test_octopus_is_whole_and_minimal():
    for width in range(1, 8):
        levels = levels_of([hashlib.sha256(bytes([i])).hexdigest() for i in range(width)])
        nodes = {(level, i): bytes.fromhex(h) for level, row in enumerate(levels) for i, h in enumerate(row)}
        top = (len(levels) - 1, 0)
        for size in range(1, width + 1):
            for chosen in combinations(range(width), size):
                want = missing(chosen, width)
                given = {(0, i): nodes[0, i] for i in chosen}
                found = interiors({**given, **{c: nodes[c] for c in want}}, width)
                assert found[top] == nodes[top] and all(nodes[c] == h for c, h in found.items())
                for left in want:
                    assert top not in interiors({**given, **{c: nodes[c] for c in want if c != left}}, width)
                for i in chosen:
                    assert fold(nodes[0, i], [(i, width)], siblings(i, width, found)) == nodes[top]


def test_parent_of_hex():
    a, b = hashlib.sha256(b"a").digest(), hashlib.sha256(b"b").digest()
    assert parent(a, b) == hashlib.sha256((a.hex() + b.hex()).encode()).digest()
    assert fold(a, [(0, 1)], [b]) is None and fold(a, [(0, 2)], []) is None


def test_empty_table(spark):
    made = manifest(table(spark, []), FIELDS)
    assert made.groups.collect() == [] and member_proofs(made).collect() == []


def test_very_long_text(spark):
    rows = [(1, "s", "en", 1, "é" * 3_000_000), (2, "s", "en", 1, "b")]
    assert rows_of(member_proofs(manifest(table(spark, rows), FIELDS))) == brute(rows)


def test_registered_query(spark, sf_dir):
    rows = [tuple(r[c] for c in FIELDS) for r in read(spark, sf_dir, "documents").collect()]
    by_id = {r[0]: r for r in brute(rows)}
    chars = {r[0]: r[3] for r in rows}
    found = registry.op12_merkle_manifest(spark, sf_dir).collect()
    assert len(found) == len(rows)
    for r in found:
        i, leaf, subroot, root, proof = by_id[r["doc_id"]]
        changed = zlib.crc32(str(i).encode()) % 7 == 0 and chars[i] is not None
        assert (r["leaf"], r["subroot"], r["root"]) == (leaf, subroot, root)
        assert r["proof_sha256"] == hashlib.sha256("".join(proof).encode()).hexdigest()
        assert r["verified"] is (not changed) and (r["folded_root"] == root) is (not changed)
