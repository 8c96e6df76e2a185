"""Merkle manifest of a table: a tree per group, a tree over the groups, and octopus multiproofs."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.operators.ordered import enrich, row_numbers
from cohortry.session import durable

BITS = 12
REQUESTS = 1024
UPPER_ROWS = 20_000


def encoded(field: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, so that no two rows run together; null is a dash."""
    text = field.cast("string")
    return F.when(field.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*fields: Column) -> Column:
    """Digest (32 bytes) of a row."""
    return F.unhex(F.sha2(F.concat(*[encoded(f) for f in fields]), 256))


def parent(*children: bytes) -> bytes:
    """Digest of the children's digests, written as lowercase hex one after the other."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


def missing(indices, width: int) -> list[tuple[int, int]]:
    """Octopus of a set of leaves of a tree with `width` leaves: the fewest (level, index) from which, with the leaves, the root follows."""
    out, level, known = [], 0, set(indices)
    while width > 1:
        out += [(level, i ^ 1) for i in sorted(known) if i ^ 1 not in known and i ^ 1 < width]
        known = {i >> 1 for i in known}
        width, level = (width + 1) // 2, level + 1
    return out


def interiors(known: dict[tuple[int, int], bytes], width: int) -> dict[tuple[int, int], bytes]:
    """All nodes that follow from known ones, each derived once, and the known ones."""
    out, level = dict(known), 0
    at_level: dict[int, list[int]] = {}
    for lvl, i in known:
        at_level.setdefault(lvl, []).append(i)
    here: set[int] = set()
    while width > 1:
        here |= set(at_level.get(level, ()))
        above = set()
        for i in {i >> 1 for i in here}:
            sides = [out.get((level, j)) for j in (2 * i, 2 * i + 1) if j < width]
            if None not in sides:
                out.setdefault((level + 1, i), parent(*sides))
                above.add(i)
        here, width, level = above, (width + 1) // 2, level + 1
    return out


def siblings(index: int, width: int, nodes: dict[tuple[int, int], bytes]) -> list[bytes]:
    """Siblings of a leaf's way to the root, from below; a lone node has none."""
    out, level = [], 0
    while width > 1:
        if index ^ 1 < width:
            out.append(nodes[level, index ^ 1])
        index, width, level = index >> 1, (width + 1) // 2, level + 1
    return out


def fold(node: bytes, places: list[tuple[int, int]], proof: list[bytes]) -> bytes | None:
    """The root that a leaf and its siblings give, through trees given as (index, width) from below; None if their number is wrong."""
    rest = iter(proof)
    for index, width in places:
        while width > 1:
            if index ^ 1 < width:
                other = next(rest, None)
                if other is None:
                    return None
                node = parent(other, node) if index & 1 else parent(node, other)
            else:
                node = parent(node)
            index, width = index >> 1, (width + 1) // 2
    return node if next(rest, None) is None else None


def _grown(bits: int, base: int):
    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        width, at = int(rows["n"].iloc[0]), dict(zip(rows["idx"].tolist(), rows["hash"]))
        for _ in range(base):
            width = (width + 1) // 2
        out, level = [], base
        while width > 1 and level < base + bits:
            up = {}
            for i in sorted({i >> 1 for i in at}):
                up[i] = parent(*[at[j] for j in (2 * i, 2 * i + 1) if j < width])
            at, width, level = up, (width + 1) // 2, level + 1
            out += [(keys[0], level, i, h, int(rows["n"].iloc[0])) for i, h in at.items()]
        return pd.DataFrame(out, columns=["key", "level", "idx", "hash", "n"])

    return run


def forest(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """All nodes (key, level, idx, hash, n) of a tree per key over leaves (key, idx, hash, n leaves of the key).

    Two neighbours become their parent; a lone last node becomes its own. Subtrees of 2^`bits` leaves are built as one group each,
    then their tops are the leaves of the next round: as many rounds as the deepest tree has times `bits` levels.
    """
    kind = "key string, level int, idx long, hash binary, n long"
    level0 = leaves.select("key", F.lit(0).alias("level"), "idx", "hash", "n")
    deepest = max(0, int((leaves.agg(F.max("n")).first()[0] or 1) - 1).bit_length())
    nodes, tops = [level0], level0
    for base in range(0, deepest, bits):
        block = F.shiftright("idx", bits).alias("block")
        grown = durable(tops.groupBy("key", block).applyInPandas(_grown(bits, base), kind))
        nodes.append(grown)
        tops = grown.where(F.col("level") == base + bits)
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return out


def depth(width: Column) -> Column:
    """Levels above the leaves of a tree."""
    return F.when(width > 1, F.length(F.bin(width - 1))).otherwise(F.lit(0))


@dataclass
class Manifest:
    """`leaves`: key, id, leaf, idx, n and what was carried along; `nodes` of the groups' trees; `groups`: key, subroot, place, groups,
    upper (siblings from subroot to root), root."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame


def _asked(bits: int):
    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        want = missing(rows["idx"].tolist(), int(rows["n"].iloc[0]))
        return pd.DataFrame([(keys[0], keys[1], level, i) for level, i in want], columns=["key", "block", "level", "idx"])

    return run


def _expanded(carried: list[str]):
    def run(keys: tuple, rows: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in ["key", "idx", "n", *carried, "proof"]})
        width = int(rows["n"].iloc[0])
        known = {(0, i): h for i, h in zip(rows["idx"].tolist(), rows["leaf"])}
        known.update({(level, i): h for level, i, h in zip(fetched["level"].tolist(), fetched["idx"].tolist(), fetched["hash"])})
        nodes = interiors(known, width)
        return rows[["key", "idx", "n", *carried]].assign(proof=[siblings(i, width, nodes) for i in rows["idx"].tolist()])

    return run


def proofs(leaves: DataFrame, nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """`leaves` (any rows of a manifest's leaves) with `proof`, the siblings from leaf to the root of its tree.

    A partition of leaves is an aligned run of 2^`bits` of a tree. It computes the coordinates that its leaves lack together, fetches
    each once by a join, derives the interiors that they share, and expands one proof per leaf. A node near the root is asked for by
    many partitions: a level of which that is so is copied, at most `REQUESTS` partitions meeting one copy.
    """
    carried = [c for c in leaves.columns if c not in ("key", "idx", "n")]
    given = leaves.withColumn("block", F.shiftright("idx", bits))
    asked = durable(given.select("key", "idx", "n", "block").groupBy("key", "block").applyInPandas(_asked(bits), "key string, block long, level int, idx long"))
    levels = [r[0] for r in asked.select("level").distinct().collect()]  # no more than a tree has
    copies = F.greatest(F.lit(1).cast("long"), F.floor(F.pow(F.lit(2.0), F.col("level") - bits) / REQUESTS).cast("long"))
    kept = nodes.select("key", "level", "idx", "hash").where(F.col("level").isin(levels) if levels else F.lit(False))
    kept = kept.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    fetched = asked.withColumn("copy", F.pmod("block", copies)).join(kept, ["key", "level", "idx", "copy"])
    kinds = dict(leaves.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["key", "idx", "n", *carried]) + ", proof array<binary>"
    met = given.groupBy("key", "block").cogroup(fetched.select("key", "block", "level", "idx", "hash").groupBy("key", "block"))
    return met.applyInPandas(_expanded(carried), schema)


def manifest(
    docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", carry: dict[str, Column] | None = None, bits: int = BITS,
) -> Manifest:
    """Trees over the rows of `docs`: one per value of `group_col` with leaves in order of the id, one over their roots in order of the group.

    A leaf is the digest of `fields`. Null ids come first, rows with one id go by their leaf; rows equal in both are interchangeable
    (what is in `carry` should then be equal too). A null group is a group, before all others; groups go by their UTF-8 bytes. A
    single leaf is the root of its tree. Texts are read and hashed once; everything after moves digests. Other columns may have any name.
    An empty table has no leaves and no groups.
    """
    group = docs[group_col].cast("string")
    key = F.coalesce(F.concat(F.lit("="), group), F.lit(""))
    extra = [c.alias(name) for name, c in (carry or {}).items()]
    light = durable(docs.select(key.alias("key"), docs[id_col].cast("long").alias("id"), leaf_hash(*[docs[f] for f in fields]).alias("leaf"), *extra))
    numbered = row_numbers(light, ["key"], ["id", "leaf"], "seq", rows=light.count())
    numbered = numbered.withColumn("idx", F.col("seq") - 1).drop("seq")
    sizes = durable(light.groupBy("key").agg(F.count("*").alias("n")))
    leaves = durable(enrich(numbered, sizes, "key", size_column="n"))
    nodes = forest(leaves.select("key", "idx", F.col("leaf").alias("hash"), "n"), bits)

    subroots = durable(nodes.where(F.col("level") == depth(F.col("n"))).select("key", F.col("hash").alias("subroot")))
    count = subroots.count()
    placed = row_numbers(subroots, [], ["key"], "seq", rows=count).select(
        F.lit("").alias("key"), (F.col("seq") - 1).alias("idx"), F.lit(count).cast("long").alias("n"), F.col("subroot").alias("leaf"), F.col("key").alias("of"))
    placed = durable(placed)
    upper = forest(placed.select("key", "idx", F.col("leaf").alias("hash"), "n"), bits)
    root = upper.where(F.col("level") == depth(F.col("n"))).select(F.col("hash").alias("root"))
    groups = proofs(placed, upper, bits).select(
        F.col("of").alias("key"), F.col("leaf").alias("subroot"), F.col("idx").alias("place"), F.col("n").alias("groups"), F.col("proof").alias("upper"))
    return Manifest(leaves, nodes, durable(groups.crossJoin(F.broadcast(root))))


def member_proofs(made: Manifest, leaves: DataFrame | None = None, bits: int = BITS) -> DataFrame:
    """Rows of `leaves` (all of the manifest's if not given) with subroot, root, place, groups and `proof` from leaf to root."""
    given = made.leaves if leaves is None else leaves
    sized = durable(made.groups.join(given.groupBy("key").agg(F.count("*").alias("_size")), "key"))
    joined = enrich(proofs(given, made.nodes, bits), sized, "key", size_column="_size", broadcast_rows=UPPER_ROWS).drop("_size")
    return joined.withColumn("proof", F.concat("proof", "upper")).drop("upper")


@F.pandas_udf(T.BinaryType())
def folded(leaf: pd.Series, idx: pd.Series, n: pd.Series, place: pd.Series, groups: pd.Series, proof: pd.Series) -> pd.Series:
    """Root that a leaf and its proof give; null if the proof has not as many siblings as its place asks for."""
    rows = zip(leaf, idx.tolist(), n.tolist(), place.tolist(), groups.tolist(), proof)
    return pd.Series([fold(bytes(a), [(i, w), (p, g)], [bytes(x) for x in s]) for a, i, w, p, g, s in rows], dtype=object)
