"""SimHash near-duplicate groups found by deletion-variant signatures."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cohortry.llm.components import components
from cohortry.llm.text import raw_texts, rolling, word_codes, words
from cohortry.session import durable

BITS = 64


def fingerprint(raw: bytes, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of every run of `width` words; no words give zero."""
    tokens = words(raw)
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(width, len(tokens)) - 1 :] - 1).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops)], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _print(raw: str, width: int = 3, seed: int = 42) -> Column:
    """The 64-bit fingerprint of a text's bytes as a signed long."""

    def run(raws: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(raw, width, seed) for raw in raws], dtype=np.uint64).view(np.int64))

    return F.pandas_udf(run, "long")(raw)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, print): the 64-bit fingerprint of every text as a signed long."""
    return raw_texts(docs, id_col, text_col).select("doc_id", _print("raw", width, seed).alias("print"))


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask)


def _segments(radius: int) -> list[range]:
    """Bit ranges such that among codes within `radius` bits one range differs by at most one bit."""
    n = (radius + 2) // 2
    edges = [BITS * k // n for k in range(n + 1)]
    return [range(a, b) for a, b in zip(edges, edges[1:])]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _cut_outside(code: Column, segment: range, pieces: int) -> Column:
    """Array of hashes of `pieces` groups of the bits outside the segment."""
    outside = [b for b in range(BITS) if b not in segment]
    edges = [len(outside) * k // pieces for k in range(pieces + 1)]
    return F.array(*[
        F.xxhash64(F.lit(k), code.bitwiseAND(_signed(_mask(outside[a:b])))) for k, (a, b) in enumerate(zip(edges, edges[1:]))
    ])


def near_pairs(prints: DataFrame, column: str = "print", radius: int = 3, crowded: int = 256) -> DataFrame:
    """Rows (a, b), a < b, once per pair of different codes within `radius` bits.

    The 64 bits are cut into (radius + 2) // 2 segments, so in any such pair one segment differs by at most one bit, and both
    sides share the variant that leaves this bit out. Each code gives 64 variants; those alone in their signature are dropped
    after one shuffle. Signatures that gather over `crowded` different codes are cut further: of radius + 1 groups of the bits
    outside the segment at least one is equal. Every pair is checked bit by bit.
    """
    codes = prints.select(F.col(column).alias("code")).where(F.col("code").isNotNull()).distinct()
    code, number, segments = F.col("code"), F.col("number"), _segments(radius)
    kept = F.lit(-1).cast("long")
    pieces = F.array(F.lit(0).cast("long"))
    for segment in segments:
        inside = (number >= segment.start) & (number < segment.stop)
        kept = F.when(inside, code.bitwiseAND(_signed(_mask(segment)))).otherwise(kept)
        pieces = F.when(inside, _cut_outside(code, segment, radius + 1)).otherwise(pieces)
    signature = F.xxhash64(kept.bitwiseAND(F.expr("~shiftleft(1L, number)")), number)
    variants = codes.select("code", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("number")).select(
        "code", "number", signature.alias("key")
    )
    shared = variants.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    cut = F.when(F.col("n") > crowded, pieces).otherwise(F.array(F.lit(0).cast("long")))
    shared = durable(shared.select("code", "key", F.explode(cut).alias("block")))
    a, b = shared.alias("a"), shared.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.code") < F.col("b.code"))
    return (
        a.join(b, near & (F.bit_count(F.col("a.code").bitwiseXOR(F.col("b.code"))) <= radius))
        .select(F.col("a.code").alias("a"), F.col("b.code").alias("b")).distinct()
    )


def _labels(marked: DataFrame, radius: int, crowded: int) -> DataFrame:
    """Rows (print, component): any one code of its component for every fingerprint of `marked`."""
    nodes = marked.select("print").distinct()
    found = components(near_pairs(nodes, "print", radius, crowded), "a", "b")
    return nodes.join(found, nodes["print"] == found["node"], "left").select("print", F.coalesce("component", "print").alias("component"))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, seed: int = 42, crowded: int = 256
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest id reachable over links).

    Equal texts have equal fingerprints, so links are searched between distinct fingerprints only and copies are never paired.
    Null and empty texts have fingerprint zero and link like any other. Each row stands for itself: rows with a repeated id each
    get a row of the result; a null id stays null and doesn't name a component unless all its members' ids are null.
    Other columns are not read. An empty table gives an empty result.
    """
    marked = durable(fingerprints(docs, id_col, text_col, width, seed))
    placed = _labels(marked, radius, crowded).join(marked.groupBy("print").agg(F.min("doc_id").alias("first")), "print")
    named = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = placed.join(named, "component").select("print", "component_id")
    return marked.join(labels, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


@dataclass(frozen=True)
class CopySettings:
    """Texts count as near copies from `similarity` on, the Jaccard index of their sets of `shingle`-word runs. `paired`: texts in a
    signature up to which all its pairs are compared at once. The `common` most frequent runs of a sample come last in the order of runs.
    `radius` and `crowded` are those of `near_pairs`."""

    shingle: int = 5
    similarity: float = 0.8
    paired: int = 32
    common: int = 65536
    radius: int = 3
    crowded: int = 256


def _run_set(raw: bytes, s: CopySettings) -> np.ndarray:
    """32-bit codes of the different word runs of a text, sorted; runs of all its words if it has fewer than `shingle`."""
    codes = word_codes(words(raw))
    return np.unique(rolling(codes, max(1, min(s.shingle, len(codes)))).astype("<u4"))


def _common_runs(tagged: DataFrame, s: CopySettings, share: int = 16, least: int = 8) -> np.ndarray:
    """Runs that many texts hold, rarest first, by the texts whose tag falls into one of `share` parts. They only order the runs:
    whatever they are, the result is the same."""

    def runs(raws: pd.Series) -> pd.Series:
        return pd.Series([_run_set(raw, s).view("<i4") for raw in raws])

    sample = tagged.where(F.pmod("tag", F.lit(share)) == 0).select(F.explode(F.pandas_udf(runs, "array<int>")("raw")).alias("run"))
    counts = durable(sample.groupBy("run").count().where(F.col("count") >= least))
    room, floor = s.common, None
    for times, n in sorted(((r["count"], r["n"]) for r in counts.groupBy("count").agg(F.count("*").alias("n")).collect()), reverse=True):
        if n > room:
            break
        room, floor = room - n, times
    if floor is None:
        return np.zeros(0, dtype="<u4")
    found = sorted((r["count"], r["run"]) for r in counts.where(F.col("count") >= floor).collect())
    return np.array([run for _, run in found], dtype="<i4").view("<u4")


def _signatures(common: np.ndarray, s: CopySettings):
    """UDF of a text's bytes: n, its number of runs, and keys, its first n - ceil(similarity n) + 1 in the common order of runs.

    Two texts with a Jaccard index of `similarity` share at least that part of the runs of either, so their keys share one.
    """
    at = np.argsort(common)
    known = common[at]

    def run(raws: pd.Series) -> pd.DataFrame:
        sizes, keys = [], []
        for raw in raws:
            found = _run_set(raw, s)
            n = len(found)
            sizes.append(n)
            if n and len(known):
                place = np.minimum(np.searchsorted(known, found), len(known) - 1)
                often = known[place] == found
                found = np.concatenate((found[~often], common[np.sort(at[place[often]])]))
            first = n - math.ceil(s.similarity * n - 1e-9) + 1
            keys.append(found[:first].view("<i4") if n else np.zeros(1, dtype="<i4"))
        return pd.DataFrame({"n": np.array(sizes, dtype=np.int32), "keys": keys})

    return F.pandas_udf(run, "n int, keys array<int>")


def _shared_keys(nodes: DataFrame) -> DataFrame:
    """Rows (key, at, tag, n, times) of the keys that `times` > 1 texts (tag, n, keys) hold; `at` is the key's place in the text's order."""
    rows = nodes.select(F.posexplode("keys").alias("at", "key"), "tag", "n")
    counts = rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    return rows.join(counts, "key")


def _alike(n: str, at: str, m: str, there: str, s: CopySettings) -> Column:
    """Whether sets of n and m runs whose first run in common stands at these places can be similar enough: from there on each holds all
    that they share."""
    need = F.ceil(s.similarity / (1 + s.similarity) * (F.col(n) + F.col(m)) - 1e-9)
    sizes = F.least(n, m) >= s.similarity * F.greatest(n, m) - 1e-9
    return sizes & (F.col(n) - F.col(at) >= need) & (F.col(m) - F.col(there) >= need)


def _print_pairs(prints: DataFrame, radius: int, crowded: int) -> DataFrame:
    """Candidate pairs (a, b), a < b, by SimHash: each text (tag, print) and the first of those that `simhash_groups` links it with."""
    placed = prints.join(_labels(prints, radius, crowded), "print").select("tag", "component")
    first = placed.groupBy("component").agg(F.min("tag").alias("a"))
    return placed.join(first, "component").where("a < tag").select("a", F.col("tag").alias("b"))


def _key_pairs(shared: DataFrame, s: CopySettings) -> DataFrame:
    """Candidate pairs (a, b), a < b, of texts with a key in common: all pairs of a key of up to `paired` texts; in larger ones each
    text meets the first and the three before it, and `_open_pairs` adds what they leave apart."""
    in_key = Window.partitionBy("key")
    ordered = in_key.orderBy("tag")
    text = F.struct("tag", "n", "at")
    reach = F.when(F.col("times") <= s.paired, F.collect_list(text).over(ordered.rowsBetween(-s.paired, -1))).otherwise(
        F.concat(F.array(F.first(text).over(ordered.rowsBetween(Window.unboundedPreceding, 0))), F.collect_list(text).over(ordered.rowsBetween(-3, -1)))
    )
    met = shared.withColumn("others", reach).select("tag", "n", "at", F.explode("others").alias("other"))
    possible = (F.col("tag") != F.col("other.tag")) & _alike("n", "at", "other.n", "other.at", s)
    return met.where(possible).select(F.col("other.tag").alias("a"), F.col("tag").alias("b")).distinct()


def _few(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Marked for broadcast if it was counted to hold few rows; else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def _possible_pairs(pairs: DataFrame, nodes: DataFrame, s: CopySettings) -> DataFrame:
    """The pairs (a, b) whose keys have enough in common. Beyond its keys the text whose keys end first has n - size(keys) runs to
    share, and similar sets share similarity / (1 + similarity) of the sum of their sizes."""
    side = lambda tag: nodes.select(F.col("tag").alias(tag), F.col("n").alias(f"n{tag}"), F.col("keys").alias(f"k{tag}"))
    need = F.ceil(s.similarity / (1 + s.similarity) * (F.col("na") + F.col("nb")) - 1e-9)
    rest = F.greatest(F.col("na") - F.size("ka"), F.col("nb") - F.size("kb"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.size(F.array_intersect("ka", "kb")) >= need - rest).select("a", "b")


def _similar_pairs(pairs: DataFrame, tagged: DataFrame, nodes: DataFrame, s: CopySettings) -> DataFrame:
    """Those of the pairs (a, b) of tags whose sets of word runs are similar enough.

    `tagged`: id, tag, raw; `nodes`: one row per text: tag, id (of one row that has it), n, keys. Only texts in a possible pair are
    read again.
    """
    pairs = durable(_possible_pairs(pairs, nodes, s))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct()
    wanted = _few(durable(nodes.join(ends, nodes["tag"] == ends["t"]).select("t", F.col("id").alias("i"))))

    def runs(raws: pd.Series) -> pd.Series:
        return pd.Series([_run_set(raw, s).tobytes() for raw in raws])

    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            a, b = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both / max(1, len(a) + len(b) - both) if len(a) or len(b) else 1.0)
        return pd.Series(out, dtype=float)

    read = tagged.join(wanted, (F.col("tag") == F.col("t")) & F.col("id").eqNullSafe(F.col("i")))
    sets = durable(read.select("t", F.pandas_udf(runs, "binary")("raw").alias("set")).dropDuplicates(["t"]))
    both = pairs.join(sets.select(F.col("t").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("t").alias("b"), F.col("set").alias("y")), "b")
    return durable(both.where(F.pandas_udf(similar, "double")("x", "y") >= s.similarity).select("a", "b"))


def _open_pairs(shared: DataFrame, found: DataFrame, done: DataFrame, s: CopySettings) -> DataFrame:
    """Pairs (a, b) of texts that share a crowded key, lie in different components so far (`found`) and weren't compared (`done`).

    The largest component of a key is only met by the others, so a key whose texts are all linked gives no row. A pair counts at the first
    key that it shares: a run that many texts hold stands late in their orders, where too little is left to share, unless nearly all of
    a text is as common. Texts meet within neighbouring classes of size.
    """
    crowded = shared.where(F.col("times") > s.paired).join(found.withColumnRenamed("node", "tag"), "tag", "left")
    crowded = durable(crowded.select("key", "at", "tag", "n", F.coalesce("component", "tag").alias("component")))
    parts = crowded.groupBy("key", "component").count()
    split = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("count", "component")).alias("main")).where("parts > 1")
    size = F.floor(F.log("n") / -math.log(s.similarity) + 1e-9)
    texts = durable(crowded.join(durable(split.select("key", "main")), "key").withColumn("size", size).withColumn(
        "strong", F.col("n") - F.col("at") >= F.ceil(2 * s.similarity / (1 + s.similarity) * F.col("n") - 1e-9)))
    # of a similar pair the smaller text, at least, holds enough from the key on for a partner of its own size
    a, b = texts.where("component != main").alias("a"), texts.withColumn("near", F.explode(F.array(*[F.col("size") + d for d in (-1, 0, 1)]))).alias("b")
    once = (F.col("b.component") == F.col("b.main")) | (F.col("a.tag") < F.col("b.tag"))
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.size") == F.col("b.near")) & (F.col("a.component") != F.col("b.component")) & once
    apart = apart & (F.col("a.strong") | F.col("b.strong")) & _alike("a.n", "a.at", "b.n", "b.at", s)
    met = a.join(b, apart).select(F.least("a.tag", "b.tag").alias("a"), F.greatest("a.tag", "b.tag").alias("b")).distinct()
    return met.join(done, ["a", "b"], "left_anti")


def near_copy_pairs(tagged: DataFrame, nodes: DataFrame, settings: CopySettings) -> DataFrame:
    """Checked pairs (a, b), a < b, of near copies, enough to link all that can be reached over such pairs. `tagged`: id, tag, raw;
    `nodes`: one row per text: tag, id, print, n, keys.

    SimHash links and shared keys propose pairs. In crowded keys a few a text link most members of a family; what they leave in
    different components is compared in full.
    """
    s = settings
    shared = durable(_shared_keys(nodes))
    pairs = durable(_print_pairs(nodes.select("tag", "print"), s.radius, s.crowded).unionByName(_key_pairs(shared, s)).distinct())
    near = _similar_pairs(pairs, tagged, nodes, s)
    if shared.where(F.col("times") > s.paired).isEmpty():
        return near
    rest = durable(_open_pairs(shared, components(near, "a", "b"), pairs, s))
    return near if rest.isEmpty() else near.unionByName(_similar_pairs(rest, tagged, nodes, s))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: CopySettings = CopySettings()) -> DataFrame:
    """The row with the smallest id of every group of copies and near copies, all columns as they are.

    A group holds what is reachable over equal texts and checked near copies. Null ids come last, ties go by a hash of the text, equal
    rows count once. Null texts are empty; texts without a word are copies of each other.
    """
    s = settings
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    tagged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(raw).alias("tag"), raw.alias("raw"))
    signed = tagged.select("id", "tag", _signatures(_common_runs(tagged, s), s)("raw").alias("of"), _print("raw").alias("print"))
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "tag")).alias("least")
    nodes = durable(signed.groupBy("tag").agg(least, F.first("of").alias("of"), F.first("print").alias("print")).select(
        "tag", F.col("least.id").alias("id"), "print", "of.n", "of.keys"))
    found = components(near_copy_pairs(tagged.select("id", "tag", "raw"), nodes, s), "a", "b")
    placed = nodes.join(found, nodes["tag"] == found["node"], "left").select("tag", "id", F.coalesce("component", "tag").alias("component"))
    chosen = placed.groupBy("component").agg(least).select(F.col("least.id").alias("i"), F.col("least.tag").alias("t")).distinct()
    kept = tagged.join(chosen, F.col("id").eqNullSafe(F.col("i")) & (F.col("tag") == F.col("t"))).select("row", "id", "tag")
    once = kept.withColumn("n", F.row_number().over(Window.partitionBy("id", "tag").orderBy(F.lit(0)))).where("n = 1")
    return once.select("row.*")
