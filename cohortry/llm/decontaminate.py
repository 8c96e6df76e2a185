"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact weighted-shingle check."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.text import raw_texts, rolling, sliding, word_codes, words

BITS, BLOCK = 64, 8
_GATE = 1 << 20


@dataclass(frozen=True)
class LeakSettings:
    """`radius` of 27 bits lies over five standard deviations beyond what two windows of similarity 0.8 differ by, if no shingle comes twice
    in either; it doesn't apply to others."""

    width: int = 5
    similarity: float = 0.8
    radius: int = 27
    items_at_once: int = 20_000


def _signs(shingles: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for every shingle."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(len(shingles), 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def _prints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of smaller over sum of larger counts of every shingle."""
    both, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left = np.bincount(at[: len(a)], minlength=len(both))
    right = np.bincount(at[len(a) :], minlength=len(both))
    return float(np.minimum(left, right).sum() / np.maximum(left, right).sum())


def _latest_repeat(grams: np.ndarray, size: int) -> np.ndarray:
    """For every window of `size` shingles the last place before which one of its shingles stands already: the window repeats one if that
    place lies in it."""
    order = np.argsort(grams, kind="stable")
    before = np.full(len(grams), -1, dtype=np.int64)
    same = grams[order[1:]] == grams[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    return sliding(before, size, np.maximum)


class ItemIndex:
    """Items of one benchmark block, searchable by window fingerprints.

    Shared shingles name the items that a text may hold, and windows with too few of an item's shingles for the similarity are
    left out, which loses none. Of the rest those within `radius` of the item's fingerprint go to the exact check: such a fingerprint
    agrees with the item's up to radius // 8 bits in one of eight byte blocks, so tables of blocks and bytes find them, then all bits
    are compared. Where shingles repeat, in the item or the window, their counts weigh in the fingerprint and similar windows may lie
    far off: these all go to the exact check.
    """

    def __init__(self, items: list[tuple[int, bytes]], settings: LeakSettings):
        self.settings = settings
        self.ids, self.shingles, widths = [], [], []
        for item, raw in items:
            codes = word_codes(words(raw))
            width = min(settings.width, len(codes))
            if width:
                self.ids.append(item)
                self.shingles.append(rolling(codes, width))
                widths.append(width)
        self.widths = np.array(widths, dtype=np.int64)
        self.repeats = [len(np.unique(x)) < len(x) for x in self.shingles]
        n = len(self.ids)
        self.prints = _prints(np.stack([_signs(x).sum(axis=0) for x in self.shingles])) if n else np.zeros(0, np.uint64)
        self.gates: dict[int, tuple] = {}
        for width in sorted(set(widths)):
            mine = [k for k in range(n) if widths[k] == width]
            keys = np.concatenate([self.shingles[k] for k in mine])
            owners = np.repeat(mine, [len(self.shingles[k]) for k in mine])
            order = np.argsort(keys, kind="stable")
            gate = np.zeros(_GATE, dtype=bool)
            gate[(keys % np.uint64(_GATE)).astype(np.int64)] = True
            self.gates[width] = (gate, keys[order], owners[order])
        near = np.array([bin(x).count("1") for x in range(256)])[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= settings.radius // BLOCK
        self.bytes = self.prints.view(np.uint8).reshape(n, 8) if n else np.zeros((0, 8), np.uint8)
        self.tables = [near[:, self.bytes[:, b]] for b in range(8)]  # by block: byte of the window x item

    def within_radius(self, prints: np.ndarray, item: int) -> np.ndarray:
        """Which fingerprints lie within the radius of an item: by block tables, then by all bits."""
        pieces = prints.view(np.uint8).reshape(len(prints), 8)
        near = np.zeros(len(prints), dtype=bool)
        for b in range(8):
            near |= self.tables[b][pieces[:, b], item]
        at = np.flatnonzero(near)
        apart = np.bitwise_count(prints[at] ^ self.prints[item])
        return at[apart <= self.settings.radius]

    def matches(self, raw: bytes):
        """(item id, best similarity, first word, words, windows over the threshold) for every item that leaks into the text."""
        codes = word_codes(words(raw))
        for width, (gate, keys, owners) in self.gates.items():
            grams = rolling(codes, width)
            maybe = np.flatnonzero(gate[(grams % np.uint64(_GATE)).astype(np.int64)])
            if not len(maybe):
                continue
            lo, hi = np.searchsorted(keys, grams[maybe], "left"), np.searchsorted(keys, grams[maybe], "right")
            place = np.repeat(maybe, hi - lo)
            if not len(place):
                continue
            item = owners[np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange(len(place))]
            for k in np.unique(item):
                found = self._leak(grams, np.unique(place[item == k]), int(k))
                if found:
                    yield (self.ids[k], *found, int(len(self.shingles[k]) + width - 1))

    def _leak(self, grams: np.ndarray, hits: np.ndarray, k: int):
        want = self.shingles[k]
        size = min(len(want), len(grams))
        # of equal long windows, this many shingles of the item at least make the similarity possible
        share = self.settings.similarity / (1 + self.settings.similarity)
        need = math.ceil(share * (size + len(want)) - 1e-9)
        held = np.zeros(len(grams) + 1, dtype=np.int64)
        held[hits + 1] = 1
        held = np.cumsum(held)
        windows = np.flatnonzero(held[size:] - held[:-size] >= need)
        if not len(windows):
            return None
        again = np.zeros(len(windows), dtype=bool) if not self.repeats[k] else np.ones(len(windows), dtype=bool)
        best, start, over = 0.0, -1, 0
        least = self.settings.similarity
        run = np.concatenate(([0], np.cumsum(np.diff(windows) > size)))
        for r in range(run[-1] + 1):
            mine = np.flatnonzero(run == r)
            for low in range(0, len(mine), 4096):  # bounded pieces of long runs
                at = windows[mine[low : low + 4096]]
                part = grams[at[0] : at[-1] + size]
                if not self.repeats[k]:
                    again[mine[low : low + 4096]] = _latest_repeat(part, size)[at - at[0]] >= at - at[0]
                sums = np.cumsum(np.vstack((np.zeros((1, BITS), np.int32), _signs(part))), axis=0)
                prints = _prints((sums[size:] - sums[:-size])[at - at[0]])
                near = again[mine[low : low + 4096]].copy()
                near[self.within_radius(prints, k)] = True
                for w in at[near].tolist():
                    same = weighted_similarity(grams[w : w + size], want)
                    over += same >= least
                    if same >= least and same > best:
                        best, start = same, w
        return (best, start, over) if over else None


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", settings: LeakSettings = LeakSettings(),
) -> DataFrame:
    """One row per (document row, benchmark item) with a leak: doc_id, item_id, similarity, first_word, n_words, n_windows.

    Windows of the item's own number of words slide over whole texts, word by word (a shorter text is one window). Similarity is
    the weighted Jaccard of `width`-word shingles with their counts; items of fewer words are one shingle. Best window first in
    ties. The benchmark is the query set: it passes in blocks of `items_at_once` items, so no broadcast grows with it. Null and
    empty texts and items match nothing; repeated rows each get their rows; ids may be null. Other columns are not read.
    """
    # ids travel as text: pandas has no whole numbers with nulls
    texts = raw_texts(docs, id_col, text_col).select(F.col("doc_id").cast("string").alias("doc_id"), "raw")
    schema = "doc_id string, item_id string, similarity double, first_word long, n_windows long, n_words long"
    out = None
    for index in _indexes(docs.sparkSession, benchmark, item_col, item_text_col, settings):

        def run(batches, index=index):
            for batch in batches:
                found = [(d, None if m[0] is None else str(m[0]), *m[1:]) for d, raw in zip(batch["doc_id"], batch["raw"]) for m in index.value.matches(raw)]
                yield pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])

        found = texts.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "item_id")})


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    settings: LeakSettings = LeakSettings(),
) -> DataFrame:
    """The rows of `docs` into which no benchmark item leaks, all columns as they are; otherwise like `leaks`."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    out = docs
    for index in _indexes(docs.sparkSession, benchmark, item_col, item_text_col, settings):
        out = out.where(_is_clean(index)(raw))
    return out


def _is_clean(index):
    def clean(raws: pd.Series) -> pd.Series:
        return pd.Series([next(index.value.matches(raw), None) is None for raw in raws], dtype=bool)

    return F.pandas_udf(clean, "boolean")


def _indexes(spark: SparkSession, benchmark: DataFrame, item_col: str, item_text_col: str, settings: LeakSettings):
    """Broadcast indexes of the benchmark, one per block of about `items_at_once` different items."""
    items = benchmark.select(
        F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).cast("binary").alias("raw")
    ).distinct()
    blocks = max(1, -(-items.count() // settings.items_at_once))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = sorted((r["item_id"] is not None, r["item_id"] or 0, bytes(r["raw"]), r["item_id"]) for r in part.collect())
        yield spark.sparkContext.broadcast(ItemIndex([(item, raw) for _, _, raw, item in rows], settings))
