"""Exact repeats of long byte strings from a common-prefix interval tree over a sparse enhanced suffix array."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cohortry.llm.text import MIX, mixed
from cohortry.session import durable

GRAM = 32


@dataclass(frozen=True)
class RepeatSettings:
    """`length`: bytes of a string that counts as repeated. `crowded`: texts that share an anchor beyond which its group is cut."""

    length: int = 100
    crowded: int = 50_000


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first, last): the least hashed grams of all windows of `length` bytes, leftmost in ties.

    Each window start belongs to one anchor; an anchor owns the starts first..last (inclusive) before it. Equal windows have
    their anchor at the same offset, so equal strings meet at equal anchors. About one byte in (length - GRAM) / 2 is one.
    """
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    h = data.astype(np.uint64) + np.uint64(1)
    width, power = 1, int(MIX)
    while width < GRAM:  # a gram's hash from those of its halves
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power % (1 << 64)
        width *= 2
    h = mixed(h)
    span = length - GRAM + 1  # grams of a window
    low, reach = h, 1
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(h) - span + 1], low[span - reach : len(h) - reach + 1])
    # runs of starts with the same least hash whose leftmost place stays the same
    edge = np.flatnonzero(low[1:] != low[:-1]) + 1
    begin = np.concatenate(([0], edge))
    stop = np.concatenate((edge, [n]))
    at, first, last = [], [], []
    places = np.flatnonzero(np.isin(h, low[begin])) if len(begin) else np.zeros(0, np.int64)
    values = h[places]
    order = np.lexsort((places, values))
    values, places = values[order], places[order]
    lo = np.searchsorted(values, low[begin], "left")
    hi = np.searchsorted(values, low[begin], "right")
    plain = hi - lo == 1
    at.append(places[lo[plain]])
    first.append(begin[plain])
    last.append(stop[plain] - 1)
    for k in np.flatnonzero(~plain):  # a gram that comes again: each start takes the leftmost place at or after it
        starts = np.arange(begin[k], stop[k])
        mine = places[lo[k] : hi[k]]
        owner = mine[np.searchsorted(mine, starts, "left")]
        cut = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(starts)]))
        at.append(owner[cut[:-1]])
        first.append(starts[cut[:-1]])
        last.append(starts[cut[1:] - 1])
    at, first, last = np.concatenate(at), np.concatenate(first), np.concatenate(last)
    return h[at], at, first, last


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading bytes of each pair of rows."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def intervals(shared: list[int]) -> list[tuple[int, int, int]]:
    """(depth, from, to) of every interval of suffixes first..last with a common prefix of `depth`, by one scan with a stack.

    `shared[i]` is the common prefix of suffixes i - 1 and i of the sorted order; index 0 isn't read. Children come before parents.
    """
    out, stack = [], [(0, 0)]
    for i in range(1, len(shared) + 1):
        depth = shared[i] if i < len(shared) else 0
        left = i - 1
        while stack[-1][0] > depth:
            top, left = stack.pop()
            out.append((top, left, i - 1))
        if stack[-1][0] < depth:
            stack.append((depth, left))
    return out


def repeat_groups(right: list[bytes], left: list[bytes], length: int) -> list[tuple[int, int, list[int]]]:
    """Maximal repeats among suffixes of one anchor: (bytes before, bytes after the anchor, all occurrences).

    `right[i]` is what follows occurrence i, `left[i]` what precedes it, reversed. The intervals of the sorted suffixes are the
    strings that can't be extended to the right; among the occurrences of one, the intervals of the sorted left parts are
    those that can't be extended to the left. A left group that lies in a single child interval is that child's.
    """
    n = len(right)
    order = sorted(range(n), key=right.__getitem__)
    shared = [0] * n
    for i in range(1, n):
        shared[i] = _prefix(right[order[i - 1]], right[order[i]])
    out = []
    for depth, a, b in intervals(shared):
        members = sorted((order[i] for i in range(a, b + 1)), key=left.__getitem__)
        child = {}  # which child interval an occurrence lies in: cut where the common prefix is just `depth`
        kind = 0
        for i in range(a, b + 1):
            kind += i > a and shared[i] == depth
            child[order[i]] = kind
        least = max(0, length - depth)
        back = [0] * len(members)
        for i in range(1, len(members)):
            back[i] = _prefix(left[members[i - 1]], left[members[i]])
        groups = intervals(back)
        if length <= depth:  # the empty left part is shared by all
            if not groups or (groups[-1][1], groups[-1][2]) != (0, len(members) - 1):
                groups = [*groups, (0, 0, len(members) - 1)]
        for before, c, d in groups:
            if before >= least and any(child[members[i]] != child[members[c]] for i in range(c + 1, d + 1)):
                out.append((before, depth, members[c : d + 1]))
    return out


def _prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def anchor_hashes(texts: DataFrame, settings: RepeatSettings) -> DataFrame:
    """Rows (gram, doc_id): the different anchor hashes of every text."""

    def run(batches):
        for batch in batches:
            ids, found = [], []
            for doc, raw in zip(batch["doc_id"], batch["raw"]):
                h = np.unique(anchors(np.frombuffer(raw, np.uint8), settings.length)[0])
                ids.append(np.full(len(h), doc, dtype=np.int64))
                found.append(h)
            if ids:
                yield pd.DataFrame({"gram": np.concatenate(found).view(np.int64), "doc_id": np.concatenate(ids)})

    return texts.mapInPandas(run, "gram long, doc_id long")


_SUFFIX = "gram long, doc_id long, tag long, at long, before long, raw binary"


def suffix_rows(known: DataFrame, settings: RepeatSettings) -> DataFrame:
    """Rows (gram, doc_id, tag, at, before, raw) of every anchor that may repeat: its surroundings, from the first start it owns to
    the end of the last window it owns; `before` bytes of them lie before the anchor.

    `known`: doc_id, tag, raw, grams and packed (the text's anchor hashes that few or many other texts have as well, or null).
    Hashes that come twice in the text itself are added here. An anchor of `packed` is cut into its windows, each a row under a hash
    of its own. Surroundings that were met just before aren't sent: the spans they make up are repeated bytes already and
    go along as rows with null for `raw`, spread by place.
    """
    length = settings.length

    def run(batches):
        for batch in batches:
            seen: set = set()
            out: list[tuple] = []
            again: tuple = [], [], [], []
            columns = zip(batch["doc_id"].tolist(), batch["tag"].tolist(), batch["raw"], batch["grams"], batch["packed"])
            before = None
            for doc, tag, raw, grams, packed in sorted(columns, key=lambda r: r[:2]):
                if (doc, tag) == before:  # a repeated row
                    continue
                before = (doc, tag)
                h, at, first, last = anchors(np.frombuffer(raw, np.uint8), length)
                if not len(h):
                    continue
                gram = h.view(np.int64)
                _, where, times = np.unique(h, return_inverse=True, return_counts=True)
                keep = times[where] > 1
                if grams is not None:
                    keep |= np.isin(gram, np.asarray(grams, dtype=np.int64))
                single = np.isin(gram, np.asarray(packed, dtype=np.int64)) if packed is not None else np.zeros(len(h), dtype=bool)
                k = np.flatnonzero(keep | single)
                for g, p, a, b, alone in sorted(zip(gram[k].tolist(), at[k].tolist(), first[k].tolist(), last[k].tolist(), single[k].tolist()), key=lambda r: r[2]):
                    for x, y in ((x, x) for x in range(a, b + 1)) if alone else ((a, b),):
                        around = raw[x : y + length]
                        if alone:
                            code = xxh64_intdigest(around)
                            g, p = code - (1 << 64) if code >> 63 else code, x
                        if (g, p - x, around) in seen:
                            for column, value in zip(again, (doc, tag, x, y + length)):
                                column.append(value)
                        else:
                            seen.add((g, p - x, around))
                            out.append((g, doc, tag, p, p - x, around))
                if len(out) + len(again[0]) > 20_000:  # a bounded number of rows at a time
                    yield sent(out, again)
                    seen, out, again = set(), [], ([], [], [], [])
            yield sent(out, again)

    def sent(out, again) -> pd.DataFrame:
        spans = _joined(*(np.array(column, dtype=np.int64) for column in again))
        spread = mixed(spans["doc_id"].to_numpy().view(np.uint64) + mixed(spans["start"].to_numpy().view(np.uint64)))
        known_already = zip(spread.view(np.int64).tolist(), *(spans[c].tolist() for c in ("doc_id", "tag", "start")), (spans["stop"] - spans["start"]).tolist())
        return pd.DataFrame(out + [(*row, None) for row in known_already], columns=[c.split()[0] for c in _SUFFIX.split(", ")])

    return known.mapInPandas(run, _SUFFIX)


def _covered(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans of the suffixes in `rows` (whole anchor groups) that repeat an earlier occurrence: doc_id, tag, start, stop."""
    known = rows["raw"].isna().to_numpy()
    taken = [tuple(rows[c].to_numpy()[known] for c in ("doc_id", "tag", "at")) + ((rows["at"] + rows["before"]).to_numpy()[known],)]
    # rows that repeat in the table are one occurrence
    rows = rows[~known].drop_duplicates(["gram", "doc_id", "tag", "at"])
    rows = rows.sort_values(["gram", "doc_id", "tag", "at"], kind="stable").reset_index(drop=True)
    gram, doc, tag, at, before = (rows[c].to_numpy() for c in ("gram", "doc_id", "tag", "at", "before"))
    raw = rows["raw"].tolist()
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))

    # equal surroundings: all but the first repeat as a whole, and say nothing new to others
    seen: dict = {}
    first = np.ones(len(raw), dtype=bool)
    for i, key in enumerate(zip(gram.tolist(), before.tolist(), raw)):
        if seen.setdefault(key, i) != i:
            first[i] = False
    del seen
    again = np.flatnonzero(~first)
    taken.append((doc[again], tag[again], at[again] - before[again], at[again] - before[again] + size[again]))
    k = np.flatnonzero(first)
    gram, doc, tag, at, before, size = gram[k], doc[k], tag[k], at[k], before[k], size[k]
    raw = [raw[i] for i in k]
    cut = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1], [True]))) if len(k) else np.zeros(1, np.int64)
    width = np.diff(cut)

    # groups of two: one interval, its common parts by whole columns
    two = cut[:-1][width == 2]
    for a in range(0, len(two), 20_000):
        i = two[a : a + 20_000]
        after, back = [], []
        for side in (i, i + 1):
            right = np.zeros((len(i), length), np.uint8)
            left = np.zeros((len(i), length), np.uint8)
            for r, x in enumerate(side.tolist()):
                b = before[x]
                part = np.frombuffer(raw[x], np.uint8)
                right[r, : len(part) - b] = part[b:]
                left[r, :b] = part[:b][::-1]
            after.append(right)
            back.append(left)
        depth = np.minimum(_common(*after), np.minimum(size[i] - before[i], size[i + 1] - before[i + 1]))
        reach = np.minimum(_common(*back), np.minimum(before[i], before[i + 1]))
        hit = depth + reach >= length
        j = i[hit] + 1
        taken.append((doc[j], tag[j], at[j] - reach[hit], at[j] + depth[hit]))

    many: tuple = [], [], [], []
    for a, b in zip(cut[:-1][width > 2].tolist(), cut[1:][width > 2].tolist()):
        ahead = before[a:b].tolist()
        right = [x[p:] for x, p in zip(raw[a:b], ahead)]
        left = [x[:p][::-1] for x, p in zip(raw[a:b], ahead)]
        for back, depth, members in repeat_groups(right, left, length):
            for m in members:
                if m != min(members):  # rows are in order of document and place
                    many[0].append(doc[a + m])
                    many[1].append(tag[a + m])
                    many[2].append(at[a + m] - back)
                    many[3].append(at[a + m] + depth)
    taken.append(tuple(np.array(x, dtype=np.int64) for x in many))
    return _joined(*(np.concatenate([np.asarray(t[c], dtype=np.int64) for t in taken]) for c in range(4)))


def _joined(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pd.DataFrame:
    """Spans of a text that touch or overlap, made one."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, stop = doc[order], tag[order], start[order], stop[order]
    if len(doc):
        # texts are moved apart so that one running maximum of the ends serves all
        shift = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))) * (int(stop.max()) + 2)
        ends = np.maximum.accumulate(stop + shift)
        head = np.flatnonzero(np.concatenate(([True], (start + shift)[1:] > ends[:-1])))
        tail = np.concatenate((head[1:], [len(doc)])) - 1
        doc, tag, start, stop = doc[head], tag[head], start[head], (ends - shift)[tail]
    return pd.DataFrame({"doc_id": doc, "tag": tag, "start": start, "stop": stop})


def _whole_groups(frames, length: int):
    """Spans of batches sorted by gram, gathered until a group is whole."""
    held, waiting = [], 0
    for frame in frames:
        held.append(frame)
        waiting += len(frame)
        if waiting >= 20_000:
            whole = pd.concat(held, ignore_index=True)
            last = whole["gram"] == whole["gram"].iloc[-1]
            if not last.all():
                yield _covered(whole[~last], length)
            held, waiting = [whole[last]], int(last.sum())
    if waiting:
        yield _covered(pd.concat(held, ignore_index=True), length)


def repeated_spans(texts: DataFrame, settings: RepeatSettings = RepeatSettings()) -> DataFrame:
    """Rows (doc_id, tag, start, stop): bytes of `texts` (doc_id, tag, raw) in a string of `length` bytes that starts earlier as well.

    Every window of `length` bytes belongs to one anchor, so a sparse suffix array over anchors finds all repeats: anchors whose
    hash comes once are dropped after a shuffle of hashes; the rest meet by hash with their surroundings, are sorted, and the
    interval tree of each group gives every maximal repeat with all its occurrences. All but the first are repeated.
    Spans of different anchors may overlap. Anchors that more than `crowded` texts share go window by window instead.
    """
    s = settings
    known = F.col("doc_id").isNotNull()
    whole = [F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tag", F.when(known, F.col("raw")).otherwise(F.lit(b"")).alias("raw")]
    counted = anchor_hashes(texts.select(*whole), s).withColumn("n", F.count("*").over(Window.partitionBy("gram"))).where("n > 1")
    lists = counted.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("n") <= s.crowded, F.col("gram"))).alias("grams"),
        F.collect_list(F.when(F.col("n") > s.crowded, F.col("gram"))).alias("packed"),
    )
    rows = suffix_rows(texts.join(lists, "doc_id", "left").select(*whole, "grams", "packed"), s)
    return rows.repartition(F.col("gram")).sortWithinPartitions("gram").mapInPandas(
        lambda frames: _whole_groups(frames, s.length), "doc_id long, tag long, start long, stop long"
    )


def _cut(raw: pd.Series, starts: pd.Series, stops: pd.Series, copy: pd.Series) -> pd.DataFrame:
    out = []
    for text, a, b, whole in zip(raw, starts, stops, copy):
        if whole:
            out.append((len(text), 1, b""))
        elif a is None or not len(a):
            out.append((0, 0, text))
        else:
            zero = np.zeros(len(a), dtype=np.int64)
            spans = _joined(zero, zero, np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64))
            a, b = spans["start"].tolist(), spans["stop"].tolist()
            kept = b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)]))
            out.append((len(text) - len(kept), len(a), kept))
    return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])


def _cut_text(raw: pd.Series, starts: pd.Series, stops: pd.Series, copy: pd.Series) -> pd.DataFrame:
    out = _cut(raw, starts, stops, copy)
    out["kept"] = [kept.decode("utf-8", "ignore") for kept in out["kept"]]
    return out


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: RepeatSettings = RepeatSettings(), as_text: bool = False
) -> DataFrame:
    """One row per row of `docs`: `row` (a struct of its columns but the text), doc_id, had_text (not null), n_bytes, n_removed,
    n_spans, kept (the bytes that stay; with `as_text` as a string, without the remains of characters that were cut through).

    Each byte in a string of `length` bytes that also starts earlier (in a smaller id, or before in the same text) is removed;
    strings are judged on the input. A text that an earlier id holds as a whole needs no search: from `length` bytes on it goes.
    Null texts count as empty. Rows with a null id keep all bytes and aren't earlier than any. Rows with an id and a text in
    common are one document, each getting its result; different texts of one id are documents ordered by their hash. Other
    columns may have any name. An empty table gives an empty result.
    """
    given = docs[text_col].cast("string")
    others = [docs[c] for c in docs.columns if c != text_col] or [F.lit(None).alias("none")]
    base = docs.select(
        F.struct(*others).alias("row"), docs[id_col].cast("long").alias("doc_id"), given.isNotNull().alias("had_text"),
        F.coalesce(given, F.lit("")).cast("binary").alias("raw"),
    )
    raw = F.col("raw")
    whole = F.unhex(F.sha2(raw, 256))
    long = F.length(raw) >= settings.length
    keys = durable(base.where(F.col("doc_id").isNotNull() & long).select("doc_id", whole.alias("digest")))
    first = keys.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    copies = keys.join(first, "digest").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("digest").alias("copied"))
    marked = base.join(durable(copies), "doc_id", "left")
    is_copy = F.coalesce(F.array_contains("copied", F.when(F.col("copied").isNotNull(), whole)), F.lit(False))
    # only copies are filtered: a condition on the text alone would move below the shuffle, which then couldn't be shared
    texts = marked.where(~is_copy).select("doc_id", F.xxhash64(raw).alias("tag"), "raw")
    spans = repeated_spans(texts, settings).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "start", "stop")).alias("spans"))
    joined = marked.join(spans, "doc_id", "left").withColumn("copy", is_copy)
    mine = F.filter("spans", lambda x: x["tag"] == F.xxhash64("raw"))
    run = F.pandas_udf(_cut_text if as_text else _cut, f"n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
    cut = run("raw", F.transform(mine, lambda x: x["start"]), F.transform(mine, lambda x: x["stop"]), "copy")
    columns = ["row", "doc_id", "had_text"]
    return joined.select(*columns, F.length("raw").cast("long").alias("n_bytes"), cut.alias("cut")).select(*columns, "n_bytes", "cut.*")


def maximal_repeats(texts: list[tuple[int, bytes]], length: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Maximal repeats of at least `length` bytes that hold an anchor, with all occurrences, of a small list: for inspection and tests."""
    groups: dict = {}
    for doc, raw in texts:
        for g, p, _, _ in zip(*anchors(np.frombuffer(raw, np.uint8), length)):
            groups.setdefault(int(g), []).append((doc, int(p), raw[: int(p)][::-1], raw[int(p) :]))
    by_id = dict(texts)
    out = {}
    for rows in groups.values():
        rows = sorted(set(rows))  # an anchor owns several runs of starts where its gram comes again nearby
        for back, depth, members in repeat_groups([r[3] for r in rows], [r[2] for r in rows], length):
            doc, p = rows[members[0]][:2]
            out[by_id[doc][p - back : p + depth]] = sorted((rows[m][0], rows[m][1] - back) for m in members)
    return sorted(out.items())
