"""Alignment of two tokenizers: windows between anchors at space-marked tokens, aligned once per id tuple."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.text import written
from cohortry.llm.tokenizers import ByteTokenizer, Numbered, PieceTokenizer, model_bytes, spaced_words

BLOCK_BYTES = 8 << 20
BETWEEN = b"\xff" * 4  # no id


def _runs(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of runs laid one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Side:
    """One tokenizer of a task: bytes and lengths of its tokens, and which begin with a space."""

    def __init__(self, tokenizer):
        self.raw = tokenizer.token_bytes()
        self.size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.spaced = np.fromiter((x[:1] == b" " for x in self.raw), bool, len(self.raw))
        self.flat = tokenizer.segment if isinstance(tokenizer, ByteTokenizer) else lambda words: tokenizer.flat(words, self.raw)

    def tokens(self, words: list[str], told: list[bytes]):
        """Ids of the words, flat, with number and start per word, and whether their bytes are those of the word."""
        flat, n = self.flat(words)
        start = np.cumsum(n) - n
        ids, raw = flat.tolist(), self.raw
        same = np.fromiter((b"".join([raw[i] for i in ids[s : s + m]]) == word for s, m, word in zip(start.tolist(), n.tolist(), told)), bool, len(words))
        return flat, n, start, same


class _Windows:
    """Windows by their pair of id tuples. Each is aligned once: its groups as text, their number, and its linked id pairs."""

    def __init__(self, a: _Side, b: _Side):
        self.code: dict[bytes, int] = {}
        self.text: list[str] = []
        self.groups: list[np.ndarray] = []
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # window, pair, how often
        self.first_b = 2 * len(a.raw)
        ends = [(a, ","), (a, "|"), (b, ","), (b, ";")]
        self.signs = [f"{i}{end}" for side, end in ends for i in range(len(side.raw))]
        self.n_a, self.n_b = len(a.raw), len(b.raw)

    def align(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Align new windows together: `group_a` and `group_b` are ends of all groups in the ids, `first` and `count` the windows' groups."""
        number = len(self.text) + np.arange(len(first))
        of = _runs(count, first)
        owner = np.repeat(number, count)
        start_a, start_b = (np.where(of > 0, ends[of - 1], 0) for ends in (group_a, group_b))
        n, m = group_a[of] - start_a, group_b[of] - start_b
        # ids with their separators, a group's A tokens before its B tokens
        at = np.cumsum(n + m) - (n + m)
        signs = np.empty(int((n + m).sum()), np.int64)
        signs[_runs(n, at)] = ids_a[_runs(n, start_a)]
        signs[_runs(m, at + n)] = ids_b[_runs(m, start_b)] + 2 * self.n_a
        signs[at + n - 1] += self.n_a
        signs[at + n + m - 1] += self.n_b
        table = self.signs
        told = [table[s] for s in signs.tolist()]
        ends = np.cumsum(np.bincount(owner - number[0], n + m, len(first)).astype(np.int64)).tolist() if len(first) else []
        self.text += ["".join(told[x:y]) for x, y in zip([0, *ends], ends)]
        self.groups.append(count)
        # all pairs of a group; a very long group is counted by its different ids instead
        short = n * m <= 4096
        size = (n * m)[short]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        wide = np.repeat(m[short], size)
        left = ids_a[np.repeat(start_a[short], size) + within // wide]
        right = ids_b[np.repeat(start_b[short], size) + within % wide]
        self.links.append((np.repeat(owner[short], size), left << 32 | right, np.ones(len(left), np.int64)))
        for k in np.flatnonzero(~short).tolist():
            x, times_x = np.unique(ids_a[start_a[k] : start_a[k] + n[k]], return_counts=True)
            y, times_y = np.unique(ids_b[start_b[k] : start_b[k] + m[k]], return_counts=True)
            self.links.append((np.full(len(x) * len(y), owner[k]), (x[:, None] << 32 | y[None]).reshape(-1), (times_x[:, None] * times_y[None]).reshape(-1)))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different id pairs, in order; and for all windows, one after the other, their number, places in that list and weights."""
        window, pair, times = (np.concatenate([x[c] for x in self.links]) if self.links else np.zeros(0, np.int64) for c in range(3))
        listed, place = np.unique(pair, return_inverse=True)
        both, back = np.unique(window * max(len(listed), 1) + place, return_inverse=True)
        weight = np.bincount(back, times, len(both)).astype(np.int64)
        return listed, np.bincount(both // max(len(listed), 1), minlength=len(self.text)), both % max(len(listed), 1), weight


def _block(texts: list[str], a: _Side, b: _Side):
    """Per text its numbers of tokens and its window numbers (none where tokens don't give the text back), and the windows."""
    number = Numbered()
    codes = [np.fromiter(map(number.__getitem__, spaced_words(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
    words = list(number)
    del number
    told = [w.encode() for w in words]
    flat_a, n_a, start_a, same_a = a.tokens(words, told)
    flat_b, n_b, start_b, same_b = b.tokens(words, told)
    same, width = same_a & same_b, np.fromiter(map(len, told), np.int64, len(told))
    del told, words
    found = _Windows(a, b)
    out = []
    low = 0
    while low < len(texts):
        # full token sequences of some texts at a time
        high, n = low, 0
        while high < len(texts) and (n < 300_000 or high == low):
            n += len(codes[high])
            high += 1
        # words that don't give their bytes back make the whole text's bytes differ, unless such words make up for one another
        good = [bool(same[c].all()) or (b"".join([a.raw[i] for i in flat_a[_runs(n_a[c], start_a[c])]]) == (" " + t).encode()
                                        == b"".join([b.raw[i] for i in flat_b[_runs(n_b[c], start_b[c])]])) for c, t in zip(codes[low:high], texts[low:high])]
        used = [c if ok else c[:0] for c, ok in zip(codes[low:high], good)]
        code = np.concatenate(used)
        ids_a, ids_b = flat_a[_runs(n_a[code], start_a[code])], flat_b[_runs(n_b[code], start_b[code])]
        ends_a, ends_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
        total = int(ends_a[-1]) if len(ends_a) else 0
        at_a, at_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        at_a[ends_a] = True
        at_b[ends_b] = True
        # a place where tokens of both end is an anchor if the next tokens of both are marked with a space, or a text ends
        shared_a, shared_b = np.flatnonzero(at_b[ends_a]), np.flatnonzero(at_a[ends_b])
        marked_a, marked_b = np.append(a.spaced[ids_a], True), np.append(b.spaced[ids_b], True)
        text_ends = np.cumsum([int(width[c].sum()) for c in used])
        closing = np.zeros(total + 1, bool)
        closing[text_ends] = True
        anchor = np.flatnonzero((marked_a[shared_a + 1] & marked_b[shared_b + 1]) | closing[ends_a[shared_a]])
        stop_a, stop_b = shared_a[anchor] + 1, shared_b[anchor] + 1
        raw_a, raw_b = ids_a.astype(np.int32).tobytes(), ids_b.astype(np.int32).tobytes()
        known, windows, fresh = found.code, [], []
        i = j = 0
        for p, q in zip((stop_a * 4).tolist(), (stop_b * 4).tolist()):
            key = raw_a[i:p] + BETWEEN + raw_b[j:q]
            w = known.get(key)
            if w is None:
                w = known[key] = len(known)
                fresh.append(len(windows))
            windows.append(w)
            i, j = p, q
        first = np.concatenate([[0], anchor[:-1] + 1])[fresh] if fresh else np.zeros(0, np.int64)
        if fresh:
            found.align(ids_a, ids_b, shared_a + 1, shared_b + 1, first, anchor[fresh] + 1 - first)
        windows = np.array(windows, np.int32)
        owner_end = np.searchsorted(ends_a[stop_a - 1], text_ends, side="right") if len(stop_a) else np.zeros(len(used), np.int64)
        begin = 0
        for c, last in zip(used, owner_end.tolist()):
            out.append((int(n_a[c].sum()), int(n_b[c].sum()), windows[begin:last]))
            begin = last
        low = high
    return out, found


def _blocks(frames, block_bytes: int):
    ids, texts, held = [], [], 0
    for frame in frames:
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
            if held >= block_bytes:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _long(values) -> pd.Series:
    return pd.Series(values, dtype="Int64")


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.uint32).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint32).astype(np.int64)


def _sides(model_a: bytes, model_b: bytes) -> tuple[_Side, _Side]:
    return _Side(ByteTokenizer(model_a)), _Side(PieceTokenizer(model_b))


def _slim(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # ids as text: pandas would turn a column with nulls into floats
    return texts.select(texts[id_col].cast("long").cast("string").alias("doc_id"), F.coalesce(texts[text_col].cast("string"), F.lit("")).alias("text"))


def aligned_groups(docs: DataFrame, byte_model: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row (doc_id, n_a, n_b, n_groups, groups) per row of `docs`; `groups` written as `a1,a2|b1;a3|b2,b3`. See `link_scores`."""
    a_model, b_model = model_bytes(byte_model), PieceTokenizer.checked(model_bytes(piece_model))

    def run(frames):
        sides = _sides(a_model, b_model)
        for ids, texts in _blocks(frames, block_bytes):
            found, windows = _block(texts, *sides)
            groups = np.concatenate([*windows.groups, np.zeros(0, np.int64)])
            for k in range(0, len(found), 1000):
                part = found[k : k + 1000]
                yield pd.DataFrame({
                    "doc_id": _long([None if i is None else int(i) for i in ids[k : k + 1000]]), "n_a": [f[0] for f in part], "n_b": [f[1] for f in part],
                    "n_groups": [int(groups[f[2]].sum()) for f in part], "groups": ["".join([windows.text[w] for w in f[2]])[:-1] for f in part]})

    return _slim(docs, id_col, text_col).mapInPandas(run, "doc_id long, n_a long, n_b long, n_groups long, groups string")


_ROWS = """block long, kind int, doc_id string, n_a long, n_b long, n_groups long, n_links long, digest string, used binary, times binary,
    pairs array<long>, docs array<int>, sizes binary, places binary, weights binary"""


def _linked(a_model: bytes, b_model: bytes, block_bytes: int):
    names = [x.split()[0] for x in _ROWS.split(",")]

    def run(frames):
        sides = _sides(a_model, b_model)
        task = TaskContext.get().partitionId()
        for turn, (ids, texts) in enumerate(_blocks(frames, block_bytes)):
            found, windows = _block(texts, *sides)
            pairs, sizes, place, weight = windows.pairs()
            start = np.cumsum(sizes) - sizes
            links = np.add.reduceat(weight, start) if len(start) else weight
            groups = np.concatenate([*windows.groups, np.zeros(0, np.int64)])
            block, docs = task << 32 | turn, np.zeros(len(pairs), np.int32)
            for k in range(0, len(found), 2000):
                part = found[k : k + 2000]
                rows = []
                for doc_id, (n_a, n_b, of) in zip(ids[k : k + 2000], part):
                    used, times = np.unique(of, return_counts=True)
                    docs[np.unique(place[_runs(sizes[used], start[used])])] += 1
                    digest = sha256("".join([windows.text[w] for w in of.tolist()])[:-1].encode()).hexdigest() if len(of) else ""
                    rows.append((block, 0, doc_id, n_a, n_b, int(groups[used] @ times), int(links[used] @ times), digest,
                                 _packed(np.diff(used, prepend=0)), _packed(times)) + (None,) * 5)
                yield pd.DataFrame(rows, columns=names)
            yield pd.DataFrame([(block, 1, None, 0, 0, 0, 0, None, None, None, pairs, docs, _packed(sizes), _packed(place), _packed(weight))], columns=names)

    return run


def _scored(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    words = rows[rows["kind"] == 1].iloc[0]
    sizes, place, weight = (_unpacked(words[c]) for c in ("sizes", "places", "weights"))
    at = table["at"].to_numpy()
    total, best_total = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
    total[at], best_total[at] = table["n"].to_numpy(), table["best"].to_numpy()
    start = np.cumsum(sizes) - sizes
    sums = lambda value: np.add.reduceat(weight * value[place], start) if len(start) else np.zeros(0, np.int64)
    of_window, best_of_window = sums(total), sums(best_total)
    docs = rows[rows["kind"] == 0]
    out = []
    for used, times in zip(docs["used"], docs["times"]):
        u, t = np.cumsum(_unpacked(used)), _unpacked(times)
        out.append((int(best_of_window[u] @ t), int(of_window[u] @ t)))
    kept = docs[["doc_id", "n_a", "n_b", "n_groups", "n_links", "digest"]].reset_index(drop=True)
    return pd.concat([kept, pd.DataFrame(out, columns=["n_best", "count_sum"])], axis=1)


def link_scores(
    docs: DataFrame, byte_model: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A space and the text is encoded by the byte-level tokenizer (A), the text by the piece tokenizer (B, which adds the space), each
    text in full: words that begin at a space after a letter, digit or sign are segmented once per block, as neither tokenizer joins
    across such a place. Where tokens of both end and both go on with a space-marked token the text is cut into windows; a window's
    pair of id tuples is aligned once. A group ends wherever tokens of both end; every A and B occurrence of a group are linked.
    A pair's count is the number of rows that hold it linked; `n_best` counts links whose count is the highest of their A id.

    A task aligns blocks of about `block_bytes` of text, whose rows hold numbers of windows and whose last row holds the windows'
    pairs; it is written to the shared folder once. Pairs travel once per block, however many documents hold them; their counts come
    back to the block by a join. A pair that all documents hold is one row per block. Texts are not shuffled.

    Null and empty texts, and texts that tokens don't give back byte by byte, have no tokens: zeros and an empty digest. Rows with
    one id count as documents of their own; null ids are kept. Other columns are ignored. An empty table gives an empty result.
    """
    a_model, b_model = model_bytes(byte_model), PieceTokenizer.checked(model_bytes(piece_model))
    rows = written(_slim(docs, id_col, text_col).mapInPandas(_linked(a_model, b_model, block_bytes), _ROWS))
    held = rows.where("kind = 1").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "p"))
    held = held.select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = written(held.groupBy("pair").agg(F.sum("docs").alias("n")))
    first = F.shiftright("pair", 32)
    # no more rows than A has ids
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    table = counts.withColumn("a", first).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    back = held.drop("docs").join(table, "pair").select(F.col("block").alias("home"), "at", "n", "best")
    left = rows.drop("pairs", "docs")
    out = left.groupBy("block").cogroup(back.groupBy("home")).applyInPandas(
        _scored, "doc_id string, n_a long, n_b long, n_groups long, n_links long, digest string, n_best long, count_sum long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
