"""Scores under a class-based bigram model: exchange clustering of words, class transitions and word emissions."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.text import fold, words
from cohortry.session import durable


@dataclass(frozen=True)
class BrownSettings:
    """`frequent` words, and `endings` (last two bytes) of all others, are the items that get clustered into `classes`.

    `near` words at most have their counts sent to every task; the counts of all others are joined. `blend`: weight of a class's own
    frequency in its transitions.
    """

    frequent: int = 1024
    endings: int = 512
    classes: int = 64
    rounds: int = 8
    near: int = 65_536
    blend: float = 5.0


END, OTHER = 0, 1  # items: the end of a text (also what comes before its first word), words of a rare ending


class Items(dict):
    """Word to packed number: its place among the near words plus one (0: none), times 2**16, plus its item. Filled as met."""

    def __init__(self, near: dict[bytes, int], frequent: dict[bytes, int], endings: dict[bytes, int]):
        super().__init__()
        self.near, self.frequent, self.endings = near, frequent, endings

    def __missing__(self, word: bytes) -> int:
        item = self.frequent.get(word)
        if item is None:
            item = self.endings.get(word[-2:], OTHER)
        code = (self.near.get(word, -1) + 1 << 16) | item
        if len(self) > 150_000:
            self.clear()
        self[word] = code
        return code

    def codes(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def __reduce__(self):
        return Items, (self.near, self.frequent, self.endings)


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of every item from the counts of neighbouring items, by exchange: each item in turn goes to the class that gives the class
    bigrams the highest likelihood, until none moves. Item 0 stays alone in class 0. Rounds go by falling frequency."""
    n = len(pairs)
    k = max(2, min(classes, n))
    order = np.argsort(-(pairs.sum(axis=0) + pairs.sum(axis=1)), kind="stable")
    order = order[order != END]
    of = np.zeros(n, dtype=np.int64)
    of[order] = 1 + np.arange(len(order)) % (k - 1)
    pairs = pairs.astype(np.float64)

    def ent(x):
        return x * np.log(np.maximum(x, 1.0))

    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    table = member.T @ pairs @ member
    for _ in range(rounds):
        moved = 0
        for w in order.tolist():
            c = of[w]
            member[w, c] = 0
            ahead, back = pairs[w] @ member, pairs[:, w] @ member  # without itself
            own = pairs[w, w]
            table[c] -= ahead
            table[:, c] -= back
            table[c, c] -= own
            rows, cols = ent(table + ahead[None, :]).sum(axis=1), ent(table + back[:, None]).sum(axis=0)
            base_rows, base_cols = ent(table).sum(axis=1), ent(table).sum(axis=0)
            diag = np.diag(table)
            # a class that takes the item changes its row and its column; where they cross counts once
            cross = ent(diag + ahead + back + own) - ent(diag + ahead) - ent(diag + back) + ent(diag)
            gain = rows - base_rows + cols - base_cols + cross
            left, right = table.sum(axis=1) + back, table.sum(axis=0) + ahead
            gain -= ent(left + ahead.sum() + own) - ent(left) + ent(right + back.sum() + own) - ent(right)
            gain[0] = -np.inf
            to = int(np.argmax(gain))
            if gain[to] <= gain[c] + 1e-9:
                to = c
            moved += to != c
            of[w] = to
            member[w, to] = 1
            table[to] += ahead
            table[:, to] += back
            table[to, to] += own
        if not moved:
            break
    return of


@dataclass
class Brown:
    """Everything a task needs; of bounded size."""

    items: Items
    of: np.ndarray  # class of an item
    near_log: np.ndarray  # log10(count + 0.1) of near words
    near_known: np.ndarray
    transition: np.ndarray  # log10, from class to class
    emission: np.ndarray  # log10 of an item within its class
    spread: np.ndarray  # log10 of what shares an item's words; 0 for items of one word
    single: np.ndarray
    end_log: float
    end_known: bool
    base_log: float

    def score(self, tokens: list[bytes]) -> tuple[int, int, float, float, Counter]:
        """(tokens, known, base, score, far words with counts): log10(count + 0.1) of the far words is yet to be added to both sums. A far
        word is never an item of its own."""
        codes = self.items.codes(tokens)
        place, item = (codes >> 16) - 1, codes & 0xFFFF
        path = np.concatenate(([END], item, [END]))
        cls = self.of[path]
        score = self.transition[cls[:-1], cls[1:]].sum() + self.emission[path[1:]].sum() - self.spread[item].sum()
        near = place >= 0
        logs = self.near_log[place[near]]
        score += logs[~self.single[item[near]]].sum()
        base = logs.sum() + self.end_log - (len(tokens) + 1) * self.base_log
        known = int(self.near_known[place[near]].sum()) + self.end_known
        far = Counter([tokens[i] for i in np.flatnonzero(~near).tolist()])
        return len(tokens) + 1, known, float(base), float(score), far


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (word, c) over all rows of (raw): counted within batches, then summed by word."""

    def frame(seen):
        return pd.DataFrame({"word": list(seen.keys()), "c": np.fromiter(seen.values(), dtype=np.int64, count=len(seen))})

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for raw in batch["raw"]:
                seen.update(words(raw))
                if len(seen) > 200_000:  # a bounded number of words at a time
                    yield frame(seen)
                    seen = Counter()
        yield frame(seen)

    return texts.select("raw").mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def pair_counts(texts: DataFrame, items: Items, n: int, blocks: int = 16) -> np.ndarray:
    """Counts of neighbouring items over all rows of (raw): n x n, summed per task, then by row blocks."""
    shared = texts.sparkSession.sparkContext.broadcast(items)
    edges = [n * b // blocks for b in range(blocks + 1)]

    def run(batches):
        table = np.zeros(n * n, dtype=np.int64)
        for batch in batches:
            for raw in batch["raw"]:
                path = np.concatenate(([END], shared.value.codes(words(raw)) & 0xFFFF, [END]))
                at, times = np.unique(path[:-1] * n + path[1:], return_counts=True)
                table[at] += times
        for b in range(blocks):
            part = table[edges[b] * n : edges[b + 1] * n]
            if part.any():
                yield pd.DataFrame({"block": [b], "counts": [zlib.compress(part.tobytes(), 1)]})

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        both = sum(np.frombuffer(zlib.decompress(x), dtype=np.int64) for x in rows["counts"])
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "counts": [zlib.compress(np.asarray(both).tobytes(), 1)]})

    packed = texts.select("raw").mapInPandas(run, "block int, counts binary")
    # two rounds of sums, so that no task gathers a table from every task of the first
    packed = packed.withColumn("turn", F.pmod(F.spark_partition_id(), F.lit(64)))
    once = packed.groupBy("block", "turn").applyInPandas(lambda rows: total(rows[["block", "counts"]]), "block int, counts binary")
    out = np.zeros(n * n, dtype=np.int64)
    for row in once.groupBy("block").applyInPandas(total, "block int, counts binary").collect():  # n x n in all
        out[edges[row["block"]] * n : edges[row["block"] + 1] * n] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    return out.reshape(n, n)


def most_frequent(counts: DataFrame, n: int) -> list[tuple[bytes, int]]:
    """The n words with the highest counts, ties by word. A histogram over 64ths of octaves (some thousand rows at most) tells from which
    count on; only such words, and the best of the step below, are sent."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 64)
    sizes = sorted(((r["s"], r["count"]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)
    taken, edge = 0, None
    for at, size in sizes:
        if taken + size > n:
            edge = at
            break
        taken += size
    above = counts if edge is None else counts.where(step > edge)
    rows = above.collect()
    if edge is not None and taken < n:
        rows += counts.where(step == edge).orderBy(F.desc("c"), "word").limit(n - taken).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda r: (-r[1], r[0]))


def fit_brown(training: DataFrame, settings: BrownSettings) -> tuple[Brown, DataFrame, int]:
    """(model, word counts, training tokens) from rows of (raw). The counts cover all rows and stay distributed."""
    s = settings
    spark = training.sparkSession
    counts = durable(word_counts(training))
    total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    texts = training.count()
    n_tokens, n_types = int(total[1]) + texts, int(total[0]) + (texts > 0)
    top = most_frequent(counts, s.near)
    frequent = top[: s.frequent]
    ending = F.expr("substring(word, greatest(length(word) - 1, 1), 2)")
    by_ending = {bytes(r["e"]): [r["c"], r["n"]] for r in counts.groupBy(ending.alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}  # 2**16 at most
    for word, c in frequent:
        by_ending[word[-2:]][0] -= c
        by_ending[word[-2:]][1] -= 1
    chosen = sorted((e for e, (c, _) in by_ending.items() if c > 0), key=lambda e: (-by_ending[e][0], e))[: s.endings]
    items = Items({w: i for i, (w, _) in enumerate(top)}, {w: 2 + i for i, (w, _) in enumerate(frequent)}, {e: 2 + len(frequent) + i for i, e in enumerate(chosen)})
    n = 2 + len(frequent) + len(chosen)

    pairs = pair_counts(training, items, n)
    of = exchange(pairs, s.classes, s.rounds)
    k = int(of.max()) + 1
    size = np.zeros(n)
    size[END] = texts
    size[2 : 2 + len(frequent)] = [c for _, c in frequent]
    types = np.zeros(n)
    for i, e in enumerate(chosen):
        size[2 + len(frequent) + i], types[2 + len(frequent) + i] = by_ending[e]
    rest = [v for e, v in by_ending.items() if e not in items.endings]
    size[OTHER], types[OTHER] = sum(v[0] for v in rest), sum(v[1] for v in rest)
    single = np.zeros(n, dtype=bool)
    single[END] = True
    single[2 : 2 + len(frequent)] = True
    in_class = np.bincount(of, weights=size, minlength=k)
    members = np.bincount(of, minlength=k)
    share = (in_class + 0.5) / (in_class.sum() + 0.5 * k)
    moves = np.zeros((k, k))
    np.add.at(moves, (of[:, None], of[None, :]), pairs)
    transition = (moves + s.blend * share[None, :]) / (moves.sum(axis=1, keepdims=True) + s.blend)
    emission = (size + 0.5) / (in_class[of] + 0.5 * members[of])
    spread = np.where(single, 1.0, size + 0.1 * (types + 1))
    near = np.array([c for _, c in top], dtype=float)
    model = Brown(
        items, of, np.log10(near + 0.1), near > 0, np.log10(transition), np.log10(emission), np.log10(spread), single,
        float(np.log10(texts + 0.1)), texts > 0, float(np.log10(n_tokens + 0.1 * (n_types + 1))),
    )
    return model, counts, n_tokens


def brown_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0, settings: BrownSettings = BrownSettings()
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    All counts come from every whole text whose crc32 fold isn't `held`. P(word | word before) is P(class | class before) times P(item |
    class) times, for words that share an item by their ending, P(word | item) with 0.1 added per known word and once for all
    unknown ones: a distribution over the known words and one place for all others of each ending.

    Null texts are empty: one token, the end. Repeated rows each get a row, null ids stay null (fold of the empty text). Without
    training rows the base gives each token probability one. An empty table gives an empty result.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw")).withColumn("held_out", fold("doc_id", folds) == held)
    model, counts, n_tokens = fit_brown(texts.where(~F.col("held_out")), settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "word binary, key long, tf long, doc_id string, n_tokens long, known long, base double, score double"

    def run(batches):
        m = shared.value
        out: list[tuple] = []
        for batch in batches:
            for key, doc, raw in zip(batch["key"].tolist(), batch["doc_id"], batch["raw"]):
                n, known, base, score, far = m.score(words(raw))
                # a row of its own for the text: no word has a blank
                out.append((b" %d" % key, key, 0, doc, n, known, base, score))
                out.extend((w, key, tf, None, 0, 0, 0.0, 0.0) for w, tf in far.items())
                if len(out) > 50_000:
                    yield frame(out)
                    out = []
        yield frame(out)

    def frame(out):
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    # ids travel as text: pandas has no whole numbers with nulls
    keyed = texts.select(F.col("doc_id").cast("string").alias("doc_id"), "raw", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "raw").alias("key"))
    rows = keyed.mapInPandas(run, schema)
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1)) * F.col("tf")
    is_text = F.col("tf") == 0
    summed = rows.join(counts, "word", "left").groupBy("key").agg(
        F.max("doc_id").cast("long").alias("doc_id"), F.count(F.when(is_text, 1)).alias("rows"), F.max("n_tokens").alias("n_tokens"),
        F.sum("known").alias("known"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("far_known"),
        F.sum(F.col("base") + F.when(is_text, 0.0).otherwise(log)).alias("base"),
        F.sum(F.col("score") + F.when(is_text, 0.0).otherwise(log)).alias("score"),
    )
    # equal rows have one key: their sums are multiples
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(
        "doc_id", (fold("doc_id", folds) == held).alias("held_out"), "n_tokens",
        ((F.col("known") + F.col("far_known")) / F.col("rows")).cast("long").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"),
    )
