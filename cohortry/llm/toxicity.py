"""Toxicity from two class-conditional Kneser-Ney models with a shared backoff."""

from __future__ import annotations

from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.text import fold, raw_texts, rolling, word_codes, words
from cohortry.session import durable


@dataclass(frozen=True)
class ToxicitySettings:
    """`max_rows` labelled rows at most are learnt from (the classifier's bounded sample); scoring reads every row.

    Discounts are shares of a class's documents, at least `least` documents of the smaller class. `stem`: bytes of a word that its
    rare forms back off to. `decisive`: log-ratios of a word below it are taken as equal.
    """

    max_rows: int = 30_000
    stem: int = 6
    word_discount: float = 0.006
    stem_discount: float = 0.018
    least: float = 1.5
    decisive: float = 1.5
    cut: float = 0.3


KINDS = ("stem", "word", "pair")


def expressions(raw: bytes, stem: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the stem and the word at every place, and of the word with the one before it (from the second place on)."""
    tokens = words(raw)
    codes = word_codes(tokens)
    stems = np.fromiter((crc32(t[:stem]) for t in tokens), dtype=np.uint64, count=len(tokens))
    return stems, codes, rolling(codes, 2)


@dataclass
class Model:
    """What is left of the counts after discounting, by sorted code: for every kind, for both classes.

    Counts are numbers of documents, so a word repeated in one text counts once. All counts at or below the discount leave
    nothing and aren't kept; their mass goes to the level below: pair to word, word to stem, stem to the shared counts.
    """

    stem: int
    decisive: float
    codes: dict[str, np.ndarray] = field(default_factory=dict)
    mass: dict[str, np.ndarray] = field(default_factory=dict)  # two columns: ordinary, toxic
    rest: dict[str, np.ndarray] = field(default_factory=dict)  # share left for the level below
    shared: dict[str, np.ndarray] = field(default_factory=dict)  # shared probability within the level below
    context: tuple = ()  # codes of words with a kept pair, share left for the level below by class
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def _find(self, kind: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.codes[kind]
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def ratios(self, raw: bytes) -> np.ndarray:
        """Log-likelihood under the toxic model less that under the ordinary one, at every word."""
        stems, codes, pairs = expressions(raw, self.stem)
        if not len(codes):
            return np.zeros(0)
        # a probability that both classes share cancels out; it counts only where a level adds mass of its own
        at, known = self._find("stem", stems)
        p = np.tile(self.rest["stem"], (len(codes), 1))
        if len(self.codes["stem"]):
            own = self.mass["stem"][at] / self.shared["stem"][at, None]
            p += np.where(known[:, None], own, 0.0)
        at, known = self._find("word", codes)
        p *= self.rest["word"]
        if len(self.codes["word"]):
            own = self.mass["word"][at] / self.shared["word"][at, None]
            p += np.where(known[:, None], own, 0.0)
        if len(pairs) and len(self.codes["pair"]):
            keys, left = self.context
            c = np.minimum(np.searchsorted(keys, codes[:-1]), len(keys) - 1)
            p[1:] *= np.where((keys[c] == codes[:-1])[:, None], left[c], 1.0)
            at, known = self._find("pair", pairs)
            own = self.mass["pair"][at] / self.shared["pair"][at, None]
            p[1:] += np.where(known[:, None], own, 0.0)
        return np.log(p[:, 1]) - np.log(p[:, 0])

    def features(self, raw: bytes) -> tuple[float, float]:
        """Length-normalised ratio of decisive words for and against the toxic model."""
        r = self.ratios(raw)
        n = max(1, len(r))
        return float(r[r > self.decisive].sum() / n), float(-r[r < -self.decisive].sum() / n)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(features) @ self.weights, -35, 35)))


def _design(features: np.ndarray) -> np.ndarray:
    features = np.asarray(features, dtype=float).reshape(-1, 2)
    return np.column_stack((np.ones(len(features)), np.log(features + 1e-3)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> Model:
    """Model from `docs` (doc_id, raw) and `labels` (doc_id, label 0 or 1; others and nulls are ignored, a conflict counts as 1).

    The sample is the `max_rows` labelled ids with the smallest hashes: the same on every run. Three quarters of it are counted, by
    Spark, per class and expression; only expressions beyond their discount come back, so what the driver holds is bounded by the
    sample over the discount. The last quarter fits the three numbers that turn ratios into a probability. Without labels of
    both classes every score is 0.5.
    """
    s = settings
    chosen = durable(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
        .groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_rows)
    )
    sample = durable(docs.join(F.broadcast(chosen), "doc_id").withColumn("fit", F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(4)) > 0))
    sizes = {r["label"]: r["count"] for r in sample.where("fit").groupBy("label").count().collect()}
    model = Model(s.stem, s.decisive)
    for kind in KINDS:
        model.codes[kind] = np.zeros(0, np.uint64)
        model.rest[kind] = np.ones(2)
    if len(sizes) < 2:
        return model
    n_docs = np.array([sizes[0], sizes[1]], dtype=float)
    discount = {}
    for kind, share in zip(KINDS, (s.stem_discount, s.word_discount, s.word_discount)):
        discount[kind] = max(share, s.least / n_docs.min()) * n_docs

    def expressed(batches):
        for batch in batches:
            out = []
            for label, raw in zip(batch["label"], batch["raw"]):
                stems, codes, pairs = expressions(raw, s.stem)
                lower = (np.zeros(len(stems), np.uint64), stems, codes[:-1])
                for k, (at, below) in enumerate(zip((stems, codes, pairs), lower)):
                    got, first = np.unique(at, return_index=True)
                    out.append((np.full(len(got), k), np.full(len(got), label), got.view(np.int64), below[first].view(np.int64)))
            if out:
                yield pd.DataFrame(dict(zip(("kind", "label", "code", "below"), map(np.concatenate, zip(*out)))))

    counts = durable(
        sample.where("fit").mapInPandas(expressed, "kind int, label int, code long, below long").groupBy("kind", "code").agg(
            F.sum((F.col("label") == 0).cast("long")).alias("n0"), F.sum((F.col("label") == 1).cast("long")).alias("n1"), F.min("below").alias("below")
        )
    )
    totals = {r["kind"]: np.array([r["a"], r["b"], r["types"]], dtype=float) for r in counts.groupBy("kind").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"), F.count("*").alias("types")).collect()}
    over = " or ".join(f"(kind = {k} and (n0 > {discount[kind][0]} or n1 > {discount[kind][1]}))" for k, kind in enumerate(KINDS))
    kept = counts.where(over)
    stems = counts.where("kind = 0").select(F.col("code").alias("below"), (F.col("n0") + F.col("n1")).alias("all"))
    contexts = counts.where("kind = 2").groupBy("below").agg(F.sum("n0").alias("h0"), F.sum("n1").alias("h1"))
    # words know their stem's shared count, pairs all counts of pairs with their first word
    rows = kept.where("kind = 0").withColumns({"all": F.lit(0).cast("long"), "h0": F.lit(0).cast("long"), "h1": F.lit(0).cast("long")})
    rows = rows.unionByName(kept.where("kind = 1").join(stems, "below").withColumns({"h0": F.lit(0).cast("long"), "h1": F.lit(0).cast("long")}))
    rows = rows.unionByName(kept.where("kind = 2").join(contexts, "below").withColumn("all", F.lit(0).cast("long")))
    table = rows.toPandas().sort_values(["kind", "code"])
    for k, kind in enumerate(KINDS):
        part = table[table["kind"] == k]
        codes = part["code"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(codes)
        part, codes = part.iloc[order], codes[order]
        n = part[["n0", "n1"]].to_numpy(float)
        left = np.maximum(n - discount[kind], 0)
        both = n.sum(axis=1)
        model.codes[kind] = codes
        if kind == "stem":
            model.mass[kind] = left / totals[k][:2]
            model.rest[kind] = 1 - model.mass[kind].sum(axis=0)
            model.shared[kind] = (both + 0.5) / (totals[k][:2].sum() + 0.5 * totals[k][2])
        elif kind == "word":
            # relative to the stem level: its shared probability times the word's share of its stem
            stem_p = (part["all"].to_numpy(float) + 0.5) / (totals[0][:2].sum() + 0.5 * totals[0][2])
            model.mass[kind] = left / totals[k][:2]
            model.rest[kind] = 1 - model.mass[kind].sum(axis=0)
            model.shared[kind] = stem_p * np.minimum(1.0, (both + 0.5) / (part["all"].to_numpy(float) + 0.5))
        else:
            below = part["below"].to_numpy(np.int64).view(np.uint64)
            seen = part[["h0", "h1"]].to_numpy(float)
            model.mass[kind] = left / np.maximum(seen, 1)
            keys, where = np.unique(below, return_inverse=True)
            gone = np.zeros((len(keys), 2))
            np.add.at(gone, where, model.mass[kind])
            model.context = (keys, 1 - gone)
            model.shared[kind] = (both + 0.5) / (seen.sum(axis=1) + 1)
    tuned = sample.where("not fit").select("doc_id", "label", "raw")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen = tuned.select("label", _features(shared, F.col("raw")).alias("x")).select("label", "x.*").toPandas()
    if len(seen):
        model.weights = _logistic(_design(seen[["toward", "against"]].to_numpy()), seen["label"].to_numpy(float))
    return model


def _features(shared, raw: Column) -> Column:
    def run(raws: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.features(text) for text in raws], columns=["toward", "against"], dtype=float)

    return F.pandas_udf(run, "toward double, against double")(raw)


def toxicity_column(spark: SparkSession, raw: Column, model: Model) -> Column:
    """The probability of label 1 for texts given as bytes."""
    shared = spark.sparkContext.broadcast(model)

    def run(raws: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array([shared.value.features(text) for text in raws])))

    return F.pandas_udf(run, "double")(raw)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = 4, held: int = 2, settings: ToxicitySettings = ToxicitySettings(),
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= `settings.cut`).

    Only text is an input of a score. Labels are learnt from rows whose crc32 fold isn't `held`; labels of unknown documents are
    ignored. Null texts count as empty and get the score of a text without a decisive word. Repeated rows each get a row; null
    ids stay null and are never learnt from. An empty table gives an empty result; without labels every score is 0.5.
    """
    texts = raw_texts(docs, id_col, text_col)
    given = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(fold("doc_id", folds) != held)
    model = fit_toxicity(texts, given, settings)
    scored = texts.select("doc_id", toxicity_column(docs.sparkSession, F.col("raw"), model).alias("score"))
    return scored.select(
        "doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score",
        (F.col("score") >= settings.cut).cast("int").alias("predicted"),
    )
