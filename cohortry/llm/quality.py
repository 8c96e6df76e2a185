"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.text import fold, raw_texts, rolling, word_codes

_SHAPES = bytes(
    ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256)
)
_RUN = re.compile(rb"([aA0])\1+")


@dataclass(frozen=True)
class QualitySettings:
    """`max_rows` labelled rows at most are learnt from (the classifier's bounded sample); scoring reads every row."""

    max_rows: int = 20_000
    buckets: int = 1 << 18
    parts: int = 8
    epochs: int = 3
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 0.0005
    l2: float = 0.001
    cut: float = 0.3


def features(raw: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of a text: bucket 0 is the constant; words, and one to three neighbouring word shapes, are hashed.

    A shape replaces letters by one letter of their case and digits by zero and merges runs, so rare words still count.
    Values are square roots of shares within each kind of n-gram, so the length of a text doesn't matter.
    """
    found, values = [np.zeros(1, dtype=np.int64)], [np.ones(1)]
    tokens = raw.split()
    shapes = word_codes(_RUN.sub(rb"\1", raw.translate(_SHAPES)).split())
    kinds = [rolling(word_codes(tokens), 1)] + [rolling(shapes, n) + np.uint64(n) for n in (1, 2, 3)]
    for grams in kinds:
        if len(grams):
            at, n = np.unique((grams % np.uint64(buckets - 1)).astype(np.int64) + 1, return_counts=True)
            found.append(at)
            values.append(np.sqrt(n / len(grams)))
    return np.concatenate(found), np.concatenate(values)


def _fit(rows: list[tuple[np.ndarray, np.ndarray, int]], s: QualitySettings) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal over the rows in the given order; non-zero weights by bucket."""
    z, n = np.zeros(s.buckets), np.zeros(s.buckets)

    def weights(at):
        shrunk = np.sign(z[at]) * s.l1 - z[at]
        w = shrunk / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        return np.where((np.abs(z[at]) <= s.l1) & (at > 0), 0.0, w)

    for _ in range(s.epochs):
        for at, x, label in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            # features of one text may share a bucket
            np.add.at(z, at, g - step * w)
            np.add.at(n, at, g * g)
    w = weights(np.arange(s.buckets))
    at = np.flatnonzero(w)
    return at, w[at]


def fit_quality(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> np.ndarray:
    """Weights by bucket. `docs`: doc_id, text; `labels`: doc_id, label 0 or 1 (others and nulls are ignored; a conflict counts as 0).

    The sample is the `max_rows` labelled ids with the smallest hashes: the same ids on every run. It is cut into `parts`, each
    part is fitted by its own task and the weights are averaged. Without any labelled row all weights are zero.
    """
    s = settings
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
        .groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_rows)
    )
    def sparse(batches):
        for batch in batches:
            made = [features(raw, s.buckets) for raw in batch["raw"]]
            yield pd.DataFrame({
                "part": batch["part"], "doc_id": batch["doc_id"], "label": batch["label"],
                "at": [a.astype("<i8").tobytes() for a, _ in made], "x": [x.astype("<f8").tobytes() for _, x in made],
            })

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "doc_id"], kind="stable")
        data = [(np.frombuffer(a, "<i8"), np.frombuffer(x, "<f8"), y) for a, x, y in zip(rows["at"], rows["x"], rows["label"])]
        at, w = _fit(data, s)
        return pd.DataFrame({"at": at, "w": w})

    known = docs.join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(s.parts)).cast("int"))
    vectors = known.select("part", "doc_id", "label", "raw").mapInPandas(sparse, "part int, doc_id long, label int, at binary, x binary")
    vectors = vectors.withColumn("place", F.xxhash64(F.lit("order"), "doc_id"))
    fitted = vectors.groupBy("part").applyInPandas(fit, "at long, w double").groupBy("at").agg((F.sum("w") / s.parts).alias("w"))
    weights = np.zeros(s.buckets)
    for row in fitted.collect():  # at most one row per bucket
        weights[row["at"]] = row["w"]
    return weights


def quality_column(spark: SparkSession, raw: Column, weights: np.ndarray) -> Column:
    """The probability of label 1 for texts given as bytes, from a sparse dot product."""
    shared = spark.sparkContext.broadcast(weights)  # `buckets` doubles

    def run(raws: pd.Series) -> pd.Series:
        w, dots = shared.value, np.zeros(len(raws))
        for k, text in enumerate(raws):
            at, x = features(text, len(w))
            dots[k] = w[at] @ x
        return pd.Series(1 / (1 + np.exp(-np.clip(dots, -35, 35))))

    return F.pandas_udf(run, "double")(raw)


def good_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 5, held: int = 0, settings: QualitySettings = QualitySettings(),
) -> DataFrame:
    """The rows of `docs` that score at least `settings.cut`, all columns as they are; otherwise like `quality_scores`."""
    weights = _learn(docs, labels, id_col, text_col, label_col, folds, held, settings)
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.where(quality_column(docs.sparkSession, raw, weights) >= settings.cut)


def _learn(docs, labels, id_col, text_col, label_col, folds, held, settings) -> np.ndarray:
    given = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(fold("doc_id", folds) != held)
    return fit_quality(raw_texts(docs, id_col, text_col), given, settings)


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 5, held: int = 0, settings: QualitySettings = QualitySettings(),
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= `settings.cut`).

    Only text is an input of a score. Labels are learnt from rows whose crc32 fold isn't `held`; labels of unknown documents are
    ignored. Null texts count as empty and get the score of the constant. Repeated rows each get a row; null ids stay null and
    are never learnt from. An empty table gives an empty result; without labels every score is 0.5.
    """
    weights = _learn(docs, labels, id_col, text_col, label_col, folds, held, settings)
    texts = raw_texts(docs, id_col, text_col)
    scored = texts.select("doc_id", quality_column(docs.sparkSession, F.col("raw"), weights).alias("score"))
    return scored.select(
        "doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score",
        (F.col("score") >= settings.cut).cast("int").alias("predicted"),
    )
