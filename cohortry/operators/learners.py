"""Class-probability learners on ``pyspark.ml`` with one scoring interface."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.fixed import N_CLASSES
from cohortry.functions.vectors import bind, items, normalised, sigmoid, softmax, total


def complete(parts: dict[int, Column], width: int = N_CLASSES) -> Column:
    """Class probabilities placed by class id; uniform when they sum to nothing, then renormalised."""
    placed = F.array(*[parts.get(i, F.lit(0.0)) for i in range(width)])
    uniform = F.array(*[F.lit(1.0 / width)] * width)
    return bind(placed, lambda a: normalised(items(F.when(total(items(a, width)) <= 0, uniform).otherwise(a), width)))


def class_counts(df: DataFrame, label: str) -> dict[int, int]:
    """Rows per class; the number of classes is small."""
    return {int(r[0]): int(r[1]) for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}


def balanced_weight(df: DataFrame, label: str, weight: str | None = None) -> tuple[Column, dict[int, float]]:
    """Sample weight times n / (classes * class count)."""
    counts = class_counts(df, label)
    n, k = sum(counts.values()), len(counts)
    factor = F.lit(None).cast("double")
    factors = {c: n / (k * m) for c, m in counts.items()}
    for c, f in factors.items():
        factor = F.when(F.col(label) == c, F.lit(f)).otherwise(factor)
    return factor * (F.lit(1.0) if weight is None else F.col(weight)), factors


def _index(label: str, classes) -> Column:
    place = F.lit(None).cast("double")
    for i, c in enumerate(classes):
        place = F.when(F.col(label) == c, F.lit(float(i))).otherwise(place)
    return place


def _training(df: DataFrame, features: str, label: str, classes, weight: Column) -> DataFrame:
    return df.where(F.col(label).isNotNull()).select(
        array_to_vector(F.col(features).cast("array<double>")).alias("features"), _index(label, classes).alias("label"),
        weight.cast("double").alias("weight"))


@dataclass
class LinearModel:
    """Fitted (multinomial) logistic coefficients; scoring is a plain expression, usable on a stream as well."""

    classes: list[int]
    coefficients: list[list[float]]
    intercepts: list[float]
    width: int = N_CLASSES

    def proba(self, features: str | Column | list[Column]) -> Column:
        if len(self.classes) == 1 and not self.coefficients:
            return complete({self.classes[0]: F.lit(1.0)}, self.width)
        if not self.classes:
            return complete({}, self.width)
        x = features if isinstance(features, list) else items(features, len(self.coefficients[0]))
        margins = [total(v * F.lit(float(b)) for v, b in zip(x, beta)) + F.lit(float(a))
                   for beta, a in zip(self.coefficients, self.intercepts)]
        if len(margins) == 1:
            return bind(sigmoid(margins[0]), lambda p: complete({self.classes[0]: F.lit(1.0) - p, self.classes[1]: p}, self.width))
        return bind(softmax(margins), lambda scored: complete({c: scored[i] for i, c in enumerate(self.classes)}, self.width))

    def contract(self) -> dict:
        return {"classes": self.classes, "coef": self.coefficients, "intercept": self.intercepts}


def fit_logistic(df: DataFrame, features: str, label: str = "label", *, weight: str | None = None, balanced: bool = False,
                 c: float = 1.0, width: int = N_CLASSES, max_iter: int = 200, tol: float = 1e-9) -> LinearModel:
    """L2 logistic regression whose penalty matches a summed loss with strength 1/c."""
    counts = class_counts(df, label)
    classes = sorted(counts)
    if len(classes) < 2:
        return LinearModel(classes, [], [], width)
    w = balanced_weight(df, label, weight)[0] if balanced else (F.lit(1.0) if weight is None else F.col(weight))
    rows = _training(df, features, label, classes, w).cache()
    mass = float(rows.agg(F.sum("weight")).first()[0])
    model = LogisticRegression(weightCol="weight", standardization=False, elasticNetParam=0.0, regParam=1.0 / (c * mass),
                               maxIter=max_iter, tol=tol).fit(rows)
    rows.unpersist()
    return LinearModel(classes, [list(map(float, r)) for r in model.coefficientMatrix.toArray()],
                       list(map(float, model.interceptVector.toArray())), width)


@dataclass
class FittedClassifier:
    """An ml classifier with its class ids, optionally followed by a logistic calibrator."""

    model: object
    classes: list[int]
    features: str
    calibrator: LinearModel | None = None
    width: int = N_CLASSES

    def _raw(self, df: DataFrame, out: str) -> DataFrame:
        vector = df.withColumn("_f", array_to_vector(F.col(self.features).cast("array<double>")))
        scored = self.model.transform(vector).withColumn("_pr", vector_to_array("probability"))
        placed = complete({c: F.col("_pr")[i] for i, c in enumerate(self.classes)}, self.width)
        return scored.withColumn(out, placed).select(*df.columns, out)

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        scored = self._raw(df, out)
        return scored if self.calibrator is None else scored.withColumn(out, self.calibrator.proba(out))

    def calibrated(self, validation: DataFrame, label: str = "label") -> "FittedClassifier":
        scored = self._raw(validation, "_base")
        head = fit_logistic(scored, "_base", label, width=self.width)
        return FittedClassifier(self.model, self.classes, self.features, head if head.coefficients else None, self.width)


def fit_forest(df: DataFrame, features: str, label: str = "label", *, weight: str | None = None, trees: int = 500,
               depth: int = 10, seed: int = 42) -> FittedClassifier:
    classes = sorted(class_counts(df, label))
    w = balanced_weight(df, label, weight)[0]
    rows = _training(df, features, label, classes, w)
    model = RandomForestClassifier(weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features").fit(rows)
    model.setFeaturesCol("_f")
    return FittedClassifier(model, classes, features)


def fit_perceptron(df: DataFrame, features: str, label: str = "label", *, hidden=(256, 128, 64), inputs: int,
                   iterations: int = 100, seed: int = 42) -> FittedClassifier:
    classes = sorted(class_counts(df, label))
    rows = _training(df, features, label, classes, F.lit(1.0))
    model = MultilayerPerceptronClassifier(layers=[inputs, *hidden, len(classes)], maxIter=iterations, seed=seed).fit(rows)
    model.setFeaturesCol("_f")
    return FittedClassifier(model, classes, features)


@dataclass
class OneVsRestBoosting:
    """One boosted binary model per class; normalised positive scores."""

    models: dict[int, object] = field(default_factory=dict)
    features: str = "x"
    width: int = N_CLASSES

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        scored = df.withColumn("_f", array_to_vector(F.col(self.features).cast("array<double>")))
        for c, model in self.models.items():
            scored = model.transform(scored).withColumn(f"_c{c}", vector_to_array("probability")[1]).drop(
                "rawPrediction", "probability", "prediction")
        return scored.withColumn(out, complete({c: F.col(f"_c{c}") for c in self.models}, self.width)).select(*df.columns, out)


def fit_boosting(df: DataFrame, features: str, label: str = "label", *, weight: str | None = None, rounds: int = 500,
                 rate: float = 0.05, depth: int = 3, seed: int = 42) -> OneVsRestBoosting:
    classes = sorted(class_counts(df, label))
    base = df.where(F.col(label).isNotNull()).select(
        array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).alias("_y"),
        (F.lit(1.0) if weight is None else F.col(weight)).cast("double").alias("weight")).cache()
    models = {}
    for c in classes:
        rows = base.withColumn("label", (F.col("_y") == c).cast("double"))
        model = GBTClassifier(weightCol="weight", maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed).fit(rows)
        model.setFeaturesCol("_f")
        models[c] = model
    base.unpersist()
    return OneVsRestBoosting(models, features)


def fit_propensity(df: DataFrame, features: str, arm: str = "arm", *, arms: int = 6) -> LinearModel:
    """Arm probabilities from pretreatment coordinates; uniform when only one arm occurs, 0 for absent arms."""
    counts = class_counts(df, arm)
    if len(counts) < 2:
        return LinearModel([], [], [], arms)
    return fit_logistic(df, features, arm, width=arms)


