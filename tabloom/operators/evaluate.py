"""Reports on a synthetic table: constraint violations, marginals, and classifiers trained on it and tested on the true one."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators import sampling, transform
from tabloom.operators.marginals import average, lattice_report
from tabloom.operators.profile import numeric_columns
from tabloom.operators.violations import violation_report
from tabloom.plans.constraint import DenialConstraint
from tabloom.sources.shared import checkpoint


@dataclass(frozen=True)
class Target:
    """An attribute to predict: positive labels, or a half-open range (of the number after a prefix)."""

    attr: str
    labels: tuple[str, ...] | None = None
    lo: float | None = None
    hi: float | None = None
    prefix: str = ""

    def column(self) -> F.Column:
        x = F.col(f"`{self.attr}`")
        if self.prefix:
            x = F.when(x.startswith(self.prefix), F.substring(x, len(self.prefix) + 1, 18).try_cast("double")).otherwise(F.lit(-math.inf))
        return transform.positive(F.lower(x.cast("string")), self.labels) if self.labels is not None else transform.positive(x.cast("double"), None, self.lo, self.hi)


#: Trees all of whose features may be split on stand for bagging; deeper trees and smaller steps for the second kind of gradient boosting.
MODELS = ("logistic", "adaptive", "boosted", "boosted_deep", "forest", "bayes", "tree", "bagging", "perceptron")


def _classifier(name: str, width: int, seed: int):
    from pyspark.ml import classification as c

    kinds = {
        "logistic": lambda: c.LogisticRegression(maxIter=50, regParam=0.01),
        "forest": lambda: c.RandomForestClassifier(numTrees=20, seed=seed),
        "bagging": lambda: c.RandomForestClassifier(numTrees=10, featureSubsetStrategy="all", seed=seed),
        "boosted": lambda: c.GBTClassifier(maxIter=20, seed=seed),
        "boosted_deep": lambda: c.GBTClassifier(maxIter=20, maxDepth=6, stepSize=0.3, subsamplingRate=0.8, seed=seed),
        "bayes": lambda: c.NaiveBayes(modelType="bernoulli", featuresCol="binary"),
        "tree": lambda: c.DecisionTreeClassifier(seed=seed),
        "perceptron": lambda: c.MultilayerPerceptronClassifier(layers=[width, 16, 2], maxIter=50, seed=seed),
    }
    return kinds[name]()


def adaptive(train: DataFrame, test: DataFrame, rounds: int = 20, seed: int = 0) -> DataFrame:
    """(label, prediction, p): boosting of one-split trees by reweighting what they got wrong (discrete AdaBoost)."""
    from pyspark.ml.classification import DecisionTreeClassifier

    train = train.withColumn("w_", F.lit(1.0))
    test = test.withColumn("vote_", F.lit(0.0))
    used = 0.0
    for step in range(rounds):
        stump = DecisionTreeClassifier(maxDepth=1, weightCol="w_", seed=seed + step).fit(train)
        told = stump.transform(train).select("label", "features", "w_", (F.col("prediction") != F.col("label")).alias("wrong_"))
        total, wrong = told.agg(F.sum("w_"), F.sum(F.when(F.col("wrong_"), F.col("w_")).otherwise(0.0))).first()
        error = min(max(wrong / total, 1e-9), 1 - 1e-9)
        if error >= 0.5:
            break
        alpha = 0.5 * math.log((1 - error) / error)
        used += alpha
        train = checkpoint(told.select("label", "features", (F.col("w_") * F.exp(F.when(F.col("wrong_"), alpha).otherwise(-alpha)) / F.lit(total)).alias("w_")))
        test = checkpoint(stump.transform(test).select("label", "features", (F.col("vote_") + F.lit(alpha) * (2 * F.col("prediction") - 1)).alias("vote_")))
        if error <= 1e-9:
            break
    p = (F.col("vote_") / F.lit(used or 1.0) + 1) / 2
    return test.select("label", (F.col("vote_") > 0).cast("double").alias("prediction"), p.alias("p"))


def features(train: DataFrame, test: DataFrame, target: Target) -> tuple[DataFrame, DataFrame, int]:
    """(label, features) of both tables: numbers scaled jointly, all values of text one-hot jointly (sparse; null has none)."""
    from pyspark.ml.feature import Binarizer, OneHotEncoder, StringIndexer, VectorAssembler

    both = train.withColumn("of_", F.lit(0)).unionByName(test.withColumn("of_", F.lit(1))).withColumn("label", target.column().cast("double"))
    columns = [c for c in train.columns if c not in (target.attr, "tid")]
    numbers = [c for c in numeric_columns(train) if c in columns]
    limits = transform.bounds(both, numbers) if numbers else {}
    inputs, i = {}, 0
    for c, (lo, hi) in limits.items():
        inputs[f"x{i}"] = F.coalesce(transform.scaled(F.col(f"`{c}`").cast("double"), lo, hi), F.lit(0.0))
        i += 1
    texts = {f"t{k}": F.lower(F.col(f"`{c}`").cast("string")) for k, c in enumerate(c for c in columns if c not in numbers)}
    ready = both.select("of_", "label", *[v.alias(k) for k, v in {**inputs, **texts}.items()])
    if texts:
        index, hot = [f"i_{k}" for k in texts], [f"h_{k}" for k in texts]
        indexer = StringIndexer(inputCols=list(texts), outputCols=index, handleInvalid="keep").fit(ready)  # null comes last,
        indexed = indexer.transform(ready)
        ready = OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True).fit(indexed).transform(indexed)  # and is dropped
        i += sum(map(len, indexer.labelsArray))
        inputs |= dict.fromkeys(hot)
    ready = VectorAssembler(inputCols=list(inputs), outputCol="features").transform(ready.filter("label is not null"))
    ready = Binarizer(inputCol="features", outputCol="binary", threshold=0.5).transform(ready).select("of_", "label", "features", "binary")
    return ready.filter("of_ = 0").drop("of_"), ready.filter("of_ = 1").drop("of_"), i


def metrics(scored: DataFrame) -> dict[str, float]:
    """Accuracy, precision, recall, F1, and the areas under both curves, of (label, prediction, p)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    r = scored.agg(*[F.count_if((F.col("label") == a) & (F.col("prediction") == b)) for a, b in ((1, 1), (0, 1), (1, 0), (0, 0))]).first()
    tp, fp, fn, tn = r
    share = lambda a, b: a / b if b else 0.0
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    out = {"accuracy": share(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall, "f1": share(2 * precision * recall, precision + recall)}
    for name, area in (("auroc", "areaUnderROC"), ("auprc", "areaUnderPR")):
        out[name] = float(BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", metricName=area).evaluate(scored)) if (tp + fn) and (fp + tn) else 0.0
    return out


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(tp, fp, fn, tn, accuracy, precision, recall, f1) of two 0/1 columns."""
    l, p = F.col(label), F.col(prediction)
    counts = df.agg(*[F.count_if((l == a) & (p == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    c = F.col
    out = counts.withColumns({"accuracy": share(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn")), "precision": share(c("tp"), c("tp") + c("fp")), "recall": share(c("tp"), c("tp") + c("fn"))})
    return out.withColumn("f1", F.coalesce(2 * c("precision") * c("recall") / F.nullif(c("precision") + c("recall"), F.lit(0.0)), F.lit(0.0)))


def classifier_report(true: DataFrame, synthetic: DataFrame, targets: Sequence[Target], models: Sequence[str] = MODELS, rows: int = 5000, seed: int = 0, tid: str = "tid") -> DataFrame:
    """(attr, model, metrics...): trained on 90 % of at most `rows` synthetic rows, tested on 10 % of as many true rows.

    A target with one class in training is predicted as that class. Given the same table twice it is split: the tenth is never trained on."""
    train, _ = sampling.keyed_split(sampling.subsample(synthetic.na.drop(), rows, seed, tid), 0.9, seed, tid)
    _, test = sampling.keyed_split(sampling.subsample(true.na.drop(), rows, seed, tid), 0.9, seed, tid)
    out = []
    for target in targets:
        a, b, width = features(train, test, target)
        a, b = checkpoint(a), checkpoint(b)
        classes = [r[0] for r in a.select("label").distinct().collect()]
        for name in models:
            if len(classes) < 2:
                constant = float(classes[0]) if classes else 0.0
                scored = b.select("label", F.lit(constant).alias("prediction"), F.lit(constant).alias("p"))
            elif name == "adaptive":
                scored = adaptive(a, b, seed=seed)
            else:
                made = _classifier(name, width, seed).fit(a).transform(b)
                from pyspark.ml.functions import vector_to_array

                p = vector_to_array("probability")[1] if "probability" in made.columns else F.col("prediction")
                scored = made.select("label", "prediction", p.alias("p"))
            out.append((target.attr, name, *metrics(scored).values()))
    return true.sparkSession.createDataFrame(out, "attr string, model string, accuracy double, precision double, recall double, f1 double, auroc double, auprc double")


def mean_over_models(report: DataFrame) -> DataFrame:
    return report.groupBy("attr").agg(*[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auroc", "auprc")])


def evaluate(true: DataFrame, synthetic: DataFrame, dcs: Sequence[DenialConstraint], columns: Sequence[str], targets: Sequence[Target] = ()) -> dict[str, DataFrame]:
    """All reports: violations, one- and two-way marginals with their averages, classifiers."""
    out = {"violations": violation_report(synthetic, dcs)}
    told = checkpoint(lattice_report(true, synthetic, columns, min(2, len(columns))))
    for k in (1, 2):
        out[f"marginal_{k}"] = told.filter(F.col("size") == k).select("attrs", "tvd")
        out[f"marginal_{k}_average"] = average(out[f"marginal_{k}"])
    if targets:
        out["classifiers"] = classifier_report(true, synthetic, targets)
    return out
