"""Models by name over Spark ML: training, AUC of hard labels or one against the rest, and error of regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.core import at_once, dealt, is_numeric
from veilwork.errors import InputError
from veilwork.plans.angles import lasso_path
from veilwork.plans.cache import kept

CLASSIFIERS = ("logreg", "rfclass", "tpotclass")
REGRESSORS = ("larscv", "encv", "rfreg", "tpotreg")
CATEGORIES = 30


def check(method: str) -> None:
    if method not in CLASSIFIERS + REGRESSORS:
        raise InputError(f"unknown model {method}")


def task(df: DataFrame, col: str, categories: int = CATEGORIES) -> str | None:
    """binary, multi_class, regression, or None for a text of many values."""
    n = df.agg(F.count_distinct(col)).first()[0]
    return "binary" if n == 2 else "multi_class" if n < categories else "regression" if is_numeric(df, col) else None


def _estimator(method: str, label: str, seed: int):  # noqa: ANN202
    """A forest, or several estimators of which the best is sought.

    Those with weights get equal rows as one. Spark's deviations of weighted columns aren't those of the rows that the
    weights stand for, so logistic regressions, whose penalty hangs on them, get columns divided by the rows' own.
    """
    args = {"featuresCol": "_features", "labelCol": label}
    scaled = args | {"featuresCol": "_scaled", "standardization": False, "weightCol": "_n"}
    if method == "logreg":
        return [LogisticRegression(**scaled, maxIter=50, regParam=r) for r in (1e-4, 1e-2, 1.0)]
    if method == "rfclass":
        return RandomForestClassifier(**args, numTrees=50, maxDepth=10, seed=seed, maxBins=64)
    if method == "tpotclass":
        return [RandomForestClassifier(**args, numTrees=40, maxDepth=12, seed=seed, maxBins=64), LogisticRegression(**scaled), GBTClassifier(**args, weightCol="_n", maxIter=20, seed=seed, maxBins=64)]
    if method == "rfreg":
        return RandomForestRegressor(**args, numTrees=50, maxDepth=10, seed=seed, maxBins=64)
    if method == "tpotreg":
        return [RandomForestRegressor(**args, numTrees=40, maxDepth=12, seed=seed, maxBins=64), LinearRegression(**args, regParam=1e-3), GBTRegressor(**args, weightCol="_n", maxIter=20, seed=seed, maxBins=64)]
    return [LinearRegression(**args, elasticNetParam=0.5, regParam=r) for r in (1e-4, 1e-2, 0.1)]


def _best(kinds: Sequence, evaluator: Evaluator, data: DataFrame, folds: int | None, seed: int):  # noqa: ANN202
    """Of several estimators the best on each fold in turn, or on a held-out fifth (``folds`` none), fitted on all rows.

    They are tried side by side. Equal rows of a part are one row that weighs their number, which comes to the same sums;
    forests, which draw for every row how often a tree gets it, are fitted to single rows.
    """
    part = F.floor(F.rand(seed) * folds) if folds else F.floor(F.rand(seed) + 0.2)
    drawn = data.withColumn("_part", part)
    counted = dealt(drawn.groupBy(*drawn.columns).agg(F.count(F.lit(1)).cast("double").alias("_n")), "counted")
    rows = lambda kind: counted if kind.hasParam("weightCol") and kind.isSet("weightCol") else drawn

    def score(tried: tuple) -> float:
        kind, held = tried
        model = kind.fit(rows(kind).filter(F.col("_part") != held))
        return evaluator.evaluate(model.transform(counted.filter(F.col("_part") == held)))

    parts = range(folds) if folds else [1]
    scores = iter(at_once(score, [(k, p) for k in kinds for p in parts]))
    means = [sum(next(scores) for _ in parts) / len(parts) for _ in kinds]
    best = kinds[means.index((max if evaluator.isLargerBetter() else min)(means))]
    return best.fit(rows(best))


def train(
    df: DataFrame, features: Sequence[str], label: str, method: str = "logreg", seed: int = 1234, folds: int = 3,
    cache: str | None = None, retrain: bool = False,
) -> PipelineModel:
    """A pipeline from columns to predictions; the label is indexed by its sorted values for classifiers.

    With a folder ``cache`` the model is saved there, and loaded when the same rows, columns and options come again.
    """
    check(method)
    if cache is not None:
        make = lambda: train(df, features, label, method, seed, folds)
        return kept(cache, method, df.select(*features, label), make, retrain=retrain, facts=(label, seed, folds))
    target = "_y"
    index = StringIndexer(inputCol="_label_text", outputCol=target, stringOrderType="alphabetAsc", handleInvalid="keep")
    rows = df.withColumn("_label_text", F.lpad(F.col(label).cast("double").cast("decimal(38,6)").cast("string"), 40, "0"))
    join = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    if method in REGRESSORS:
        if method == "larscv":  # the path's prediction is one expression over the columns
            found = lasso_path(df, features, label, folds, seed)
            return PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, {found.sql()} AS prediction FROM __THIS__")])
        data = dealt(join.transform(rows.withColumn(target, F.col(label).cast("double"))).select("_features", target), "training")
        made = _estimator(method, target, seed)
        errors = RegressionEvaluator(labelCol=target, weightCol="_n")
        return PipelineModel(stages=[join, _best(made, errors, data, folds if method == "encv" else None, seed) if isinstance(made, list) else made.fit(data)])
    made = _estimator(method, target, seed)
    scale = [StandardScaler(inputCol="_features", outputCol="_scaled")] if isinstance(made, list) else []
    prepared = Pipeline(stages=[index, join, *scale]).fit(rows)
    data = dealt(prepared.transform(rows).select("_features", *["_scaled"] * len(scale), target), "training")
    if isinstance(made, list):
        if method == "tpotclass" and data.select(target).distinct().count() > 2:
            made = made[:2]
        f1 = MulticlassClassificationEvaluator(labelCol=target, metricName="f1", weightCol="_n")
        best = _best(made, f1, data, folds if method == "logreg" else None, seed)
    else:
        best = made.fit(data)
    return PipelineModel(stages=[*prepared.stages, best])


def auc(model: PipelineModel, df: DataFrame, label: str) -> float:
    """Two classes: mean of the two rates of hard labels. More: mean over classes of one against the rest. Numbers: raw predictions."""
    rows = df.withColumn("_label_text", F.lpad(F.col(label).cast("double").cast("decimal(38,6)").cast("string"), 40, "0"))
    out = model.transform(rows)
    if "probability" not in out.columns:
        raw = out.select(array_to_vector(F.array(-F.col("prediction"), F.col("prediction"))).alias("rawPrediction"), F.col(label).cast("double").alias("label"))
        return BinaryClassificationEvaluator().evaluate(raw)
    rates = out.groupBy("_y").agg(F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("r")).collect()
    if len(rates) <= 2:
        return sum(r.r for r in rates) / len(rates) if len(rates) == 2 else 0.5
    scores = []
    for r in rates:
        p = vector_to_array("probability")[int(r._y)]
        one = out.select(array_to_vector(F.array(1 - p, p)).alias("rawPrediction"), (F.col("_y") == r._y).cast("double").alias("label"))
        scores.append(BinaryClassificationEvaluator().evaluate(one))
    return sum(scores) / len(scores)
