"""Surrogates on ``pyspark.ml``: steel regressors, the validity classifier and what is read from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Families by name; parameters go to the estimator as they are.
FAMILIES: dict[str, Callable[..., Estimator]] = {
    "forest": lambda **p: RandomForestRegressor(**{"numTrees": 100, "minInstancesPerNode": 2, "featureSubsetStrategy": "0.8", "seed": 42, **p}),
    "boosted": lambda **p: GBTRegressor(**{"maxIter": 50, "seed": 42, **p}),
    "linear": lambda **p: LinearRegression(**p),
    "huber": lambda **p: LinearRegression(**{"loss": "huber", **p}),
}


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column of the training rows; a constant column gets scale 1."""
    row = train.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in params.items()})


def unscale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.col(c) * s + m for c, (m, s) in params.items()})


def fit_regressor(train: DataFrame, target: str, features: Sequence[str], family: str = "forest", **params) -> Model:
    """A fitted pipeline that adds ``prediction``. Rows with a null in a feature are left out of the fit."""
    parts = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip"), FAMILIES[family](**params).setFeaturesCol("_x").setLabelCol(target)
    return Pipeline(stages=list(parts)).fit(train)


def fit_validity(train: DataFrame, label: str, features: Sequence[str]) -> Model:
    """Balanced logistic regression of C = 1 on columns that are scaled already; label 1 is valid. Both classes must occur."""
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().where(F.col(label).isin(0, 1)).collect()}
    if len(counts) < 2:
        raise ValueError("the training rows hold one class only")
    n = sum(counts.values())
    weight = F.when(F.col(label) == 0, n / (2 * counts[0])).otherwise(n / (2 * counts[1]))
    model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", standardization=False, regParam=1 / n, maxIter=200)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip"), model]).fit(train.where(F.col(label).isin(0, 1)).withColumn("_w", weight))


def p_invalid(model: Model, df: DataFrame) -> DataFrame:
    """Adds ``p_invalid``, the probability of class 0."""
    return model.transform(df).withColumn("p_invalid", vector_to_array("probability")[0]).drop("_x", "rawPrediction", "probability", "prediction")


def coefficients(model: Model, df: DataFrame) -> DataFrame:
    """(feature, coefficient) of a fitted linear or logistic pipeline; ``df`` gives the session."""
    return df.sparkSession.createDataFrame(list(zip(model.stages[0].getInputCols(), map(float, model.stages[-1].coefficients), strict=True)), "feature string, coefficient double")


def principal_components(train: DataFrame, df: DataFrame, vector: str = "embedding", k: int = 2) -> DataFrame:
    """``df`` with ``pc1`` to ``pck`` and the shares ``explained``, fitted on the centred vectors of ``train``.

    Each component's sign makes its loading of largest size positive. Rows of a null vector are left out.
    """
    made = lambda d: d.where(F.col(vector).isNotNull()).withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    fitted = Pipeline(stages=[StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False), PCA(k=k, inputCol="_c", outputCol="_p")]).fit(made(train))
    loadings = fitted.stages[-1].pc.toArray()
    signs = [1.0 if c[abs(c).argmax()] >= 0 else -1.0 for c in loadings.T]
    out = fitted.transform(made(df)).withColumn("_p", vector_to_array("_p"))
    explained = F.array(*(F.lit(float(x)) for x in fitted.stages[-1].explainedVariance.toArray()))
    return out.withColumns({f"pc{j + 1}": F.col("_p")[j] * s for j, s in enumerate(signs)} | {"explained": explained}).drop("_x", "_c", "_p")


def cross_validate(df: DataFrame, target: str, candidates: dict[str, tuple[str, Sequence[str], dict]], fold: str = "fold") -> DataFrame:
    """(candidate, fold, n, mae, rmse) of each candidate ``(family, features, parameters)`` on each fold, fitted on the other folds.

    The predictions of all fits are one table with one grouped aggregate. Rows of a null fold take no part.
    """
    rows = df.where(F.col(fold).isNotNull() & F.col(target).isNotNull())
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    if len(folds) < 2:
        raise ValueError("cross-validation needs two folds at least")
    got = None
    for name, (family, features, parameters) in candidates.items():
        for k in folds:
            model = fit_regressor(rows.where(F.col(fold) != k), target, features, family, **parameters)
            some = model.transform(rows.where(F.col(fold) == k)).select(F.lit(name).alias("candidate"), F.col(fold).alias("fold"), (F.col("prediction") - F.col(target)).alias("e"))
            got = some if got is None else got.unionByName(some)
    if got is None:
        raise ValueError("no candidates")
    return got.groupBy("candidate", "fold").agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))


def ranked_candidates(metrics: DataFrame) -> DataFrame:
    """(candidate, mean_mae, std_mae, mae_rank) of ``cross_validate``; equal means rank by name."""
    mean = metrics.groupBy("candidate").agg(F.avg("mae").alias("mean_mae"), F.stddev_samp("mae").alias("std_mae"))
    return mean.withColumn("mae_rank", F.row_number().over(Window.orderBy("mean_mae", "candidate")))  # one row for each candidate


def ablation(df: DataFrame, target: str, groups: dict[str, Sequence[str]], family: str = "linear", fold: str = "fold", **parameters) -> DataFrame:
    """What the error of a fold rises by when a group of features is left out: (left_out, mean, median, lowest, highest, positive_share)."""
    whole = [c for g in groups.values() for c in g]
    candidates = {"": (family, whole, parameters)} | {g: (family, [c for c in whole if c not in set(some)], parameters) for g, some in groups.items()}
    m = cross_validate(df, target, candidates, fold)
    base = m.where("candidate = ''").select("fold", F.col("mae").alias("base"))
    rise = m.where("candidate <> ''").join(base, "fold").select(F.col("candidate").alias("left_out"), (F.col("mae") - F.col("base")).alias("rise"))
    return rise.groupBy("left_out").agg(F.avg("rise").alias("mean"), F.median("rise").alias("median"), F.min("rise").alias("lowest"), F.max("rise").alias("highest"), F.avg((F.col("rise") > 0).cast("double")).alias("positive_share"))
