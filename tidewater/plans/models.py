"""Regression models on one feature table.

``linear_models`` fits any number of ridge and lasso models and scores them on
held-out rows from sums of products: one scan adds up the products of all
pairs of columns, for training and held-out rows apart, and everything after
that is algebra on a matrix of a few columns.  ``compare_models`` is the
Spark ML comparison with a random forest, whose training and scoring are
distributed jobs over the whole table (no sampling)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.operators.order_stats import cut_lineage

FEATURES = ("n_lines", "quantity", "avg_discount", "avg_tax", "gross")


def order_features(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per order: line features (summed per order map-side, then
    joined on the order key) and the order total as the label."""
    per = lineitem.groupBy("l_orderkey").agg(
        F.count("*").cast("double").alias("n_lines"), F.sum("l_quantity").alias("quantity"),
        F.avg("l_discount").alias("avg_discount"), F.avg("l_tax").alias("avg_tax"),
        F.sum("l_extendedprice").alias("gross"))
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("label"))
    return per.join(o, "l_orderkey")


def _models(seed: int):
    return {
        "ridge": LinearRegression(featuresCol="features", labelCol="label", regParam=0.1, elasticNetParam=0.0),
        "lasso": LinearRegression(featuresCol="features", labelCol="label", regParam=0.1, elasticNetParam=1.0),
        "random_forest": RandomForestRegressor(featuresCol="raw", labelCol="label", numTrees=20, maxDepth=6,
                                               seed=seed),
    }


def compare_models(features: DataFrame, cols: Sequence[str] = FEATURES, seed: int = 42,
                   key: str = "l_orderkey", folds: int = 5) -> DataFrame:
    """Fit each model and report RMSE and R² on held-out rows (one row per
    model).  A row is held out if its key's hash is 0 modulo ``folds``.  The
    features are assembled and written once; the models read that table."""
    assemble = VectorAssembler(inputCols=list(cols), outputCol="raw")
    table = cut_lineage(assemble.transform(features).select(key, "label", "raw"))
    held = F.pmod(F.xxhash64(key), F.lit(folds)) == 0
    train, test = table.where(~held), table.where(held)
    scale = StandardScaler(inputCol="raw", outputCol="features").fit(train)
    train, test = scale.transform(train), scale.transform(test)
    rmse = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="rmse")
    r2 = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="r2")
    rows = []
    for name, est in _models(seed).items():
        pred = est.fit(train).transform(test)
        rows.append((name, float(rmse.evaluate(pred)), float(r2.evaluate(pred))))
    spark = features.sparkSession
    return spark.createDataFrame(rows, "model string, rmse double, r2 double")


def sums_of_products(df: DataFrame, cols: Sequence[str], held: Column) -> dict[bool, np.ndarray]:
    """``Z'Z`` with ``Z = (1, cols...)`` over the complete rows, for training
    (False) and held-out (True) rows: one aggregate, summed before its shuffle.
    Rows without a fold or with a missing value are left out."""
    z = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in cols]]
    n = len(z)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    complete = df.where(F.array_size(F.array_compact(F.array(*z))) == n)
    rows = complete.groupBy(held.alias("__held")).agg(*[F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    out = {False: np.zeros((n, n)), True: np.zeros((n, n))}
    for r in rows:
        if r["__held"] is not None:
            for i, j in pairs:
                out[r["__held"]][i, j] = out[r["__held"]][j, i] = r[f"s{i}_{j}"]
    return out


def ridge(corr: np.ndarray, with_y: np.ndarray, penalty: float) -> np.ndarray:
    """Minimises ``|y - Zb|^2 / 2n + penalty |b|^2 / 2`` from ``corr = Z'Z/n``
    and ``with_y = Z'y/n`` by a Cholesky factor."""
    low = np.linalg.cholesky(corr + penalty * np.eye(len(corr)))
    return np.linalg.solve(low.T, np.linalg.solve(low, with_y))


def lasso(corr: np.ndarray, with_y: np.ndarray, penalty: float, tolerance: float = 1e-13, sweeps: int = 100_000) -> np.ndarray:
    """Minimises ``|y - Zb|^2 / 2n + penalty |b|_1`` by coordinate descent on
    the same two matrices."""
    b = np.zeros(len(corr))
    for _ in range(sweeps):
        before = b.copy()
        for j in range(len(b)):
            rest = with_y[j] - corr[j] @ b + corr[j, j] * b[j]
            b[j] = np.sign(rest) * max(abs(rest) - penalty, 0) / corr[j, j]
        if np.abs(b - before).max() <= tolerance:
            break
    return b


@dataclass(frozen=True)
class LinearSpec:
    ridge: tuple[float, ...] = (0.01, 0.1, 1.0)
    lasso: tuple[float, ...] = (0.001, 0.03, 0.3)
    folds: int = 5


def linear_models(df: DataFrame, cols: Sequence[str] = FEATURES, label: str = "label", key: str = "l_orderkey",
                  spec: LinearSpec = LinearSpec()) -> DataFrame:
    """``(model, penalty, term, coefficient, rmse, r2)``: one row per model and
    term, scored on the rows whose key is 0 modulo ``folds``.

    Features and label are standardised with the training rows' means and
    population deviations, the penalties act on that scale, and coefficients are
    given on the columns' own scale.  A constant feature has coefficient 0.
    Without training rows coefficients are NULL, without held-out rows scores are."""
    cols = list(cols)
    held = F.pmod(F.col(f"`{key}`"), F.lit(spec.folds)) == 0
    sums = sums_of_products(df, [*cols, label], held)
    p = len(cols)
    train, test = sums[False], sums[True]
    out = []
    n = train[0, 0]
    mean = train[0] / n if n else train[0]
    cov = train / n - np.outer(mean, mean) if n else train
    # a variance that is rounding error of its sums is none
    var = np.where(np.diag(cov) > 1e-12 * np.maximum(mean * mean, 1e-300), np.diag(cov), 0.0)
    dev = np.sqrt(var)
    use = [j for j in range(1, p + 1) if dev[j] > 0 and dev[p + 1] > 0]
    scale = np.outer(dev[use], dev[use])
    corr, with_y = cov[np.ix_(use, use)] / scale, cov[use, p + 1] / (dev[use] * dev[p + 1])
    for name, fit, penalties in (("ridge", ridge, spec.ridge), ("lasso", lasso, spec.lasso)):
        for penalty in penalties:
            beta = np.zeros(p + 1)
            if use:
                beta[use] = fit(corr, with_y, penalty) * dev[p + 1] / dev[use]
            beta[0] = mean[p + 1] - beta[1:] @ mean[1:p + 1]
            # squared error of held-out rows: (y - z beta)'(y - z beta) from the same sums
            w = np.append(-beta, 1.0)
            m = test[0, 0]
            error = max(w @ test @ w, 0.0)
            total = test[p + 1, p + 1] - test[0, p + 1] ** 2 / m if m else 0.0
            rmse, r2 = (float(np.sqrt(error / m)) if m else None, float(1 - error / total) if total > 0 else None)
            for term, b in zip(["intercept", *cols], beta):
                out.append((name, float(penalty), term, float(b) if n else None, rmse if n else None, r2 if n else None))
    return df.sparkSession.createDataFrame(out, "model string, penalty double, term string, coefficient double, rmse double, r2 double")
