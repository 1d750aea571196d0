"""Linear regression over CUR embeddings of falling dimension."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.config import SeriesConfig
from corvane.functions.vectors import as_vector
from corvane.operators.linalg import cur_embedding, svd_basis, top_rows


def fit_line(train: DataFrame, c: SeriesConfig = SeriesConfig()):
    """L-BFGS with an L2 penalty, intercept and standardisation; columns features (vector) and label."""
    return LinearRegression(featuresCol="features", labelCol="label", maxIter=c.max_iter, regParam=c.reg_param, solver="l-bfgs").fit(train)


def dimension_sweep(train: DataFrame, test: DataFrame, key: str, c: SeriesConfig = SeriesConfig()) -> DataFrame:
    """One row a dimension, from all lags down to the smallest: errors, selected columns and rows, iterations.

    The basis comes from the training rows once; both tables are cached for the models that follow.
    """
    train, test = train.persist(), test.persist()
    basis = svd_basis(train)
    evaluate = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="rmse").evaluate
    rows = []
    largest = [r[key] for r in top_rows(train, key, c.lags).collect()]
    for k in range(c.lags, c.min_dimension - 1, -1):
        a, b = (cur_embedding(x, basis, k).select("label", as_vector(F.col("features")).alias("features")) for x in (train, test))
        model = fit_line(a, c)
        history = model.summary.objectiveHistory
        rows.append((k, float(evaluate(model.transform(a))), float(evaluate(model.transform(b))), basis.columns(k), [str(x) for x in largest[:k]], len(history), [float(x) for x in history]))
    train.unpersist()
    test.unpersist()
    schema = "dimension int, train_rmse double, test_rmse double, columns array<int>, rows array<string>, objective_iterations int, objective_history array<double>"
    out = train.sparkSession.createDataFrame(rows, schema)
    return out.withColumns({"selected_columns": F.to_json("columns"), "selected_rows": F.to_json("rows")}).drop("columns", "rows")


def best_row(results: DataFrame, score: str, tie: str) -> DataFrame:
    """The row of the lowest score; among equals the lowest `tie`."""
    return results.orderBy(score, tie).limit(1)
