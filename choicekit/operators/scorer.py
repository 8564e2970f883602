"""Linear choice scorer, settings grid and split report.

The reference fine-tunes a network with one linear layer on a pooled vector
and a BCE loss.  On Spark that is MLlib logistic regression on the vector
column; grids are ``ParamGridBuilder`` + ``TrainValidationSplit``; scoring is
``model.transform`` followed by the SQL metrics of ``metrics.py``.
"""
from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import bce_with_logits


def features(df: DataFrame, vec: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(vec))


def fit_linear(train: DataFrame, label: str = "y", reg: float = 0.0, max_iter: int = 50):
    """C4: one linear layer + sigmoid, trained with the logistic (BCE) loss."""
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=reg,
                            maxIter=max_iter)
    return lr.fit(train)


def score(model, df: DataFrame) -> DataFrame:
    """Adds ``logit`` (raw margin of the positive class) and ``prob``."""
    out = model.transform(df)
    return out.withColumn("logit", vector_to_array("rawPrediction")[1]) \
        .withColumn("prob", vector_to_array("probability")[1]) \
        .drop("rawPrediction", "probability", "features")


def grid_search(train: DataFrame, label: str = "y", regs=(0.0, 0.01, 0.1),
                train_ratio: float = 0.8, seed: int = 7) -> DataFrame:
    """Every setting of the grid, its validation metric (area under ROC,
    higher is better) and whether it was chosen."""
    spark = train.sparkSession
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=50)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(regs)).build()
    tvs = TrainValidationSplit(estimator=lr, estimatorParamMaps=grid,
                               evaluator=BinaryClassificationEvaluator(labelCol=label),
                               trainRatio=train_ratio, seed=seed)
    model = tvs.fit(train)
    metrics = list(model.validationMetrics)
    best = max(range(len(metrics)), key=lambda i: metrics[i])
    # one row per grid point: a list whose length is the grid size
    rows = [(float(g[lr.regParam]), float(m), i == best)
            for i, (g, m) in enumerate(zip(grid, metrics))]
    return spark.createDataFrame(rows, "reg_param double, auc double, chosen boolean")


def split_report(scored: DataFrame, label: str = "y", split: str = "split") -> DataFrame:
    """Per split accuracy (threshold 0.5) and mean BCE."""
    right = (F.col("prediction") == F.col(label)).cast("double")
    return scored.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(right), 6).alias("accuracy"),
        F.round(F.avg(bce_with_logits("logit", F.col(label).cast("double"))), 6).alias("bce"))
