"""Residual models behind the same interface as any forecaster: rows with predictions or sorted quantiles.

Neural models are not rebuilt here.  A weighted linear model gives points, empirical residual quantiles
give intervals, and everything downstream takes either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip

#: Quantile levels of an interval forecast.
LEVELS = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]


def residual_quantiles(df: DataFrame, by: list[str], train: Column, target: str, base: str, low: float, high: float,
                       levels: list[float] = LEVELS) -> DataFrame:
    """Adds `quantiles`: base plus the training residuals' quantiles of its group, clipped, in order.

    Groups are few, so their quantiles are one small table joined back."""
    fitted = df.where(train).groupBy(*by).agg(F.percentile(F.col(target) - F.col(base), F.array(*[F.lit(x) for x in levels])).alias("_r"))
    shifted = F.transform("_r", lambda r: clip(F.col(base) + r, low, high))
    return df.join(fitted, by, "left").withColumn("quantiles", F.array_sort(shifted)).drop("_r")


def linear_residual(df: DataFrame, features: list[str], train: Column, target: str, base: str, weight: str, low: float, high: float,
                    penalty: float = 1e-3) -> DataFrame:
    """Adds `prediction`: base plus a weighted ridge fit of the residual, clipped."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df).withColumn(
        "_y", F.col(target) - F.col(base))
    model = LinearRegression(featuresCol="_x", labelCol="_y", weightCol=weight, predictionCol="_p", regParam=penalty).fit(rows.where(train))
    return model.transform(rows).withColumn("prediction", clip(F.col(base) + F.col("_p"), low, high)).drop("_x", "_y", "_p")
