"""Supervised pipeline pieces: features, pipeline, split, error, persistence."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_km: float = 6371.0) -> Column:
    """Great-circle distance in km between two points given in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dphi, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * radius_km) * F.asin(F.sqrt(a))


def time_features(df: DataFrame, ts: str, prefix: str = "") -> DataFrame:
    """Hour, day of week, month and year of a timestamp column."""
    return df.select("*", F.hour(ts).alias(f"{prefix}hour"), F.dayofweek(ts).alias(f"{prefix}dow"),
                     F.month(ts).alias(f"{prefix}month"), F.year(ts).alias(f"{prefix}year"))


def regression_pipeline(numeric: Sequence[str], categorical: Sequence[str], label: str):
    """Scaled numeric features + one-hot categorical features -> linear regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    stages = []
    idx = [f"{c}_idx" for c in categorical]
    ohe = [f"{c}_ohe" for c in categorical]
    stages.append(StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep"))
    stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=list(numeric), outputCol="_num"))
    stages.append(StandardScaler(inputCol="_num", outputCol="_nums", withMean=True, withStd=True))
    stages.append(VectorAssembler(inputCols=["_nums", *ohe], outputCol="features"))
    stages.append(LinearRegression(featuresCol="features", labelCol=label, predictionCol="prediction"))
    return Pipeline(stages=stages)


def train_test(df: DataFrame, key: str, test_share: float = 0.3, buckets: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Stable split by a hash of the key (same split on every run and partitioning)."""
    b = F.pmod(F.xxhash64(key), F.lit(buckets))
    cut = int(round(test_share * buckets))
    return df.filter(b >= cut), df.filter(b < cut)


def rmse(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error (and the mean error) per key."""
    err = F.col(prediction) - F.col(label)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("mean_error"),
                                 F.count(F.lit(1)).alias("n"))


def save_model(model, path: str) -> None:
    """Persist a fitted model or pipeline (Spark ML writer, overwrite)."""
    model.write().overwrite().save(path)


def load_pipeline_model(path: str):
    """Load a fitted pipeline saved with ``save_model``."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
