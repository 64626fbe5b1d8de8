"""A binary text classifier on Spark ML: hashed words and logistic regression; prediction rows and smoothed loss."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pipeline(text: str = "text", label: str = "label", features: int = 1 << 14) -> Pipeline:
    """Words and word pairs, hashed and weighted. The fitted model's size is bounded by ``features``."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+"),
            NGram(n=2, inputCol="_words", outputCol="_pairs"),
            SQLTransformer(statement="select *, concat(_words, _pairs) as _grams from __THIS__"),
            HashingTF(inputCol="_grams", outputCol="_counts", numFeatures=features),
            IDF(inputCol="_counts", outputCol="_features"),
            LogisticRegression(featuresCol="_features", labelCol=label, maxIter=20, regParam=0.01),
        ]
    )


def fit(df: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14) -> PipelineModel:
    return pipeline(text, label, features).fit(df.where(F.col(text).isNotNull() & F.col(label).isNotNull()))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """prediction, is_ai, confidence, both probabilities and ai_percentage; label 1 is ai."""
    made = model.transform(df).withColumn("_p", vector_to_array("probability"))
    ai = F.col("_p")[1]
    rows = made.select(*df.columns, ai.alias("ai_probability"), (1 - ai).alias("human_probability"))
    is_ai = F.col("ai_probability") > F.col("human_probability")
    return rows.select("*", F.when(is_ai, "ai").otherwise("human").alias("prediction"), is_ai.alias("is_ai"), F.greatest("ai_probability", "human_probability").alias("confidence"), F.round(F.col("ai_probability") * 100, 2).alias("ai_percentage"))


def smoothed_loss(label: Column, ai_probability: Column, smoothing: float = 0.1) -> Column:
    """Cross entropy against labels moved towards one half."""
    target = label * (1 - smoothing) + smoothing / 2
    safe = F.greatest(F.least(ai_probability, F.lit(1 - 1e-12)), F.lit(1e-12))
    return -(target * F.log(safe) + (1 - target) * F.log(1 - safe))


def band(accuracy: Column) -> Column:
    """low under 70 %, moderate under 85 %, else good."""
    return F.when(accuracy < 0.7, "low").when(accuracy < 0.85, "moderate").otherwise("good")
