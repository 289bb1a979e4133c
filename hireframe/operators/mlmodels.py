"""M4 alternative with Spark ML: hashed term frequencies + logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fit_logreg(df: DataFrame, label_col: str, tokens_col: str, num_features: int = 1 << 16,
               max_iter: int = 30, reg: float = 0.01) -> PipelineModel:
    """Fit StringIndexer (alphabetical, A4) -> HashingTF -> LogisticRegression."""
    idx = StringIndexer(inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc",
                        handleInvalid="error")
    tf = HashingTF(inputCol=tokens_col, outputCol="_features", numFeatures=num_features)
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_pred",
                            maxIter=max_iter, regParam=reg)
    return Pipeline(stages=[idx, tf, lr]).fit(df)


def predict_logreg(model: PipelineModel, df: DataFrame, key_col: str, tokens_col: str) -> DataFrame:
    """(key, prediction) with the class index mapped back to the label."""
    labels = model.stages[0].labels
    to_label = IndexToString(inputCol="_pred", outputCol="prediction", labels=labels)
    stages = model.stages[1:]
    out = df.select(key_col, tokens_col)
    for st in stages:
        out = st.transform(out)
    return to_label.transform(out).select(key_col, "prediction")


def objective_history(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The training objective per iteration."""
    hist = model.stages[-1].summary.objectiveHistory
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(hist)], "iteration int, objective double") \
        .select("iteration", F.round("objective", 6).alias("objective"))
