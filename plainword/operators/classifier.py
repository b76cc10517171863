"""Linear classifier of (gov, dep, off, score) features: does the word fit its context?"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Solvers by name. Those without a twin in Spark use the nearest: squared hinge loss and multi-class machines become LinearSVC.
SOLVERS = {
    "L2R_LR": ("lr", 0.0), "L1R_LR": ("lr", 1.0), "L2R_L2LOSS_SVC_DUAL": ("svc", 0.0), "L2R_L2LOSS_SVC": ("svc", 0.0), "L2R_L1LOSS_SVC_DUAL": ("svc", 0.0),
    "MCSVM_CS": ("svc", 0.0), "L1R_L2LOSS_SVC": ("svc", 0.0),
}


def _named(features: DataFrame, use_score: bool) -> DataFrame:
    cols = {"__g": F.concat(F.lit("g="), "gov"), "__d": F.concat(F.lit("d="), "dep"), "__o": F.concat(F.lit("o="), F.col("off").cast("string")), "__s": F.col("score") if use_score else F.lit(0.0), "__b": F.lit(1.0)}
    return features.withColumns(cols)


def train(features: DataFrame, solver: str = "L2R_LR", c: float = 1.0, eps: float = 0.01, use_score: bool = True, buckets: int = 1 << 18) -> PipelineModel:
    """features: label (boolean), gov, dep, off, score. The bias is a constant feature."""
    kind, mix = SOLVERS[solver]
    n = max(features.count(), 1)
    hasher = FeatureHasher(inputCols=["__g", "__d", "__o", "__s", "__b"], outputCol="__x", numFeatures=buckets)
    args = {"featuresCol": "__x", "labelCol": "__y", "regParam": 1.0 / (c * n), "tol": eps, "fitIntercept": False, "standardization": False, "predictionCol": "__p", "rawPredictionCol": "__r"}
    model = LogisticRegression(elasticNetParam=mix, probabilityCol="__q", **args) if kind == "lr" else LinearSVC(**args)
    return Pipeline(stages=[hasher, model]).fit(_named(features, use_score).withColumn("__y", F.col("label").cast("double")))


def predict(model: PipelineModel, features: DataFrame, use_score: bool = True) -> DataFrame:
    """features with ``pred``: 'pos' or 'neg'. ``use_score`` false leaves the dependency score out, as a model trained with it may be served."""
    out = model.transform(_named(features, use_score))
    return out.withColumn("pred", F.when(F.col("__p") == 1.0, "pos").otherwise("neg")).select(*features.columns, "pred")
