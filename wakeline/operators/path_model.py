"""A path classifier: half boosted trees, half logistic regression, scored on vessels that it was not fitted on."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.resampling import grouped_folds
from wakeline.scratch import Scratch


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """df with its features as a vector; missing and non-finite values count as 0."""
    known = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).otherwise(0.0)
    clean = df.withColumns({f"_{c}": known(c) for c in features})
    return VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="_vector").transform(clean).drop(*[f"_{c}" for c in features])


def fit(df: DataFrame, label: str, seed: int = 0, trees: int = 20):
    """A function that adds score to assembled rows, from rows with both labels; positives weigh as much as negatives in the regression."""
    share = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    rows = df.select("_vector", F.col(label).cast("double").alias("_y"))
    rows = rows.withColumn("_w", F.when(F.col("_y") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    scaler = StandardScaler(inputCol="_vector", outputCol="_scaled", withMean=True).fit(rows)
    boosted = GBTClassifier(featuresCol="_vector", labelCol="_y", maxIter=trees, maxDepth=2, stepSize=0.08, subsamplingRate=0.8, seed=seed).fit(rows)
    boosted.setPredictionCol("_p1").setProbabilityCol("_boosted").setRawPredictionCol("_r1")
    logistic = LogisticRegression(featuresCol="_scaled", labelCol="_y", weightCol="_w", regParam=0.01, maxIter=100, predictionCol="_p2", probabilityCol="_logistic", rawPredictionCol="_r2").fit(scaler.transform(rows))

    def score(new: DataFrame) -> DataFrame:
        out = logistic.transform(scaler.transform(boosted.transform(new)))
        half = lambda c: 0.5 * vector_to_array(c)[1]
        return out.withColumn("score", half("_boosted") + half("_logistic")).select(*new.columns, "score")

    return score


def out_of_fold_scores(df: DataFrame, features: list[str], label: str, group: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """df with fold and score: groups are whole and labels spread over the folds; each fold is scored by a model of all others.

    A fold whose other folds hold one label only gets that label's share as its score.
    """
    rows = Scratch(df.sparkSession, "folds").save(assembled(grouped_folds(df, group, label, folds, seed), features).withColumn("_known", F.col(label).isNotNull()), "rows")
    out = None
    for k in range(folds):  # a few models, each fitted on the cluster
        own, rest = rows.where(F.col("fold") == k), rows.where((F.col("fold") != k) & F.col("_known"))
        low, high, share = rest.agg(F.min(F.col(label).cast("int")), F.max(F.col(label).cast("int")), F.avg(F.col(label).cast("double"))).first()
        part = fit(rest, label, seed)(own) if low != high else own.withColumn("score", F.lit(share).cast("double"))
        out = part if out is None else out.union(part)
    return out.drop("_vector", "_known")
