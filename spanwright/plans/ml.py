"""A regression of soft labels on boundary windows, with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.functions import expr as E
from spanwright.session import Tables


def boundary_features(rows: DataFrame, k: int = 4, slots: int = 256, length: int = 500) -> DataFrame:
    """``features`` of each row: k-mers with their place in the oriented window, type and side.

    ``rows`` has ``rec_type, side, seq`` with whole sequences: they are oriented first and then cut
    to ``length`` bases from the boundary, as the reference does. Short windows have no k-mers.
    Only the windows are kept as a table, and of what features are made of nothing stays in the result.
    """
    names = [c for c in rows.columns if c != "seq"]
    df = Tables(rows.sparkSession).keep(rows.select(*names, F.left(E.model_orientation("seq", "side"), F.lit(length)).alias("oriented")))
    places = F.when(F.length("oriented") >= k, F.sequence(F.lit(1), F.length("oriented") - (k - 1))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("kmers", F.transform(places, lambda i: F.concat_ws(":", (i / 5).cast("int").cast("string"), F.substr(F.col("oriented"), i, F.lit(k)))))
    stages = [
        HashingTF(numFeatures=slots, inputCol="kmers", outputCol="kmer_counts"),
        StringIndexer(inputCols=["rec_type", "side"], outputCols=["type_no", "side_no"], handleInvalid="keep"),
        OneHotEncoder(inputCols=["type_no", "side_no"], outputCols=["type_hot", "side_hot"]),
        VectorAssembler(inputCols=["kmer_counts", "type_hot", "side_hot"], outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(df).transform(df).select(*names, "features")


def fit_predict(rows: DataFrame, rounds: int = 5) -> DataFrame:
    """Fit on the train split, watching the val split, and predict the test split, to four decimals.

    ``rows`` has ``features, label, split``.
    """
    rows = Tables(rows.sparkSession).keep(rows)  # read several times, and too large for memory
    fitting = rows.where(F.col("split").isin("train", "val")).withColumn("watch", F.col("split") == "val")
    model = GBTRegressor(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=3, seed=7, validationIndicatorCol="watch").fit(fitting.select("features", "label", "watch"))
    return model.transform(rows.where(F.col("split") == "test")).withColumn("prediction", F.round("prediction", 4))


def fold_rotation(rows: DataFrame, n: int = 5) -> DataFrame:
    """Each row in each of n runs: its fold is tested once, the next one watches, the others train."""
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    role = F.when(F.col("fold") == F.col("run"), "test").when(F.col("fold") == (F.col("run") + 1) % n, "val").otherwise("train")
    return runs.withColumn("role", role)
