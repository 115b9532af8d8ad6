"""K-means zones through Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["lat", "lon"]


def fit(
    stops: DataFrame, k: int = 10, features: list[str] | None = None, seed: int = 42, rounds: int = 20, restarts: int = 1
) -> PipelineModel:
    """Euclidean k-means over standardised features; of several restarts the one of least cost."""
    prepare = Pipeline(
        stages=[
            VectorAssembler(inputCols=features or FEATURES, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        ]
    ).fit(stops)
    scaled = prepare.transform(stops).select("_scaled").persist()
    tries = [
        KMeans(featuresCol="_scaled", predictionCol="_cluster", k=k, seed=seed + i, maxIter=rounds).fit(scaled)
        for i in range(max(1, restarts))
    ]
    scaled.unpersist()
    return PipelineModel([*prepare.stages, min(tries, key=lambda m: m.summary.trainingCost)])


def assign(model: PipelineModel, stops: DataFrame) -> DataFrame:
    """Zone of every row, numbered from 1 in the order of the centers."""
    centers = [tuple(map(float, c)) for c in model.stages[-1].clusterCenters()]
    order = sorted(range(len(centers)), key=centers.__getitem__)
    zones = F.array(*[F.lit(order.index(i) + 1).cast("long") for i in range(len(centers))])
    scored = model.transform(stops).withColumn("zone_id", F.get(zones, F.col("_cluster")))
    return scored.drop("_raw", "_scaled", "_cluster")


def balance(zoned: DataFrame) -> DataFrame:
    return zoned.groupBy("zone_id").agg(
        F.count("*").alias("stop_count"), F.round(F.avg("lat"), 4).alias("avg_lat"), F.round(F.avg("lon"), 4).alias("avg_lon")
    )


def evaluate(model: PipelineModel, stops: DataFrame) -> DataFrame:
    """Silhouette and mean squared distance to the centers."""
    scored = model.transform(stops)
    quality = ClusteringEvaluator(featuresCol="_scaled", predictionCol="_cluster").evaluate(scored)
    # From the assignment, so that a model loaded from disk will do.
    centers = F.array(*[F.array(*map(F.lit, map(float, c))) for c in model.stages[-1].clusterCenters()])
    center = F.get(centers, F.col("_cluster"))
    apart = F.aggregate(
        F.zip_with(vector_to_array("_scaled"), center, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, d: total + d
    )
    return scored.agg(
        F.lit(float(quality)).alias("silhouette"),
        F.avg(apart).alias("mean_squared_distance"),
        F.lit(int(model.stages[-1].getK())).alias("clusters"),
    )
