"""Customer segments by clustering of recency, frequency and spend."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rfm import rfm_matrix

# Names from the best cluster to the worst, and of customers without orders.
BUYER_SEGMENTS = ("VIP", "Loyal", "Promising", "At Risk")
DORMANT = "Dormant"


def fit_segmentation(profiles: DataFrame, seed: int = 42, restarts: int = 10) -> DataFrame:
    """(customer_id, segment): clusters named by low recency, high frequency and spend.

    Of several starts the one with the smallest cost is kept. With fewer buyers than
    clusters everyone is dormant.
    """
    everyone = profiles.select("customer_id")
    buyers = profiles.where(F.col("total_orders") > 0).limit(len(BUYER_SEGMENTS)).count()
    if buyers < len(BUYER_SEGMENTS):
        return everyone.withColumn("segment", F.lit(DORMANT))
    columns = ["recency", "frequency", "monetary"]
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(
        rfm_matrix(profiles)
    )
    points = vectors.select("customer_id", "features").persist()
    try:
        models = [
            KMeans(k=len(BUYER_SEGMENTS), seed=seed + i, featuresCol="features").fit(points)
            for i in range(restarts)
        ]
    finally:
        points.unpersist()
    model = min(models, key=lambda m: m.summary.trainingCost)
    centers = np.array(model.clusterCenters())
    order = np.argsort(-(-centers[:, 0] + centers[:, 1] + centers[:, 2]), kind="stable")
    names = F.create_map(
        *[F.lit(x) for rank, cluster in enumerate(order) for x in (int(cluster), BUYER_SEGMENTS[min(rank, 3)])]
    )
    named = model.transform(vectors).select(
        "customer_id", F.element_at(names, F.col("prediction")).alias("segment")
    )
    return everyone.join(named, "customer_id", "left").withColumn(
        "segment", F.coalesce("segment", F.lit(DORMANT))
    )
