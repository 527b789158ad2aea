"""Projection of vectors to two dimensions."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca_2d(vectors: DataFrame) -> DataFrame:
    """(id, x, y): the first two principal components, centred and scaled to [-1, 1] by the largest value.

    Vectors are read as doubles and must have one length. The sign of an axis is fixed so that its
    greatest deviation is positive. One vector, or equal ones, fall on the origin.
    """
    rows = vectors.select("id", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    points = model.transform(rows).select("id", vector_to_array("p").alias("p")).select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    centre = points.agg(*[F.avg(c).alias(f"m{c}") for c in "xy"], *[F.min(c).alias(f"lo{c}") for c in "xy"], *[F.max(c).alias(f"hi{c}") for c in "xy"])
    joined = points.withColumn("_one", F.lit(1)).join(centre.withColumn("_one", F.lit(1)), "_one")  # one row
    out = ["id"]
    for c in "xy":
        high, low = F.col(f"hi{c}") - F.col(f"m{c}"), F.col(f"m{c}") - F.col(f"lo{c}")
        sign = F.when(high >= low, 1.0).otherwise(-1.0)
        out.append(F.coalesce(F.try_divide(sign * (F.col(c) - F.col(f"m{c}")), F.nullif(F.greatest(high, low), F.lit(0.0))), F.lit(0.0)).alias(c))
    return joined.select(*out)
