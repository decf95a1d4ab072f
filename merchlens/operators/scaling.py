"""Standard scaling with the population standard deviation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class PopulationScaler:
    """(x - mean) / population std of scalar columns; constant columns become 0."""

    columns: list[str]
    means: list[float]
    stds: list[float]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> PopulationScaler:
        aggs = [a for c in columns for a in (F.avg(c), F.stddev_pop(c))]
        row = df.agg(*aggs).first()
        means = [float(row[2 * i] or 0.0) for i in range(len(columns))]
        stds = [float(row[2 * i + 1] or 0.0) or 1.0 for i in range(len(columns))]
        return cls(list(columns), means, stds)

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        return df.withColumns(
            {
                prefix + c: (F.col(c) - F.lit(m)) / F.lit(s)
                for c, m, s in zip(self.columns, self.means, self.stds)
            }
        )


def scale_vectors(df: DataFrame, vector: str, out: str):
    """Population scaling of a vector column; returns the frame and the two-stage models."""
    n = df.count()
    model = StandardScaler(withMean=True, withStd=True, inputCol=vector, outputCol="_sample_scaled").fit(df)
    # the sample deviation is larger than the population one by sqrt(n / (n - 1))
    widen = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    product = ElementwiseProduct(
        scalingVec=Vectors.dense([widen] * len(model.mean)), inputCol="_sample_scaled", outputCol=out
    )
    return product.transform(model.transform(df)).drop("_sample_scaled"), [model, product]
