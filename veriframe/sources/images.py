"""S-14, U-06: rasters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width, height, channels, data): decoded rows of blue, green, red bytes."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def grey(images: DataFrame) -> DataFrame:
    """S-14: images with ``grey``, one byte a pixel: (299 R + 587 G + 114 B) / 1000."""

    @F.pandas_udf("binary")
    def luma(data: pd.Series, channels: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for d, c in zip(data, channels):
            x = np.frombuffer(d, np.uint8).reshape(-1, c).astype(np.int64)
            out.append((x[:, 0] if c == 1 else (299 * x[:, 2] + 587 * x[:, 1] + 114 * x[:, 0]) // 1000).astype(np.uint8).tobytes())
        return pd.Series(out)

    return images.withColumn("grey", luma("data", "channels"))


def as_base64(files: DataFrame, content: str = "content") -> DataFrame:
    """S-14: file bytes as text."""
    return files.withColumn("base64", F.base64(content))
