"""Model weights as raw little-endian fixed-point numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

#: Fixed value: fraction bits of stored weights.
FRACTION_BITS = 16


def read_weights(spark: SparkSession, path: str, shape: tuple[int, ...], fraction_bits: int = FRACTION_BITS) -> np.ndarray:
    """One file of 32-bit whole numbers; weights are as large as a model, not as the data."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return (np.frombuffer(data, "<i4").astype(np.float64) / (1 << fraction_bits)).reshape(shape)


def encode_weights(values: np.ndarray, fraction_bits: int = FRACTION_BITS) -> bytes:
    return np.round(np.asarray(values) * (1 << fraction_bits)).astype("<i4").tobytes()
