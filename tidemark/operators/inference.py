"""Batch inference: layers on numpy arrays, models applied to DataFrames in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a model takes at a time: its layers hold a multiple of their input.
BLOCK = 64
#: Values of patches that a convolution holds at a time, one row's at least.
PATCHES = 1 << 22


def exact_product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w``; of whole numbers by floating point where every sum surely is below 2^53, as that is exact and many times faster.

    Sums beyond 64 bits are an error. Weights may be of a small type.
    """
    if not (np.issubdtype(x.dtype, np.integer) and np.issubdtype(w.dtype, np.integer)):
        return x @ w
    wide = w.astype(np.float64)
    bound = max(abs(float(x.max(initial=0))), abs(float(x.min(initial=0)))) * float(np.abs(wide).sum(axis=0).max(initial=0))
    if bound < 2.0**53:
        return (x.astype(np.float64) @ wide).astype(np.int64)
    if bound >= 2.0**62 and np.abs(x.astype(np.float64) @ wide).max(initial=0) >= 2.0**62:
        raise OverflowError("a layer's sums don't fit 64 bits")
    return x @ w.astype(np.int64)


@dataclass
class Conv2D:
    """Input (batch, height, width, channels); ``filters`` is (height, width, channels, outputs)."""

    filters: np.ndarray
    bias: np.ndarray | None = None
    stride: int = 1
    pad: int = 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h, w = self.filters.shape[:2]
        x = np.pad(x, ((0, 0), (self.pad,) * 2, (self.pad,) * 2, (0, 0)))
        patches = np.lib.stride_tricks.sliding_window_view(x, (h, w), axis=(1, 2))[:, :: self.stride, :: self.stride].transpose(0, 1, 2, 4, 5, 3)
        size, outputs = int(np.prod(patches.shape[3:])), self.filters.shape[3]
        flat, rows = self.filters.reshape(size, outputs), max(1, PATCHES // max(1, int(np.prod(patches.shape[1:]))))
        parts = [exact_product(p.reshape(-1, size), flat) for p in (patches[lo : lo + rows] for lo in range(0, max(1, len(x)), rows))]
        out = np.concatenate(parts).reshape(*patches.shape[:3], outputs)
        return out if self.bias is None else out + self.bias


@dataclass
class AvgPool:
    """Divides by the whole window, padding included; ``total`` leaves out the division."""

    size: int
    stride: int
    pad: int = 0
    total: bool = False

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (self.pad,) * 2, (self.pad,) * 2, (0, 0)))
        sums = np.lib.stride_tricks.sliding_window_view(x, (self.size, self.size), axis=(1, 2))[:, :: self.stride, :: self.stride].sum(axis=(4, 5))
        if self.total:
            return sums
        area = self.size**2
        return sums // area if np.issubdtype(sums.dtype, np.integer) else sums / area


@dataclass
class ReLU:
    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x, 0)


@dataclass
class Rescale:
    """Drops ``bits`` fraction bits of whole numbers, rounding down: products of fixed-point numbers have those of both factors."""

    bits: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x >> self.bits


@dataclass
class FullyConnected:
    """Flattens each instance; ``weights`` is (inputs, outputs)."""

    weights: np.ndarray
    bias: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = exact_product(x.reshape(len(x), -1), self.weights)
        return out if self.bias is None else out + self.bias


@dataclass
class Model:
    """Layers one after another; any callable on a batch may be a layer."""

    layers: list[Callable[[np.ndarray], np.ndarray]] = field(default_factory=list)

    def add(self, layer: Callable[[np.ndarray], np.ndarray]) -> Model:
        return Model([*self.layers, layer])

    def forward(self, x: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            x = layer(x)
        return x


def apply_model(df: DataFrame, keys: Sequence[str], column: str, model: Model, shape: tuple[int, ...], out: str, kind: str = "double") -> DataFrame:
    """``keys`` and the flat output array of the model for each row's flat input array; weights are broadcast once.

    The model sees BLOCK rows at a time, whatever the size of a batch.
    """
    held, names = df.sparkSession.sparkContext.broadcast(model), list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), BLOCK):
                pdf = whole.iloc[lo : lo + BLOCK]
                x = np.stack(pdf[column].to_numpy()).reshape(len(pdf), *shape)
                yield pdf[names].assign(**{out: list(held.value.forward(x).reshape(len(pdf), -1))})

    rows = df.select(*names, column)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names), f"{out} array<{kind}>"])
    return rows.mapInPandas(run, schema)


def _conv(inputs: int, outputs: int, size: int, weight: Callable[[int], np.ndarray], **how: int) -> Conv2D:
    return Conv2D(weight(size * size * inputs * outputs).reshape(size, size, inputs, outputs), **how)


#: Output channels of the convolutions and outputs of the dense layers of the model for 32 x 32 images.
ALEXNET = (96, 256, 384, 384, 256), (256, 256, 10)
#: Output channels of the convolutions in each block, and outputs of the dense layers for 32 x 32 and for 224 x 224 images.
VGG16 = ((64, 64), (128, 128), (256, 256, 256), (512, 512, 512), (512, 512, 512))
VGG16_DENSE = {32: (256, 256, 10), 224: (4096, 4096, 1000)}


def alexnet(weight: Callable[[int], np.ndarray], share: int = 1, channels: int = 3) -> Model:
    """The model for 32 x 32 images; all inner widths are divided by ``share``, and ``weight(n)`` gives the next n weights."""
    (a, *rest), dense = [max(1, w // share) for w in ALEXNET[0]], ALEXNET[1]
    layers = [_conv(channels, a, 11, weight, stride=4, pad=9), AvgPool(3, 2), ReLU()]
    layers += [_conv(a, rest[0], 5, weight, pad=1), AvgPool(2, 1), ReLU()]
    for before, after in zip(rest, rest[1:]):
        layers += [_conv(before, after, 3, weight, pad=1), ReLU()]
    return Model(layers + _dense_layers(rest[-1], [*(max(1, w // share) for w in dense[:-1]), dense[-1]], weight))


def vgg16(weight: Callable[[int], np.ndarray], share: int = 1, side: int = 32, channels: int = 3, bits: int = 0) -> Model:
    """The model for ``side`` x ``side`` images, 32 or 224: five blocks of 3 x 3 convolutions, each halved by pooling, and dense layers.

    ``bits`` are the fraction bits of fixed-point weights, dropped after each product; whole weights have none.
    """
    layers: list = []
    for block in VGG16:
        for width in block:
            layers += [_conv(channels, max(1, width // share), 3, weight, pad=1), ReLU()]
            channels = max(1, width // share)
        layers.append(AvgPool(2, 2))
    left = side >> len(VGG16)
    if left > 1:  # the large model halves once more
        layers, left = [*layers, AvgPool(2, 2)], left // 2
    *inner, last = VGG16_DENSE[side]
    layers += _dense_layers(channels * left**2, [*(max(1, w // share) for w in inner), last], weight)
    drop = [Rescale(bits)] if bits else []
    return Model([x for layer in layers for x in ([layer, *drop] if isinstance(layer, Conv2D | FullyConnected) else [layer])])


def _dense_layers(inputs: int, outputs: Sequence[int], weight: Callable[[int], np.ndarray]) -> list:
    out: list = []
    for n in outputs:
        out += [FullyConnected(weight(inputs * n).reshape(inputs, n)), ReLU()]
        inputs = n
    return out


def separate_channels(v: Column, channels: int) -> Column:
    """From a pixel's channels one after another to a channel's pixels one after another."""
    n = (F.size(v) / channels).cast("int")
    return F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.get(v, (i % n) * channels + F.floor(i / n).cast("int")))


def interleave_channels(v: Column, channels: int) -> Column:
    """The way back."""
    n = (F.size(v) / channels).cast("int")
    return F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.get(v, (i % channels) * n + F.floor(i / channels).cast("int")))


def reshape(m: DataFrame, columns: int, new_columns: int) -> DataFrame:
    """A matrix of (i, j, v) rows and ``columns`` columns with another number of columns, read row by row."""
    at = f"(i * {columns} + j)"
    return m.select(F.expr(f"{at} div {new_columns}").alias("i"), F.expr(f"{at} % {new_columns}").alias("j"), "v")


def elementwise(a: DataFrame, b: DataFrame, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """``combine`` of the values of two matrices of (i, j, v) rows at each place."""
    return a.join(b.select("i", "j", F.col("v").alias("_w")), ["i", "j"]).select("i", "j", combine(F.col("v"), F.col("_w")).alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two matrices of (i, j, v) rows."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("col"), F.col("v").alias("w"))
    return a.select("i", F.col("j").alias("k"), "v").join(right, "k").groupBy("i", F.col("col").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
