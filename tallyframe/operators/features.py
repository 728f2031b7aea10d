"""Pixels and stored vectors to features.

Pixel work runs in Arrow batches over partitioned rows; everything on stored
arrays is a column expression and needs no shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tallyframe.functions.names import norm_stem
from tallyframe.functions.values import normalize_channels

# Executors get the pixel functions with the plan, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Feature image side, histogram bins, channel mean and std of the evaluation transform.
FEATURE_SIZE = 128
HIST_BINS = 16
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)

STACK_BYTES = 8 << 20  # pixels worked on together


def _weights(src: int, dst: int, kind: str) -> np.ndarray:
    """Row-normalised filter weights ``dst x src``; the filter widens when shrinking."""
    scale = src / dst
    widen = max(scale, 1.0)
    centers = (np.arange(dst) + 0.5) * scale
    x = np.abs((np.arange(src)[None, :] + 0.5 - centers[:, None]) / widen)
    if kind == "bilinear":
        w = np.clip(1.0 - x, 0.0, None)
    else:  # cubic, a = -0.5
        w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def _to_bytes(a: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(a + 0.5), 0, 255).astype(np.uint8)


def resize_pixels(pixels: np.ndarray, height: int, width: int, kind: str) -> np.ndarray:
    """Resampled ``uint8[h, w, channels]``; ``kind`` is nearest, bilinear or bicubic."""
    h, w = pixels.shape[:2]
    if (h, w) == (height, width):
        return pixels
    if kind == "nearest":
        rows = ((np.arange(height) + 0.5) * h / height).astype(int)
        cols = ((np.arange(width) + 0.5) * w / width).astype(int)
        return pixels[rows][:, cols]
    if w != width:
        pixels = _to_bytes(np.einsum("xw,hwc->hxc", _weights(w, width, kind), pixels))
    if h != height:
        pixels = _to_bytes(np.einsum("yh,hwc->ywc", _weights(h, height, kind), pixels))
    return pixels


def _pixels(data: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, -1)


@pandas_udf(T.BinaryType())
def rgb_bytes(channels: pd.Series, data: pd.Series) -> pd.Series:
    """RGB bytes of decoded images that hold gray, BGR or BGRA bytes."""
    out = []
    for n, raw in zip(channels, data, strict=True):
        px = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)
        px = np.repeat(px, 3, axis=1) if n == 1 else px[:, 2::-1]
        out.append(np.ascontiguousarray(px).tobytes())
    return pd.Series(out)


def exif_orientation(raw: bytes) -> int:
    """The orientation tag (1 to 8) of a JPEG's EXIF segment, 1 when there is none."""
    if raw[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] != 0xDA:
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        if raw[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            order = "little" if tiff[:2] == b"II" else "big"

            def number(place: int, width: int, tiff=tiff, order=order) -> int:
                return int.from_bytes(tiff[place : place + width], order)

            table = number(4, 4)
            for entry in range(table + 2, table + 2 + 12 * number(table, 2), 12):
                if number(entry, 2) == 0x0112:
                    value = number(entry + 8, 2)
                    return value if 1 <= value <= 8 else 1
            return 1
        at += 2 + size
    return 1


@pandas_udf(T.IntegerType())
def orientation(content: pd.Series) -> pd.Series:
    return content.map(exif_orientation)


def turned(pixels: np.ndarray, tag: int) -> np.ndarray:
    """Pixels as they should be shown, by orientation tag."""
    if tag >= 5:
        pixels = pixels.swapaxes(0, 1)
    if tag in (3, 4, 7, 8):
        pixels = pixels[::-1]
    if tag in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return pixels


@pandas_udf(
    T.StructType(
        [
            T.StructField("height", T.IntegerType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("data", T.BinaryType()),
        ]
    )
)
def upright(data: pd.Series, height: pd.Series, width: pd.Series, tag: pd.Series) -> pd.DataFrame:
    rows = []
    for d, h, w, t in zip(data, height, width, tag, strict=True):
        px = np.ascontiguousarray(turned(_pixels(d, h, w), t))
        rows.append((px.shape[0], px.shape[1], px.tobytes()))
    return pd.DataFrame(rows, columns=["height", "width", "data"])


@pandas_udf(T.BinaryType())
def to_gray(data: pd.Series) -> pd.Series:
    """Luma bytes of RGB bytes (weights 299, 587, 114 per mille)."""
    weights = np.array([19595, 38470, 7471], dtype=np.int64)
    out = []
    for raw in data:
        px = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int64)
        out.append((((px @ weights) + 0x8000) >> 16).astype(np.uint8).tobytes())
    return pd.Series(out)


@pandas_udf(T.BinaryType())
def resize_nearest(
    data: pd.Series, height: pd.Series, width: pd.Series, to_height: pd.Series, to_width: pd.Series
) -> pd.Series:
    """Mask bytes at another size."""
    return pd.Series(
        [
            np.ascontiguousarray(resize_pixels(_pixels(d, h, w), th, tw, "nearest")).tobytes()
            for d, h, w, th, tw in zip(data, height, width, to_height, to_width, strict=True)
        ]
    )


@pandas_udf(T.BinaryType())
def binarize_mask(data: pd.Series) -> pd.Series:
    """Mask bytes as 0 and 1."""
    return data.map(lambda d: (np.frombuffer(d, dtype=np.uint8) > 0).astype(np.uint8).tobytes())


def image_features(
    images: DataFrame, bins: int = HIST_BINS, size: int | None = FEATURE_SIZE, out: str = "features"
) -> DataFrame:
    """Density histogram per channel, then channel means and population stds of values in [0, 1].

    ``size`` None keeps each image's own size.
    """

    def stacked(data: pd.Series, height: pd.Series, width: pd.Series):
        """Images of one size at a time, a bounded number together: ``(places, uint8[n, pixels, 3])``."""
        sizes = pd.DataFrame({"h": height, "w": width}).groupby(["h", "w"]).indices
        for (h, w), places in sizes.items():
            step = max(1, STACK_BYTES // (3 * (size * size if size else h * w)))
            for k in range(0, len(places), step):
                some = places[k : k + step]
                if size is None or (h, w) == (size, size):
                    joined = np.frombuffer(b"".join(data.iloc[i] for i in some), dtype=np.uint8)
                else:
                    joined = np.stack([resize_pixels(_pixels(data.iloc[i], h, w), size, size, "bilinear") for i in some])
                yield some, joined.reshape(len(some), -1, 3)

    @pandas_udf(T.ArrayType(T.FloatType()))
    def features(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        out_rows = np.empty((len(data), 3 * bins + 6), dtype=np.float32)
        for places, px in stacked(data, height, width):
            n, pixels, _ = px.shape
            whole = px.astype(np.int64)
            slots = whole * bins // 256 + np.arange(3) * bins + np.arange(n)[:, None, None] * (3 * bins)
            tallies = np.bincount(slots.reshape(-1), minlength=n * 3 * bins).reshape(n, 3 * bins)
            # mean and std from whole sums: no rounding before the last step
            total, squares = whole.sum(axis=1), (whole * whole).sum(axis=1)
            out_rows[places, : 3 * bins] = tallies / (pixels * 256.0 / bins)
            out_rows[places, 3 * bins : 3 * bins + 3] = total / (pixels * 255.0)
            out_rows[places, 3 * bins + 3 :] = np.sqrt(pixels * squares - total * total) / (pixels * 255.0)
        return pd.Series(list(out_rows))

    return images.withColumn(out, features("data", "height", "width"))


def flatten_images(images: DataFrame, size: int, out: str = "features") -> DataFrame:
    """All pixels at ``size`` x ``size``, scaled to [0, 1]."""

    @pandas_udf(T.ArrayType(T.FloatType()))
    def flat(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series(
            [
                resize_pixels(_pixels(d, h, w), size, size, "bicubic").astype(np.float32).reshape(-1) / np.float32(255)
                for d, h, w in zip(data, height, width, strict=True)
            ]
        )

    return images.withColumn(out, flat("data", "height", "width"))


def image_tensor(
    images: DataFrame,
    size: int = 224,
    mean: Sequence[float] = CHANNEL_MEAN,
    std: Sequence[float] = CHANNEL_STD,
    out: str = "tensor",
) -> DataFrame:
    """Resized, scaled and normalised per channel; channel planes one after another."""
    mean_a = np.array(mean, dtype=np.float32)
    std_a = np.array(std, dtype=np.float32)

    @pandas_udf(T.ArrayType(T.FloatType()))
    def tensor(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        rows = []
        for d, h, w in zip(data, height, width, strict=True):
            px = resize_pixels(_pixels(d, h, w), size, size, "bilinear").astype(np.float32) / np.float32(255)
            rows.append(((px - mean_a) / std_a).transpose(2, 0, 1).reshape(-1))
        return pd.Series(rows)

    return images.withColumn(out, tensor("data", "height", "width"))


def normalized(df: DataFrame, col: str, mean: Sequence[float], std: Sequence[float], out: str) -> DataFrame:
    """The normalising step alone, on stored arrays."""
    return df.withColumn(out, normalize_channels(col, mean, std))


def vector_features(
    df: DataFrame, col: str, bins: int, low: float, high: float, out: str = "features"
) -> DataFrame:
    """The histogram, mean and population std of a stored array, within its row."""
    x = F.col(col)
    width = (high - low) / bins
    inside = F.filter(x, lambda v: (v >= low) & (v <= high))
    places = F.transform(
        inside, lambda v: F.least(F.floor((v - low) / width), F.lit(bins - 1).cast("bigint"))
    )
    tallies = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter("_places", lambda p: p == b))
    )
    density = F.transform(
        "_tallies", lambda n: F.coalesce(F.try_divide(n, F.size("_places") * F.lit(width)), F.lit(0.0))
    )
    total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    spread = F.aggregate(
        x, F.lit(0.0), lambda acc, v: acc + (v - F.col("_mean")) * (v - F.col("_mean"))
    )
    n = F.size(x)
    return (
        df.withColumn("_places", places)
        .withColumn("_tallies", tallies)
        .withColumn("_mean", F.try_divide(total, n))
        .withColumn("_std", F.sqrt(F.try_divide(spread, n)))
        .withColumn(out, F.concat(density, F.array("_mean", "_std")))
        .drop("_places", "_tallies", "_mean", "_std")
    )


def feature_stats(df: DataFrame, col: str) -> DataFrame:
    """One row: mean and population std per place of an array column, and the number of rows."""
    stats = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(col)))
    n = F.col("s.count")
    return df.agg(stats.alias("s")).select(
        vector_to_array("s.mean").alias("mean"),
        F.transform(
            vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / F.greatest(n, F.lit(1)))
        ).alias("std"),
        n.alias("rows"),
    )


def apply_stats(df: DataFrame, stats: DataFrame, col: str, out: str) -> DataFrame:
    """Standardised arrays; a constant place keeps a divisor of 1. ``stats`` is one row."""
    centred = F.zip_with(F.col(col), F.col("_mean"), lambda v, m: v - m)
    scaled = F.zip_with(centred, F.col("_std"), lambda v, s: v / F.when(s == 0, F.lit(1.0)).otherwise(s))
    return (
        df.withColumn("_mean", stats.select("mean").scalar())
        .withColumn("_std", stats.select("std").scalar())
        .withColumn(out, scaled)
        .drop("_mean", "_std")
    )


def standardize(df: DataFrame, col: str = "x", out: str = "z") -> DataFrame:
    return apply_stats(df, feature_stats(df, col), col, out)


def shape_check(images: DataFrame, masks: DataFrame, key: Column | None = None) -> DataFrame:
    """Whether each image and its mask agree in size, by stem. Stems are unique on both sides."""
    stem = key if key is not None else norm_stem("path")
    a = images.groupBy(stem.alias("stem")).agg(F.min(F.struct("path", "height", "width")).alias("i"))
    b = masks.groupBy(stem.alias("stem")).agg(F.min(F.struct("path", "height", "width")).alias("m"))
    return a.join(b, "stem").select(
        "stem",
        F.col("i.height").alias("height"),
        F.col("i.width").alias("width"),
        F.col("m.height").alias("mask_height"),
        F.col("m.width").alias("mask_width"),
        ((F.col("i.height") == F.col("m.height")) & (F.col("i.width") == F.col("m.width"))).alias("same_size"),
    )
