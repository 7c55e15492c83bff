"""Pixel operators over the ``image`` source's struct (BGR bytes), in Arrow batches."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curalake import schemas as S
from curalake.session import bounded_batches


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Image struct -> ``(height, width, 3)`` RGB float array."""
    raw = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(raw, 3, axis=2).astype(np.float64)
    return raw[:, :, 2::-1].astype(np.float64)


#: Weights kept per Python worker: those of sides up to ``KEPT_SIDE`` pixels; the weights of a long side take megabytes.
KEPT_SIDE = 256


def resample_weights(source: int, target: int, support: float, kernel) -> np.ndarray:
    """``(target, source)`` weights of a separable, anti-aliased resampling."""
    return (_kept_weights if max(source, target) <= KEPT_SIDE else _weights)(source, target, support, kernel)


def _weights(source: int, target: int, support: float, kernel) -> np.ndarray:
    scale = max(source / target, 1.0)
    centers = (np.arange(target) + 0.5) * source / target
    weights = kernel((np.arange(source) + 0.5 - centers[:, None]) / scale)
    weights[np.abs((np.arange(source) + 0.5 - centers[:, None]) / scale) >= support] = 0.0
    return weights / weights.sum(axis=1, keepdims=True)


@functools.lru_cache(maxsize=256)
def _kept_weights(source: int, target: int, support: float, kernel) -> np.ndarray:
    return _weights(source, target, support, kernel)


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - np.abs(x))


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.sinc(x) * np.sinc(x / 3.0)


def resize(image: np.ndarray, height: int, width: int, kernel=triangle, support: float = 1.0) -> np.ndarray:
    """Rows first, then columns: two small contractions."""
    rows = resample_weights(image.shape[0], height, support, kernel)
    columns = resample_weights(image.shape[1], width, support, kernel)
    return np.moveaxis(np.tensordot(columns, np.tensordot(rows, image, axes=1), axes=(1, 1)), 0, 1)


def luma(image: np.ndarray) -> np.ndarray:
    return image @ np.array([0.299, 0.587, 0.114])


def square_pad(image: np.ndarray, fill=S.PAD_COLOR) -> np.ndarray:
    """Pad to a square; an odd pixel goes to the right or the bottom."""
    height, width = image.shape[:2]
    side = max(height, width)
    result = np.empty((side, side, 3))
    result[:] = fill
    top, left = (side - height) // 2, (side - width) // 2
    result[top:top + height, left:left + width] = image
    return result


def normalized(image: np.ndarray, size: int) -> np.ndarray:
    """Square pad, resize, channel-wise standardisation; channel-first floats."""
    small = resize(square_pad(image), size, size) / 255.0
    return np.transpose((small - np.array(S.CHANNEL_MEAN)) / np.array(S.CHANNEL_STD), (2, 0, 1))


def gray_grid(image: np.ndarray, size: int = 8) -> np.ndarray:
    """Row-major ``size x (size+1)`` gray grid for the difference hash."""
    gray = np.rint(luma(image))
    return np.clip(np.rint(resize(gray, size, size + 1, lanczos, 3.0)), 0, 255).reshape(-1)


def luma_range(image: np.ndarray) -> int:
    small = np.rint(resize(np.rint(luma(image)), 64, 64))
    return int(small.max() - small.min())


def _map(df: DataFrame, name: str, kind: T.DataType, function) -> DataFrame:
    """Apply ``function`` to every decoded image; undecodable rows get null."""
    keep = [f for f in df.schema.fields if f.name != "image"]
    schema = T.StructType([*keep, T.StructField(name, kind)])
    bounded_batches(df.sparkSession)
    flat = df.select(*[f.name for f in keep], "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [
                function(pixels(h, w, c, d)) if h is not None and h > 0 else None
                for h, w, c, d in zip(batch["height"], batch["width"], batch["nChannels"], batch["data"])
            ]
            yield batch[[f.name for f in keep]].assign(**{name: pd.Series(values, index=batch.index, dtype=object)})

    return flat.mapInPandas(run, schema)


def image_grids(df: DataFrame) -> DataFrame:
    """``image`` -> ``grid``; hash it with ``functions.hashing.grid_difference_hash``."""
    return _map(df, "grid", T.ArrayType(T.DoubleType()), gray_grid)


def image_features(df: DataFrame, size: int = 224) -> DataFrame:
    """``image`` -> ``features``: flat, normalised, channel-first floats."""
    return _map(df, "features", T.ArrayType(T.FloatType()), lambda i: normalized(i, size).astype(np.float32).reshape(-1))


def image_luma_range(df: DataFrame) -> DataFrame:
    return _map(df, "luma_range", T.IntegerType(), luma_range)


def decode_audit(images: DataFrame) -> DataFrame:
    """``path, decodable, width, height, short_side`` of an ``image`` scan (failed decodes have height -1)."""
    ok = F.col("image.height") > 0
    return images.select(
        F.col("image.origin").alias("path"), ok.alias("decodable"), F.when(ok, F.col("image.width")).alias("width"),
        F.when(ok, F.col("image.height")).alias("height"), F.when(ok, F.least("image.width", "image.height")).alias("short_side"),
    )


@F.pandas_udf(T.IntegerType())
def exif_orientation(content: pd.Series) -> pd.Series:
    """EXIF tag 274 from JPEG bytes; 1 when absent."""
    return content.map(_orientation)


def _orientation(data: bytes | None) -> int:
    if not data or data[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        length = int.from_bytes(data[at + 2:at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4:at + 10] == b"Exif\0\0":
            tiff = data[at + 10:at + 2 + length]
            order = "little" if tiff[:2] == b"II" else "big"
            number = lambda i, n: int.from_bytes(tiff[i:i + n], order)
            first = number(4, 4)
            for entry in range(number(first, 2)):
                place = first + 2 + 12 * entry
                if number(place, 2) == 274:
                    return number(place + 8, 2)
            return 1
        at += 2 + length
    return 1
