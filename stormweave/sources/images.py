"""Perceptual hashes of image directories.

Spark's image source decodes on the JVM; the resize and the gradient are a few numpy lines per image inside a
task. Files the source cannot decode take a digest instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 9, 8
_LOBES = 3.0


def _resample(source: int, target: int) -> np.ndarray:
    """Lanczos weights that take `source` samples to `target`, widened when shrinking."""
    scale = source / target
    stretch = max(scale, 1.0)
    weights = np.zeros((target, source))
    for out in range(target):
        centre = (out + 0.5) * scale
        low = max(int(centre - _LOBES * stretch + 0.5), 0)
        high = min(int(centre + _LOBES * stretch + 0.5), source)
        x = (np.arange(low, high) + 0.5 - centre) / stretch
        row = np.where(np.abs(x) < _LOBES, np.sinc(x) * np.sinc(x / _LOBES), 0.0)
        weights[out, low:high] = row / row.sum()
    return weights


def _grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of grey, BGR or BGRA pixels with the usual integer weights."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(np.float64)
    blue, green, red = (pixels[:, :, i].astype(np.int64) for i in range(3))
    return ((red * 19595 + green * 38470 + blue * 7471 + 0x8000) >> 16).astype(np.float64)


def gradient_hash(height: int, width: int, channels: int, data: bytes) -> int | None:
    """64 bits: is a cell of the 9 x 8 thumbnail brighter than its right neighbour? Signed for a long."""
    if height <= 0 or width <= 0 or len(data) < height * width * channels:
        return None
    grey = _grey(np.frombuffer(data, np.uint8)[: height * width * channels].reshape(height, width, channels))
    across = np.clip(np.floor(grey @ _resample(width, WIDTH).T + 0.5), 0, 255)
    small = np.clip(np.floor(_resample(height, HEIGHT) @ across + 0.5), 0, 255)
    bits = (small[:, :-1] > small[:, 1:]).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = zip(batch["height"], batch["width"], batch["channels"], batch["data"], strict=True)
        batch["hash"] = pd.array([gradient_hash(*row) for row in rows], dtype="Int64")
        yield batch[["origin", "hash"]]


def hash_images(images: DataFrame) -> DataFrame:
    """(origin, hash) for rows in the schema of Spark's image source."""
    flat = images.select(
        "image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data"
    )
    return flat.mapInPandas(_hashes, "origin string, hash long")


def digest_hash(path: Column) -> Column:
    """Stand-in for an image that cannot be decoded: the first 16 hex digits of the digest of its path."""
    return F.substring(F.md5(path), 1, 16)


def hash_text(value: Column) -> Column:
    """A hash as 16 hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def directory_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(origin, phash) for every file below a path."""
    decoded = hash_images(spark.read.format("image").option("dropInvalid", "true").load(path))
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("origin"))
    )
    return files.join(decoded, "origin", "left").select(
        "origin", F.coalesce(hash_text(F.col("hash")), digest_hash(F.col("origin"))).alias("phash")
    )


__all__ = ["digest_hash", "directory_hashes", "gradient_hash", "hash_images", "hash_text"]
