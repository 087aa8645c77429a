"""Image measures from Spark's own decoder: perceptual hashes, digests of RGB pixels, thumbnails, histograms, masks.

Pixels are brought to RGB first, so that digests agree with those of any tool that digests decoded RGB. Reductions use
fixed-point filters with 22 bits, as the common imaging libraries do, so that hashes agree with stored ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.functions.text import file_stem
from mullion.sources.scans import IMAGE_GLOB, relative

#: Bits of the filters' fixed-point weights, and the weights of red, green and blue in grey, of 65536. Fixed values.
PRECISION, GREY = 22, (19595, 38470, 7471)
#: Side of thumbnails and bins of histograms.
THUMB, BINS = 32, 16


def _sinc3(x: np.ndarray) -> np.ndarray:
    """The windowed sine of three lobes."""
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _cubic(x: np.ndarray) -> np.ndarray:
    """The cubic convolution with a slope of -1/2."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


@lru_cache(maxsize=256)
def _weights(m: int, n: int, kind: str) -> np.ndarray:
    """(n, m) fixed-point weights that bring m points to n; narrower targets widen the filter."""
    shape, support = {"sinc3": (_sinc3, 3.0), "cubic": (_cubic, 2.0)}[kind]
    scale = m / n
    wide = max(scale, 1.0)
    out = np.zeros((n, m), dtype=np.int64)
    for k in range(n):
        centre = (k + 0.5) * scale
        first, last = max(0, int(centre - support * wide + 0.5)), min(m, int(centre + support * wide + 0.5))
        w = shape((np.arange(first, last) - centre + 0.5) / wide)
        w = w / w.sum() * (1 << PRECISION)
        out[k, first:last] = np.trunc(w + np.where(w < 0, -0.5, 0.5))
    return out


def resized(plane: np.ndarray, n: int, kind: str) -> np.ndarray:
    """One channel of whole numbers from 0 to 255 as n by n: along the rows first, then the columns, rounded after each."""
    out = plane.astype(np.int64)
    for axis in (1, 0):
        if out.shape[axis] != n:
            w = _weights(out.shape[axis], n, kind)
            out = out @ w.T if axis == 1 else w @ out
            out = np.clip((out + (1 << (PRECISION - 1))) >> PRECISION, 0, 255)
    return out


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """(height, width, 3) from the decoder's bytes: grey, or blue, green, red and perhaps opacity, which is left out."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[..., 2::-1]


def grey(pixels: np.ndarray) -> np.ndarray:
    r, g, b = (pixels[..., i].astype(np.int64) for i in range(3))
    return (r * GREY[0] + g * GREY[1] + b * GREY[2] + 0x8000) >> 16


def hash_bits(pixels: np.ndarray, side: int = 8) -> int:
    """The side * side bits of a cosine hash of RGB pixels: low frequencies of a grey reduction above their median."""
    n = side * 4
    small = resized(grey(pixels), n, "sinc3").astype(float)
    c = 2 * np.cos(np.pi * np.arange(side)[:, None] * (2 * np.arange(n) + 1)[None, :] / (2 * n))
    low = c @ small @ c.T
    return int("".join("1" if b else "0" for b in (low > np.median(low)).ravel()), 2)


def thumbnail(pixels: np.ndarray) -> list[int]:
    """THUMB by THUMB by three values of RGB pixels."""
    return np.stack([resized(pixels[..., i], THUMB, "cubic") for i in range(3)], axis=-1).ravel().tolist()


def histogram(pixels: np.ndarray) -> list[float]:
    """Shares of the values of each channel in equal bins, one channel after the other."""
    out: list[float] = []
    for k in range(3):
        h = np.bincount(pixels[..., k].ravel().astype(np.int64) * BINS // 256, minlength=BINS)
        out += (h / max(1, h.sum())).tolist()
    return out


def split_level(values: np.ndarray) -> int:
    """The level from 0 to 255 at which two classes of values differ most; the lower class is up to it."""
    n = np.bincount(values.ravel().astype(np.int64), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(invalid="ignore", divide="ignore"):
        between = np.where((below > 0) & (above > 0), below * above * (mass / below - (mass[-1] - mass) / above) ** 2, -1.0)
    return int(np.argmax(between))


def covered_share(pixels: np.ndarray, mask: np.ndarray) -> float | None:
    """Marked pixels as a share of the dark area of the image together with the marked pixels; null if both are empty."""
    values, marked = grey(pixels), grey(mask) > 127
    area = (values <= split_level(values)) | marked
    return float(marked.sum() / area.sum()) if area.any() else None


def _decoded(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_GLOB).load(root)
    # The decoder gives the origin as an encoded address; a plus sign in it is itself.
    origin = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))
    return raw.select(relative(origin, root).alias("relpath"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def _each(rows: DataFrame, schema: str, measure: Callable[..., tuple], keys: int) -> DataFrame:
    """One row per row: the first `keys` columns, and what `measure` makes of the others; nulls for no picture."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(*r[:keys], *measure(*r[keys:])) for r in b.itertuples(index=False)], columns=names, dtype=object)

    return rows.mapInPandas(run, schema)


def image_measures(spark: SparkSession, root: str) -> DataFrame:
    """(relpath, width, height, phash, rgb_sha256, thumb, histogram) of every image; nulls for what can't be decoded."""

    def measure(w, h, c, data) -> tuple:
        if w is None or w <= 0:
            return (None,) * 6
        p = rgb(data, int(h), int(w), int(c))
        return int(w), int(h), f"{hash_bits(p):016x}", hashlib.sha256(np.ascontiguousarray(p).tobytes()).hexdigest(), thumbnail(p), histogram(p)

    return _each(_decoded(spark, root), "relpath string, width int, height int, phash string, rgb_sha256 string, thumb array<int>, histogram array<double>", measure, 1)


def hash_images(spark: SparkSession, root: str) -> DataFrame:
    """(relpath, width, height, phash, rgb_sha256) of every image; nulls for what can't be decoded."""
    return image_measures(spark, root).drop("thumb", "histogram")


def likeness(pairs: DataFrame, measures: DataFrame, a: str = "a", b: str = "b", low: float = 60.0, moderate: float = 30.0, aspect: float = 0.15) -> DataFrame:
    """Adds to pairs of relpaths: difference (mean of the thumbnails' differences), aspect_close, and a verdict of
    low, moderate or high similarity; all null where an image of the pair is missing or can't be decoded."""
    m = measures.select("relpath", "thumb", (F.col("width") / F.col("height")).alias("aspect"))
    x = m.select(F.col("relpath").alias(a), F.col("thumb").alias("_ta"), F.col("aspect").alias("_ra"))
    y = m.select(F.col("relpath").alias(b), F.col("thumb").alias("_tb"), F.col("aspect").alias("_rb"))
    total: Column = F.aggregate(F.zip_with("_ta", "_tb", lambda p, q: F.abs(p - q)), F.lit(0), lambda s, v: s + v)
    out = pairs.join(x, a, "left").join(y, b, "left").withColumn("difference", total / F.lit(3 * THUMB * THUMB)).withColumn("aspect_close", F.abs(F.col("_ra") - F.col("_rb")) < aspect)
    verdict = F.when(F.col("difference") > low, "low").when(F.col("difference") > moderate, "moderate").when(F.col("difference").isNotNull(), "high")
    return out.withColumn("similarity", verdict).drop("_ta", "_tb", "_ra", "_rb")


def mask_shares(spark: SparkSession, images: str, masks: str) -> DataFrame:
    """(stem, share) of every image with a mask of the same file stem and size; null where one can't be decoded or the
    sizes differ."""
    x, y = (_decoded(spark, root).withColumn("stem", file_stem(F.col("relpath"))).drop("relpath") for root in (images, masks))
    y = y.withColumnsRenamed({c: f"m_{c}" for c in ("width", "height", "channels", "data")})

    def measure(w, h, c, data, mw, mh, mc, mdata) -> tuple:
        if min(w or 0, h or 0) <= 0 or (w, h) != (mw, mh):
            return (None,)
        return (covered_share(rgb(data, int(h), int(w), int(c)), rgb(mdata, int(mh), int(mw), int(mc))),)

    joined = x.join(y, "stem").select("stem", "width", "height", "channels", "data", "m_width", "m_height", "m_channels", "m_data")
    return _each(joined, "stem string, share double", measure, 1)
