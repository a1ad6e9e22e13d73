"""Perceptual hashes and visual differences.

Rows have the columns of Spark's ``image`` source: width, height, n_channels and
BGR bytes. Decoding is Spark's; resampling and transforms run on batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.plans.session import spread

LEAST_SIDE = 32


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(id, width, height, n_channels, data) of all images below a folder; those that can't be decoded are left out."""
    raw = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder)
    return raw.select(F.col("image.origin").alias("id"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))


def grey(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
    """Luminance as a (height, width) array."""
    px = np.frombuffer(data, np.uint8, width * height * channels).reshape(height, width, channels).astype(float)
    return px[:, :, 0] if channels == 1 else px[:, :, :3] @ np.array([0.114, 0.587, 0.299])


@lru_cache(64)
def _weights(n: int, m: int) -> np.ndarray:
    edges = np.linspace(0, n, m + 1)
    lo, hi = edges[:-1, None], edges[1:, None]
    cover = np.minimum(hi, np.arange(1, n + 1)) - np.maximum(lo, np.arange(n))
    return np.clip(cover, 0, None) * m / n


def resample(img: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Area average to (rows, cols)."""
    return _weights(img.shape[0], rows) @ img @ _weights(img.shape[1], cols).T


def _packed(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits.ravel()).tobytes(), "big", signed=True)


def difference_hash(img: np.ndarray) -> int:
    """B2: 64 bits, row by row from the highest: a place of the 9 x 8 image is brighter than the next."""
    small = resample(img, 8, 9)
    return _packed(small[:, :-1] > small[:, 1:])


@lru_cache(64)
def _whole_weights(n: int, m: int) -> np.ndarray:
    """``_weights`` times what makes them whole numbers."""
    lo, hi = np.arange(m)[:, None] * n, np.arange(1, m + 1)[:, None] * n
    return np.clip(np.minimum(hi, np.arange(1, n + 1) * m) - np.maximum(lo, np.arange(n) * m), 0, None)


def exact_difference_hash(img: np.ndarray) -> int:
    """B2 of a luminance image, in whole numbers: equal places are equal, and no rounding makes one of them brighter."""
    small = _whole_weights(img.shape[0], 8) @ np.rint(img * 1000).astype(np.int64) @ _whole_weights(img.shape[1], 9).T
    return _packed(small[:, :-1] > small[:, 1:])


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


_DCT32 = _dct(32)


def perceptual_hash(img: np.ndarray) -> int:
    """63 bits: low frequencies of the 32 x 32 cosine transform without the mean, against the 32nd of them in order."""
    small = resample(img, 32, 32)
    low = (_DCT32 @ small @ _DCT32.T)[:8, :8].ravel()[1:]
    return _packed(np.concatenate(([False], low > np.sort(low)[31])))


def image_hashes(images: DataFrame) -> DataFrame:
    """(id, dhash, phash); null for images with a side under 32 pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, p = [], []
            for w, h, c, data in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                img = grey(w, h, c, data) if data and min(w, h) >= LEAST_SIDE else None
                d.append(None if img is None else exact_difference_hash(img))
                p.append(None if img is None else perceptual_hash(img))
            yield pa.record_batch([b.column(0), pa.array(d, pa.int64()), pa.array(p, pa.int64())], names=["id", "dhash", "phash"])

    kind = images.schema["id"].dataType.simpleString()
    return images.select("id", "width", "height", "n_channels", "data").mapInArrow(run, f"id {kind}, dhash long, phash long")


def grid_hash(grid: Column) -> Column:
    """B2 in SQL, for a 72-element array that holds the 9 x 8 image row by row."""
    places = F.filter(F.sequence(F.lit(0), F.lit(70)), lambda i: i % 9 != 8)
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(F.when(F.get(grid, i) > F.get(grid, i + 1), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def sample_times(duration: Column, middle_from: float = 2.0, end_offset: float = 1.0, tolerance: float = 0.05) -> Column:
    """Start, middle of videos of 2 s and more, and a second before the end; near times once; two at least where there is room."""
    end = F.greatest(duration - end_offset, F.lit(0.0))
    raw = F.array_sort(F.filter(F.array(F.lit(0.0), F.when(duration >= middle_from, duration / 2), F.when(duration > 0, end)), lambda x: x.isNotNull()))
    kept = F.aggregate(raw, F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) > 0) & (F.abs(F.element_at(acc, -1) - x) < tolerance), acc).otherwise(F.concat(acc, F.array(x))))
    fallback = F.greatest(duration - F.least(duration, F.lit(0.1)), F.lit(0.0))
    return F.when((F.size(kept) == 1) & (duration > 0) & (F.abs(kept[0] - fallback) > tolerance), F.concat(kept, F.array(fallback))).otherwise(kept)


def video_signatures(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """(id, duration_sec, frames): for each sample time the hash of the nearest frame, in order; null without frames.

    ``videos`` is (id, duration_sec), ``frames`` is (id, t, dhash).
    """
    times = videos.select("id", "duration_sec", F.posexplode(sample_times(F.col("duration_sec"))).alias("pos", "at"))
    near = times.join(frames.filter("dhash is not null"), "id").groupBy("id", "pos").agg(F.min_by("dhash", F.struct(F.abs(F.col("t") - F.col("at")), F.col("t"))).alias("h"))
    listed = near.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]).alias("frames"))
    return videos.select("id", "duration_sec").join(listed, "id", "left")


_SIDE = 256


def _square(w: int, h: int, c: int, data: bytes) -> np.ndarray:
    px = np.frombuffer(data, np.uint8, w * h * c).reshape(h, w, c)
    channels = [resample(px[:, :, k].astype(float), _SIDE, _SIDE) for k in range(1 if c == 1 else 3)]
    return np.stack(channels * 3 if c == 1 else channels).astype(np.float32)


def difference(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Pixel distances, structural similarity and histogram distance of two images of three planes of 256 x 256."""
    apart = np.sqrt(_total((x - y) ** 2))
    gx, gy = _total(x) / 3, _total(y) / 3
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    cov = ((gx - gx.mean()) * (gy - gy.mean())).mean()
    ssim = (2 * gx.mean() * gy.mean() + c1) * (2 * cov + c2) / ((gx.mean() ** 2 + gy.mean() ** 2 + c1) * (gx.var() + gy.var() + c2))
    return {
        "mean_difference": apart.mean(), "max_difference": apart.max(), "changed_pct": (apart > 10).mean() * 100, "ssim": ssim, "histogram_distance": np.abs(_histogram(x) - _histogram(y)).sum(),
        "hash_distance": float(bin((difference_hash(gx) ^ difference_hash(gy)) & (1 << 64) - 1).count("1")),
    }


def _total(planes: np.ndarray) -> np.ndarray:
    return planes[0] + planes[1] + planes[2]


def _histogram(planes: np.ndarray) -> np.ndarray:
    """Shares of the pixels in 16 x 16 x 16 colours."""
    level = (planes.clip(0, 255).astype(np.uint8) >> 4).astype(np.int32)
    return np.bincount((level[0] * 256 + level[1] * 16 + level[2]).ravel(), minlength=4096) / level[0].size


_MEASURES = ("mean_difference", "max_difference", "changed_pct", "ssim", "histogram_distance", "hash_distance")


_SQUARE_BYTES = _SIDE * _SIDE * 3 * 4


def reduced(images: DataFrame) -> DataFrame:
    """(id, width, height, n_channels, data): pictures of more bytes than a square of 256 x 256 in three channels has as that square.

    A square's numbers are 32-bit, and its n_channels is 0. Smaller pictures stay
    as they are, so that no row grows: ``_as_square`` makes their squares.
    """
    kind = images.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                b = batch[i : i + 16]
                out = []
                for row in zip(*b.columns[1:], strict=True):
                    w, h, c, data = (x.as_py() for x in row)
                    out.append((w, h, c, data) if len(data) <= _SQUARE_BYTES else (_SIDE, _SIDE, 0, _square(w, h, c, data).tobytes()))
                w, h, c, data = zip(*out, strict=True)
                sizes = [pa.array(x, pa.int32()) for x in (w, h, c)]
                yield pa.record_batch([b.column(0), *sizes, pa.array(data, pa.binary())], names=["id", "width", "height", "n_channels", "data"])

    return images.select("id", "width", "height", "n_channels", "data").mapInArrow(run, f"id {kind}, width int, height int, n_channels int, data binary")


def _as_square(w: int, h: int, c: int, data: bytes) -> np.ndarray:
    """The square of a row of ``reduced``."""
    square = np.frombuffer(data, np.float32).reshape(3, _SIDE, _SIDE) if c == 0 else _square(w, h, c, data)
    return square.astype(float)


def visual_differences(pairs: DataFrame, images: DataFrame, with_map: bool = False) -> DataFrame:
    """(a, b) with the measures; ``with_map`` adds the distance of every pixel as bytes, 0 to 255.

    A large picture is reduced once, and moved as its square, however many pairs
    it is in; pictures in none aren't. They go from one shuffle to the next and
    not by a table, whose readers would take thousands of squares at a time.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    small = reduced(images.join(ids, "id", "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                b = batch[i : i + 64]
                rows, maps = [], []
                for r in zip(*b.columns[2:], strict=True):
                    x, y = (_as_square(*(v.as_py() for v in side[:3]), side[3].as_buffer()) for side in (r[:4], r[4:]))
                    rows.append(difference(x, y))
                    maps.append(np.sqrt(_total((x - y) ** 2) / 3).clip(0, 255).astype(np.uint8).tobytes() if with_map else None)
                cols = [b.column(0), b.column(1), *(pa.array([r[m] for r in rows], pa.float64()) for m in _MEASURES)]
                yield pa.record_batch([*cols, pa.array(maps, pa.binary())], names=["a", "b", *_MEASURES, "map"])

    kind = images.schema["id"].dataType.simpleString()
    own = ["width", "height", "n_channels", "data"]
    left, right = (small.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in own]) for side in ("a", "b"))
    # a pair's rows are small and cost much
    joined = spread(pairs.select("a", "b").join(left, "a"), "b").join(right, "b").select("a", "b", *[f"{side}_{c}" for side in ("a", "b") for c in own])
    out = joined.mapInArrow(run, f"a {kind}, b {kind}, {', '.join(f'{m} double' for m in _MEASURES)}, map binary")
    return out if with_map else out.drop("map")


def overall_difference(d: DataFrame) -> DataFrame:
    """Score, verdict and whether the pair counts as a duplicate."""
    parts = F.array(
        F.least(F.lit(1.0), F.col("hash_distance") / 64) * 0.3, F.least(F.lit(1.0), F.col("mean_difference") / 255) * 0.3, (1 - F.col("ssim")) * 0.3,
        F.least(F.lit(1.0), F.col("histogram_distance") / 2) * 0.1,
    )
    known = F.filter(parts, lambda x: x.isNotNull())
    score = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(0.5)
    d = d.withColumn("score", score)
    v = None
    for below, name in ((0.05, "identical"), (0.15, "nearlyIdentical"), (0.30, "verySimilar"), (0.50, "similar"), (0.70, "somewhatDifferent")):  # fixed values
        v = F.when(F.col("score") < below, name) if v is None else v.when(F.col("score") < below, name)
    return d.withColumn("verdict", v.otherwise("veryDifferent")).withColumn("is_duplicate", F.col("score") < 0.3)
