"""Distances and blocking keys of single files."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinweave.plans.config import Thresholds


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hamming(a: str | Column, b: str | Column) -> Column:
    """Number of differing bits of two 64-bit hashes."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b))).cast("int")


def match_confidence(distance: str | Column) -> Column:
    """1 - d / 64, at least 0."""
    return F.greatest(F.lit(0.0), 1 - _c(distance) / 64.0)


def extension(name: str | Column) -> Column:
    """Lower-case file extension, empty without one."""
    return F.lower(F.regexp_extract(_c(name), r"\.([^./]+)$", 1))


def stem(name: str | Column) -> Column:
    """C4: normalised name without extension."""
    s = F.lower(F.regexp_replace(_c(name), r"\.[^./]+$", ""))
    s = F.translate(s, "_-", "  ")
    for mark in ("copy", "(1)", "(2)", "(3)"):  # fixed values
        s = F.replace(s, F.lit(mark))
    return F.trim(s)


def stem_bucket(name_stem: str | Column) -> Column:
    """First four letters, marks or digits of a stem, else ``none``."""
    s = F.substring(F.regexp_replace(_c(name_stem), r"[^\p{L}\p{M}\p{N}]", ""), 1, 4)
    return F.when(s == "", "none").otherwise(s)


def snapped(v: str | Column) -> Column:
    """Next multiple of 16, 0 for values up to 0 and null."""
    v = _c(v)
    return F.when(v > 0, (F.floor((v + 15) / 16) * 16).cast("long")).otherwise(F.lit(0).cast("long"))


def size_bucket(size: str | Column, banding: str = "reference") -> Column:
    """Size over 1 % of itself; ``log`` banding gives bands that do differ (``log_band``)."""
    size = _c(size)
    if banding == "log":
        return F.greatest(log_band(size, 0.01, 1.0), F.lit(0))
    return F.when(size > 0, F.round(size / F.greatest(F.lit(1.0), size * 0.01))).otherwise(F.lit(0)).cast("long")


def duration_bucket(seconds: str | Column, share: float) -> Column:
    """Duration over the greater of half a second and its share."""
    d = _c(seconds)
    return F.when(d > 0, F.round(d / F.greatest(F.lit(0.5), d * share))).otherwise(F.lit(0)).cast("long")


#: Bands are this much wider than what is close, so that rounding never sets close values two bands apart.
_BAND_SLACK = 1.01


def log_band(value: str | Column, share: float, least: float) -> Column:
    """C7, C8 for ``banding="log"``: values that are ``close`` are in one band or in two that meet; -10 for null and values up to 0.

    Bands are as wide as the tolerance: ``least`` up to least / share, and from
    there on in proportion to the value.
    """
    v = _c(value).cast("double")
    knee = least / share
    steps = F.when(v < knee, v / least).otherwise(F.log(v / knee) / -math.log1p(-share) + 1 / share)
    return F.when(v > 0, F.floor(steps / _BAND_SLACK)).otherwise(F.lit(-10)).cast("long")


def close(a: str | Column, b: str | Column, share: float, least: float) -> Column:
    """Whether values differ by ``share`` of the greater, or ``least`` if that is more; values up to 0 and nulls are alike."""
    a, b = (F.greatest(F.coalesce(_c(x).cast("double"), F.lit(0.0)), F.lit(0.0)) for x in (a, b))
    return ((a > 0) == (b > 0)) & (F.abs(a - b) <= F.greatest(F.lit(least), F.greatest(a, b) * share))


def resolution_tier(width: str | Column, height: str | Column) -> Column:
    """Tier of the longer side; unknown without dimensions."""
    side = F.when(_c(width).isNotNull() & _c(height).isNotNull(), F.greatest(_c(width), _c(height)))
    tier = F.when(side.isNull(), "unknown")
    for below, name in ((720, "sd"), (1080, "hd720"), (1440, "hd1080"), (2160, "quad"), (3000, "uhd")):  # fixed values
        tier = tier.when(side < below, name)
    return tier.otherwise("beyond")


def signature(t: Thresholds = Thresholds(), banding: str = "reference") -> Column:
    """Blocking key of a row with the asset columns."""
    bucket = stem_bucket(stem("file_name"))
    size = size_bucket("file_size", banding).cast("string")
    duration = lambda share: duration_bucket(F.coalesce("duration_sec", F.lit(0.0)), share).cast("string")
    photo = F.concat(F.lit("img:"), snapped("width").cast("string"), F.lit("x"), snapped("height").cast("string"), F.lit(":s"), size, F.lit(":n"), bucket)
    video = F.concat(F.lit("vid:"), resolution_tier("width", "height"), F.lit(":d"), duration(t.duration_share), F.lit(":n"), bucket)
    audio = F.concat(F.lit("aud:d"), duration(0.01), F.lit(":s"), size, F.lit(":n"), bucket)
    return F.when(F.col("media_type") == "photo", photo).when(F.col("media_type") == "video", video).otherwise(audio)


def size_category(size: str | Column, with_tiny: bool = False) -> Column:
    """Small, medium, large or xlarge at 1, 10 and 100 MB; optionally tiny below 1 kB."""
    size = _c(size)
    c = F.when((size < 1024) & F.lit(with_tiny), "tiny")
    return c.when(size < 1 << 20, "small").when(size < 10 << 20, "medium").when(size < 100 << 20, "large").otherwise("xlarge")


def pair(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """An unordered pair as (least, greatest)."""
    return F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b))
