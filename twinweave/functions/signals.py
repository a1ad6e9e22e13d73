"""Evidence of a pair.

Functions take a row with the columns of both files, prefixed ``a_`` and ``b_``,
and give a signal struct (key, weight, raw, contribution, note) or null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from twinweave.functions.fingerprints import hamming
from twinweave.plans.config import Thresholds, Weights

SIGNAL = "struct<key:string,weight:double,raw:double,contribution:double,note:string>"


def a(c: str) -> Column:
    return F.col(f"a_{c}")


def b(c: str) -> Column:
    return F.col(f"b_{c}")


def signal(key: str, weight: float, raw: Column, note: Column, contribution: Column | None = None) -> Column:
    """A signal, null where ``raw`` is."""
    value = F.lit(weight) * raw if contribution is None else contribution
    s = F.struct(F.lit(key).alias("key"), F.lit(weight).alias("weight"), raw.cast("double").alias("raw"), value.cast("double").alias("contribution"), note.alias("note"))
    return F.when(raw.isNotNull(), s)


def same_checksum() -> Column:
    return F.when(a("checksum").isNotNull() & b("checksum").isNotNull(), (a("checksum") == b("checksum")).cast("double"))


def checksum_signal(w: Weights, same: Column | None = None) -> Column:
    """C17."""
    same = same_checksum() if same is None else same
    return signal("checksum", w.checksum, same, F.when(same == 1, "checksum match").otherwise("checksum mismatch"))


def image_distance() -> Column:
    return hamming(a("dhash"), b("dhash"))


def image_hash_raw(t: Thresholds, d: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - d / float(max(t.image_distance, 1))) + d * 0


def image_hash_signal(w: Weights, t: Thresholds, d: Column | None = None) -> Column:
    """C15."""
    d = image_distance() if d is None else d
    return signal("hash", w.hash, image_hash_raw(t, d), F.concat(F.lit("dHash distance="), d.cast("string")))


def frame_distances() -> Column:
    """Distances of the frames that both videos have, in order."""
    n = F.least(F.size(a("frames")), F.size(b("frames")))
    return F.zip_with(F.slice(a("frames"), 1, n), F.slice(b("frames"), 1, n), lambda x, y: hamming(x, y))


def most_frame_distance() -> Column:
    return F.when(a("frames").isNotNull() & b("frames").isNotNull(), F.array_max(frame_distances()))


def video_hash_raw(t: Thresholds, d: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - d / float(max(t.frame_distance, 1))) + d * 0


def video_hash_signal(w: Weights, t: Thresholds, d: Column | None = None) -> Column:
    """C16."""
    d = most_frame_distance() if d is None else d
    return signal("hash", w.hash, video_hash_raw(t, d), F.concat(F.lit("max frame distance="), d.cast("string")))


def _closeness(c: str) -> Column:
    most = F.greatest(a(c), b(c))
    both = a(c).isNotNull() & b(c).isNotNull()
    return F.when(both & (most > 0), F.greatest(F.lit(0.0), 1 - F.abs(a(c) - b(c)) / most))


def mean(*parts: Column) -> Column:
    """Mean of the parts that aren't null; no lambda, so that it is compiled."""
    total, known = F.lit(0.0), F.lit(0)
    for x in parts:
        total, known = total + F.coalesce(x, F.lit(0.0)), known + x.isNotNull().cast("int")
    return F.when(known > 0, total / known)


def _size_closeness() -> Column:
    return F.when((a("file_size") > 0) & (b("file_size") > 0), _closeness("file_size"))


def _duration_closeness(t: Thresholds) -> Column:
    da, db = a("duration_sec"), b("duration_sec")
    tolerance = F.greatest(F.greatest(da, db) * t.duration_share, F.lit(2.0))
    delta = F.abs(da - db)
    return F.when((da > 0) & (db > 0) & (delta <= tolerance), 1 - delta / tolerance)


def _sided(c: str) -> Column:
    return (a(c) > 0) & (b(c) > 0)


def likeness_parts(video: Column, t: Thresholds) -> list[Column]:
    """Closeness of sizes, or of a video's durations, and of both dimensions; likeness is the mean of those there are."""
    side = lambda c: F.when(~video | _sided(c), _closeness(c))
    return [F.when(video, _duration_closeness(t)).otherwise(_size_closeness()), side("width"), side("height")]


def image_likeness() -> Column:
    """Reads no durations, so that rows of pictures need none."""
    return mean(_size_closeness(), _closeness("width"), _closeness("height"))


def image_metadata_signal(w: Weights, likeness: Column | None = None) -> Column:
    """C13."""
    return signal("metadata", w.metadata, image_likeness() if likeness is None else likeness, F.lit("metadata similarity"))


def video_likeness(t: Thresholds) -> Column:
    """Reads no file sizes."""
    return mean(_duration_closeness(t), *[F.when(_sided(c), _closeness(c)) for c in ("width", "height")])


def video_metadata_signal(w: Weights, t: Thresholds, likeness: Column | None = None) -> Column:
    """C14."""
    return signal("metadata", w.metadata, video_likeness(t) if likeness is None else likeness, F.lit("video metadata"))


def capture_delta() -> Column:
    return F.abs(a("capture_s") - b("capture_s"))


def capture_raw(delta: Column) -> Column:
    return F.when(delta <= 2, F.lit(1.0)).when(delta < 10, 1 - delta / 10.0)


def capture_signal(w: Weights, delta: Column | None = None) -> Column:
    """C12; times in seconds."""
    delta = capture_delta() if delta is None else delta
    return signal("captureTime", w.capture_time, capture_raw(delta), F.concat(F.lit("capture delta="), F.format_string("%.2f", delta.cast("double")), F.lit("s")))


def name_signal(w: Weights) -> Column:
    """C18; ``name_score`` is C11 of the stems."""
    return signal("name", w.name, F.when(F.col("name_score") > 0, F.col("name_score")), F.lit("name similarity"))


def jaro_winkler(x: str, y: str) -> float:
    """C11: Jaro similarity raised by 0.1 for each of the first four places that agree.

    Two empty names are alike. A window below 0 (names of one letter, or against
    an empty one) has no matches.
    """
    if not x and not y:
        return 1.0
    window = max(len(x), len(y)) // 2 - 1
    taken: set[int] = set()
    left = []
    for i, c in enumerate(x):
        j = next((j for j in range(max(0, i - window), min(i + window + 1, len(y))) if j not in taken and y[j] == c), None)
        if j is not None:
            taken.add(j)
            left.append(c)
    if not left:
        return 0.0
    swaps = sum(c != y[j] for c, j in zip(left, sorted(taken), strict=True))
    m = len(left)
    jaro = (m / len(x) + m / len(y) + (m - swaps / 2) / m) / 3
    agree = sum(c == d for c, d in zip(x[:4], y[:4], strict=False))
    return jaro + agree * 0.1 * (1 - jaro)


_LETTERS = 64
_CHUNK = 4096


def _letters(texts: list[str], lengths: np.ndarray) -> np.ndarray:
    """Code points of texts as rows of one width, -1 beyond their ends."""
    width = max(int(lengths.max()), 1)
    out = np.full((len(texts), width), -1, np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _low_bits(n: np.ndarray) -> np.ndarray:
    """Words whose lowest ``n`` bits are set, for n from 0 to 64."""
    n = np.clip(n, 0, 64)
    return np.where(n >= 64, np.uint64(0xFFFF_FFFF_FFFF_FFFF), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


def _first(letters: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """The marked letters of each row moved to its front, in order."""
    return np.take_along_axis(letters, np.argsort(~marked, axis=1, kind="stable"), 1)


def _jaro_winkler_short(x: list[str], y: list[str]) -> np.ndarray:
    """``jaro_winkler`` of a batch of names of up to 64 letters: a name's free letters are the bits of one word."""
    nx, ny = (np.fromiter(map(len, t), np.int64, len(t)) for t in (x, y))
    ax, ay = _letters(x, nx), _letters(y, ny)
    window = np.maximum(nx, ny) // 2 - 1
    places = np.uint64(1) << np.arange(ay.shape[1], dtype=np.uint64)
    taken = np.zeros(len(x), np.uint64)
    matched = np.zeros(ax.shape, bool)
    for i in range(ax.shape[1]):
        equal = ((ay == ax[:, i : i + 1]) & (ax[:, i : i + 1] >= 0)) @ places
        inside = _low_bits(np.minimum(i + window + 1, ny)) & ~_low_bits(np.minimum(np.maximum(i - window, 0), 64))
        free = equal & inside & ~taken
        hit = free & (~free + np.uint64(1))
        taken |= hit
        matched[:, i] = hit != 0
    m = matched.sum(1)
    used = (taken[:, None] & places) != 0
    width = min(ax.shape[1], ay.shape[1])
    swaps = ((_first(ax, matched)[:, :width] != _first(ay, used)[:, :width]) & (np.arange(width) < m[:, None])).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (m / nx + m / ny + (m - swaps / 2) / m) / 3
    head = min(4, width)
    agree = ((ax[:, :head] == ay[:, :head]) & (ax[:, :head] >= 0)).sum(1)
    score = jaro + agree * 0.1 * (1 - jaro)
    return np.where((nx == 0) & (ny == 0), 1.0, np.where(m == 0, 0.0, score))


def jaro_winkler_batch(x: list[str], y: list[str]) -> np.ndarray:
    """``jaro_winkler`` of many pairs at once; pairs of like length go together, and names of over 64 letters one by one."""
    longest = np.maximum(np.fromiter(map(len, x), np.int64, len(x)), np.fromiter(map(len, y), np.int64, len(y)))
    out = np.empty(len(x))
    order = np.argsort(longest, kind="stable")
    short = order[: int((longest <= _LETTERS).sum())]
    for k in range(0, len(short), _CHUNK):
        part = short[k : k + _CHUNK]
        out[part] = _jaro_winkler_short([x[i] for i in part], [y[i] for i in part])
    for i in order[len(short) :]:
        out[i] = jaro_winkler(x[i], y[i])
    return out


@F.pandas_udf(DoubleType())
def _jaro_winkler(x: pd.Series, y: pd.Series) -> pd.Series:
    known = (x.notna() & y.notna()).to_numpy()
    out = np.full(len(x), np.nan)
    if known.any():
        out[known] = jaro_winkler_batch(x[known].tolist(), y[known].tolist())
    return pd.Series(out)  # what isn't a number is null


def with_name_score(pairs: DataFrame, left: str = "a_stem", right: str = "b_stem", out: str = "name_score") -> DataFrame:
    """``pairs`` plus C11 of two stems; equal stems need no comparison, others are compared where the pair is, without a shuffle."""
    same = F.when(F.col(left) == F.col(right), F.when(F.length(left) == 1, 0.0).otherwise(1.0))
    return pairs.withColumn(out, F.coalesce(same, _jaro_winkler(F.when(F.col(left) != F.col(right), F.col(left)), F.col(right))))
