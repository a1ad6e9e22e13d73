"""Scores and distance reports of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.functions import signals as s
from twinweave.functions.fingerprints import hamming, stem
from twinweave.plans.config import Thresholds, Weights
from twinweave.plans.session import spread

FIELDS = ("media_type", "file_name", "file_size", "checksum", "width", "height", "duration_sec", "capture_s", "dhash", "frames")


#: What scoring reads of a file, but for its media type.
MEASURED = ("file_size", "checksum", "width", "height", "duration_sec", "capture_s", "dhash", "frames", "stem")


def described(assets: DataFrame) -> DataFrame:
    """``assets`` with stems, and with frames of none if there are no frames."""
    if "frames" not in assets.columns:
        assets = assets.withColumn("frames", F.lit(None).cast("array<bigint>"))
    return assets.withColumn("stem", stem("file_name"))


def paired(pairs: DataFrame, assets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with both files' columns, prefixed a_ and b_, and their stems."""
    own = [*FIELDS, "stem"]
    cols = described(assets).select("id", *own)
    left = cols.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in own])
    right = cols.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in own])
    return spread(spread(pairs, "a").join(left, "a"), "b").join(right, "b")


def audio_matches() -> dict[str, Column]:
    """F3's four tests; null where a side is missing."""
    close = lambda c: F.abs(s.a(c) - s.b(c)) <= F.greatest(s.a(c), s.b(c)) * 0.01
    return {
        "checksum_match": s.a("checksum") == s.b("checksum"),
        "size_match": close("file_size"),
        "duration_match": close("duration_sec"),
        "capture_match": F.abs(s.a("capture_s") - s.b("capture_s")) < 60,
    }


#: Kinds of edges: compared pictures, videos and audio, equal checksums, policies.
PICTURE, VIDEO, AUDIO, EXACT, POLICY = range(5)
#: A signal's place: its key in pictures and videos, its key in audio.
PLACES = (("checksum", "checksum"), ("hash", "fileSize"), ("metadata", "duration"), ("name", "metadata"), ("captureTime", None))
#: The columns of a measured edge.
EDGE = ("a", "b", "kind", "score", "penalty", *[f"r{i}" for i in range(5)], *[f"f{i}" for i in range(5)], "distance", "delta")


def measured(rows: DataFrame, w: Weights = Weights(), t: Thresholds = Thresholds()) -> DataFrame:
    """F1-F3 in numbers: the pairs of ``rows`` (a, b and both files' columns) that score, as (media_type, ``EDGE``).

    Of each place of ``PLACES`` there are the raw value, null without a signal,
    and the factor that makes its contribution; distance and delta are what the
    notes of the hash and the capture time tell. Texts are made of them by
    ``explained``, so that a table of pairs holds none.
    """
    # what is read more than once becomes a column first. A row that is made as an array of one is a step of its own: the optimizer
    # doesn't put its expressions into later steps, where each use would make them again, and the JVM compiles it
    step = lambda df, keep, **made: df.select(*keep, F.inline_outer(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))
    video, audio = s.a("media_type") == "video", s.a("media_type") == "audio"
    test = lambda c: F.when(F.coalesce(c, F.lit(False)), F.lit(1.0))
    m = audio_matches()
    alone = lambda k: F.when(audio, test(~F.coalesce(m["checksum_match"], F.lit(False)) & m[k]))
    size, width, height = s.likeness_parts(video, t)
    own = [f"{x}_{c}" for c in ("media_type", "stem", "checksum", "file_size", "duration_sec", "capture_s") for x in "ab"]
    full = step(
        rows, ("a", "b", *own), distance=F.when(video, s.most_frame_distance()).when(~audio, s.image_distance()), delta=F.when(~audio, s.capture_delta()).cast("double"),
        size=size, width=width, height=height,
    )
    full = step(
        full, ("a", "b", s.a("media_type").alias("media_type"), "distance", "delta"), kind=F.when(video, VIDEO).when(audio, AUDIO).otherwise(PICTURE),
        a_stem=F.when(~audio, s.a("stem")), b_stem=F.when(~audio, s.b("stem")), same=F.when(audio, test(m["checksum_match"])).otherwise(s.same_checksum()),
        likeness=F.when(~audio, s.mean(F.col("size"), F.col("width"), F.col("height"))),
        size_match=alone("size_match"), duration_match=alone("duration_match"), capture_match=alone("capture_match"),
    )
    full = s.with_name_score(full)
    video, audio = F.col("kind") == VIDEO, F.col("kind") == AUDIO
    name, distance = F.col("name_score"), F.col("distance")
    hashed = F.when(video, s.video_hash_raw(t, distance)).when(audio, F.col("size_match")).otherwise(s.image_hash_raw(t, distance))
    full = step(
        full, ("a", "b", "media_type", "kind", "distance", "delta"), r0=F.col("same"), r1=hashed, r2=F.coalesce("likeness", "duration_match"),
        r3=F.when(audio, F.col("capture_match")).when(name > 0, name), r4=s.capture_raw(F.col("delta")),
    )
    seen, told = (w.checksum, w.hash, w.metadata, w.name, w.capture_time), (0.9, 0.3, 0.4, 0.2, None)
    raws = [F.col(f"r{i}") for i in range(len(PLACES))]
    factors = [F.when(audio, F.lit(y).cast("double")).otherwise(F.lit(x).cast("double")) for x, y in zip(seen, told, strict=True)]
    total = F.lit(0.0)
    for raw, factor in zip(raws, factors, strict=True):
        total = total + F.coalesce(factor * raw, F.lit(0.0))
    penalty = F.when(~audio & raws[1].isNull(), F.lit(-0.1)).otherwise(F.lit(0.0))
    full = full.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total + penalty)))
    enough = F.when(audio, F.col("score") >= 0.5 - 1e-9).otherwise(F.col("score") > 0)
    # one element or none, exploded: a filter over the score would be pushed down, and make the score again for each use
    full = full.select("*", F.explode_outer(F.when(enough, F.array(F.lit(True)))).alias("enough")).filter("enough is not null")
    places = [*[r.alias(f"r{i}") for i, r in enumerate(raws)], *[f.alias(f"f{i}") for i, f in enumerate(factors)]]
    return full.select("media_type", "a", "b", "kind", "score", penalty.alias("penalty"), *places, "distance", "delta")


def place_signals(kind: Column, raws: list[Column], adds: list[Column], distance: Column, delta: Column, w: Weights | None = None) -> list[Column]:
    """The signal of each place, null where its raw value is; with weights if these are given."""
    audio, video = kind == AUDIO, kind == VIDEO
    either = lambda seen, heard: seen if heard is None else F.when(audio, F.lit(heard)).otherwise(seen)
    notes = [
        either(F.when(raws[0] == 1, "checksum match").otherwise("checksum mismatch"), "exact_match"),
        either(F.concat(F.when(video, "max frame distance=").otherwise("dHash distance="), distance.cast("string")), "size_match"),
        either(F.when(video, "video metadata").otherwise("metadata similarity"), "duration_match"),
        either(F.lit("name similarity"), "metadata_match"),
        F.concat(F.lit("capture delta="), F.format_string("%.2f", delta), F.lit("s")),
    ]
    weights = [None] * 5 if w is None else [F.lit(w.checksum), either(F.lit(w.hash), 0.3), either(F.lit(w.metadata), 0.4), either(F.lit(w.name), w.metadata), F.lit(w.capture_time)]
    out = []
    for (seen, heard), weight, raw, add, note in zip(PLACES, weights, raws, adds, notes, strict=True):
        key = F.lit(seen) if seen == heard else either(F.lit(seen), heard)
        own = [] if weight is None else [weight.cast("double").alias("weight")]
        out.append(F.when(raw.isNotNull(), F.struct(key.alias("key"), *own, raw.alias("raw"), add.alias("contribution"), note.alias("note"))))
    return out


def explained(edges: DataFrame, w: Weights = Weights()) -> tuple[Column, Column]:
    """Signals and rationale (C29) of the compared pairs of ``measured``."""
    raws = [F.col(f"r{i}") for i in range(len(PLACES))]
    adds = [F.col(f"f{i}") * r for i, r in enumerate(raws)]
    audio = F.col("kind") == AUDIO
    found = place_signals(F.col("kind"), raws, adds, F.col("distance"), F.col("delta"), w)
    lines = [F.when(r.isNotNull(), _line(F.lit(seen) if heard in (None, seen) else F.when(audio, heard).otherwise(seen), add)) for (seen, heard), r, add in zip(PLACES, raws, adds, strict=True)]
    whole = lambda parts: F.filter(F.array(*parts), lambda x: x.isNotNull())
    return whole(found), whole(lines)


def scored(pairs: DataFrame, assets: DataFrame, w: Weights = Weights(), t: Thresholds = Thresholds()) -> DataFrame:
    """Edges (a, b, score, signals, penalties, rationale) of the pairs that score.

    Pairs are of one media type. Photos and videos need a score above 0, audio
    0.5 or more. A missing hash or signature costs 0.1.
    """
    edges = measured(paired(pairs, assets), w, t)
    signals, lines = explained(edges, w)
    return edges.select("a", "b", "media_type", "score", signals.alias("signals"), "penalty", lines.alias("rationale"))


def _line(key: Column, contribution: Column) -> Column:
    return F.concat(key, F.lit(":"), F.format_string("%.2f", contribution))


def rationale(signals: str | Column, fallback: Column) -> Column:
    """``key:contribution`` of each signal, or the fallback alone."""
    lines = F.transform(signals, lambda x: _line(x["key"], x["contribution"]))
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(fallback))


def label(score: str | Column, t: Thresholds = Thresholds()) -> Column:
    """C27."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c >= t.duplicate, "duplicate").when(c >= t.similar, "similar").otherwise("different")


def image_distance(pairs: DataFrame, assets: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """distance of two images' hashes with its reason."""
    p = paired(pairs, assets)
    d = hamming("a_dhash", "b_dhash")
    photos = (F.col("a_media_type") == "photo") & (F.col("b_media_type") == "photo")
    reason = F.when(~photos, "mediaTypeMismatch").when(d.isNull(), "missingHash").when(d <= t.image_distance, "withinThreshold").otherwise("beyondThreshold")
    return p.select("a", "b", F.when(photos, d).alias("distance"), reason.alias("reason"))


def video_distance(pairs: DataFrame, assets: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """mean and greatest distance over the frames that both videos have."""
    p = paired(pairs, assets).withColumn("d", s.frame_distances())
    n = F.size("d")
    return p.filter("a_media_type = 'video' and b_media_type = 'video'").select(
        "a",
        "b",
        F.when(F.col("d").isNotNull(), F.when(n > 0, F.aggregate("d", F.lit(0), lambda x, y: x + y) / n).otherwise(0.0)).alias("mean_distance"),
        F.when(F.col("d").isNotNull(), F.coalesce(F.array_max("d"), F.lit(0))).alias("max_distance"),
        F.when(F.col("d").isNotNull(), n).otherwise(0).alias("compared"),
        F.when(F.col("d").isNotNull(), F.size(F.filter("d", lambda x: x > t.frame_distance))).otherwise(0).alias("mismatched"),
    )


def compare_signatures(pairs: DataFrame, assets: DataFrame, frame_threshold: int = 5, mismatches: int = 1, seconds: float = 2.0, share: float = 0.02) -> DataFrame:
    """verdict over all frames of the longer signature; a frame that only one side has is a mismatch."""
    p = paired(pairs, assets).filter("a_frames is not null and b_frames is not null")
    d = F.zip_with("a_frames", "b_frames", lambda x, y: hamming(x, y))
    p = p.withColumn("d", d).withColumn("known", F.filter("d", lambda x: x.isNotNull()))
    bad = F.size(F.filter("d", lambda x: x.isNull() | (x > frame_threshold)))
    da, db = F.coalesce("a_duration_sec", F.lit(0.0)), F.coalesce("b_duration_sec", F.lit(0.0))
    most, delta = F.greatest(da, db), F.abs(da - db)
    inside = delta <= F.greatest(F.lit(seconds), most * share)
    verdict = (
        F.when(F.size("known") == 0, "insufficientData")
        .when(inside & (bad == 0), "duplicate")
        .when(inside & (bad <= mismatches), "similar")
        .when(inside, "different")
        .when(bad == 0, "similar")
        .otherwise("different")
    )
    mean = F.when(F.size("known") > 0, F.aggregate("known", F.lit(0), lambda x, y: x + y) / F.size("known"))
    return p.select("a", "b", verdict.alias("verdict"), delta.alias("duration_delta"), mean.alias("average_distance"), F.array_max("known").alias("max_distance"), bad.alias("mismatched"))


def confirmed_verdict(dhash_distance: Column, phash_distance: Column) -> Column:
    """dHash up to 3 is a duplicate; 4 to 6 needs pHash up to 8; to 10 is similar. Off unless asked for."""
    sure = (dhash_distance < 4) | (dhash_distance <= 6) & (phash_distance <= 8)
    return F.when(sure, "duplicate").when(dhash_distance <= 10, "similar").otherwise("different")
