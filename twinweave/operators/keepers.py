"""Choice of the file to keep in each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score of the first entry that the type's name contains (fixed values).
FORMAT_SCORES = ((("raw", "cr2", "nef", "dng", "arw"), 1.0), (("png",), 0.9), (("jpeg", "jpg"), 0.7), (("heic", "heif"), 0.5))


def format_score(kind: str = "ut_type") -> Column:
    c = None
    for names, score in FORMAT_SCORES:
        test = F.lower(F.col(kind)).rlike("|".join(names))
        c = F.when(test, score) if c is None else c.when(test, score)
    return c.otherwise(0.0)


def completeness() -> Column:
    """C20: share of five parts that a file's metadata has."""
    has = lambda c: c.cast("int")
    gps = F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()
    return (1 + has(F.col("capture_s").isNotNull()) + has(gps) + has(F.col("camera_model").isNotNull()) + has(F.col("keywords").isNotNull())) / 5.0


def _pixels() -> Column:
    return F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0))


def orders() -> dict[str, list[Column]]:
    """Sort keys of each preset; nulls last, the id at the end so that the choice is one."""
    pixels, size, name, i = _pixels().desc(), F.col("file_size").desc(), F.col("file_name"), F.col("id").asc()
    first = lambda c: F.col(c).asc_nulls_last()
    last = lambda c: F.col(c).desc_nulls_last()
    rank = F.when(F.col("media_type") == "photo", 0).when(F.col("media_type") == "video", 1).otherwise(2)
    audio = F.col("media_type") == "audio"
    return {
        "engine": [rank.asc(), F.when(~audio, _pixels()).desc_nulls_last(), size, F.when(audio, F.col("duration_sec")).desc_nulls_last(), first("created_s"), name.asc(), i],
        "intelligent": [pixels, size, format_score().desc(), completeness().desc(), first("capture_s"), name.asc(), i],
        "highest_resolution": [pixels, size, i],
        "largest_file": [size, pixels, i],
        "keep_latest": [last("modified_s"), last("created_s"), last("capture_s"), name.desc(), i],
        "keep_earliest": [first("created_s"), first("capture_s"), first("modified_s"), name.asc(), i],
        "best_metadata": [completeness().desc(), pixels, i],
        "best_format": [format_score().desc(), pixels, i],
    }


def keepers(members: DataFrame, preset: str = "engine", group: str = "group_id") -> DataFrame:
    """(group, keeper_id): the first member in the preset's order; ``custom`` leaves the choice open (null)."""
    if preset == "custom":
        return members.groupBy(group).agg(F.lit(None).cast(members.schema["id"].dataType).alias("keeper_id"))
    best = F.row_number().over(Window.partitionBy(group).orderBy(*orders()[preset]))
    return members.withColumn("__r", best).filter("__r = 1").select(group, F.col("id").alias("keeper_id"))
