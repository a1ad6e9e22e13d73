"""Queries of section C: functions of single rows and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave.functions import fingerprints as fp
from twinweave.functions.signals import with_name_score
from twinweave.operators import keepers, metrics
from twinweave.plans import views
from twinweave.plans.session import spread, table
from twinweave.queries import query
from twinweave.sources import files as fs

A = views.ASSETS
_NEXT = "p AS (SELECT a.id AS a, b.id AS b, a.dhash AS x, b.dhash AS y FROM assets a JOIN assets b ON b.id = a.id + 1)"


def _neighbours(spark, sf_dir, *columns):
    """Rows of consecutive ids side by side."""
    a = views.assets(spark, sf_dir)
    left = a.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = a.select(F.col("id").alias("b"), (F.col("id") - 1).alias("a"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return left.join(right, "a")


@query("c01_hamming_distance", f"WITH {A}, {_NEXT} SELECT a, b, CAST(bit_count(xor(x, y)) AS INTEGER) AS distance FROM p WHERE x IS NOT NULL AND y IS NOT NULL")
def c01(spark, sf_dir):
    n = _neighbours(spark, sf_dir, "dhash")
    return n.select("a", "b", fp.hamming("a_dhash", "b_dhash").alias("distance")).filter("distance is not null")


@query("c02_match_confidence", f"WITH {A}, {_NEXT} SELECT a, greatest(0, 1 - bit_count(xor(x, y)) / 64.0::DOUBLE) AS confidence, bit_count(xor(x, y)) = 0 AS is_exact, bit_count(xor(x, y)) <= 5 AS is_near FROM p WHERE x IS NOT NULL AND y IS NOT NULL")
def c02(spark, sf_dir):
    d = c01(spark, sf_dir)
    return d.select("a", fp.match_confidence("distance").alias("confidence"), (F.col("distance") == 0).alias("is_exact"), (F.col("distance") <= 5).alias("is_near"))


_STEM = r"trim(replace(replace(replace(replace(translate(lower(regexp_replace({0}, '\.[^./]+$', '')), '_-', '  '), 'copy', ''), '(1)', ''), '(2)', ''), '(3)', ''), ' ')"
_BUCKET = r"CASE WHEN substr(regexp_replace({0}, '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g'), 1, 4) = '' THEN 'none' ELSE substr(regexp_replace({0}, '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g'), 1, 4) END"


@query("c03_c05_names", rf"WITH {A} SELECT id, lower(regexp_extract(file_name, '\.([^./]+)$', 1)) AS ext, {_STEM.format('file_name')} AS stem, {_BUCKET.format(_STEM.format('file_name'))} AS bucket FROM assets")
def c03(spark, sf_dir):
    a = views.assets(spark, sf_dir).withColumn("stem", fp.stem("file_name"))
    return a.select("id", fp.extension("file_name").alias("ext"), "stem", fp.stem_bucket("stem").alias("bucket"))


@query("c05_stem_bucket_of_names", rf"SELECT c_custkey AS id, {_BUCKET.format(_STEM.format('c_name'))} AS bucket FROM customer")
def c05(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), fp.stem_bucket(fp.stem("c_name")).alias("bucket"))


_SIZE = "CASE WHEN file_size > 0 THEN CAST(round(file_size / greatest(1.0::DOUBLE, file_size * 0.01::DOUBLE)) AS BIGINT) ELSE 0 END"
_DUR = "CASE WHEN coalesce(duration_sec, 0) > 0 THEN CAST(round(duration_sec / greatest(0.5::DOUBLE, duration_sec * {0}::DOUBLE)) AS BIGINT) ELSE 0 END"
_SNAP = "CASE WHEN {0} > 0 THEN CAST((({0} + 15) // 16) * 16 AS BIGINT) ELSE 0 END"
_TIER = "CASE WHEN width IS NULL OR height IS NULL THEN 'unknown' WHEN greatest(width, height) < 720 THEN 'sd' WHEN greatest(width, height) < 1080 THEN 'hd720' WHEN greatest(width, height) < 1440 THEN 'hd1080' WHEN greatest(width, height) < 2160 THEN 'quad' WHEN greatest(width, height) < 3000 THEN 'uhd' ELSE 'beyond' END"


@query(
    "c06_c09_bands",
    f"WITH {A} SELECT id, {_SNAP.format('width')} AS snapped_width, {_SNAP.format('height')} AS snapped_height, {_SIZE} AS size_band, {_DUR.format('0.02')} AS video_band, {_DUR.format('0.01')} AS audio_band, {_TIER} AS tier FROM assets",
)
def c06(spark, sf_dir):
    d = F.coalesce("duration_sec", F.lit(0.0))
    return views.assets(spark, sf_dir).select(
        "id", fp.snapped("width").alias("snapped_width"), fp.snapped("height").alias("snapped_height"), fp.size_bucket("file_size").alias("size_band"),
        fp.duration_bucket(d, 0.02).alias("video_band"), fp.duration_bucket(d, 0.01).alias("audio_band"), fp.resolution_tier("width", "height").alias("tier"),
    )


SIGNATURE = (
    f"CASE media_type WHEN 'photo' THEN 'img:' || {_SNAP.format('width')} || 'x' || {_SNAP.format('height')} || ':s' || {_SIZE} || ':n' || {_BUCKET.format(_STEM.format('file_name'))} "
    f"WHEN 'video' THEN 'vid:' || {_TIER} || ':d' || {_DUR.format('0.02')} || ':n' || {_BUCKET.format(_STEM.format('file_name'))} "
    f"ELSE 'aud:d' || {_DUR.format('0.01')} || ':s' || {_SIZE} || ':n' || {_BUCKET.format(_STEM.format('file_name'))} END"
)
STEM, STEM_BUCKET, SNAP, TIER = _STEM, _BUCKET, _SNAP, _TIER


@query("c10_signatures", f"WITH {A} SELECT id, {SIGNATURE} AS signature FROM assets")
def c10(spark, sf_dir):
    return views.assets(spark, sf_dir).select("id", fp.signature().alias("signature"))


#: Needs ``stems`` (x, y) and a recursive WITH; gives ``jw`` (x, y, name). One step a letter of x, which takes the first free equal letter of y.
JARO = """
jw_steps AS (
  SELECT x, y, CAST(0 AS BIGINT) AS i, greatest(length(x), length(y)) // 2 - 1 AS w, CAST([] AS BIGINT[]) AS taken, CAST([] AS VARCHAR[]) AS l FROM stems
  UNION ALL
  SELECT x, y, i + 1, w, CASE WHEN j IS NULL THEN taken ELSE list_append(taken, j) END, CASE WHEN j IS NULL THEN l ELSE list_append(l, substr(x, i + 1, 1)) END
  FROM (SELECT *, list_min([k for k in range(greatest(1, i + 1 - w), least(length(y), i + 1 + w) + 1) if NOT list_contains(taken, k) AND substr(y, k, 1) = substr(x, i + 1, 1)]) AS j FROM jw_steps WHERE i < length(x))),
jw_parts AS (
  SELECT x, y, CAST(len(l) AS DOUBLE) AS m, len([k for k in range(1, len(l) + 1) if l[k] <> substr(y, list_sort(taken)[k], 1)]) AS swaps,
         CAST(len([k for k in range(1, 5) if k <= length(x) AND k <= length(y) AND substr(x, k, 1) = substr(y, k, 1)]) AS DOUBLE) AS agree
  FROM jw_steps WHERE i = length(x)),
jw AS (SELECT x, y, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE jaro + agree * 0.1::DOUBLE * (1 - jaro) END AS name FROM (SELECT *, (m / length(x) + m / length(y) + (m - swaps / 2.0::DOUBLE) / m) / 3 AS jaro FROM jw_parts))"""
#: Name score of two stems, with ``jw`` joined.
NAME_SCORE = "CASE WHEN {0} = {1} THEN CASE WHEN length({0}) = 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE jw.name END"


@query(
    "c11_jaro_winkler",
    f"""WITH RECURSIVE p AS (SELECT p_partkey AS a, {_STEM.format('p_name')} AS stem FROM part), pairs AS (SELECT l.a, l.stem AS x, r.stem AS y FROM p l JOIN p r ON r.a = l.a + 1), stems AS (SELECT DISTINCT x, y FROM pairs WHERE x <> y), {JARO}
        SELECT a, round({NAME_SCORE.format('pairs.x', 'pairs.y')}, 6) AS score FROM pairs LEFT JOIN jw USING (x, y)""",
)
def c11(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), fp.stem("p_name").alias("a_stem"))
    pairs = p.join(p.select((F.col("a") - 1).alias("a"), F.col("a_stem").alias("b_stem")), "a")
    return with_name_score(spread(pairs, "a")).select("a", F.round("name_score", 6).alias("score"))


@query(
    "c12_c17_pair_signals",
    f"""WITH {A}, p AS (SELECT a.id AS a, a.checksum AS ca, b.checksum AS cb, a.capture_s AS ta, b.capture_s AS tb, CAST(a.file_size AS DOUBLE) AS sa, CAST(b.file_size AS DOUBLE) AS sb, CAST(a.width AS DOUBLE) AS wa, CAST(b.width AS DOUBLE) AS wb,
                       CAST(a.height AS DOUBLE) AS ha, CAST(b.height AS DOUBLE) AS hb, a.dhash AS x, b.dhash AS y FROM assets a JOIN assets b ON b.id = a.id + 1)
        SELECT a, CASE WHEN ca = cb THEN 1.0::DOUBLE ELSE 0.0 END AS checksum_raw,
               CASE WHEN abs(ta - tb) <= 2 THEN 1.0 WHEN abs(ta - tb) < 10 THEN 1 - abs(ta - tb) / 10.0::DOUBLE END AS capture_raw,
               round((CASE WHEN sa > 0 AND sb > 0 THEN 1 - abs(sa - sb) / greatest(sa, sb) ELSE 0 END + 1 - abs(wa - wb) / greatest(wa, wb) + 1 - abs(ha - hb) / greatest(ha, hb)) / CASE WHEN sa > 0 AND sb > 0 THEN 3 ELSE 2 END, 6) AS metadata_raw,
               greatest(0.0::DOUBLE, 1 - bit_count(xor(x, y)) / 5.0::DOUBLE) AS hash_raw FROM p""".replace("greatest(0.0::DOUBLE, 1 - bit_count(xor(x, y)) / 5.0::DOUBLE)", "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(0.0::DOUBLE, 1 - bit_count(xor(x, y)) / 5.0::DOUBLE) END"),
)
def c12(spark, sf_dir):
    from twinweave.functions import signals as s
    from twinweave.plans.config import Thresholds, Weights

    n = _neighbours(spark, sf_dir, "checksum", "capture_s", "file_size", "width", "height", "dhash")
    w, t = Weights(), Thresholds()
    return n.select(
        "a", s.checksum_signal(w)["raw"].alias("checksum_raw"), s.capture_signal(w)["raw"].alias("capture_raw"), F.round(s.image_metadata_signal(w)["raw"], 6).alias("metadata_raw"),
        s.image_hash_signal(w, t)["raw"].alias("hash_raw"),
    )


_FORMAT = "CASE WHEN regexp_matches(lower(ut_type), 'raw|cr2|nef|dng|arw') THEN 1.0::DOUBLE WHEN regexp_matches(lower(ut_type), 'png') THEN 0.9 WHEN regexp_matches(lower(ut_type), 'jpeg|jpg') THEN 0.7 WHEN regexp_matches(lower(ut_type), 'heic|heif') THEN 0.5 ELSE 0.0 END"
_COMPLETE = "(1 + CAST(capture_s IS NOT NULL AS INTEGER) + CAST(gps_lat IS NOT NULL AND gps_lon IS NOT NULL AS INTEGER) + CAST(camera_model IS NOT NULL AS INTEGER) + CAST(keywords IS NOT NULL AS INTEGER)) / 5.0::DOUBLE"


@query("c20_c21_keeper_scores", f"WITH {A} SELECT id, {_COMPLETE} AS completeness, {_FORMAT} AS format_score FROM assets")
def c20(spark, sf_dir):
    return views.assets(spark, sf_dir).select("id", keepers.completeness().alias("completeness"), keepers.format_score().alias("format_score"))


FORMAT, COMPLETE = _FORMAT, _COMPLETE


@query(
    "c22_normalised_metadata",
    f"WITH {A} SELECT id, coalesce(capture_s, created_s, modified_s) AS capture_s, CASE WHEN gps_lat IS NOT NULL AND gps_lon IS NOT NULL THEN round(gps_lat, 6) ELSE gps_lat END AS gps_lat, CASE WHEN gps_lat IS NOT NULL AND gps_lon IS NOT NULL THEN round(gps_lon, 6) ELSE gps_lon END AS gps_lon FROM assets",
)
def c22(spark, sf_dir):
    return fs.normalised_metadata(views.assets(spark, sf_dir)).select("id", "capture_s", "gps_lat", "gps_lon")


@query(
    "c23_exif_dates",
    "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') AS exif, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders",
)
def c23(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fs.format_exif_date(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("exif"))
    return o.withColumn("seconds", fs.parse_exif_date(F.col("exif")))


@query(
    "c24_keyword_lists",
    "SELECT p_partkey AS id, array_to_string(list_sort(list_distinct([trim(x) for x in string_split(replace(p_name, ' ', ', '), ',') if trim(x) <> ''])), '|') AS keywords FROM part",
)
def c24(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(fs.keyword_list(F.replace(F.col("p_name"), F.lit(" "), F.lit(", "))), "|").alias("keywords"))


@query("c25_snapshots", f"WITH {A} SELECT id, file_name, file_size, width, camera_model, array_to_string(keywords, '|') AS keywords FROM assets")
def c25(spark, sf_dir):
    back = fs.from_snapshot(fs.snapshot(views.assets(spark, sf_dir)))
    return back.select("id", "file_name", "file_size", "width", "camera_model", F.array_join("keywords", "|").alias("keywords"))


@query(
    "c26_size_categories",
    "SELECT o_orderkey AS id, CASE WHEN s < 1048576 THEN 'small' WHEN s < 10485760 THEN 'medium' WHEN s < 104857600 THEN 'large' ELSE 'xlarge' END AS category, CASE WHEN s < 1024 THEN 'tiny' WHEN s < 1048576 THEN 'small' WHEN s < 10485760 THEN 'medium' WHEN s < 104857600 THEN 'large' ELSE 'xlarge' END AS category5 FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 500 * (o_orderkey % 3) AS s FROM orders)",
)
def c26(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("s", F.floor("o_totalprice").cast("long") * 500 * (F.col("o_orderkey") % 3))
    return o.select(F.col("o_orderkey").alias("id"), fp.size_category("s").alias("category"), fp.size_category("s", with_tiny=True).alias("category5"))


@query("c27_confidence_labels", f"WITH {views.DECISIONS} SELECT group_id, CASE WHEN confidence >= 0.85 THEN 'duplicate' WHEN confidence >= 0.6 THEN 'similar' ELSE 'different' END AS label FROM decisions")
def c27(spark, sf_dir):
    from twinweave.operators.scoring import label

    return views.decisions(spark, sf_dir).select("group_id", label("confidence").alias("label"))


@query("c31_canonical_pairs", "SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem")
def c31(spark, sf_dir):
    low, high = fp.pair("l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", low.alias("a"), high.alias("b"))


@query(
    "c33_grades",
    "SELECT p_partkey AS id, CASE WHEN ms <= 2 AND e >= 10 THEN 'excellent' WHEN ms <= 5 AND e >= 5 THEN 'good' WHEN ms <= 10 AND e >= 2 THEN 'acceptable' ELSE 'needs_optimization' END AS grade FROM (SELECT p_partkey, p_size % 15 AS ms, p_retailprice % 12 AS e FROM part)",
)
def c33(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 15).alias("ms"), (F.col("p_retailprice") % 12).alias("e"))
    return p.select("id", metrics.grade("ms", "e").alias("grade"))


@query(
    "c34_fields_found",
    f"""WITH {A} SELECT id, CAST(CASE media_type WHEN 'photo' THEN 2 + CAST(capture_s IS NOT NULL AS INTEGER) + CAST(camera_model IS NOT NULL AS INTEGER) + CAST(gps_lat IS NOT NULL AS INTEGER) + CAST(gps_lon IS NOT NULL AS INTEGER) + CAST(keywords IS NOT NULL AS INTEGER)
        WHEN 'video' THEN 2 + CAST(duration_sec IS NOT NULL AS INTEGER) + CAST(keywords IS NOT NULL AS INTEGER) ELSE CAST(duration_sec IS NOT NULL AS INTEGER) + CAST(keywords IS NOT NULL AS INTEGER) END AS INTEGER) AS fields FROM assets""",
)
def c34(spark, sf_dir):
    a = views.assets(spark, sf_dir).alias("after")
    bare = views.assets(spark, sf_dir).select("id", *[F.lit(None).cast(t).alias(c) for c, t in views.assets(spark, sf_dir).dtypes if c != "id"]).alias("before")
    return bare.join(a, F.col("before.id") == F.col("after.id")).select(F.col("after.id").alias("id"), fs.fields_found("before", "after", F.col("after.media_type")).alias("fields"))
