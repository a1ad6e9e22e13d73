"""Views that feed the operators from the provided tables, and the same views as DuckDB text.

The provided tables hold no media files; these recipes give each document the
columns of a scanned file. Both engines compute them alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.plans.session import table

#: File extension by the last digit of the id.
EXTENSIONS = ("cr2", "jpg", "png", "jpg", "xmp", "heic", "mov", "mp4", "mp4", "mp3")


def word_hash(text: str) -> Column:
    """60 bits of the least and the greatest word of a text; edits elsewhere leave it as it is."""
    words = F.split(text, r"\s+")
    ends = F.concat(F.array_min(words), F.lit(" "), F.array_max(words))
    return F.conv(F.substring(F.md5(ends), 1, 15), 16, 10).cast("long")


WORD_HASH = r"CAST('0x' || substr(md5(list_min(regexp_split_to_array(text, '\s+')) || ' ' || list_max(regexp_split_to_array(text, '\s+'))), 1, 15) AS BIGINT)"


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: identity, file attributes, checksum, dimensions, duration, times, hashes, metadata."""
    digit = F.col("doc_id") % 10
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (digit + 1).cast("int"))
    head = word_hash("text")
    flip = F.when(F.col("doc_id") % 3 == 0, F.expr("shiftleft(1L, cast(doc_id % 60 as int))")).otherwise(F.lit(0).cast("long"))
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.when(digit < 6, "photo").when(digit < 9, "video").otherwise("audio").alias("media_type"),
        F.concat(F.lit("IMG_"), F.expr("doc_id div 4").cast("string"), F.when(digit == 3, "_copy").otherwise(""), F.lit("."), ext).alias("file_name"),
        F.concat(F.lit("/photos/"), "source", F.lit("/"), "lang").alias("folder"),
        F.col("n_chars").alias("file_size"),
        F.sha2("text", 256).alias("checksum"),
        (640 + 16 * (F.col("n_chars") % 40)).cast("int").alias("width"),
        (480 + 16 * (F.col("n_chars") % 30)).cast("int").alias("height"),
        F.when(digit >= 6, (F.col("n_chars") % 600) / 2.0).alias("duration_sec"),
        F.when(F.col("doc_id") % 7 != 0, (1_700_000_000 + F.col("doc_id") % 50).cast("long")).alias("capture_s"),
        F.when(F.col("doc_id") % 11 != 0, (1_600_000_000 + F.col("doc_id") % 1000).cast("long")).alias("created_s"),
        (1_650_000_000 + F.col("n_chars") % 1000).cast("long").alias("modified_s"),
        F.when((digit < 6) & (F.col("doc_id") % 13 != 0), head.bitwiseXOR(flip)).alias("dhash"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("cam-"), "source")).alias("camera_model"),
        F.when(F.col("doc_id") % 4 == 0, (F.col("n_chars") % 180) / 3.0 - 30).alias("gps_lat"),
        F.when(F.col("doc_id") % 4 == 0, (F.col("n_chars") % 360) / 7.0 - 20).alias("gps_lon"),
        F.when(F.col("doc_id") % 3 == 0, F.array("lang", "source")).alias("keywords"),
        ext.alias("ut_type"),
    )


ASSETS = f"""
assets AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 10 < 6 THEN 'photo' WHEN doc_id % 10 < 9 THEN 'video' ELSE 'audio' END AS media_type,
         'IMG_' || CAST(doc_id // 4 AS VARCHAR) || CASE WHEN doc_id % 10 = 3 THEN '_copy' ELSE '' END || '.' || e AS file_name,
         '/photos/' || source || '/' || lang AS folder, n_chars AS file_size, sha256(text) AS checksum,
         CAST(640 + 16 * (n_chars % 40) AS INTEGER) AS width, CAST(480 + 16 * (n_chars % 30) AS INTEGER) AS height,
         CASE WHEN doc_id % 10 >= 6 THEN CAST(n_chars % 600 AS DOUBLE) / 2 END AS duration_sec,
         CASE WHEN doc_id % 7 <> 0 THEN 1700000000 + doc_id % 50 END AS capture_s,
         CASE WHEN doc_id % 11 <> 0 THEN 1600000000 + doc_id % 1000 END AS created_s,
         1650000000 + n_chars % 1000 AS modified_s,
         CASE WHEN doc_id % 10 < 6 AND doc_id % 13 <> 0 THEN
           xor({WORD_HASH}, CASE WHEN doc_id % 3 = 0 THEN CAST(1 AS BIGINT) << CAST(doc_id % 60 AS INTEGER) ELSE 0 END) END AS dhash,
         CASE WHEN doc_id % 5 = 0 THEN 'cam-' || source END AS camera_model,
         CASE WHEN doc_id % 4 = 0 THEN CAST(n_chars % 180 AS DOUBLE) / 3 - 30 END AS gps_lat,
         CASE WHEN doc_id % 4 = 0 THEN CAST(n_chars % 360 AS DOUBLE) / 7 - 20 END AS gps_lon,
         CASE WHEN doc_id % 3 = 0 THEN [lang, source] END AS keywords, e AS ut_type
  FROM (SELECT *, ['cr2', 'jpg', 'png', 'jpg', 'xmp', 'heic', 'mov', 'mp4', 'mp4', 'mp3'][CAST(doc_id % 10 AS INTEGER) + 1] AS e FROM documents))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, size, head): pages as files; ``head`` is the first 16 bytes as hex."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("file_id"),
        F.regexp_replace("url", "^https?:/", "").alias("path"),
        F.length("html").cast("long").alias("size"),
        F.upper(F.hex(F.substring(F.encode("html", "UTF-8"), 1, 16))).alias("head"),
    )


FILES = r"""
files AS (
  SELECT page_id AS file_id, regexp_replace(url, '^https?:/', '') AS path, CAST(length(html) AS BIGINT) AS size, upper(substr(hex(encode(html)), 1, 32)) AS head FROM pages)"""


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scan events: session, kind, path, seconds."""
    e = table(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type") == "signup", "started")
        .when(F.col("event_type") == "view", "progress")
        .when(F.col("event_type") == "click", "item")
        .when(F.col("event_type") == "error", "error")
        .otherwise("finished")
    )
    return e.select(
        "event_id",
        F.col("user_id").alias("session_id"),
        kind.alias("kind"),
        F.concat(F.lit("/photos/f"), (F.col("event_id") % 97).cast("string")).alias("path"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "value",
    )


EVENTS = """
scan_events AS (
  SELECT event_id, user_id AS session_id,
         CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'item' WHEN 'error' THEN 'error' ELSE 'finished' END AS kind,
         '/photos/f' || CAST(event_id % 97 AS VARCHAR) AS path, ts, epoch_us(ts) AS us, value FROM events)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as merge transactions with their lines as removed files, in line order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("removed")
    )
    o = table(spark, sf_dir, "orders")
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("group_id"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("keeper_id"),
        F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"),
        seconds.alias("created_s"),
        F.when(F.col("o_orderstatus") == "F", seconds + 3600).alias("undone_s"),
        F.when(F.col("o_orderkey") % 50 == 0, "failed").otherwise("done").alias("status"),
        F.col("o_totalprice").alias("bytes_freed"),
    )


TRANSACTIONS = """
lines AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS removed FROM lineitem GROUP BY l_orderkey),
transactions AS (
  SELECT o_orderkey AS id, o_custkey AS group_id, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS keeper_id, coalesce(removed, []) AS removed,
         CAST(epoch(o_orderdate) AS BIGINT) AS created_s, CASE WHEN o_orderstatus = 'F' THEN CAST(epoch(o_orderdate) AS BIGINT) + 3600 END AS undone_s,
         CASE WHEN o_orderkey % 50 = 0 THEN 'failed' ELSE 'done' END AS status, o_totalprice AS bytes_freed
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as users' decisions on groups, with a confidence."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("group_id"), (F.col("quality") == 1).alias("accepted"), ((F.col("doc_id") * 37 % 100) / 100.0).alias("confidence"), F.col("doc_id").alias("ts")
    )


DECISIONS = """
decisions AS (SELECT doc_id AS group_id, quality = 1 AS accepted, CAST(doc_id * 37 % 100 AS DOUBLE) / 100 AS confidence, doc_id AS ts FROM labels)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as metric samples: operation, duration, items, memory, cpu, hit rate, seconds."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("op-"), "l_returnflag", F.lit("-"), "l_linestatus").alias("operation"),
        (F.col("l_extendedprice") / 100).alias("duration_ms"),
        F.col("l_quantity").cast("long").alias("items"),
        (F.col("l_extendedprice") / 50).alias("memory_mb"),
        (F.col("l_discount") * 1000).alias("cpu"),
        (1 - F.col("l_tax") * 10).alias("hit_rate"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("ts"),
        F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("sample_id"),
    )


SAMPLES = """
samples AS (
  SELECT 'op-' || l_returnflag || '-' || l_linestatus AS operation, l_extendedprice / 100 AS duration_ms, CAST(l_quantity AS BIGINT) AS items, l_extendedprice / 50 AS memory_mb,
         l_discount * 1000 AS cpu, 1 - l_tax * 10 AS hit_rate, CAST(epoch(l_shipdate) AS BIGINT) AS ts, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS sample_id FROM lineitem)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
