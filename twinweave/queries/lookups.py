"""Queries of sections D, E and H on lookups, joins and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave.functions.fingerprints import pair, signature
from twinweave.operators import catalog, keepers, metrics, pairs
from twinweave.plans import views
from twinweave.plans.scratch import Scratch
from twinweave.plans.session import table
from twinweave.queries import query
from twinweave.queries.scalars import COMPLETE, FORMAT, SIGNATURE, SNAP, STEM, STEM_BUCKET, TIER
from twinweave.sources.layout import Ranges

A = views.ASSETS


@query("d01_by_file_size", f"WITH {A} SELECT id, file_size FROM assets WHERE file_size BETWEEN 500 AND 3000 AND media_type = 'photo' ORDER BY id LIMIT 500")
def d01(spark, sf_dir):
    return catalog.by_range(views.assets(spark, sf_dir), "file_size", 500, 3000, "photo").select("id", "file_size")


@query("d01_ranged_lookup", f"WITH {A} SELECT id, media_type, file_size FROM assets WHERE file_size BETWEEN 500 AND 3000")
def d01_ranged(spark, sf_dir):
    """D1 over files that lie by ranges of size: all rows of the range, from the folders that it meets."""
    a = views.assets(spark, sf_dir).select("id", "media_type", "file_size")
    laid = Ranges(spark, Scratch(spark, "ranges").root, "file_size", a.schema)
    laid.write(a, 16)
    return laid.read(500, 3000)


@query("d02_by_dimensions", f"WITH {A} SELECT id FROM (SELECT * FROM assets WHERE width = 800 ORDER BY id LIMIT 500) WHERE media_type = 'photo'")
def d02(spark, sf_dir):
    return catalog.by_dimensions(views.assets(spark, sf_dir), 800, None, "photo").select("id")


@query("d03_by_capture_time", f"WITH {A} SELECT id, capture_s FROM assets WHERE capture_s >= 1700000010 AND media_type = 'photo' ORDER BY id LIMIT 500")
def d03(spark, sf_dir):
    return catalog.by_range(views.assets(spark, sf_dir), "capture_s", 1_700_000_010, None, "photo").select("id", "capture_s")


@query("d04_videos_by_duration", f"WITH {A} SELECT id, duration_sec FROM assets WHERE duration_sec <= 60 AND media_type = 'video' ORDER BY id LIMIT 500")
def d04(spark, sf_dir):
    return catalog.by_range(views.assets(spark, sf_dir), "duration_sec", None, 60.0, "video").select("id", "duration_sec")


@query("d05_scopes", f"WITH {A} SELECT id, 'ids' AS scope FROM assets WHERE id IN (SELECT doc_id FROM labels) UNION ALL SELECT id, 'folder' FROM assets WHERE starts_with(folder, '/photos/src1') UNION ALL SELECT id, 'bucket' FROM assets WHERE ({SIGNATURE}) = 'aud:d100:s100:nimg1'")
def d05(spark, sf_dir):
    a = views.assets(spark, sf_dir).withColumn("bucket", signature())
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    named = lambda df, n: df.select("id", F.lit(n).alias("scope"))
    return named(catalog.in_scope(a, ids), "ids").union(named(catalog.in_scope(a, folder="/photos/src1"), "folder")).union(named(catalog.in_scope(a, bucket="aud:d100:s100:nimg1"), "bucket"))


@query("d06_ignored_pairs", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE least(o_custkey, o_orderkey) = least(l_partkey, l_suppkey) AND greatest(o_custkey, o_orderkey) = greatest(l_partkey, l_suppkey))")
def d06(spark, sf_dir):
    low, high = pair("l_partkey", "l_suppkey")
    found = table(spark, sf_dir, "lineitem").select(low.alias("a"), high.alias("b")).distinct()
    return pairs.without_pairs(found, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b")))


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"), F.concat(F.lit("cat-"), (F.col("user_id") % 5).cast("string")).alias("category"), F.concat(F.lit("User "), "event_type").alias("message"))


_LOG = "log AS (SELECT event_id, epoch_us(ts) AS ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, 'cat-' || CAST(user_id % 5 AS VARCHAR) AS category, 'User ' || event_type AS message FROM events)"


@query("d08_log_filter", f"WITH {_LOG} SELECT event_id, level FROM log WHERE ts >= 1700000000000000 AND level IN ('info') AND (contains(lower(message), 'click') OR contains(lower(category), 'click'))")
def d08(spark, sf_dir):
    return catalog.logs(_log(spark, sf_dir), low=1_700_000_000_000_000, levels=["info"], text="CLICK").select("event_id", "level")


@query("d08_log_categories", f"WITH {_LOG} SELECT DISTINCT category FROM log")
def d08b(spark, sf_dir):
    return _log(spark, sf_dir).select("category").distinct()


@query("g15_log_counts", f"WITH {_LOG} SELECT level, NULL AS category, count(*) AS n FROM log GROUP BY level UNION ALL SELECT NULL, category, count(*) FROM log GROUP BY category")
def g15(spark, sf_dir):
    return metrics.log_counts(_log(spark, sf_dir))


@query("d09_operations", f"WITH {views.TRANSACTIONS} SELECT id, bytes_freed FROM transactions WHERE created_s >= (SELECT max(created_s) FROM transactions) - 2592000 AND status = 'done'")
def d09(spark, sf_dir):
    t = views.transactions(spark, sf_dir)
    return catalog.operations(t, t.agg(F.max("created_s")).first()[0] or 0, "30d", "done", "largest").select("id", "bytes_freed")


@query("d10_ignored_groups", "SELECT doc_id AS group_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def d10(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("group_id"))
    return catalog.without_keys(groups, table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("group_id")), "group_id")


@query("d11_interrupted_sessions", "SELECT user_id AS user, max(event_id) AS session_id FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id")
def d11(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("session_id"), F.col("event_id").alias("started_s"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "cancelled").otherwise("done").alias("phase"))
    return catalog.interrupted(e).select("user", "session_id")


@query("e01_exact_duplicates", f"WITH {A} SELECT m.a, x.id AS b, m.n AS group_size FROM assets x JOIN (SELECT checksum, file_size, min(id) AS a, count(*) AS n FROM assets WHERE file_size > 0 GROUP BY checksum, file_size HAVING count(*) > 1) m USING (checksum, file_size) WHERE x.id <> m.a")
def e01(spark, sf_dir):
    return pairs.exact_edges(views.assets(spark, sf_dir))


BUCKETS = f"""
s AS (SELECT id, media_type, file_name, created_s, {SIGNATURE} AS bucket FROM assets),
n AS (SELECT media_type, bucket, count(*) AS n FROM s GROUP BY ALL),
placed AS (SELECT s.*, row_number() OVER (PARTITION BY media_type, bucket ORDER BY file_name, created_s NULLS LAST, id) AS pos FROM s JOIN n USING (media_type, bucket) WHERE n.n BETWEEN 2 AND 256),
ranked AS (SELECT x.media_type, x.bucket, least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, x.pos AS px, y.pos AS py FROM placed x JOIN placed y ON x.media_type = y.media_type AND x.bucket = y.bucket AND x.pos < y.pos),
blocked AS (SELECT media_type, bucket, a, b FROM (SELECT *, row_number() OVER (PARTITION BY media_type, bucket ORDER BY px, py) AS r FROM ranked) WHERE r <= 10000)"""


@query("e02_h10_blocked_pairs", f"WITH {A}, {BUCKETS} SELECT * FROM blocked")
def e02(spark, sf_dir):
    return pairs.blocked_pairs(views.assets(spark, sf_dir))


_NEAR = "(({0} > 0) = ({1} > 0) AND abs(greatest({0}, 0) - greatest({1}, 0)) <= greatest({2}::DOUBLE, greatest({0}, {1}) * {3}::DOUBLE))"


@query(
    "e02_log_banded_pairs",
    f"""WITH {A}, s AS (SELECT id, media_type, CAST(file_size AS DOUBLE) AS size, coalesce(duration_sec, 0) AS dur,
         {STEM_BUCKET.format(STEM.format('file_name'))} || CASE media_type WHEN 'photo' THEN {SNAP.format('width')} || 'x' || {SNAP.format('height')} WHEN 'video' THEN {TIER} ELSE '' END AS fixed FROM assets)
        SELECT x.media_type, x.id AS a, y.id AS b FROM s x JOIN s y ON x.media_type = y.media_type AND x.fixed = y.fixed AND x.id < y.id
        WHERE (x.media_type = 'video' OR {_NEAR.format('x.size', 'y.size', '1.0', '0.01')}) AND (x.media_type = 'photo' OR CASE WHEN x.media_type = 'video' THEN {_NEAR.format('x.dur', 'y.dur', '0.5', '0.02')} ELSE {_NEAR.format('x.dur', 'y.dur', '0.5', '0.01')} END)""",
)
def e02_log(spark, sf_dir):
    """Q1: bands that tell sizes and durations apart, met across their edges."""
    return pairs.banded_pairs(views.assets(spark, sf_dir))


@query("e03_hamming_pairs", f"WITH {A}, v AS (SELECT DISTINCT dhash FROM assets WHERE dhash IS NOT NULL) SELECT x.dhash AS hash_a, y.dhash AS hash_b, CAST(bit_count(xor(x.dhash, y.dhash)) AS INTEGER) AS distance FROM v x JOIN v y ON x.dhash < y.dhash WHERE bit_count(xor(x.dhash, y.dhash)) <= 5")
def e03(spark, sf_dir):
    return pairs.hamming_pairs(views.assets(spark, sf_dir).select(F.col("dhash").alias("hash")))


@query("e04_e05_hash_lookups", f"WITH {A}, h AS (SELECT id, dhash FROM assets WHERE dhash IS NOT NULL) SELECT p.id AS probe_id, f.id AS file_id, CAST(bit_count(xor(p.dhash, f.dhash)) AS INTEGER) AS distance, 1 - bit_count(xor(p.dhash, f.dhash)) / 64.0::DOUBLE AS confidence, p.dhash = f.dhash AS is_exact, true AS is_near FROM h p JOIN h f ON p.id <> f.id WHERE p.id % 20 = 0 AND bit_count(xor(p.dhash, f.dhash)) <= 5")
def e04(spark, sf_dir):
    h = Scratch(spark, "hashes").stash(views.assets(spark, sf_dir).select("id", F.col("dhash").alias("hash")), "hashes")
    return pairs.within_distance(h, h.filter("id % 20 = 0")).drop("rank")


_TWO_HASHES = """h AS (SELECT id, 'dHash' AS algorithm, dhash AS hash FROM assets WHERE dhash IS NOT NULL UNION ALL SELECT id, 'pHash', xor(dhash, CAST(file_size % 4 AS BIGINT)) FROM assets WHERE dhash IS NOT NULL AND id % 3 <> 1)"""


def _two_hashes(spark, sf_dir):
    """Hashes of two algorithms: (id, algorithm, hash)."""
    a = views.assets(spark, sf_dir).filter("dhash is not null").select("id", "dhash", "file_size")
    second = a.filter("id % 3 <> 1").select("id", F.lit("pHash").alias("algorithm"), F.col("dhash").bitwiseXOR((F.col("file_size") % 4).cast("long")).alias("hash"))
    return Scratch(spark, "hashes").stash(a.select("id", F.lit("dHash").alias("algorithm"), F.col("dhash").alias("hash")).union(second), "hashes")


@query("e03_pairs_by_algorithm", f"WITH {A}, {_TWO_HASHES}, v AS (SELECT DISTINCT algorithm, hash FROM h) SELECT x.algorithm, x.hash AS hash_a, y.hash AS hash_b, CAST(bit_count(xor(x.hash, y.hash)) AS INTEGER) AS distance FROM v x JOIN v y ON x.algorithm = y.algorithm AND x.hash < y.hash WHERE bit_count(xor(x.hash, y.hash)) <= 5")
def e03_algorithms(spark, sf_dir):
    return pairs.hamming_pairs(_two_hashes(spark, sf_dir))


@query("e03_e05_ranked_lookups", f"WITH {A}, {_TWO_HASHES}, f AS (SELECT p.algorithm, p.id AS probe_id, f.id AS file_id, CAST(bit_count(xor(p.hash, f.hash)) AS INTEGER) AS distance FROM h p JOIN h f ON p.algorithm = f.algorithm AND p.id <> f.id WHERE p.id % 20 = 0 AND bit_count(xor(p.hash, f.hash)) <= 5) SELECT *, CAST(row_number() OVER (PARTITION BY probe_id, algorithm ORDER BY distance, file_id) AS INTEGER) AS rank FROM f")
def e03_ranked(spark, sf_dir):
    h = _two_hashes(spark, sf_dir)
    return pairs.within_distance(h, h.filter("id % 20 = 0")).select("algorithm", "probe_id", "file_id", "distance", "rank")


@query(
    "e06_e09_policy_pairs",
    f"""WITH {A}, k AS (SELECT id, {STEM.format('file_name')} AS stem, e FROM (SELECT *, ut_type AS e FROM assets))
        SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, p.policy, p.contribution FROM (VALUES ('policy.raw-jpeg', 0.05::DOUBLE), ('policy.live-photo', 0.03), ('policy.sidecar', 0.02)) p(policy, contribution)
        JOIN k x ON true JOIN k y ON x.stem = y.stem WHERE (policy = 'policy.raw-jpeg' AND x.e = 'cr2' AND y.e = 'jpg') OR (policy = 'policy.live-photo' AND x.e = 'heic' AND y.e IN ('mov', 'mp4')) OR (policy = 'policy.sidecar' AND x.e = 'xmp' AND y.e <> 'xmp')""",
)
def e06(spark, sf_dir):
    return pairs.policy_edges(views.assets(spark, sf_dir)).withColumn("contribution", F.round("contribution", 6))


@query(
    "e10_e11_index_candidates",
    f"""WITH {A}, c AS (SELECT id, media_type, file_size, CASE WHEN file_size * 2000 < 1048576 THEN 1 WHEN file_size * 2000 < 10485760 THEN 2 WHEN file_size * 2000 < 104857600 THEN 3 ELSE 4 END AS level FROM assets)
        SELECT id, candidate_id, candidate_size, rank FROM (SELECT q.id, x.id AS candidate_id, x.file_size * 2000 AS candidate_size, row_number() OVER (PARTITION BY q.id ORDER BY x.file_size DESC, x.id) AS rank FROM c q JOIN c x ON q.media_type = x.media_type AND abs(q.level - x.level) <= 1 AND q.id <> x.id) WHERE rank <= 10""",
)
def e10(spark, sf_dir):
    a = views.assets(spark, sf_dir).withColumn("file_size", F.col("file_size") * 2000)
    return pairs.index_candidates(a, a).withColumn("rank", F.col("rank").cast("long"))


@query("e13_group_read", f"WITH {A} SELECT id % 50 AS group_id, id, file_name, file_size FROM assets JOIN labels ON doc_id = id")
def e13(spark, sf_dir):
    members = table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("group_id"), F.col("doc_id").alias("id"))
    return catalog.group_files(members, views.assets(spark, sf_dir)).select("group_id", "id", "file_name", "file_size")


@query("e15_key_tests", "SELECT doc_id AS id, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents")
def e15(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return catalog.with_keys(d, k, "id").withColumn("known", F.lit(True)).union(catalog.without_keys(d, k, "id").withColumn("known", F.lit(False)))


_PX = "CAST(width AS BIGINT) * height DESC"
_ORDERS = {
    "engine": f"CASE media_type WHEN 'photo' THEN 0 WHEN 'video' THEN 1 ELSE 2 END, CASE WHEN media_type <> 'audio' THEN CAST(width AS BIGINT) * height END DESC NULLS LAST, file_size DESC, CASE WHEN media_type = 'audio' THEN duration_sec END DESC NULLS LAST, created_s NULLS LAST, file_name, id",
    "intelligent": f"{_PX}, file_size DESC, {FORMAT} DESC, {COMPLETE} DESC, capture_s NULLS LAST, file_name, id",
    "highest_resolution": f"{_PX}, file_size DESC, id",
    "largest_file": f"file_size DESC, {_PX}, id",
    "keep_latest": "modified_s DESC NULLS LAST, created_s DESC NULLS LAST, capture_s DESC NULLS LAST, file_name DESC, id",
    "keep_earliest": "created_s NULLS LAST, capture_s NULLS LAST, modified_s NULLS LAST, file_name, id",
    "best_metadata": f"{COMPLETE} DESC, {_PX}, id",
    "best_format": f"{FORMAT} DESC, {_PX}, id",
}


def _keeper_query(number: str, preset: str, sql: str) -> None:
    @query(f"h{number}_keeper_{preset}", sql)
    def keeper(spark, sf_dir, preset=preset):
        return keepers.keepers(views.assets(spark, sf_dir).withColumn("group_id", F.expr("id div 7")), preset)


for _i, (_preset, _order) in enumerate(_ORDERS.items(), 1):
    _keeper_query(f"{_i:02d}", _preset, f"WITH {A} SELECT id // 7 AS group_id, first(id ORDER BY {_order}) AS keeper_id FROM assets GROUP BY id // 7")
_keeper_query("09", "custom", f"WITH {A} SELECT id // 7 AS group_id, CAST(NULL AS BIGINT) AS keeper_id FROM assets GROUP BY id // 7")


@query("h11_top_groups_by_space", f"WITH {A} SELECT checksum, count(*) AS n, CAST(sum(file_size) - max(file_size) AS BIGINT) AS space FROM assets GROUP BY checksum HAVING count(*) > 1 ORDER BY space DESC, checksum LIMIT 5")
def h11(spark, sf_dir):
    g = views.assets(spark, sf_dir).groupBy("checksum").agg(F.count(F.lit(1)).alias("n"), (F.sum("file_size") - F.max("file_size")).alias("space")).filter("n > 1")
    return catalog.top_n(g, [F.desc("space"), "checksum"], 5)


@query("h12_slowest_operations", f"WITH {views.SAMPLES} SELECT sample_id, duration_ms FROM samples WHERE duration_ms > 500 ORDER BY duration_ms DESC, sample_id LIMIT 20")
def h12(spark, sf_dir):
    return catalog.top_n(views.samples(spark, sf_dir).filter("duration_ms > 500"), [F.desc("duration_ms"), "sample_id"], 20).select("sample_id", "duration_ms")


@query("h16_h17_hot_items", f"WITH {views.EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us DESC, event_id DESC) AS r FROM scan_events), h AS (SELECT session_id, path, count(*) AS n, min(r) AS r FROM r WHERE r <= 10 GROUP BY ALL HAVING count(*) >= 2) SELECT session_id, path, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY r) AS rank FROM h) WHERE rank <= 5")
def h16(spark, sf_dir):
    return metrics.hot_items(views.scan_events(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("i03_shared_algorithms", f"WITH {A} SELECT a.id, CAST((a.dhash IS NOT NULL AND b.dhash IS NOT NULL) AS INTEGER) AS shared FROM assets a JOIN assets b ON b.id = a.id + 1")
def i03(spark, sf_dir):
    a = views.assets(spark, sf_dir).select("id", F.map_filter(F.create_map(F.lit("dHash"), F.col("dhash")), lambda k, v: v.isNotNull()).alias("hashes"))
    b = a.select((F.col("id") - 1).alias("id"), F.col("hashes").alias("other"))
    return a.join(b, "id").select("id", F.size(pairs.shared_algorithms("hashes", "other")).alias("shared"))


@query("i05_unscanned", "SELECT doc_id AS id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def i05(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).exceptAll(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))
