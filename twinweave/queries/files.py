"""Queries of sections A and B: listings, the catalogue, signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave.functions.fingerprints import extension
from twinweave.operators import catalog
from twinweave.plans import views
from twinweave.plans.scratch import Scratch
from twinweave.plans.session import table
from twinweave.queries import query
from twinweave.sources import files as fs
from twinweave.sources import images
from twinweave.sources.keyed_store import KeyedStore
from twinweave.sources.layout import write_bucketed

A, FILES = views.ASSETS, views.FILES
_EXT = r"lower(regexp_extract({0}, '\.([^./]+)$', 1))"
_QUOTED = {k: ", ".join(f"'{e}'" for e in v) for k, v in fs.MEDIA.items()}
_KNOWN = ", ".join(_QUOTED.values())


@query("a02_media_types", f"WITH {A}, e AS (SELECT id, {_EXT.format('file_name')} AS ext FROM assets) SELECT id, CASE WHEN ext IN ({_QUOTED['photo']}) THEN 'photo' WHEN ext IN ({_QUOTED['video']}) THEN 'video' WHEN ext IN ({_QUOTED['audio']}) THEN 'audio' ELSE 'photo' END AS media_type FROM e")
def a02(spark, sf_dir):
    return views.assets(spark, sf_dir).select("id", fs.media_type(extension("file_name")).alias("media_type"))


_SNIFF = "CASE " + " ".join(f"WHEN starts_with(head, '{h}')" + (f" AND contains(head, '{m}')" if m else "") + f" THEN '{n}'" for n, _, h, m in fs.MAGIC) + " END"
_HEADS = "h AS (SELECT doc_id AS id, CASE CAST(doc_id % 8 AS INTEGER) " + " ".join(f"WHEN {i} THEN '{h}{'00000000' + m if m else ''}'" for i, (_, _, h, m) in enumerate(fs.MAGIC[::3])) + " ELSE '' END || upper(substr(md5(text), 1, 8)) AS head FROM documents)"


def _head():
    """First bytes of a made-up file: one of the known prefixes by the id, then bytes of the text's digest."""
    out = F.lit("")
    for i, (_, _, h, m) in enumerate(fs.MAGIC[::3]):
        out = F.when(F.col("doc_id") % 8 == i, h + ("00000000" + m if m else "")).otherwise(out)
    return F.concat(out, F.upper(F.substring(F.md5("text"), 1, 8)))


@query("a03_sniffed_formats", f"WITH {_HEADS} SELECT id, {_SNIFF} AS format FROM h")
def a03(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), fs.sniffed(_head()).alias("format"))


@query(
    "a04_inferred_formats",
    f"WITH {_HEADS}, {A} SELECT id, CASE WHEN e IN ({_KNOWN}) THEN CASE e WHEN 'jpg' THEN 'jpeg' WHEN 'tif' THEN 'tiff' WHEN 'heif' THEN 'heic' WHEN 'aif' THEN 'aiff' ELSE e END ELSE coalesce({_SNIFF}, 'unknown') END AS format FROM (SELECT id, head, {_EXT.format('file_name')} AS e FROM h JOIN assets USING (id))",
)
def a04(spark, sf_dir):
    heads = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _head().alias("head"))
    a = views.assets(spark, sf_dir).join(heads, "id")
    return a.select("id", fs.inferred_format(F.lit("public.data"), extension("file_name"), F.col("head")).alias("format"))


def _rule_sql(r: fs.Exclude) -> str:
    last = "regexp_extract(path, '[^/]*$')"
    return {
        "prefix": f"starts_with(path, '{r.text}')", "suffix": f"suffix(path, '{r.text}')", "contains": f"contains(path, '{r.text}')", "hidden": f"starts_with({last}, '.')",
        "bundle": rf"regexp_matches({last}, '\.(app|framework|bundle)$')", "cloud": "(" + " OR ".join(f"contains(lower(path), '{c}')" for c in fs.CLOUD) + ")",
    }[r.kind]


_EXCLUDED = " OR ".join(_rule_sql(r) for r in fs.DEFAULT_EXCLUDES)


@query("a05_excluded_paths", f"WITH {FILES} SELECT file_id, ({_EXCLUDED}) AS excluded FROM files")
def a05(spark, sf_dir):
    return views.files(spark, sf_dir).select("file_id", fs.excluded().alias("excluded"))


@query("a05_excluded_by_rule_table", f"WITH {FILES} SELECT file_id FROM files WHERE NOT EXISTS (SELECT 1 FROM nation WHERE contains(path, CAST(n_nationkey AS VARCHAR) || '#') OR starts_with(path, '/' || chr(97 + n_nationkey % 13)) OR suffix(path, substr(CAST(n_nationkey * 7 AS VARCHAR), 1, 2)))")
def a05b(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rule = lambda kind, text: n.select(F.lit(kind).alias("kind"), text.alias("text"))
    rules = rule("contains", F.concat(F.col("n_nationkey").cast("string"), F.lit("#"))).union(rule("prefix", F.concat(F.lit("/"), F.chr(97 + F.col("n_nationkey") % 13))))
    rules = rules.union(rule("suffix", F.substring((F.col("n_nationkey") * 7).cast("string"), 1, 2)))
    return fs.excluded_by_table(views.files(spark, sf_dir), rules).select("file_id")


@query("a06_managed_libraries", f"WITH {FILES} SELECT file_id, (" + " OR ".join(f"contains(lower(path), '{m}')" for m in fs.LIBRARIES) + ") AS managed FROM files")
def a06(spark, sf_dir):
    return views.files(spark, sf_dir).select("file_id", fs.in_library().alias("managed"))


_LISTING = "listing AS (SELECT 'f' || o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, 1600000000 + o_orderkey AS modified_s, o_orderkey AS k, o_orderstatus AS status FROM orders), catalog AS (SELECT path, size + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS size, modified_s, 1700000000 - k % 7 * 20000 AS last_scanned_s FROM listing WHERE status <> 'O')"


def _listing(spark, sf_dir):
    """Orders as a listing and as what a catalogue knew of it before."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.floor("o_totalprice").cast("long").alias("size"), (1_600_000_000 + F.col("o_orderkey")).alias("modified_s"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    known = o.filter("status <> 'O'").select("path", (F.col("size") + F.when(F.col("k") % 5 == 0, 1).otherwise(0)).alias("size"), "modified_s", (1_700_000_000 - F.col("k") % 7 * 20_000).alias("last_scanned_s"))
    return o.drop("k", "status"), known


_SKIP = f"WITH {_LISTING} SELECT l.path FROM listing l LEFT JOIN catalog c USING (path) WHERE NOT coalesce(l.modified_s <= c.modified_s AND l.size = c.size AND c.last_scanned_s >= 1700000000 - 86400, false)"


@query("a07_incremental_skip", _SKIP)
def a07(spark, sf_dir):
    listing, known = _listing(spark, sf_dir)
    return catalog.to_scan(listing, known, 1_700_000_000).select("path")


@query("a07_bucketed_skip", _SKIP)
def a07_bucketed(spark, sf_dir):
    """A7 over a catalogue that lies in buckets by path: only the listing is shuffled."""
    listing, known = _listing(spark, sf_dir)
    root = Scratch(spark, "catalogue").root
    return catalog.to_scan(listing, write_bucketed(known, f"catalogue_{root[-32:]}", "path", 8, f"{root}/rows"), 1_700_000_000).select("path")


_UPSERT = f"WITH {_LISTING} SELECT path, coalesce(l.size, c.size) AS size, CASE WHEN l.size IS NOT NULL THEN 1700000000 ELSE c.last_scanned_s END AS last_scanned_s, (c.size IS NOT NULL AND l.size IS NOT NULL AND (c.size <> l.size OR c.modified_s <> l.modified_s)) AS needs_refresh FROM listing l FULL JOIN catalog c USING (path)"


@query("a08_catalog_upsert", _UPSERT)
def a08(spark, sf_dir):
    listing, known = _listing(spark, sf_dir)
    return catalog.upsert(known, listing, 1_700_000_000).select("path", "size", "last_scanned_s", "needs_refresh")


CATALOG = "path string, size long, modified_s long, last_scanned_s long, needs_refresh boolean"


@query("a08_stored_upsert", _UPSERT)
def a08_stored(spark, sf_dir):
    """A8 on a keyed store: the scan is a commit of its own, and given twice it counts once."""
    listing, known = _listing(spark, sf_dir)
    store = KeyedStore(spark, Scratch(spark, "catalog").root, CATALOG, ["path"], 16)
    store.put(known.withColumn("needs_refresh", F.lit(False)), "scan", 0)
    for _ in range(2):
        store.change(listing, lambda before: catalog.upsert(before, listing, 1_700_000_000), "scan", 1)
    return store.read().select("path", "size", "last_scanned_s", "needs_refresh")


@query("a09_signature_upsert", "SELECT l_partkey AS file_id, max(l_orderkey) AS computed_at, arg_max(l_suppkey, (l_orderkey, l_linenumber)) AS hash FROM lineitem GROUP BY l_partkey")
def a09(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file_id"), F.struct("l_orderkey", "l_linenumber").alias("at"), F.col("l_suppkey").alias("hash"))
    return catalog.last_write_wins(rows, ["file_id"], "at").select("file_id", F.col("at.l_orderkey").alias("computed_at"), "hash")


_GROUPS = "SELECT doc_id // 5 AS group_id, doc_id AS id FROM documents WHERE doc_id // 5 NOT IN (SELECT doc_id // 5 FROM labels) UNION ALL SELECT doc_id // 5, doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)"


@query("a10_group_store", _GROUPS)
def a10(spark, sf_dir):
    group = F.expr("doc_id div 5").alias("group_id")
    store = table(spark, sf_dir, "documents").select(group, F.col("doc_id").alias("id"))
    return catalog.replace_groups(store, table(spark, sf_dir, "labels").select(group, F.col("doc_id").alias("id")), store)


@query("a10_stored_groups", _GROUPS)
def a10_stored(spark, sf_dir):
    """A10 on a keyed store: only buckets of the groups that are written again are replaced."""
    group = F.expr("doc_id div 5").alias("group_id")
    old = table(spark, sf_dir, "documents").select(group, F.col("doc_id").alias("id"))
    new = table(spark, sf_dir, "labels").select(group, F.col("doc_id").alias("id"))
    store = KeyedStore(spark, Scratch(spark, "groups").root, "group_id long, id long", ["group_id"], 16)
    store.put(old, "groups", 0)
    store.change(new, lambda before: catalog.replace_groups(before, new, old), "groups", 1)
    return store.read()


@query("a11_file_records", f"WITH {A} SELECT id, folder, file_name FROM assets WHERE media_type = 'photo'")
def a11(spark, sf_dir):
    return catalog.records(views.assets(spark, sf_dir), "photo").select("id", "folder", "file_name")


@query("a12_json_export", f"WITH {views.DECISIONS} SELECT group_id, '{{\"group_id\":' || group_id || ',\"accepted\":' || accepted || '}}' AS json FROM decisions")
def a12(spark, sf_dir):
    d = views.decisions(spark, sf_dir).select("group_id", "accepted")
    return fs.as_json(d).select(F.get_json_object("json", "$.group_id").cast("long").alias("group_id"), "json")


_OUTCOME = f"CASE WHEN {' OR '.join(f'''contains(lower(path), '{m}')''' for m in fs.LIBRARIES)} THEN 'error' WHEN {_EXCLUDED} THEN 'skipped' WHEN {_EXT.format('path')} IN ({_KNOWN}) OR ({_SNIFF}) IS NOT NULL THEN 'item' ELSE 'skipped' END"


@query("a13_scan_counters", f"WITH {FILES} SELECT count(*) AS total, count(*) FILTER (o = 'item') AS media, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'error') AS errors, count(*) / 10.0::DOUBLE AS files_per_s FROM (SELECT {_OUTCOME} AS o FROM files)")
def a13(spark, sf_dir):
    return fs.scan_counters(fs.scan(views.files(spark, sf_dir)), 10.0)


@query("a14_hard_links", "SELECT l_partkey AS inode, min('p' || l_orderkey) AS path, count(*) AS links FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY l_partkey UNION ALL SELECT NULL, 'p' || l_orderkey, 1 FROM lineitem WHERE l_partkey % 4 = 0")
def a14(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey")).alias("inode"), F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("path"))
    return catalog.hard_links(rows)


@query("b01_checksums", "SELECT doc_id AS id, sha256(text) AS checksum FROM documents")
def b01(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("checksum"))


def _pictures(spark, sf_dir):
    """Whole texts as pictures, 32 BGR pixels wide and 32 or more high; a text that ends inside a row begins again."""
    d = table(spark, sf_dir, "documents").filter("octet_length(text) > 0").withColumn("height", F.expr("cast(greatest(32, ceil(octet_length(text) / 96D)) as int)"))
    data = F.expr("substring(encode(repeat(text, cast(ceil(height * 96D / octet_length(text)) as int)), 'UTF-8'), 1, height * 96)")
    return d.select(F.col("doc_id").alias("id"), F.lit(32).alias("width"), "height", F.lit(3).alias("n_channels"), data.alias("data"))


@query("b02_b03_image_hashes")
def b02(spark, sf_dir):
    return images.image_hashes(_pictures(spark, sf_dir))


_BYTE = "CAST('0x' || substr(hx, 2 * ((3 * i + {0}) % n) + 1, 2) AS BIGINT)"


@query(
    "b02_picture_hashes",
    f"""WITH d AS (SELECT doc_id AS id, hex(encode(text)) AS hx, octet_length(encode(text)) AS n, greatest(32, CAST(ceil(octet_length(encode(text)) / 96.0::DOUBLE) AS BIGINT)) AS h FROM documents WHERE octet_length(encode(text)) > 0),
        px AS (SELECT id, h, i // 32 AS y, i % 32 AS x, 114 * {_BYTE.format(0)} + 587 * {_BYTE.format(1)} + 299 * {_BYTE.format(2)} AS g FROM (SELECT *, unnest(range(h * 32)) AS i FROM d)),
        cells AS (SELECT id, h, x, y, g, unnest(list_distinct([9 * x // 32, (9 * x + 8) // 32])) AS c FROM px),
        parts AS (SELECT *, unnest(list_distinct([8 * y // h, (8 * y + 7) // h])) AS r FROM cells),
        small AS (SELECT id, r, c, sum(g * (least(9 * x + 9, 32 * c + 32) - greatest(9 * x, 32 * c)) * (least(8 * y + 8, h * r + h) - greatest(8 * y, h * r))) AS v FROM parts GROUP BY id, r, c),
        bits AS (SELECT l.id, CASE WHEN l.v > m.v THEN CAST(1 AS HUGEINT) << CAST(63 - (8 * l.r + l.c) AS INTEGER) ELSE 0 END AS b FROM small l JOIN small m ON m.id = l.id AND m.r = l.r AND m.c = l.c + 1)
        SELECT id, CAST(CASE WHEN sum(b) >= CAST(1 AS HUGEINT) << 63 THEN sum(b) - (CAST(1 AS HUGEINT) << 64) ELSE sum(b) END AS BIGINT) AS dhash FROM bits GROUP BY id""",
)
def b02_pictures(spark, sf_dir):
    """B2 of whole texts as pictures of 32 by 32 pixels and more."""
    return images.image_hashes(_pictures(spark, sf_dir)).select("id", "dhash")


@query(
    "b02_grid_hash",
    "WITH g AS (SELECT vec_id AS id, embedding || embedding[1:8] AS v FROM embeddings), b AS (SELECT id, unnest(range(0, 64)) AS k, v FROM g) SELECT id, CAST(sum(CASE WHEN k > 0 AND v[(k // 8) * 9 + k % 8 + 1] > v[(k // 8) * 9 + k % 8 + 2] THEN CAST(1 AS HUGEINT) << CAST(63 - k AS INTEGER) ELSE 0 END) AS BIGINT) AS hash63 FROM b GROUP BY id",
)
def b02g(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.concat("embedding", F.slice("embedding", 1, 8)))
    return e.select(F.col("vec_id").alias("id"), images.grid_hash(F.col("v")).bitwiseAND(F.lit((1 << 63) - 1)).alias("hash63"))


_TIMES = """t AS (SELECT id, d, [x for x in list_sort([0.0::DOUBLE, CASE WHEN d >= 2 THEN d / 2 END, CASE WHEN d > 0 THEN greatest(d - 1, 0) END]) if x IS NOT NULL] AS r FROM (SELECT id, duration_sec AS d FROM assets WHERE duration_sec IS NOT NULL)),
k AS (SELECT id, d, list_distinct(CASE WHEN len(r) = 1 THEN r WHEN len(r) = 2 THEN CASE WHEN r[2] - r[1] < 0.05 THEN [r[1]] ELSE r END
  WHEN r[2] - r[1] < 0.05 THEN CASE WHEN r[3] - r[1] < 0.05 THEN [r[1]] ELSE [r[1], r[3]] END WHEN r[3] - r[2] < 0.05 THEN [r[1], r[2]] ELSE r END) AS u FROM t)"""


@query("b04_sample_times", f"WITH {A}, {_TIMES} SELECT id, len(u) + CASE WHEN len(u) = 1 AND d > 0 AND abs(u[1] - greatest(d - least(d, 0.1), 0)) > 0.05 THEN 1 ELSE 0 END AS n, round(list_sum(u) + CASE WHEN len(u) = 1 AND d > 0 AND abs(u[1] - greatest(d - least(d, 0.1), 0)) > 0.05 THEN greatest(d - least(d, 0.1), 0) ELSE 0 END, 6) AS total FROM k")
def b04(spark, sf_dir):
    a = views.assets(spark, sf_dir).filter("duration_sec is not null").withColumn("t", images.sample_times(F.col("duration_sec")))
    return a.select("id", F.size("t").cast("long").alias("n"), F.round(F.aggregate("t", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def videos_with_frames(spark, sf_dir):
    """Videos with signatures from frames, made from its text's hash, 21 over its length."""
    a = views.assets(spark, sf_dir)
    videos = a.filter("media_type = 'video'").select("id", "duration_sec")
    base = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), views.word_hash("text").alias("h"))
    frames = videos.join(base, "id").select("id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"), "h", "duration_sec")
    frames = frames.select("id", (F.col("k") * F.col("duration_sec") / 20).alias("t"), F.col("h").bitwiseXOR(F.expr("shiftleft(1L, cast((k * (1 + id % 2)) % 60 as int))")).alias("dhash"))
    return images.video_signatures(videos, frames)


#: Needs ``assets``; gives ``sigs`` (id, frames): of each sample time the nearest frame's hash.
FRAMES = f"""{_TIMES},
ats AS (SELECT id, d, CASE WHEN len(u) = 1 AND d > 0 AND abs(u[1] - f) > 0.05 THEN list_append(list_sort(u), f) ELSE list_sort(u) END AS ts FROM (SELECT *, greatest(d - least(d, 0.1::DOUBLE), 0) AS f FROM k)),
vf AS (SELECT a.id, k.k * a.duration_sec / 20 AS t, xor({views.WORD_HASH}, CAST(1 AS BIGINT) << CAST((k.k * (1 + a.id % 2)) % 60 AS INTEGER)) AS dhash FROM assets a JOIN documents ON doc_id = a.id, (SELECT unnest(range(0, 21)) AS k) k WHERE media_type = 'video'),
near AS (SELECT id, pos, arg_min(dhash, (abs(t - ts[pos]), t)) AS h FROM (SELECT id, ts, unnest(range(1, len(ts) + 1)) AS pos FROM ats) JOIN vf USING (id) GROUP BY id, pos),
sigs AS (SELECT id, list(h ORDER BY pos) AS frames FROM near GROUP BY id)"""


@query("b05_video_signatures", f"WITH {A}, {FRAMES} SELECT a.id, duration_sec, frames FROM assets a LEFT JOIN sigs USING (id) WHERE media_type = 'video'")
def b05(spark, sf_dir):
    return videos_with_frames(spark, sf_dir)


@query("b06_failure_statistics", f"WITH {A} SELECT count(*) AS attempted, count(*) FILTER (dhash IS NULL) AS failed, count(*) FILTER (dhash IS NULL) / count(*) AS failure_rate, count(*) FILTER (dhash IS NULL) / count(*) > 0.01 AS warn FROM assets WHERE media_type = 'photo'")
def b06(spark, sf_dir):
    return catalog.failure_stats(views.assets(spark, sf_dir).filter("media_type = 'photo'"), F.col("dhash").isNotNull())


@query("b07_signature_reuse", f"WITH {_LISTING} SELECT path FROM listing l WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.path = l.path AND c.size = l.size AND c.modified_s = l.modified_s)")
def b07(spark, sf_dir):
    listing, known = _listing(spark, sf_dir)
    return catalog.unsigned(listing, known).select("path")


@query("b08_b09_visual_differences")
def b08(spark, sf_dir):
    p = _pictures(spark, sf_dir)
    pairs = p.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return images.overall_difference(images.visual_differences(pairs, p))
