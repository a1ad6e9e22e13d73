"""Queries of sections F and G1-G11: scoring, grouping and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinweave.operators import groups, keepers, pairs, scoring
from twinweave.operators.components import connected_components
from twinweave.operators.upkeep import KeptComponents
from twinweave.plans import views
from twinweave.plans.scratch import Scratch
from twinweave.queries import query
from twinweave.queries.files import FRAMES, videos_with_frames
from twinweave.queries.lookups import BUCKETS
from twinweave.queries.scalars import JARO, NAME_SCORE, STEM

A = views.ASSETS
_AS_GROUPS = f"""dup AS (SELECT checksum, file_size, min(id) AS group_id, count(*) AS n, sum(file_size) AS bytes FROM assets WHERE file_size > 0 GROUP BY checksum, file_size HAVING count(*) > 1),
member AS (SELECT d.group_id, a.* FROM assets a JOIN dup d USING (checksum, file_size))"""
_ENGINE = "CASE media_type WHEN 'photo' THEN 0 WHEN 'video' THEN 1 ELSE 2 END, CASE WHEN media_type <> 'audio' THEN CAST(width AS BIGINT) * height END DESC NULLS LAST, file_size DESC, CASE WHEN media_type = 'audio' THEN duration_sec END DESC NULLS LAST, created_s NULLS LAST, file_name, id"


@query(
    "flagship_exact_duplicates",
    f"WITH {A}, {_AS_GROUPS} SELECT group_id, count(*) AS n_members, first(id ORDER BY {_ENGINE}) AS keeper_id, CAST(sum(file_size) * (count(*) - 1) AS BIGINT) AS space_reference, CAST(sum(file_size) - max(file_size) AS BIGINT) AS space_reclaimable FROM member GROUP BY group_id",
)
def flagship(spark, sf_dir):
    """Exact duplicate groups of documents: members, the one to keep, the bytes that the others take."""
    a = views.assets(spark, sf_dir)
    edges = pairs.exact_edges(a)
    members = connected_components(edges, "a", "b").select(F.col("component").alias("group_id"), F.col("node").alias("id")).join(a, "id")
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"), F.sum("file_size").alias("bytes"), F.max("file_size").alias("most"))
    kept = keepers.keepers(members)
    return sizes.join(kept, "group_id").select("group_id", "n_members", "keeper_id", (F.col("bytes") * (F.col("n_members") - 1)).alias("space_reference"), (F.col("bytes") - F.col("most")).alias("space_reclaimable"))


_PAIR = f"""{BUCKETS}, pol AS (
  SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM assets x JOIN assets y ON x.id <> y.id AND split_part(replace(x.file_name, '_copy', ''), '.', 1) = split_part(replace(y.file_name, '_copy', ''), '.', 1)
  WHERE (x.ut_type = 'cr2' AND y.ut_type = 'jpg') OR (x.ut_type = 'heic' AND y.ut_type IN ('mov', 'mp4')) OR (x.ut_type = 'xmp' AND y.ut_type <> 'xmp')),
p AS (SELECT x.* FROM (SELECT * FROM blocked) b JOIN (SELECT l.id AS a, r.id AS b, l.media_type, l.checksum AS ca, r.checksum AS cb, CAST(l.file_size AS DOUBLE) AS sa, CAST(r.file_size AS DOUBLE) AS sb, l.duration_sec AS da, r.duration_sec AS db,
  l.capture_s AS ta, r.capture_s AS tb, l.dhash AS ha, r.dhash AS hb, l.width AS wa, r.width AS wb, l.height AS ya, r.height AS yb FROM assets l JOIN assets r ON l.media_type = r.media_type) x ON x.a = b.a AND x.b = b.b)"""


_SIGNAL = "{{'key': '{0}', 'contribution': {1}, 'raw': CAST({2} AS DOUBLE), 'note': {3}}}"


def _signal(key: str, weight: str, raw: str, note: str, contribution: str | None = None) -> str:
    """A signal in SQL, null where ``raw`` is."""
    return f"CASE WHEN {raw} IS NOT NULL THEN {_SIGNAL.format(key, contribution or f'{weight}::DOUBLE * {raw}', raw, note)} END"


def _scored_sql(frames: str, skip: bool) -> str:
    """``sc`` (a, b, media_type, score, penalty, signals, rationale): the compared pairs that score. ``frames`` is the table of video signatures."""
    side = lambda x, y: f"CASE WHEN {x} > 0 AND {y} > 0 THEN greatest(0.0::DOUBLE, 1 - abs({x} - {y}) / greatest({x}, {y})) END"
    mean = lambda *parts: f"(SELECT CASE WHEN len(v) > 0 THEN list_sum(v) / len(v) END FROM (SELECT [z for z in [{', '.join(parts)}] if z IS NOT NULL] AS v))"
    tolerance = "greatest(greatest(da, db) * 0.02::DOUBLE, 2.0::DOUBLE)"
    duration = f"CASE WHEN da > 0 AND db > 0 AND abs(da - db) <= {tolerance} THEN 1 - abs(da - db) / {tolerance} END"
    capture = _signal("captureTime", "0.03", "tr", "'capture delta=' || printf('%.2f', CAST(abs(ta - tb) AS DOUBLE)) || 's'")
    name, checksum = _signal("name", "0.05", "nr", "'name similarity'"), _signal("checksum", "0.5", "cr", "CASE WHEN cr = 1 THEN 'checksum match' ELSE 'checksum mismatch' END")
    photo = [checksum, _signal("hash", "0.3", "hr", "'dHash distance=' || hd"), _signal("metadata", "0.1", "mr", "'metadata similarity'"), name, capture]
    video = [checksum, _signal("hash", "0.3", "vr", "'max frame distance=' || vd"), _signal("metadata", "0.1", "wr", "'video metadata'"), name, capture]
    when = lambda test: f"CASE WHEN {test} THEN 1.0::DOUBLE END"
    audio = [
        _signal("checksum", "", "q1", "'exact_match'", "0.9::DOUBLE"), _signal("fileSize", "", "q2", "'size_match'", "0.3::DOUBLE"),
        _signal("duration", "", "q3", "'duration_match'", "0.4::DOUBLE"), _signal("metadata", "", "q4", "'metadata_match'", "0.2::DOUBLE"),
    ]
    known = lambda parts: f"[z for z in [{', '.join(parts)}] if z IS NOT NULL]"
    two = "CAST(CAST(round(CAST(CAST(z.contribution AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DECIMAL(10, 2)) AS VARCHAR)"
    source = "eb" if skip else "blocked"
    again = """ers AS (SELECT *, row_number() OVER (PARTITION BY media_type, bucket ORDER BY px, py) AS r FROM ranked WHERE NOT EXISTS (SELECT 1 FROM pol WHERE pol.a = ranked.a AND pol.b = ranked.b)),
eb AS (SELECT media_type, a, b FROM ers WHERE r <= 10000),"""
    return f"""{again if skip else ''}
both_ AS (SELECT c.a, c.b, c.media_type, l.checksum AS ca, r.checksum AS cb, CAST(l.file_size AS DOUBLE) AS sa, CAST(r.file_size AS DOUBLE) AS sb, l.duration_sec AS da, r.duration_sec AS db, l.capture_s AS ta, r.capture_s AS tb,
  l.dhash AS ha, r.dhash AS hb, CAST(l.width AS DOUBLE) AS wa, CAST(r.width AS DOUBLE) AS wb, CAST(l.height AS DOUBLE) AS ya, CAST(r.height AS DOUBLE) AS yb, {STEM.format('l.file_name')} AS x, {STEM.format('r.file_name')} AS y, fl.frames AS fa, fr.frames AS fb
  FROM {source} c JOIN assets l ON l.id = c.a JOIN assets r ON r.id = c.b LEFT JOIN {frames} fl ON fl.id = c.a LEFT JOIN {frames} fr ON fr.id = c.b),
stems AS (SELECT DISTINCT x, y FROM both_ WHERE x <> y), {JARO},
raws AS (SELECT both_.*, CASE WHEN ca = cb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cr, bit_count(xor(ha, hb)) AS hd, nullif(greatest({NAME_SCORE.format('both_.x', 'both_.y')}, 0), 0) AS nr,
  CASE WHEN abs(ta - tb) <= 2 THEN 1.0::DOUBLE WHEN abs(ta - tb) < 10 THEN 1 - abs(ta - tb) / 10.0::DOUBLE END AS tr,
  {mean(side('sa', 'sb'), side('wa', 'wb'), side('ya', 'yb'))} AS mr, {mean(duration, side('wa', 'wb'), side('ya', 'yb'))} AS wr,
  CASE WHEN fa IS NOT NULL AND fb IS NOT NULL THEN list_max([bit_count(xor(fa[k], fb[k])) for k in range(1, least(len(fa), len(fb)) + 1)]) END AS vd,
  {when('ca = cb')} AS q1, {when('ca <> cb AND abs(sa - sb) <= greatest(sa, sb) * 0.01::DOUBLE')} AS q2, {when('ca <> cb AND abs(da - db) <= greatest(da, db) * 0.01::DOUBLE')} AS q3, {when('ca <> cb AND abs(ta - tb) < 60')} AS q4
  FROM both_ LEFT JOIN jw ON jw.x = both_.x AND jw.y = both_.y),
hashed AS (SELECT *, CASE WHEN hd IS NOT NULL THEN greatest(0.0::DOUBLE, 1 - hd / 5.0::DOUBLE) END AS hr, CASE WHEN vd IS NOT NULL THEN greatest(0.0::DOUBLE, 1 - vd / 5.0::DOUBLE) END AS vr FROM raws),
told AS (SELECT a, b, media_type, CASE media_type WHEN 'photo' THEN {known(photo)} WHEN 'video' THEN {known(video)} ELSE {known(audio)} END AS signals,
  CASE WHEN (media_type = 'photo' AND hr IS NULL) OR (media_type = 'video' AND vr IS NULL) THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END AS penalty FROM hashed),
sc AS (SELECT a, b, media_type, score, penalty, signals, [z.key || ':' || {two} for z in signals] AS rationale
  FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(list_sum([z.contribution for z in signals]), 0) + penalty)) AS score FROM told)
  WHERE CASE WHEN media_type = 'audio' THEN score >= 0.5 - 1e-9 ELSE score > 0 END)"""


_NO_FRAMES = "no_frames AS (SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT[]) AS frames)"
_POLICY = """poled AS (SELECT pol.a, pol.b, CASE WHEN 'xmp' IN (x.ut_type, y.ut_type) THEN 'policy.sidecar' WHEN 'heic' IN (x.ut_type, y.ut_type) THEN 'policy.live-photo' ELSE 'policy.raw-jpeg' END AS policy FROM pol JOIN assets x ON x.id = pol.a JOIN assets y ON y.id = pol.b)"""
#: ``edges`` (kind, a, b, score, penalty, signals, rationale): all edges of a detection.
_EDGES = f"""{{pair}}, {_AS_GROUPS}, {_POLICY}, {_NO_FRAMES}, {_scored_sql('no_frames', True)},
edges AS (
  SELECT 'checksum' AS kind, group_id AS a, id AS b, 1.0::DOUBLE AS score, 0.0::DOUBLE AS penalty, [{_SIGNAL.format('checksum', '1.0::DOUBLE', '1.0', "'checksum match'")}] AS signals, ['checksum'] AS rationale FROM member WHERE id <> group_id
  UNION ALL SELECT 'compared', a, b, score, penalty, signals, rationale FROM sc
  UNION ALL SELECT 'policy', a, b, s, 0.0::DOUBLE, [{_SIGNAL.format('policy', 's', 's / 0.05::DOUBLE', 'policy')}], [policy] FROM (SELECT *, CASE policy WHEN 'policy.raw-jpeg' THEN 0.05::DOUBLE WHEN 'policy.live-photo' THEN 0.03::DOUBLE ELSE 0.02::DOUBLE END AS s FROM poled)),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS v, a AS r FROM sym UNION SELECT sym.b, reach.r FROM reach JOIN sym ON sym.a = reach.v),
mem AS (SELECT v AS id, min(r) AS group_id FROM reach GROUP BY v),
ends AS (SELECT *, unnest([a, b]) AS id FROM edges),
tops AS (SELECT id, s.key AS key, max((s.contribution, s.raw, s.note)) AS top FROM (SELECT id, unnest(signals) AS s FROM ends) GROUP BY ALL),
ev AS (SELECT mem.group_id, id, greatest(least(greatest(coalesce(adds, 0) + penalty, 0), 1), best) AS confidence, n FROM mem JOIN (SELECT id, sum(penalty) AS penalty, max(score) AS best FROM ends GROUP BY id) USING (id)
  LEFT JOIN (SELECT id, sum(top[1]) AS adds, count(*) AS n FROM tops GROUP BY id) USING (id)),
lines AS (SELECT group_id, list(DISTINCT line ORDER BY line) AS rationale FROM (SELECT mem.group_id, unnest(rationale) AS line FROM edges JOIN mem ON mem.id = a) GROUP BY group_id),
over_ AS (SELECT media_type, bucket FROM n WHERE n > 256 OR n * (n - 1) // 2 > 10000),
full_ AS (SELECT mem.group_id, a.*, over_.bucket IS NOT NULL AS cut FROM mem JOIN assets a USING (id) JOIN s USING (id) LEFT JOIN over_ ON over_.media_type = s.media_type AND over_.bucket = s.bucket),
res AS (
  SELECT f.group_id, f.n_members, confidence, CASE WHEN confidence >= 0.85 THEN 'duplicate' WHEN confidence >= 0.6 THEN 'similar' ELSE 'different' END AS label, keeper_id, k.media_type, rationale,
         CAST(bytes * (f.n_members - 1) AS BIGINT) AS space_reference, CAST(bytes - k.file_size AS BIGINT) AS space_reclaimable, cut AS bucket_incomplete
  FROM (SELECT group_id, count(*) AS n_members, sum(file_size) AS bytes, bool_or(cut) AS cut, first(id ORDER BY {_ENGINE}) AS keeper_id FROM full_ GROUP BY group_id) f
  JOIN (SELECT group_id, max(confidence) AS confidence FROM ev GROUP BY group_id) USING (group_id) JOIN lines USING (group_id) JOIN assets k ON k.id = keeper_id)"""
_EDGES = _EDGES.replace("{pair}", _PAIR)


@query(
    "f03_audio_scores",
    f"""WITH {A}, {_PAIR}, au AS (SELECT a, b, CASE WHEN ca = cb THEN 0.9::DOUBLE ELSE CASE WHEN abs(sa - sb) <= greatest(sa, sb) * 0.01 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN abs(da - db) <= greatest(da, db) * 0.01 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN abs(ta - tb) < 60 THEN 0.2::DOUBLE ELSE 0 END END AS score FROM p WHERE media_type = 'audio')
        SELECT a, b, round(score, 6) AS score FROM au WHERE score >= 0.5 - 1e-9""",
)
def f03(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    audio = pairs.blocked_pairs(a.filter("media_type = 'audio'")).select("a", "b")
    return scoring.scored(audio, a).select("a", "b", F.round("score", 6).alias("score"))


@query("f01_f02_scored_pairs", f"WITH RECURSIVE {A}, {_PAIR}, {FRAMES}, {_scored_sql('sigs', False)} SELECT a, b, media_type, round(score, 6) AS score, penalty, array_to_string(rationale, ' ') AS rationale FROM sc")
def f01(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    frames = videos_with_frames(spark, sf_dir).select("id", "frames")
    a = a.join(frames, "id", "left")
    s = scoring.scored(pairs.blocked_pairs(a).select("a", "b"), a)
    return s.select("a", "b", "media_type", F.round("score", 6).alias("score"), "penalty", F.array_join("rationale", " ").alias("rationale"))


@query("f04_image_distance", f"WITH {A}, {_PAIR} SELECT a, b, CAST(bit_count(xor(ha, hb)) AS INTEGER) AS distance, CASE WHEN ha IS NULL OR hb IS NULL THEN 'missingHash' WHEN bit_count(xor(ha, hb)) <= 5 THEN 'withinThreshold' ELSE 'beyondThreshold' END AS reason FROM p WHERE media_type = 'photo'")
def f04(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    return scoring.image_distance(pairs.blocked_pairs(a.filter("media_type = 'photo'")).select("a", "b"), a)


def _video_pairs(spark, sf_dir):
    a = views.assets(spark, sf_dir).filter("media_type = 'video'")
    return pairs.blocked_pairs(a).select("a", "b"), a.join(videos_with_frames(spark, sf_dir).select("id", "frames"), "id", "left")


_VIDEO = f"{FRAMES}, vp AS (SELECT p.a, p.b, x.frames AS fa, y.frames AS fb, coalesce(da, 0) AS da, coalesce(db, 0) AS db FROM p LEFT JOIN sigs x ON x.id = a LEFT JOIN sigs y ON y.id = b WHERE media_type = 'video')"


@query(
    "f05_video_distance",
    f"""WITH {A}, {_PAIR}, {_VIDEO}, d AS (SELECT a, b, CASE WHEN fa IS NOT NULL AND fb IS NOT NULL THEN [bit_count(xor(fa[k], fb[k])) for k in range(1, least(len(fa), len(fb)) + 1)] END AS d FROM vp)
        SELECT a, b, CASE WHEN len(d) > 0 THEN list_sum(d) / len(d) WHEN d IS NOT NULL THEN 0.0 END AS mean_distance, CASE WHEN d IS NOT NULL THEN coalesce(list_max(d), 0) END AS max_distance, coalesce(len(d), 0) AS compared, coalesce(len([x for x in d if x > 5]), 0) AS mismatched FROM d""",
)
def f05(spark, sf_dir):
    return scoring.video_distance(*_video_pairs(spark, sf_dir))


@query(
    "f06_signature_comparison",
    f"""WITH {A}, {_PAIR}, {_VIDEO}, d AS (SELECT a, b, abs(da - db) AS delta, abs(da - db) <= greatest(2.0, greatest(da, db) * 0.02::DOUBLE) AS inside, [bit_count(xor(fa[k], fb[k])) for k in range(1, greatest(len(fa), len(fb)) + 1)] AS d FROM vp WHERE fa IS NOT NULL AND fb IS NOT NULL),
        m AS (SELECT *, [x for x in d if x IS NOT NULL] AS known, len([x for x in d if x IS NULL OR x > 5]) AS bad FROM d)
        SELECT a, b, CASE WHEN len(known) = 0 THEN 'insufficientData' WHEN inside AND bad = 0 THEN 'duplicate' WHEN inside AND bad <= 1 THEN 'similar' WHEN inside THEN 'different' WHEN bad = 0 THEN 'similar' ELSE 'different' END AS verdict,
               delta AS duration_delta, CASE WHEN len(known) > 0 THEN list_sum(known) / len(known) END AS average_distance, list_max(known) AS max_distance, bad AS mismatched FROM m""",
)
def f06(spark, sf_dir):
    return scoring.compare_signatures(*_video_pairs(spark, sf_dir))


@query("f07_confirmed_verdicts", f"WITH {A}, {_PAIR} SELECT a, b, CASE WHEN d < 4 OR (d <= 6 AND h <= 8) THEN 'duplicate' WHEN d <= 10 THEN 'similar' ELSE 'different' END AS verdict FROM (SELECT a, b, bit_count(xor(ha, hb)) AS d, bit_count(xor(ha // 8, hb // 8)) AS h FROM p WHERE ha IS NOT NULL AND hb IS NOT NULL)")
def f07(spark, sf_dir):
    from twinweave.functions.fingerprints import hamming

    a = views.assets(spark, sf_dir)
    p = scoring.paired(pairs.blocked_pairs(a.filter("media_type = 'photo'")).select("a", "b"), a).filter("a_dhash is not null and b_dhash is not null")
    h = hamming(F.shiftright("a_dhash", 3), F.shiftright("b_dhash", 3))
    return p.select("a", "b", scoring.confirmed_verdict(hamming("a_dhash", "b_dhash"), h).alias("verdict"))


@query("g01_candidate_buckets", f"WITH {A}, {BUCKETS} SELECT media_type, bucket, n, n * (n - 1) // 2 AS comparisons FROM n WHERE n > 1")
def g01(spark, sf_dir):
    return groups.candidate_buckets(views.assets(spark, sf_dir))


@query("g01_described_buckets", f"WITH {A}, {BUCKETS}, ig AS (SELECT DISTINCT x.id AS a, y.id AS b FROM assets x JOIN assets y ON y.id = x.id + 10 WHERE x.id % 3 <> 0), k AS (SELECT l.media_type, l.bucket, count(*) AS k FROM ig JOIN s l ON l.id = a JOIN s r ON r.id = b AND r.media_type = l.media_type AND r.bucket = l.bucket GROUP BY ALL) SELECT media_type, bucket, n, n * (n - 1) // 2 AS comparisons, coalesce(k, 0) AS skipped_by_policy, CASE media_type WHEN 'photo' THEN 'image.dimensions+size' WHEN 'video' THEN 'video.duration+resolution' ELSE 'audio.duration+size' END AS heuristic FROM n LEFT JOIN k USING (media_type, bucket) ORDER BY bucket, media_type")
def g01d(spark, sf_dir):
    """G1 with pairs of ids ten apart ignored, given in either order and some twice."""
    a = views.assets(spark, sf_dir)
    near = a.filter("id % 3 <> 0").select(F.col("id").alias("a"), (F.col("id") + 10).alias("b"))
    return groups.described_buckets(a, near.unionByName(near.filter("a % 2 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"))))


@query("h10_compared_members", f"WITH {A}, {BUCKETS} SELECT media_type, bucket, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS members FROM placed GROUP BY media_type, bucket")
def g01b(spark, sf_dir):
    return groups.compared_members(views.assets(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


@query("g01_all_bucket_members", f"WITH {A}, {BUCKETS} SELECT media_type, bucket, row_number() OVER (PARTITION BY media_type, bucket ORDER BY file_name, created_s NULLS LAST, id) AS pos, id FROM s")
def g01c(spark, sf_dir):
    return groups.bucket_members(views.assets(spark, sf_dir))


@query(
    "g02_components",
    f"""WITH RECURSIVE {A}, v AS (SELECT id, dhash FROM assets WHERE dhash IS NOT NULL), e AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id AND bit_count(xor(x.dhash, y.dhash)) <= 2),
        r AS (SELECT a AS v, a AS w FROM e UNION SELECT e.b, r.w FROM r JOIN e ON e.a = r.v) SELECT v AS id, min(w) AS group_id FROM r GROUP BY v""",
)
def g02(spark, sf_dir):
    a = Scratch(spark, "hashes").stash(views.assets(spark, sf_dir).filter("dhash is not null").select("id", F.col("dhash").alias("hash")), "hashes")
    least = a.groupBy("hash").agg(F.min("id").alias("hub"))
    same = a.join(least, "hash").filter("id <> hub").select(F.col("hub").alias("x"), F.col("id").alias("y"))
    near = pairs.hamming_pairs(a, 2)
    near = near.join(least.toDF("hash_a", "x"), "hash_a").join(least.toDF("hash_b", "y"), "hash_b").select("x", "y")
    return connected_components(same.union(near), "x", "y").select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def _detected(spark, sf_dir):
    """The whole detection: edges, members and evidence, as tables."""
    scratch = Scratch(spark, "detection")
    a = scratch.stash(views.assets(spark, sf_dir), "assets")
    edges = scratch.stash(groups.measured_edges(a), "edges")
    members = scratch.stash(groups.group_members(edges), "members")
    return a, edges, members, groups.member_evidence(edges, members)


@query("i02_detection_edges", f"WITH RECURSIVE {A}, {_EDGES} SELECT a, b, round(score, 6) AS score, penalty, array_to_string(rationale, ' ') AS rationale FROM edges")
def i02(spark, sf_dir):
    e = groups.detection_edges(views.assets(spark, sf_dir))
    return e.select("a", "b", F.round("score", 6).alias("score"), "penalty", F.array_join("rationale", " ").alias("rationale"))


@query("g03_member_evidence", f"WITH RECURSIVE {A}, {_EDGES} SELECT group_id, id, round(confidence, 6) AS confidence, n AS n_signals FROM ev")
def g03(spark, sf_dir):
    return _detected(spark, sf_dir)[3].select("group_id", "id", F.round("confidence", 6).alias("confidence"), F.size("signals").alias("n_signals"))


def _results(spark, sf_dir):
    a, edges, members, evidence = _detected(spark, sf_dir)
    return groups.group_results(edges, members, evidence, a)


@query("g04_g11_detected_groups", f"WITH RECURSIVE {A}, {_EDGES} SELECT * REPLACE (round(confidence, 6) AS confidence, array_to_string(rationale, ' ') AS rationale) FROM res")
def g04(spark, sf_dir):
    return _results(spark, sf_dir).withColumn("confidence", F.round("confidence", 6)).withColumn("rationale", F.array_join("rationale", " "))


@query("g02_a10_kept_components", f"WITH {A}, {_AS_GROUPS}, e AS (SELECT group_id AS a, id AS b FROM member WHERE id <> group_id), last AS (SELECT a, b FROM e WHERE b % 3 = 0 OR (a % 7 <> 0 AND b % 7 <> 0)) SELECT b AS node, a AS component FROM last UNION SELECT a, a FROM last")
def g02_kept(spark, sf_dir):
    """Components of exact copies kept up to date: two thirds of the edges, then every seventh file goes and the other edges come."""
    edges = Scratch(spark, "edges").stash(pairs.exact_edges(views.assets(spark, sf_dir)).select("a", "b"), "edges")
    kept = KeptComponents(spark, Scratch(spark, "kept").root, 16)
    kept.update(edges.filter("b % 3 <> 0"), number=0)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).filter("node % 7 = 0").distinct()
    kept.update(edges.filter("b % 3 = 0"), nodes, number=1)
    return kept.read()


@query("g04_q03_parity", f"WITH RECURSIVE {A}, {_EDGES} SELECT group_id, keeper_id, bucket_incomplete, EXISTS (SELECT 1 FROM over_) AS incomplete FROM res")
def g04_parity(spark, sf_dir):
    """Q3: the reference's flag for all groups beside each group's own."""
    return groups.with_parity(_results(spark, sf_dir), views.assets(spark, sf_dir)).select("group_id", "keeper_id", "bucket_incomplete", "incomplete")


@query("g05_detection_metrics", f"WITH {A}, {BUCKETS}, k AS (SELECT count(*) AS buckets, avg(n) AS average_bucket, bool_or(n > 256 OR n * (n - 1) // 2 > 10000) AS incomplete FROM n), c AS (SELECT count(*) AS comparisons FROM blocked), t AS (SELECT count(*) AS assets FROM assets) SELECT assets, comparisons, buckets, average_bucket, assets * (assets - 1) // 2 AS naive, round((1 - comparisons / (assets * (assets - 1) / 2)) * 100, 6) AS reduction_pct, incomplete FROM t, c, k")
def g05(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    m = groups.detection_metrics(a, pairs.blocked_pairs(a), groups.candidate_buckets(a, least=1))
    return m.withColumn("reduction_pct", F.round("reduction_pct", 6))


_HAS = ", ".join(f"count(*) FILTER (len([x for x in rationale if starts_with(x, '{k}')]) > 0) AS with_{k}" for k in ("checksum", "hash", "policy", "metadata"))


@query("g06_calibration", f"WITH RECURSIVE {A}, {_EDGES} SELECT count(*) AS groups, count(*) FILTER (confidence >= 0.85) AS duplicate, count(*) FILTER (confidence >= 0.6 AND confidence < 0.85) AS similar, count(*) FILTER (confidence < 0.6) AS different, round(avg(confidence), 9) AS avg_confidence, round(min(confidence), 9) AS min_confidence, round(max(confidence), 9) AS max_confidence, {_HAS}, CASE WHEN count(*) >= 10 THEN round(count(*) FILTER (confidence >= 0.85) / count(*), 9) END AS duplicate_rate FROM res")
def g06(spark, sf_dir):
    return views.rounded(groups.calibration(_results(spark, sf_dir)), 9)


@query("g08_explained_group", f"WITH RECURSIVE {A}, {_EDGES}, least_ AS (SELECT min(group_id) AS group_id FROM res) SELECT res.group_id, id, id = keeper_id AS is_keeper, round(ev.confidence, 6) AS confidence, s.key AS key, round(s.top[1], 6) AS contribution, s.top[3] AS note, array_to_string(rationale, ' ') AS rationale FROM least_ JOIN res USING (group_id) JOIN ev USING (group_id) JOIN tops s USING (id)")
def g08(spark, sf_dir):
    a, edges, members, evidence = _detected(spark, sf_dir)
    results = groups.group_results(edges, members, evidence, a)
    least = results.agg(F.min("group_id").alias("group_id"))
    out = groups.explained(results, evidence, least)
    return views.rounded(out.withColumn("rationale", F.array_join("rationale", " ")))


@query(
    "g09_c28_group_evidence",
    f"""WITH RECURSIVE {A}, {_EDGES}, best AS (SELECT mem.group_id, key, max(top) AS top FROM tops JOIN mem USING (id) GROUP BY ALL), parts AS (SELECT group_id, key, top[1] AS c, top[2] AS raw, regexp_extract(lower(top[3]), 'distance[=\\s]+(\\d+)', 1) AS said, regexp_extract(lower(top[3]), 'delta[=\\s]+([\\d.]+)s', 1) AS seconds FROM best)
        SELECT group_id, key, CASE key WHEN 'checksum' THEN 'Checksum' WHEN 'hash' THEN 'Hash Distance' WHEN 'metadata' THEN 'Metadata' WHEN 'name' THEN 'Name' WHEN 'captureTime' THEN 'Capture Date' WHEN 'fileSize' THEN 'File Size' WHEN 'duration' THEN 'Duration' WHEN 'policy' THEN 'Policy' END AS label, round(c, 6) AS contribution,
               CASE WHEN key = 'checksum' THEN CASE WHEN raw >= 1 THEN '0' ELSE 'mismatch' END WHEN key = 'hash' THEN CASE WHEN said <> '' THEN said ELSE CAST(CAST(floor((1 - raw) * 5) AS BIGINT) AS VARCHAR) END WHEN key = 'captureTime' AND seconds <> '' THEN seconds || 's' ELSE CAST(CAST(floor(raw * 100) AS BIGINT) AS VARCHAR) || '%' END AS distance_text,
               CASE WHEN key = 'checksum' THEN CASE WHEN raw >= 1 THEN '0' ELSE 'match' END WHEN key = 'hash' THEN '5' WHEN key IN ('metadata', 'name') THEN '50%' WHEN key = 'captureTime' THEN '5m' WHEN key = 'fileSize' THEN '10%' WHEN key = 'duration' THEN '2%' ELSE 'N/A' END AS threshold_text,
               CASE WHEN c > 0.3 OR raw >= 1 THEN 'pass' WHEN c > 0.1 THEN 'warn' ELSE 'fail' END AS verdict FROM parts""",
)
def g09(spark, sf_dir):
    a, _, members, evidence = _detected(spark, sf_dir)
    media = keepers.keepers(members.join(a, "id")).join(a.select(F.col("id").alias("keeper_id"), "media_type"), "keeper_id").select("group_id", "media_type")
    return views.rounded(groups.group_evidence(evidence, media))


@query("g09_penalties", f"WITH RECURSIVE {A}, {_EDGES} SELECT DISTINCT group_id, CASE media_type WHEN 'video' THEN 'penalty_videoSignatureMissing' ELSE 'penalty_hashMissing' END AS key, CASE media_type WHEN 'video' THEN 'Video Signature Missing' ELSE 'Hash Missing' END AS label, CAST(NULL AS DOUBLE) AS contribution, 'missing' AS distance_text, 'required' AS threshold_text, 'fail' AS verdict FROM edges JOIN mem ON mem.id = a JOIN assets ON assets.id = a WHERE penalty < 0")
def g09_penalties(spark, sf_dir):
    """What is missing in each group."""
    a, edges, members, _ = _detected(spark, sf_dir)
    return groups.penalty_evidence(edges, members, a)


@query("g10_summary", f"WITH RECURSIVE {A}, {_EDGES} SELECT round(avg(confidence), 9) AS avg_confidence, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.6 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.6) AS low, CAST(sum(n_members) AS BIGINT) AS files, round(avg(n_members), 9) AS average_size, max(n_members) AS largest FROM res")
def g10(spark, sf_dir):
    return views.rounded(groups.summary(_results(spark, sf_dir)), 9)


@query("d07_c32_group_search", f"WITH RECURSIVE {A}, {_EDGES} SELECT group_id, round(confidence + 0.05::DOUBLE * (len([x for x in [1] if len([z for z in rationale if starts_with(z, 'checksum')]) > 0]) + len([x for x in [1] if len([z for z in rationale if starts_with(z, 'hash')]) > 0])), 6) AS search_score FROM res WHERE media_type = 'photo' AND confidence >= 0.3 AND (contains(lower(array_to_string(rationale, ' ')), 'policy') OR contains(CAST(group_id AS VARCHAR), 'policy'))")
def d07(spark, sf_dir):
    return views.rounded(groups.search_groups(_results(spark, sf_dir), "policy", 0.3, "photo", ("checksum", "hash")).select("group_id", "search_score"), 6)
