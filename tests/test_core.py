"""Core operators against worked cases and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from twinweave.functions.fingerprints import hamming, signature, stem, stem_bucket
from twinweave.functions.signals import image_metadata_signal, jaro_winkler, video_metadata_signal, with_name_score
from twinweave.operators import catalog, groups, keepers, merge, metrics, pairs, scoring
from twinweave.operators.components import connected_components
from twinweave.plans.config import Limits, Thresholds, Weights

SCHEMA = "id long, media_type string, file_name string, folder string, file_size long, checksum string, width int, height int, duration_sec double, capture_s long, created_s long, modified_s long, dhash long, camera_model string, gps_lat double, gps_lon double, keywords array<string>, ut_type string"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def asset(i, name, size=1000, media="photo", **other):
    row = dict.fromkeys(NAMES) | {"id": i, "media_type": media, "file_name": name, "folder": "/p", "file_size": size, "ut_type": name.rsplit(".", 1)[-1].lower()} | other
    return tuple(row[n] for n in NAMES)


@pytest.fixture
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)


def detect(assets, **options):
    edges = groups.detection_edges(assets, **options)
    members = groups.group_members(edges)
    evidence = groups.member_evidence(edges, members)
    return groups.group_results(edges, members, evidence, assets).collect(), evidence.collect()


def test_stems(spark):
    df = spark.createDataFrame([("IMG_0001_copy.JPG",), ("Trip (1).png",), ("a.b-c.tar",), ("...",), ("x",)], "n string")
    got = [tuple(r) for r in df.select(stem("n"), stem_bucket(stem("n"))).collect()]
    assert got == [("img 0001", "img0"), ("trip", "trip"), ("a.b c", "abc"), ("...", "none"), ("x", "x")]


def test_photo_bucket(make):
    a = make(
        asset(1, "IMG_0001.JPG", 5_000_000, width=4002, height=3001), asset(2, "IMG_0001_copy.JPG", 5_030_000, width=4002, height=3001), asset(3, "IMG_0002.JPG", 2_000_000, width=1920, height=1080)
    )
    b = groups.candidate_buckets(a).collect()
    assert [(r["n"], r["comparisons"]) for r in b] == [(2, 1)]
    assert a.select(signature().alias("s")).first()["s"] == "img:4016x3008:s100:nimg0"


def test_checksum_group(make):
    g, _ = detect(make(asset(1, "A.CR2", 6_000_000, checksum="c"), asset(2, "B.JPG", 6_000_000, checksum="c")))
    assert len(g) == 1 and g[0]["confidence"] == 1.0 and "checksum" in g[0]["rationale"]
    assert g[0]["space_reference"] == 12_000_000 and g[0]["space_reclaimable"] == 6_000_000


def test_raw_jpeg_and_live_photo(make):
    g, _ = detect(make(asset(1, "DSC0001.CR2", 12_000_000), asset(2, "DSC0001.JPG", 4_000_000), asset(3, "Beach.HEIC"), asset(4, "Beach.MOV", media="video")))
    lines = {r["group_id"]: r["rationale"] for r in g}
    assert lines == {1: ["policy.raw-jpeg"], 3: ["policy.live-photo"]}
    assert min(r["confidence"] for r in g) == pytest.approx(0.03)


def test_ignored_pair(spark, make):
    ignored = spark.createDataFrame([(2, 1)], "a long, b long")
    g, _ = detect(make(asset(1, "A.JPG", 5, checksum="c"), asset(2, "A.PNG", 5, checksum="c")), ignored=ignored)
    assert g == []


def test_budget(make):
    a = make(*[asset(i, f"IMG_0001_{i}.JPG", width=100, height=100) for i in range(5)])
    assert pairs.blocked_pairs(a).count() == 10
    assert pairs.blocked_pairs(a, Limits(comparisons_per_bucket=1)).collect()[0][2:] == (0, 1)
    assert pairs.blocked_pairs(a, Limits(bucket_size=4)).count() == 0


def test_audio(make):
    base = asset(1, "song1.mp3", 4_000_000, "audio", duration_sec=180.0, capture_s=1000)
    for other, score in (
        (asset(2, "song2.mp3", 4_010_000, "audio", duration_sec=180.5, capture_s=1030), 0.9),
        (asset(2, "song2.mp3", 4_010_000, "audio", duration_sec=200.0, capture_s=1030), 0.5),
        (asset(2, "song2.mp3", 5_000_000, "audio", duration_sec=180.5, capture_s=1120), None),
    ):
        a = make(base, other)
        got = scoring.scored(a.sparkSession.createDataFrame([(1, 2)], "a long, b long"), a).collect()
        assert [r["score"] for r in got] == ([] if score is None else [pytest.approx(score)])


def test_burst_is_not_a_duplicate(make):
    a = make(*[asset(i, f"IMG_{i}.HEIC", width=100, height=100, capture_s=1000 + i, dhash=(1 << (15 * i)) * 1023) for i in range(1, 4)])
    g, _ = detect(a)
    assert all(r["confidence"] < 0.85 for r in g)


@pytest.mark.parametrize("x,y,want", [("martha", "marhta", 0.9611), ("abxd", "acxd", 0.8833), ("", "", 1.0), ("a", "a", 0.0), ("ab", "", 0.0), ("same", "same", 1.0)])
def test_jaro_winkler(spark, x, y, want):
    assert jaro_winkler(x, y) == pytest.approx(want, abs=1e-4)
    got = with_name_score(spark.createDataFrame([(x, y)], "a_stem string, b_stem string")).first()["name_score"]
    assert got == pytest.approx(want, abs=1e-4)


def test_weights():
    w = Weights().with_overrides(checksum=0.6).normalized
    assert sum(vars(w).values()) == pytest.approx(1.0) and w.is_valid
    with pytest.raises(ValueError):
        Weights(hash=-1)


@pytest.mark.parametrize("distance", [0, 2, 3, 5, 9])
def test_hamming_pairs_equal_brute_force(spark, distance):
    rnd = random.Random(distance)
    values = [rnd.getrandbits(64) - (1 << 63) for _ in range(60)]
    for v in values[:40]:
        x = v
        for k in rnd.sample(range(64), rnd.randint(1, distance + 2)):
            x ^= 1 << k if k < 63 else -(1 << 63)
        values.append(x)
    want = {(min(p), max(p)) for p in itertools.combinations(sorted(set(values)), 2) if bin((p[0] ^ p[1]) & (1 << 64) - 1).count("1") <= distance}
    got = pairs.hamming_pairs(spark.createDataFrame([(v,) for v in values] + [(None,)], "hash long"), distance)
    assert {(r["hash_a"], r["hash_b"]) for r in got.collect()} == want
    assert distance == 0 or want


def test_components_of_paths_stars_and_nothing(spark):
    path = [(i, i + 1) for i in range(1000)]
    random.Random(1).shuffle(path)
    star = [(5000, 6000 + i) for i in range(300)]
    edges = spark.createDataFrame(path + star + [(9, 9), (None, 3), (8000, 8000)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(1001)) and all(got[6000 + i] == 5000 for i in range(300))
    assert 8000 not in got and len(got) == 1001 + 301
    assert connected_components(edges.limit(0)).count() == 0


def test_average_distance(spark):
    rnd = random.Random(7)
    v = [rnd.getrandbits(63) for _ in range(40)]
    got = metrics.hash_statistics(spark.createDataFrame([("d", x) for x in v], "algorithm string, hash long")).first()
    want = sum(bin(a ^ b).count("1") for a, b in itertools.combinations(v, 2)) / (40 * 39 / 2)
    assert got["average_distance"] == pytest.approx(want) and got["entries"] == 40


def test_negative_hash_distance(spark):
    assert spark.createDataFrame([(-1, 0)], "a long, b long").select(hamming("a", "b")).first()[0] == 64


def test_bucket_members_have_no_size_limit(make):
    rows = [asset(i, "same.jpg", 1000, width=10, height=10, created_s=i) for i in range(300)] + [asset(900, "one.jpg", 10**9, width=9000, height=9000)]
    got = groups.bucket_members(make(*reversed(rows))).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["pos"]):
        by.setdefault(r["bucket"], []).append((r["pos"], r["id"]))
    assert sorted(by.values(), key=len) == [[(1, 900)], [(i + 1, i) for i in range(300)]]
    assert groups.compared_members(make(*rows)).count() == 0


def test_keepers(make):
    a = make(
        asset(1, "b.jpg", 10, width=10, height=10, created_s=5, modified_s=1), asset(2, "a.png", 20, width=10, height=10, modified_s=9), asset(3, "c.mov", 99, "video", width=99, height=99, created_s=1, capture_s=2, keywords=["k"])
    ).withColumn("group_id", F.lit(0))
    got = {p: keepers.keepers(a, p).first()["keeper_id"] for p in (*keepers.orders(), "custom")}
    assert got == {
        "engine": 2, "intelligent": 3, "highest_resolution": 3, "largest_file": 3, "keep_latest": 2, "keep_earliest": 3, "best_metadata": 3, "best_format": 2, "custom": None,
    }


def test_merge_fills_gaps(spark, make):
    a = make(
        asset(1, "big.jpg", 10, width=99, height=99), asset(2, "s.jpg", 5, capture_s=50, gps_lat=1.5, gps_lon=2.5, keywords=["b", "a"]), asset(3, "t.jpg", 5, capture_s=40, camera_model="x", keywords=["a"])
    ).withColumn("group_id", F.lit(7))
    m = merge.merged_metadata(a, keepers.keepers(a, "intelligent"))
    r = m.first()
    assert (r["keeper_id"], r["capture_s"], r["gps_lat"], r["camera_model"], r["keywords"], r["removed"]) == (1, 40, 1.5, "x", "a,b", [2, 3])
    assert {x["field"]: x["change"] for x in merge.field_changes(m).collect()} == dict.fromkeys(merge.FIELDS, "fill")
    p = merge.merge_plan(m).first()
    assert p["valid"] and p["changed_fields"] == sorted(merge.FIELDS)
    t = merge.record(merge.merge_plan(m), F.lit(100).cast("long"))
    undone = merge.apply_undo(t, merge.undo_candidate(t), 200)
    assert merge.undo_candidate(undone).count() == 0 and merge.redo_candidate(undone).first()["undone_s"] == 200
    assert merge.apply_undo(undone, merge.redo_candidate(undone), None).first()["undone_s"] is None


def test_incremental_scan(spark):
    old = spark.createDataFrame([("a", 1, 10, 1000), ("b", 1, 10, 1000), ("c", 1, 10, 0)], "path string, size long, modified_s long, last_scanned_s long")
    new = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("c", 1, 10), ("d", 1, 10)], "path string, size long, modified_s long")
    assert {r["path"] for r in catalog.to_scan(new, old, 1100, 500).collect()} == {"b", "c", "d"}
    assert {r["path"]: r["needs_refresh"] for r in catalog.upsert(old, new, 1100).collect()} == {"a": False, "b": True, "c": False, "d": False}


def test_threshold_suggestion_without_decisions(spark):
    r = metrics.threshold_suggestion(spark.createDataFrame([], "group_id long, accepted boolean, confidence double, ts long")).first()
    assert r["decisions"] == 0 and r["duplicate_threshold"] is None


def test_trend_directions(spark):
    rows = [(3600 * h + i, f"{i}", v) for h, vs in enumerate(([1.0, 1.0, 1.0], [1.0, 2.0], [2.0, 1.0], [1.0, 1.1], [0.0, 1.0], [5.0])) for i, v in enumerate(vs)]
    got = metrics.trends(spark.createDataFrame(rows, "ts long, sample_id string, v double"), "v", "hour").orderBy("period_s").collect()
    assert [r["direction"] for r in got] == ["stable", "increasing", "decreasing", "volatile", None, "stable"]


@pytest.mark.parametrize("n", [100, 30_000, 10**7, 10**12])
def test_near_hashes_have_a_key_in_common(spark, n):
    """For tables of every size: the keys of two hashes within the distance meet, and are as many as the bands' choices."""
    rng = random.Random(n)
    together = pairs._bands_together(n, 5)
    rows = []
    for _ in range(60):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), 5):
            y ^= 1 << bit
        rows.append((x - (1 << 63), y - (1 << 63)))
    df = spark.createDataFrame(rows, "x long, y long").withColumns({"kx": pairs.band_keys("x", 5, together), "ky": pairs.band_keys("y", 5, together)})
    assert df.filter(F.size(F.array_intersect("kx", "ky")) > 0).count() == 60
    assert df.select(F.size("kx")).first()[0] == len(list(itertools.combinations(range(5 + together), together)))
    assert together == {100: 1, 30_000: 2, 10**7: 3, 10**12: 4}[n]


def test_lookups_equal_brute_force(spark):
    rng = random.Random(8)
    hashes = [(i, rng.getrandbits(63)) for i in range(80)]
    hashes += [(100 + i, hashes[i % 80][1] ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63))) for i in range(120)] + [(300, hashes[0][1]), (301, None)]
    df = spark.createDataFrame(hashes, "id long, hash long")
    got = {(r["probe_id"], r["file_id"], r["distance"]) for r in pairs.within_distance(df, df.filter("id % 3 = 0")).collect()}
    want = {(i, j, (x ^ y).bit_count()) for i, x in hashes for j, y in hashes if i % 3 == 0 and i != j and x is not None and y is not None and (x ^ y).bit_count() <= 5}
    assert got == want
    both = {(r["hash_a"], r["hash_b"]) for r in pairs.hamming_pairs(df).collect()}
    assert both == {(x, y) for _, x in hashes for _, y in hashes if x is not None and y is not None and x < y and (x ^ y).bit_count() <= 5}
    assert pairs.within_distance(df, df.limit(0)).count() == 0


def test_scoring_joins_each_side_once_and_nothing_else(spark, sf_dir):
    """Names are compared where the pair is; what the signals read is a column before they are made."""
    from twinweave.operators import scoring
    from twinweave.plans import views

    a = views.assets(spark, sf_dir)
    plan = scoring.scored(spark.createDataFrame([(1, 11), (2, 12)], "a long, b long"), a)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "Aggregate" not in plan and plan.count("ArrowEvalPython") == 1
    assert "Generate explode" in plan and "aggregate(" not in plan.split("Generate explode")[1].split("\n")[0]


def test_no_step_of_scoring_is_too_large_to_compile(spark, sf_dir):
    """The JVM interprets methods of over 8,000 bytes."""
    from twinweave.operators import scoring
    from twinweave.plans.scratch import Scratch
    from twinweave.plans import views

    a = Scratch(spark, "assets").stash(views.assets(spark, sf_dir), "assets")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scored = scoring.scored(spark.createDataFrame([(1, 11), (2, 12)], "a long, b long"), a)
        debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package")
        steps = debug.codegenStringSeq(scored._jdf.queryExecution().executedPlan())
        sizes = [steps.apply(i)._3().maxMethodCodeSize() for i in range(steps.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) <= 8000


def test_budget_and_skips_without_a_rank_of_pairs(spark, make):
    """Pairs are neither sorted nor moved once they are made, and are those of a count in order."""
    rng = random.Random(7)
    rows = [asset(i, f"IMG_{rng.randrange(4)}_{rng.randrange(9)}.JPG", width=100 + 16 * rng.randrange(2), height=100, created_s=rng.choice([None, 1, 2])) for i in rng.sample(range(900), 90)]
    a, ids = make(*rows), [r[0] for r in rows]
    skip = [tuple(rng.sample(ids, 2)) for _ in range(1500)]
    skip += skip[:20]
    skips = spark.createDataFrame(skip, "a long, b long")
    skip = {tuple(sorted(p)) for p in skip}
    buckets = {}
    for r in pairs.bucketed(a).select("bucket", "id", "file_name", "created_s").collect():
        buckets.setdefault(r["bucket"], []).append((r["file_name"], r["created_s"] is None, r["created_s"] or 0, r["id"]))
    for budget, most in ((10, 256), (1, 256), (0, 256), (200, 256), (10_000, 256), (50, max(map(len, buckets.values())) - 1)):
        want = set()
        for files in (f for f in buckets.values() if len(f) <= most):
            found = [tuple(sorted((x[3], y[3]))) for x, y in itertools.combinations(sorted(files), 2)]
            want |= set([p for p in found if p not in skip][:budget])
        got = pairs.blocked_pairs(a, Limits(comparisons_per_bucket=budget, bucket_size=most), skips)
        rows = [tuple(r) for r in got.select("a", "b").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    assert "Window" not in above and "RepartitionByExpression" not in above


def test_evidence_is_aggregated_in_numbers(spark, make):
    """No aggregate over edge ends sorts them, as one with texts does; of equal signals the later note counts."""
    a = make(*[asset(i, f"IMG_0001_{i}.JPG", width=100, height=100, capture_s=1000 + i, dhash=h) for i, h in enumerate([0, (1 << 9) - 1, (1 << 12) - 1, (1 << 3) - 1])])
    edges = groups.detection_edges(a)
    evidence = groups.member_evidence(edges, groups.group_members(edges))
    assert "SortAggregate" not in evidence._jdf.queryExecution().executedPlan().toString()
    notes = {r["id"]: {s["key"]: s["note"] for s in r["signals"]} for r in evidence.collect()}
    # distances: 0-1 9, 0-2 12, 0-3 3, 1-2 3, 1-3 6, 2-3 9
    assert {n["hash"] for n in notes.values()} == {"dHash distance=3"}
    assert notes[0]["captureTime"] == "capture delta=2.00s"
    # orders of distances: as the struct of raw value and note has them, and back
    df = spark.range(65).select(F.col("id").cast("int").alias("d")).withColumn("raw", F.greatest(F.lit(0.0), 1 - F.col("d") / 5.0))
    rows = df.withColumn("o", groups._hash_order(F.col("d"), F.col("raw"))).withColumn("back", groups._distance_of(F.col("o"))).collect()
    assert all(r["back"] == r["d"] for r in rows)
    assert [r["d"] for r in sorted(rows, key=lambda r: r["o"])] == [r["d"] for r in sorted(rows, key=lambda r: (r["raw"], str(r["d"])))]


def test_lines_have_the_digits_of_the_edges(spark, make):
    """Lines of groups, numbers until they are told apart, are those of the edges as texts."""
    rng = random.Random(3)
    photos = [asset(i, f"IMG_{i}.{rng.choice(['CR2', 'JPG', 'XMP'])}", 1000 + rng.randrange(9), width=100, height=100, checksum=rng.choice(["c", "d", None]), capture_s=1000 + i % 4, dhash=rng.choice([None, 0, 7, 255])) for i in range(12)]
    audio = [asset(i, f"song{i}.mp3", 4_000_000, "audio", duration_sec=180.0, capture_s=1000, checksum=rng.choice(["e", "f"])) for i in range(20, 26)]
    edges = groups.detection_edges(make(*photos, *audio)).cache()
    members = groups.group_members(edges)
    of = {r["id"]: r["group_id"] for r in members.collect()}
    want = {}
    for r in edges.collect():
        want.setdefault(of[r["a"]], set()).update(r["rationale"])
    assert {r["group_id"]: r["rationale"] for r in groups._group_lines(edges, members).collect()} == {g: sorted(x) for g, x in want.items()}
    halves = [k / 1000 for k in range(0, 1000, 5)]
    plain = [(1, 2, 0, *([None] * 4), x, 1.0) for x in halves]
    e = spark.createDataFrame(plain, "a long, b long, kind int, r1 double, r2 double, r3 double, r4 double, r0 double, f0 double")
    e = e.withColumns({f"f{i}": F.lit(1.0) for i in range(1, 5)}).withColumn("policy", F.lit(None).cast("string"))
    got = groups._group_lines(e, spark.createDataFrame([(1, 1)], "group_id long, id long")).first()["rationale"]
    assert got == sorted({r[0] for r in e.select(F.concat(F.lit("checksum:"), F.format_string("%.2f", "r0"))).collect()})


def test_metadata_signals_read_their_own_columns_only(spark):
    """A picture's rows need no durations, a video's no file sizes."""
    sides = "a_width int, b_width int, a_height int, b_height int"
    pictures = spark.createDataFrame([(100, 80, 10, 20, 30, 30), (0, 80, 10, 20, None, 30), (None, None, None, None, None, None)], f"a_file_size long, b_file_size long, {sides}")
    got = [r[0] for r in pictures.select(image_metadata_signal(Weights())["raw"]).collect()]
    assert got == [pytest.approx((0.8 + 0.5 + 1) / 3), pytest.approx(0.5), None]
    videos = spark.createDataFrame([(10.0, 11.0, 10, 20, 30, 30), (10.0, 20.0, 0, 20, 15, 30), (None, 1.0, 0, 0, None, 30)], f"a_duration_sec double, b_duration_sec double, {sides}")
    got = [r[0] for r in videos.select(video_metadata_signal(Weights(), Thresholds())["raw"]).collect()]
    assert got == [pytest.approx((0.5 + 0.5 + 1) / 3), pytest.approx(0.5), None]
