"""Bands that meet across their edges, Hamming joins under skew, exact quantiles, bounded merges."""

import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from twinweave.functions.fingerprints import close, log_band
from twinweave.operators import groups, merge, pairs
from twinweave.operators.quantiles import exact_quantiles
from twinweave.plans.config import Limits

ASSET = "id long, media_type string, file_name string, width int, height int, file_size long, duration_sec double, created_s long"


def near(a, b, share, least):
    a, b = max(a or 0, 0), max(b or 0, 0)
    return (a > 0) == (b > 0) and abs(a - b) <= max(least, share * max(a, b))


@pytest.mark.parametrize(("share", "least"), [(0.01, 1.0), (0.02, 0.5), (0.01, 0.5)])
def test_close_values_are_in_bands_that_meet(spark, share, least):
    rng = random.Random(1)
    rows = []
    for _ in range(4000):
        a = rng.choice([rng.uniform(0, 3), rng.uniform(0, 200), math.exp(rng.uniform(0, 25)), least / share * rng.uniform(0.95, 1.05)])
        b = a * (1 - share) if a * share > least else a - least
        rows += [(a, b), (a, a - (a - b) * rng.random()), (a, 0.0), (None, -1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    bad = df.filter(close("a", "b", share, least) & (F.abs(log_band("a", share, least) - log_band("b", share, least)) > 1))
    assert bad.count() == 0
    # and bands tell values apart: one three tolerances away is in none of the three
    far = df.filter("a > 1").withColumn("b", F.col("a") + 4 * F.greatest(F.lit(least), F.col("a") * share))
    assert far.filter(F.abs(log_band("a", share, least) - log_band("b", share, least)) <= 1).count() == 0


def some_assets(n=260):
    rng = random.Random(3)
    size = [1000, 1009, 1010, 1011, 50_000, 50_400, 50_520, 99, 100, 101, 0, 0]
    lasts = [10.0, 10.4, 10.5, 10.6, 25.0, 25.4, 25.6, 300.0, 305.9, 306.2, 0.0, None]
    return [(i, rng.choice(["photo", "video", "audio"]), f"{rng.choice(['clip', 'shot'])}{i}.x", rng.choice([640, 650]), 480, rng.choice(size), rng.choice(lasts), rng.choice([None, i])) for i in range(n)]


def brute_banded(rows):
    def meets(x, y):
        if x[1] != y[1] or x[2][:4] != y[2][:4]:
            return False
        if x[1] == "photo":
            return math.ceil(x[3] / 16) == math.ceil(y[3] / 16) and near(x[5], y[5], 0.01, 1.0)
        if x[1] == "video":
            return near(x[6], y[6], 0.02, 0.5)
        return near(x[5], y[5], 0.01, 1.0) and near(x[6], y[6], 0.01, 0.5)

    return {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if meets(x, y)}


def test_banded_pairs_miss_none(spark):
    rows = some_assets()
    got = [(r.a, r.b) for r in pairs.banded_pairs(spark.createDataFrame(rows, ASSET)).collect()]
    want = brute_banded(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    skip = spark.createDataFrame([(b, a) for a, b in sorted(want)[:50]], "a long, b long")
    left = {(r.a, r.b) for r in pairs.banded_pairs(spark.createDataFrame(rows, ASSET), skip=skip).collect()}
    assert left == want - set(sorted(want)[:50])
    few = pairs.banded_pairs(spark.createDataFrame(rows, ASSET), Limits(comparisons_per_bucket=3)).count()
    assert 0 < few < len(want)
    assert pairs.banded_pairs(spark.createDataFrame([], ASSET)).count() == 0


@pytest.mark.parametrize("hot", [50, None])
def test_banded_pairs_of_crowded_bands_are_whole(spark, hot):
    rows = [(3 * i, "video", f"clip{i}.mp4", 1920, 1080, 100 + i, 100.0 + i % 5, None) for i in range(300)]
    rows += [(3 * i + 1, "audio", f"clip{i}.mp3", None, None, 5000 + i % 80, 60.0 + i % 2, 1) for i in range(260)]
    df = spark.createDataFrame(rows, ASSET)
    got = [(r.a, r.b) for r in pairs.banded_pairs(df, hot=hot).collect()]
    want = brute_banded(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40_000
    assert pairs.banded_pairs(df, Limits(bucket_size=40)).count() < len(want)


def crowd(rng, n):
    """Half of the hashes are within three bits of zero."""
    out = {0}
    while len(out) < n // 2:
        out.add(sum(1 << b for b in rng.sample(range(63), rng.randrange(4))))
    while len(out) < n:
        x = rng.getrandbits(63)
        out |= {x, x ^ 1 << rng.randrange(63) ^ 1 << rng.randrange(63)}
    return sorted(out)


def apart(a, b):
    return bin(a ^ b).count("1")


@pytest.mark.parametrize("hot", [40, 100_000])
def test_hamming_pairs_of_a_crowd(spark, hot):
    values = crowd(random.Random(7), 500)
    df = spark.createDataFrame([(v, alg) for v in values for alg in ("d", "p") if alg == "d" or v % 3] + [(None, "d"), (values[0], "d")], "hash long, algorithm string")
    got = [tuple(r) for r in pairs.hamming_pairs(df, 3, hot=hot).collect()]
    want = {(alg, a, b, apart(a, b)) for alg in ("d", "p") for a, b in itertools.combinations([v for v in values if alg == "d" or v % 3], 2) if apart(a, b) <= 3}
    assert len(got) == len(set(got)) and set(got) == want
    plain = pairs.hamming_pairs(df.filter("algorithm = 'd'").drop("algorithm"), 3, hot=hot)
    assert {tuple(r) for r in plain.collect()} == {w[1:] for w in want if w[0] == "d"}


@pytest.mark.parametrize("hot", [30, 100_000])
def test_lookups_by_algorithm_in_order_of_distance(spark, hot):
    rng = random.Random(8)
    values = crowd(rng, 300)
    rows = [(i, v, alg) for i, v in enumerate(values) for alg in ("d", "p")] + [(900, values[5], "d"), (901, None, "d")]
    df = spark.createDataFrame(rows, "id long, hash long, algorithm string")
    got = pairs.within_distance(df, df.filter("id % 9 = 0"), 4, hot=hot).collect()
    want = {}
    for i, v, alg in rows:
        if i % 9 == 0:
            found = sorted((apart(v, w), j) for j, w, other in rows if other == alg and w is not None and j != i and apart(v, w) <= 4)
            want |= {(alg, i, j): (d, k) for k, (d, j) in enumerate(found, 1)}
    assert {(r.algorithm, r.probe_id, r.file_id): (r.distance, r["rank"]) for r in got} == want and len(got) == len(want)


def test_hot_keys_are_split(spark):
    """Of a crowd at one key few stay together at a finer key: 2,000 hashes that share 16 bits, else apart."""
    rng = random.Random(9)
    values = sorted({rng.getrandbits(47) << 16 for _ in range(2000)})
    near_by = [v ^ 1 << rng.randrange(20, 60) for v in values[:50]]
    df = spark.createDataFrame([(v,) for v in {*values, *near_by}], "hash long")
    got = {(r.hash_a, r.hash_b) for r in pairs.hamming_pairs(df, 3, hot=64).collect()}
    every = sorted({*values, *near_by})
    import numpy as np

    x = np.array(every, np.uint64)
    want = set()
    for k, v in enumerate(x):
        d = np.array([bin(z).count("1") for z in (x[k + 1 :] ^ v).tolist()])
        want |= {(int(v), int(w)) for w in x[k + 1 :][d <= 3]} if len(d) else set()
    assert got == want and len(got) >= 50


SAMPLES = "op string, v double"


@pytest.mark.parametrize("few", [1 << 16, 30, 0])
def test_quantiles_equal_duckdb(spark, few):
    rng = random.Random(4)
    hot = [("hot", rng.choice([rng.gauss(0, 1e3), 5.0, -0.0, 0.0, 1e-300, -1e300, 7.25])) for _ in range(6000)]
    rows = hot + [("one", 3.5), ("two", 1.0), ("two", 2.0), (None, 4.0), (None, None), ("none", None), ("far", -1e308), ("far", 1e308), ("inf", math.inf), ("inf", -math.inf), ("inf", 1.0)]
    rows += [(f"g{i % 50}", rng.random() * 10 ** rng.randrange(-20, 20)) for i in range(900)]
    df = spark.createDataFrame(rows, SAMPLES).repartition(5)
    got = {(r.op, r.probability): r.value for r in exact_quantiles(df, ["op"], "v", (0.0, 0.25, 0.5, 0.99, 1.0), few).collect()}
    pdf = df.toPandas()  # noqa: F841
    want = duckdb.sql("select op, unnest([0.0, 0.25, 0.5, 0.99, 1.0]) as p, unnest(quantile_cont(v, [0.0, 0.25, 0.5, 0.99, 1.0])) as q from pdf where v is not null and op is distinct from 'far' group by op").fetchall()
    for op, p, q in want:
        mine = got[op if op == op else None, float(p)]
        assert mine == q or math.isclose(mine, q, rel_tol=1e-12), (op, p, mine, q)
    assert ("none", 0.5) not in got and got[None, 0.5] == 4.0 and got["far", 0.0] == -1e308
    whole = exact_quantiles(df, [], "v", few=few).collect()
    assert len(whole) == 1 and math.isclose(whole[0].value, duckdb.sql("select median(v) from pdf").fetchall()[0][0], rel_tol=1e-12)


def test_quantiles_of_ties_and_nan(spark):
    df = spark.createDataFrame([("a", 2.0)] * 999 + [("b", float("nan")), ("b", 1.0), ("b", 2.0)], SAMPLES)
    got = {(r.op, r.probability): r.value for r in exact_quantiles(df, ["op"], "v", (0.5, 1.0), few=2).collect()}
    assert got["a", 0.5] == 2.0 and got["b", 0.5] == 2.0 and math.isnan(got["b", 1.0])
    assert exact_quantiles(df.limit(0), ["op"], "v").count() == 0


META = "group_id long, id long, capture_s long, gps_lat double, gps_lon double, camera_model string, keywords array<string>"


def test_merges_of_a_large_group(spark):
    n = 200_000
    big = spark.range(n).select(
        F.lit(1).cast("long").alias("group_id"), "id", F.when(F.col("id") % 3 == 1, F.col("id") + 100).alias("capture_s"), F.when(F.col("id") == 77, 1.5).alias("gps_lat"), F.lit(None).cast("double").alias("gps_lon"),
        F.when(F.col("id") % 2 == 1, "").when(F.col("id") > 9, F.concat(F.lit("cam"), F.col("id").cast("string"))).alias("camera_model"), F.array(F.concat(F.lit("k"), (F.col("id") % 5).cast("string")), F.lit(None)).alias("keywords"),
    )
    small = spark.createDataFrame([(2, n + 1, None, None, None, "own", ["x"]), (2, n + 2, 5, None, 2.0, "other", None), (3, n + 3, 1, None, None, None, None)], META)
    members, chosen = big.unionByName(small), spark.createDataFrame([(1, 0), (2, n + 1), (3, 999_999)], "group_id long, keeper_id long")
    fields = {r.group_id: r.asDict() for r in merge.merged_fields(members, chosen).collect()}
    assert (fields[1]["capture_s"], fields[1]["gps_lat"], fields[1]["gps_lon"], fields[1]["camera_model"], fields[1]["n_removed"], fields[1]["valid"]) == (101, 1.5, None, "cam10", n - 1, True)
    assert (fields[2]["capture_s"], fields[2]["gps_lon"], fields[2]["camera_model"], fields[2]["n_removed"]) == (5, 2.0, "own", 1)
    assert not fields[3]["valid"]
    words = {tuple(r) for r in merge.merged_keywords(members, chosen).collect()}
    assert words == {(1, f"k{i}", i == 0) for i in range(5)} | {(2, "x", True)}
    gone = merge.removals(members, chosen)
    assert gone.count() == n and {tuple(r) for r in gone.filter("group_id > 1").collect()} == {(2, n + 1, n + 2)}
    # as the one-row form of the small groups
    whole = {r.group_id: r for r in merge.merged_metadata(small, chosen).collect()}
    for g in (2, 3):
        assert all(whole[g][c] == fields[g][c] for c in ("capture_s", "gps_lat", "gps_lon", "camera_model", "keeper_capture_s"))


def test_described_buckets_and_parity(spark):
    a = spark.createDataFrame([(i, "photo", f"name{i}.jpg", 640, 480, 500, None, None) for i in range(6)] + [(9, "audio", "z.mp3", None, None, 500, 3.0, None)], ASSET)
    ignored = spark.createDataFrame([(0, 1), (1, 0), (2, 9), (3, 4), (5, 5)], "a long, b long")
    got = groups.described_buckets(a, ignored).collect()
    assert [(r.media_type, r.n, r.comparisons, r.skipped_by_policy, r.heuristic) for r in got] == [("audio", 1, 0, 0, "audio.duration+size"), ("photo", 6, 15, 2, "image.dimensions+size")]
    assert groups.described_buckets(a).select("skipped_by_policy").distinct().collect()[0][0] == 0
    some = spark.createDataFrame([(1, False)], "group_id long, bucket_incomplete boolean")
    assert groups.with_parity(some, a, Limits(bucket_size=5)).first()["incomplete"] and not groups.with_parity(some, a).first()["incomplete"]
