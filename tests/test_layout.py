"""Names in batches, tables that lie as they are asked for."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinweave.functions.signals import jaro_winkler, jaro_winkler_batch
from twinweave.operators import catalog
from twinweave.sources.layout import Ranges, write_bucketed

ODD = ["", "a", "b", "ab", "ba", "aaaa", "aaab", "martha", "marhta", "🙂🙂x", "x🙂🙂", "é́", "é", "x" * 64, "y" * 63 + "x", "x" * 65, "ab" * 100, "\ud800", "abcdefghijklmnopqrstuvwxyz" * 2]


def some_names(n, rng):
    word = lambda: "".join(rng.choice("abcdeé🙂 1") for _ in range(rng.choice([0, 1, 2, 5, 9, 17, 33, 64, 70])))
    out = []
    for _ in range(n):
        x = word()
        y = "".join(c for c in x if rng.random() < 0.9) if rng.random() < 0.5 else word()
        out.append((x, "".join(rng.sample(y, len(y))) if rng.random() < 0.2 else y))
    return out


def test_names_in_a_batch_equal_one_by_one():
    pairs = some_names(4000, random.Random(1)) + [(x, y) for x in ODD for y in ODD]
    x, y = zip(*pairs, strict=True)
    got = jaro_winkler_batch(list(x), list(y))
    want = np.array([jaro_winkler(p, q) for p, q in pairs])
    assert np.allclose(got, want, rtol=0, atol=1e-12)
    assert len(jaro_winkler_batch([], [])) == 0


def test_a_batch_is_several_times_as_fast():
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abcdefgh") for _ in range(20)), "".join(rng.choice("abcdefgh") for _ in range(20))) for _ in range(8000)]
    x, y = map(list, zip(*pairs, strict=True))
    rates = []
    for f in (lambda: jaro_winkler_batch(x, y), lambda: [jaro_winkler(p, q) for p, q in pairs]):
        t = time.process_time()
        f()
        rates.append(time.process_time() - t)
    assert rates[0] * 2 < rates[1]


@pytest.fixture
def listing(spark):
    return spark.range(3000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), (F.col("id") * 7 % 1000).alias("size"), F.lit(1).cast("long").alias("modified_s"))


def test_only_the_listing_moves_to_a_bucketed_catalogue(spark, listing, tmp_path):
    known = listing.filter("size % 3 <> 0").withColumn("last_scanned_s", F.lit(10).cast("long"))
    table = write_bucketed(known, "kept_catalogue", "path", 8, str(tmp_path / "c"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        todo = catalog.to_scan(listing, table, 20)
        plan = todo._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        plain = catalog.to_scan(listing, known, 20)
        assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert sorted(map(tuple, todo.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists kept_catalogue")


def test_a_range_reads_its_share_of_files(spark, listing, tmp_path):
    rows = listing.withColumn("size", F.when(F.col("path").endswith("77"), None).when(F.col("path").endswith("1"), 500).otherwise(F.col("size")))
    r = Ranges(spark, str(tmp_path / "r"), "size", rows.schema)
    r.write(rows, 20)
    for low, high in ((100, 149), (None, 30), (980, None), (500, 500), (5000, None)):
        got = r.read(low, high)
        want = rows.filter("size is not null").filter(F.lit(True) if low is None else F.col("size") >= low).filter(F.lit(True) if high is None else F.col("size") <= high)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert r.read().count() == 3000
    assert len(r.read(100, 149).inputFiles()) <= 0.2 * len(r.read().inputFiles())
    empty = Ranges(spark, str(tmp_path / "e"), "size", rows.schema)
    empty.write(rows.limit(0))
    assert empty.read(1, 2).count() == 0
