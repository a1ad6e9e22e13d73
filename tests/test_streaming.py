"""Stream operators on a file source."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from twinweave.streaming import events as ev

SCHEMA = "event_id long, ts timestamp, session_id long, kind string, path string, value double, modified_s long, size long"
T0 = dt.datetime(2024, 1, 1)


def row(i, s, kind="item", path="p", session=1, value=0.0, size=1):
    return (i, T0 + dt.timedelta(seconds=s), session, kind, path, value, 1, size)


@pytest.fixture
def run(spark, tmp_path):
    def go(batches, transform, mode="append"):
        src = tmp_path / "in"
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(src / f"b{k}"))
        schema = spark.createDataFrame([], SCHEMA).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
        q = transform(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
            return spark.sql("select * from out").collect()
        finally:
            q.stop()

    return go


def test_debounce(run):
    got = run([[row(1, 0), row(2, 0.5, "modified"), row(3, 5, "deleted")], [row(4, 100, path="far")]], lambda s: ev.debounced(s, "1 second", "1 second"))
    assert sorted((r["path"], r["kind"], r["merged"]) for r in got) == [("p", "deleted", 1), ("p", "modified", 2)]


def test_session_fold(run):
    got = run([[row(1, 0, "started"), row(2, 1), row(3, 2, "error")], [row(4, 3, "finished", value=7.0), row(5, 1, session=2)]], ev.session_state, "complete")
    assert {r["session_id"]: (r["items"], r["errors"], r["phase"]) for r in got} == {1: (7, 1, "finished"), 2: (1, 0, "item")}


def test_duplicate_suppression(run):
    got = run([[row(1, 0), row(2, 1)], [row(3, 2), row(4, 3, size=2)]], lambda s: ev.unchanged_dropped(s).select("path", "size"))
    assert sorted(r["size"] for r in got) == [1, 2]


def test_windows(run):
    got = run([[row(i, i) for i in range(20)]], lambda s: ev.progress_health(s, least=1.5), "complete")
    assert [(r["per_second"], r["slow"]) for r in sorted(got, key=lambda r: r["start"])] == [(1.0, True), (1.0, True)]


CHANGE = "event_id long, ts timestamp, path string, kind string, old_path string, size long"


def test_changes(spark):
    catalog = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "id long, path string, size long")
    events = spark.createDataFrame(
        [(1, T0, "a", "modified", None, 5), (2, T0, "b", "deleted", None, None), (3, T0, "d", "renamed", "c", None), (4, T0, "e", "created", None, 9), (0, T0, "e", "deleted", None, None)], CHANGE
    )
    got = {r["path"]: (r["id"], r["size"]) for r in ev.apply_changes(catalog, events).collect()}
    assert got == {"a": (1, 5), "d": (3, 1), "e": (-5, 9)}


def folded(catalog, events):
    """The catalogue after the events, one by one."""
    at = {p: (i, s) for i, p, s in catalog}
    for number, _, path, kind, old, size in sorted(events, key=lambda e: (e[1], e[0])):
        if kind == "deleted":
            at.pop(path, None)
            continue
        if kind == "renamed" and old != path and old in at:
            at[path] = at.pop(old)
        elif path not in at:
            at[path] = (-1 - number, None)
        if size is not None:
            at[path] = (at[path][0], size)
    return {p: v for p, v in at.items()}


CHAINS = {
    "modified, then renamed": [("A", "modified", None, 7), ("C", "renamed", "A", None)],
    "created, then renamed": [("D", "created", None, 3), ("E", "renamed", "D", None)],
    "renamed, then modified": [("C", "renamed", "A", None), ("C", "modified", None, 8)],
    "renamed onto another": [("B", "renamed", "A", None)],
    "there and back": [("C", "renamed", "A", None), ("A", "created", None, 4), ("D", "renamed", "C", 5), ("C", "renamed", "A", None), ("A", "renamed", "D", None)],
    "renamed from nothing": [("B", "renamed", "X", 6), ("Y", "renamed", "X", 6), ("X", "deleted", None, None)],
    "onto itself": [("A", "renamed", "A", 2), ("Z", "renamed", None, 3)],
}


@pytest.mark.parametrize("name", CHAINS)
def test_chained_changes(spark, name):
    catalog = [(1, "A", 1), (2, "B", 1)]
    events = [(i, T0 + dt.timedelta(seconds=i), *e) for i, e in enumerate(CHAINS[name])]
    out = ev.apply_changes(spark.createDataFrame(catalog, "id long, path string, size long"), spark.createDataFrame(events[::-1], CHANGE)).collect()
    assert {r["path"]: (r["id"], r["size"]) for r in out} == folded(catalog, events) and len(out) == len({r["path"] for r in out})


def test_many_changes_in_order(spark):
    import random

    rng = random.Random(5)
    paths = [f"f{i}" for i in range(30)]
    catalog = [(i, p, i) for i, p in enumerate(paths[:20])]
    events = [(i, T0 + dt.timedelta(seconds=rng.randrange(200)), rng.choice(paths), rng.choice(["created", "modified", "deleted", "renamed", "renamed"]), rng.choice([None, *paths]), rng.choice([None, i])) for i in range(400)]
    known = spark.createDataFrame(catalog, "id long, path string, size long")
    out = ev.apply_changes(known, spark.createDataFrame(events, CHANGE).repartition(3))
    assert {r["path"]: (r["id"], r["size"]) for r in out.collect()} == folded(catalog, events)
    signatures = known.select(F.col("id").alias("file_id"), F.lit("h").alias("hash"))
    left = {v[0] for v in folded(catalog, events).values() if v[0] >= 0}
    assert {r["file_id"] for r in ev.surviving(signatures, out).collect()} == left
    assert ev.apply_changes(known.limit(0), spark.createDataFrame([], CHANGE)).count() == 0


def test_continuous_scan_reads_new_files(spark, tmp_path):
    spark.createDataFrame([row(1, 0)], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = ev.continuous_scan(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    q = ev.live_counters(stream).writeStream.format("memory").queryName("scan").outputMode("complete").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([row(2, 1)], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        assert spark.sql("select sum(n) from scan").first()[0] == 2
    finally:
        q.stop()


def test_run_changes(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1)], "id long, path string, size long").write.parquet(str(tmp_path / "c0"))
    state = {"at": str(tmp_path / "c0")}

    def write(gone, put, number):
        rest = spark.read.parquet(state["at"]).join(gone.select("path"), "path", "left_anti")
        state["at"] = str(tmp_path / f"c{number + 1}")
        rest.unionByName(put).write.parquet(state["at"])

    spark.createDataFrame([(1, T0, "z", "created", None, 4)], CHANGE).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.createDataFrame([], CHANGE).schema).parquet(str(tmp_path / "in"))
    q = ev.run_changes(stream, lambda: spark.read.parquet(state["at"]), write, str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r["path"] for r in spark.read.parquet(state["at"]).filter(F.col("size") > 0).collect()} == {"a", "z"}
