"""The keyed store: commits, replays, crashes, restarts and races."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import CHANGE, T0, folded
from twinweave.operators import catalog, merge
from twinweave.sources.keyed_store import KeyedStore, LostRace
from twinweave.streaming import events as ev

SCHEMA = "id long, name string, extra array<long>"


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "store"), SCHEMA, ["id"], buckets=8)


def rows(df):
    return sorted(map(tuple, df.collect()))


def table(spark, ids, name):
    return spark.createDataFrame([(i, name, [i]) for i in ids], SCHEMA)


def test_commits_and_versions(spark, store):
    assert store.read().count() == 0 and store.manifest().version == 0 and store.vacuum() == 0
    assert store.put(table(spark, range(50), "a"), "s", 0)
    before = store.manifest()
    assert store.put(table(spark, [3, 60], "b"), "s", 1)
    after = store.manifest()
    changed = {b for b in {*before.folders, *after.folders} if before.folders.get(b) != after.folders.get(b)}
    assert changed == set(store.touched(table(spark, [3, 60], ""))) and len(changed) <= 2
    want = [(i, "b" if i in (3, 60) else "a", [i]) for i in [*range(50), 60]]
    assert rows(store.read()) == want
    assert rows(store.read(version=1)) == [(i, "a", [i]) for i in range(50)]
    assert rows(store.lookup(spark.createDataFrame([(3,), (60,), (99,)], "id long"))) == [(3, "b", [3]), (60, "b", [60])]
    assert store.remove(store.read().select("id"), "s", 2) and store.read().count() == 0
    assert store.put(table(spark, [1], "c"), "s", 3) and rows(store.read()) == [(1, "c", [1])]


def test_a_replayed_batch_changes_nothing(spark, store):
    assert store.put(table(spark, range(9), "a"), "s", 0)
    now = store.manifest()
    assert not store.put(table(spark, range(9), "other"), "s", 0)
    assert store.manifest() == now
    assert store.put(table(spark, [1], "b"), "another", 0)


def test_a_commit_that_died_is_done_again(spark, store, monkeypatch):
    store.put(table(spark, range(20), "a"), "s", 0)
    now = store.manifest()
    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "_publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            store.put(table(spark, [2], "b"), "s", 1)
    assert store.manifest() == now and {r[1] for r in rows(store.read())} == {"a"}
    assert store.put(table(spark, [2], "b"), "s", 1)
    assert [r for r in rows(store.read()) if r[1] == "b"] == [(2, "b", [2])] and store.read().count() == 20


def test_two_writers_of_a_version(spark, store, monkeypatch):
    store.put(table(spark, range(20), "a"))
    other = KeyedStore(spark, store.path, SCHEMA, ["id"], buckets=8)
    publish, lost = KeyedStore._publish, []

    def late(self, writer, m):
        """Both have read version 1 when the other publishes; the writer whose name comes first wins."""
        monkeypatch.setattr(KeyedStore, "_publish", publish)
        publish(other, "0" * 32, type(m)(m.version, {**m.folders, **dict.fromkeys(m.folders, "elsewhere")}, {}))
        publish(self, writer, m)

    monkeypatch.setattr(KeyedStore, "_publish", late)
    try:
        store.put(table(spark, [3], "b"))
    except LostRace as e:
        lost.append(e)
    assert len(lost) == 1


def test_rows_outside_the_named_buckets_are_an_error(spark, store):
    store.put(table(spark, range(20), "a"))
    key = spark.createDataFrame([(3,)], "id long")
    stray = next(i for i in range(20) if store.touched(table(spark, [i], "")) != store.touched(key))
    with pytest.raises(Exception, match="outside the buckets"):
        store.change(key, lambda before: before.union(table(spark, [stray], "b")))
    assert {r[1] for r in rows(store.read())} == {"a"}


def test_vacuum_keeps_the_last_versions(spark, store):
    for k in range(4):
        store.put(table(spark, range(k, 20), f"n{k}"), "s", k)
    assert store.vacuum(keep=1) > 0
    assert rows(store.read()) == [(i, f"n{min(i, 3)}", [i]) for i in range(20)]
    assert store.manifest().version == 4 and store.vacuum(keep=1) == 0


def some_events(n, seed=5):
    rng = random.Random(seed)
    paths = [f"f{i}" for i in range(30)]
    return [(i, T0 + dt.timedelta(seconds=i // 3), rng.choice(paths), rng.choice(["created", "modified", "deleted", "renamed", "renamed"]), rng.choice([None, *paths]), rng.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_repeated_and_shuffled_events_are_a_sequential_fold(spark, seed):
    events = some_events(200, seed)
    again = events + random.Random(seed).choices(events, k=150)
    random.Random(seed + 1).shuffle(again)
    known = [(i, f"f{i}", i) for i in range(20)]
    out = ev.apply_changes(spark.createDataFrame(known, ev.CATALOG), spark.createDataFrame(again, CHANGE).repartition(3)).collect()
    assert {r["path"]: (r["id"], r["size"]) for r in out} == folded(known, events) and len(out) == len({r["path"] for r in out})


def test_a_rename_delivered_twice_keeps_the_id(spark):
    e = [(1, T0, "b", "renamed", "a", None)] * 2
    out = ev.apply_changes(spark.createDataFrame([(1, "a", 7)], ev.CATALOG), spark.createDataFrame(e, CHANGE))
    assert rows(out) == [(1, "b", 7)]
    nameless = [(None, T0, "b", "renamed", "a", None)] * 2 + [(None, T0, "c", "created", None, 3)]
    out = ev.apply_changes(spark.createDataFrame([(1, "a", 7)], ev.CATALOG), spark.createDataFrame(nameless, CHANGE)).collect()
    assert {(r["path"], r["size"]) for r in out} == {("b", 7), ("c", 3)} and next(r["id"] for r in out if r["path"] == "b") == 1


def test_changes_stream_into_the_store_through_a_crash_and_a_restart(spark, tmp_path, monkeypatch):
    events = some_events(120)
    store = KeyedStore(spark, str(tmp_path / "catalog"), ev.CATALOG, ["path"], buckets=4)
    known = [(i, f"f{i}", i) for i in range(20)]
    store.put(spark.createDataFrame(known, ev.CATALOG))
    parts = [events[:50], events[50:90] + events[40:50], events[90:] + events[85:90]]  # the ends of parts come again
    for k, part in enumerate(parts):
        spark.createDataFrame(part, CHANGE).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(spark.createDataFrame([], CHANGE).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    publish, dies = KeyedStore._publish, {3: "before", 4: "after"}

    def dying(self, writer, m):
        when = dies.pop(m.version, None)
        if when == "before":
            raise OSError("killed before the version was there")
        publish(self, writer, m)
        if when == "after":
            raise OSError("killed after the version was there")

    monkeypatch.setattr(KeyedStore, "_publish", dying)
    failures = 0
    for _ in range(4):
        q = ev.stream_changes(stream, store, str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
            break
        except Exception:
            failures += 1
        finally:
            q.stop()
    assert failures == 2 and not dies
    got = store.read().collect()
    assert {r["path"]: (r["id"], r["size"]) for r in got} == folded(known, events) and len(got) == len({r["path"] for r in got})
    assert store.manifest().version == 1 + len(parts)


def test_undo_and_failure_rewrite_their_buckets_only(spark, tmp_path):
    schema = "id long, group_id long, created_s long, undone_s long, status string"
    t = spark.createDataFrame([(i, i % 5, i, None, "done") for i in range(40)], schema)
    store = KeyedStore(spark, str(tmp_path / "t"), schema, ["id"], buckets=16)
    store.put(t)
    first = store.manifest()
    chosen = merge.undo_candidate(store.read()).filter("group_id < 2").select("id")
    store.change(chosen, lambda before: merge.apply_undo(before, chosen, 99))
    second = store.manifest()
    assert {b for b in first.folders if first.folders[b] != second.folders[b]} == set(store.touched(chosen))
    assert {r["id"] for r in store.read().filter("undone_s = 99").collect()} == {35, 36}
    redo = merge.redo_candidate(store.read()).filter("group_id = 0").select("id")
    store.change(redo, lambda before: merge.apply_undo(before, redo, None))
    failed = spark.createDataFrame([(7,)], "id long")
    store.change(failed, lambda before: merge.mark_failed(before, failed))
    want = merge.mark_failed(merge.apply_undo(t, spark.createDataFrame([(36,)], "id long"), 99), failed)
    assert rows(store.read().select(*want.columns).fillna(-1)) == rows(want.fillna(-1))


def test_upserts_in_the_store_equal_whole_tables(spark, tmp_path):
    schema = "path string, size long, modified_s long, last_scanned_s long, needs_refresh boolean"
    known = spark.createDataFrame([(f"p{i}", i, 1, 5, False) for i in range(30)], schema)
    listing = spark.createDataFrame([(f"p{i}", i + i % 2, 1) for i in range(20, 40)], "path string, size long, modified_s long")
    store = KeyedStore(spark, str(tmp_path / "c"), schema, ["path"], buckets=8)
    store.put(known)
    store.change(listing, lambda before: catalog.upsert(before, listing, 9))
    assert rows(store.read()) == rows(catalog.upsert(known, listing, 9).select(*store.schema.names))
    # groups: only the new groups' buckets
    members = "group_id long, id long"
    old = spark.createDataFrame([(g, 10 * g + k) for g in range(9) for k in range(3)], members)
    new = spark.createDataFrame([(2, 20), (2, 999), (40, 41)], members)
    files = old.select("id").union(spark.createDataFrame([(41,)], "id long"))
    groups = KeyedStore(spark, str(tmp_path / "g"), members, ["group_id"], buckets=8)
    groups.put(old)
    groups.change(new, lambda before: catalog.replace_groups(before, new, files))
    assert rows(groups.read()) == rows(catalog.replace_groups(old, new, files)) and groups.read().filter(F.col("group_id") == 2).count() == 1
