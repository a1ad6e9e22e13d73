"""The file tree source and changes between its listings."""

import datetime as dt
import os
import random

import pytest

from twinweave.sources import files as fs
from twinweave.sources import tree
from twinweave.sources.keyed_store import KeyedStore
from twinweave.streaming import events as ev

T0 = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "photos"
    for name in ("a/1.jpg", "a/deep/er/2.png", "a/deep/3.tmp", "b/4.gif", "b/.hidden/5.jpg", "cache/6.jpg", "7.jpg", "x/node_modules/8.js"):
        p = top / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"\x89PNG\r\n\x1a\n" + name.encode())
    (top / "link").symlink_to(top / "a")
    (top / "empty").mkdir()
    return str(top)


def names(df, root):
    return sorted(r.path.removeprefix(root + "/") for r in df.filter("error is null").collect())


@pytest.mark.parametrize("tasks", [1, 3, 64])
def test_tree_lists_every_file_once(spark, root, tasks):
    df = tree.file_tree(spark, [root, root + "/a", root + "/"], tasks=tasks, heads=True)
    assert names(df, root) == ["7.jpg", "a/1.jpg", "a/deep/3.tmp", "a/deep/er/2.png", "b/.hidden/5.jpg", "b/4.gif", "cache/6.jpg", "x/node_modules/8.js"]
    row = df.filter("path like '%/7.jpg'").first()
    s = os.stat(root + "/7.jpg")
    assert (row.size, row.modified_s, row.inode) == (s.st_size, int(s.st_mtime), f"{s.st_dev}:{s.st_ino}") and row.head.startswith("89504E47")
    plain = {r.path.removeprefix("file:") for r in fs.listing(spark, root).collect()}
    # Spark's own listing leaves hidden folders out and follows links
    assert {p for p in plain if "/link/" not in p} == {r.path for r in df.collect() if "/.hidden/" not in r.path}


def test_pruned_folders_are_never_opened(spark, root):
    os.chmod(root + "/cache", 0)
    opened = []
    reader = tree.FileTreeReader({"roots": f'["{root}"]', "exclude": f'[["hidden", ""], ["prefix", "{root}/cache"], ["contains", "/node_modules/"]]', "tasks": "2"})
    below = reader._below
    reader._below = lambda folder: opened.append(folder) or below(folder)
    got = [p for part in reader.partitions() for b in reader.read(part) for p in b.column("path").to_pylist()]
    os.chmod(root + "/cache", 0o755)
    assert sorted(p.removeprefix(root + "/") for p in got) == ["7.jpg", "a/1.jpg", "a/deep/3.tmp", "a/deep/er/2.png", "b/4.gif"]
    assert not any(".hidden" in f or "cache" in f or "node_modules" in f for f in opened)
    rules = [fs.Exclude("prefix", root + "/cache"), ("contains", "/node_modules/"), ("hidden", "")]
    assert names(tree.file_tree(spark, [root], rules), root) == ["7.jpg", "a/1.jpg", "a/deep/3.tmp", "a/deep/er/2.png", "b/4.gif"]


def test_missing_roots_are_rows_with_an_error(spark, tmp_path):
    got = tree.file_tree(spark, [str(tmp_path / "none")]).collect()
    assert len(got) == 1 and got[0].error and got[0].size is None
    assert tree.file_tree(spark, []).count() == 0


LISTING = "path string, inode string, size long, modified_s long"


def applied(spark, catalog, before, after, number=1):
    known = spark.createDataFrame(catalog, ev.CATALOG)
    events = tree.listing_changes(spark.createDataFrame(before, LISTING), spark.createDataFrame(after, LISTING), T0, number)
    return {r.path: (r.id, r.size) for r in ev.apply_changes(known, events).collect()}, events.collect()


def test_kinds_of_change(spark):
    before = [("same", "1", 1, 1), ("grown", "2", 1, 1), ("gone", "3", 1, 1), ("old", "4", 4, 1), ("x", "5", 5, 1), ("y", "6", 6, 1), ("saved", "7", 7, 1), ("left", "8", 8, 1)]
    after = [("same", "1", 1, 1), ("grown", "2", 2, 2), ("new", "4", 4, 1), ("x", "6", 6, 1), ("y", "5", 5, 1), ("saved", "70", 9, 2), ("fresh", "9", 3, 3), ("right", "8", 8, 1), ("left", "10", 1, 9)]
    out, events = applied(spark, [(i, p, s) for i, (p, _, s, _) in enumerate(before)], before, after)
    assert {k: v for k, v in out.items() if v[0] >= 0} == {"same": (0, 1), "grown": (1, 2), "new": (3, 4), "x": (5, 6), "y": (4, 5), "saved": (6, 9), "right": (7, 8)}
    assert {k: v[1] for k, v in out.items() if v[0] < 0} == {"fresh": 3, "left": 1}
    assert {e.path: e.kind for e in events if "\0" not in e.path} == {"grown": "modified", "gone": "deleted", "new": "renamed", "x": "renamed", "y": "renamed", "saved": "modified", "fresh": "created", "right": "renamed", "left": "modified"}


@pytest.mark.parametrize("seed", range(2))
def test_random_listings(spark, seed):
    rng = random.Random(seed)
    before = {f"p{k}": (str(k), k, 0) for k in range(40)}
    ids = {inode: k for k, (inode, _, _) in enumerate(before.values())}
    catalog = [(ids[i], p, s) for p, (i, s, _) in before.items()]
    after = {p: v for p, v in before.items() if rng.random() < 0.8}
    paths = list(after)
    moved = rng.sample(paths, 20)
    targets = rng.sample(sorted(set(moved) | {f"q{k}" for k in range(10)} | (set(before) - set(after))), 20)
    contents = [after.pop(p) for p in moved]
    after |= dict(zip(targets, contents, strict=True))
    after |= {f"n{k}": (f"n{k}", k, 1) for k in range(5)}
    rows = lambda d: [(p, *v) for p, v in d.items()]
    out, _ = applied(spark, catalog, rows(before), rows(after))
    assert {p: s for p, (_, s) in out.items()} == {p: s for p, (_, s, _) in after.items()}
    assert {p: i for p, (i, _) in out.items() if i >= 0} == {p: ids[inode] for p, (inode, _, _) in after.items() if inode in ids}


def test_scans_of_a_folder_keep_ids(spark, root, tmp_path):
    seen = KeyedStore(spark, str(tmp_path / "seen"), tree.SNAPSHOT, ["path"], buckets=4)
    catalog = KeyedStore(spark, str(tmp_path / "catalog"), ev.CATALOG, ["path"], buckets=4)
    folder, schema = str(tmp_path / "events"), "event_id long, ts timestamp, path string, kind string, old_path string, size long"

    def scan(number):
        tree.commit_scan(seen, tree.file_tree(spark, [root]), folder, number, T0 + dt.timedelta(minutes=number))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)
        q = ev.stream_changes(stream, catalog, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
        return {r.path.removeprefix(root + "/"): (r.id, r.size) for r in catalog.read().collect()}

    first = scan(0)
    assert set(first) == set(names(tree.file_tree(spark, [root]), root))
    os.rename(root + "/a/1.jpg", root + "/b/one.jpg")
    os.remove(root + "/cache/6.jpg")
    with open(root + "/7.jpg", "ab") as f:
        f.write(b"more")
    with open(root + "/new.jpg", "wb") as f:
        f.write(b"12345")
    second = scan(1)
    assert second["b/one.jpg"] == first["a/1.jpg"] and "cache/6.jpg" not in second and "a/1.jpg" not in second
    assert second["7.jpg"] == (first["7.jpg"][0], first["7.jpg"][1] + 4) and second["new.jpg"][1] == 5
    version = seen.manifest().version
    assert not tree.commit_scan(seen, tree.file_tree(spark, [root]), folder, 1, T0 + dt.timedelta(minutes=1))
    assert seen.manifest().version == version and scan(2) == second
