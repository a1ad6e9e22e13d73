"""Folder trees as a data source, and what changed between two listings of one.

``FileTree`` lists a tree in many tasks: the driver opens folders from the top
until there are enough of them, and each task walks its own. A folder that a
rule excludes is never opened. ``listing_changes`` finds created, changed,
deleted and renamed files by path and inode; ``commit_scan`` keeps the last
listing in a keyed store and appends the changes to a folder that streams read.
"""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from twinweave.sources.keyed_store import KeyedStore

LISTING = "path string, inode string, size long, modified_s long, head string, error string"
_ARROW = pa.schema([("path", pa.string()), ("inode", pa.string()), ("size", pa.int64()), ("modified_s", pa.int64()), ("head", pa.string()), ("error", pa.string())])
_BATCH = 4096


@dataclass
class Folders(InputPartition):
    """Folders to list, with all below them or, if not ``deep``, the files that lie in them."""

    folders: tuple[str, ...]
    deep: bool


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [r.rstrip("/") or "/" for r in json.loads(options["roots"])]
        self.rules = [tuple(r) for r in json.loads(options.get("exclude", "[]"))]
        self.tasks = int(options.get("tasks", "64"))
        self.heads = options.get("heads", "false").lower() == "true"

    def pruned(self, folder: str) -> bool:
        """Whether a rule excludes everything below a folder."""
        inside = folder + "/"
        for kind, text in self.rules:
            if kind == "prefix" and inside.startswith(text) or kind == "contains" and text in inside:
                return True
            if kind == "hidden" and os.path.basename(folder).startswith("."):
                return True
        return False

    def _below(self, folder: str) -> tuple[list[str], list[os.DirEntry], str | None]:
        """(folders to walk, files, error) of one folder; links aren't followed."""
        try:
            with os.scandir(folder) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError as e:
            return [], [], e.strerror
        folders = [e.path for e in entries if e.is_dir(follow_symlinks=False) and not self.pruned(e.path)]
        return folders, [e for e in entries if e.is_file(follow_symlinks=False)], None

    def partitions(self) -> list[Folders]:
        roots = [r for r in dict.fromkeys(self.roots) if not self.pruned(r)]
        # a root below another is listed once
        todo = [r for r in roots if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in roots)]
        opened: list[str] = []
        while todo and len(todo) < self.tasks:
            deeper = [(f, self._below(f)[0]) for f in todo]
            if not any(below for _, below in deeper):
                break
            opened += [f for f, _ in deeper]
            todo = [b for _, below in deeper for b in below]
        deal = lambda folders, deep: [Folders(tuple(folders[k :: self.tasks]), deep) for k in range(min(self.tasks, len(folders)))]
        return deal(opened, False) + deal(todo, True) or [Folders((), False)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        todo = list(partition.folders)
        while todo:
            folder = todo.pop()
            below, files, error = self._below(folder)
            if error is not None:
                rows.append((folder, None, None, None, None, error))
            rows += [self._row(f) for f in files]
            todo += below if partition.deep else []
            if len(rows) >= _BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _row(self, entry: os.DirEntry) -> tuple:
        head = error = None
        try:
            s = entry.stat(follow_symlinks=False)
            if self.heads:
                with open(entry.path, "rb") as f:
                    head = f.read(16).hex().upper()
        except OSError as e:
            return (entry.path, None, None, None, None, e.strerror)
        return (entry.path, f"{s.st_dev}:{s.st_ino}", s.st_size, int(s.st_mtime), head, error)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class FileTree(DataSource):
    """``spark.read.format("file_tree")``: files below folders that driver and executors mount alike.

    Options: ``roots``, a JSON list of folders; ``exclude``, a JSON list of rules
    (kind prefix, contains or hidden; text), of which those that take a whole
    folder keep it closed (single files are left to ``files.excluded``);
    ``tasks``; ``heads`` true for the first 16 bytes as hex. A folder or file
    that can't be opened is a row with its ``error``.
    """

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> FileTreeReader:
        return FileTreeReader(self.options)


def file_tree(spark: SparkSession, roots: list[str], exclude=(), tasks: int = 64, heads: bool = False) -> DataFrame:
    """A1: the files below ``roots``; ``exclude`` are rules of ``files.Exclude`` or (kind, text)."""
    spark.dataSource.register(FileTree)
    rules = [(r.kind, r.text) if hasattr(r, "kind") else tuple(r) for r in exclude]
    options = {"roots": json.dumps(roots), "exclude": json.dumps(rules), "tasks": str(tasks), "heads": str(heads)}
    return spark.read.format("file_tree").options(**options).load()


# changes between listings

SNAPSHOT = "path string, inode string, size long, modified_s long"
#: Order of a scan's events: what goes makes room for what comes.
_GONE, _ASIDE, _MOVED, _LANDED, _PUT = range(5)


def listing_changes(before: DataFrame, after: DataFrame, at: dt.datetime, number: int = 0) -> DataFrame:
    """K1: (event_id, ts, path, kind, old_path, size) of all that differs between two listings (path, inode, size, modified_s).

    A file whose inode is at another path was renamed; of an inode with several
    paths those that left and those that came are matched in order. A path with
    another inode, size or time was modified. Events of one scan are in order by
    ``ts``, a microsecond apart: deletions, renames, then files that came or
    changed; a file whose new place another leaves goes aside first. Rows without an inode are
    matched by path alone. Paths are unique and not null.
    """
    both = before.select("path", F.col("inode").alias("i0"), F.col("size").alias("s0"), F.col("modified_s").alias("m0"), F.lit(True).alias("was")).join(
        after.select("path", F.col("inode").alias("i1"), F.col("size").alias("s1"), F.col("modified_s").alias("m1"), F.lit(True).alias("is")), "path", "full_outer"
    )
    stays = F.col("was").isNotNull() & F.col("is").isNotNull() & (F.col("i0").eqNullSafe(F.col("i1")) | F.col("i0").isNull() | F.col("i1").isNull())
    left = both.filter(F.col("was").isNotNull() & ~stays)
    came = both.filter(F.col("is").isNotNull() & ~stays)
    place = lambda df, inode: df.filter(F.col(inode).isNotNull()).groupBy(F.col(inode).alias("inode")).agg(F.array_sort(F.collect_list("path")).alias("paths")).select("inode", F.posexplode("paths").alias("k", "path"))
    moved = place(left, "i0").withColumnRenamed("path", "old_path").join(place(came, "i1"), ["inode", "k"]).select("old_path", "path")
    renamed = moved.join(came.select("path", F.col("s1").alias("size")), "path")
    # the new place is one that another moved file leaves
    crossing = renamed.join(moved.select(F.col("old_path").alias("path")), "path", "left_semi").select("path", "old_path", "size")
    plain = renamed.join(crossing.select("path"), "path", "left_anti").select("path", "old_path", "size")
    aside = F.concat(F.col("old_path"), F.lit("\0"), F.lit(str(number)))
    nothing = F.lit(None).cast("string")
    no_size = F.lit(None).cast("long")
    event = lambda df, step, kind, path, old, size: df.select(F.lit(step).alias("step"), F.lit(kind).alias("kind"), path.alias("path"), old.alias("old_path"), size.alias("size"))
    gone = left.filter(F.col("is").isNull()).join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    changed = both.filter(stays & ~(F.col("s0").eqNullSafe(F.col("s1")) & F.col("m0").eqNullSafe(F.col("m1"))))
    new = came.join(moved.select("path"), "path", "left_anti")
    parts = [
        event(gone, _GONE, "deleted", F.col("path"), nothing, no_size),
        event(crossing, _ASIDE, "renamed", aside, F.col("old_path"), no_size),
        event(crossing, _LANDED, "renamed", F.col("path"), aside, F.col("size")),
        event(plain, _MOVED, "renamed", F.col("path"), F.col("old_path"), F.col("size")),
        event(changed.union(new.filter(F.col("was").isNotNull())), _PUT, "modified", F.col("path"), nothing, F.col("s1")),
        event(new.filter(F.col("was").isNull()), _PUT, "created", F.col("path"), nothing, F.col("s1")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    start = int(at.replace(tzinfo=at.tzinfo or dt.timezone.utc).timestamp() * 1_000_000)
    return out.select(F.pmod(F.xxhash64(F.lit(number), "step", "path"), F.lit(1 << 62)).alias("event_id"), F.timestamp_micros(F.lit(start) + F.col("step")).alias("ts"), "path", "kind", "old_path", "size")


def commit_scan(store: KeyedStore, listing: DataFrame, events_path: str, number: int, at: dt.datetime, source: str = "scan") -> bool:
    """K1: one scan: its changes are appended below ``events_path`` and the stored listing (``SNAPSHOT`` by path) is brought up to date.

    The first scan gives every file as created. A scan that died, or comes again
    under its number, writes the same events in the same place.
    """
    now = listing.filter("error is null").select("path", "inode", "size", "modified_s")
    base = store.base(source, number)
    before = store.read(base)
    events = listing_changes(before, now, at, number)
    events.write.mode("overwrite").parquet(f"{events_path}/scan={number}")
    done = store.spark.read.schema("path string, old_path string").parquet(f"{events_path}/scan={number}")
    paths = done.select("path").union(done.select(F.col("old_path").alias("path"))).filter(F.col("path").isNotNull() & ~F.col("path").contains("\0")).distinct()
    return store.change(paths, lambda old: old.join(paths, "path", "left_anti").unionByName(now.join(paths, "path", "left_semi")), source, number)
