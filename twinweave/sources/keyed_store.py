"""A keyed table that changes are committed to.

Rows lie in buckets by the hash of their key. A commit rewrites the buckets of
the keys it names into a folder of its own and then publishes a version: a
manifest file that says in which folder each bucket is, and the number of the
batch it came from. The manifest appears by one rename, so readers see all of a
commit or nothing. A commit that died before leaves files that no manifest
names; run again it makes the same rows. One whose number the latest manifest
already has is a no-op, so a micro-batch may be replayed.

    path/manifest/version=N/part-*.parquet   (writer, bucket, folder, source, number)
    path/data/<writer>/bucket=K/part-*.parquet
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinweave.plans.scratch import delete

_MANIFEST = "writer string, bucket int, folder string, source string, number long"


class LostRace(RuntimeError):
    """Another writer published this version first; read again and repeat."""


@dataclass(frozen=True)
class Manifest:
    """Folders of buckets, and the last batch of each source."""

    version: int = 0
    folders: dict[int, str] = field(default_factory=dict)
    numbers: dict[str, int] = field(default_factory=dict)


class KeyedStore:
    """A table of ``schema`` keyed by ``keys`` under ``path``, a folder that driver and executors share.

    The number of buckets is fixed when the first version is published; a bucket
    should hold what one task rewrites with ease. Keys aren't null; rows of equal
    keys share a bucket. An empty store reads as an empty table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def bucket(self, *columns: str | Column) -> Column:
        """The bucket of a key."""
        return F.pmod(F.xxhash64(*(columns or self.keys)), F.lit(self.buckets)).cast("int")

    # versions

    def _versions(self) -> list[int]:
        """Numbers of the published versions, from the names of their folders."""
        try:
            files = self.spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).parquet(f"{self.path}/manifest").inputFiles()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted({int(f.rsplit("/", 2)[1].removeprefix("version=")) for f in files})

    def _version(self, version: int) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={version}")

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest published manifest, or that of a version; of two writers of a version the first by name counts."""
        if version is None:
            version = max(self._versions(), default=0)
        if version == 0:
            return Manifest()
        rows = self._version(version).collect()
        winner = min(r.writer for r in rows)
        rows = [r for r in rows if r.writer == winner]
        return Manifest(version, {r.bucket: r.folder for r in rows if r.bucket is not None}, {r.source: r.number for r in rows if r.source is not None})

    def _publish(self, writer: str, m: Manifest) -> None:
        rows = [(writer, b, f, None, None) for b, f in sorted(m.folders.items())] + [(writer, None, None, s, n) for s, n in sorted(m.numbers.items())]
        rows = rows or [(writer, None, None, None, None)]
        # append: what a dead writer of this version left behind stays unread
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest/version={m.version}")
        if self.manifest(m.version).folders != m.folders:
            raise LostRace(f"version {m.version} of {self.path}")

    # rows

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table as of a version (the latest if None), or some of its buckets."""
        return self._rows(self.manifest(version), buckets)

    def _rows(self, m: Manifest, buckets: Sequence[int] | None = None) -> DataFrame:
        paths = [f"{f}/bucket={b}" for b, f in sorted(m.folders.items()) if buckets is None or b in set(buckets)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys: at most ``buckets`` small numbers reach the driver."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of the given keys; only their buckets are read."""
        return self.read(version, self.touched(keys)).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def base(self, source: str, number: int | None) -> int:
        """The version that a batch starts from: the latest, or the one before if the batch is there already."""
        m = self.manifest()
        return m.version - 1 if number is not None and m.numbers.get(source, -1) >= number else m.version

    # commits

    def change(self, keys: DataFrame, rewrite: Callable[[DataFrame], DataFrame], source: str = "", number: int | None = None) -> bool:
        """Replace the buckets of ``keys`` by ``rewrite`` of their rows; False if this batch was committed before.

        ``rewrite`` gets all rows of those buckets and returns all that they are
        to hold; rows of any other bucket are an error. ``number`` is that of a
        micro-batch, which grows within its ``source``. Without keys there is
        nothing to publish.
        """
        now = self.manifest()
        if number is not None and now.numbers.get(source, -1) >= number:
            return False
        touched = self.touched(keys)
        if not touched:
            return True
        folders = {b: f for b, f in now.folders.items() if b not in touched}
        writer = uuid.uuid4().hex
        folder = f"{self.path}/data/{writer}"
        own = self.bucket()
        after = rewrite(self._rows(now, touched)).select(*self.schema.names)
        strays = F.when(~own.isin(touched), F.raise_error(F.lit("a row outside the buckets that were named"))).otherwise(own)
        placed = after.withColumn("bucket", strays).repartition(len(touched), "bucket").sortWithinPartitions("bucket", *self.keys)
        placed.write.partitionBy("bucket").parquet(folder)
        full = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(folder)
        folders |= {r[0]: folder for r in full.select("bucket").distinct().collect()}
        numbers = now.numbers if number is None else {**now.numbers, source: number}
        self._publish(writer, Manifest(now.version + 1, folders, numbers))
        return True

    def put(self, rows: DataFrame, source: str = "", number: int | None = None) -> bool:
        """Insert rows or replace those of their keys."""
        return self.change(rows, lambda before: before.join(rows.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(rows.select(*self.schema.names)), source, number)

    def remove(self, keys: DataFrame, source: str = "", number: int | None = None) -> bool:
        return self.change(keys, lambda before: before.join(keys.select(*self.keys).distinct(), self.keys, "left_anti"), source, number)

    def vacuum(self, keep: int = 2) -> int:
        """Delete data that none of the last ``keep`` versions has, and the manifests before these; how many folders went.

        Not while a commit is under way.
        """
        versions = self._versions()
        used = {x for v in versions[-keep:] for x in self.manifest(v).folders.items()}
        # all writers of the older versions, those that lost too
        old = {(r.bucket, r.folder) for v in versions[:-keep] for r in self._version(v).filter("bucket is not null").collect()} - used
        versions = versions[:-keep]
        for path in [f"{f}/bucket={b}" for b, f in sorted(old)] + [f"{self.path}/manifest/version={v}" for v in versions]:
            delete(self.spark, path)
        return len(old)
