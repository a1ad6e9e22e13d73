"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations.

Each table rotates a vector three times by random signs and a Hadamard
transform; the hash of a rotation is the largest coordinate with its sign, and
a table's key joins a few such hashes. A vector also enters the buckets of its
next best hashes (multiprobe). Pairs that share a bucket are compared by exact
cosine in double precision, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.operators.components import connected_components
from twinweave.plans.scratch import Scratch


@dataclass(frozen=True)
class Hashing:
    """``tables`` keys of ``width`` rotations each; ``probes`` buckets a vector enters in each table."""

    tables: int = 8
    width: int = 2
    probes: int = 3
    seed: int = 5

    @staticmethod
    def of(vectors: int, dim: int) -> Hashing:
        """So wide that a bucket holds about four vectors that are alike by chance, with tables to make up for it.

        Tables are enough for 99 % of pairs at cosine 0.9 to share a bucket, whatever the dimension and width.
        """
        bits = max(1, (dim - 1).bit_length())
        width = max(2, math.ceil(math.log(max(1, vectors * Hashing.probes / 4)) / math.log(2 << bits)))
        needed = math.log(0.01) / math.log1p(-shared_in_a_table(bits, width))
        return Hashing(tables=max(round(8 * 1.6 ** (width - 2)), math.ceil(1.1 * needed)), width=width)


def shared_in_a_table(bits: int, width: int) -> float:
    """Share of pairs at cosine 0.9 that meet in one table with three probes, for 2^bits dimensions.

    A line through shares that were measured on random pairs of 64 to 2,048
    dimensions, at width 2, and through the factor of each further rotation.
    """
    past = bits - 6
    return min(0.9, max(0.1, 0.65 - 0.051 * past) * max(0.1, 0.53 - 0.034 * past) ** (width - 2))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; those whose squares would overflow or vanish are scaled first."""
    x = x.astype(float)
    most = np.abs(x).max(1, keepdims=True)
    far = (most > 1e100) | (most < 1e-100)
    x = np.where(far, x / np.where(far, most, 1.0), x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n = x.shape[1]
    h = 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(-1, n)
        h *= 2
    return x / math.sqrt(n)


def bucket_keys(x: np.ndarray, how: Hashing) -> np.ndarray:
    """Buckets (rows, tables * probes) of unit vectors; a row's buckets are distinct."""
    length = x.shape[1]
    dim = 1 << max(1, (length - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, dim - length)))
    rng = np.random.default_rng([how.seed, dim])
    out = []
    for t in range(how.tables):
        hashes, gaps = [], []
        for _ in range(how.width):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], dim))
            size = np.abs(y)
            top = np.argpartition(-size, min(how.probes, dim - 1), 1)[:, : how.probes + 1]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), 1, kind="stable"), 1)
            lead = np.take_along_axis(size, top, 1)
            hashes.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
            gaps.append(lead[:, :1] - lead)
        # choose one coordinate of each rotation; the cheapest choices are the probes
        choice = np.stack(np.meshgrid(*[np.arange(h.shape[1]) for h in hashes], indexing="ij"), -1).reshape(-1, how.width)
        cost = sum(gaps[w][:, choice[:, w]] ** 2 for w in range(how.width))
        best = np.argsort(cost, 1, kind="stable")[:, : how.probes]
        key = np.full(best.shape, t * 1_000_003 + length, np.int64)
        for w in range(how.width):
            key = key * (2 * dim) + np.take_along_axis(hashes[w], choice[best, w], 1)
        out.append(key)
    return np.concatenate(out, 1)


def _hashed(how: Hashing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = b.take(pa.array(np.flatnonzero(sizes == size)))
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                keys = np.sort(bucket_keys(unit_rows(x), how), 1)
                packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, keys)]
                yield pa.record_batch([part.column(0), part.column(1), *packed, pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "copies", "vector", "keys", "buckets"])

    return run


_FEW = 64


def _dense(node, copies, unit, keys, bucket, threshold: float, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one pair of blocks in one large bucket, by a matrix: (node, links) and a spanning forest (node, root)."""
    order = np.argsort(node, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    node, copies, unit, keys, a, b = node[order], copies[order], unit[order], keys[order], np.sort(back[a]), np.sort(back[b])
    linked = unit[a] @ unit[b].T >= threshold
    if len(a) == len(b) and (a == b).all():
        linked &= a[:, None] < b[None, :]
    p, q = np.nonzero(linked)
    for c in range(0, len(p), 4096):
        left, right = keys[a[p[c : c + 4096]]], keys[b[q[c : c + 4096]]]
        met = ((left[:, :, None] == right[:, None, :]) & (left[:, :, None] < bucket)).any((1, 2))
        linked[p[c : c + 4096][met], q[c : c + 4096][met]] = False
    links = np.zeros(len(node), np.int64)
    np.add.at(links, a, linked @ copies[b])
    np.add.at(links, b, linked.T @ copies[a])
    root = np.arange(len(node))
    pairs = np.argwhere(linked)
    src, dst = a[pairs[:, 0]], b[pairs[:, 1]]
    while len(src):
        low = np.minimum(root[src], root[dst])
        before = root.copy()
        np.minimum.at(root, root[src], low)
        np.minimum.at(root, root[dst], low)
        root = root[root]
        if (before == root).all():
            break
    out = np.flatnonzero(links)
    return node[out], links[out], node[root[out]]


def _sparse(group, within, block, node, copies, unit, keys, bucket, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of many small groups of rows at once: rows one apart, two apart and so on."""
    found = []
    for d in range(1, _FEW):
        a = np.flatnonzero(group[:-d] == group[d:])
        if not len(a):
            break
        a = a[within[a] | (block[a] != block[a + d])]
        a = a[np.einsum("ij,ij->i", unit[a], unit[a + d]) >= threshold]
        met = ((keys[a][:, :, None] == keys[a + d][:, None, :]) & (keys[a][:, :, None] < bucket[a][:, None, None])).any((1, 2))
        found.append(np.stack((a[~met], a[~met] + d)))
    a, b = np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)
    low = np.minimum(node[a], node[b])
    return np.concatenate((node[a], node[b])), np.concatenate((copies[b], copies[a])), np.concatenate((low, low))


def _compare(threshold: float, kind: str):
    """(node, links, root) of rows that come in order of (bucket, i, j): the pairs of each such group that are similar.

    A pair counts in the least bucket that it shares only, so no pair counts twice.
    """

    def compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
        wide = pa.compute.binary_length(t.column("vector")).to_numpy()
        for size in np.unique(wide):
            part = t.filter(pa.array(wide == size))
            bucket, i, j, block, node, copies = (part.column(c).to_numpy() for c in ("bucket", "i", "j", "block", "node", "copies"))
            unpacked = lambda name, of: np.frombuffer(b"".join(part.column(name).to_pylist()), of).reshape(part.num_rows, -1)  # noqa: B023, E731
            vectors, keys = unit_rows(unpacked("vector", kind)), unpacked("keys", np.int64)
            new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            rows = np.diff(np.append(first, len(group)))
            few = rows[group] <= _FEW
            out = [_sparse(group[few], (i == j)[few], block[few], node[few], copies[few], vectors[few], keys[few], bucket[few], threshold)]
            for g in np.flatnonzero(rows > _FEW):
                own = slice(first[g], first[g] + rows[g])
                side = block[own]
                sides = (np.flatnonzero(side == x) for x in (i[first[g]], j[first[g]]))
                out.append(_dense(node[own], copies[own], vectors[own], keys[own], bucket[first[g]], threshold, *sides))
            yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            keys = np.stack([t.column(c).to_numpy() for c in ("bucket", "i", "j")])
            changes = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            whole = int(changes[-1]) if len(changes) else 0
            if whole:
                yield from compared(t.slice(0, whole))
            held = t.slice(whole)  # the last group may go on
        if held is not None and held.num_rows:
            yield from compared(held)

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, how: Hashing | None = None, block: int = 1024
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Two vectors link if they share a bucket and their cosine is at least
    ``threshold``; equal vectors always link. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the least id reachable by links, itself
    included, and ``kept`` is whether that is the row's own id. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing.
    Vectors of different lengths don't link. A row with a null id takes part and
    has a null component only if all rows it reaches have null ids; it isn't
    kept. Repeated rows are linked as other rows are. An empty table gives no
    rows. Equal vectors are compared once. Large buckets are dealt out in blocks
    of about ``block`` vectors, one task for each pair of blocks. ``how`` follows
    from the number of distinct vectors and their dimension unless it is given.
    Vectors are told apart by a 128-bit hash. Components of any finite size do:
    lengths are taken after scaling. Other columns, of any names, aren't read.

    Buckets are found from (bucket, node) rows alone; vectors, packed as they
    came, go to the buckets of two nodes or more only.
    """
    scratch = Scratch(vectors.sparkSession, "embedding")
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    kind, sql_kind = ("<f4", "float") if single else ("<f8", "double")
    numbers = F.transform(F.col(vector_col), lambda v: v.cast(sql_kind) + F.lit(0.0).cast(sql_kind))
    finite = F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite & F.exists(numbers, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable, numbers).alias("v"))
    node = F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit(1), "v").alias("y"))
    rows = scratch.stash(rows.withColumn("class", F.when(F.col("v").isNotNull(), node)), "rows")
    # one vector a class, numbered by a part of its hash: the copies only differ in id
    classes = rows.filter("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.first("v").alias("v"))
    classes = scratch.stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    if how is None:
        found = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        how = Hashing.of(found[0], found[1] or 1)
    hashed = classes.select("node", "copies", "v").mapInArrow(_hashed(how), "node long, copies long, vector binary, keys binary, buckets array<long>")
    hashed = scratch.stash(hashed, "hashed")

    entries = hashed.select("node", F.explode("buckets").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = scratch.stash(sizes.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "buckets")
    placed = entries.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks")).cast("int"))
    # block k meets every block, itself included, once
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("bucket", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    placed = scratch.stash(placed, "placed")
    carried = placed.join(hashed.select("node", "copies", "vector", "keys"), "node")
    grouped = carried.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = scratch.stash(grouped.mapInArrow(_compare(threshold, kind), "node long, links long, root long"), "found")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select("node", "root"), "node", "root")
    nodes = classes.select("class", "node", "copies", "least").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).join(links, "node", "left")
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    known = nodes.join(least, "component").select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(known, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))
    )


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings, cosine 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = r"""
WITH RECURSIVE e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS r FROM e WHERE list_dot_product(v, v) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.9 * a.r * b.r),
reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.v),
comp AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT e.vec_id, CAST(coalesce(c.k, 0) AS BIGINT) AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY a) c ON c.a = e.vec_id JOIN comp ON comp.v = e.vec_id
"""
