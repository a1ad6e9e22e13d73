"""N-gram Jaccard self-join by universe partitions, exact.

Documents become sets of word shingles. Sets fall into size bands; for a pair
whose larger set is in band k, the symmetric difference is at most H(k), so if
the shingle universe is hashed into segments with allocations a_i whose sum is
at least H + 1 + slack, segments of total allocation above the slack differ in
fewer than a_i shingles. Allocation 1 indexes the segment's subset itself;
allocation 2 also indexes its one-deletion neighbourhood; allocation 0 leaves a
segment out. The split of a band into segments is chosen by cost. A set may
leave out empty segments up to the slack, and costly ones (whose subset very
many sets share, say a common passage) with what then remains of the slack: a
pair that agrees there agrees elsewhere too.

Equal sets are one node. Nodes that share a signature are candidates: in small
buckets all of them, in large ones each with a hub, in rounds. Sets that have
more costly segments than their slack allows, and whose large buckets still hold
several components, are met in segments of one shingle, rare ones first. Parity
bitmaps bound the difference of a pair from below and drop most candidates; the
others are verified on whole sets.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.operators.components import connected_components
from twinweave.plans.scratch import Scratch

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_WORD_CACHE = 200_000
_BAND_RATIO = 1.5
_STAR_ROUNDS = 2
_HUB_ORDERS = 3
_FEW = 24
#: Signatures are indexed in so many turns, by their hash, so that a part of them is on disk at once.
_TURNS = 4
#: Buckets of at most so many nodes compare all pairs.
_SMALL = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M1
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hash of a word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORD_CACHE:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


_hash_of = _WordHashes()


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; ASCII letters lower-cased; a shorter text is one shingle; empty without words."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, w), np.uint64, len(w))
    k = min(width, len(w))
    acc = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        acc = _mix(acc * _M1 + h[i : len(w) - k + 1 + i])
    return np.unique(acc)


def bands(up_to: int) -> list[int]:
    """Least size of each band: 1, 2, 3, 4, 6, 9, ..."""
    lows = [1]
    while lows[-1] <= up_to:
        lows.append(max(lows[-1] + 1, int(lows[-1] * _BAND_RATIO)))
    return lows


_LOWS = bands(1 << 40)


@lru_cache(maxsize=None)
def allocation(band: int, percent: int) -> tuple[int, int, int]:
    """(segments, of which the first q have allocation 2, slack) for pairs whose larger set is in the band.

    Cost: signatures emitted for a set of the band's largest size, plus a charge
    for segments so small that unlike sets share them. Deletions may not make
    large sets emit more than one signature a unit of allocation.
    """
    top = _LOWS[band + 1] - 1
    most = 2 * top * (100 - percent) // (100 + percent)
    slack = max(2, most // 8)
    need = most + 1 + slack
    emitted = lambda q: (need - q) + q * top / (need - q)
    cost = lambda q: emitted(q) + 400 * (need - q) * math.exp(-top / (need - q))
    q = min((q for q in range(need // 2 + 1) if q == 0 or emitted(q) <= max(_FEW, need)), key=cost)
    return need - q, q, slack


def signatures(s: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Signatures of a set in its own band and in each higher band where a partner may be the larger set.

    With them the spare slack: in each band, so many signatures may be left out
    besides the empty segments.
    """
    n = len(s)
    if not n:
        return np.empty(0, np.int64), 0
    out, spare = [], 1 << 30
    band = bisect_right(_LOWS, n) - 1
    mixed = _mix(s)
    while _LOWS[band] * percent <= 100 * n or _LOWS[band] <= n:
        m, q, slack = allocation(band, percent)
        seg = (_mix(s ^ np.uint64(band + 1)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed[order])))
        ends = np.searchsorted(seg[order], np.arange(m + 1))
        sums = total[ends[1:]] - total[ends[:-1]]
        empty = (ends[1:] == ends[:-1]) & (np.arange(m) >= q)
        name = _mix((np.arange(m, dtype=np.uint64) + np.uint64(1)) * _M1 + np.uint64(band))
        own = _mix(sums * _M2 + name)
        out.append(own[~empty] if empty.sum() <= slack else own)
        spare = min(spare, max(0, slack - int(empty.sum())) // (2 if q else 1))
        if q:
            near = seg < q
            out.append(_mix((sums[seg[near]] - mixed[near]) * _M2 + name[seg[near]]))
        band += 1
    return np.unique(np.concatenate(out)).view(np.int64), spare


def parity(s: np.ndarray) -> np.ndarray:
    """Bitmap of at least as many bits as the set has shingles, a power of two; a bit is the parity of its shingles."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    ones = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view("<i8")


def node_of(s: np.ndarray) -> int | None:
    """One id for equal sets; null for the empty set."""
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def _lists(parts: list[np.ndarray], keep: np.ndarray | None = None) -> pa.ListArray:
    """A list for each array, of its values where ``keep`` holds for all of them in a row."""
    sizes = np.array([len(x) for x in parts], np.int64)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    if keep is not None:
        sizes = np.bincount(np.repeat(np.arange(len(parts)), sizes)[keep], minlength=len(parts))
        flat = flat[keep]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat, pa.int64()))


_SKETCH = "id long, n long, node long, spare int, bits array<long>, " + ", ".join(f"sigs{k} array<long>" for k in range(_TURNS))


def _sketch(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, nodes, spares, bits, sigs = [], [], [], [], []
            for t in b.column(1).cast(pa.binary()):
                s = shingle_set(t.as_py(), width)
                found, spare = signatures(s, percent)
                sizes.append(len(s))
                nodes.append(node_of(s))
                spares.append(spare)
                bits.append(parity(s) if len(s) else np.empty(0, np.int64))
                sigs.append(found)
            turn = (np.concatenate(sigs) if sigs else np.empty(0, np.int64)) % _TURNS
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(spares, pa.int32()), _lists(bits)]
            columns += [_lists(sigs, turn == k) for k in range(_TURNS)]
            yield pa.record_batch(columns, names=["id", "n", "node", "spare", "bits", *(f"sigs{k}" for k in range(_TURNS))])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py(), width) for t in b.column(1).cast(pa.binary())]
            keep = [i for i, s in enumerate(found) if node_of(s) == b.column(0)[i].as_py()]
            arrays = pa.array([found[i].view(np.int64) for i in keep], pa.list_(pa.int64()))
            yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int32())), arrays], names=["node", "set"])

    return run


def _near_size(x: str, y: str, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _differing_bits(x: str, y: str):
    """Bits in which two parity bitmaps differ, the longer one folded; never more than the shingles that one set only has."""

    def folded(of: str, to: str):
        every = lambda i: F.sequence(i, F.size(of) - 1, F.size(to))
        halves = F.transform(F.sequence(F.lit(0), F.size(to) - 1), lambda i: F.aggregate(every(i), F.lit(0).cast("long"), lambda a, j: a.bitwiseXOR(F.get(of, j))))
        return F.when(F.size(of) > F.size(to), halves).otherwise(F.col(of))

    return F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) whose parity bitmaps don't differ in more bits than similar sets may in shingles."""
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    both = pairs.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    return both.filter((100 + percent) * _differing_bits("bitsa", "bitsb") <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity is at least percent / 100."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", same.alias("same"), (F.size("sa") + F.size("sb")).alias("total"))
    return both.filter((100 + percent) * F.col("same") >= percent * F.col("total")).select("a", "b")


def _buckets(placed: DataFrame, r: int) -> DataFrame:
    """(sig, size, hub) of buckets that hold more than one component.

    Hubs are the first by a seeded order of nodes, of which there are a few, so
    a group that shares many buckets has few hubs and its members meet each once.
    """
    order = F.xxhash64(F.lit(r), F.pmod("sig", F.lit(_HUB_ORDERS)), "node")
    hub = F.min_by(F.struct("node", "n", "comp"), order).alias("hub")
    found = placed.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), hub)
    return found.filter("lo <> hi").select("sig", "size", "hub")


def _star_pairs(placed: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a member of a large bucket and the bucket's hub, in different components."""
    met = placed.join(buckets.filter(F.col("size") > _SMALL).select("sig", "hub"), "sig")
    pairs = met.filter((F.col("comp") != F.col("hub.comp")) & _near_size("n", "hub.n", percent))
    return pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))


def _small_pairs(placed: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one small bucket, in different components."""
    met = placed.join(buckets.filter(F.col("size") <= _SMALL).select("sig"), "sig")
    other = met.select("sig", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    pairs = met.join(other, "sig").filter((F.col("node") < F.col("b")) & (F.col("comp") != F.col("cb")) & _near_size("n", "nb", percent))
    return pairs.select(F.col("node").alias("a"), "b")


def _rare_shingles(scratch: Scratch, open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, comp, place, shingle): of each open node so many of its rarest shingles that similar sets share one.

    These are segments of one shingle, with allocation 0 from the common ones on:
    in any one order of shingles, sets of similarity J that differ in all of
    their first n - ceil(J n) + 1 shingles can't be similar; rare ones first, a
    passage that many texts share brings none of them together.
    """
    each = sets.select("node", F.explode("set").alias("shingle"))
    held = scratch.stash(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "held")
    by_node = each.join(held, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("s"))
    # shingles of one open node come before all others and have no partner
    by_node = by_node.join(open_, "node").withColumn("alone", F.col("n") - F.size("s"))
    first = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - F.col("alone")
    picked = F.posexplode(F.slice("s", F.lit(1), F.greatest(F.lit(0), first).cast("int"))).alias("pos", "x")
    return by_node.select("node", "n", "comp", "alone", picked).select("node", "n", "comp", (F.col("alone") + F.col("pos")).alias("place"), "x.shingle")


def _rare_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open nodes in different components that share a rare shingle."""
    other = rare.select("shingle", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("place").alias("pb"))
    # from their first common shingle on, both must hold enough of theirs to reach the similarity
    reach = F.least(F.col("n") - F.col("place"), F.col("nb") - F.col("pb"))
    crossed = rare.join(other, "shingle").filter(
        (F.col("node") < F.col("b")) & (F.col("comp") != F.col("cb")) & ((100 + percent) * reach >= percent * (F.col("n") + F.col("nb")))
    )
    return crossed.select(F.col("node").alias("a"), "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Two documents link when their sets' similarity reaches ``percent`` / 100;
    ``component_id`` is the least id reachable by links, itself included.
    Null, empty and blank texts have empty sets and link with nothing, as do
    rows with a null id (their component is null). Equal sets link. Repeated
    rows share a component. An empty table gives no rows. The whole text counts
    at any length. Equality of sets and shingles is that of 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession, "ngram")
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = scratch.stash(keyed.mapInArrow(_sketch(width, percent), _SKETCH), "sketch")
    linked = sketch.filter("node is not null and id is not null")

    # Rows of buckets with two nodes or more.
    turns = []
    for k in range(_TURNS):
        rows = linked.select("node", "n", F.explode(f"sigs{k}").alias("sig"))
        shared = rows.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("sig")
        shared = scratch.stash(shared, "shared")
        turns.append(scratch.stash(rows.join(shared, "sig").distinct(), "members"))
        scratch.drop(shared)
    members = reduce(DataFrame.union, turns)
    base = scratch.stash(sketch.select("id", "n", "node"), "sizes")
    nodes = linked.groupBy("node").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", "spare", "bits")))
    nodes = scratch.stash(nodes, "nodes")
    scratch.drop(sketch)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Whole sets of nodes, from one document each."""
        texts = keyed.join(nodes.join(wanted.distinct(), "node").select("node", "id"), "id").select("node", "text")
        return texts.mapInArrow(_sets(width), "node long, set array<long>").dropDuplicates(["node"])

    def linked_pairs(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        near = scratch.stash(_possible(pairs, nodes, percent), "possible")
        sets = sets or scratch.stash(sets_of(near.select(F.col("a").alias("node")).union(near.select("b"))), "sets")
        found = scratch.stash(_verified(near, sets, percent), "links")
        scratch.drop(near)
        scratch.drop(sets)
        return found

    placed, links = members.withColumn("comp", F.col("node")), None
    for r in range(_STAR_ROUNDS):
        buckets = scratch.stash(_buckets(placed, r), "buckets")
        pairs = _star_pairs(placed, buckets, percent)
        found = linked_pairs(pairs if r else pairs.union(_small_pairs(placed, buckets, percent)))
        links = found if links is None else links.union(found)
        final = connected_components(links, "a", "b")
        scratch.drop(buckets)
        labelled = members.join(final.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        before, placed = placed, scratch.stash(labelled, "placed")
        scratch.drop(before)

    # What is left, say texts of which a very common passage is the greater part.
    costly = placed.join(_buckets(placed, 0).filter(F.col("size") > _SMALL).select("sig"), "sig")
    open_ = costly.groupBy("node").agg(F.count(F.lit(1)).alias("costly"), F.first("n").alias("n"), F.first("comp").alias("comp"))
    open_ = open_.join(nodes.select("node", "spare"), "node").filter("costly > spare").select("node", "n", "comp")
    open_ = scratch.stash(open_, "open")
    sets = scratch.stash(sets_of(open_.select("node")), "open-sets")
    rare = scratch.stash(_rare_shingles(scratch, open_, sets, percent), "rare")
    final = connected_components(links.union(linked_pairs(_rare_pairs(rare, percent), sets)), "a", "b")

    grouped = nodes.select("node", "id").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    of_node = grouped.join(least, "component").select("node", "component_id")
    out = base.join(of_node, "node", "left")
    own = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9, all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM d),
tok AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tok a JOIN tok b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM sets UNION SELECT sym.b, reach.r FROM reach JOIN sym ON sym.a = reach.v)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(r) AS component_id FROM sets JOIN reach ON reach.v = sets.doc_id GROUP BY sets.doc_id, s
"""
