"""Language-model scoring by cross-entropy difference.

A target model (from trusted documents) and a background model (from all
documents) are interpolated bigram models over one shared vocabulary: all words
of the corpus. A document's score is the mean over its words of the target's loss
minus the background's; lower is closer to the target.

Every word and bigram counts. A block is the encoded documents of a bounded size
of text. Blocks send their distinct words and bigrams to parts, which add up those
that several blocks hold and send the sums back. What only one block holds has its
counts there already. Blocks and parts have a bounded size; their number grows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.plans.scratch import Scratch

_BLOCK_BYTES = 24 << 20
#: Occurrences that a context's word frequencies count for beside its bigrams.
_PRIOR = 10.0
_START = 0xFFFFFFFF
_SENT = "part int, block long, at binary, key binary, counts binary"
_BACK = "block long, part int, bigrams boolean, at binary, ids binary, counts binary, kinds long, kinds_target long"


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers with their bytes by place value, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).reshape(-1).view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def _unpacked(data: pa.Scalar, kind) -> np.ndarray:
    data = data.as_py()
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


class _Block:
    """Documents as indices into the block's own words, in order of appearance."""

    def __init__(self):
        self.index: dict[bytes, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.ids, self.target, self.tokens, self.sizes, self.bytes = [], [], [], [], 0

    def add(self, key, text: bytes, target: bool) -> None:
        w = text.lower().split()
        self.tokens.append(np.fromiter(map(self.index.__getitem__, w), np.int32, len(w)))
        self.sizes.append(len(w))
        self.ids.append(key)
        self.target.append(target)
        self.bytes += len(text) + 64

    def row(self, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        sizes, target = np.array(self.sizes, np.int32), np.array(self.target, bool)
        hashes = b"".join(blake2b(w, digest_size=8).digest() for w in self.index)
        full = sizes > 0
        sums = [sizes.sum(), sizes[target].sum(), full.sum(), (full & target).sum()]
        columns = {
            "block": pa.array([number], pa.int64()), "ids": pa.array([self.ids], pa.list_(id_type)), "sizes": pa.array([_packed(sizes)], pa.binary()), "target": pa.array([_packed(target)], pa.binary()),
            "tokens": pa.array([_packed(np.concatenate(self.tokens))], pa.binary()), "hashes": pa.array([hashes], pa.binary()), "totals": pa.array([[int(x) for x in sums]], pa.list_(pa.int64())),
        }
        return pa.record_batch(list(columns.values()), names=list(columns))


def _encode(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, kind = _Block(), TaskContext.get().partitionId() << 24, pa.null()
        for b in batches:
            kind = b.column(0).type
            for key, text, target in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                block.add(key, text.as_py() or b"", target)
                if block.bytes >= block_bytes:
                    yield block.row(number, kind)
                    block, number = _Block(), number + 1
        if block.ids:
            yield block.row(number, kind)

    return run


def _opened(table: pa.Table | pa.RecordBatch, i: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, target, tokens) of a block."""
    of = lambda name, kind: _unpacked(table.column(name)[i], kind)
    return of("sizes", np.int32), of("target", bool), of("tokens", np.int32)


def _dealt(key: np.ndarray, parts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(parts, places of each part's keys in rising order)."""
    order = np.argsort(key, kind="stable")
    part = (((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts))[order]
    order = order[by := np.argsort(part, kind="stable")]
    found, first = np.unique(part[by], return_index=True)
    return found.astype(np.int32), np.split(order, first[1:]) if len(order) else []


def _by_part(block: int, parts: int, at: np.ndarray | None, key: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows for the parts: ``counts`` has a row for each kind of count. Without ``at`` the place in the part's keys stands for it."""
    found, cuts = _dealt(key, parts)
    binary = lambda values: pa.array([_packed(v) for v in values], pa.binary())
    places = pa.array([b""] * len(cuts), pa.binary()) if at is None else binary(at[c].astype(np.int32) for c in cuts)
    columns = [pa.array(found), pa.array([block] * len(cuts), pa.int64()), places, binary(np.diff(key[c], prepend=np.uint64(0)) for c in cuts), binary(counts[:, c].astype(np.uint32) for c in cuts)]
    return pa.record_batch(columns, names=["part", "block", "at", "key", "counts"])


def _word_tallies(sizes: np.ndarray, target: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """Occurrences of each word, and those with a word after them; of both the target's share."""
    last = np.zeros(len(tokens), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    of_target = np.repeat(target, sizes)
    return np.stack([np.bincount(tokens[m], minlength=n) for m in (slice(None), of_target, ~last, of_target & ~last)])


def _send_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                hashes = np.frombuffer(b.column("hashes")[i].as_py(), np.uint64)
                yield _by_part(b.column("block")[i].as_py(), parts, np.arange(len(hashes)), hashes, _word_tallies(*_opened(b, i), len(hashes)))

    return run


def _add_up(parts: int, bigrams: bool):
    """Sums of what two blocks or more have sent to a part, for each of these; words get a number of their own."""

    def run(sent: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in sent.column("key")]
        counts = [_unpacked(x, np.uint32).reshape(-1, len(k)) for x, k in zip(sent.column("counts"), keys, strict=True)]
        uniq, inverse, blocks = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        # sums of whole numbers, exact in double up to 2^53
        sums = np.stack([np.bincount(inverse, weights=c, minlength=len(uniq)) for c in np.concatenate(counts, axis=1)]).astype(np.int64)
        shared = blocks > 1
        part = sent.column("part")[0].as_py()
        ids = np.cumsum(shared) * parts + part
        if len(ids) and ids[-1] >= _START:
            raise ValueError("more words than 32-bit numbers")
        rows, start = [], 0
        for block, at, key in zip(sent.column("block").to_pylist(), sent.column("at"), keys, strict=True):
            own = inverse[start : start + len(key)]
            hit = shared[own]
            start += len(key)
            own = own[hit]
            at = np.arange(len(key), dtype=np.int32) if bigrams else _unpacked(at, np.int32)
            rows.append((block, part, bigrams, _packed(np.diff(at[hit], prepend=np.int32(0))), b"" if bigrams else _packed(ids[own].astype(np.uint32)), _packed(sums[:, own]), 0, 0))
        rows.append((-1, part, bigrams, b"", b"", b"", len(uniq), int((sums[1] > 0).sum())))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["block", "part", "bigrams", "at", "ids", "counts", "kinds", "kinds_target"])

    return run


def _block_bigrams(sizes: np.ndarray, target: np.ndarray, tokens: np.ndarray, n: int):
    """Distinct (first, second) of a block, the place of each token's in them, and counts; first is ``n`` at a beginning."""
    first = np.empty(len(tokens), np.int64)
    first[1:] = tokens[:-1]
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = n
    cells, inverse = np.unique(first * (n + 1) + tokens, return_inverse=True)
    counts = np.stack([np.bincount(inverse, minlength=len(cells)), np.bincount(inverse[np.repeat(target, sizes)], minlength=len(cells))])
    return cells // (n + 1), cells % (n + 1), inverse, counts


def _returned(back: pa.Table, bigrams: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, places, numbers, sums) that parts have sent to a block."""
    for part, kind, at, ids, counts in zip(back.column("part").to_pylist(), back.column("bigrams").to_pylist(), back.column("at"), back.column("ids"), back.column("counts"), strict=True):
        if kind == bigrams and at.as_py():
            at = np.cumsum(_unpacked(at, np.int32), dtype=np.int32)
            yield part, at, _unpacked(ids, np.uint32), _unpacked(counts, np.int64).reshape(-1, len(at))


def _shared_bigrams(first: np.ndarray, second: np.ndarray, back: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of bigrams that other blocks may hold: a word of this block only makes bigrams of this block only."""
    number = np.zeros(n + 1, np.uint64)
    number[n] = _START
    for _, at, ids, _ in _returned(back, False):
        number[at] = ids
    a, b = number[first], number[second]
    at = np.flatnonzero((a > 0) & (b > 0))
    return at, (a[at] << np.uint64(32)) | b[at]


def _send_bigrams(parts: int):
    def run(block: pa.Table, back: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("at", "key", "counts")}})
        sizes, target, tokens = _opened(block)
        n = int(tokens.max(initial=-1)) + 1
        first, second, _, counts = _block_bigrams(sizes, target, tokens, n)
        at, key = _shared_bigrams(first, second, back, n)
        return pa.Table.from_batches([_by_part(block.column("block")[0].as_py(), parts, None, key, counts[:, at])])

    return run


def _score_block(parts: int, totals: list[int], kinds: int, kinds_target: int, id_col: str):
    """Losses of a block's documents. A target word's probability is drawn to the background's, a bigram's to its second word's."""

    def run(block: pa.Table, back: pa.Table) -> pa.Table:
        ids = block.column("ids").combine_chunks().flatten()
        if not block.num_rows:
            return pa.table([ids, pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())], names=[id_col, "n_words", "target_loss", "background_loss"])
        sizes, target, tokens = _opened(block)
        n = int(tokens.max(initial=-1)) + 1
        words = _word_tallies(sizes, target, tokens, n)
        first, second, inverse, cells = _block_bigrams(sizes, target, tokens, n)
        for _, at, _, sums in _returned(back, False):
            words[:, at] = sums
        places, key = _shared_bigrams(first, second, back, n)
        sent = dict(zip(*(x.tolist() if isinstance(x, np.ndarray) else x for x in _dealt(key, parts)), strict=True))
        for part, at, _, sums in _returned(back, True):
            cells[:, places[sent[part][at]]] = sums
        context = np.concatenate((words[2:], [[totals[2]], [totals[3]]]), axis=1)
        base = (words[0] + 0.5) / (totals[0] + 0.5 * kinds)
        near = (words[1] + kinds_target * base) / (totals[1] + kinds_target) if totals[1] else base
        means, full = [], sizes > 0
        starts = (np.cumsum(sizes) - sizes)[full]
        for k, uni in ((1, near), (0, base)):
            loss = -np.log((cells[k] + _PRIOR * uni[second]) / (context[k, first] + _PRIOR))
            out = np.zeros(len(sizes))
            out[full] = np.add.reduceat(loss[inverse], starts) / sizes[full] if len(starts) else 0
            means.append(pa.array(out, mask=~full))
        return pa.table([ids, pa.array(sizes.astype(np.int64)), *means], names=[id_col, "n_words", "target_loss", "background_loss"])

    return run


def corpus_scores(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """(``id_col``, n_words, target_loss, background_loss, ce_difference) of each row of ``docs``.

    ``target_ids`` (one column ``id_col``) names the target's documents; without
    any its model is the corpus's word frequencies. The models hold all words and bigrams of all
    documents, without a limit. Words are compared in lower case (A-Z) and told
    apart by a 64-bit hash. Losses are in nats a word, and null for texts that are
    null, empty or without words. Texts count whole at any length; equal texts
    have equal scores, and repeated rows count as often as they stand there. Rows
    with a null id aren't of the target. An empty table gives an empty result.
    ``block_bytes`` is what a task encodes at once; scores don't depend on it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    id_type = docs.schema[id_col].dataType.simpleString()
    marks = target_ids.select(F.col(id_col).alias("id")).filter("id is not null").distinct().select("id", F.lit(0).alias("deal"), F.lit(True).alias("target"))
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # rows without an id have no match, and are dealt out by their text
    keyed = keyed.withColumn("deal", F.when(F.col("id").isNull(), F.hash("text")).otherwise(0))
    # target_ids has no bound, so it is never broadcast: the join is a sort-merge one at every size
    flagged = keyed.join(marks.hint("merge"), ["id", "deal"], "left").select("id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    blocks = scratch.stash(flagged.mapInArrow(_encode(block_bytes), f"block long, ids array<{id_type}>, sizes binary, target binary, tokens binary, hashes binary, totals array<long>"), "blocks")
    sums = blocks.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in range(4))).first()
    parts, totals = max(1, sums[0]), list(sums[1:])
    sent = blocks.select("block", "sizes", "target", "tokens", "hashes").mapInArrow(_send_words(parts), _SENT)
    words = scratch.stash(sent.groupBy("part").applyInArrow(_add_up(parts, False), _BACK), "words")
    kinds = words.agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("kinds_target"), F.lit(0))).first()
    for_blocks = lambda t: t.filter("block >= 0").select("block", "part", "bigrams", "at", "ids", "counts").groupBy("block")
    sent = blocks.select("block", "sizes", "target", "tokens").groupBy("block").cogroup(for_blocks(words)).applyInArrow(_send_bigrams(parts), _SENT)
    bigrams = scratch.stash(sent.groupBy("part").applyInArrow(_add_up(parts, True), _BACK), "bigrams")
    scored = blocks.select("block", "ids", "sizes", "target", "tokens").groupBy("block").cogroup(for_blocks(words.union(bigrams)))
    out = scored.applyInArrow(_score_block(parts, totals, kinds[0], kinds[1], id_col), f"`{id_col}` {id_type}, n_words long, target_loss double, background_loss double")
    return out.withColumn("ce_difference", F.col("target_loss") - F.col("background_loss"))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents against a target of those labelled of good quality and not toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")
    return corpus_scores(docs, good)
