"""Substring de-duplication by content-defined chunking.

A gear rolling hash over the last 16 bytes picks chunk ends where it is the
least hash within 16 bytes on either side, so ends depend on nearby bytes only
and an insertion shifts chunks without changing those beyond it. Chunks are
compared by digest; of equal chunks the first (least document id, then place)
stays. Runs of adjacent repeated chunks that are long enough are duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.llm.words import unused
from twinweave.plans.scratch import Scratch

_RADIUS = 16
_GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(b: np.ndarray) -> np.ndarray:
    """Gear hash of the 16 bytes that end at each place: the sum of gear[byte] << distance, by doubling."""
    h = _GEAR[b]
    for span in (1, 2, 4, 8):
        if len(h) > span:
            longer = h.copy()
            longer[span:] += h[:-span] << np.uint32(span)
            h = longer
    return h


def _least_before(h: np.ndarray) -> np.ndarray:
    """Least of the 16 values before each place (the largest value where there are none)."""
    m = np.concatenate((np.full(_RADIUS, np.uint32(0xFFFFFFFF)), h[:-1] if len(h) else h))
    for span in (1, 2, 4, 8):
        m = np.minimum(m, np.concatenate((m[:1].repeat(span), m[:-span])))
    return m[_RADIUS - 1 :][: len(h)]


def chunk_ends(text: bytes, longest: int = 128) -> list[int]:
    """Ends of the chunks of ``text``, the last one its length; none for empty text. Ends fall on character bounds."""
    n = len(text)
    if n == 0:
        return []
    b = np.frombuffer(text, np.uint8)
    h = gear_hashes(b)
    # A place whose next byte continues a character can't end a chunk.
    h[:-1][(b[1:] & 0xC0) == 0x80] = 0xFFFFFFFF
    left, right = _least_before(h), _least_before(h[::-1])[::-1]
    ends = np.flatnonzero((h < left) & (h <= right) & (h != 0xFFFFFFFF)) + 1
    out, at = [], 0
    for e in [*ends.tolist(), n]:
        while e - at > longest:
            at += longest
            while at < e and b[at] & 0xC0 == 0x80:
                at += 1
            if at < e:
                out.append(at)
        if e > at:
            out.append(e)
        at = e
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, keys, starts, ends, digests, again = [], [], [], [], [], []
        for i, key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            text = t.as_py() or b""
            cuts = chunk_ends(text)
            seen: set[bytes] = set()
            at = 0
            for e in cuts:
                d = blake2b(text[at:e], digest_size=8).digest()
                again.append(d in seen)
                seen.add(d)
                digests.append(d)
                at = e
            docs.extend([i] * len(cuts))
            keys.extend([key] * len(cuts))
            starts.extend([0, *cuts[:-1]] if cuts else [])
            ends.extend(cuts)
            if len(docs) > 500_000:
                yield _batch(docs, keys, starts, ends, digests, again)
                docs, keys, starts, ends, digests, again = [], [], [], [], [], []
        yield _batch(docs, keys, starts, ends, digests, again)


def _batch(docs, keys, starts, ends, digests, again) -> pa.RecordBatch:
    digest = np.frombuffer(b"".join(digests), "<i8")
    columns = [pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(digest, pa.int64()), pa.array(again, pa.bool_())]
    return pa.record_batch(columns, names=["id", "text_key", "start", "end", "digest", "again"])


def text_key(text: str | Column) -> Column:
    """Hash by which a span names its text among those of one id."""
    return F.xxhash64(text)


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 120) -> DataFrame:
    """(id, text_key, start_byte, end_byte, first_id): spans of whole chunks that stand earlier, in this or another document.

    ``text_key`` is the hash of the text that the span is in, see ``text_key``.
    ``first_id`` is the least document that holds the span's first chunk, or the
    document itself where that chunk stands earlier in it. A span
    is at least ``min_bytes`` long; a passage loses at most the parts of chunks
    at its two ends. Null, empty and short texts have no spans, and texts of any
    length are taken whole. Rows with a null id take no part. Rows that share an
    id are one document, so a repeated row isn't a copy of itself, and passages
    that only they share stay. An empty table gives no rows. Chunks are equal if
    their 64-bit digests are.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    chunks = scratch.stash(keyed.mapInArrow(_chunks, "id long, text_key long, start int, end int, digest long, again boolean"), "chunks")
    firsts = chunks.filter("not again").groupBy("digest").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    firsts = scratch.stash(firsts.filter("first_id <> last_id").select("digest", "first_id"), "firsts")
    across = chunks.filter("not again").join(firsts, "digest").filter("id <> first_id").select("id", "text_key", "start", "end", "first_id")
    within = chunks.filter("again").select("id", "text_key", "start", "end", F.col("id").alias("first_id"))
    repeated = across.union(within).groupBy("id", "text_key", "start", "end").agg(F.min("first_id").alias("first_id"))
    order = Window.partitionBy("id", "text_key").orderBy("start", "end")
    opens = F.when(F.col("start") == F.lag("end").over(order), 0).otherwise(1)
    runs = repeated.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order))
    spans = runs.groupBy("id", "text_key", "run").agg(
        F.min("start").alias("start_byte"), F.max("end").alias("end_byte"), F.min_by("first_id", "start").alias("first_id")
    )
    return spans.filter(F.col("end_byte") - F.col("start_byte") >= min_bytes).select(F.col("id").alias(id_col), "text_key", "start_byte", "end_byte", "first_id")


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str | None = None) -> DataFrame:
    """``docs`` with the spans cut out of their texts; texts without spans stay as they are.

    A span counts for rows of its id and text only, so rows that share an id and
    differ in text are cut apart, and repeated rows alike. Null and empty texts
    and rows with a null id stay. Columns of any names are kept. ``mark`` names a
    boolean column to add: whether the row's text was cut. Without spans or rows
    the result is ``docs``.
    """
    own, key, cuts = unused(docs, "span_id", "span_text", "span_cuts")
    per_doc = spans.groupBy(F.col(id_col).alias(own), F.col("text_key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias(cuts))
    both = docs.join(per_doc, (docs[id_col] == per_doc[own]) & (text_key(docs[text_col]) == per_doc[key]), "left")
    raw = F.encode(F.col(text_col), "UTF-8")
    n = F.size(cuts)
    pieces = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.substring(
            raw,
            F.coalesce(F.get(cuts, i - 1)["end_byte"], F.lit(0)) + 1,
            F.coalesce(F.get(cuts, i)["start_byte"], F.octet_length(text_col)) - F.coalesce(F.get(cuts, i - 1)["end_byte"], F.lit(0)),
        ),
    )
    joined = F.decode(F.unhex(F.array_join(F.transform(pieces, lambda p: F.hex(p)), "")), "UTF-8")
    both = both.withColumn(text_col, F.when(F.col(cuts).isNotNull(), joined).otherwise(F.col(text_col)))
    if mark:
        both = both.withColumn(mark, F.col(cuts).isNotNull())
    return both.select(*docs.columns, *[mark] * bool(mark))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Duplicate spans of all documents."""
    return duplicate_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
