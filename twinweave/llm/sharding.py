"""Sharding by a two-pass external shuffle.

Pass 1 scatters records uniformly into memory-sized buckets by a seeded hash.
Pass 2 puts each bucket in a canonical order, Fisher-Yates shuffles it and cuts
the global sequence into shards of consecutive rows, so shard sizes differ by
at most one row (law ``rows``) and each bucket touches one or two shards only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.llm.words import unused
from twinweave.plans.scratch import Scratch


def record_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _fisher_yates(seed: int):
    """Column function (bucket, rows in the bucket, place in canonical order) -> shuffled place.

    A bucket's permutation follows from the seed, its number and its size, so
    only these integers reach Python and the records stay where they are.
    """

    def shuffled(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held: tuple[int, np.ndarray] = (-1, np.empty(0, np.int64))
        for bucket, n, place in columns:
            bucket, n, place = bucket.to_numpy(), n.to_numpy(), place.to_numpy()
            out = np.empty(len(bucket), np.int64)
            for k in np.unique(bucket):
                own = bucket == k
                if held[0] != k:
                    order = np.arange(n[own][0])
                    np.random.default_rng([seed, int(k)]).shuffle(order)  # numpy's in-place Fisher-Yates
                    held = (int(k), order)
                out[own] = held[1][place[own]]
            yield pa.array(out)

    return F.arrow_udf(shuffled, "bigint")


def _spread_copies(rows: DataFrame, draw: str) -> DataFrame:
    """``rows`` with a draw of its own for each copy of a key and text; the first keeps the one it has.

    Draws that repeat are found first, from the draws alone; where ids are
    unique there are none, and that is all. Copies are numbered by the partition
    they are in and their place among the copies there, so a group of any size
    is numbered by many tasks.
    """
    again, part, copy, before = unused(rows, "draw_again", "draw_part", "draw_copy", "draws_before")
    repeated = rows.groupBy(draw).agg(F.count(F.lit(1)).alias(copy)).filter(F.col(copy) > 1).select(F.col(draw).alias(again))
    repeated = Scratch(rows.sparkSession, "sharding").stash(repeated, "repeated")
    if repeated.isEmpty():
        return rows
    marked = rows.withColumn(part, F.spark_partition_id()).join(repeated, F.col(draw) == F.col(again), "left")
    single, several = marked.filter(F.col(again).isNull()), marked.filter(F.col(again).isNotNull())
    counts = several.groupBy(F.col(draw).alias(again + "_"), F.col(part).alias(part + "_")).agg(F.count(F.lit(1)).alias(copy))
    offsets = counts.withColumn(before, F.sum(copy).over(Window.partitionBy(again + "_").orderBy(part + "_")) - F.col(copy)).drop(copy)
    numbered = several.withColumn(copy, F.row_number().over(Window.partitionBy(draw, part).orderBy(F.lit(0))) - 1)
    # left: were the partitions of a second reading others, copies would share draws, and none be lost
    numbered = numbered.join(offsets, (F.col(draw) == F.col(again + "_")) & (F.col(part) == F.col(part + "_")), "left")
    number = F.col(copy) + F.coalesce(before, F.lit(0))
    numbered = numbered.withColumn(draw, F.when(number > 0, F.xxhash64(F.col(draw), number)).otherwise(F.col(draw)))
    return single.select(*rows.columns).unionByName(numbered.select(*rows.columns))


def shuffle_into_shards(
    docs: DataFrame,
    n_shards: int,
    key: Sequence[str] = ("doc_id",),
    seed: int = 17,
    bucket_rows: int = 20_000,
    bucket_bytes: int = 16 << 20,
    text_col: str = "text",
) -> DataFrame:
    """``docs`` plus ``shard`` (0..n_shards-1) and ``slot`` (gapless from 0 in each shard).

    The scatter hash is of ``key`` and the text, so copies of a text under
    different keys spread over all buckets, and of the number of the copy where
    key and text repeat: such rows are interchangeable, and spread too. Nulls
    hash like any value. An empty table gives an empty result. Columns named like
    the two outputs are replaced, others of any names are kept. A text of any
    length is one record. Buckets hold ``bucket_bytes`` of text and
    ``bucket_rows`` rows on average; a task sorts and shuffles many buckets in
    turn, as there may be more of them than a shuffle can have partitions. A
    row's place follows from the rows, the seed and the parameters only, not from
    the session or the partitions that the rows come in.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    docs = docs.drop("shard", "slot")
    stats = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    n_buckets = max(1, -(-stats[0] // bucket_rows), -(-(stats[1] or 0) // bucket_bytes))
    bucket, n, start, total, draw, place = unused(docs, "bucket", "in_bucket", "bucket_start", "n_rows", "scatter", "place")
    scattered = docs.withColumn(draw, F.xxhash64(F.lit(seed), *key, F.xxhash64(text_col)))
    scattered = _spread_copies(scattered, draw).withColumn(bucket, F.pmod(draw, F.lit(n_buckets)))
    # One row for each bucket, never for each record.
    counts = scattered.groupBy(bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(bucket, n, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start), F.sum(n).over(everything).alias(total))
    order = Window.partitionBy(bucket).orderBy(draw)
    tasks = min(n_buckets, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = scattered.repartition(tasks, bucket).join(starts, bucket).withColumn(place, F.row_number().over(order) - 1)
    placed = placed.withColumn(place, F.col(start) + _fisher_yates(seed)(bucket, n, place))
    shard = F.expr(f"({place} * {n_shards}) div {total}")
    first = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.col(place) - first)
    return placed.select(*docs.columns, F.col("shard").cast("int"), "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Parquet under ``path/shard=K/``; rows of a file are in slot order.

    ``slot`` stays a column: readers that need the full order sort by it.
    """
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``shuffle_into_shards`` over all documents: 40 shards, law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shuffle_into_shards(docs, 40)
    return out.select(
        "doc_id",
        record_bytes("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
