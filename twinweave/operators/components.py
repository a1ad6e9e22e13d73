"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.plans.scratch import Scratch


def _star(sym: DataFrame, smaller_only: bool) -> DataFrame:
    """One star step over (u, v): hang neighbours of ``u`` on the least node of its neighbourhood.

    The least neighbour is a partial aggregate and the join back is an inner
    equi-join, so a hub node is pre-aggregated and then split by AQE.
    """
    low = sym.groupBy("u").agg(F.min("v").alias("low"))
    if smaller_only:
        near = sym.join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        return near.union(low.select(F.col("u").alias("a"), F.col("low").alias("b")))
    low = low.select("u", F.least("u", "low").alias("low"))
    return sym.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node id.

    A small-star step, then alternating large-star and small-star steps: the edge table never grows past
    its first size and the number of rounds is logarithmic in the longest path.
    Each round is written to the shared folder; the driver only sees a row count
    and a checksum. Null ends and self-loops are ignored (a node with only a
    self-loop has no row). Empty input gives an empty result.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    pairs = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).filter("x is not null and y is not null and x <> y")
    edges = scratch.stash(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")), "edges")
    # a small star first: it reads an edge at one end, and leaves of a clique a star
    cur = scratch.stash(_star(edges, True).filter("a <> b").distinct(), "stars")
    scratch.drop(edges)
    mark = F.xxhash64("a", "b").cast("decimal(20,0)")
    last = None
    for _ in range(max_rounds):
        sym = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(sym, False).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        nxt = scratch.stash(_star(down, True).filter("a <> b").distinct(), "stars")
        now = nxt.agg(F.count(F.lit(1)), F.sum(mark)).first()
        scratch.drop(cur)
        cur = nxt
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
