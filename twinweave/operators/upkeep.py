"""Groups that are kept up to date as edges and files come and go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.operators.components import connected_components
from twinweave.plans.scratch import Scratch
from twinweave.sources.keyed_store import KeyedStore

LABELS = "node long, component long"
EDGES = "component long, a long, b long"


class KeptComponents:
    """The components of a growing and shrinking edge table, in two keyed stores.

    ``labels`` has each node's component by node, ``edges`` each edge by its
    component. An update looks up the nodes that it names and reads the edges of
    their components alone: those that lose something are computed anew, and
    added edges merge labels by the components of a graph of labels. A node
    without an edge has no row, as in ``connected_components``.
    """

    def __init__(self, spark, path: str, buckets: int = 64):
        self.spark = spark
        self.labels = KeyedStore(spark, f"{path}/labels", LABELS, ["node"], buckets)
        self.edges = KeyedStore(spark, f"{path}/edges", EDGES, ["component"], buckets)

    def read(self) -> DataFrame:
        """(node, component); the component is its least node."""
        return self.labels.read()

    def update(self, added: DataFrame | None = None, removed_nodes: DataFrame | None = None, removed_edges: DataFrame | None = None, source: str = "", number: int | None = None) -> None:
        """Apply removals, then additions: ``added`` and ``removed_edges`` have (a, b) in either order, ``removed_nodes`` has (node).

        Null ends and loops are ignored, and repeated edges are one. A batch that
        died half-way or comes again under its ``number`` leaves the same tables.
        """
        scratch = Scratch(self.spark, "upkeep")
        pairs = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct()
        none = self.spark.createDataFrame([], "a long, b long")
        new = scratch.stash(pairs(added) if added is not None else none, "added")
        cut = scratch.stash(pairs(removed_edges) if removed_edges is not None else none, "cut")
        gone = scratch.stash((removed_nodes if removed_nodes is not None else none.select(F.col("a").alias("node"))).select("node").filter("node is not null").distinct(), "gone")
        version = self.labels.base(source, number)
        ends = lambda df: df.select(F.col("a").alias("node")).union(df.select(F.col("b").alias("node")))
        named = scratch.stash(ends(new).union(ends(cut)).union(gone).distinct(), "named")
        known = scratch.stash(self.labels.lookup(named, version), "known")
        touched = scratch.stash(known.select("component").distinct(), "touched")
        before = scratch.stash(self.edges.lookup(touched, self.edges.base(source, number)), "before")
        # components that lose an edge or a node fall apart as their own edges say
        losing = known.join(ends(cut).union(gone).distinct(), "node", "left_semi").select("component").distinct()
        kept = before.join(cut, ["a", "b"], "left_anti").join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
        nothing = self.spark.createDataFrame([], LABELS)
        whole_stays = cut.isEmpty() and gone.isEmpty()
        parts = nothing if whole_stays else connected_components(kept.join(losing, "component", "left_semi"), "a", "b")
        intact = before.join(losing, "component", "left_anti")
        whole = intact.select(F.col("a").alias("node"), "component").union(intact.select(F.col("b").alias("node"), "component")).distinct()
        after = scratch.stash(parts.unionByName(whole), "after")
        # added edges between labels; a node that is new is its own label
        label = lambda side: after.select(F.col("node").alias(side), F.col("component").alias(f"label_{side}"))
        placed = new.join(label("a"), "a", "left").join(label("b"), "b", "left")
        placed = scratch.stash(placed.select("a", "b", F.coalesce("label_a", "a").alias("x"), F.coalesce("label_b", "b").alias("y")), "placed")
        merged = (nothing if new.isEmpty() else connected_components(placed.select("x", "y"), "x", "y")).select(F.col("node").alias("component"), F.col("component").alias("least"))
        nodes = after.unionByName(placed.select(F.col("a").alias("node"), F.col("x").alias("component"))).unionByName(placed.select(F.col("b").alias("node"), F.col("y").alias("component"))).distinct()
        labels = scratch.stash(nodes.join(merged, "component", "left").select("node", F.coalesce("least", "component").alias("component")), "labels")
        edges = kept.select("a", "b").unionByName(new).distinct().join(labels.withColumnRenamed("node", "a"), "a").select("component", "a", "b")
        edges = scratch.stash(edges, "edges")
        self._replace(self.labels, named.unionByName(ends(before)).unionByName(labels.select("node")).distinct(), labels, source, number)
        self._replace(self.edges, touched.unionByName(edges.select("component")).distinct(), edges, source, number)
        scratch.drop_all()

    @staticmethod
    def _replace(store: KeyedStore, keys: DataFrame, rows: DataFrame, source: str, number: int | None) -> None:
        """The rows of ``keys`` are now ``rows``."""
        store.change(keys, lambda old: old.join(keys, store.keys, "left_anti").unionByName(rows), source, number)
