"""Consolidating pairwise matches into groups: union-find over bounded edge partitions, merged as forests.

One level works like this:

1. The edges are hashed over as many partitions as keep each below `max_edges` rows. Hashing by both
   ends spreads a hub that takes part in a third of all pairs.
2. Every partition runs union-find over its own edges and keeps a spanning forest only: each node
   points at its tree's root. Roots are the nodes of smallest salted hash, so that in expectation a
   fixed share of the nodes stops being a root at every level, whatever the graph's shape.
3. The forests are brought together by node. A node that is nobody's root gets its parent for good
   and leaves the graph; the other roots it met become edges between roots. Only those go on.

Levels repeat until the remaining edges fit one bounded partition, whose union-find ends the matter.
Parents are then resolved from the last level back to the first by equi-joins. A node's list of roots
is at most one per partition, so no task holds a group. Every level is written to the shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.session import Scratch

#: Edges that one task holds in memory (about 100 bytes each).
MAX_EDGES = 400_000


def linked_pairs(
    pairs: DataFrame,
    threshold: float = 0.95,
    a: str = "canonical_id_a",
    b: str = "canonical_id_b",
    score: str = "calibrated_probability",
    at: str = "scored_at",
) -> DataFrame:
    """Unordered pairs (u < v) whose latest score reaches the threshold.

    Rows with a missing end or of a record with itself are no pairs. Of several rows of a pair, in
    either order, the latest counts (rows without a time are the oldest; at equal times the highest
    score); if its score is missing the pair does not link.
    """
    ends = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.struct(F.col(at), F.col(score)).alias("s"))
    return (
        ends.where(F.col("a") != F.col("b"))
        .groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        .agg(F.max("s")[score].alias("p"))
        .where(F.col("p") >= threshold)
        .select("u", "v")
    )


def _union(batches: Iterator[pa.RecordBatch], salt: str | None) -> dict[str, str]:
    """Node -> root over all edges of a partition; salt None makes the smallest node the root."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    rank = (lambda n: n) if salt is None else (lambda n: (zlib.crc32((salt + n).encode()), n))
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rx, ry = find(parent.setdefault(x, x)), find(parent.setdefault(y, y))
            if rx != ry:
                if rank(rx) < rank(ry):
                    parent[ry] = rx
                else:
                    parent[rx] = ry
    return {x: find(x) for x in parent}


def _forest(level: int | None):
    salt = None if level is None else f"{level}:"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = _union(batches, salt)
        if roots:
            yield pa.RecordBatch.from_arrays([pa.array(list(roots), pa.string()), pa.array(list(roots.values()), pa.string())], ["node", "root"])

    return run


def components(edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """Component of every node of the edges (u, v): columns node, component (its smallest node)."""
    scratch = Scratch(edges.sparkSession, "components")
    rest = scratch.write(edges.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v")), "edges")
    left, settled, level = rest.count(), [], 0
    while left > max_edges:
        if level > 60:
            raise RuntimeError("the spanning forests do not shrink")
        parts = -(-left // max_edges)
        trees = rest.repartition(parts, "u", "v").mapInArrow(_forest(level), "node string, root string")
        # a root points at itself, which marks it as one
        met = trees.groupBy("node").agg(F.array_sort(F.collect_set("root")).alias("roots"))
        is_root = F.array_contains("roots", F.col("node"))
        others = F.array_except("roots", F.array("node"))
        met = scratch.write(
            met.select("node", is_root.alias("is_root"), others.alias("roots")).where(F.size("roots") > 0), f"level{level}"
        )
        settled.append(met.where(~F.col("is_root")).select("node", F.col("roots")[0].alias("parent")))
        among_roots = met.where(F.size("roots") > 1).select(
            F.explode(F.expr("slice(roots, 2, size(roots) - 1)")).alias("u"), F.col("roots")[0].alias("v")
        )
        still_root = met.where("is_root").select(F.col("node").alias("u"), F.col("roots")[0].alias("v"))
        before, rest = rest, scratch.write(among_roots.union(still_root).distinct(), f"edges{level}")
        scratch.drop(before)
        left, level = rest.count(), level + 1
    label = rest.coalesce(1).mapInArrow(_forest(None), "node string, root string").withColumnRenamed("root", "top")
    if not settled:
        return label.withColumnRenamed("top", "component")
    for parents in reversed(settled):
        up = label.select(F.col("node").alias("parent"), "top")
        down = parents.join(up, "parent", "left").select("node", F.coalesce("top", "parent").alias("top"))
        label = scratch.write(label.union(down), "labels")
    # a root that met no other has no row of its own yet
    label = label.union(label.select(F.col("top").alias("node"), "top")).distinct()
    least = label.groupBy("top").agg(F.min("node").alias("component"))
    return label.join(least, "top").select("node", "component")


def consolidate(pairs: DataFrame, threshold: float = 0.95, max_edges: int = MAX_EDGES, **columns: str) -> DataFrame:
    """One row per record linked to another: canonical_id, group_id (the smallest canonical_id).

    Pairs as for `linked_pairs`. No linked pair, or an empty table, gives no rows.
    """
    found = components(linked_pairs(pairs, threshold, **columns), max_edges)
    return found.select(F.col("node").alias("canonical_id"), F.col("component").alias("group_id"))
