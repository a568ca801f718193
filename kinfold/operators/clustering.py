"""Grouping records into identities: components, constraints, identifiers and reviewer changes.

Components are found by alternating two star rewrites of the edge list, each a grouped aggregate;
every node's group minimum travels along, so no row is ever compared with a whole group. The edge
list is written to the shared folder each round and the loop ends when it no longer changes. A short
edge list is joined by one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import Scratch

MAX_ROUNDS = 60
#: Edges up to which one task joins them by union-find; the rows are the same either way.
FEW = 300_000


def undirected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct edges with a < b; loops and missing ends are left out."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number of distinct edges and two sums of their hashes: equal for equal sets of edges."""
    h, g = F.xxhash64("a", "b"), F.xxhash64("b", "a", F.lit(1))
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.sum(g.cast("decimal(38,0)"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and the smallest node joined with it, over all edges of the partition."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([root(x) for x in part], pa.string())], ["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes of the edges (a, b)."""
    scratch = Scratch(edges.sparkSession, "stars")
    now = scratch.write(undirected(edges))
    mark = _mark(now)
    if mark[0] <= FEW:
        return now.coalesce(1).mapInArrow(_joined, "node string, component string")
    for _ in range(MAX_ROUNDS):
        # large star: neighbours greater than a node hang on the least of its neighbourhood
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: a node's smaller neighbours, and the node, hang on the least of them
        root = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(root, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        before, now = now, scratch.write(small)
        scratch.drop(before)
        was, mark = mark, _mark(now)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    labels = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return labels.union(now.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()


def inline_edges(scored: DataFrame, must: DataFrame, cannot: DataFrame, auto: float = 0.95) -> DataFrame:
    """Edges used at ingest: automatic links and must-links, without pairs that are cannot-linked
    themselves (joins through a third record stay)."""
    positive = scored.where((F.col("p") >= auto) | F.coalesce(F.col("det_match"), F.lit(False))).select("a", "b")
    return undirected(positive.union(must.select("a", "b"))).join(undirected(cannot), ["a", "b"], "left_anti")


def constrained_clusters(nodes: DataFrame, scored: DataFrame, must: DataFrame, cannot: DataFrame, auto: float = 0.95, reject: float = 0.20) -> DataFrame:
    """node, cluster: components of the positive edges; a component that holds a negative or
    cannot-linked pair falls apart into singletons. Must-links override negatives, cannot-links all."""
    no = F.coalesce(~F.col("det_match"), F.lit(False)) | (F.col("p") < reject)
    yes = (F.col("p") >= auto) | F.coalesce(F.col("det_match"), F.lit(False))
    # sides are united before they are made distinct, so that nothing rests on a union's partitioning
    must_, cannot_ = undirected(must), undirected(cannot)
    linked = scored.where(yes & ~F.coalesce(~F.col("det_match"), F.lit(False))).select("a", "b")
    positive = undirected(linked.union(must.select("a", "b"))).join(cannot_, ["a", "b"], "left_anti")
    negative = undirected(scored.where(no)).join(must_, ["a", "b"], "left_anti").union(cannot_)
    labels = connected_components(positive)
    la = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    lb = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    torn = negative.join(la, "a").join(lb, "b").where("ca = cb").select(F.col("ca").alias("component")).distinct().withColumn("torn", F.lit(True))
    own = nodes.select("node").distinct().join(labels, "node", "left").join(torn, "component", "left")
    return own.select("node", F.when(F.col("torn").isNull(), F.coalesce("component", "node")).otherwise(F.col("node")).alias("cluster"))


def assign_identities(clusters: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """node, cluster, identity: the smallest identity a member had before, else one derived from the
    smallest member."""
    minted = F.concat(F.lit("U"), F.substring(F.sha2("cluster", 256), 1, 16))
    if previous is None:
        return clusters.select("node", "cluster", minted.alias("identity"))
    had = clusters.join(previous.select("node", F.col("identity").alias("old")), "node", "left")
    kept = had.groupBy("cluster").agg(F.min("old").alias("kept"))
    return clusters.join(kept, "cluster").select("node", "cluster", F.coalesce("kept", minted).alias("identity"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """size, n_clusters."""
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_clusters"))


def merge_identities(membership: DataFrame, pairs: DataFrame) -> DataFrame:
    """Must-linked pairs (a, b) of records merge their identities; the smallest survives. Records
    without identity join the other's, or get a new one together."""
    named = membership.select("node", "identity")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    known = ends.join(named, "node", "left").withColumn("label", F.coalesce("identity", F.concat(F.lit("~"), "node")))
    la, lb = known.select(F.col("node").alias("a"), F.col("label").alias("la")), known.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    merged = connected_components(pairs.join(la, "a").join(lb, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    # '~' sorts after any identity, so a component's least label is an identity if it has one
    new = F.when(F.startswith("component", F.lit("~")), F.concat(F.lit("U"), F.substring(F.sha2(F.substring("component", 2, 4000), 256), 1, 16))).otherwise(F.col("component"))
    to = merged.select(F.col("node").alias("label"), new.alias("to"))
    all_named = named.withColumn("label", F.col("identity")).unionByName(known.where("identity IS NULL").select("node", "identity", "label"))
    return all_named.join(to, "label", "left").select("node", F.coalesce("to", "identity").alias("identity"))


def split_identities(membership: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cannot-linked pairs (a, b) that share an identity: only b leaves, for an identity of its own."""
    named = membership.select("node", "identity")
    a = named.select(F.col("node").alias("a"), F.col("identity").alias("ia"))
    b = named.select(F.col("node").alias("b"), F.col("identity").alias("ib"))
    leaving = pairs.join(a, "a").join(b, "b").where("ia = ib").select(F.col("b").alias("node"), F.lit(True).alias("leaves")).distinct()
    own = F.concat(F.lit("U"), F.substring(F.sha2(F.concat(F.lit("split|"), "node"), 256), 1, 16))
    return named.join(leaving, "node", "left").select("node", F.when(F.col("leaves"), own).otherwise(F.col("identity")).alias("identity"))


def member_pairs(membership: DataFrame) -> DataFrame:
    """All pairs within the identities of a reviewed selection: identity, a < b."""
    a, b = membership.select("identity", F.col("node").alias("a")), membership.select("identity", F.col("node").alias("b"))
    return a.join(b, "identity").where("a < b")


def approve(membership: DataFrame) -> DataFrame:
    """Must-link constraints for every pair of the approved identities' members."""
    return member_pairs(membership).select("a", "b", F.lit("must_link").alias("constraint"))


def regroup(membership: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A reviewer's partition (node, label) of one or more identities: (new membership, constraints,
    differences). Labels solo, isolate and '+ new group' stand for groups of one. The largest group
    keeps the identity (ties: smallest member); pairs within a group must, across groups cannot link.
    `differences` lists members missing from, or foreign to, the partition; it must be empty."""
    lone = F.lower(F.trim("label")).isin("solo", "isolate", "+ new group")
    groups = groups.select("node", F.when(lone, F.concat(F.lit("solo|"), "node")).otherwise(F.col("label")).alias("label"))
    joined = membership.join(groups, "node", "full_outer")
    differences = joined.where("identity IS NULL OR label IS NULL").select("node", F.when(F.col("label").isNull(), "missing").otherwise("foreign").alias("problem"))
    here = joined.where("identity IS NOT NULL AND label IS NOT NULL")
    size = here.groupBy("identity", "label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
    keeps = size.groupBy("identity").agg(F.max_by("label", F.struct(F.col("n"), F.translate("least", "0123456789", "9876543210"))).alias("keeper"))
    own = F.concat(F.lit("U"), F.substring(F.sha2(F.concat_ws("|", F.lit("group"), "identity", "label"), 256), 1, 16))
    moved = here.join(keeps, "identity").select("node", F.when(F.col("label") == F.col("keeper"), F.col("identity")).otherwise(own).alias("identity"))
    a = here.select("identity", F.col("node").alias("a"), F.col("label").alias("la"))
    b = here.select("identity", F.col("node").alias("b"), F.col("label").alias("lb"))
    constraints = a.join(b, "identity").where("a < b").select("a", "b", F.when(F.col("la") == F.col("lb"), "must_link").otherwise("cannot_link").alias("constraint"))
    return moved, constraints, differences
