"""Filling fixed-capacity containers with documents: Martello-Toth reduction, then best fit.

A packing depends on sizes only, and there are at most `capacity` different ones. So the documents
are counted by size, the packing is found once on that histogram, and documents take their places by
their rank among those of equal size. The histogram stays below capacity rows however many documents
there are; the packing is a list of patterns, each with the number of containers filled by it.

Reduction: for the largest size left, a set of companions that provably dominates every alternative
is fixed for good. Nothing else fits: the document is alone. One companion fills the rest exactly, or
no two documents fit beside it and the largest that does is taken: in any packing the companions can
be exchanged for it without using more containers. What is left is packed best fit, largest first.

Ranks are exact without gathering a size in one task: documents of a frequent size are split over hash
buckets, numbered inside a bucket, and shifted by the sizes of the buckets before it. Rare sizes are one
bucket, so the shifts that are broadcast stay a few for every `BUCKET_ROWS` documents.

Defined results: a document longer than the capacity is cut into full pieces and a rest; nothing else
is cut. Documents of 0 tokens (missing or empty texts) go into container 0. A doc_id in several rows
is placed once, with its largest token count; rows without doc_id are not placed. Containers are
numbered from 0 per kind. Capacities that are missing or below 1 are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.tokens import with_token_counts
from kinfold.session import Scratch

#: Documents of one size that one task numbers.
BUCKET_ROWS = 100_000
MAX_CAPACITY = 1 << 20


def reduce_instance(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Fix dominating sets and take them out of `counts`: patterns ((size, copies), ...) and how often."""
    fixed: list[tuple[tuple[tuple[int, int], ...], int]] = []
    sizes = sorted(s for s, n in counts.items() if n > 0)

    def take(size: int, n: int) -> None:
        counts[size] -= n
        if counts[size] == 0:
            del counts[size]
            sizes.pop(bisect.bisect_left(sizes, size))

    top = len(sizes) - 1
    while top >= 0:
        top = min(top, len(sizes) - 1)
        if top < 0:
            break
        j = sizes[top]
        rest = capacity - j
        at = bisect.bisect_right(sizes, rest) - 1
        if at >= 0 and sizes[at] == j and counts[j] == 1:
            at -= 1  # it cannot accompany itself
        if at < 0:
            n = counts[j]
            take(j, n)
            fixed.append((((j, 1),), n))
            top -= 1
            continue
        k = sizes[at]
        small = sizes[0]
        second = small if counts[small] - (small == j) >= 2 else sizes[1] if len(sizes) > 1 else capacity
        if small == j and counts[j] == 1:
            small, second = (sizes[1], sizes[2]) if len(sizes) > 2 else (capacity, capacity)
        if k == rest or small + second > rest:
            if k == j:
                n = counts[j] // 2
                take(j, 2 * n)
                fixed.append((((j, 2),), n))
            else:
                n = min(counts[j], counts[k])
                take(j, n)
                take(k, n)
                fixed.append((((j, 1), (k, 1)), n))
            top = min(top, len(sizes) - 1)
            # the same size is looked at again if some of it is left
            while top >= 0 and sizes[top] > j:
                top -= 1
            continue
        top -= 1
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over a histogram; equal containers are handled as one group."""
    groups: dict[int, list[tuple[tuple, int]]] = {}  # room left -> [(pattern, containers)]
    rooms: list[int] = []

    def put(room: int, pattern: tuple, n: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((pattern, n))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        placed = []  # rooms below s are not looked at again for s
        while left:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                q = capacity // s
                n, more = divmod(left, q)
                if n:
                    placed.append((capacity - q * s, ((s, q),), n))
                if more:
                    placed.append((capacity - more * s, ((s, more),), 1))
                break
            room = rooms[at]
            pattern, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            q = room // s
            full, more = divmod(left, q)
            used = min(full, n)
            if used:
                placed.append((room - q * s, (*pattern, (s, q)), used))
            left -= used * q
            if used < n:
                n -= used
                if left:  # one container takes the last few
                    placed.append((room - more * s, (*pattern, (s, more)), 1))
                    n -= 1
                    left = 0
                if n:
                    put(room, pattern, n)
        for room, pattern, n in placed:
            put(room, pattern, n)
    return [g for room in rooms for g in groups[room]]


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    counts = {s: n for s, n in histogram.items() if n > 0}
    return reduce_instance(counts, capacity) + best_fit(counts, capacity)


def _places(patterns) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: the first rank of each run of places, the run's first container, copies in each."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    container = 0
    for pattern, n in patterns:
        for size, q in pattern:
            start = taken.get(size, 0)
            runs.setdefault(size, []).append((start, container, q))
            taken[size] = start + n * q
        container += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in runs.items()}


def token_sizes(documents: DataFrame, scratch: Scratch, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens with each doc_id once."""
    counted = with_token_counts(documents.where("doc_id IS NOT NULL").select("doc_id", "text"), ["doc_id"], vocabulary)
    return scratch.write(counted.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")), "tokens")


def pack(documents: DataFrame, containers: DataFrame, vocabulary: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row per document piece: container_kind, container_id, doc_id, piece_no, n_tokens."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    sizes = token_sizes(documents, scratch, vocabulary)
    # the kinds are a reference list; MAX_CAPACITY bounds the histogram that comes to the driver
    kinds = {
        r[0]: int(r[1])
        for r in containers.where("container_kind IS NOT NULL AND capacity_tokens >= 1").groupBy("container_kind").agg(F.max("capacity_tokens")).collect()
    }
    if any(c > MAX_CAPACITY for c in kinds.values()):
        raise ValueError(f"capacities above {MAX_CAPACITY} tokens are not supported")
    empty = spark.createDataFrame([], f"container_kind string, container_id bigint, doc_id {sizes.schema['doc_id'].dataType.simpleString()}, piece_no int, n_tokens bigint")
    if not kinds:
        return empty
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in sorted(kinds.items())]))
    each = sizes.select("doc_id", "n_tokens", kind.alias("k")).select("doc_id", "n_tokens", "k.*")
    last = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int") - 1, F.lit(0))
    pieces = each.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last))).select(
        "container_kind",
        "doc_id",
        "piece_no",
        F.least(F.col("n_tokens") - F.col("piece_no") * F.col("capacity"), F.col("capacity")).alias("size"),
    )
    histogram: dict[str, dict[int, int]] = {k: {} for k in kinds}
    for k, s, n in pieces.groupBy("container_kind", "size").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows a kind
        histogram[k][int(s)] = int(n)
    # only sizes of more than `bucket_rows` pieces are split, so buckets number less than twice pieces / bucket_rows, whatever the sizes
    many = [(k, s, -(-n // bucket_rows)) for k, h in sorted(histogram.items()) for s, n in sorted(h.items()) if n > bucket_rows]
    split = F.broadcast(spark.createDataFrame(many, "container_kind string, size bigint, buckets bigint"))
    bucket = F.coalesce(F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("buckets")), F.lit(0)).cast("int")
    pieces = pieces.join(split, ["container_kind", "size"], "left").withColumn("bucket", bucket)
    parts = scratch.write(pieces.where("buckets IS NOT NULL").groupBy("container_kind", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    before = Window.partitionBy("container_kind", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("container_kind", "size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    for h in histogram.values():
        h.pop(0, None)  # documents without tokens take no room
    held = spark.sparkContext.broadcast({k: _places(solve(h, kinds[k])) for k, h in histogram.items()})
    here = Window.partitionBy("container_kind", "size", "bucket").orderBy("doc_id", "piece_no")
    ranked = pieces.withColumn("in_bucket", F.row_number().over(here) - 1).join(F.broadcast(shifts), ["container_kind", "size", "bucket"], "left")
    rank = (F.col("in_bucket") + F.coalesce("shift", F.lit(0))).alias("rank")
    ranked = ranked.select("container_kind", "doc_id", "piece_no", "size", rank)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = held.value
        for batch in batches:
            kind_of = batch.column(0).to_pylist()
            size = batch.column(3).to_numpy()
            rank = batch.column(4).to_numpy()
            out = np.zeros(len(size), np.int64)
            codes = np.unique(size)
            kinds_here = np.array(kind_of, dtype=object)
            for k in set(kind_of):
                of_kind = kinds_here == k
                for s in codes[codes > 0]:
                    rows = np.flatnonzero(of_kind & (size == s))
                    if len(rows):
                        start, first, q = places[k][int(s)]
                        run = np.searchsorted(start, rank[rows], side="right") - 1
                        out[rows] = first[run] + (rank[rows] - start[run]) // q[run]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out), batch.column(1), batch.column(2), batch.column(3)],
                ["container_kind", "container_id", "doc_id", "piece_no", "n_tokens"],
            )

    return ranked.mapInArrow(assign, empty.schema)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: containers used, fewest possible by total size, tokens, and the share left unused."""
    size = containers.groupBy("container_kind").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    used = packed.groupBy("container_kind").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("tokens"))
    return used.join(F.broadcast(size), "container_kind").select(
        "container_kind",
        "n_containers",
        F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest_possible"),
        "tokens",
        (1 - F.col("tokens") / (F.col("n_containers") * F.col("capacity"))).alias("unused_share"),
    )
