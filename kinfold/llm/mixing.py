"""Mixing sources to target token shares with a splitting tree of hypergeometric draws.

Amounts. The mix is as large as the scarcest source allows: with target share w, tokens A and at most
r copies, T is the least A r / w over the sources, and a source contributes w T tokens. That is some
whole copies of it and a part of one more; the part ends in one block, filled with the documents
that come nearest to the amount.

Placement. Documents fall into hash blocks per source. The numbers of block copies per source are
split exactly over the output shards by a binary tree: each node draws its left half's share of every
source from a multivariate hypergeometric distribution, so every shard is a uniform draw without
replacement and the leaves add up exactly. The source's blocks, in permuted order, are dealt to the
shards by these quotas; documents are shuffled inside their shard only.

Only block totals (at most about `MAX_BLOCKS` plus one per source) and the quotas are handled in one
place. Documents meet their block's plan in a join on (source, block) with the small side broadcast
under that bound, are exploded into copies and shuffled once, by shard.

Defined results: documents of sources without a target, without source or without doc_id are not
drawn; a doc_id in several rows counts once (smallest source, largest token count). Targets without
documents or with no positive share are left out and the other shares scaled up. max_repeats below 1
or missing counts as 1. Same seed, same result. No usable target or no document: no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.tokens import with_token_counts
from kinfold.session import Scratch

MAX_BLOCKS = 20_000
BLOCK_DOCS = 50
SHARD_TOKENS = 2_000_000


def split_quotas(units: list[int], shards: int, seed: int) -> np.ndarray:
    """Exact quotas (shards x sources) of each source's units, drawn by recursive halving."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((shards, len(units)), np.int64)
    todo = [(0, shards, np.array(units, np.int64))]
    while todo:
        first, n, have = todo.pop()
        if n == 1:
            out[first] = have
            continue
        left = n // 2
        share = int(round(have.sum() * left / n))
        drawn = rng.multivariate_hypergeometric(have, share, method="marginals") if have.sum() else have
        todo += [(first, left, drawn), (first + left, n - left, have - drawn)]
    return out


def _plan(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, tuple[float, float, int, float]]:
    """source -> (target, scaled share, whole copies, tokens of the part copy)."""
    usable = {s: t for s, t in targets.items() if t[0] > 0 and totals.get(s, 0) > 0}
    weight = sum(t[0] for t in usable.values())
    if not usable:
        return {}
    size = min(totals[s] * r / (w / weight) for s, (w, r) in usable.items())
    plan = {}
    for s, (w, r) in usable.items():
        amount = size * w / weight
        copies = min(int(amount / totals[s] + 1e-9), r)
        plan[s] = (w, w / weight, copies, max(0.0, amount - copies * totals[s]))
    return plan


def _fill(block: pd.DataFrame) -> pd.DataFrame:
    """Which documents of a block make up its cut: in shuffled order all that still fit, and then the
    smallest other one if the sum comes nearer with it."""
    block = block.sort_values(["turn", "doc_id"])
    limit, reached, fits = float(block["cut"].iloc[0]), 0, []
    for n in block["n_tokens"]:
        fits.append(reached + n <= limit)
        reached += n if fits[-1] else 0
    out = pd.DataFrame({"doc_id": block["doc_id"].to_numpy(), "fits": fits})
    others = block["n_tokens"].to_numpy()[~out["fits"].to_numpy()]
    if len(others) and abs(reached + others.min() - limit) < limit - reached:
        out.loc[np.flatnonzero(~out["fits"].to_numpy())[int(others.argmin())], "fits"] = True
    return out


def mix(
    documents: DataFrame,
    targets: DataFrame,
    vocabulary: str | None = None,
    shard_tokens: int = SHARD_TOKENS,
    block_docs: int = BLOCK_DOCS,
    seed: int = 1,
) -> DataFrame:
    """A row per drawn copy: shard_id, position, doc_id, source, copy_no, n_tokens."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    counted = with_token_counts(documents.where("doc_id IS NOT NULL AND source IS NOT NULL").select("doc_id", "source", "text"), ["doc_id", "source"], vocabulary)
    docs = scratch.write(
        counted.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens")), "tokens"
    )
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"shard_id int, position int, doc_id {doc_type}, source string, copy_no int, n_tokens bigint")
    # targets are a reference list of sources
    wanted = {
        r.source: (float(r.w), max(1, int(r.r or 1)))
        for r in targets.where("source IS NOT NULL AND target_share IS NOT NULL")
        .groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).collect()
    }
    ours = docs.where(F.col("source").isin(sorted(wanted))) if wanted else docs.limit(0)
    stats = {r.source: (int(r.tokens), int(r.n)) for r in ours.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    plan = _plan({s: t for s, (t, _) in stats.items()}, wanted)
    if not plan:
        return empty
    drawn = sum(n for s, (_, n) in stats.items() if s in plan)
    block_docs = max(block_docs, -(-drawn // MAX_BLOCKS))
    n_blocks = {s: -(-stats[s][1] // block_docs) for s in plan}
    order = sorted(plan)

    def by_source(values: dict, kind: str):
        return F.element_at(F.create_map(*[x for s in order for x in (F.lit(s), F.lit(values[s]).cast(kind))]), F.col("source"))

    mix_hash = F.xxhash64(F.lit(seed), "source", "doc_id")
    blocked = ours.where(F.col("source").isin(order)).withColumn("block", F.pmod(mix_hash, by_source(n_blocks, "bigint")).cast("int"))
    blocks = blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")).toPandas()  # at most MAX_BLOCKS + sources rows

    # per source: permuted blocks, how far the part copy reaches, and the shards of all block copies
    rng = np.random.Generator(np.random.PCG64(seed))
    units: dict[str, list[tuple[int, int, float]]] = {}  # (block, copy, token limit or inf)
    for s in order:
        _, _, copies, part = plan[s]
        mine = blocks[blocks["source"] == s].sort_values("block")
        perm = rng.permutation(len(mine))
        ids, tokens = mine["block"].to_numpy()[perm], mine["tokens"].to_numpy()[perm].astype(float)
        todo = [(int(b), c, np.inf) for c in range(1, copies + 1) for b in ids]
        start = np.cumsum(tokens) - tokens
        for b, at, n in zip(ids, start, tokens):
            if at >= part - 1e-6:
                break
            todo.append((int(b), copies + 1, np.inf if at + n <= part else part - at))
        units[s] = [todo[i] for i in rng.permutation(len(todo))]
    total = sum((plan[s][2] * stats[s][0] + plan[s][3]) for s in order)
    # blocks grow with the data, as their number is bounded; shards grow with them, so that none stays empty
    shards = max(1, min(round(total / shard_tokens), sum(map(len, units.values())) // 4))
    quotas = split_quotas([len(units[s]) for s in order], shards, seed)
    rows = []
    for i, s in enumerate(order):
        shard = np.repeat(np.arange(shards), quotas[:, i])
        rows += [(s, b, c, int(k), None if np.isinf(limit) else float(limit)) for (b, c, limit), k in zip(units[s], shard)]
    dealt = spark.createDataFrame(rows, "source string, block int, copy_no int, shard_id int, token_limit double")

    by_block = dealt.groupBy("source", "block").agg(F.collect_list(F.struct("copy_no", "shard_id", "token_limit")).alias("copies"), F.max("token_limit").alias("cut"))
    placed = blocked.join(F.broadcast(by_block), ["source", "block"])  # bounded by MAX_BLOCKS and the copies
    # only the one block per source in which the part copy ends is gone through document by document
    whole = placed.where("cut IS NULL").select("doc_id", "source", "n_tokens", "copies", F.lit(True).alias("fits"))
    cut = (
        placed.where("cut IS NOT NULL")
        .select("doc_id", "source", "n_tokens", "cut", F.xxhash64(F.lit(seed + 1), "doc_id").alias("turn"))
        .groupBy("source")
        .applyInPandas(_fill, f"doc_id {doc_type}, fits boolean")
    )
    cut = placed.where("cut IS NOT NULL").join(cut, "doc_id").select("doc_id", "source", "n_tokens", "copies", "fits")
    copies = whole.unionByName(cut).select("doc_id", "source", "n_tokens", "fits", F.explode("copies").alias("c"))
    chosen = copies.where(F.col("c.token_limit").isNull() | F.col("fits"))
    local = Window.partitionBy("shard_id").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "copy_no"), "doc_id", "copy_no")
    return chosen.select("doc_id", "source", "n_tokens", "c.copy_no", "c.shard_id").select(
        "shard_id", F.row_number().over(local).alias("position"), "doc_id", "source", "copy_no", "n_tokens"
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: tokens and copies drawn, most copies of one document, share reached."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_copies"), F.max("copy_no").alias("most_copies"))
    all_tokens = got.agg(F.sum("tokens").alias("all_tokens"))
    want = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = F.lit(0).cast("bigint")
    return want.join(got, "source", "left").crossJoin(F.broadcast(all_tokens)).select(  # one row
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce("n_copies", zero).alias("n_copies"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        (F.coalesce("tokens", zero) / F.col("all_tokens")).alias("actual_share"),
    )
