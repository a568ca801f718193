"""Candidate pairs by shared block keys: explode keys, equi-join on the key, never on a disjunction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.similarity import trigrams

BLOCKS = ("legal_entity_pan", "pan", "phone", "pin_door", "pin_name")


def block_rows(records: DataFrame) -> DataFrame:
    """canonical_id, block_type, block_key of every non-empty key."""
    source = {"pin_name": "blocking_pin_name", "pin_door": "blocking_pin_door"}
    keys = F.array(*[F.struct(F.lit(b).alias("block_type"), F.col(source.get(b, b)).alias("block_key")) for b in BLOCKS])
    return records.select("canonical_id", F.explode(keys).alias("k")).select("canonical_id", "k.*").where("block_key IS NOT NULL AND block_key <> ''")


def candidates(records: DataFrame, seen: DataFrame | None = None, max_block: int | None = None) -> DataFrame:
    """canonical_id_a < canonical_id_b with the sorted list of blocks they share; pairs in `seen` are
    left out. With `max_block`, keys of more records are not expanded; `oversized` reports them."""
    rows = block_rows(records)
    size = rows.groupBy("block_type", "block_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if max_block is not None:
        size = size.where(F.col("n") <= max_block)
    rows = rows.join(size.drop("n"), ["block_type", "block_key"])
    b = rows.select(F.col("canonical_id").alias("canonical_id_b"), "block_type", "block_key")
    pairs = rows.withColumnRenamed("canonical_id", "canonical_id_a").join(b, ["block_type", "block_key"]).where("canonical_id_a < canonical_id_b")
    out = pairs.groupBy("canonical_id_a", "canonical_id_b").agg(F.sort_array(F.collect_set("block_type")).alias("shared_blocks"))
    return out if seen is None else out.join(seen.select(F.least("canonical_id_a", "canonical_id_b").alias("canonical_id_a"), F.greatest("canonical_id_a", "canonical_id_b").alias("canonical_id_b")), ["canonical_id_a", "canonical_id_b"], "left_anti")


def oversized(records: DataFrame, max_block: int) -> DataFrame:
    """Keys above the size limit and the pairs they would give: block_type, block_key, n, n_pairs."""
    size = block_rows(records).groupBy("block_type", "block_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_block)
    return size.withColumn("n_pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))


def block_sizes(records: DataFrame) -> DataFrame:
    return block_rows(records).groupBy("block_type", "block_key").agg(F.count(F.lit(1)).alias("n")).groupBy("block_type").agg(
        F.count(F.lit(1)).alias("n_keys"), F.max("n").alias("largest"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("n_pairs")
    )


def trigram_candidates(names: DataFrame, within: str, share: float = 0.6) -> DataFrame:
    """id_a, id_b: names (id, name, key column `within`) that share the key and of whose trigrams b has
    at least `share` of a's. Names under four characters ask for nothing."""
    grams = names.select("id", within, F.explode(trigrams(F.lower("name"))).alias("g"), F.size(trigrams(F.lower("name"))).alias("n"), F.length("name").alias("len"))
    b = grams.select(F.col("id").alias("id_b"), within, "g")
    hits = grams.where("len >= 4").withColumnRenamed("id", "id_a").join(b, [within, "g"]).where("id_a <> id_b")
    return hits.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("hits"), F.max("n").alias("n")).where(F.col("hits") >= F.col("n") * share).select("id_a", "id_b")
