"""Streaming ingest of events: validate, resolve, append or quarantine, once per event_id.

The stream itself is stateless. Each micro-batch is written under its batch id, so a batch that is
replayed after a failure overwrites its own output; event_ids stored by earlier batches are left out by
an anti-join. Late events are accepted at any age, since verdicts are computed from event time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.activity import append_events, resolve
from kinfold.sources.readers import validate_events


def process_batch(raw: DataFrame, mapping: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(joined, quarantined, rejected) of one batch of JSON texts in `value`."""
    valid, rejected = validate_events(raw)
    once = append_events(valid.withColumn("ingested_at", F.current_timestamp()).withColumn("metadata", F.to_json("metadata")), stored)
    joined, waiting = resolve(once, mapping)
    return joined, waiting, rejected


def _stored(spark: SparkSession, root: str, batch_id: int) -> DataFrame | None:
    """Rows of earlier batches only: the batch's own folder may be left from a failed attempt."""
    parts = [spark.read.parquet(f"{root}/{name}").select("event_id", "batch") for name in ("joined", "quarantine") if _exists(spark, f"{root}/{name}")]
    if not parts:
        return None
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.where(F.col("batch") < batch_id).select("event_id")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def start_ingest(raw: DataFrame, mapping: Callable[[], DataFrame], root: str, checkpoint: str):
    """Starts the query; `mapping` is read anew for every batch, so new identities are seen."""
    spark = raw.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        joined, waiting, rejected = process_batch(batch, mapping(), _stored(spark, root, batch_id))
        for name, rows in (("joined", joined), ("quarantine", waiting), ("rejected", rejected)):
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        batch.unpersist()

    return raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def decision_stream(raw: DataFrame) -> DataFrame:
    """Reviewer decisions, each once although two paths deliver them (keyed by decision_id)."""
    schema = "decision_id string, a string, b string, decision string, reviewer string, tier string, decided_at timestamp"
    rows = raw.select(F.from_json("value", schema).alias("d")).select("d.*").where("decision_id IS NOT NULL")
    return rows.withWatermark("decided_at", "7 days").dropDuplicatesWithinWatermark(["decision_id"])
