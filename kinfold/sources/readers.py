"""Sources and sinks: CSV registers, JSON record and event batches, Kafka, parquet event store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import dictionaries as D

EVENT_SCHEMA = "event_id string, source_system string, source_record_id string, event_type string, event_date date, metadata map<string,string>, _corrupt_record string"
SOURCES = ("ekarmika", "fbis", "kspcb", "bescom", "bwssb")


def read_register_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A register upload: UTF-8 with header, every value a string; empty fields are NULL."""
    return spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def read_records_json(spark: SparkSession, path: str) -> DataFrame:
    """A batch {"records": [...]} as one row per record."""
    whole = spark.read.option("multiLine", True).json(path)
    return whole.select(F.explode("records").alias("r")).select("r.*")


def read_events_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) events of JSON lines; blank lines are skipped, rejected rows say why."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    return validate_events(raw)


def validate_events(raw: DataFrame, event_types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with a JSON text in `value`: (valid, rejected). An event needs an id, a known source, a
    known type and a date; bad rows are returned with a reason, never dropped."""
    parsed = raw.select("value", F.from_json("value", EVENT_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("e"))
    types = tuple(event_types or D.SIGNALS)
    reason = (
        F.when(F.col("e").isNull() | F.col("e._corrupt_record").isNotNull(), "not an event object")
        .when(F.col("e.event_id").isNull(), "no event_id")
        .when(~F.coalesce(F.col("e.source_system").isin(*SOURCES), F.lit(False)), "unknown source")
        .when(~F.coalesce(F.col("e.event_type").isin(*types), F.lit(False)), "unknown event type")
        .when(F.col("e.event_date").isNull(), "no event_date")
    )
    judged = parsed.withColumn("reason", reason)
    return judged.where("reason IS NULL").select("e.*").drop("_corrupt_record"), judged.where("reason IS NOT NULL").select("value", "reason")


def kafka_stream(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """A Kafka source from the earliest offset; offsets live in the query's checkpoint."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    return reader.option("startingOffsets", "earliest").load().select(F.col("value").cast("string").alias("value"))


def kafka_sink(frame: DataFrame, servers: str, topic: str, key: str, checkpoint: str):
    """Keyed JSON rows to Kafka, acknowledged by all replicas, idempotent producer."""
    rows = frame.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    writer = rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return writer.option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("checkpointLocation", checkpoint).start()


def write_events(events: DataFrame, path: str) -> None:
    """Appends to the event store, partitioned by month so that a lookback prunes files."""
    months = events.withColumn("month", F.date_format("event_date", "yyyy-MM"))
    months.repartition("month").write.mode("append").partitionBy("month").parquet(path)


def write_export(frame: DataFrame, path: str) -> None:
    """A CSV export with header, in one file: for report pages, not for tables."""
    frame.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_latest(frame: DataFrame, stored: DataFrame | None, key: str, path: str) -> None:
    """Upsert by key: rows of `frame` replace stored rows of the same key; written to a new path."""
    kept = frame if stored is None else frame.unionByName(stored.join(frame.select(key), key, "left_anti"))
    kept.write.mode("overwrite").parquet(path)


def insert_only(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose natural key is not stored yet."""
    return new.join(stored.select(*key), key, "left_anti")


def ground_truth(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(entity, source_system, source_record_id) from columns of ';'-separated ids, by source."""
    listed = F.explode(F.array(*[F.struct(F.lit(s).alias("source_system"), F.split(F.coalesce(c, F.lit("")), ";").alias("ids")) for c, s in columns.items()]))
    rows = frame.select(F.col("entity_id").alias("entity"), listed.alias("l")).select("entity", "l.source_system", F.explode("l.ids").alias("source_record_id"))
    return rows.select("entity", "source_system", F.trim("source_record_id").alias("source_record_id")).where("source_record_id <> ''")


def synthetic_water_events(spark: SparkSession, connections: int, months: int, start: str = "2024-01-01", seed: int = 7) -> DataFrame:
    """A fixture stream for one register: a bill each month, payment for most, some gaps; hash-derived."""
    base = spark.range(connections * months).select((F.col("id") / months).cast("bigint").alias("c"), (F.col("id") % months).cast("int").alias("m"))
    h = F.pmod(F.xxhash64(F.lit(seed), "c", "m"), F.lit(100))
    kind = F.when(h < 8, "bwssb_zero_consumption").when(h < 70, "bwssb_bill_paid").otherwise("bwssb_bill_generated")
    return base.select(
        F.format_string("W-%07d-%03d", "c", "m").alias("event_id"), F.lit("bwssb").alias("source_system"), F.format_string("W%09d", "c").alias("source_record_id"),
        kind.alias("event_type"), F.expr(f"add_months(date'{start}', m)").alias("event_date"),
    )
