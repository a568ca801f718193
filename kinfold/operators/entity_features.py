"""One feature row per entity from an event log: counts, totals and recency per event type.

Storage first, features second. `cumulative` keeps, for each (entity, type, day), the running count
and running total; any window's value is then the difference of two as-of reads, so windows of any
length cost no further pass over the events. `features` reads those endpoints and spreads the types
into columns.

Shuffles: one on event_id (each event once), then one on (entity, type) of rows already
reduced to a row per entity, type and day. An entity holding a third of the log is therefore spread
over its types and has at most one row per type and day; nothing is sorted or gathered per entity
until there is one row per type.

Defined results: of several deliveries of an event_id the earliest arrival counts (ties: smallest
metadata). Rows without event_id or entity belong to nobody and are left out. Types are compared
trimmed and in lower case; a missing type is the type ''. Amounts may be numbers or strings with
separators; what cannot be read adds nothing. Events without a date count in the all-time figures
and in no trailing window; they have no recency. Events dated after the as-of day are excluded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event types are a catalogue, not data; more distinct values than this mean the column is wrong.
MAX_TYPES = 4000


def amount(metadata: Column) -> Column:
    """The `amount` of a JSON object: a number, or digits with thousands separators."""
    raw = F.regexp_replace(F.get_json_object(metadata, "$.amount"), r"[,\s]", "")
    return raw.try_cast("decimal(18,2)")


def deliveries_once(events: DataFrame) -> DataFrame:
    """Each event_id once: its earliest arrival. Columns entity, event_type, day, amount."""
    narrow = events.where(F.col("event_id").isNotNull()).select(
        "event_id",
        F.struct(
            F.col("ingested_at").isNull().alias("undated"),
            F.col("ingested_at"),
            F.coalesce(F.col("metadata"), F.lit("")).alias("metadata"),
            F.col("ubid"),
            F.lower(F.trim(F.coalesce(F.col("event_type"), F.lit("")))).alias("event_type"),
            F.col("event_date"),
        ).alias("d"),
    )
    first = narrow.groupBy("event_id").agg(F.min("d").alias("d"))
    return first.where(F.col("d.ubid").isNotNull()).select(
        F.col("d.ubid").alias("ubid"),
        F.col("d.event_type").alias("event_type"),
        F.col("d.event_date").alias("day"),
        amount(F.col("d.metadata")).alias("amount"),
    )


def cumulative(events: DataFrame) -> DataFrame:
    """Running count and total by entity, type and day (undated events first, day NULL)."""
    daily = (
        deliveries_once(events)
        .groupBy("ubid", "event_type", "day")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    )
    upto = (
        Window.partitionBy("ubid", "event_type")
        .orderBy(F.col("day").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return daily.select(
        "ubid",
        "event_type",
        "day",
        F.sum("n").over(upto).alias("cum_n"),
        F.coalesce(F.sum("amount").over(upto), F.lit(0).cast("decimal(28,2)")).cast("decimal(28,2)").alias("cum_total"),
    )


def as_of_features(cum: DataFrame, as_of: Column | None = None, windows: Sequence[int] = ()) -> DataFrame:
    """Long form: a row per entity and type as of a day (default: the last event day in the table).

    Columns ubid, event_type, n_events, total, recency_days, and for each window of w days
    n_events_<w>d and total_<w>d: the as-of read minus the read w days earlier.
    """
    if as_of is None:
        last = cum.agg(F.max("day").alias("as_of"))
        at = cum.crossJoin(F.broadcast(last))  # one row
    else:
        at = cum.withColumn("as_of", as_of)
    known = F.col("day").isNull() | (F.col("day") <= F.col("as_of"))
    before = [F.col("day").isNull() | (F.col("day") <= F.date_sub(F.col("as_of"), w)) for w in windows]
    zero = F.lit(0).cast("decimal(28,2)")
    out = (
        at.where(known)
        .groupBy("ubid", "event_type")
        .agg(
            # running sums never fall, so the as-of read is a maximum: no sort, combined map-side;
            # totals are read at the latest row because amounts may be negative
            F.max("cum_n").alias("n_events"),
            F.max(F.struct(F.col("cum_n"), F.col("cum_total")))["cum_total"].alias("total"),
            F.datediff(F.max("as_of"), F.max("day")).alias("recency_days"),
            *[F.max(F.when(b, F.struct("cum_n", "cum_total"))).alias(f"_b{w}") for w, b in zip(windows, before)],
        )
    )
    for w in windows:
        out = out.withColumn(f"n_events_{w}d", F.col("n_events") - F.coalesce(F.col(f"_b{w}.cum_n"), F.lit(0)))
        out = out.withColumn(f"total_{w}d", (F.col("total") - F.coalesce(F.col(f"_b{w}.cum_total"), zero)).cast("decimal(28,2)"))
    return out.drop(*[f"_b{w}" for w in windows])


def features(long: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Wide form: one row per entity; for each type <type>_n_events (0 if none), <type>_recency_days
    (NULL if none) and <type>_total (0 if none). Other figures of the long form stay there. `types` are
    columns whether or not they occur; types found beside them follow.

    The rows of an entity, at most one per type, are brought together before the pivot so that its
    wide buffers are built once per entity instead of once per input partition.
    """
    found = long.select("event_type").distinct().orderBy("event_type").limit(MAX_TYPES + 1).collect()
    types = [*(types or ()), *(r[0] for r in found if r[0] not in set(types or ()))]
    if len(types) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types: event_type is not a catalogue column")
    own = long.select("ubid", "event_type", "n_events", "recency_days", F.col("total").cast("double").alias("total"))
    if not types:
        return own.select("ubid").distinct()
    wide = (
        own.repartition("ubid")
        .groupBy("ubid")
        .pivot("event_type", list(types))
        .agg(F.first("n_events").alias("n_events"), F.first("recency_days").alias("recency_days"), F.first("total").alias("total"))
    )
    columns = ["ubid"]
    for t in types:  # as text: thousands of Column calls cost more than parsing
        q = t.replace("`", "``")
        columns += [
            f"coalesce(`{q}_n_events`, 0L) AS `{q}_n_events`",
            f"`{q}_recency_days`",
            f"coalesce(`{q}_total`, 0D) AS `{q}_total`",
        ]
    return wide.selectExpr(*columns)
