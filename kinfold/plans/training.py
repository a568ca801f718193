"""Registered queries of the core training-data operators (entity features, late events)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinfold.functions.dictionaries import SIGNALS
from kinfold.operators import entity_features, lateness
from kinfold.session import Scratch, table

WINDOWS = (30, 90, 365)

# Matters of which each register records every outcome, beside the scored signals.
OUTCOMES = ("approved", "cancelled", "filed", "queried", "received", "rejected", "returned")
MATTERS = {
    "bescom": "arrears_notice deposit load_revision meter_reading meter_swap transformer_check",
    "bwssb": "arrears_notice borewell_check deposit meter_reading meter_swap sewer_check",
    "fac": "boiler_test canteen_return fee hoist_test overtime_notice plan_change safety_drill",
    "kspcb": "bank_guarantee effluent_sample fee hazwaste_return noise_check stack_sample",
    "se": "fee holiday_list leave_return shift_notice signboard wage_register",
}
EVENT_TYPES = tuple(sorted([*SIGNALS, *(f"{r}_{m}_{o}" for r, words in MATTERS.items() for m in words.split() for o in OUTCOMES)]))


def p3_entity_features(spark: SparkSession, root: str) -> DataFrame:
    cum = entity_features.cumulative(table(spark, root, "activity_events"))
    kept = Scratch(spark, "p3").write(cum, "cumulative")  # read for the last day, the types and the features
    return entity_features.features(entity_features.as_of_features(kept), EVENT_TYPES)


def p3_windowed_long(spark: SparkSession, root: str) -> DataFrame:
    cum = entity_features.cumulative(table(spark, root, "activity_events"))
    kept = Scratch(spark, "p3").write(cum, "cumulative")
    long = entity_features.as_of_features(kept, windows=WINDOWS)
    return long.select(*[long[c].cast("double").alias(c) if c.startswith("total") else long[c] for c in long.columns])


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return lateness.beyond_cutoff(spark, table(spark, root, "activity_events"), table(spark, root, "lateness_cutoffs"))


def p6_triangle(spark: SparkSession, root: str) -> DataFrame:
    return lateness.triangle(spark, table(spark, root, "activity_events"), table(spark, root, "lateness_cutoffs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_entity_features": p3_entity_features,
    "p3_windowed_long": p3_windowed_long,
    "p6_found": p6_found,
    "p6_triangle": p6_triangle,
}

_ONCE = """
SELECT * FROM (
  SELECT event_id, source_system, ubid, lower(trim(coalesce(event_type, ''))) AS event_type, event_date AS day, ingested_at,
         TRY_CAST(replace(replace(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.amount'), ',', ''), ' ', '') AS DECIMAL(18, 2)) AS amount,
         row_number() OVER (PARTITION BY event_id ORDER BY ingested_at NULLS LAST, coalesce(metadata, ''), ubid, event_date) AS k
  FROM activity_events WHERE event_id IS NOT NULL) WHERE k = 1
"""

_LONG = f"""
WITH once AS ({_ONCE}), last AS (SELECT max(day) AS as_of FROM once WHERE ubid IS NOT NULL)
SELECT ubid, event_type, count(*) AS n_events, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total,
       CAST(max(as_of) - max(day) AS INTEGER) AS recency_days,
       {', '.join(f"count(*) FILTER (day > as_of - {w}) AS n_events_{w}d, CAST(coalesce(sum(amount) FILTER (day > as_of - {w}), 0) AS DOUBLE) AS total_{w}d" for w in WINDOWS)}
FROM once, last WHERE ubid IS NOT NULL GROUP BY ubid, event_type
"""

_JUDGED = """
SELECT event_id, arg_min(source_system, ingested_at) AS source_system, arg_min(event_date, ingested_at) AS event_date,
       CAST(min(ingested_at) AS DATE) AS arrival_date
FROM activity_events GROUP BY event_id
"""

ORACLE: dict[str, str] = {
    "p3_entity_features": "SELECT ubid, "
    + ", ".join(
        f"coalesce(sum(n_events) FILTER (event_type = '{t}'), 0)::BIGINT AS {t}_n_events, max(recency_days) FILTER (event_type = '{t}') AS {t}_recency_days, "
        f"coalesce(sum(total) FILTER (event_type = '{t}'), 0) AS {t}_total"
        for t in EVENT_TYPES
    )
    + f" FROM ({_LONG}) GROUP BY ubid",
    "p3_windowed_long": _LONG,
    "p6_found": f"SELECT event_id FROM ({_JUDGED}) e JOIN lateness_cutoffs c USING (source_system) WHERE arrival_date - event_date > cutoff_days",
    "p6_triangle": f"""
WITH cells AS (
  SELECT source_system, CAST(date_trunc('month', event_date) AS DATE) AS event_month,
         CAST(date_trunc('month', arrival_date) AS DATE) AS arrival_month, count(*) AS arrived
  FROM ({_JUDGED}) e LEFT JOIN lateness_cutoffs c USING (source_system)
  WHERE event_date IS NOT NULL AND NOT coalesce(arrival_date - event_date > cutoff_days, FALSE) GROUP BY ALL)
SELECT *, CAST(sum(arrived) OVER w AS BIGINT) AS count_so_far, row_number() OVER w AS revision,
       arrival_month = max(arrival_month) OVER (PARTITION BY source_system, event_month) AS is_latest
FROM cells WINDOW w AS (PARTITION BY source_system, event_month ORDER BY arrival_month)""",
}
