"""Counts by event period that are corrected as late events arrive, with a cut-off per source.

The event-period by arrival-period triangle: every distinct event falls into one cell
(source, month of event_date, month of first arrival). A running sum along the arrival axis gives
each revision of a period's count, the last one being the value known today. Events whose lateness
exceeds their source's cut-off never enter a cell; they are listed by `beyond_cutoff`.

Everything is SQL. The only wide shuffle is the one that takes each event_id once; cells are
aggregated map-side before their shuffle, so one source or month holding most rows costs nothing extra.

Defined results: an event delivered several times counts once, at its earliest arrival, with the
source and date of that delivery (ties: smallest date, then source). Events without event_id,
event_date, arrival time or a cut-off for their source are never "beyond"; without event_date or
arrival time they have no cell. Events dated after arrival have negative lateness and are kept.
An empty table gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FIRST = """
SELECT event_id, first.source_system AS source_system, first.event_date AS event_date,
       CAST(first.ingested_at AS DATE) AS arrival_date
FROM (
  SELECT event_id,
         MIN(STRUCT(ingested_at IS NULL AS undated, ingested_at, event_date, source_system)) AS first
  FROM {events} WHERE event_id IS NOT NULL GROUP BY event_id
)
"""

_JUDGED = f"""
SELECT e.*, DATEDIFF(e.arrival_date, e.event_date) AS days_late,
       COALESCE(DATEDIFF(e.arrival_date, e.event_date) > c.cutoff_days, FALSE) AS beyond
FROM ({_FIRST}) e
LEFT JOIN (SELECT source_system, MAX(cutoff_days) AS cutoff_days FROM {{cutoffs}}
           WHERE source_system IS NOT NULL GROUP BY source_system) c
  ON e.source_system = c.source_system
"""

_TRIANGLE = f"""
WITH cells AS (
  SELECT source_system, DATE_TRUNC('MONTH', event_date) AS event_month,
         DATE_TRUNC('MONTH', arrival_date) AS arrival_month, COUNT(*) AS arrived
  FROM ({_JUDGED})
  WHERE NOT beyond AND event_date IS NOT NULL AND arrival_date IS NOT NULL
  GROUP BY 1, 2, 3
)
SELECT source_system, CAST(event_month AS DATE) AS event_month,
       CAST(arrival_month AS DATE) AS arrival_month, arrived,
       SUM(arrived) OVER w AS count_so_far,
       CAST(ROW_NUMBER() OVER w AS BIGINT) AS revision,
       arrival_month = MAX(arrival_month) OVER (PARTITION BY source_system, event_month) AS is_latest
FROM cells
WINDOW w AS (PARTITION BY source_system, event_month ORDER BY arrival_month
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

_BEYOND = f"SELECT event_id FROM ({_JUDGED}) WHERE beyond"


def triangle(spark: SparkSession, events: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Every corrected revision: source_system, event_month, arrival_month, arrived, count_so_far,
    revision (1 = first report) and is_latest."""
    return spark.sql(_TRIANGLE, events=events, cutoffs=cutoffs)


def beyond_cutoff(spark: SparkSession, events: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The event_ids that the triangle leaves out because they came too late."""
    return spark.sql(_BEYOND, events=events, cutoffs=cutoffs)
