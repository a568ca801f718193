from __future__ import annotations

import datetime as dt
from collections import defaultdict

from pyspark.sql import functions as F

from kinfold.operators import entity_features as ef
from kinfold.operators import lateness

SCHEMA = "event_id string, source_system string, event_type string, event_date date, ingested_at timestamp_ntz, ubid string, metadata string, entity string, amount string, day string"
D = dt.date


def event(i, source="bescom", kind="paid", day=D(2024, 1, 5), at=dt.datetime(2024, 1, 6), who="U1", meta='{"amount": "1,000.50"}'):
    return (i, source, kind, day, at, who, meta, "x", "y", "z")


ROWS = [
    event("e1"),
    event("e1", at=dt.datetime(2024, 2, 1), meta='{"amount": 7}'),  # delivered again: the first counts
    event("e2", kind=" PAID ", day=D(2024, 3, 1), at=dt.datetime(2024, 3, 2), meta='{"amount": 2}'),
    event("e3", kind="visit", day=None, meta=None),
    event("e4", who=None),
    event(None),
    event("e5", who="U2", meta="not json", day=D(2024, 2, 29), at=dt.datetime(2024, 2, 1)),
    event("e6", who="U2", kind=None, meta="", day=D(2024, 3, 1), at=None),
]


def test_entity_features_against_hand_count(spark):
    events = spark.createDataFrame(ROWS, SCHEMA)
    cum = ef.cumulative(events)
    long = {(r.ubid, r.event_type): r for r in ef.as_of_features(cum, windows=(30,)).collect()}
    paid = long["U1", "paid"]
    assert (paid.n_events, float(paid.total), paid.recency_days) == (2, 1002.5, 0)
    assert (paid.n_events_30d, float(paid.total_30d)) == (1, 2.0)
    visit = long["U1", "visit"]
    assert (visit.n_events, visit.recency_days, visit.n_events_30d) == (1, None, 0)
    assert set(long) == {("U1", "paid"), ("U1", "visit"), ("U2", "paid"), ("U2", "")}
    wide = {r.ubid: r for r in ef.features(ef.as_of_features(cum)).collect()}
    assert wide["U1"]["paid_n_events"] == 2 and wide["U2"]["visit_n_events"] == 0 and wide["U2"]["visit_recency_days"] is None
    early = {(r.ubid, r.event_type): r.n_events for r in ef.as_of_features(cum, F.lit("2024-01-31").cast("date")).collect()}
    assert early["U1", "paid"] == 1


def test_entity_features_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ef.features(ef.as_of_features(ef.cumulative(empty))).count() == 0


CUT = "source_system string, cutoff_days int, event_id string"


def test_late_events_and_revisions(spark):
    rows = [
        event("a", day=D(2024, 1, 31), at=dt.datetime(2024, 1, 31, 23)),
        event("b", day=D(2024, 1, 1), at=dt.datetime(2024, 2, 5)),  # 35 days: not beyond
        event("c", day=D(2024, 1, 1), at=dt.datetime(2024, 2, 6)),  # 36 days: beyond
        event("c", day=D(2024, 1, 1), at=dt.datetime(2024, 3, 1)),
        event("d", day=D(2024, 2, 9), at=dt.datetime(2024, 2, 1)),  # dated after arrival
        event("e", day=None),
        event("f", source=None, day=D(2020, 1, 1)),
        event("g", source="other", day=D(2020, 1, 1)),
        event("h", at=None),
    ]
    events = spark.createDataFrame(rows, SCHEMA)
    cut = spark.createDataFrame([("bescom", 35, "x"), (None, 1, "x")], CUT)
    assert [r.event_id for r in lateness.beyond_cutoff(spark, events, cut).collect()] == ["c"]
    cells = {(r.source_system, str(r.event_month), str(r.arrival_month)): r for r in lateness.triangle(spark, events, cut).collect()}
    jan = cells["bescom", "2024-01-01", "2024-02-01"]
    assert (jan.arrived, jan.count_so_far, jan.revision, jan.is_latest) == (1, 2, 2, True)
    assert cells["bescom", "2024-02-01", "2024-02-01"].arrived == 1
    per_month = defaultdict(int)
    for (s, m, _), r in cells.items():
        per_month[s, m] += r.arrived
    assert sum(per_month.values()) == 5  # a, b, d, f, g


def test_late_events_of_an_empty_table(spark):
    empty, cut = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], CUT)
    assert lateness.triangle(spark, empty, cut).count() == 0 and lateness.beyond_cutoff(spark, empty, cut).count() == 0
