"""Review listings, evaluation by group sizes, and the parts that keep large identities and long chains cheap."""

from __future__ import annotations

import random
import types

import pytest
from pyspark.sql import functions as F

from kinfold import session
from kinfold.operators import activity, adapters, clustering, entity_features, reports, review, scoring
from kinfold.streaming import ingest


@pytest.mark.parametrize("few", [0, 300_000])
def test_components_by_stars_and_by_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(clustering, "FEW", few)
    rnd = random.Random(3)
    pairs = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [(f"x{rnd.randrange(30)}", f"x{rnd.randrange(30)}") for _ in range(25)] + [(None, "a"), ("b", None), ("c", "c")]
    label: dict[str, str] = {}
    for a, b in pairs:
        if a and b and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    got = {r.node: r.component for r in clustering.connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == label
    assert clustering.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_components_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(clustering, "FEW", 0)
    monkeypatch.setattr(clustering, "MAX_ROUNDS", 1)
    chain = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(30)], "a string, b string")
    with pytest.raises(RuntimeError):
        clustering.connected_components(chain)


def test_top_evidence_of_a_large_identity(spark):
    rows = [("A", f"e{i:04d}", float((i * 37) % 101 - 50) / 100) for i in range(500)] + [("B", "f", 0.5)]
    top = activity.top_evidence(spark.createDataFrame(rows, "identity string, event_id string, contribution double"), 7).collect()
    mine = sorted((r for r in rows if r[0] == "A"), key=lambda r: (-abs(r[2]), r[1]))
    assert [r.event_id for r in sorted(top, key=lambda r: r.rank) if r.identity == "A" and r.rank <= 7] == [r[1] for r in mine[:7]]
    rest = next(r for r in top if r.identity == "A" and r.rank == 8)
    assert rest.n_events == 493 and rest.contribution == round(sum(r[2] for r in mine[7:]), 4)
    assert [(r.rank, r.event_id) for r in top if r.identity == "B"] == [(1, "f")]


def test_letters_of_the_pollution_board(spark):
    rows = spark.createDataFrame([("1", "R"), ("2", "orange"), ("3", "x"), ("4", None)], "consent_file_no string, industry_category string")
    assert {r.source_record_id: r.kspcb_category for r in adapters.adapt(rows, "kspcb").collect()} == {"1": "red", "2": "orange", "3": None, "4": None}


def test_pending_items_and_log(spark):
    queue = spark.createDataFrame([("a", "b", 0.8, 0.7, "pending"), ("a", "c", 0.6, 0.2, "pending"), ("a", "z", 0.6, 0.9, "pending"), ("b", "c", 0.7, 0.9, "decided")], "canonical_id_a string, canonical_id_b string, p double, priority double, status string")
    records = spark.createDataFrame([(x, f"N{x}", "s") for x in "abc"], "canonical_id string, name_raw string, source_system string")
    assert [(r.canonical_id_b, r.name_b) for r in review.pending_items(queue, records).collect()] == [("b", "Nb"), ("c", "Nc")]
    assert [r.canonical_id_b for r in review.pending_items(queue, records, low_stakes=0.5).collect()] == ["c"]
    log = spark.createDataFrame([("a", "z", "confirm", 1), ("a", "b", "reject", 2)], "a string, b string, decision string, decided_at int")
    assert [(r.a, r.b, r.name_b) for r in review.decision_log(log, records).collect()] == [("a", "b", "Nb"), ("a", "z", None)]
    assert [r.n for r in review.retrain_history(spark.createDataFrame([(1, 1), (3, 3), (2, 2)], "started_at int, n int"), 2).collect()] == [3, 2]


def test_recall_counts_pairs_never_retrieved(spark):
    records = spark.createDataFrame([("1", "U"), ("2", "U"), ("3", "U"), ("3", "U"), ("4", None)], "canonical_id string, ubid string")
    row = reports.recall_of_all_pairs(spark.createDataFrame([("1", "2", 0.99), ("1", "3", 0.5), ("1", "4", 1.0)], "a string, b string, p double"), records).first()
    assert (row.pairs, row.retrieved, row.linked, row.recall) == (3, 2, 1, 0.3333)


def test_listed_event_types_are_columns_even_if_unseen(spark):
    long = spark.createDataFrame([("U", "seen", 2, 5, 1.5), ("U", "new", 1, 0, 0.0)], "ubid string, event_type string, n_events bigint, recency_days int, total double")
    wide = entity_features.features(long, ("never", "seen")).first()
    assert (wide.never_n_events, wide.never_recency_days, wide.seen_n_events, wide.new_n_events) == (0, None, 2, 1)


def test_decided_pairs_have_no_features(spark):
    fields = {**adapters.COLUMNS}
    base = {n: None for n in fields}
    rows = [{**base, "canonical_id": i, "name_normalized": "x y", "pan": p, "legal_entity_pan": p, "pin_code": "560001", "pan_is_proprietorship": False} for i, p in (("1", "ABCFE1234F"), ("2", "ABCFE1234F"), ("3", None))]
    records = spark.createDataFrame([tuple(r[n] for n in fields) for r in rows], ", ".join(f"{n} {t}" for n, t in fields.items()))
    whole = F.struct(*records.columns)
    pairs = records.select(F.col("canonical_id").alias("canonical_id_a"), whole.alias("a")).crossJoin(records.select(F.col("canonical_id").alias("canonical_id_b"), whole.alias("b"))).where("canonical_id_a < canonical_id_b")
    got = {(r.canonical_id_a, r.canonical_id_b): r for r in scoring.score_pairs(pairs).collect()}
    assert got["1", "2"].decision == "auto_link" and got["1", "2"].raw_score is None and got["1", "2"].explanation is None
    assert got["1", "3"].raw_score is not None and got["1", "3"].explanation


def test_a_cluster_without_a_shared_folder_is_an_error():
    conf = types.SimpleNamespace(get=lambda *a: None)
    context = types.SimpleNamespace(getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        session.shared_dir(types.SimpleNamespace(conf=conf, sparkContext=context))


def test_streamed_events_keep_their_arrival(spark):
    value = '{"event_id": "e1", "source_system": "fbis", "source_record_id": "r1", "event_type": "fac_inspection", "event_date": "2024-01-02"}'
    mapping = spark.createDataFrame([("fbis", "r1", "U1")], "source_system string, source_record_id string, ubid string")
    joined, waiting, rejected = ingest.process_batch(spark.createDataFrame([(value,)], "value string"), mapping, None)
    assert joined.count() + waiting.count() + rejected.count() == 1
    assert all(r.ingested_at is not None for r in joined.collect())
