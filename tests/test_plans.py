from __future__ import annotations

import pytest

from kinfold.plans import reference

RECORD = "canonical_id string, ingested_at timestamp, source_system string, source_record_id string, name_raw string, name_normalized string, address_raw string, pin_code string, locality_canonical string, taluk string, district string, pan string, phone string, email string, employee_count int, registration_date date, ubid string"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("plans"))
    name = lambda i: f"{'abcdefghij'[i % 10] * 4} works {'pvt ltd' if i % 3 else 'llp'}"
    rows = [(f"C{i:03d}", None, "fbis", f"F{i}", name(i), name(i), f"{i // 2}, Mill Street", "560058", None, None, None, None, None, f"x@d{i // 2}.test", None, None, None if i == 79 else f"U{i // 2}") for i in range(80)]
    spark.createDataFrame(rows, RECORD).write.parquet(f"{at}/canonical_records.parquet")
    pairs = [(f"C{i:03d}", f"C{j:03d}", 0.5, None) for i in range(80) for j in range(i + 1, min(80, i + 4))]
    spark.createDataFrame(pairs, "canonical_id_a string, canonical_id_b string, calibrated_probability double, scored_at timestamp").write.parquet(f"{at}/linkage_pairs.parquet")
    return at


def test_pin_and_door_are_a_block(spark, root):
    got = {(r.canonical_id_a, r.canonical_id_b): r.shared_blocks for r in reference.union_blocking_all(spark, root).collect()}
    assert got["C000", "C001"] == "pin_door" and ("C000", "C002") not in got and got["C000", "C010"] == "pin_name"
    assert {r.block_type: r.n_pairs for r in reference.block_sizes_all(spark, root).collect()}["pin_door"] == 40


def test_pair_features_know_door_mail_and_form(spark, root):
    rows = {(r.canonical_id_a, r.canonical_id_b): r for r in reference.pair_features_all(spark, root).collect()}
    near, far = rows["C000", "C001"], rows["C001", "C002"]
    assert (near.addr_door_eq, near.id_email_domain_eq, near.blk_shared_pin_door, near.struct_legal_form_compat) == (1.0, 1.0, 1.0, 0.2)
    assert (far.addr_door_eq, far.id_email_domain_eq, far.blk_shared_pin_door, far.struct_legal_form_compat) == (0.0, 0.0, 0.0, 1.0)


def test_every_pair_gets_a_trained_score(spark, root):
    rows = reference.trained_scores(spark, root).collect()
    assert len(rows) == reference.pair_features_all(spark, root).count() == 3 * 80 - 6
    assert all(r.raw_score is not None and 0 <= r.calibrated_probability <= 1 for r in rows)
    assert {r.held for r in rows if r.label is not None} == {True, False}
    assert {(r.label, r.held) for r in rows if "C079" in (r.canonical_id_a, r.canonical_id_b)} == {(None, False)}
